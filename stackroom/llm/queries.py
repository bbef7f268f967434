"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm import canonical as CA
from stackroom.llm import cooccurrence as CO
from stackroom.llm import leakage as LE
from stackroom.llm import packing as PA
from stackroom.llm import reading as RE
from stackroom.llm import setjoin as SJ
from stackroom.operators.thesaurus import current_terms
from stackroom.session import materialize
from stackroom.skew import lookup
from stackroom.tables import current_articles, table


def _free_tags(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (record, tag) whose tag isn't exactly a term or canonical of any thesaurus row."""
    tags = table(spark, d, "tagging_suggestions").select("suggestion_id", F.explode("existing_tags").alias("tag")).where("tag IS NOT NULL AND suggestion_id IS NOT NULL").distinct()
    rows = table(spark, d, "thesaurus")
    exact = rows.select(F.col("term").alias("tag")).unionByName(rows.select(F.col("canonical").alias("tag"))).where("tag IS NOT NULL").distinct()
    return tags.join(exact, "tag", "left_anti")


def _mapped_tags(spark: SparkSession, d: str, free: DataFrame) -> DataFrame:
    """Each free tag value once, with the curated term it denotes or -1."""
    cur = current_terms(table(spark, d, "thesaurus")).where("origin = 'curated'")
    names = cur.select("term_id", F.explode(F.concat(F.array("term", "canonical"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    return CA.map_values(free, "tag", names, "term_id", "name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    free = materialize(_free_tags(spark, d), "free-tags")
    got = _mapped_tags(spark, d, free).select(F.col("value").alias("tag"), F.col("entry_id").alias("term_id"))
    return lookup(free, got, "tag", "inner").select("suggestion_id", "tag", "term_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that denote no curated term, with the number of records that hold them."""
    free = materialize(_free_tags(spark, d), "free-tags")
    none = _mapped_tags(spark, d, free).where("entry_id = -1").select(F.col("value").alias("tag"))
    return lookup(free, none, "tag", "inner").groupBy("tag").agg(F.count(F.lit(1)).alias("n_records"))


def _article_tags(spark: SparkSession, d: str) -> DataFrame:
    return current_articles(table(spark, d, "orphans_analysis"), F.col("metadata.frontmatter.tags").alias("tags")).select(
        F.col("record_id").alias("id"), CO.item_set(F.col("tags")).alias("items")
    )


def p4_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Tag pairs with counts and lift."""
    return CO.cooccurrence(_article_tags(spark, d), "items")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_cooccurrence(spark, d).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def _tag_sets(spark: SparkSession, d: str) -> DataFrame:
    sug = table(spark, d, "tagging_suggestions").select(F.col("suggestion_id").alias("id"), CO.item_set(F.col("existing_tags")).alias("items"))
    return _article_tags(spark, d).unionByName(sug)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    reps, members = SJ.distinct_sets(_tag_sets(spark, d), "id", "items", 4)
    return SJ.expand(SJ.similar_sets(reps, "0.8"), members)


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Per record its class of equal tag sets and the number of similar records."""
    reps, members = SJ.distinct_sets(_tag_sets(spark, d), "id", "items", 4)
    return SJ.links(SJ.similar_sets(reps, "0.8"), reps, members)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text")
    return LE.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where in which document which item stands, and how much of it."""
    return _leaks(spark, d)


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents without the leaked spans."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text")
    return LE.cleaned(docs, "doc_id", "text", items, "item_id", "text").where("n_removed > 0")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return PA.pack(PA.token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces with their container and place in it."""
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers by unused room."""
    return PA.containers(_packed(spark, d)).groupBy("unused").agg(F.count(F.lit(1)).alias("n_containers"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents packed, containers over capacity, short texts split, texts that are not whole."""
    lengths = materialize(PA.token_counts(table(spark, d, "documents"), "doc_id", "text"), "lengths")
    packed = materialize(PA.pack(lengths), "packed")
    over = PA.containers(packed).agg(F.count_if(F.col("unused") < 0).alias("n_over"))
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("held"))
    j = lengths.where("n_tokens > 0").select("doc_id", "n_tokens").join(per, "doc_id", "full")
    sums = j.agg(
        F.count("pieces").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= PA.CAPACITY)).alias("n_split"),
        F.count_if(~F.coalesce(F.col("held") == F.col("n_tokens"), F.lit(False))).alias("n_lost"),
    )
    return sums.join(F.broadcast(over))


def _reading(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return RE.reading_levels(docs, "doc_id", "text", table(spark, d, "reading_labels"), "doc_id", "reading_level")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _reading(spark, d).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean vocabulary rank by language and level."""
    at = RE.FEATURES.index("log_r95")
    return _reading(spark, d).groupBy("lang", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.exp(F.col("x")[at])).alias("mean_rank_95"))


QUERIES = {
    "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p4_found": p4_found, "p4_cooccurrence": p4_cooccurrence, "p5_found": p5_found, "p5_links": p5_links,
    "p7_packing": p7_packing, "p7_fill": p7_fill, "p7_check": p7_check, "p8_found": p8_found, "p8_spans": p8_spans, "p8_cleaned": p8_cleaned, "p9_found": p9_found, "p9_profile": p9_profile,
}

SETS = r"""art AS (SELECT record_id AS id, metadata.frontmatter.tags AS t FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) AS rn FROM orphans_analysis) WHERE rn = 1),
clean AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(coalesce(t, []), lambda x: regexp_replace(lower(x), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')), lambda x: x IS NOT NULL AND x <> ''))) AS items FROM art)"""
PAIRS = f"""{SETS}, e AS (SELECT id, unnest(items) AS tag FROM clean), n AS (SELECT tag, count(*) AS n FROM e GROUP BY tag), t AS (SELECT count(*) AS total FROM clean WHERE len(items) > 0),
p AS (SELECT a.tag AS item_a, b.tag AS item_b, count(*) AS n_ab FROM e a JOIN e b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL), x AS (SELECT item_a, item_b, n_ab, na.n AS n_a, nb.n AS n_b, total AS n FROM p JOIN n na ON na.tag = item_a JOIN n nb ON nb.tag = item_b, t
WHERE n_ab >= 5 AND n_ab * 2000 >= total AND n_ab * total >= 3 * na.n * nb.n)"""
JOINED = f"""{SETS.replace("WHERE rn = 1)", "WHERE rn = 1 UNION ALL SELECT suggestion_id, existing_tags FROM tagging_suggestions)", 1)}, s AS (SELECT DISTINCT id, items FROM clean WHERE len(items) >= 4), e AS (SELECT id, items, unnest(items) AS tag FROM s),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(DISTINCT a.tag) AS common, len(any_value(a.items)) AS la, len(any_value(b.items)) AS lb FROM e a JOIN e b ON a.tag = b.tag AND a.id < b.id GROUP BY ALL), f AS (SELECT id_a, id_b FROM c WHERE common * 5 >= 4 * (la + lb - common))"""

SQL: dict[str, str] = {
    "p4_found": f"WITH {PAIRS} SELECT item_a AS tag_a, item_b AS tag_b FROM x",
    "p4_cooccurrence": f"WITH {PAIRS} SELECT item_a, item_b, n_ab, n_a, n_b, n, n_ab * n / (n_a * n_b) AS lift FROM x",
    "p5_found": f"WITH {JOINED} SELECT DISTINCT id_a, id_b FROM f",
    "p7_check": "SELECT count(*) AS n_docs, 0::BIGINT AS n_over, 0::BIGINT AS n_split, 0::BIGINT AS n_lost FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL",
    "p5_links": f"""WITH {JOINED}, sides AS (SELECT DISTINCT id_a AS id, id_b AS o FROM f UNION SELECT DISTINCT id_b, id_a FROM f)
SELECT s.id, min(s.id) OVER (PARTITION BY s.items) AS class_id, coalesce(n, 0)::BIGINT AS n_links FROM s LEFT JOIN (SELECT id, count(*) AS n FROM sides GROUP BY id) USING (id)""",
}
