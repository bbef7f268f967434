"""Queries of the general training-data operators: hierarchies, orphan references, timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators import hierarchy as H
from stackroom.operators import orphan_refs as O
from stackroom.operators import thesaurus as T
from stackroom.operators import timestamps as S
from stackroom.session import cut
from stackroom.tables import current_articles, table


def _tree(spark: SparkSession, d: str, with_path: bool = False) -> DataFrame:
    return H.hierarchy(T.term_parents(table(spark, d, "thesaurus")), "term_id", "parent_id", with_path)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("id").alias("term_id"), "root_id", "depth")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Per term the path, depth, root, number of terms below and the width of its nested-set range."""
    t = _tree(spark, d, True)
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return t.select(F.col("id").alias("term_id"), "parent_id", "root_id", "depth", "n_descendants", (F.col("hi") - F.col("lo")).alias("width"), "on_loop", path.alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All terms below each term whose id is divisible by 100."""
    t = _tree(spark, d)
    return H.descendants(t, t.where("id % 100 = 0"))


def p1_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All terms below every term; subtrees that hang off a loop are trees of their own."""
    t = cut(H.hierarchy(T.term_parents(table(spark, d, "thesaurus")), "term_id", "parent_id", off_loops=True))
    return H.descendants(t, t)


def _references(spark: SparkSession, d: str) -> DataFrame:
    art = table(spark, d, "orphans_analysis")
    cur = current_articles(art, F.col("path"), F.col("metadata.frontmatter.related").alias("related"), F.col("loaded_at").alias("at"))
    a = cur.select(
        F.lit("orphans_analysis").alias("src_table"), F.col("record_id").alias("src_id"), F.col("path").alias("base"), F.explode("related").alias("entry"), "at"
    )
    toc = table(spark, d, "toc_validation_report").select("report_id", "file", "checked_at", F.explode("cross_references.broken_links").alias("b"))
    # without a url the file is the one that the reason names, from the root
    named = F.regexp_extract(F.col("b.reason"), r"(/?knowledge/[^\s()]+)", 1)
    b = toc.select(
        F.lit("toc_validation_report").alias("src_table"), F.col("report_id").alias("src_id"), F.col("file").alias("base"),
        F.coalesce(F.col("b.link.url"), F.when(named != "", named)).alias("entry"), F.col("checked_at").alias("at"),
    )
    refs = a.unionByName(b)
    # exploding the path, a filter on it doesn't compute it a second time
    return refs.select("src_table", "src_id", F.lit("orphans_analysis").alias("parent_table"), F.explode(F.array(O.plain_path(F.col("entry"), F.col("base")))).alias("key"), "at")


def _articles_as_parents(spark: SparkSession, d: str) -> DataFrame:
    """Per record its path, whether the current row is deleted, and the earliest time it was there."""
    art = table(spark, d, "orphans_analysis").where("path IS NOT NULL")
    status = F.lower(F.trim(F.col("metadata.frontmatter.status")))
    g = art.groupBy("path").agg(F.max_by(F.coalesce(status, F.lit("")), "loaded_at").alias("status"), F.min("loaded_at").alias("since"))
    return g.select(F.lit("orphans_analysis").alias("parent_table"), F.col("path").alias("key"), (F.col("status") == "deleted").alias("deleted"), "since")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.find_orphans(_articles_as_parents(spark, d), _references(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "src_id", F.col("key").alias("target_path"), "kind").distinct()


def p2_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, kind and month."""
    return O.orphan_counts(_orphans(spark, d)).select("src_table", "kind", F.date_format("period", "yyyy-MM").alias("month"), "n_refs", "n_targets")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """The date values of the three tables with their readings, one row per record."""
    zones = S.zone_ids(spark)
    rc = table(spark, d, "recent_changes").select(
        F.lit("recent_changes").alias("src_table"), F.col("change_id").alias("src_id"), F.coalesce("author", F.lit("")).alias("source"),
        F.array("date").alias("values"), "zone",
    )
    art = current_articles(table(spark, d, "orphans_analysis"), F.col("metadata.frontmatter.date").alias("date"), F.col("metadata.frontmatter.source").alias("src"))
    oa = art.select(
        F.lit("orphans_analysis").alias("src_table"), F.col("record_id").alias("src_id"), F.coalesce("src", F.lit("")).alias("source"),
        F.array("date").alias("values"), F.lit(None).cast("string").alias("zone"),
    )
    mv = table(spark, d, "metadata_validation").select(
        F.lit("metadata_validation").alias("src_table"), F.col("validation_id").alias("src_id"), F.lit("").alias("source"),
        F.flatten(F.transform("invalid_fields.date", S.quoted)).alias("values"), F.lit(None).cast("string").alias("zone"),
    )
    rows = rc.unionByName(oa).unionByName(mv).where("src_id IS NOT NULL").distinct()
    # exploding the readings themselves, a filter on them doesn't compute them a second time
    each = F.transform("values", lambda x: S.readings(x, F.col("zone"), zones))
    v = rows.select("src_table", "src_id", "source", F.posexplode(each).alias("pos", "c")).where(F.size("c") > 0)
    # of several quoted texts the first that is a date counts
    return v.groupBy("src_table", "src_id").agg(F.min(F.struct("pos", "source", "c")).alias("r")).select(
        "src_table", "src_id", F.concat_ws("/", "src_table", "r.source").alias("source"), F.col("r.c").alias("c")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = S.choose(_dated(spark, d), "source", "src_id", "c")
    return got.select(F.split("source", "/")[0].alias("src_table"), F.col("ord").alias("src_id"), "utc_ms")


def p6_formats(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each table were read in each format."""
    got = S.choose(_dated(spark, d), "source", "src_id", "c")
    return got.groupBy(F.split("source", "/")[0].alias("src_table"), "fmt").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p1_all_descendants": p1_all_descendants,
    "p2_found": p2_found, "p2_orphan_counts": p2_orphan_counts, "p6_found": p6_found, "p6_formats": p6_formats,
}

KEY = "trim(regexp_replace(lower(n), '[\\s\\x{A0}_-]+', ' ', 'g'), ' ')"
WALK = f"""cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY exported_at DESC) AS rn FROM thesaurus) WHERE rn = 1),
nm AS (SELECT term AS n, term_id, 0 AS rank FROM cur UNION ALL SELECT canonical, term_id, 1 FROM cur UNION ALL SELECT unnest(synonyms), term_id, 2 FROM cur),
owner AS (SELECT key, arg_min(term_id, (rank, term_id)) AS parent FROM (SELECT {KEY} AS key, term_id, rank FROM nm WHERE n IS NOT NULL) WHERE key <> '' GROUP BY key),
asked AS (SELECT term_id, {KEY} AS key, pos FROM (SELECT term_id, unnest(broader) AS n, generate_subscripts(broader, 1) AS pos FROM cur) WHERE n IS NOT NULL),
par AS (SELECT term_id, arg_min(parent, pos) AS parent FROM asked JOIN owner USING (key) GROUP BY term_id),
walk AS (SELECT term_id, term_id AS node, [term_id] AS seen, false AS looped FROM cur UNION ALL SELECT w.term_id, p.parent, list_append(w.seen, p.parent), list_contains(w.seen, p.parent) FROM walk w JOIN par p ON p.term_id = w.node WHERE NOT w.looped),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY len(seen) DESC) AS r FROM walk) WHERE r = 1)"""
PLAIN = r"""
raw AS (SELECT src_table, src_id, base, at_time, regexp_replace(entry, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS raw FROM refs WHERE entry IS NOT NULL),
txt AS (SELECT *, regexp_replace(replace(url_decode(regexp_replace(raw, '[#?][\s\S]*$', '')), '\', '/'), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS t FROM raw
WHERE NOT regexp_matches(raw, '(?i)^(?:[a-z][a-z0-9+.]+:|www\.)') AND NOT regexp_matches(raw, '^[^/\s@]+@[^/\s@]+\.[^/\s@]+$')),
steps AS (SELECT *, string_split(CASE WHEN regexp_matches(t, '^(?:/|knowledge/)') THEN t ELSE regexp_replace(base, '[^/]*$', '') || t END, '/') AS p FROM txt WHERE t <> '' AND base IS NOT NULL),
named AS (SELECT src_table, src_id, at_time, array_to_string(list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END, []), '/') AS target_path FROM steps),
arts AS (SELECT path AS target_path, arg_max(lower(trim(metadata.frontmatter.status)), loaded_at) AS status, min(loaded_at) AS since FROM orphans_analysis GROUP BY path),
kinds AS (SELECT n.*, CASE WHEN a.target_path IS NULL THEN 'missing' WHEN status = 'deleted' THEN 'deleted' WHEN since > at_time THEN 'late' END AS kind FROM named n LEFT JOIN arts a USING (target_path) WHERE n.target_path <> '')"""
REFS = f"""refs AS (SELECT 'orphans_analysis' AS src_table, record_id AS src_id, path AS base, unnest(metadata.frontmatter.related) AS entry, loaded_at AS at_time FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) AS rn FROM orphans_analysis) WHERE rn = 1
UNION ALL SELECT 'toc_validation_report', report_id, file, coalesce(b.link.url, nullif(regexp_extract(b.reason, '(/?knowledge/[^\\s()]+)', 1), '')), checked_at FROM (SELECT report_id, file, checked_at, unnest(cross_references.broken_links) AS b FROM toc_validation_report)),{PLAIN}"""

SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {WALK} SELECT term_id, CASE WHEN looped THEN list_min(seen[list_position(seen, node):]) ELSE node END AS root_id, (CASE WHEN looped THEN -1 ELSE len(seen) - 1 END)::INT AS depth FROM ends",
    "p1_hierarchy": f"""WITH RECURSIVE {WALK}, ring AS (SELECT DISTINCT unnest(seen[list_position(seen, node):]) AS node FROM ends WHERE looped), below AS (SELECT node, count(*) AS n FROM walk WHERE len(seen) > 1 AND NOT looped GROUP BY node)
SELECT e.term_id, p.parent AS parent_id, CASE WHEN looped THEN list_min(seen[list_position(seen, e.node):]) ELSE e.node END AS root_id, (CASE WHEN looped THEN -1 ELSE len(seen) - 1 END)::INT AS depth, CASE WHEN NOT looped THEN coalesce(n, 0) END AS n_descendants, CASE WHEN NOT looped THEN coalesce(n, 0) + 1 END AS width,
e.term_id IN (SELECT node FROM ring) AS on_loop, CASE WHEN NOT looped THEN array_to_string(list_reverse(seen), '>') END AS path FROM ends e LEFT JOIN par p USING (term_id) LEFT JOIN below b ON b.node = e.term_id""",
    "p1_descendants": f"""WITH RECURSIVE {WALK}, up AS (SELECT w.node AS ancestor_id, w.term_id AS descendant_id, (len(w.seen) - 1)::INT AS steps FROM walk w JOIN ends e USING (term_id) WHERE NOT e.looped AND len(w.seen) > 1)
SELECT * FROM up WHERE ancestor_id % 100 = 0""",
    "p1_all_descendants": f"""WITH RECURSIVE {WALK}, ring AS (SELECT DISTINCT unnest(seen[list_position(seen, node):]) AS node FROM ends WHERE looped)
SELECT node AS ancestor_id, term_id AS descendant_id, (len(seen) - 1)::INT AS steps FROM walk WHERE NOT looped AND len(seen) > 1 AND node NOT IN (SELECT node FROM ring)""",
    "p2_found": f"WITH {REFS} SELECT DISTINCT src_table, src_id, target_path, kind FROM kinds WHERE kind IS NOT NULL",
    "p2_orphan_counts": f"""WITH {REFS}, d AS (SELECT DISTINCT src_table, src_id, target_path, kind, at_time FROM kinds WHERE kind IS NOT NULL)
SELECT src_table, kind, strftime(at_time AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_refs, count(DISTINCT target_path) AS n_targets FROM d GROUP BY ALL""",
}
