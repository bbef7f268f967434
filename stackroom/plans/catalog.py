"""Queries over the articles: facets, statistics, tags, taxonomy, quality, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.operators import catalog as C
from stackroom.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Rows of one record loaded at the same time: the greatest values count, column by column.
TIE = ", ".join(f"metadata.frontmatter.{c} DESC NULLS LAST" for c in "title category subcategory status source difficulty word_count quality_score pagerank pagerank_inlinks pagerank_outlinks difficulty_score".split())
#: The articles in SQL: current row per record with cleaned columns.
ART = f"""cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC, {TIE}) AS rn FROM orphans_analysis) WHERE rn = 1),
art AS (SELECT record_id AS id, path, metadata.frontmatter.title AS title, coalesce(nullif(trim(lower(metadata.frontmatter.category)), ''), 'misc') AS category, coalesce(metadata.frontmatter.subcategory, '-') AS subcategory,
coalesce(nullif(trim(lower(metadata.frontmatter.status)), ''), 'draft') AS status, coalesce(metadata.frontmatter.source, 'unknown') AS author, coalesce(nullif(trim(lower(metadata.frontmatter.difficulty)), ''), 'unknown') AS difficulty,
coalesce(list_sort(list_distinct(list_filter(list_transform(metadata.frontmatter.tags, lambda t: trim(lower(t), ' ')), lambda t: t IS NOT NULL AND t <> ''))), []) AS tags, len(coalesce(metadata.frontmatter.related, [])) AS n_related,
metadata.frontmatter.word_count AS words, metadata.frontmatter.quality_score AS quality, metadata.frontmatter.pagerank AS pagerank, metadata.frontmatter.pagerank_inlinks AS inlinks, metadata.frontmatter.pagerank_outlinks AS outlinks,
metadata.frontmatter.difficulty_score AS difficulty_score, metadata.frontmatter.quality_metrics AS qm, metadata.content_length AS chars, (metadata.modified_date AT TIME ZONE 'UTC') AS modified, metadata.age_days AS age, loaded_at,
classification.type AS orphan_type, classification.severity AS severity FROM cur)"""
TAGS = "tg AS (SELECT id, category, words, age, quality, unnest(tags) AS tag FROM art)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def arts(spark: SparkSession, d: str) -> DataFrame:
    return C.articles(table(spark, d, "orphans_analysis"))


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"""WITH {ART} SELECT category, count(*) AS n, sum(words)::BIGINT AS words, round(avg(words), 6) AS mean_words, min(words)::INT AS least_words, max(words)::INT AS most_words,
count(DISTINCT subcategory) AS n_subcategories, round(avg(quality), 6) AS mean_quality FROM art GROUP BY category""")
def category_stats(spark, d):
    return arts(spark, d).groupBy("category").agg(
        n(), F.sum("words").alias("words"), r6(F.avg("words"), "mean_words"), F.min("words").alias("least_words"), F.max("words").alias("most_words"),
        F.countDistinct("subcategory").alias("n_subcategories"), r6(F.avg("quality"), "mean_quality"),
    )


@query(f"""WITH {ART}, f AS (SELECT 'category' AS facet, category AS value FROM art UNION ALL SELECT 'status', status FROM art UNION ALL SELECT 'author', author FROM art UNION ALL SELECT 'difficulty', difficulty FROM art
UNION ALL SELECT 'year', strftime(modified, '%Y') FROM art UNION ALL SELECT 'month', strftime(modified, '%Y-%m') FROM art UNION ALL SELECT 'tag', unnest(tags) FROM art) SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL""")
def facet_counts(spark, d):
    return C.facet_counts(arts(spark, d))


@query(f"""WITH {ART} SELECT id, path FROM art WHERE category = 'computers' AND status = 'published' AND list_has_any(tags, ['встроенный соус', 'встроенный-соус', 'ручной бульон']) AND contains(lower(title), 'о')""")
def filter_articles(spark, d):
    a = C.filter_articles(arts(spark, d), {"category": "computers", "status": "published"}, any_tags=["встроенный соус", "встроенный-соус", "ручной бульон"], title="о")
    return a.select("id", "path")


@query(f"""WITH {ART} SELECT id FROM art WHERE list_has_all(tags, ['ручной бульон']) AND category <> 'misc'""")
def filter_all_tags(spark, d):
    return C.filter_articles(arts(spark, d), all_tags=["ручной бульон"]).where("category <> 'misc'").select("id")


@query(f"""WITH {ART} SELECT id, path FROM art WHERE contains(lower(coalesce(title, '')), 'салат') OR contains(category, 'салат') OR len(list_filter(tags, lambda t: contains(t, 'салат'))) > 0""")
def substring_search(spark, d):
    return C.search(arts(spark, d), "салат").select("id", "path")


@query(f"""WITH {ART} SELECT 'overall' AS scope, count(*) AS n, sum(words)::BIGINT AS words, round(avg(words), 6) AS mean_words, round(100.0::DOUBLE * count(title) / count(*), 6) AS with_title,
round(100.0::DOUBLE * sum((len(tags) > 0)::INT) / count(*), 6) AS with_tags, round(100.0::DOUBLE * sum((n_related > 0)::INT) / count(*), 6) AS with_related, round(avg(len(tags)), 6) AS mean_tags FROM art""")
def corpus_overview(spark, d):
    share = lambda c, name: r6(F.sum(c.cast("int")) * 100.0 / F.count(F.lit(1)), name)
    return arts(spark, d).agg(
        F.lit("overall").alias("scope"), n(), F.sum("words").alias("words"), r6(F.avg("words"), "mean_words"), share(F.col("title").isNotNull(), "with_title"),
        share(F.size("tags") > 0, "with_tags"), share(F.col("n_related") > 0, "with_related"), r6(F.avg(F.size("tags")), "mean_tags"),
    )


@query(f"""WITH {ART} SELECT CASE WHEN quality >= 90 THEN 'A+' WHEN quality >= 80 THEN 'A' WHEN quality >= 70 THEN 'B' WHEN quality >= 60 THEN 'C' WHEN quality >= 50 THEN 'D' ELSE 'F' END AS grade, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM art WHERE quality IS NOT NULL GROUP BY 1""")
def quality_grades(spark, d):
    return arts(spark, d).where("quality IS NOT NULL").groupBy(C.grade(F.col("quality")).alias("grade")).agg(n(), r6(F.avg("quality"), "mean_quality"))


@query(f"""WITH {ART} SELECT id, round(0.20::DOUBLE * qm.completeness + 0.20::DOUBLE * qm.structure + 0.15::DOUBLE * qm.links + 0.15::DOUBLE * qm.examples + 0.20::DOUBLE * qm.readability + 0.10::DOUBLE * qm.freshness, 6) AS overall FROM art WHERE qm IS NOT NULL""")
def quality_overall(spark, d):
    return arts(spark, d).where("qm IS NOT NULL").select("id", r6(C.overall_quality(F.col("qm")), "overall"))


@query(f"""WITH {ART}, b AS (SELECT CASE WHEN quality >= 80 THEN '80-100' WHEN quality >= 60 THEN '60-79' WHEN quality >= 40 THEN '40-59' WHEN quality >= 20 THEN '20-39' ELSE '0-19' END AS bucket FROM art WHERE quality IS NOT NULL) SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def quality_buckets(spark, d):
    q = F.col("quality")
    b = F.when(q >= 80, "80-100").when(q >= 60, "60-79").when(q >= 40, "40-59").when(q >= 20, "20-39").otherwise("0-19")
    return arts(spark, d).where("quality IS NOT NULL").groupBy(b.alias("bucket")).agg(n())


@query(f"WITH {ART} SELECT id, quality, inlinks FROM art WHERE quality > 60 AND inlinks < 3 ORDER BY quality DESC, id LIMIT 10")
def hidden_gems(spark, d):
    return arts(spark, d).where("quality > 60 AND inlinks < 3").orderBy(F.desc("quality"), "id").limit(10).select("id", "quality", "inlinks")


@query(f"WITH {ART}, r AS (SELECT category, id, words, row_number() OVER (PARTITION BY category ORDER BY words DESC, id) AS rank FROM art WHERE words IS NOT NULL) SELECT category, id, words, rank::INT AS rank FROM r WHERE rank <= 10")
def longest_per_category(spark, d):
    w = W.partitionBy("category").orderBy(F.desc("words"), "id")
    return arts(spark, d).where("words IS NOT NULL").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("category", "id", "words", "rank")


@query(f"""WITH {ART}, p AS (SELECT category, count(*) AS c FROM art GROUP BY category), t AS (SELECT sum(c) AS s, count(*) AS k FROM p)
SELECT round(-sum(c / s * ln(c / s)), 6) AS entropy_ln, round(-sum(c / s * log2(c / s)), 6) AS entropy_log2, round(-100 * sum(c / s * sqrt(c / s)), 6) AS diversity_sqrt, round(-sum(c / s * ln(c / s)) / ln(max(k)), 6) AS evenness FROM p, t""")
def category_diversity(spark, d):
    return C.diversity(arts(spark, d), "category")


@query(f"""WITH {ART}, m AS (SELECT strftime(modified, '%Y-%m') AS month, count(*) AS n, count(DISTINCT category) AS n_categories, count(DISTINCT author) AS n_authors FROM art WHERE modified IS NOT NULL GROUP BY 1)
SELECT month, n, n_categories, n_authors, coalesce(n - lag(n) OVER (ORDER BY month), 0)::BIGINT AS delta, sum(n) OVER (ORDER BY month)::BIGINT AS total FROM m""")
def growth_by_month(spark, d):
    return C.growth(arts(spark, d))


@query(f"""WITH {ART}, m AS (SELECT strftime(modified, '%Y-%m') AS month, count(*) AS n FROM art WHERE modified IS NOT NULL GROUP BY 1), l AS (SELECT * FROM m ORDER BY month DESC LIMIT 6), r AS (SELECT avg(n) AS rate FROM l), t AS (SELECT count(*) AS total FROM art)
SELECT i::INT AS months_ahead, floor(total + rate * i)::BIGINT AS forecast FROM r, t, unnest([1, 2, 3]) AS u(i)""")
def growth_forecast(spark, d):
    return C.forecast(arts(spark, d), 3)


@query(f"""WITH {ART}, a AS (SELECT author, count(*) AS n, count(DISTINCT category) AS n_categories, round(avg(len(tags)), 6) AS mean_tags FROM art GROUP BY author) SELECT * FROM a WHERE n >= 3""")
def prolific_authors(spark, d):
    return arts(spark, d).groupBy("author").agg(n(), F.countDistinct("category").alias("n_categories"), r6(F.avg(F.size("tags")), "mean_tags")).where("n >= 3")


@query(f"WITH {ART} SELECT author, category, count(*) AS n FROM art GROUP BY ALL")
def author_category_matrix(spark, d):
    return arts(spark, d).groupBy("author", "category").agg(n())


@query(f"WITH {ART} SELECT CASE WHEN regexp_matches(upper(substr(title, 1, 1)), '[А-ЯЁA-Z]') THEN upper(substr(title, 1, 1)) ELSE '#' END AS letter, count(*) AS n FROM art WHERE title IS NOT NULL GROUP BY 1")
def card_catalog_letters(spark, d):
    first = F.upper(F.substring("title", 1, 1))
    return arts(spark, d).where("title IS NOT NULL").groupBy(F.when(first.rlike("[А-ЯЁA-Z]"), first).otherwise("#").alias("letter")).agg(n())


# tags


@query(f"WITH {ART}, {TAGS} SELECT tag, count(*) AS n, count(DISTINCT category) AS n_categories, min(id) AS first_id FROM tg GROUP BY tag")
def tag_counts(spark, d):
    return C.article_tags(arts(spark, d)).groupBy("tag").agg(n(), F.countDistinct("category").alias("n_categories"), F.min("id").alias("first_id"))


@query(f"""WITH {ART}, {TAGS}, c AS (SELECT tag, count(*) AS n FROM tg GROUP BY tag), m AS (SELECT min(n) AS lo, max(n) AS hi FROM c), x AS (SELECT tag, n, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (ln(n) - ln(lo)) / (ln(hi) - ln(lo)) END AS weight FROM c, m)
SELECT tag, n, round(weight, 6) AS weight, CASE WHEN weight >= 0.8 THEN 'xl' WHEN weight >= 0.6 THEN 'l' WHEN weight >= 0.4 THEN 'm' WHEN weight >= 0.2 THEN 's' ELSE 'xs' END AS size_class FROM x""")
def tag_cloud_sizes(spark, d):
    return C.size_classes(C.article_tags(arts(spark, d)))


@query(f"""WITH {ART}, {TAGS}, c AS (SELECT tag, count(*) AS n FROM tg GROUP BY tag), m AS (SELECT min(n) AS lo, max(n) AS hi FROM c) SELECT tag, CASE WHEN hi = lo THEN 5.0::DOUBLE ELSE round(1 + 9 * (n - lo) / (hi - lo), 1) END AS weight FROM c, m""")
def tag_cloud_linear(spark, d):
    c = C.article_tags(arts(spark, d)).groupBy("tag").agg(n())
    m = c.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return c.join(F.broadcast(m), F.lit(True)).select("tag", F.when(F.col("hi") == F.col("lo"), 5.0).otherwise(F.round(1 + (F.col("n") - F.col("lo")) * 9 / (F.col("hi") - F.col("lo")), 1)).alias("weight"))


@query(f"""WITH {ART}, {TAGS}, n AS (SELECT count(*) AS total FROM art), g AS (SELECT tag, count(*) AS c, avg(age) AS a, avg(words) AS w FROM tg GROUP BY tag),
x AS (SELECT tag, c, least(100, 10 * c) AS frequency, greatest(0, coalesce(100 - a / 3, 0)) AS recency, least(100, coalesce(w / 50, 0)) AS importance, 30 * ln(total / c) AS spec FROM g, n)
SELECT tag, round(0.4::DOUBLE * frequency + 0.2::DOUBLE * recency + 0.2::DOUBLE * importance + 0.2::DOUBLE * least(100, spec), 6) AS weight,
CASE WHEN c <= 2 AND recency > 70 THEN 'emerging' WHEN c >= 5 AND recency > 50 THEN 'mature' WHEN recency < 30 THEN 'declining' ELSE 'growing' END AS stage FROM x""")
def tag_weights(spark, d):
    a = arts(spark, d)
    return C.tag_weights(C.article_tags(a), a.agg(F.count(F.lit(1)).alias("total"))).select("tag", r6(F.col("weight"), "weight"), "stage")


@query(f"""WITH {ART}, {TAGS}, k AS (SELECT tag, category, count(*) AS c FROM tg GROUP BY ALL), t AS (SELECT tag, sum(c) AS s, count(*) AS kinds FROM k GROUP BY tag)
SELECT tag, round(CASE WHEN max(kinds) > 1 THEN -sum(c / s * log2(c / s)) / log2(max(kinds)) * 100 ELSE 0 END, 6) AS entropy FROM k JOIN t USING (tag) GROUP BY tag""")
def tag_entropy(spark, d):
    return C.tag_entropy(C.article_tags(arts(spark, d)))


@query(f"""WITH {ART}, {TAGS}, p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM tg a JOIN tg b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL) SELECT * FROM p WHERE n >= 3""")
def tag_cooccurrence(spark, d):
    return C.tag_pairs(C.article_tags(arts(spark, d)), 3)


@query(f"""WITH {ART}, {TAGS}, p AS (SELECT a.tag AS tag, b.tag AS other, count(*) AS n FROM tg a JOIN tg b ON a.id = b.id AND a.tag <> b.tag GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS rank FROM p)
SELECT tag, other, n, rank::INT AS rank FROM r WHERE rank <= 5""")
def related_tags(spark, d):
    p = C.tag_pairs(C.article_tags(arts(spark, d)), 2)
    both = p.select(F.col("tag_a").alias("tag"), F.col("tag_b").alias("other"), "n").unionByName(p.select(F.col("tag_b").alias("tag"), F.col("tag_a").alias("other"), "n"))
    w = W.partitionBy("tag").orderBy(F.desc("n"), "other")
    return both.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query(f"WITH {ART} SELECT len(tags)::INT AS n_tags, count(*) AS n FROM art GROUP BY 1")
def tag_coverage(spark, d):
    return arts(spark, d).groupBy(F.size("tags").alias("n_tags")).agg(n())


@query(f"""WITH {ART}, {TAGS}, c AS (SELECT tag, count(*) AS n FROM tg GROUP BY tag) SELECT count(*) AS n_tags, sum(n)::BIGINT AS uses, sum((n = 1)::INT)::BIGINT AS singletons, round(avg(n), 6) AS mean_uses, max(n) AS most FROM c""")
def tag_totals(spark, d):
    c = C.article_tags(arts(spark, d)).groupBy("tag").agg(n())
    return c.agg(F.count(F.lit(1)).alias("n_tags"), F.sum("n").alias("uses"), F.sum((F.col("n") == 1).cast("int")).alias("singletons"), r6(F.avg("n"), "mean_uses"), F.max("n").alias("most"))


@query(f"""WITH {ART}, {TAGS}, c AS (SELECT tag, count(*) AS c, sum(coalesce(words, 0) + 10 * 1)::BIGINT AS weight FROM tg GROUP BY tag) SELECT tag, c AS n, weight FROM c ORDER BY weight DESC, tag LIMIT 30""")
def weighted_tags(spark, d):
    g = C.article_tags(arts(spark, d)).groupBy("tag").agg(n(), F.sum(F.coalesce("words", F.lit(0)) + 10).alias("weight"))
    return g.orderBy(F.desc("weight"), "tag").limit(30)


@query(f"""WITH {ART}, {TAGS}, t AS (SELECT DISTINCT CASE WHEN length(tag) > 3 AND ends_with(tag, 's') AND NOT regexp_matches(tag, '(ss|is|us)$') THEN replace(left(tag, length(tag) - 1), '-', '_') ELSE replace(tag, '-', '_') END AS normal, tag FROM tg)
SELECT normal, count(*) AS n_forms, min(tag) AS example FROM t GROUP BY normal""")
def tag_normal_forms(spark, d):
    t = C.article_tags(arts(spark, d)).select(C.normal_tag(F.col("tag")).alias("normal"), "tag").distinct()
    return t.groupBy("normal").agg(n("n_forms"), F.min("tag").alias("example"))


# taxonomy


@query(f"""WITH {ART}, x AS (SELECT category AS c, subcategory AS s, CASE WHEN len(tags) > 0 THEN tags[1] ELSE '-' END AS t FROM art) SELECT coalesce(c, '*') AS category, coalesce(s, '*') AS subcategory, coalesce(t, '*') AS tag, count(*) AS n, grouping(c, s, t)::INT AS level
FROM x GROUP BY ROLLUP (c, s, t)""")
def taxonomy_rollup(spark, d):
    return C.taxonomy(arts(spark, d))


@query(f"""WITH {ART}, x AS (SELECT category, count(DISTINCT subcategory) AS breadth, count(*) AS n, max(len(string_split(path, '/')) - 1)::INT AS max_depth, round(avg(len(string_split(path, '/')) - 1), 6) AS mean_depth FROM art GROUP BY category) SELECT * FROM x""")
def taxonomy_depth(spark, d):
    depth = F.size(F.split("path", "/")) - 1
    return arts(spark, d).groupBy("category").agg(F.countDistinct("subcategory").alias("breadth"), n(), F.max(depth).alias("max_depth"), r6(F.avg(depth), "mean_depth"))


@query(f"WITH {ART}, s AS (SELECT category, subcategory, count(*) AS n FROM art GROUP BY ALL) SELECT category, subcategory, n, CASE WHEN n = 1 THEN 'orphan' WHEN n > 50 THEN 'overpopulated' ELSE 'ok' END AS state FROM s")
def category_balance(spark, d):
    s = arts(spark, d).groupBy("category", "subcategory").agg(n())
    return s.withColumn("state", F.when(F.col("n") == 1, "orphan").when(F.col("n") > 50, "overpopulated").otherwise("ok"))


@query(f"WITH {ART}, p AS (SELECT id, string_split(path, '/') AS s FROM art), e AS (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM p) SELECT id, i::INT AS level, s[i] AS crumb, array_to_string(s[1:i], '/') AS trail FROM e")
def breadcrumbs(spark, d):
    return C.breadcrumbs(arts(spark, d))


# orphans, dates, exports


@query(f"WITH {ART} SELECT orphan_type, severity, count(*) AS n, round(avg(age), 6) AS mean_age FROM art GROUP BY ALL")
def orphan_classes(spark, d):
    return arts(spark, d).groupBy("orphan_type", "severity").agg(n(), r6(F.avg("age"), "mean_age"))


@query(f"""WITH {ART}, o AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir, CASE WHEN age < 7 THEN 'new' WHEN age < 30 THEN 'recent' WHEN age < 90 THEN 'established' ELSE 'old' END AS age_class FROM art WHERE inlinks = 0)
SELECT category, age_class, count(*) AS n, count(DISTINCT dir) AS n_dirs FROM o GROUP BY ALL""")
def orphan_clusters(spark, d):
    a = F.col("age")
    o = arts(spark, d).where("inlinks = 0").withColumn("dir", F.regexp_replace("path", "[^/]*$", ""))
    return o.groupBy("category", F.when(a < 7, "new").when(a < 30, "recent").when(a < 90, "established").otherwise("old").alias("age_class")).agg(n(), F.countDistinct("dir").alias("n_dirs"))


@query(f"""WITH {ART} SELECT id, CASE WHEN age < 30 THEN 100 WHEN age < 90 THEN 90 WHEN age < 180 THEN 75 WHEN age < 365 THEN 60 WHEN age < 730 THEN 40 ELSE 20 END AS freshness,
CASE WHEN age < 1 THEN 'always' WHEN age < 7 THEN 'daily' WHEN age < 30 THEN 'weekly' WHEN age < 90 THEN 'monthly' WHEN age < 365 THEN 'yearly' ELSE 'never' END AS changefreq FROM art WHERE age IS NOT NULL""")
def freshness(spark, d):
    a = arts(spark, d).where("age IS NOT NULL")
    return a.select("id", C.freshness(F.col("age")).alias("freshness"), C.change_frequency(F.col("age")).alias("changefreq"))


@query(f"""WITH {ART}, p AS (SELECT id, path, round(least(1.0, 0.5 + 0.1 * (len(string_split(path, '/')) <= 4)::INT + 0.1 * (coalesce(words, 0) > 300)::INT + 0.1 * (coalesce(inlinks, 0) > 2)::INT + 0.1 * (coalesce(outlinks, 0) > 2)::INT), 2)::DOUBLE AS priority FROM art WHERE path IS NOT NULL)
SELECT path, priority, ((row_number() OVER (ORDER BY priority DESC, path) - 1) // 1000)::INT AS sitemap FROM p""")
def sitemap_rows(spark, d):
    return C.sitemap(arts(spark, d), 1000)


@query(f"""WITH {ART} SELECT id, 'kb' || id || coalesce(lower(regexp_extract(title, '^([^\\s:.,]+)', 1)), '') AS cite_key, '@article{{kb' || id || coalesce(lower(regexp_extract(title, '^([^\\s:.,]+)', 1)), '') || ', title = {{' || coalesce(title, '') || '}}, author = {{' || author || '}}}}' AS entry FROM art""")
def bibtex_entries(spark, d):
    return C.bibtex(arts(spark, d))


@query(f"WITH {ART} SELECT id, path || ';' || replace(coalesce(title, ''), '\"', '\"\"') || ';' || category || ';' || array_to_string(tags, ',') AS line FROM art")
def export_csv_lines(spark, d):
    return arts(spark, d).select("id", F.concat_ws(";", "path", F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit('""')), "category", F.array_join("tags", ",")).alias("line"))


@query(f"""WITH {ART}, w AS (SELECT category, difficulty, words, row_number() OVER (PARTITION BY category ORDER BY difficulty_score, id) AS position, id, difficulty_score AS score FROM art WHERE difficulty_score IS NOT NULL)
SELECT category, id, position::INT AS position, score, coalesce(lag(id) OVER (PARTITION BY category ORDER BY position), -1) AS previous_id, coalesce(lead(id) OVER (PARTITION BY category ORDER BY position), -1) AS next_id FROM w""")
def learning_path(spark, d):
    return C.learning_path(arts(spark, d))


@query(f"""WITH {ART}, g AS (SELECT category, count(*) AS total, sum((status = 'published')::INT)::BIGINT AS done, sum((status = 'draft')::INT)::BIGINT AS in_progress FROM art GROUP BY category) SELECT category, total, done, in_progress, total - done - in_progress AS rest, round(100.0::DOUBLE * done / total, 6) AS pct FROM g""")
def category_progress(spark, d):
    g = arts(spark, d).groupBy("category").agg(n("total"), F.sum((F.col("status") == "published").cast("int")).alias("done"), F.sum((F.col("status") == "draft").cast("int")).alias("in_progress"))
    return g.withColumn("rest", F.col("total") - F.col("done") - F.col("in_progress")).withColumn("pct", F.round(F.col("done") * 100.0 / F.col("total"), 6))


@query(f"""WITH {ART}, {TAGS}, c AS (SELECT tag, count(*) AS c FROM tg GROUP BY tag), s AS (SELECT tg.id, sum(c.c)::BIGINT AS score FROM tg JOIN c USING (tag) GROUP BY tg.id) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10""")
def trending_by_tags(spark, d):
    t = C.article_tags(arts(spark, d))
    c = t.groupBy("tag").agg(n("c"))
    return t.join(c, "tag").groupBy("id").agg(F.sum("c").alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"""WITH {ART} SELECT round(corr(words, quality), 6) AS words_quality, round(corr(inlinks, pagerank), 6) AS inlinks_pagerank, round(corr(age, quality), 6) AS age_quality FROM art""")
def correlations(spark, d):
    return arts(spark, d).agg(r6(F.corr("words", "quality"), "words_quality"), r6(F.corr("inlinks", "pagerank"), "inlinks_pagerank"), r6(F.corr("age", "quality"), "age_quality"))


@query(f"""WITH {ART}, s AS (SELECT list_sort(list(words)) AS v FROM art WHERE words IS NOT NULL), q AS (SELECT v[len(v) // 4 + 1] AS q1, v[3 * len(v) // 4 + 1] AS q3 FROM s)
SELECT id, words FROM art, q WHERE words < q1 - 1.5 * (q3 - q1) OR words > q3 + 1.5 * (q3 - q1)""")
def outliers_iqr(spark, d):
    return C.iqr_outliers(arts(spark, d), "words").select("id", "words")


@query(f"""WITH {ART}, q AS (SELECT count(words) AS n, avg(words) AS m, median(words) AS med, min(words) AS lo, max(words) AS hi, var_pop(words) AS v, stddev_pop(words) AS s FROM art) SELECT n, round(m, 6) AS mean, med::DOUBLE AS median, lo::INT AS least, hi::INT AS most, round(v, 4) AS variance, round(s, 6) AS deviation FROM q""")
def descriptive_statistics(spark, d):
    w = F.col("words")
    return arts(spark, d).agg(F.count(w).alias("n"), r6(F.avg(w), "mean"), F.median(w).alias("median"), F.min(w).alias("least"), F.max(w).alias("most"), F.round(F.var_pop(w), 4).alias("variance"), r6(F.stddev_pop(w), "deviation"))
