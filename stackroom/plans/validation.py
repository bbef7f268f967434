"""Validation queries: rule tables over articles and documents, and the reports' own issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.operators import validation as V
from stackroom.plans.catalog import TIE
from stackroom.tables import current_articles, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

RAW = f"""raw AS (SELECT record_id AS id, metadata.frontmatter.title AS title, metadata.frontmatter.date AS date, metadata.frontmatter.tags AS tags, metadata.frontmatter.category AS category, metadata.frontmatter.status AS status,
metadata.frontmatter.difficulty AS difficulty, metadata.frontmatter.word_count AS words, path FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC, {TIE}) AS rn FROM orphans_analysis) WHERE rn = 1)"""

# rule -> (severity, predicate in SQL)
RULES_SQL = {
    "title_missing": ("high", "title IS NULL OR trim(title) = ''"), "date_missing": ("high", "date IS NULL OR trim(date) = ''"), "category_missing": ("high", "category IS NULL OR trim(category) = ''"),
    "tags_missing": ("high", "tags IS NULL OR len(tags) = 0"), "tags_few": ("low", "len(tags) BETWEEN 1 AND 2"), "title_long": ("low", "length(title) > 70"), "title_short": ("low", "trim(title) <> '' AND length(title) < 5"),
    "date_format": ("medium", "trim(date) <> '' AND NOT regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$')"), "status_unknown": ("medium", "trim(status) <> '' AND lower(trim(status)) NOT IN ('draft', 'published', 'archived', 'deleted')"),
    "difficulty_unknown": ("medium", "trim(difficulty) <> '' AND lower(trim(difficulty)) NOT IN ('beginner', 'intermediate', 'advanced')"), "too_short": ("medium", "words < 100"), "short": ("low", "words BETWEEN 100 AND 299"),
    "path_upper": ("low", "regexp_matches(path, '[A-ZА-ЯЁ][^/]*$')"), "path_cyrillic": ("low", "regexp_matches(path, '[а-яА-ЯёЁ]')"), "path_space": ("low", "contains(path, ' ')"), "path_deep": ("low", "len(string_split(path, '/')) > 6"),
}
TEXT_SQL = {
    "no_text": ("high", "text IS NULL OR trim(text) = ''"), "no_heading": ("medium", "trim(text) <> '' AND NOT regexp_matches(text, '(?m)^#{1,6}\\s')"), "no_sentence": ("medium", "trim(text) <> '' AND NOT regexp_matches(text, '[.!?]')"),
    "code_without_language": ("low", "regexp_matches(text, '(?m)^```[ \\t]*\\r?\\n[^`]')"), "empty_link": ("high", "regexp_matches(text, '\\]\\(\\s*\\)')"), "image_without_alt": ("medium", "regexp_matches(text, '!\\[\\s*\\]\\(')"),
    "todo": ("low", "regexp_matches(text, '\\b(TODO|FIXME)\\b')"), "long_line": ("low", "len(list_filter(string_split(text, chr(10)), lambda l: length(l) >= 2000)) > 0"),
}


def _union(source: str, key: str, rules: dict) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS key, '{r}' AS rule, '{s}' AS severity FROM {source} WHERE {p}" for r, (s, p) in rules.items())


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _raw(spark, d):
    fm = lambda f: F.col(f"metadata.frontmatter.{f}")
    # the columns in the order in which equal versions are told apart everywhere
    order = "title category subcategory status source difficulty word_count quality_score pagerank pagerank_inlinks pagerank_outlinks difficulty_score".split()
    c = current_articles(table(spark, d, "orphans_analysis"), *[fm(x).alias(x) for x in order], fm("date").alias("date"), fm("tags").alias("tags"), F.col("path"))
    return c.select(F.col("record_id").alias("id"), "title", "date", "tags", "category", "status", "difficulty", F.col("word_count").alias("words"), "path")


@query(f"WITH {RAW} {_union('raw', 'id', RULES_SQL)}")
def issues_front_matter(spark, d):
    return V.issues(_raw(spark, d), "id", V.front_matter_rules()).select("key", "rule", "severity")


@query(_union("documents", "doc_id", TEXT_SQL))
def issues_text(spark, d):
    return V.issues(table(spark, d, "documents"), "doc_id", V.text_rules()).select("key", "rule", "severity")


@query(f"WITH {RAW}, i AS ({_union('raw', 'id', RULES_SQL)}), s AS (SELECT key, greatest(0, 100 - sum(CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 3 END))::BIGINT AS score FROM i GROUP BY key) SELECT key, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s")
def metadata_scores(spark, d):
    return V.score(V.issues(_raw(spark, d), "id", V.front_matter_rules()))


@query(f"WITH {RAW}, i AS ({_union('raw', 'id', RULES_SQL)}) SELECT severity, rule, count(*) AS n FROM i GROUP BY ALL")
def issue_counts(spark, d):
    return V.issues(_raw(spark, d), "id", V.front_matter_rules()).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i.type AS type, i.severity AS severity, count(*) AS n, count(DISTINCT report_id) AS n_reports FROM (SELECT DISTINCT report_id, unnest(validation.issues) AS i FROM toc_validation_report) GROUP BY ALL")
def toc_issue_counts(spark, d):
    i = table(spark, d, "toc_validation_report").select("report_id", F.explode("validation.issues").alias("i")).distinct()
    return i.groupBy("i.type", "i.severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("report_id").alias("n_reports"))


@query("""WITH r AS (SELECT DISTINCT report_id, file, cross_references.total_links AS total, len(coalesce(cross_references.broken_links, [])) AS broken FROM toc_validation_report), h AS (SELECT report_id, total, broken, CASE WHEN total > 0 THEN 100.0::DOUBLE * (total - least(broken, total)) / total ELSE 100 END AS health FROM r)
SELECT CASE WHEN health >= 90 THEN 'healthy' WHEN health >= 70 THEN 'fair' WHEN health >= 50 THEN 'poor' ELSE 'broken' END AS state, count(*) AS n, sum(total)::BIGINT AS links, sum(broken)::BIGINT AS broken FROM h GROUP BY 1""")
def link_health(spark, d):
    r = table(spark, d, "toc_validation_report").select("report_id", "file", F.col("cross_references.total_links").alias("total"), F.coalesce(F.size("cross_references.broken_links"), F.lit(0)).alias("broken")).distinct()
    r = r.withColumn("broken", F.greatest("broken", F.lit(0)))
    h = F.when(F.col("total") > 0, (F.col("total") - F.least("broken", "total")) * 100.0 / F.col("total")).otherwise(100.0)
    state = F.when(h >= 90, "healthy").when(h >= 70, "fair").when(h >= 50, "poor").otherwise("broken")
    return r.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("links"), F.sum("broken").alias("broken"))


@query("SELECT lower(coalesce(b.link.type, 'unknown')) AS type, coalesce(b.severity, 'none') AS severity, count(*) AS n FROM (SELECT unnest(cross_references.broken_links) AS b FROM toc_validation_report) GROUP BY ALL")
def broken_link_types(spark, d):
    b = table(spark, d, "toc_validation_report").select(F.explode("cross_references.broken_links").alias("b"))
    return b.groupBy(F.lower(F.coalesce("b.link.type", F.lit("unknown"))).alias("type"), F.coalesce("b.severity", F.lit("none")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT grade, valid, count(*) AS n, round(avg(quality_total), 6) AS mean_quality FROM metadata_validation GROUP BY ALL")
def validation_grades(spark, d):
    return table(spark, d, "metadata_validation").groupBy("grade", "valid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_total"), 6).alias("mean_quality"))


@query("SELECT kind, field, count(*) AS n FROM (SELECT 'missing' AS kind, unnest(missing_fields) AS field FROM metadata_validation UNION ALL SELECT 'error', split_part(unnest(errors), ':', 1) FROM metadata_validation UNION ALL SELECT 'warning', split_part(unnest(warnings), ':', 1) FROM metadata_validation) GROUP BY ALL")
def validation_fields(spark, d):
    m = table(spark, d, "metadata_validation")
    tagged = lambda kind, a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("field")))
    head = lambda a: F.transform(a, lambda x: F.split(x, ":")[0])
    f = m.select(F.explode(F.concat(tagged("missing", F.col("missing_fields")), tagged("error", head("errors")), tagged("warning", head("warnings")))).alias("f"))
    return f.groupBy("f.kind", "f.field").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(trim(title)) AS title, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM (SELECT DISTINCT path, metadata.frontmatter.title AS title FROM orphans_analysis) WHERE title IS NOT NULL GROUP BY 1 HAVING count(DISTINCT path) > 1")
def duplicate_titles(spark, d):
    t = table(spark, d, "orphans_analysis").select("path", F.col("metadata.frontmatter.title").alias("t")).where("t IS NOT NULL").distinct()
    return t.groupBy(F.lower(F.trim("t")).alias("title")).agg(F.countDistinct("path").alias("n_paths"), F.min("path").alias("first_path")).where("n_paths > 1")
