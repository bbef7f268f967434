"""External links of the table-of-contents reports, searches by tag, query expansion and boosted fields."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.functions import text as T
from stackroom.operators import weblinks as L
from stackroom.operators.catalog import article_tags
from stackroom.plans.catalog import ART, arts
from stackroom.tables import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Web addresses in SQL: one row per link of a report.
WEB = r"""lk AS (SELECT report_id, file AS article, split_part(file, '/', 2) AS category, b.link.url AS url, (checked_at AT TIME ZONE 'UTC') AS at_time, regexp_extract(lower(trim(b.link.url)), '^https?://(?:www\.)?([^/:?#\s]+)', 1) AS domain FROM (SELECT report_id, file, checked_at, unnest(cross_references.broken_links) AS b FROM toc_validation_report)),
ex AS (SELECT * FROM lk WHERE domain <> ''),
dm AS (SELECT domain, count(DISTINCT article) AS n_articles, count(*) AS n_citations, count(DISTINCT category) AS n_categories, count(DISTINCT url) AS n_urls, min(at_time) AS first_seen, max(at_time) AS last_seen FROM ex GROUP BY domain),
au AS (SELECT *, least(100, 10 * n_articles) * 0.4::DOUBLE + least(100, 5 * n_citations) * 0.4::DOUBLE + least(100, 20 * n_categories) * 0.2::DOUBLE AS authority FROM dm),
tr AS (SELECT *, greatest(0, least(100, authority - CASE WHEN n_articles = 1 THEN 20 ELSE 0 END - CASE WHEN n_categories = 0 THEN 10 ELSE 0 END + CASE WHEN n_categories >= 3 THEN 10 ELSE 0 END)) AS trust FROM au)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def links(spark, d):
    t = table(spark, d, "toc_validation_report").select("report_id", "file", "checked_at", F.explode("cross_references.broken_links").alias("b"))
    return t.select("report_id", F.col("file").alias("article"), F.split("file", "/")[1].alias("category"), F.col("b.link.url").alias("url"), F.col("checked_at").alias("at"))


@query(f"WITH {WEB} SELECT domain, n_articles, n_citations, n_categories, n_urls, round(authority, 6) AS authority, round(trust, 6) AS trust FROM tr")
def domain_authority(spark, d):
    """Use, authority and trust of every external domain."""
    return L.domains(links(spark, d)).select("domain", "n_articles", "n_citations", "n_categories", "n_urls", F.round("authority", 6).alias("authority"), F.round("trust", 6).alias("trust"))


@query(f"WITH {WEB} SELECT domain, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen FROM dm")
def domain_lifetimes(spark, d):
    return L.domains(links(spark, d)).select("domain", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


@query(f"WITH {WEB} SELECT category, count(DISTINCT domain) AS n_domains, count(DISTINCT article) AS n_articles, count(*) AS n_links FROM ex WHERE category IS NOT NULL GROUP BY category")
def domain_topics(spark, d):
    x = links(spark, d).withColumn("domain", L.domain(F.col("url"))).where("domain IS NOT NULL AND category IS NOT NULL")
    return x.groupBy("category").agg(F.countDistinct("domain").alias("n_domains"), F.countDistinct("article").alias("n_articles"), F.count(F.lit(1)).alias("n_links"))


@query(f"WITH {WEB}, r AS (SELECT domain, n_citations, row_number() OVER (ORDER BY n_citations DESC, domain)::INT AS rank FROM dm) SELECT * FROM r WHERE rank <= greatest(1, (SELECT count(*) FROM dm) // 5)")
def leading_domains(spark, d):
    return L.leading_domains(L.domains(links(spark, d)).select("domain", "n_citations"))


@query(f"WITH {WEB}, o AS (SELECT article, count(*) AS n_out, count(DISTINCT domain) AS n_domains FROM ex WHERE article IS NOT NULL GROUP BY article) SELECT * FROM o")
def external_link_counts(spark, d):
    x = links(spark, d).withColumn("domain", L.domain(F.col("url"))).where("domain IS NOT NULL AND article IS NOT NULL")
    return x.groupBy("article").agg(F.count(F.lit(1)).alias("n_out"), F.countDistinct("domain").alias("n_domains"))


@query(f"""WITH {WEB}, u AS (SELECT url, any_value(domain) AS domain, count(*) AS n FROM ex GROUP BY url ORDER BY n DESC, url LIMIT 50), k AS (SELECT url, n, authority FROM u JOIN au USING (domain) WHERE regexp_matches(domain, '\\.(edu|org|gov)$') OR n >= 2 AND authority >= 60) SELECT url, n, round(authority, 6) AS authority FROM k ORDER BY n DESC, url LIMIT 20""")
def archive_candidates(spark, d):
    """Of the fifty most cited addresses those worth keeping, twenty at most (a report)."""
    x = links(spark, d).withColumn("domain", L.domain(F.col("url"))).where("domain IS NOT NULL")
    top = x.groupBy("url", "domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "url").limit(50)
    k = top.join(L.domains(links(spark, d)).select("domain", "authority"), "domain").where(F.col("domain").rlike(r"\.(edu|org|gov)$") | ((F.col("n") >= 2) & (F.col("authority") >= 60)))
    return k.orderBy(F.desc("n"), "url").limit(20).select("url", "n", F.round("authority", 6).alias("authority"))


@query(f"""WITH {WEB}, c AS (SELECT url, CASE report_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 204 ELSE NULL END AS status, report_id % 3 AS redirects, (report_id % 90) - 20 AS days, (report_id % 50) * 100 AS ms FROM lk WHERE url IS NOT NULL), b AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 100 WHEN status BETWEEN 300 AND 399 THEN 80 WHEN status IN (401, 403, 429) THEN 50 ELSE 0 END AS base FROM c),
s AS (SELECT url, CASE WHEN base = 0 THEN 0 ELSE greatest(0, base - redirects * 10 - CASE WHEN days < 0 THEN 20 WHEN days < 30 THEN 10 ELSE 0 END - CASE WHEN ms > 3000 THEN 5 ELSE 0 END) END AS score FROM b) SELECT score::INT AS score, count(*) AS n_checks, count(DISTINCT url) AS n_urls FROM s GROUP BY 1""")
def link_health_scores(spark, d):
    """Checks by health score; the answers of the network are derived from the report's id here."""
    r = F.col("report_id")
    status = F.when(r % 6 == 0, 200).when(r % 6 == 1, 301).when(r % 6 == 2, 403).when(r % 6 == 3, 404).when(r % 6 == 4, 204)
    s = links(spark, d).where("url IS NOT NULL").select("url", L.health(status, r % 3, (r % 90) - 20, (r % 50) * 100).cast("int").alias("score"))
    return s.groupBy("score").agg(F.count(F.lit(1)).alias("n_checks"), F.countDistinct("url").alias("n_urls"))


@query(f"WITH {WEB}, l AS (SELECT url, max(at_time) AS last FROM lk WHERE url IS NOT NULL GROUP BY url), h AS (SELECT (epoch_us((SELECT max(last) FROM l)) - epoch_us(last)) / 3600000000.0::DOUBLE AS hours FROM l) SELECT CASE WHEN hours IS NULL THEN 'unknown' WHEN hours < 24 THEN 'fresh' WHEN hours < 168 THEN 'stale' ELSE 'old' END AS freshness, count(*) AS n FROM h GROUP BY 1")
def link_freshness(spark, d):
    """How long ago each address was last checked, against the newest check."""
    l = links(spark, d).where("url IS NOT NULL").groupBy("url").agg(F.max("at").alias("last"))
    newest = l.agg(F.max("last").alias("now"))
    hours = (F.unix_micros("now") - F.unix_micros("last")) / 3600000000.0
    return l.join(F.broadcast(newest)).groupBy(L.freshness(hours).alias("freshness")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE h AS (SELECT DISTINCT p_partkey AS url, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part) END AS dst FROM part), w AS (SELECT url, coalesce(dst, url) AS final, (dst IS NOT NULL)::INT AS n, coalesce(dst = url, false) AS looped, 1 AS round FROM h
UNION ALL SELECT w.url, CASE WHEN h.dst IS NOT NULL AND NOT looped THEN h.dst ELSE final END, n + (h.dst IS NOT NULL AND NOT looped)::INT, looped OR coalesce(h.dst = w.url, false), round + 1 FROM w LEFT JOIN h ON h.url = w.final WHERE round < 5) SELECT url, final, n AS n_redirects, looped FROM w WHERE round = 5""")
def redirect_chains(spark, d):
    """Hops between addresses followed five steps; part keys stand for addresses."""
    p = table(spark, d, "part").select("p_partkey").distinct()
    size = p.agg((F.max("p_partkey") + 1).alias("m"))
    h = p.join(F.broadcast(size)).select(F.col("p_partkey").alias("url"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") * 7 + 3) % F.col("m")).alias("to"))
    return L.redirect_chains(h)


ASKED = f"WITH {ART}, ask AS (SELECT lower(trim(q, ' ')) AS query FROM (SELECT unnest(existing_tags) AS q FROM tagging_suggestions) WHERE q IS NOT NULL), n AS (SELECT query, count(*) AS n_asked FROM ask GROUP BY query), r AS (SELECT tag AS query, count(*) AS n_results FROM (SELECT unnest(tags) AS tag FROM art) GROUP BY 1), lg AS (SELECT query, n_asked, coalesce(n_results, 0) AS n_results FROM n LEFT JOIN r USING (query))"


def _log(spark, d):
    asked = table(spark, d, "tagging_suggestions").select(F.explode("existing_tags").alias("q")).where("q IS NOT NULL").select(F.lower(F.trim("q")).alias("query"))
    found = article_tags(arts(spark, d)).groupBy(F.col("tag").alias("query")).agg(F.count(F.lit(1)).alias("n_results"))
    return L.search_log(asked, found)


@query(f"{ASKED} SELECT query, n_asked, n_results FROM lg ORDER BY n_asked DESC, query LIMIT 20")
def popular_searches(spark, d):
    return _log(spark, d).orderBy(F.desc("n_asked"), "query").limit(20)


@query(f"{ASKED} SELECT query, n_asked FROM lg WHERE n_results = 0")
def searches_without_result(spark, d):
    return _log(spark, d).where("n_results = 0").select("query", "n_asked")


@query(f"{ASKED} SELECT count(*) AS n_queries, sum(n_asked)::BIGINT AS n_searches, sum((n_results = 0)::INT)::BIGINT AS n_without_result, round(sum(n_results * n_asked) / sum(n_asked), 6) AS mean_results FROM lg")
def search_analytics(spark, d):
    return _log(spark, d).agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("n_asked").alias("n_searches"), F.count_if(F.col("n_results") == 0).alias("n_without_result"),
        F.round(F.sum(F.col("n_results") * F.col("n_asked")) / F.sum("n_asked"), 6).alias("mean_results"),
    )


@query(f"""WITH {ART}, t AS (SELECT *, list_filter(string_split_regex(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS tw FROM art), s AS (SELECT id, 3.0 * len(list_filter(tw, lambda x: x IN ('шлюз', 'фильтр', 'омлет'))) + 2.0 * len(list_filter(tags, lambda x: x IN ('шлюз', 'фильтр', 'омлет'))) + 1.5 * len(list_filter([category, subcategory], lambda x: x IN ('шлюз', 'фильтр', 'омлет'))) AS score FROM t)
SELECT id, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def field_boosted_search(spark, d):
    """Best articles for three words, those in titles counting three times, in tags twice."""
    a = arts(spark, d)
    fields = {"title": (T.words(F.col("title")), 3.0), "tags": (F.col("tags"), 2.0), "place": (F.array("category", "subcategory"), 1.5)}
    s = a.select("id", L.boosted(fields, ["шлюз", "фильтр", "омлет"]).alias("score")).where("score > 0")
    return s.orderBy(F.desc("score"), "id").limit(20)


@query("""WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY exported_at DESC) AS rn FROM thesaurus) WHERE rn = 1), q AS (SELECT DISTINCT lower(term) AS query FROM cur WHERE term_id % 100 = 0 AND term IS NOT NULL), w AS (SELECT lower(term) AS query, unnest(synonyms) AS word, 'synonyms' AS origin FROM cur UNION ALL SELECT lower(term), unnest(related), 'related' FROM cur)
SELECT query, query AS word, 'query' AS origin FROM q UNION SELECT query, lower(word), origin FROM q JOIN w USING (query) WHERE word IS NOT NULL AND trim(word) <> ''""")
def expanded_queries(spark, d):
    """Terms whose id is divisible by 100 with their synonyms and related terms."""
    t = latest(table(spark, d, "thesaurus"), "term_id", "exported_at", F.col("term"), F.col("synonyms"), F.col("related"))
    return L.expand(t.where("term_id % 100 = 0").select(F.col("term").alias("query")), t)
