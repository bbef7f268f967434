"""External links: domains, health of checked addresses, and what searches were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.skew import lookup


def domain(url: Column) -> Column:
    """Host of a web address in lower case without www; null for anything else."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:www\.)?([^/:?#\s]+)", 1)
    return F.when(host != "", host)


def authority(articles: Column, citations: Column, categories: Column) -> Column:
    """0 to 100 from the numbers of articles, citations and categories that use a domain."""
    hundred = F.lit(100.0)
    return F.least(hundred, articles * 10) * 0.4 + F.least(hundred, citations * 5) * 0.4 + F.least(F.lit(100.0), categories * 20) * 0.2


def trust(score: Column, articles: Column, categories: Column) -> Column:
    """Authority less 20 for a single article and 10 without category, 10 more from three categories on; 0 to 100."""
    v = score - F.when(articles == 1, 20).otherwise(0) - F.when(categories == 0, 10).otherwise(0) + F.when(categories >= 3, 10).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))


def domains(links: DataFrame) -> DataFrame:
    """Per domain its use. links: article, category, url, at. Rows whose url is no web address are left out."""
    l = links.withColumn("domain", domain(F.col("url"))).where("domain IS NOT NULL")
    g = l.groupBy("domain").agg(
        F.countDistinct("article").alias("n_articles"), F.count(F.lit(1)).alias("n_citations"), F.countDistinct("category").alias("n_categories"),
        F.countDistinct("url").alias("n_urls"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    )
    g = g.withColumn("authority", authority(F.col("n_articles"), F.col("n_citations"), F.col("n_categories")))
    return g.withColumn("trust", trust(F.col("authority"), F.col("n_articles"), F.col("n_categories")))


def leading_domains(d: DataFrame) -> DataFrame:
    """The fifth of the domains (one at least) with most citations, with their rank; ties by name. One row per domain is ranked."""
    w = W.orderBy(F.desc("n_citations"), "domain")
    total = d.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 5)).alias("_most"))
    return d.withColumn("rank", F.row_number().over(w)).join(F.broadcast(total), F.col("rank") <= F.col("_most")).drop("_most")


def health(status: Column, redirects: Column, certificate_days: Column, millis: Column) -> Column:
    """Score of a checked address: 100, 0 for errors and null status; less for redirects, certificates that end and slow answers."""
    base = F.when(status.between(200, 299), 100).when(status.between(300, 399), 80).when(status.isin(401, 403, 429), 50).otherwise(0)
    off = F.coalesce(redirects, F.lit(0)) * 10 + F.when(certificate_days < 0, 20).when(certificate_days < 30, 10).otherwise(0) + F.when(millis > 3000, 5).otherwise(0)
    return F.when(base == 0, 0).otherwise(F.greatest(F.lit(0), base - off))


def freshness(hours: Column) -> Column:
    """fresh within a day, stale within a week, else old; unknown for null."""
    return F.when(hours.isNull(), "unknown").when(hours < 24, "fresh").when(hours < 168, "stale").otherwise("old")


def redirect_chains(hops: DataFrame, most: int = 5) -> DataFrame:
    """(url, final, n_redirects, looped): where addresses lead, at most ``most`` hops. hops: url, to (null where it ends)."""
    t = hops.where("url IS NOT NULL").groupBy("url").agg(F.min("to").alias("to"))
    out = t.select("url", F.coalesce("to", "url").alias("final"), F.col("to").isNotNull().cast("int").alias("n_redirects"), (F.col("to") == F.col("url")).alias("looped"))
    out = out.withColumn("looped", F.coalesce("looped", F.lit(False)))
    for _ in range(most - 1):
        step = t.select(F.col("url").alias("final"), F.col("to").alias("_next"))
        j = lookup(out, step, "final", "left")
        go = F.col("_next").isNotNull() & ~F.col("looped")
        out = j.select(
            "url", F.when(go, F.col("_next")).otherwise(F.col("final")).alias("final"), (F.col("n_redirects") + go.cast("int")).alias("n_redirects"),
            (F.col("looped") | F.coalesce(go & (F.col("_next") == F.col("url")), F.lit(False))).alias("looped"),
        )
    return out


def search_log(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Per query the times it was asked and what it found. asked: query; found: query, n_results (missing: none)."""
    n = asked.where("query IS NOT NULL").groupBy("query").agg(F.count(F.lit(1)).alias("n_asked"))
    return n.join(found, "query", "left").select("query", "n_asked", F.coalesce("n_results", F.lit(0)).alias("n_results"))


def boosted(fields: dict[str, tuple[Column, float]], words: list[str]) -> Column:
    """Sum over fields of boost x number of occurrences of the words (lower case) in a token array."""
    score = F.lit(0.0)
    for tokens, boost in fields.values():
        score = score + F.size(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isin(words))) * boost
    return score


def expand(terms: DataFrame, thesaurus: DataFrame, kinds: tuple[str, ...] = ("synonyms", "related")) -> DataFrame:
    """(query, word, origin) of each query and what the thesaurus names beside it. terms: query; thesaurus: term and the kinds."""
    t = thesaurus.select(F.lower("term").alias("query"), *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in kinds])
    q = terms.select(F.lower("query").alias("query")).where("query IS NOT NULL").distinct()
    named = F.flatten(F.array(*[F.transform(k, _tagged(k)) for k in kinds]))
    more = q.join(t, "query").select("query", F.explode(named).alias("w")).select("query", F.lower("w.word").alias("word"), "w.origin").where("word IS NOT NULL AND trim(word) <> ''")
    return q.select("query", F.col("query").alias("word"), F.lit("query").alias("origin")).unionByName(more).distinct()


def _tagged(kind: str):
    return lambda x: F.struct(x.alias("word"), F.lit(kind).alias("origin"))
