"""Article catalog: cleaned articles, facets, tags, taxonomy, quality, growth and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.skew import ranked

from stackroom.tables import current_articles


def articles(raw: DataFrame) -> DataFrame:
    """Current articles with defaults filled in and tags as a sorted set."""
    fm = lambda f: F.col(f"metadata.frontmatter.{f}")
    cur = current_articles(
        raw, F.col("path"), fm("title").alias("title"), fm("category").alias("category"), fm("subcategory").alias("subcategory"), fm("status").alias("status"), fm("source").alias("author"),
        fm("difficulty").alias("difficulty"), fm("tags").alias("tags"), fm("related").alias("related"), fm("word_count").alias("words"), fm("quality_score").alias("quality"), fm("pagerank").alias("pagerank"),
        fm("pagerank_inlinks").alias("inlinks"), fm("pagerank_outlinks").alias("outlinks"), fm("difficulty_score").alias("difficulty_score"), fm("quality_metrics").alias("qm"),
        F.col("metadata.content_length").alias("chars"), F.col("metadata.modified_date").alias("modified"), F.col("metadata.age_days").alias("age"), F.col("loaded_at"),
        F.col("classification.type").alias("orphan_type"), F.col("classification.severity").alias("severity"),
    )
    clean = lambda c, default: F.coalesce(F.nullif(F.trim(F.lower(F.col(c))), F.lit("")), F.lit(default))
    tags = F.filter(F.transform("tags", lambda t: F.trim(F.lower(t))), lambda t: t.isNotNull() & (t != ""))
    return cur.select(
        F.col("record_id").alias("id"), "path", "title", clean("category", "misc").alias("category"), F.coalesce("subcategory", F.lit("-")).alias("subcategory"), clean("status", "draft").alias("status"),
        F.coalesce("author", F.lit("unknown")).alias("author"), clean("difficulty", "unknown").alias("difficulty"), F.coalesce(F.sort_array(F.array_distinct(tags)), F.array().cast("array<string>")).alias("tags"),
        "related", F.coalesce(F.size("related"), F.lit(0)).alias("n_related"), "words", "quality", "pagerank", "inlinks", "outlinks", "difficulty_score", "qm", "chars", "modified", "age", "loaded_at", "orphan_type", "severity",
    )


def article_tags(a: DataFrame) -> DataFrame:
    return a.select("id", "category", "words", "age", "quality", F.explode("tags").alias("tag"))


def facet_counts(a: DataFrame) -> DataFrame:
    """(facet, value, n) of seven facets in one pass: values are exploded side by side, then counted."""
    one = lambda name, c: F.array(F.struct(F.lit(name).alias("facet"), c.alias("value")))
    plain = F.concat(*[one(f, F.col(f)) for f in ("category", "status", "author", "difficulty")], one("year", F.date_format("modified", "yyyy")), one("month", F.date_format("modified", "yyyy-MM")))
    pairs = F.concat(plain, F.transform("tags", lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))
    return a.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def filter_articles(a: DataFrame, equal: dict | None = None, any_tags: list | None = None, all_tags: list | None = None, title: str | None = None) -> DataFrame:
    """Conjunction of equalities, tag overlap, tag containment and a title substring without case."""
    for k, v in (equal or {}).items():
        a = a.where(F.col(k) == v)
    if any_tags:
        a = a.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_tags))))
    if all_tags:
        a = a.where(F.size(F.array_except(F.array(*map(F.lit, all_tags)), "tags")) == 0)
    return a.where(F.lower("title").contains(title.lower())) if title else a


def search(a: DataFrame, text: str) -> DataFrame:
    """Substring in title, category or any tag."""
    t = text.lower()
    return a.where(F.lower(F.coalesce("title", F.lit(""))).contains(t) | F.col("category").contains(t) | F.exists("tags", lambda x: x.contains(t)))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A+").when(score >= 80, "A").when(score >= 70, "B").when(score >= 60, "C").when(score >= 50, "D").otherwise("F")


def overall_quality(qm: Column) -> Column:
    """Weighted mean of the six sub-scores."""
    weights = {"completeness": 0.20, "structure": 0.20, "links": 0.15, "examples": 0.15, "readability": 0.20, "freshness": 0.10}
    return sum((qm[k] * w for k, w in weights.items()), F.lit(0.0))


def freshness(age: Column) -> Column:
    out = F.when(age < 30, 100)
    for at, v in ((90, 90), (180, 75), (365, 60), (730, 40)):
        out = out.when(age < at, v)
    return out.otherwise(20)


def change_frequency(age: Column) -> Column:
    out = F.when(age < 1, "always")
    for at, v in ((7, "daily"), (30, "weekly"), (90, "monthly"), (365, "yearly")):
        out = out.when(age < at, v)
    return out.otherwise("never")


def diversity(a: DataFrame, by: str) -> DataFrame:
    """Entropies of a column's distribution and the named square-root variant."""
    p = a.groupBy(by).agg(F.count(F.lit(1)).alias("c"))
    t = p.agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("k"))
    x = F.col("c") / F.col("s")
    return p.join(F.broadcast(t), F.lit(True)).agg(
        F.round(-F.sum(x * F.log(x)), 6).alias("entropy_ln"), F.round(-F.sum(x * F.log2(x)), 6).alias("entropy_log2"),
        F.round(F.sum(x * F.sqrt(x)) * -100, 6).alias("diversity_sqrt"), F.round(-F.sum(x * F.log(x)) / F.log(F.max("k")), 6).alias("evenness"),
    )


def growth(a: DataFrame) -> DataFrame:
    """Articles per month with the change and the running total; windows see one row a month."""
    m = a.where("modified IS NOT NULL").groupBy(F.date_format("modified", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("n_categories"), F.countDistinct("author").alias("n_authors")
    )
    w = W.orderBy("month")
    return m.select("month", "n", "n_categories", "n_authors", F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)).alias("delta"), F.sum("n").over(w).alias("total"))


def forecast(a: DataFrame, months: int) -> DataFrame:
    """Linear forecast from the mean of the last six months."""
    m = a.where("modified IS NOT NULL").groupBy(F.date_format("modified", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    rate = m.orderBy(F.desc("month")).limit(6).agg(F.avg("n").alias("rate"))
    total = a.agg(F.count(F.lit(1)).alias("total"))
    i = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("months_ahead")
    return rate.join(F.broadcast(total), F.lit(True)).select(i, "rate", "total").select("months_ahead", F.floor(F.col("total") + F.col("rate") * F.col("months_ahead")).alias("forecast"))


def size_classes(tags: DataFrame) -> DataFrame:
    """Log-normalised weight and five size classes per tag; all equal counts give 1."""
    c = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    m = c.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    w = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.log("n") - F.log("lo")) / (F.log("hi") - F.log("lo")))
    x = c.join(F.broadcast(m), F.lit(True)).select("tag", "n", w.alias("w"))
    size = F.when(F.col("w") >= 0.8, "xl").when(F.col("w") >= 0.6, "l").when(F.col("w") >= 0.4, "m").when(F.col("w") >= 0.2, "s").otherwise("xs")
    return x.select("tag", "n", F.round("w", 6).alias("weight"), size.alias("size_class"))


def tag_weights(tags: DataFrame, total: DataFrame) -> DataFrame:
    """Frequency, recency, importance and specificity of tags, combined, and the stage of life. Unknown ages and lengths count as 0 points."""
    g = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("c"), F.avg("age").alias("a"), F.avg("words").alias("w")).join(F.broadcast(total), F.lit(True))
    x = g.select(
        "tag", "c", F.least(F.lit(100.0), F.col("c") * 10.0).alias("frequency"), F.coalesce(F.greatest(F.lit(0.0), 100 - F.col("a") / 3), F.lit(0.0)).alias("recency"),
        F.coalesce(F.least(F.lit(100.0), F.col("w") / 50), F.lit(0.0)).alias("importance"), F.least(F.lit(100.0), F.log(F.col("total") / F.col("c")) * 30).alias("specificity"),
    )
    stage = F.when((F.col("c") <= 2) & (F.col("recency") > 70), "emerging").when((F.col("c") >= 5) & (F.col("recency") > 50), "mature").when(F.col("recency") < 30, "declining").otherwise("growing")
    return x.withColumn("weight", 0.4 * F.col("frequency") + 0.2 * F.col("recency") + 0.2 * F.col("importance") + 0.2 * F.col("specificity")).withColumn("stage", stage)


def tag_entropy(tags: DataFrame) -> DataFrame:
    """Entropy of a tag's categories as a share of the greatest possible, in percent."""
    k = tags.groupBy("tag", "category").agg(F.count(F.lit(1)).alias("c"))
    # sums of c log c give the entropy without a second look at the groups
    g = k.groupBy("tag").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.log2("c")).alias("q"), F.count(F.lit(1)).alias("kinds"))
    h = F.log2("s") - F.col("q") / F.col("s")
    return g.select("tag", F.round(F.when(F.col("kinds") > 1, h / F.log2("kinds") * 100).otherwise(0.0), 6).alias("entropy"))


def tag_pairs(tags: DataFrame, least: int) -> DataFrame:
    """(tag_a < tag_b, n) from each article's own sorted tags: no join of the table with itself."""
    per = tags.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("t"))
    pair = F.flatten(F.transform("t", lambda x, i: F.transform(F.filter("t", lambda y: y > x), lambda y: F.struct(x.alias("tag_a"), y.alias("tag_b")))))
    return per.select(F.explode(pair).alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def normal_tag(t: Column) -> Column:
    """Plural s off (not ss, is, us; more than three letters), hyphens to underscores."""
    plural = (F.length(t) > 3) & t.endswith("s") & ~t.rlike("(ss|is|us)$")
    return F.replace(F.when(plural, F.expr(f"left({_name(t)}, length({_name(t)}) - 1)")).otherwise(t), F.lit("-"), F.lit("_"))


def _name(c: Column) -> str:
    return c._jc.toString()


def taxonomy(a: DataFrame) -> DataFrame:
    """Category / subcategory / first tag with subtree counts; '*' stands for all of a level."""
    x = a.select(F.col("category").alias("c"), F.col("subcategory").alias("s"), F.when(F.size("tags") > 0, F.col("tags")[0]).otherwise("-").alias("t"))
    g = x.rollup("c", "s", "t").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    return g.select(star("c").alias("category"), star("s").alias("subcategory"), star("t").alias("tag"), "n", "level")


def breadcrumbs(a: DataFrame) -> DataFrame:
    """One row per step of each article's path."""
    s = a.select("id", F.split("path", "/").alias("s")).select("id", "s", F.posexplode("s").alias("i", "crumb"))
    return s.select("id", (F.col("i") + 1).alias("level"), "crumb", F.array_join(F.slice("s", F.lit(1), F.col("i") + 1), "/").alias("trail"))


def sitemap(a: DataFrame, per_file: int) -> DataFrame:
    """Paths by priority with the number of their sitemap file. Unknown numbers count as 0; articles without path are left out."""
    yes = lambda c: c.cast("int") * 0.1
    known = a.where("path IS NOT NULL").na.fill(0, ["words", "inlinks", "outlinks"])
    p = known.select("path", F.round(F.least(F.lit(1.0), 0.5 + yes(F.size(F.split("path", "/")) <= 4) + yes(F.col("words") > 300) + yes(F.col("inlinks") > 2) + yes(F.col("outlinks") > 2)), 2).alias("priority"))
    r = ranked(p, F.desc("priority"), F.col("path"))
    return r.select("path", "priority", F.floor(F.col("_rank") / per_file).cast("int").alias("sitemap"))


def bibtex(a: DataFrame) -> DataFrame:
    first = F.coalesce(F.lower(F.regexp_extract("title", r"^([^\s:.,]+)", 1)), F.lit(""))
    key = F.concat(F.lit("kb"), F.col("id").cast("string"), first)
    entry = F.concat(F.lit("@article{"), key, F.lit(", title = {"), F.coalesce("title", F.lit("")), F.lit("}, author = {"), F.col("author"), F.lit("}}"))
    return a.select("id", key.alias("cite_key"), entry.alias("entry"))


def learning_path(a: DataFrame) -> DataFrame:
    """Articles of each category from easy to hard, with their neighbours (-1: none)."""
    r = ranked(a.where("difficulty_score IS NOT NULL").select("category", "id", "difficulty_score"), F.col("category"), F.col("difficulty_score"), F.col("id"))
    first = r.groupBy("category").agg(F.min("_rank").alias("_first"))
    beside = lambda k, name: r.select("category", (F.col("_rank") + k).alias("_rank"), F.col("id").alias(name))
    x = r.join(F.broadcast(first), "category").join(beside(1, "p"), ["category", "_rank"], "left").join(beside(-1, "n"), ["category", "_rank"], "left")
    return x.select(
        "category", "id", (F.col("_rank") - F.col("_first") + 1).cast("int").alias("position"), F.col("difficulty_score").alias("score"),
        F.coalesce("p", F.lit(-1).cast("long")).alias("previous_id"), F.coalesce("n", F.lit(-1).cast("long")).alias("next_id"),
    )


def value_at(a: DataFrame, col: str, shares: list[tuple[int, int]]) -> list:
    """Values at positions n * p // q of the sorted column, from its value counts."""
    counts = a.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    x = counts.withColumn("upto", F.sum("c").over(W.orderBy("v"))).join(F.broadcast(total), F.lit(True))
    pick = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / q), F.col("v"))).alias(f"q{i}") for i, (p, q) in enumerate(shares)]
    return x.agg(*pick)


def iqr_outliers(a: DataFrame, col: str) -> DataFrame:
    """Rows beyond one and a half interquartile ranges, quartiles by position."""
    q = value_at(a, col, [(1, 4), (3, 4)])
    r = 1.5 * (F.col("q1") - F.col("q0"))
    return a.join(F.broadcast(q), F.lit(True)).where((F.col(col) < F.col("q0") - r) | (F.col(col) > F.col("q1") + r))
