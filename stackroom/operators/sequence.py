"""Sequences and activity: sessions, streaks, deltas, spikes, bus factor, velocity, commit scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, n): a session ends where the next event is more than the gap away.

    Built on ``session_window``, which merges sessions in a map-side combined aggregation; the
    window's gap is exclusive, so that an event exactly at the gap still belongs to it.
    """
    w = F.session_window(F.col(at), f"{gap_seconds} seconds 1 microsecond")
    s = events.where(F.col(at).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("start"), F.max(at).alias("end"))
    return s.select("key", F.row_number().over(W.partitionBy("key").orderBy("start")).alias("session"), "start", "end", "n")


def gap_clusters(df: DataFrame, at: str, days: int, *by: str) -> DataFrame:
    """Distinct days in clusters: a gap of more than ``days`` days begins a new one."""
    d = df.where(F.col(at).isNotNull()).select(*by, F.to_date(at).alias("day")).groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by).orderBy("day")
    new = F.coalesce((F.datediff("day", F.lag("day").over(w)) > days).cast("int"), F.lit(1))
    c = d.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(w))
    return c.groupBy(*by, "cluster").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n"))


def streaks(df: DataFrame, key: str, at: str) -> DataFrame:
    """(key, start_day, days) of runs of consecutive days."""
    d = df.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.to_date(at).alias("day")).distinct()
    anchor = F.date_sub("day", F.row_number().over(W.partitionBy("key").orderBy("day")))
    return d.withColumn("a", anchor).groupBy("key", "a").agg(F.min("day").alias("start_day"), F.count(F.lit(1)).alias("days")).drop("a")


def monthly(df: DataFrame, at: str, *by: str) -> DataFrame:
    return df.where(F.col(at).isNotNull()).groupBy(*by, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def spikes(m: DataFrame, *by: str, factor: float = 2.0, least: int = 3) -> DataFrame:
    """Months with at least ``factor`` times the mean of their group, where it has ``least`` months."""
    w = W.partitionBy(*by)
    return m.withColumn("mean", F.avg("n").over(w)).withColumn("k", F.count(F.lit(1)).over(w)).where((F.col("k") >= least) & (F.col("n") >= F.col("mean") * factor)).drop("k")


def bus_factor(commits: DataFrame, author: str) -> DataFrame:
    """One row: fewest authors with half of the commits, and the risk."""
    a = commits.groupBy(author).agg(F.count(F.lit(1)).alias("c"))
    w = W.orderBy(F.desc("c"), author)  # one row an author
    x = a.select(F.row_number().over(w).alias("k"), F.sum("c").over(w).alias("upto"), F.sum("c").over(W.partitionBy()).alias("all"))
    f = x.where(F.col("upto") * 2 >= F.col("all")).agg(F.min("k").alias("bus_factor"))
    return f.withColumn("risk", F.when(F.col("bus_factor") < 3, "critical").when(F.col("bus_factor") < 5, "medium").otherwise("low"))


def velocity(df: DataFrame, at: str) -> DataFrame:
    """One row: mean per active day in the earlier and the later half, and the trend beyond 20 percent."""
    d = df.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    x = d.withColumn("k", F.row_number().over(W.orderBy("day"))).withColumn("all", F.count(F.lit(1)).over(W.partitionBy()))
    late = F.col("k") > F.floor(F.col("all") / 2)
    g = x.agg(F.avg(F.when(~late, F.col("n"))).alias("earlier"), F.avg(F.when(late, F.col("n"))).alias("later"))
    return g.withColumn("trend", F.when(F.col("later") > F.col("earlier") * 1.2, "accelerating").when(F.col("later") < F.col("earlier") * 0.8, "slowing").otherwise("stable"))


# The words of a commit message by which its kind is told, first match counts.
COMMIT_KINDS = (("fix", "fix|typo|правк|исправ"), ("feature", "добав|add|feat"), ("merge", "merge|слия"), ("update", "обнов|update"), ("export", "выгруз|export"))


def commit_kind(message: Column) -> Column:
    low = F.lower(message)
    out = F.when(low.rlike(COMMIT_KINDS[0][1]), COMMIT_KINDS[0][0])
    for name, p in COMMIT_KINDS[1:]:
        out = out.when(low.rlike(p), name)
    return out.otherwise("other")


def size_class(changed: Column) -> Column:
    return F.when(changed < 10, "tiny").when(changed < 50, "small").when(changed < 200, "medium").when(changed < 500, "large").otherwise("huge")


def risk(changed: Column, files: Column, deletions: Column, insertions: Column) -> Column:
    """Points for size, number of files and deleting more than adding."""
    a = F.when(changed > 500, 40).when(changed > 200, 25).when(changed > 50, 10).otherwise(0)
    b = F.when(files > 10, 30).when(files > 5, 15).otherwise(0)
    return a + b + F.when(deletions > insertions, 25).otherwise(0)


def risk_level(points: Column) -> Column:
    return F.when(points >= 80, "critical").when(points >= 50, "high").when(points >= 25, "medium").otherwise("low")


def message_score(message: Column) -> Column:
    """Points for length, more than one word, an initial capital and no closing full stop."""
    return (
        F.when(F.length(message).between(10, 72), 40).otherwise(10) + F.when(F.size(F.split(F.trim(message), " ")) >= 2, 20).otherwise(0)
        + F.when(message.rlike("^[А-ЯЁA-Z]"), 20).otherwise(0) + F.when(message.endswith("."), 0).otherwise(20)
    )


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(path.isNull(), "unknown").when(low.contains("/index/"), "index").when(low.rlike(r"\.(md|markdown)$"), "article").when(low.rlike(r"\.(json|ya?ml|toml|cfg|ini)$"), "config").otherwise("other")
