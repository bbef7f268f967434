"""Reading progress, goals and achievements; series of articles (chains), their order, gaps and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: (name, kind, threshold) of achievements.
ACHIEVEMENTS = (
    ("first", "reads", 1), ("ten", "reads", 10), ("fifty", "reads", 50), ("hundred", "reads", 100), ("streak_3", "streak", 3), ("streak_7", "streak", 7), ("streak_30", "streak", 30), ("expert", "category", 10),
)


def goal_counts(reads: DataFrame, now: Column) -> DataFrame:
    """Per reader the reads of today, this week (from Monday) and this month. reads: reader, at. Null times do not count."""
    since = lambda unit: F.count_if((F.col("at") >= F.date_trunc(unit, now)) & (F.col("at") <= now))
    return reads.groupBy("reader").agg(since("day").alias("today"), since("week").alias("week"), since("month").alias("month"))


def achievements(stats: DataFrame) -> DataFrame:
    """(reader, achievement, value, threshold, unlocked). stats: reader, reads, streak, category (best category's reads)."""
    each = F.array(*[F.struct(F.lit(a).alias("achievement"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("value"), F.lit(t).alias("threshold")) for a, k, t in ACHIEVEMENTS])
    return stats.select("reader", F.explode(each).alias("a")).select("reader", "a.*").withColumn("unlocked", F.col("value") >= F.col("threshold"))


def next_achievements(all_: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` locked achievements nearest to their threshold, per reader."""
    locked = all_.where("NOT unlocked").withColumn("progress", F.col("value") / F.col("threshold"))
    w = W.partitionBy("reader").orderBy(F.desc("progress"), "achievement")  # as many rows as achievements
    return locked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)


def longest_streak(days: DataFrame) -> DataFrame:
    """(reader, streak): most consecutive days. days: reader, day."""
    w = W.partitionBy("reader").orderBy("day")  # a row per reader and day
    runs = days.where("day IS NOT NULL").distinct().withColumn("run", F.date_sub("day", F.row_number().over(w)))
    return runs.groupBy("reader", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("reader").agg(F.max("n").alias("streak"))


def chains(parts: DataFrame) -> DataFrame:
    """Per series its parts in order. parts: series, part, article, difficulty; null series or parts are left out.

    Of several articles of one part the one with the smallest id counts, the others are listed in ``n_repeated``.
    """
    p = parts.where("series IS NOT NULL AND part IS NOT NULL").groupBy("series", "part").agg(F.min_by(F.struct("article", "difficulty"), "article").alias("a"), (F.count(F.lit(1)) - 1).alias("again"))
    return p.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("part", "a.article", "a.difficulty"))).alias("parts"), F.sum("again").alias("n_repeated"))


def chain_report(c: DataFrame) -> DataFrame:
    """Difficulty (mean, least, greatest, whether it never falls), missing parts and a score per series."""
    diff = F.filter(F.transform("parts", lambda p: p["difficulty"]), lambda x: x.isNotNull())
    pairs = F.arrays_zip(F.slice(diff, F.lit(1), F.greatest(F.size(diff) - 1, F.lit(0))).alias("x"), F.slice(diff, F.lit(2), F.greatest(F.size(diff) - 1, F.lit(0))).alias("y"))
    most = F.array_max(F.transform("parts", lambda p: p["part"]))
    missing = F.array_except(F.sequence(F.lit(1).cast("bigint"), most), F.transform("parts", lambda p: p["part"]))
    out = c.select(
        "series", F.size("parts").alias("n_parts"), "n_repeated", F.when(F.size(diff) > 0, F.aggregate(diff, F.lit(0.0), lambda a, x: a + x) / F.size(diff)).alias("mean_difficulty"),
        F.array_min(diff).alias("least"), F.array_max(diff).alias("greatest"), F.forall(pairs, lambda z: z["x"] <= z["y"]).alias("progressive"), F.array_join(F.transform(missing, lambda x: x.cast("string")), ",").alias("missing"), F.size(missing).alias("n_missing"),
    )
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 10 * F.col("n_missing") - 5 * F.col("n_repeated")))


def chain_navigation(c: DataFrame) -> DataFrame:
    """(series, article, place, previous, next): neighbours of each article in its series, null at the ends."""
    p = c.select("series", "parts", F.posexplode("parts").alias("i", "p"))
    at = lambda k: F.get("parts", F.col("i") + k)["article"]
    return p.select("series", F.col("p.article").alias("article"), (F.col("i") + 1).alias("place"), F.when(F.col("i") > 0, at(-1)).alias("previous"), at(1).alias("next"))


def edited_chain(members: Column, add: Column, place: Column, remove: Column) -> Column:
    """A chain with one article put in at a place (from 1; null: at the end) and one removed; nulls change nothing."""
    without = F.when(remove.isNull(), members).otherwise(F.array_remove(members, F.coalesce(remove, F.lit(""))))
    spot = F.least(F.coalesce(place, F.size(without) + 1), F.size(without) + 1)
    return F.when(add.isNull(), without).otherwise(F.concat(F.slice(without, F.lit(1), spot - 1), F.array(add), F.slice(without, spot, F.size(without) + 1)))


def suggested(candidates: DataFrame, own: DataFrame, top: int = 5, per_tag: int = 10, per_category: int = 20) -> DataFrame:
    """(owner, article, score, k): candidates that share tags (each) and category with what an owner has.

    candidates: article, category, tags; own: owner, article, category, tags. What an owner has is never suggested.
    """
    tags = own.select("owner", F.explode("tags").alias("tag")).distinct()
    cats = own.select("owner", "category").distinct()
    t = candidates.select("article", F.explode("tags").alias("tag")).join(tags, "tag").select("owner", "article", F.lit(per_tag).alias("s"))
    c = candidates.select("article", "category").join(cats, "category").select("owner", "article", F.lit(per_category).alias("s"))
    s = t.unionByName(c).groupBy("owner", "article").agg(F.sum("s").alias("score")).join(own.select("owner", "article"), ["owner", "article"], "left_anti")
    return s.withColumn("k", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("score"), "article"))).where(F.col("k") <= top)
