"""Incremental batch operators: change capture, snapshots, retention, upserts, duplicate history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def changes(before: DataFrame, after: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, change): added, removed or changed by content hash; unchanged keys are left out. Null keys match nothing."""
    h = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(content).alias(n), F.lit(True).alias(f"in_{n}"))
    j = h(before, "a").join(h(after, "b"), "key", "full_outer")
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select("key", kind.alias("change")).where("change IS NOT NULL")


def upsert(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """State with the rows of ``new`` in place of its own: anti join and union."""
    return state.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def expired(df: DataFrame, at: str, now: Column, hours: int, *terminal: Column) -> DataFrame:
    """Rows older than so many hours, where every terminal condition holds."""
    out = df.where(F.col(at).cast("timestamp") < now - F.expr(f"INTERVAL {hours} HOURS"))
    for t in terminal:
        out = out.where(t)
    return out


def backup_chain(snapshots: DataFrame) -> DataFrame:
    """Last full snapshot and the incremental ones after it, in order. snapshots: taken_at, kind, path.

    The last full one is an extreme, found by aggregation; the table is not sorted as a whole.
    """
    last = snapshots.where("kind = 'full'").agg(F.max("taken_at").alias("since"))
    return snapshots.join(F.broadcast(last), F.lit(True)).where("taken_at >= since AND (kind = 'incremental' OR taken_at = since AND kind = 'full')").drop("since")


def first_seen(df: DataFrame, content: str, order: str, key: str) -> DataFrame:
    """(key, duplicate_of): rows whose content an earlier row had, with that row's key."""
    first = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(F.struct(order, key)).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    j = df.join(first, content).select(F.col(key).alias("key"), F.col(f"f.{key}").alias("duplicate_of"))
    return j.where("key <> duplicate_of")


def keep_newest(df: DataFrame, at: str, n: int, *by: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc(at))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def cache_key(tool: Column, *params: Column) -> Column:
    """Name of a cached result: the tool and a hash of its parameters."""
    return F.concat_ws(":", tool, F.lower(F.conv(F.abs(F.hash(*params)).cast("string"), 10, 36)))
