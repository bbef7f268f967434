"""Joins and rankings that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.session import cut

#: A key is hot when it holds more than this share of the rows; so there are at most
#: 1 / HOT_SHARE hot keys, whatever the input, and that bounds what is broadcast for them.
HOT_SHARE = 1 / 256


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of the rows: at most 1/share rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    # total is one row by construction, the broadcast of it is of proven size
    return counts.join(F.broadcast(total), F.col("_n") > F.greatest(F.col("_all") * share, F.lit(1000.0))).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a large table with a table that has one row per key, salting the key.

    Each left row draws one of ``salts`` values from a hash of all its columns, the right side
    is replicated that often; a hot key is so read by ``salts`` tasks. Null keys match nothing.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if not left.schema[c].dataType.typeName() == "map"]), F.lit(salts)).cast("int")
    l = left.withColumn("_s", spread)
    r = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "_s"], how).drop("_s")


def bucket_offsets(df: DataFrame, by: list[str], bucket: str, weight: Column) -> DataFrame:
    """Per (by, bucket) the sum of weight over the smaller buckets of the same group.

    The window sees one row per group and bucket, not the rows themselves.
    """
    sums = df.groupBy(*by, bucket).agg(F.sum(weight).alias("_w"))
    w = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_w").over(w), F.lit(0))).drop("_w")


def pairs_within(df: DataFrame, key: str, item: str, block: int = 1000) -> DataFrame:
    """(key, a < b) of the items that share a key; a key of many items is cut into blocks, each two of which meet in a task.

    df: distinct (key, item) rows. What comes out is as long as the answer.
    """
    many = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_k"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    m = lookup(df.select(key, item), many, key, "inner").withColumn("_own", F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    left, right = m.select(key, F.col("_own").alias("_r"), each.alias("_q"), F.col(item).alias("a")), m.select(key, each.alias("_r"), F.col("_own").alias("_q"), F.col(item).alias("b"))
    return left.join(right, [key, "_r", "_q"]).where("a < b").select(key, "a", "b")


def ranked(df: DataFrame, *order: Column, name: str = "_rank") -> DataFrame:
    """Rank from 0 over all rows: sorted range partitions, each counted, and the counts before it added.

    No window sees more than one row per partition. Rows equal in ``order`` are ranked in any order.
    """
    laid = cut(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    laid = laid.withColumn("_pid", F.shiftright("_at", 33).cast("int"))
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_pid", F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(before), "_pid").withColumn(name, own + F.col("_before")).drop("_at", "_pid", "_before")
