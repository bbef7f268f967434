"""Readers of the driver's tables and the row-version rules they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str | Column, *columns: Column) -> DataFrame:
    """Per key the given columns of the row with the greatest version.

    One partial aggregation, no window: a key that holds a third of all rows is reduced on
    the map side. Equal versions are broken by the column values, so that repeated rows and
    ties give one row, always the same. Rows whose key is null are left out; a null version
    counts as the oldest.
    """
    v = F.col(version) if isinstance(version, str) else version
    names = [df.select(c).columns[0] for c in columns]
    packed = F.struct(v.alias("_v"), *[c.alias(n) for c, n in zip(columns, names)])
    g = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(packed).alias("_r"))
    return g.select(F.col(key), *[F.col(f"_r.{n}").alias(n) for n in names])


def current_articles(df: DataFrame, *columns: Column) -> DataFrame:
    """Current row of each record of ``orphans_analysis``."""
    return latest(df, "record_id", "loaded_at", *columns)
