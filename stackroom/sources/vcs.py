"""Parsers of version-control text: change logs with line counts and line annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A commit's header line; fields are parted by a bar.
HEADER = r"^([0-9a-f]{7,40})\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
COUNTS = r"^(\d+|-)\t(\d+|-)\t(.+)$"
STATUS = r"^([AMDRCT])\d*\t(.+)$"


def _grouped(lines: DataFrame, file: str, line: str, text: str) -> DataFrame:
    """Lines with the number of the header they stand below. Log files are bounded by their writer: one file, one group."""
    w = W.partitionBy(file).orderBy(line)
    return lines.withColumn("_h", F.sum(F.col(text).rlike(HEADER).cast("int")).over(w))


def commit_log(lines: DataFrame, file: str = "file", line: str = "line", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of log lines ``hash|author|email|date|message`` followed by counts or status lines.

    Lines of no known form are skipped; binary files have no counts.
    """
    g = _grouped(lines, file, line, text).where("_h > 0")
    part = lambda i: F.regexp_extract(text, HEADER, i)
    commits = g.where(F.col(text).rlike(HEADER)).select(file, "_h", part(1).alias("hash"), part(2).alias("author"), part(3).alias("email"), F.try_to_timestamp(part(4)).alias("at"), part(5).alias("message"))
    num = lambda i: F.regexp_extract(text, COUNTS, i).try_cast("int")
    counts = g.where(F.col(text).rlike(COUNTS)).select(file, "_h", num(1).alias("insertions"), num(2).alias("deletions"), F.regexp_extract(text, COUNTS, 3).alias("path"), F.lit(None).cast("string").alias("status"))
    status = g.where(F.col(text).rlike(STATUS)).select(file, "_h", F.lit(None).cast("int").alias("insertions"), F.lit(None).cast("int").alias("deletions"), F.regexp_extract(text, STATUS, 2).alias("path"), F.regexp_extract(text, STATUS, 1).alias("status"))
    both = counts.unionByName(status).groupBy(file, "_h", "path").agg(F.max("insertions").alias("insertions"), F.max("deletions").alias("deletions"), F.max("status").alias("status"))
    files = both.join(commits.select(file, "_h", "hash"), [file, "_h"]).select("hash", "status", "path", "insertions", "deletions")
    return commits.drop(file, "_h"), files


def file_history(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per path the number of commits and authors, first and last time, lines added and removed."""
    return files.join(commits, "hash").groupBy("path").agg(
        F.countDistinct("hash").alias("n_commits"), F.countDistinct("author").alias("n_authors"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.sum("insertions").alias("added"), F.sum("deletions").alias("removed"),
    )


def versions(tags: DataFrame, col: str = "tag") -> DataFrame:
    """Version tags with their parts, newest first; text that is no version is left out."""
    p = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?$"
    n = lambda i: F.regexp_extract(col, p, i).cast("int")
    v = tags.where(F.col(col).rlike(p)).select(col, n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch"), F.regexp_extract(col, p, 4).alias("pre"))
    return v.orderBy(F.desc("major"), F.desc("minor"), F.desc("patch"), F.desc(F.col("pre") == ""), F.desc("pre"))
