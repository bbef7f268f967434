from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stackroom.operators import orphan_refs as O
from tests.conftest import rows

BASE = "knowledge/a/articles/x/doc.md"


@pytest.mark.parametrize(
    "entry,want",
    [
        ("../y/n.md", "knowledge/a/articles/y/n.md"), ("n.md#part", "knowledge/a/articles/x/n.md"), ("./n.md?v=1#p", "knowledge/a/articles/x/n.md"), ("/knowledge//b/n.md", "knowledge/b/n.md"),
        ("knowledge/b/../c/n.md", "knowledge/c/n.md"), ("..\\y\\n.md", "knowledge/a/articles/y/n.md"), ("..//../n.md ", "knowledge/a/n.md"), ("%D0%B0%2Db.md", "knowledge/a/articles/x/а-b.md"),
        ("a+b%20c.md", "knowledge/a/articles/x/a+b c.md"), ("50%-off.md", "knowledge/a/articles/x/50%-off.md"), (" n.md\n", "knowledge/a/articles/x/n.md"), ("https://h.example/p", None), ("mailto:a@b.c", None),
        ("desk@kb.invalid", None), ("#part", None), ("", None), ("  ", None), (None, None), ("?v=2", None), ("../../../../../../n.md", "n.md"), ("N.MD", "knowledge/a/articles/x/N.MD"),
    ],
)
def test_plain_path(spark, entry, want):
    df = spark.createDataFrame([(entry, BASE)], "e string, b string")
    assert df.select(O.plain_path(F.col("e"), F.col("b"))).first()[0] == want


def test_relative_without_base(spark):
    df = spark.createDataFrame([("n.md", None), ("/n.md", None)], "e string, b string")
    assert [r[0] for r in df.select(O.plain_path(F.col("e"), F.col("b"))).collect()] == [None, "n.md"]


def ts(n):
    return datetime(2025, 1, n)


def test_kinds(spark):
    parents = spark.createDataFrame([("t", "a", False, ts(1)), ("t", "b", True, ts(1)), ("t", "c", False, ts(9)), ("t", "c", False, ts(5)), ("t", None, False, ts(1))], "parent_table string, key string, deleted boolean, since timestamp")
    kids = [("s", 1, "t", "a", ts(2)), ("s", 2, "t", "b", ts(2)), ("s", 3, "t", "c", ts(2)), ("s", 4, "t", "c", ts(6)), ("s", 5, "t", "zz", ts(2)), ("s", 5, "t", "zz", ts(2)), ("s", 6, "t", None, ts(2)), ("s", 7, "t", "c", None), ("s", 8, "t", "zz", None)]
    children = spark.createDataFrame(kids, "src_table string, src_id long, parent_table string, key string, at timestamp")
    got = O.find_orphans(parents, children)
    assert sorted((r.src_id, r.kind) for r in got.collect()) == [(2, "deleted"), (3, "late"), (5, "missing"), (8, "missing")]
    assert O.find_orphans(parents.limit(0), children).where("kind <> 'missing'").count() == 0
    assert O.find_orphans(parents, children.limit(0)).count() == 0
    assert sum(r.n_refs for r in O.orphan_counts(got).collect()) == 4


def test_hot_key(spark):
    parents = spark.createDataFrame([("t", "a", False, ts(1))], "parent_table string, key string, deleted boolean, since timestamp")
    children = spark.range(3000).select(F.lit("s").alias("src_table"), F.col("id").alias("src_id"), F.lit("t").alias("parent_table"), F.when(F.col("id") % 3 == 0, "hot").otherwise("a").alias("key"), F.lit(ts(2)).alias("at"))
    assert O.find_orphans(parents, children).groupBy("kind").count().collect()[0]["count"] == 1000
    assert rows(O.find_orphans(parents, children).select("kind").distinct()) == [("missing",)]
