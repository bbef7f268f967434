"""Co-occurrence against brute force."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from stackroom.llm import cooccurrence as CO


def brute(sets, least, lift):
    sets = [set(s) for s in sets if s]
    n, one, two = len(sets), Counter(), Counter()
    for s in sets:
        one.update(s), two.update(combinations(sorted(s), 2))
    return {(a, b, k) for (a, b), k in two.items() if k >= least and (lift is None or k * n >= lift * one[a] * one[b])}


def check(spark, sets, least=2, lift=None, per=None):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sets)], "n long, items array<string>, item_a string")
    got = {(r.item_a, r.item_b, r.n_ab) for r in CO.cooccurrence(df, "items", least, per, lift).collect()}
    assert got == brute([[x for x in s or [] if x is not None] for s in sets], least, lift)


def test_small(spark):
    r = random.Random(1)
    sets = [[f"i{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randrange(0, 9))] for _ in range(400)]
    check(spark, sets + [None, [], [None, "a"]], 3, 1.2)


def test_heavy_rows(spark, monkeypatch):
    r = random.Random(2)
    sets = [sorted({f"i{r.randrange(3000)}" for _ in range(900)}) for _ in range(6)] + [["i1", "i2"]] * 5
    check(spark, sets, 3)


def test_shuffled_index(spark, monkeypatch):
    monkeypatch.setattr(CO, "DENSE_ITEMS", 5)
    r = random.Random(3)
    check(spark, [[f"i{r.randrange(20)}" for _ in range(5)] for _ in range(200)], 4, 1.1)


def test_empty(spark):
    check(spark, [])


def test_item_set(spark):
    df = spark.createDataFrame([([" B", "b ", None, "", " a"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(CO.item_set(F.col("t"))).collect()] == [["a", "b"], []]
