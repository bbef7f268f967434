"""Scoring rows against a stated set of queries."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackroom.operators import similarity as S


def test_answers_score_every_pair_and_keep_the_best(spark, monkeypatch):
    """Against brute force: all pairs and the best of each query, in blocks and passes of any size; null and equal ids, ties."""
    r = random.Random(5)
    data = [(i % 40 if i % 9 else None, [f"w{r.randrange(12)}" for _ in range(r.randrange(6))] + [None] * (i % 2), i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "id long, ws array<string>, kind long").select("id", S.hashed(F.col("ws")).alias("ws"), "kind")

    def score(common, sizes, query_sizes, plain, query_plain):
        return np.where(common[0] > 0, common[0] / (sizes[0] + query_sizes[0] - common[0]) + (plain[0] == query_plain[0]), np.nan)

    def plain(x, y):
        a, b = set(x[1]) - {None}, set(y[1]) - {None}
        return len(a & b) / len(a | b) + (x[2] == y[2]) if a & b else None

    pairs = sorted((q[0], x[0], round(s, 9)) for q in data for x in data if q[0] is not None and q[0] % 4 == 0 and x[0] is not None and x[0] != q[0] and (s := plain(q, x)) is not None)
    one = {q[0]: q for q in reversed(data) if q[0] is not None}
    of = lambda q: ((q, i, s) for i, x in one.items() if i != q and (s := plain(one[q], x)) is not None)
    best = sorted((q, i, round(s, 9)) for q in one if q % 4 == 0 for q, i, s in sorted(of(q), key=lambda p: (-round(p[2], 6), p[1]))[:3])
    unique = spark.createDataFrame(list(one.values()), "id long, ws array<string>, kind long").select("id", S.hashed(F.col("ws")).alias("ws"), "kind")
    top = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    for held in (S.PASS, 20):
        monkeypatch.setattr(S, "PASS", held)
        assert sorted((a, b, round(s, 9)) for a, b, s in S.answers(df, df.where("id % 4 = 0"), ["ws"], score).collect()) == pairs
        got = S.answers(unique, unique.where("id % 4 = 0"), ["ws"], score, 3).withColumn("k", F.row_number().over(top)).where("k <= 3")
        assert sorted((x.query_id, x.id, round(x.score, 9)) for x in got.collect()) == best
    assert S.answers(df, df.where("id < 0"), ["ws"], score).count() == 0


@pytest.mark.parametrize("name", ["similar_word_sets", "hybrid_related", "integration_candidates"])
def test_no_pair_is_moved(spark, name):
    """The plan joins nothing per pair: only what is given out leaves the tasks that score."""
    plan = __import__("__spark_entry__").queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInPandas" in plan


@pytest.mark.parametrize("held", [S.PASS, 300])
def test_hybrid_related_answers_every_article(spark, tmp_path, monkeypatch, held):
    """Every article has its five best, as all pairs in plain Python give them: ties, no tags, no title, a tag of most rows; one pass and several."""
    monkeypatch.setattr(S, "PASS", held)
    monkeypatch.setattr(S, "SEEDS", 6)
    r = random.Random(3)
    tags, words = [f"t{i}" for i in range(9)], ["red", "green", "blue", "old", "new"]
    data = []
    for i in range(1, 141):
        own = None if i % 11 == 0 else sorted({*r.sample(tags, r.randrange(4)), *(["hot"] if i % 3 else [])})
        title = None if i % 13 == 0 else " ".join(r.sample(words, r.randrange(1, 4)))
        data.append((i, own or [], title or "", r.choice("ab"), r.choice("xyz")))
    rows = spark.createDataFrame([(i, t, w.split(), ord(c), ord(u)) for i, t, w, c, u in data], "id long, tags array<string>, ws array<string>, category long, subcategory long")
    rows = rows.select("id", S.hashed(F.col("tags")).alias("tags"), S.hashed(F.col("ws")).alias("ws"), "category", "subcategory")
    want = []
    for i, t, w, c, u in data:
        found = []
        for j, t2, w2, c2, u2 in data:
            a, b, x, y = set(t), set(t2), set(w.split()), set(w2.split())
            if i != j and (a & b or x & y):
                found.append((-round(0.5 * len(a & b) / max(len(a | b), 1) + 0.3 * len(x & y) / max(len(x | y), 1) + 0.2 * min(1, (c == c2) + 0.5 * (u == u2)), 6), j))
        want += [(i, j, -s, k) for k, (s, j) in enumerate(sorted(found)[:5], 1)]
    assert sorted(tuple(x) for x in S.related(rows, 5).select("query_id", "id", "score", "rank").collect()) == sorted(want)
    assert S.related(rows.where("id < 0"), 5).count() == 0


def test_hybrid_related_leaves_no_article_out(spark):
    """The query answers for ids that are not divisible by 100 too."""
    e = __import__("__spark_entry__")
    assert e.queries()["hybrid_related"](spark, "/root/testdata/sf0.001").where("query_id % 100 <> 0").count() > 0
    assert "% 100" not in e.oracle_sql()["hybrid_related"]
