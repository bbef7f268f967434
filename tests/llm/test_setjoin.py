"""Set join against brute force: no pair lost, whatever the sizes."""

import random
from fractions import Fraction

import pytest

from stackroom.llm import setjoin as SJ
from tests.conftest import rows


def brute(sets, t):
    out = set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = set(sets[a]), set(sets[b])
            if x and y and Fraction(len(x & y), len(x | y)) >= Fraction(t):
                out.add((a, b))
    return out


@pytest.mark.parametrize("t", ["0.8", "0.6", "0.5"])
def test_all_pairs(spark, t):
    r = random.Random(5)
    sets, n = {}, 0
    for size in [1, 2, 4, 5, 6, 9, 10, 12, 20, 40]:
        base = [f"t{r.randrange(60)}x{size}" for _ in range(size)]
        for _ in range(25):
            s = set(base)
            for _ in range(r.randrange(0, max(2, size // 4))):
                s.discard(r.choice(sorted(s))) if r.random() < 0.5 and len(s) > 1 else s.add(f"n{r.randrange(8)}")
            sets[n] = sorted(s)
            n += 1
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    reps, members = SJ.distinct_sets(df, "id", "items")
    pairs = SJ.similar_sets(reps, t)
    want = brute(sets, t)
    assert {(x.id_a, x.id_b) for x in SJ.expand(pairs, members).collect()} == want
    links = {x.id: x.n_links for x in SJ.links(pairs, reps, members).collect()}
    for k in sets:
        assert links[k] == sum(k in p for p in want)


def test_hollow_segments(spark):
    """Many sets that leave segments empty: the second split must lose nothing."""
    r = random.Random(9)
    sets = {i: sorted({f"w{r.randrange(14)}" for _ in range(10)}) for i in range(300)}
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    reps, members = SJ.distinct_sets(df, "id", "items")
    assert {(x.id_a, x.id_b) for x in SJ.expand(SJ.similar_sets(reps, "0.5"), members).collect()} == brute(sets, "0.5")


def test_hot_signatures(spark, monkeypatch):
    """Sets that share most tokens have the same signatures; cut into blocks they give the same pairs."""
    monkeypatch.setattr(SJ, "BLOCK", 8)
    r = random.Random(4)
    common = [f"c{i}" for i in range(12)]
    sets = {i: sorted({*common, *(f"v{r.randrange(40)}" for _ in range(r.randrange(0, 6)))}) for i in range(150)}
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    reps, members = SJ.distinct_sets(df, "id", "items")
    assert {(x.id_a, x.id_b) for x in SJ.expand(SJ.similar_sets(reps, "0.8"), members).collect()} == brute(sets, "0.8")


def test_empty_null_and_repeated(spark):
    data = [(1, []), (2, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "b"]), (None, ["a", "b"])]
    df = spark.createDataFrame(data, "id long, items array<string>")
    reps, members = SJ.distinct_sets(df, "id", "items")
    assert rows(SJ.expand(SJ.similar_sets(reps, "0.8"), members)) == [(2, 3)]
    none = df.limit(0)
    reps, members = SJ.distinct_sets(none, "id", "items")
    assert SJ.expand(SJ.similar_sets(reps, "0.8"), members).count() == 0
