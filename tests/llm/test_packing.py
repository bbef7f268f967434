import os
import random

import numpy as np
import pytest

from stackroom.llm import packing as PA


def check(spark, lengths, capacity):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, n_tokens long, offset string")
    got = PA.pack(df, capacity).collect()
    by, pieces = {}, {}
    for r in got:
        by.setdefault(r.container_id, []).append((r.offset, r.n_tokens))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at  # side by side, none overlaps
            at += n
        assert at <= capacity
    for i, n in enumerate(lengths):
        if not n:
            assert i not in pieces
            continue
        p = sorted(pieces[i])
        assert sum(x[2] for x in p) == n and [x[1] for x in p] == list(np.cumsum([0] + [x[2] for x in p[:-1]]))
        assert len(p) == -(-n // capacity)  # split only beyond the capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def first_fit(lengths, capacity):
    """Containers that first fit in falling order takes."""
    room = []
    for n in sorted((x for l in lengths for x in [capacity] * (l // capacity) + [l % capacity] if x), reverse=True):
        i = next((i for i, x in enumerate(room) if x >= n), None)
        if i is None:
            room.append(capacity - n)
        else:
            room[i] -= n
    return len(room)


def test_mixed(spark):
    r = random.Random(1)
    lengths = [r.choice([0, 1, 5, 40, r.randrange(1, 300), 100, 100, 250]) for _ in range(2000)] + [256, 512, 700, 255, None or 0]
    assert check(spark, lengths, 256) <= first_fit(lengths, 256)
    smooth = [r.randrange(1, 257) for _ in range(3000)]
    assert check(spark, smooth, 256) <= -(-sum(smooth) // 256) * 1.01 + 1


def test_hot_length_and_tiny_tables(spark):
    assert check(spark, [100] * 500, 256) == 250
    assert check(spark, [], 256) == 0
    assert check(spark, [3], 256) == 1
    assert check(spark, [0, 0], 256) == 0


def test_plan_uses_every_item_once():
    r = np.random.default_rng(2)
    hist = np.zeros(513, np.int64)
    np.add.at(hist, r.integers(1, 513, 30000), 1)
    used = np.zeros(513, np.int64)
    for p, n in PA.plan(hist, 512):
        assert sum(p) <= 512 and n > 0
        for l in p:
            used[l] += n
    assert (used == hist).all()


@pytest.mark.skipif(not os.path.exists(PA.VOCABULARY), reason="no tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "Привет, мир! " * 2000), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in PA.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 4000 and None not in got
