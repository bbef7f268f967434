import random

import numpy as np

from stackroom.llm import reading as RE

EASY = "кот дом лес сад чай хлеб стол мяч рука окно вода снег".split()
HARD = "гетерогенность параллелизация стандартизация декомпозиция репрезентативность инвариантность верификация аппроксимация".split()


def text(r, level, n=160):
    out = []
    while n > 0:
        k = r.randrange(3, 6) + 4 * level
        ws = [r.choice(HARD if r.random() < (level - 1) / 4.5 else EASY) for _ in range(k)]
        out.append(" ".join(ws).capitalize() + ".")
        n -= k
    return " ".join(out)


def corpus(n=400, seed=3):
    r = random.Random(seed)
    level = [1 + i % 5 for i in range(n)]
    return [(i, text(r, l)) for i, l in enumerate(level)], level


def test_held_out_levels(spark):
    docs, level = corpus()
    labels = [(i, level[i], "a") for i in range(0, 400, 2)] + [(0, None, "b"), (None, 3, "b")]
    d = spark.createDataFrame(docs + [(900, ""), (901, None), (902, "Мало слов."), (None, "x")], "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, reading_level int, lang string")
    got = {r.doc_id: r.reading_level for r in RE.reading_levels(d, "doc_id", "text", l, "doc_id", "reading_level").collect()}
    assert set(got) == set(range(400))
    assert np.mean([got[i] == level[i] for i in range(1, 400, 2)]) >= 0.9
    none = RE.reading_levels(d, "doc_id", "text", l.limit(0), "doc_id", "reading_level")
    assert {r.reading_level for r in none.collect()} == {None}
    assert RE.reading_levels(d.limit(0), "doc_id", "text", l, "doc_id", "reading_level").count() == 0


def test_ranks_joined_as_broadcast(spark):
    docs, _ = corpus(30)
    m = RE.measured(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    a = {r.doc_id: r.x for r in RE.demands(m).collect()}
    b = {r.doc_id: r.x for r in RE.demands(m, 0).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_word_ranks(spark):
    m = spark.createDataFrame([(1, "ru", ["a", "b"], [3, 2]), (2, "ru", ["c", "b", "d"], [2, 1, 1])], "doc_id long, lang string, words array<string>, counts array<int>")
    assert {r.word: r["rank"] for r in RE.word_ranks(m).collect()} == {"a": 2, "b": 2, "c": 3, "d": 4}


def test_prose():
    t = "---\ntitle: x\n---\r\n# Head\n\nFirst line\nof prose with [a link](/x.md) and `code`.\n\n- item one\n  goes on\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n```\n\nSecond para.\n\n    indented code\n"
    assert RE.prose(t) == ["First line of prose with   and  .", "Second para."]
    assert RE.prose("") == [] and RE.prose("```\nopen fence\n\ntext") == []


def test_cover():
    assert RE.cover(np.array([5, 1, 2]), np.array([1, 7, 2]), (0.5, 0.8, 0.95)) == [1, 2, 5]
