import random

from stackroom.llm import leakage as LE
from tests.conftest import rows

R = random.Random(7)
VOCAB = [f"word{i}" for i in range(300)]
INSTRUCTION = "please read the passage below and answer the question with care "


def sentence(n):
    return [R.choice(VOCAB) for _ in range(n)]


ITEMS = [sentence(60) for _ in range(5)]


def frames(spark, docs):
    items = [(i + 1, INSTRUCTION + " ".join(w) + ".") for i, w in enumerate(ITEMS)] + [(90, None), (91, ""), (92, "...")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs):
    d, i = frames(spark, docs)
    return rows(LE.leaks(d, "doc_id", "text", i, "item_id", "text").select("doc_id", "item_id"))


def test_cases(spark):
    noise = lambda n: " ".join(sentence(n))
    w = ITEMS[0]
    altered = [x + "s" if k % 4 == 3 else x for k, x in enumerate(w)]
    cut_in = w[:30] + sentence(12) + w[30:]
    shuffled = w[:]
    R.shuffle(shuffled)
    docs = [
        (1, noise(200) + " " + " ".join(w).upper() + ". " + noise(100)), (2, noise(50) + " " + " ".join(w[:40]) + " " + noise(50)), (3, noise(80) + "\n" + "\n".join(altered) + noise(9)), (4, " ".join(cut_in)),
        (5, noise(90) + " " + " ".join(w[:18]) + " " + noise(90)), (6, INSTRUCTION + noise(200)), (7, " ".join(shuffled)), (8, ""), (9, None), (10, " ".join(ITEMS[1]) + " " + " ".join(ITEMS[2])), (11, noise(30000)),
        (12, noise(20000) + " " + " ".join(ITEMS[3]) + noise(9)), (12, "x"),
    ]
    assert found(spark, docs) == [(1, 1), (2, 1), (3, 1), (4, 1), (10, 2), (10, 3), (12, 4)]


def test_spans_are_removed(spark):
    d, i = frames(spark, [(1, "Before it. " + " ".join(ITEMS[0]) + ". After it."), (2, "Nothing here"), (3, "")])
    got = {r.doc_id: (r.text, r.n_removed) for r in LE.cleaned(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {1: ("Before it. . After it.", 1), 2: ("Nothing here", 0)}


def test_every_copy_and_part_is_removed(spark):
    w, v = " ".join(ITEMS[0]), " ".join(ITEMS[1])
    far = " ".join(f"other{i}" for i in range(60))
    part = " ".join(ITEMS[0][:38]), " ".join(ITEMS[0][38:])
    docs = [
        (1, f"Start {w} {far} {w} {far} {w} end"), (2, f"Start {w} {w} end"), (3, f"Start {part[0]} {far} {part[1]} end"), (4, f"Start {w} {far} {v} {far} {w} end"),
    ]
    d, i = frames(spark, docs)
    got = {r.doc_id: (r.text.split(), r.n_removed) for r in LE.cleaned(d, "doc_id", "text", i, "item_id", "text").collect()}
    f = far.split()
    assert got == {1: (["Start", *f, *f, "end"], 3), 2: (["Start", "end"], 2), 3: (["Start", *f, "end"], 2), 4: (["Start", *f, *f, "end"], 3)}
    spans = rows(LE.leaks(d, "doc_id", "text", i, "item_id", "text").select("doc_id", "item_id", "first_word", "last_word"))
    assert spans[:3] == [(1, 1, 1, 60), (1, 1, 121, 180), (1, 1, 241, 300)] and (3, 1, 99, 120) in spans


def test_several_passes(spark, monkeypatch):
    """Shared openings and spans are the same however the items are dealt to passes."""
    docs = [(1, " ".join(ITEMS[0])), (2, " ".join(ITEMS[4])), (3, INSTRUCTION * 3), (4, INSTRUCTION), (5, f"a {' '.join(ITEMS[1])} b {' '.join(ITEMS[2])} c {' '.join(ITEMS[1])} d")]
    d, i = frames(spark, docs)
    want = found(spark, docs), rows(LE.cleaned(d, "doc_id", "text", i, "item_id", "text"))
    assert want[0] == [(1, 1), (2, 5), (5, 2), (5, 2), (5, 3)] and want[1][4] == (5, "a  b  c  d", 3)
    for least in (1200, 1):
        monkeypatch.setattr(LE, "ITEM_BYTES", least)
        assert (found(spark, docs), rows(LE.cleaned(d, "doc_id", "text", i, "item_id", "text"))) == want


def test_recall_by_gap_and_alteration():
    """Whole items in runs with foreign words between, and with a share of words altered."""
    r = random.Random(5)
    items = LE.Items([(i, " ".join(w), 0) for i, w in enumerate(ITEMS)])
    foreign = lambda n: [f"other{r.randrange(5000)}" for _ in range(n)]
    hits = lambda words, k: any(x[1] == k for x in LE._scan([" ".join(words)], items))
    for gap in (0, 12, 39, 60, 100, 200):
        for run in (10, 20, 30):
            for k, w in enumerate(ITEMS):
                assert hits(sum((w[a : a + run] + foreign(gap) for a in range(0, 60, run)), foreign(300)) + foreign(300), k), (gap, run)
    for every in (2, 3, 4):
        for k, w in enumerate(ITEMS):
            assert hits(foreign(50) + [x + "s" if n % every == 0 else x for n, x in enumerate(w)] + foreign(50), k)
            assert hits(foreign(50) + [foreign(1)[0] if n % every == 0 else x for n, x in enumerate(w)] + foreign(50), k)
    for k, w in enumerate(ITEMS):
        assert not hits(foreign(50) + w[:26] + foreign(200) + w[:26] + foreign(50), k)
        assert not hits([x for n, x in enumerate(w) if n % 5 < 2], k)


def test_empty_tables(spark):
    d, i = frames(spark, [(1, " ".join(ITEMS[0]))])
    assert LE.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert LE.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
