"""Operators that SQL cannot hold to account, against plain Python on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackroom import registry as REG
from stackroom.functions import scalar as X
from stackroom.functions import text as T
from stackroom.operators import analysis as A
from stackroom.operators import graph as G
from stackroom.operators import retrieval as R
from stackroom.operators import sequence as Q
from stackroom.operators import similarity as S
from tests.conftest import rows


def graph(spark, edges, more=()):
    e = spark.createDataFrame(edges, "src string, dst string")
    n = spark.createDataFrame([(x,) for x in sorted({x for p in edges for x in p} | set(more))], "id string")
    return n, e


def test_pagerank_golden(spark):
    n, e = graph(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")], ["d"])
    got = {r.id: r["rank"] for r in G.pagerank(n, e).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 0.290844, "b": 0.161105, "c": 0.298052, "d": 0.0375}
    kept = G.pagerank(n, e, keep_dangling=True).agg(F.sum("rank")).first()[0]
    assert abs(kept - 1) < 1e-9
    n, e = graph(spark, [("x", "y")], ["z"])
    assert {r.id: round(r["rank"], 4) for r in G.pagerank(n, e).collect()} == {"x": 0.05, "y": 0.0925, "z": 0.05}
    assert G.pagerank(n.limit(0), e.limit(0)).count() == 0


def brandes(nodes, adj):
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, pred = {s: 0}, {s: 1.0}, [], {}
        todo = [s]
        while todo:
            v = todo.pop(0)
            order.append(v)
            for w in adj.get(v, ()):
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in pred.get(w, ()):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return out


def test_betweenness(spark):
    r = random.Random(2)
    edges = sorted({(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(30)})
    edges = [(a, b) for a, b in edges if a != b]
    n, e = graph(spark, edges)
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    want = brandes([x.id for x in n.collect()], adj)
    got = {x.id: x.betweenness for x in G.betweenness(n, e, n).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_components_and_triangles(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(35)]
    n, e = graph(spark, edges, ["alone"])
    group = {x.id: x.id for x in n.collect()}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert {x.id: x.component for x in G.components(n, e).collect()} == group
    u = {frozenset(p) for p in edges if p[0] != p[1]}
    tri = [t for t in itertools.combinations(sorted(group), 3) if all(frozenset(p) in u for p in itertools.combinations(t, 2))]
    assert {x.id: x.triangles for x in G.triangles(e).collect()} == {k: sum(k in t for t in tri) for k in group if any(k in t for t in tri)}


def test_topology(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")])
    assert rows(G.topological_levels(n, e)) == [("a", 0), ("b", 1), ("c", 2), ("x", -1), ("y", -1), ("z", -1)]
    assert rows(G.affected(e, n.where("id = 'c'"))) == [("a", 1), ("b", 1)]


def test_bm25_golden(spark):
    d = spark.createDataFrame([("d1", "spark joins tables fast"), ("d2", "spark streams events"), ("d3", "tables store rows tables"), ("d4", None)], "id string, text string").where("text IS NOT NULL")
    got = {r.doc: round(r.score, 6) for r in R.bm25(d, "id", "text", ["spark", "tables"]).collect()}
    assert got == {"d1": 0.903064, "d2": 0.511885, "d3": 0.652371}
    assert R.bm25(d, "id", "text", ["nothing"]).count() == 0
    assert R.bm25(d.limit(0), "id", "text", ["spark"]).count() == 0


def test_boolean_parser(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["c"]), (4, [])], "id int, ws array<string>")
    for q, want in {"a AND b": [1], "a OR c": [1, 3], "NOT b": [3, 4], "(a OR c) AND NOT b": [3], "a b": [1], "a AND (b": [1], "": [1, 2, 3, 4]}.items():
        assert sorted(r.id for r in d.where(R.boolean(q, F.col("ws"))).collect()) == want


def test_betweenness_query_takes_all_sources_and_lengths(spark, tmp_path):
    from stackroom.plans import links

    e = [(f"a{i:02}", f"a{i + 1:02}") for i in range(13)]  # a chain of thirteen steps
    spark.createDataFrame([(s, [t]) for s, t in e], "path string, similar_articles array<string>").write.parquet(f"{tmp_path}/tagging_suggestions.parquet")
    spark.createDataFrame([("alone",)], "path string").write.parquet(f"{tmp_path}/orphans_analysis.parquet")
    got = dict(rows(links.QUERIES["betweenness"](spark, str(tmp_path))))
    assert got == {f"a{i:02}": float(i * (13 - i)) for i in range(1, 13)}


def test_near_duplicates_recall(spark):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    docs, n = [], 0
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.randrange(60, 200))]
        for v in range(4):
            w = base[:]
            for _ in range(v):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((n, " ".join(w)))
            n += 1
    docs += [(900, ""), (901, None), (902, "one two"), (903, "one two"), (904, docs[0][1])] + [(1000 + i, docs[8][1]) for i in range(200)]
    got = {x.doc_id: x for x in S.near_duplicates(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect()}
    assert 900 not in got and 901 not in got and got[902].class_id == got[903].class_id == 902
    sh = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in docs if t}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sh), 2) if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])]
    assert np.mean([got[a].class_id == got[b].class_id for a, b in pairs]) >= 0.95
    assert got[904].copy_of == got[0].copy_of and got[1000].copy_of == got[8].copy_of
    # no class without a chain of true links
    import collections

    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    for x in got.values():
        seen, todo = {x.doc_id}, [x.doc_id]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        assert {k for k, y in got.items() if y.class_id == x.class_id} <= seen


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_near_duplicates_links_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(2000)]
    base, docs = [r.choice(vocab) for _ in range(300)], []
    for i in range(50):
        w = base[: 300 - r.randrange(20)]
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i, " ".join(w)))
    got = {x.doc_id: x for x in S.near_duplicates(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect()}
    sh = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in docs}
    own = {min(j for j in sh if sh[j] == sh[i]) for i in sh}
    want = {i: sum(len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]) for j in own if sh[j] != sh[i]) for i in sh}
    assert sum(want.values()) > 50 * 20
    # never a link too many, and the bands miss hardly any
    assert all(got[i].n_links <= want[i] for i in sh) and sum(got[i].n_links for i in sh) >= 0.995 * sum(want.values())


def test_simhash_near_for_near_texts(spark):
    base = " ".join(f"word{i}" for i in range(200))
    d = spark.createDataFrame([(0, base), (1, base + " more"), (2, " ".join(f"other{i}" for i in range(200))), (3, "")], "id int, t string")
    h = {r.id: r.h for r in d.select("id", S.simhash(T.words(F.col("t"))).alias("h")).collect()}
    bits = lambda a, b: bin((h[a] ^ h[b]) & (2**64 - 1)).count("1")
    assert bits(0, 1) <= 5 < bits(0, 2) and h[3] == 0


def test_textrank(spark):
    text = "The red fox sees the blue lake today. A blue lake holds the cold red water. Nothing here has anything in common with that."
    d = spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, t string")
    got = sorted((r.ord, r["rank"]) for r in A.textrank(d, "id", "t").collect())
    ss = [set(w) for w in (["the", "red", "fox", "sees", "blue", "lake", "today"], ["a", "blue", "lake", "holds", "the", "cold", "red", "water"], ["nothing", "here", "has", "anything", "in", "common", "with", "that"])]
    w = [[0 if i == j else len(a & b) / (np.log(len(a)) + np.log(len(b))) for j, b in enumerate(ss)] for i, a in enumerate(ss)]
    rank = np.ones(3)
    for _ in range(20):
        rank = np.array([0.15 + 0.85 * sum(w[i][j] * rank[j] / sum(w[j]) for j in range(3) if sum(w[j])) for i in range(3)])
    assert np.allclose([x for _, x in got], rank, atol=1e-5)


def test_gap_clusters(spark):
    d = spark.createDataFrame([("2026-01-01",), ("2026-01-20",), ("2026-03-01",), ("2026-03-31",), ("2026-05-01",), (None,)], "d string").select(F.to_timestamp("d").alias("at"))
    assert [r.n for r in Q.gap_clusters(d, "at", 30).orderBy("cluster").collect()] == [2, 2, 1]
    assert Q.gap_clusters(d.limit(0), "at", 30).count() == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = F.lit
    assert one(X.morse(s("SOS 1"))) == "... --- ... / .----" and one(X.unmorse(s("... --- ... / .----"))) == "sos 1"
    assert [one(X.roman(s(n))) for n in (1, 4, 1994, 3999, 0, 4000)] == ["I", "IV", "MCMXCIV", "MMMCMXCIX", None, None]
    assert one(X.unroman(s("MCMXCIV"))) == 1994
    assert one(X.fibonacci(s(8))) == [0, 1, 1, 2, 3, 5, 8, 13] and one(X.fibonacci(s(0))) == []
    assert [n for n in range(30) if one(X.is_prime(s(n)))] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert one(X.gcd(s(84), s(36))) == 12 and one(X.lcm(s(4), s(6))) == 12 and one(X.lcm(s(0), s(6))) == 0
    assert one(X.triangle_area(s(3.0), s(4.0), s(5.0))) == 6.0 and one(X.triangle_area(s(1.0), s(1.0), s(5.0))) is None
    assert one(X.hamming(s("karolin"), s("kathrin"))) == 3 and one(X.hamming(s("a"), s("ab"))) is None
    assert round(one(X.char_entropy(s("aabb"))), 6) == 1.0 and one(X.char_entropy(s(""))) == 0.0
    assert one(X.sentiment(s("this is a good and happy day"))) == 0.7 and one(X.sentiment(s("plain"))) == 0.5 and one(X.sentiment(s("bad"))) == 0.4
    assert one(X.is_card(s("4539 1488 0343 6467"))) and not one(X.is_card(s("1234 5678 9012 3456")))
    assert one(X.hex_to_rgb(s("#FF8000"))) == [255, 128, 0] and one(X.hex_to_rgb(s("x"))) is None
    assert one(X.distinct_lines(s("a\nB\na\nb"))) == "a\nB\nb" and one(X.distinct_lines(s("a\nB\na\nb"), True)) == "a\nB"
    assert tuple(one(X.line_diff(s("a\nb"), s("b\nc\nd")))) == (2, 1, 1)
    assert one(X.array_median(F.array(s(3.0), s(1.0), s(2.0), s(10.0)))) == 2.5 and one(X.array_mean(F.array().cast("array<double>"))) is None
    assert one(X.html_unescape(X.html_escape(s("<a href='x'>&\"")))) == "<a href='x'>&\""
    assert [one(X.file_size(s(n))) for n in (0, 1023, 1024, 5 * 1024**3)] == ["0.00 B", "1023.00 B", "1.00 KB", "5.00 GB"]
    assert one(X.percentage(s(1.0), s(0.0))) is None and one(X.capitalize(s("hELLO wORLD"))) == "Hello world"
    assert len(X.register(spark)) == len(X.SQL_FUNCTIONS)
    assert spark.sql("SELECT sr_is_anagram('Listen', 'sil ent'), sr_gcd(84, 36), sr_array_median(array(1D, 2D))").first()[:] == (True, 12, 1.5)


def test_registry(spark, tmp_path):
    qs = {"tag_counts": lambda s, d: s.range(3), "broken_search": lambda s, d: 1 / 0}
    reg = REG.registry(spark, qs)
    assert rows(reg.select("name", "category")) == [("broken_search", "search"), ("tag_counts", "tags")]
    assert REG.search(reg, "TAG").count() == 1
    assert REG.run(spark, qs, "tag_counts", "", str(tmp_path / "x")).rows == 3
    assert REG.run(spark, qs, "broken_search", "").status == "failed"
    assert REG.retry_order([(1, 5.0, 0), (10, 9.0, 2), (10, 1.0, 0), (5, 0.0, 3)]) == [(2, 0.0), (1, 4.0), (0, 0.0)]
