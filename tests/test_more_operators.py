"""Networks, web links, markup, knowledge, progress and upkeep: defined results for nulls, ties, empty and clashing input."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from stackroom import skew
from stackroom.functions import markup as M
from stackroom.operators import knowledge as K
from stackroom.operators import network as N
from stackroom.operators import progress as P
from stackroom.operators import upkeep as U
from stackroom.operators import weblinks as L
from tests.conftest import rows

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), (None, "a"), ("d", None), ("a", "a"), ("a", "b")]


def test_simple_paths_by_search(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    got = {tuple(r.nodes) for r in N.simple_paths(e, spark.createDataFrame([("a",), (None,), ("zz",)], "id string"), 4).collect()}
    out = {x: sorted({d for s, d in EDGES if s == x and d and d != x}) for x in "abcd"}
    want, todo = set(), [("a",)]
    while todo:
        p = todo.pop()
        for d in out[p[-1]]:
            if d not in p and len(p) < 4:
                want.add((*p, d)), todo.append((*p, d))
    assert got == want
    assert N.simple_paths(e.limit(0), spark.createDataFrame([("a",)], "id string")).count() == 0


def test_louvain_never_lowers_modularity(spark):
    r = random.Random(2)
    groups = [[f"g{k}n{i}" for i in range(6)] for k in range(4)]
    e = [p for g in groups for p in combinations(g, 2)] + [(r.choice(groups[k]), r.choice(groups[(k + 1) % 4])) for k in range(4)]
    nodes = spark.createDataFrame([(x,) for g in groups for x in g] + [("alone",)], "id string")
    c = {x.id: x.community for x in N.louvain(nodes, spark.createDataFrame(e, "src string, dst string"), 6).collect()}
    und = {frozenset(p) for p in e}
    deg = {x: sum(x in p for p in und) for x in c}

    def q(of):
        m = len(und)
        return sum(len({of[x] for x in p}) == 1 for p in und) / m - sum((sum(deg[x] for x in c if of[x] == k) / (2 * m)) ** 2 for k in set(of.values()))

    assert q(c) > q({x: x for x in c}) and c["alone"] == "alone" and len(set(c.values())) < 15


def test_pairs_within_and_ranked(spark):
    r = random.Random(1)
    items = sorted({(k, r.randrange(40)) for k in ("hot", "hot", "hot", "x", "y") for _ in range(40)}) + [("one", 1)]
    df = spark.createDataFrame(items + [(None, 3)], "k string, i long")
    want = sorted((k, a, b) for k in {k for k, _ in items} for a, b in combinations(sorted(i for x, i in items if x == k), 2))
    assert rows(skew.pairs_within(df, "k", "i", 7)) == want
    v = [(r.randrange(10), i) for i in range(200)]
    got = skew.ranked(spark.createDataFrame(v, "v int, id long").repartition(7), F.desc("v"), F.col("id")).orderBy("_rank").collect()
    assert [(x.v, x.id) for x in got] == sorted(v, key=lambda x: (-x[0], x[1])) and [x._rank for x in got] == list(range(200))
    assert skew.ranked(spark.createDataFrame([], "v int"), F.col("v")).count() == 0


def test_domains_and_health(spark):
    links = [("p1", "c1", "https://www.A.org/x", 1), ("p2", "c2", "http://a.org", 5), ("p2", "c3", "mailto:x@y", 2), ("p3", None, None, None), ("p3", None, "https://b.io/#", 3)]
    df = spark.createDataFrame(links, "article string, category string, url string, at long")
    got = {r.domain: (r.n_articles, r.n_citations, r.n_categories, round(r.authority, 3), round(r.trust, 3)) for r in L.domains(df).collect()}
    assert got == {"a.org": (2, 2, 2, 20.0, 20.0), "b.io": (1, 1, 0, 6.0, 0.0)}
    h = spark.createDataFrame([(200, 0, 90, 10), (301, 2, -1, 9000), (404, 0, 90, 1), (None, None, None, None), (200, None, None, None)], "s int, r int, c int, m int")
    assert [r[0] for r in h.select(L.health(*(F.col(x) for x in "srcm"))).collect()] == [100, 35, 0, 0, 100]
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), (None, "q")], "url string, to string")
    assert rows(L.redirect_chains(hops).where("url IN ('a', 'x')")) == [("a", "c", 2, False), ("x", "x", 2, True)]


def test_markup(spark):
    t = '![a b c d e f](x.PNG "T") ![](data:image/gif;base64,AAAA)\nРис. 3. Схема\nsee рис. 3 and fig 3, [3] #12 @n/a.md [[idea]] 10.1234/AbC. ВАЖНО помнить\n'
    r = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(
        M.images(F.col("t")).alias("i"), M.captions(F.col("t")).alias("c"), M.mentions(F.col("t"), F.lit(3)).alias("m"), M.dois(F.col("t")).alias("d"), M.references(F.col("t")).alias("r"), M.excerpts(F.col("t")).alias("e")
    ).collect()
    assert [(x.alt, x.url, x.title, x.embedded_bytes) for x in r[0].i] == [("a b c d e f", "x.PNG", "T", None), ("", "data:image/gif;base64,AAAA", "", 3)]
    assert (r[0].c, r[0].m, r[0].d) == (["Схема"], 4, ["10.1234/abc"]) and [tuple(x) for x in r[0].r] == [("note", "12"), ("article", "n/a.md"), ("concept", "idea")]
    assert [tuple(x) for x in r[0].e] == [("key_idea", "ВАЖНО помнить")]
    assert all(x.i == x.c == x.d == x.r == x.e == [] and x.m == 0 for x in r[1:])
    c = spark.createDataFrame([("Ann Mary Poe", "T", 2020, "u"), (None, None, None, None)], "a string, t string, y int, u string")
    got = c.select(*[M.citation(s, F.col("a"), F.col("t"), F.col("y"), F.col("u"), F.lit(2)).alias(s) for s in ("apa", "mla", "ieee")]).collect()
    assert tuple(got[0]) == ("Poe, A. M. (2020). T. u", 'Poe, Ann Mary. "T." 2020. u', '[2] A. M. Poe, "T," 2020. u') and got[1].apa == "Unknown (n.d.). Untitled."


def test_knowledge(spark):
    d = spark.createDataFrame([(1, "# Server\nserver and filter. Filter! server\n"), (2, None), (3, ""), (4, "filter filter server")], "id long, text string")
    e = K.entities(d, "id", "text", ["server", "filter"])
    assert rows(e) == [(1, "filter", "term", 2), (1, "server", "heading", 1), (1, "server", "term", 3), (4, "filter", "term", 2), (4, "server", "term", 1)]
    rel = K.sentence_relations(d, "id", "text", ["server", "filter"])
    assert rows(rel) == [("filter", "server", 2)] and K.sentence_relations(d.limit(0), "id", "text", ["a"]).count() == 0
    assert rows(K.importance(e.where("kind = 'term'"), rel)) == [("filter", 4, 1, 6), ("server", 4, 1, 6)]
    t = spark.createDataFrame([(1, "r1"), (1, "r2"), (2, "r1"), (2, "r2"), (3, "r2"), (None, "r1"), (1, None)], "item long, reader string")
    assert [(r.item, r.other, r.common, r.k) for r in K.together(t, spark.createDataFrame([(1,), (9,)], "item long")).orderBy("k").collect()] == [(1, 2, 2, 1), (1, 3, 1, 2)]


def test_progress(spark):
    c = P.chains(spark.createDataFrame([("s", 1, 10, 3), ("s", 1, 11, 9), ("s", 3, 12, 2), ("s", None, 13, 1), (None, 1, 14, 1), ("t", 2, 15, None)], "series string, part long, article long, difficulty int"))
    r = {x.series: x for x in P.chain_report(c).collect()}
    assert (r["s"].n_parts, r["s"].n_repeated, r["s"].missing, r["s"].progressive, r["s"].score) == (2, 1, "2", False, 85) and (r["t"].missing, r["t"].mean_difficulty, r["t"].progressive) == ("1", None, True)
    assert rows(P.chain_navigation(c)) == [("s", 10, 1, None, 12), ("s", 12, 2, 10, None), ("t", 15, 1, None, None)]
    e = spark.createDataFrame([(["a", "b"], "x", 1, None), (["a", "b"], "x", None, "a"), (["a"], None, None, "zz"), ([], "x", 5, None)], "m array<string>, a string, p int, r string")
    assert [r[0] for r in e.select(P.edited_chain(F.col("m"), F.col("a"), F.col("p"), F.col("r"))).collect()] == [["x", "a", "b"], ["b", "x"], ["a"], ["x"]]


def test_upkeep(spark):
    d = spark.createDataFrame([("a\nb\nb", "b\na\nc"), (None, "x"), ("", ""), ("q\r\nq", "q")], "x string, y string")
    assert [tuple(r[0]) for r in d.select(U.line_changes(F.col("x"), F.col("y"))).collect()] == [(1, 1, 2), (1, 0, 0), (0, 0, 0), (0, 1, 1)]
    v = spark.createDataFrame([([3, None, -1, 3, 0],), ([],), (None,)], "v array<int>")
    got = v.select(U.keep(F.col("v"), "positive").alias("p"), U.keep(F.col("v"), "unique").alias("u"), U.keep(F.col("v"), "less", 1).alias("l"), U.found_at(F.col("v"), F.lit(3)).alias("f")).collect()
    assert (got[0].p, got[0].u, got[0].l, got[0].f) == ([3, 3], [3, -1, 0], [-1, 0], 2) and (got[1].p, got[1].f) == ([], -1) and got[2].p is None
    s = spark.createDataFrame([("aab",), ("",), (None,)], "t string").select(U.character_stats(F.col("t")).alias("s")).select("s.*").collect()
    assert (s[0].n, s[0].distinct, round(s[0].entropy, 4)) == (3, 2, 0.9183) and s[1].ratio is None and s[2].n == 0
    p = spark.createDataFrame([("a, b\n1,2\n3\n",), ("a",), (None,)], "t string").select(U.parsed_lines(F.col("t")).alias("r")).collect()
    assert p[0].r == [{"a": "1", "b": "2"}, {"a": "3", "b": None}] and p[1].r == p[2].r == []
    k = spark.range(2000).select(U.drawn(F.col("id").cast("string"), 1, 1, 6).alias("d"), U.drawn_id(F.col("id").cast("string"), 1).alias("u"))
    assert {r.d for r in k.collect()} == set(range(1, 7)) and k.select("u").distinct().count() == 2000
