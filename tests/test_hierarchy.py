import random

from stackroom.operators import hierarchy as H
from stackroom.operators import thesaurus as T
from tests.conftest import rows


def brute(par):
    out = {}
    for x in par:
        seen = [x]
        while True:
            p = par[seen[-1]]
            if p is None or p not in par:
                out[x] = (seen[-1], len(seen) - 1)
                break
            if p in seen:
                out[x] = (min(seen[seen.index(p) :]), -1)
                break
            seen.append(p)
    return out


def below(par, x):
    out, todo = set(), [x]
    while todo:
        y = todo.pop()
        for k, p in par.items():
            if p == y and k not in out:
                out.add(k), todo.append(k)
    return out


def check(spark, par):
    df = spark.createDataFrame([(k, v, "x") for k, v in par.items()], "id long, parent long, lo string")
    got = {r.id: r for r in H.hierarchy(df, with_path=True).collect()}
    want = brute(par)
    assert {k: (r.root_id, r.depth) for k, r in got.items()} == want
    for k, r in got.items():
        if r.depth >= 0:
            assert r.path[0] == r.root_id and r.path[-1] == k and len(r.path) == r.depth + 1
            assert r.n_descendants == len(below(par, k)) == r.hi - r.lo - 1
            inside = {j for j, s in got.items() if s.root_id == r.root_id and s.depth >= 0 and r.lo < s.lo < r.hi}
            assert inside == below(par, k)
        else:
            assert r.on_loop == (k in loop_of(par, k)) and r.lo is None


def loop_of(par, x):
    seen = [x]
    while par[seen[-1]] not in seen:
        seen.append(par[seen[-1]])
    return seen[seen.index(par[seen[-1]]) :]


def test_random_forest_with_loops(spark):
    r = random.Random(4)
    par = {i: (None if r.random() < 0.1 else r.randrange(120)) for i in range(120)}
    par[7], par[500], par[501] = 7, 501, 9999  # a loop of one; a parent that is no node
    check(spark, par)


def test_deep_chain_and_hot_parent(spark):
    par = {i: (i - 1 if i else None) for i in range(150)} | {1000 + i: 3 for i in range(300)}
    check(spark, par)


def test_long_loop_with_tail(spark):
    par = {i: (i + 1) % 23 for i in range(23)} | {100 + i: (99 + i if i else 5) for i in range(30)}
    check(spark, par)


def test_empty_null_and_repeated(spark):
    assert rows(H.hierarchy(spark.createDataFrame([], "id long, parent long"))) == []
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (2, 1), (2, 1)], "id long, parent long")
    assert [(r.id, r.root_id, r.depth) for r in H.hierarchy(df).orderBy("id").collect()] == [(1, 1, 0), (2, 1, 1)]


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 5)], "id long, parent long")
    t = H.hierarchy(df)
    of = spark.createDataFrame([(1,), (2,), (5,), (77,)], "id long")
    assert rows(H.descendants(t, of)) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]


def test_all_descendants_with_subtrees_below_loops(spark):
    r = random.Random(9)
    par = {i: (None if r.random() < 0.1 else r.randrange(80)) for i in range(80)} | {200: 201, 201: 200, 202: 201, 203: 202, 204: 203, 205: 202} | {300 + i: (299 + i if i else 201) for i in range(20)}
    df = spark.createDataFrame(list(par.items()), "id long, parent long")
    t = H.hierarchy(df, with_path=True, off_loops=True)
    looped = {x for x in par if brute(par)[x][1] < 0 and x in loop_of(par, x)}
    want = {(a, x) for a in par if a not in looped for x in below(par, a)}
    got = rows(H.descendants(t, t))
    assert {(a, x) for a, x, _ in got} == want and len(got) == len(want)
    assert {(202, 203, 1), (202, 204, 2), (202, 205, 1), (203, 204, 1)} <= set(got) and not {200, 201} & {a for a, *_ in got}


def test_all_descendants_query(spark, tmp_path):
    from stackroom.plans import general

    names = {1: [], 2: ["t1"], 3: ["t2"], 4: ["t5"], 5: ["t4"], 6: ["t5"], 7: ["t6"]}  # 4 and 5 are a loop
    df = spark.createDataFrame([(i, f"t{i}", b) for i, b in names.items()], "term_id long, term string, broader array<string>")
    df.selectExpr("*", "CAST(NULL AS string) AS canonical", "CAST(NULL AS array<string>) AS synonyms", "'mined' AS origin", "TIMESTAMP '2025-01-01' AS exported_at").write.parquet(f"{tmp_path}/thesaurus.parquet")
    assert rows(general.QUERIES["p1_all_descendants"](spark, str(tmp_path))) == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (6, 7, 1)]


def test_names(spark):
    s = "term_id long, term string, canonical string, synonyms array<string>, broader array<string>, origin string, exported_at timestamp"
    from datetime import datetime

    t1, t2 = datetime(2025, 1, 1), datetime(2025, 2, 1)
    df = spark.createDataFrame(
        [(1, "Big-Tree", "big tree", ["old  name"], None, "curated", t1), (2, "leaf", "Leaf", None, ["unknown", None, "", " BIG_tree "], "mined", t2), (2, "leaf", "Leaf", None, ["none"], "mined", t1),
         (3, "twig", None, [], ["Old-Name", "leaf"], "mined", t1), (4, None, None, None, [], None, None)], s)
    assert rows(T.term_parents(df).na.fill(-1)) == [(1, -1), (2, 1), (3, 1), (4, -1)]
