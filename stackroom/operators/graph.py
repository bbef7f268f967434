"""Graph analytics over an edge table (src, dst) and a node table (id).

Iterations are joins and map-side combined aggregations; lineage is cut through the shared
folder every few rounds. Nothing is collected but counters. Self-loops and repeated edges are
dropped by ``simple``; operators that count multiplicity say so.
"""

from __future__ import annotations

from itertools import count

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.operators.hierarchy import hop
from stackroom.session import cut
from stackroom.skew import pairs_within

#: Rounds between cuts of the lineage.
CUT_EVERY = 5


def simple(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    e = simple(edges)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every node, isolated ones with zeros."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy("x.id").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.join(d, "id", "left").select("id", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("degree"))


def properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density of a directed graph."""
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    dens = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    return n.join(F.broadcast(m), F.lit(True)).select("n_nodes", "n_edges", dens.alias("density"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, seeds: DataFrame | None = None, keep_dangling: bool = False) -> DataFrame:
    """(id, rank) after a fixed number of rounds; a dangling node's mass is dropped unless kept.

    With seeds, the walk restarts there alone and starts there. A rank without links in is the
    restart share. ``keep_dangling`` spreads the dangling mass evenly, so that ranks add up to 1.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    if seeds is not None:
        k = seeds.distinct().count()
        base = nodes.join(seeds.select("id").distinct().withColumn("_s", F.lit(1.0 / max(k, 1))), "id", "left").select("id", F.coalesce("_s", F.lit(0.0)).alias("t"))
    else:
        base = nodes.select("id", F.lit(1.0 / n).alias("t"))
    base = cut(base)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    e = cut(edges.join(out, "src").select("src", "dst", "o"))
    r = base.select("id", F.col("t").alias("rank"))
    for i in range(rounds):
        flow = e.join(r, e.src == r.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("o")).alias("f"))
        new = base.join(flow, "id", "left").select("id", (F.lit(1 - damping) * F.col("t") + damping * F.coalesce("f", F.lit(0.0))).alias("rank"))
        if keep_dangling:
            lost = new.agg((1 - F.sum("rank")).alias("lost"))
            new = new.join(F.broadcast(lost), F.lit(True)).select("id", (F.col("rank") + F.col("lost") / n).alias("rank"))
        r = cut(new) if (i + 1) % CUT_EVERY == 0 else new
    return r


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, hub, authority), L2-normalised each round; hubs use the round's old authorities."""
    s = nodes.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"))
    e = cut(edges.select("src", "dst"))
    for i in range(rounds):
        a = e.join(s, e.src == s.id).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        h = e.join(s, e.dst == s.id).groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("h"))
        raw = nodes.join(a, "id", "left").join(h, "id", "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a"))
        raw = cut(raw) if (i + 1) % 2 == 0 else raw
        norm = raw.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("nh"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"))
        by = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
        s = raw.join(F.broadcast(norm), F.lit(True)).select("id", by("h", "nh").alias("hub"), by("a", "na").alias("authority"))
        s = cut(s) if (i + 1) % 2 == 0 else s
    return s


def katz(nodes: DataFrame, edges: DataFrame, rounds: int = 10, alpha: float = 0.1, beta: float = 1.0) -> DataFrame:
    """(id, katz): x = alpha A'x + beta, a fixed number of rounds."""
    e = cut(edges.select("src", "dst"))
    x = nodes.select("id", F.lit(0.0).alias("katz"))
    for i in range(rounds):
        f = e.join(x, e.src == x.id).groupBy(F.col("dst").alias("id")).agg(F.sum("katz").alias("f"))
        x = nodes.join(f, "id", "left").select("id", (alpha * F.coalesce("f", F.lit(0.0)) + beta).alias("katz"))
        x = cut(x) if (i + 1) % CUT_EVERY == 0 else x
    return x


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, eigenvector): x = (A + I) x on the undirected graph, L2-normalised, a fixed number of rounds; A + I never swings."""
    u = cut(undirected(edges))
    x = cut(nodes.select("id", F.lit(1.0).alias("x")))
    for r in range(rounds):
        got = u.join(x.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("v"))
        y = x.join(got, "id", "left").select("id", (F.col("x") + F.coalesce("v", F.lit(0.0))).alias("y"))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("l"))
        x = y.join(F.broadcast(norm)).select("id", (F.col("y") / F.col("l")).alias("x"))
        if r % 2 == 1 or r == rounds - 1:
            x = cut(x)
    return x.select("id", F.col("x").alias("eigenvector"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least id of the weakly connected component, in a logarithmic number of rounds.

    A round takes the least label among the neighbours, hands it to the node that the own label
    names (hooking), and replaces every label by its label (jumping); so a long path does not
    take a round per step. Labels of giant components are hot keys and are joined by broadcast.
    """
    e = cut(undirected(edges))
    lab = cut(nodes.select("id", F.col("id").alias("component")))
    n = lab.count()
    while True:
        near = e.join(lab, e.dst == lab.id).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        low = cut(lab.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component")))
        hook = low.where("component < old").groupBy(F.col("old").alias("id")).agg(F.min("component").alias("h"))
        j = cut(low.join(hook, "id", "left").select("id", "old", F.least("component", F.coalesce("h", "component")).alias("j")))
        new = cut(hop(j, n).select("id", "old", F.least("j", "_j").alias("component")))
        changed = new.where("component < old").limit(1).count()
        lab = new.select("id", "component")
        if not changed:
            return lab


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): each undirected triangle once per corner; edges point from the lower degree.

    Orientation by degree bounds the paths that are listed by m^1.5 even with hot nodes.
    """
    u = undirected(edges)
    d = u.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    both = u.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    o = cut(both.where(F.struct("d", "src") < F.struct("dd", "dst")).select("src", "dst"))
    a, b = o.select(F.col("src").alias("x"), F.col("dst").alias("y")), o.select(F.col("src").alias("x"), F.col("dst").alias("z"))
    open_ = a.join(b, "x").where("y < z")
    e = u.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    t = open_.join(e, ["y", "z"])
    return t.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) on the undirected graph; 0 below two neighbours."""
    d = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    x = nodes.join(d, "id", "left").join(triangles(edges), "id", "left").na.fill(0, ["degree", "triangles"])
    return x.withColumn("clustering", F.when(F.col("degree") > 1, F.col("triangles") * 2 / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def mutual(edges: DataFrame) -> DataFrame:
    """(a < b) linked both ways."""
    e = simple(edges)
    p = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")


def _paired(edges: DataFrame, key: str, other: str, least: int, of: DataFrame | None) -> DataFrame:
    e = simple(edges).select(F.col(key).alias("k"), F.col(other).alias("o"))
    if of is None:
        j = pairs_within(e, "k", "o")
    else:
        left = e.join(of.select(F.col("id").alias("o")).distinct(), "o", "left_semi")
        j = left.select("k", F.col("o").alias("a")).join(e.select("k", F.col("o").alias("b")), "k").where("a <> b")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def cocitation(edges: DataFrame, least: int = 2, of: DataFrame | None = None) -> DataFrame:
    """(a, b, n): targets that n sources cite together; with ``of`` only for those targets."""
    return _paired(edges, "src", "dst", least, of)


def coupling(edges: DataFrame, least: int = 2, of: DataFrame | None = None) -> DataFrame:
    """(a, b, n): sources that share n targets; with ``of`` only for those sources."""
    return _paired(edges, "dst", "src", least, of)


def h_index(edges: DataFrame) -> DataFrame:
    """(id, h, i10, n_citing): over the in-degrees of the citing nodes.

    Counted from how many citing nodes have each in-degree, so that a node with a third of all
    links is no group to be sorted.
    """
    from pyspark.sql import Window as W

    e = simple(edges)
    ind = e.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("c"))
    c = e.join(ind, "src", "left").select(F.col("dst").alias("id"), F.coalesce("c", F.lit(0)).alias("c"))
    g = c.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"))
    more = g.withColumn("upto", F.sum("n").over(W.partitionBy("id").orderBy(F.desc("c"))))
    return more.groupBy("id").agg(F.max(F.least("c", "upto")).alias("h"), F.coalesce(F.sum(F.when(F.col("c") >= 10, F.col("n"))), F.lit(0)).alias("i10"), F.sum("n").alias("n_citing"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): synchronous rounds, the most frequent label among neighbours, least on ties."""
    e = cut(undirected(edges))
    lab = nodes.select("id", F.col("id").alias("label"))
    for i in range(rounds):
        votes = e.join(lab, e.dst == lab.id).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        # greatest count, then least label: an extreme, not a sorted group
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("b"))
        lab = nodes.join(best, "id", "left").select("id", F.coalesce("b.label", "id").alias("label"))
        lab = cut(lab) if (i + 1) % 2 == 0 else lab
    return lab


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a partition of the undirected graph."""
    e = undirected(edges)
    l = labels.select("id", "label")
    x = e.join(l.withColumnRenamed("id", "src").withColumnRenamed("label", "a"), "src").join(l.withColumnRenamed("id", "dst").withColumnRenamed("label", "b"), "dst")
    m2 = e.agg(F.count(F.lit(1)).alias("m2"))
    per = x.groupBy("a").agg(F.sum((F.col("a") == F.col("b")).cast("int")).alias("inside"), F.count(F.lit(1)).alias("ends"))
    q = F.col("inside") / F.col("m2") - F.pow(F.col("ends") / F.col("m2"), 2)
    return per.join(F.broadcast(m2), F.lit(True)).agg(F.sum(q).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, id, distance) for nodes within ``most`` directed steps of each source; without it for all it reaches."""
    e = cut(simple(edges))
    seen = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct())
    front = seen
    for d in count(1) if most is None else range(1, most + 1):
        step = front.join(e, front.id == e.src).select("source", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front)) if d % CUT_EVERY == 0 else seen.unionByName(front)
    return seen


def closeness(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(id, reach, closeness, harmonic) of the sources over distances up to ``most``, without it over all."""
    d = distances(edges, sources, most).where("distance > 0")
    return d.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("reach"), (F.count(F.lit(1)) / F.sum("distance")).alias("closeness"), F.sum(1 / F.col("distance")).alias("harmonic"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): longest chain of predecessors; -1 for nodes on a cycle or behind one."""
    e = cut(simple(edges))
    left = cut(nodes.select("id"))
    done, level = None, 0
    while True:
        has = e.select(F.col("dst").alias("id")).distinct()
        free = cut(left.join(has, "id", "left_anti").withColumn("level", F.lit(level)))
        done = free if done is None else done.unionByName(free)
        if not free.limit(1).count():
            break
        left = cut(left.join(free, "id", "left_anti"))
        e = cut(e.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return done.unionByName(left.withColumn("level", F.lit(-1)))


def affected(edges: DataFrame, changed: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes that depend on changed ones, directly or not: (id, steps). Edges point from dependent to dependency."""
    back = simple(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    d = distances(back, changed, most).where("distance > 0")
    return d.groupBy("id").agg(F.min("distance").alias("steps"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(id, betweenness): Brandes' accumulation from the given sources on the directed graph.

    Forward rounds count shortest paths level by level for all sources at once, backward rounds
    share the dependencies out; state is one row per (source, node reached). Without ``most``
    the rounds end where nothing new is reached; with all nodes as sources it is the centrality.
    """
    e = cut(simple(edges))
    seen = cut(sources.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")).distinct())
    front, last = seen, 0
    for d in range(1, most + 1) if most else count(1):
        step = front.join(e, front.id == e.src).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(d).alias("d"), "sigma"))
        if not front.limit(1).count():
            break
        seen, last = cut(seen.unionByName(front)), d
    delta = seen.where(F.col("d") == last).select("s", "id", "d", "sigma", F.lit(0.0).alias("delta"))
    total = delta
    for d in range(last, 0, -1):
        upper = seen.where(F.col("d") == d - 1)
        share = delta.select("s", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("x")).join(e, "dst").groupBy("s", F.col("src").alias("id")).agg(F.sum("x").alias("x"))
        delta = cut(upper.join(share, ["s", "id"], "left").select("s", "id", "d", "sigma", (F.col("sigma") * F.coalesce("x", F.lit(0.0))).alias("delta")))
        total = total.unionByName(delta)
    per = total.where("id <> s").groupBy("id").agg(F.sum("delta").alias("betweenness"))
    return nodes.join(per, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def dot(edges: DataFrame) -> Column:
    return edges.select(F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("line"))
