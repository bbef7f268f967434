"""Parent-child links to full hierarchies.

Every node gets its root, depth, number of descendants and a nested-set range, and nodes on or
below a loop are pointed out. The work is done in rounds whose number grows with the logarithm
of the depth: in each round every node's jump pointer doubles its reach, so a chain of a million
links takes twenty rounds, not a million.

1. upward: ``size(v)`` = nodes within 2^k steps below v; a round adds the sizes of the nodes
   whose jump lands on v. Nodes that still have a jump when a round ends none of them never
   will: they are on a loop or below one.
2. siblings - and the roots among themselves - get preorder offsets by prefix sums of the sizes,
   in hashed buckets per parent so that a parent with a third of all children is not one task;
3. downward: the offsets are summed along the way to the root. Node v's descendants are exactly
   the nodes with lo in (v.lo, v.hi);
4. from the ranges alone come the root (the last root that begins at or before lo), the depth
   (the ranges that begin before lo less those that have ended) and, on request, the path and all
   descendants (the ranges that hold lo). Since the ranges number all nodes without gaps, blocks
   of equal length hold equally many, however the trees are shaped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.session import cut, cut_counted
from stackroom.skew import HOT_SHARE, bucket_offsets

#: Hashed buckets per parent in the sibling prefix sums.
SIBLING_BUCKETS = 64
#: Nodes of a block in the sums over the preorder.
BLOCK = 4096
#: Lengths of the blocks into which a range is cut to be joined with what it holds.
STEPS = (1, 8, 64, 512, 4096)


def hop(state: DataFrame, n: int, *values: str) -> DataFrame:
    """For each row with a jump, the values (and the jump) of the row it lands on, as ``_<name>``.

    Jump targets with more than HOT_SHARE of the rows (at most 1/HOT_SHARE of them) are
    joined by broadcast, the others by shuffle.
    """
    live = state.where("j IS NOT NULL")
    right = state.select(F.col("id").alias("j"), F.col("j").alias("_j"), *[F.col(v).alias(f"_{v}") for v in values])
    if n < 1000 / HOT_SHARE:
        return live.join(right, "j")
    hot = live.groupBy("j").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n * HOT_SHARE).select("j")
    few = right.join(F.broadcast(hot), "j", "left_semi")
    marked = live.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "j", "left")
    return (
        marked.where("_hot").drop("_hot").join(F.broadcast(few), "j").unionByName(marked.where("_hot IS NULL").drop("_hot").join(right, "j"))
    )


def hierarchy(links: DataFrame, id_col: str = "id", parent_col: str = "parent", with_path: bool = False, off_loops: bool = False) -> DataFrame:
    """Full hierarchy of parent-child rows.

    links: one row per node, parent null for a root. Other columns are ignored. Repeated rows
    count once; of several parents of one id the smallest is taken; a null id is dropped; a
    parent that is no id counts as null. An empty table gives an empty result.

    Returns ``id, parent_id, root_id, depth, n_descendants, lo, hi, on_loop`` and, on request,
    ``path`` (ids from the root to the node). lo numbers the nodes of all trees in preorder. For
    a node on a loop or below one, root_id is the smallest id of that loop, depth is -1, on_loop
    tells which of both it is, and the other columns are null. With ``off_loops`` the nodes on loops
    are left out and each subtree that hangs off a loop is a tree of its own: the first node below
    the loop is its root. Runs jobs while the plan is built.
    """
    raw, n = cut_counted(
        links.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{parent_col}`").cast("long").alias("p"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("p").alias("p"))
    )
    # roots stay out of the join, a parent of many is joined by broadcast
    named = hop(raw.select("id", F.col("p").alias("j")), n)
    base = named.select("id", F.col("j").alias("parent")).join(raw.select("id"), "id", "right")
    size = lambda: F.lit(1).cast("long").alias("size")
    state, live = cut_counted(base.select("id", "parent", F.col("parent").alias("j"), size()), "j IS NOT NULL")
    while live:
        state, now = cut_counted(_grown(state, n), "j IS NOT NULL")
        if now == live:
            break
        live = now
    trees = state.where("j IS NULL")
    if live and off_loops:
        trees, live = trees.unionByName(_below_loops(state, n)), 0

    # a root is taken for a child of one node above all, -1 standing for it here only
    kids = trees.select("id", "parent", "size", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS * 64)).cast("int").alias("b"))
    kids = kids.withColumn("b", F.when(F.col("parent").isNotNull(), F.col("b") % SIBLING_BUCKETS).otherwise(F.col("b"))).withColumn("top", F.col("parent").isNull())
    kids = kids.withColumn("parent", F.coalesce("parent", F.lit(-1)))
    before = bucket_offsets(kids, ["top", "parent"], "b", F.col("size"))
    w = W.partitionBy("top", "parent", "b").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    placed = kids.withColumn("_in", F.coalesce(F.sum("size").over(w), F.lit(0))).join(before, ["top", "parent", "b"])
    lo = F.col("_in") + F.col("_before") + F.when(F.col("top"), 0).otherwise(1)
    parent = F.when(~F.col("top"), F.col("parent"))
    pos, left = cut_counted(placed.select("id", parent.alias("parent"), parent.alias("j"), "size", lo.alias("lo")), "j IS NOT NULL")
    while left:
        pos, left = cut_counted(_lowered(pos, n), "j IS NOT NULL")
    out = _from_ranges(pos.select("id", F.col("parent").alias("parent_id"), "size", "lo", (F.col("lo") + F.col("size")).alias("hi")))
    if with_path:
        out = cut(out)
        chain = F.sort_array(F.collect_list(F.struct("steps", "ancestor_id")), asc=False)
        above = descendants(out, out).groupBy(F.col("descendant_id").alias("id")).agg(F.transform(chain, lambda x: x["ancestor_id"]).alias("above"))
        out = out.join(above, "id", "left").withColumn("path", F.concat(F.coalesce("above", F.array().cast("array<bigint>")), F.array("id"))).drop("above")
    if not live:
        return out
    loops = _loops(state.where("j IS NOT NULL").select("id", "parent"), n)
    null = F.lit(None).cast("long")
    return out.unionByName(
        loops.select(
            "id", "parent_id", "root_id", F.lit(-1).alias("depth"), null.alias("n_descendants"), null.alias("lo"), null.alias("hi"), "on_loop",
            *([F.lit(None).cast("array<bigint>").alias("path")] if with_path else []),
        )
    )


def _grown(state: DataFrame, n: int) -> DataFrame:
    """One doubling upward: sizes of the nodes whose jump lands on a node are added, jumps reach twice as far."""
    inc = state.where("j IS NOT NULL").groupBy(F.col("j").alias("id")).agg(F.sum("size").alias("_inc"))
    moved = hop(state, n).select("id", "parent", F.col("_j").alias("j"), "size")
    return moved.unionByName(state.where("j IS NULL")).join(inc, "id", "left").withColumn("size", F.col("size") + F.coalesce("_inc", F.lit(0))).drop("_inc")


def _lowered(pos: DataFrame, n: int) -> DataFrame:
    """One doubling downward: the offset of the node a jump lands on is added."""
    moved = hop(pos, n, "lo").select("id", "parent", F.col("_j").alias("j"), "size", (F.col("lo") + F.col("_lo")).alias("lo"))
    return moved.unionByName(pos.where("j IS NULL"))


def _from_ranges(nodes: DataFrame) -> DataFrame:
    """Root and depth of every node from the ranges: sums over the preorder, block by block.

    The window within a block sees at most BLOCK nodes (and the ends of ranges there), the one
    over blocks a row per BLOCK nodes.
    """
    begins = nodes.select("lo", "id", "parent_id", "size", "hi", F.lit(0).alias("ends"), F.when(F.col("parent_id").isNull(), F.struct("lo", "id")).alias("root"))
    null = F.lit(None).cast("long")
    ends = nodes.groupBy(F.col("hi").alias("lo")).agg(F.count(F.lit(1)).cast("int").alias("ends"))
    events = begins.unionByName(ends.select("lo", null.alias("id"), null.alias("parent_id"), null.alias("size"), null.alias("hi"), "ends", F.lit(None).cast("struct<lo:bigint,id:bigint>").alias("root")))
    events = events.withColumn("block", F.floor(F.col("lo") / BLOCK))
    sums = events.groupBy("block").agg(F.sum("ends").alias("e"), F.max("root").alias("r"))
    over = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("block", F.coalesce(F.sum("e").over(over), F.lit(0)).alias("_e"), F.max("r").over(over).alias("_r"))
    # what ends at a place has ended for the node that begins there
    w = W.partitionBy("block").orderBy("lo", F.col("id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumn("ended", F.sum("ends").over(w)).withColumn("last", F.max("root").over(w)).where("id IS NOT NULL").join(before, "block")
    return seen.select(
        "id", "parent_id", F.coalesce("last.id", "_r.id").alias("root_id"), (F.col("lo") - F.col("ended") - F.col("_e")).cast("int").alias("depth"),
        (F.col("size") - 1).alias("n_descendants"), "lo", "hi", F.lit(False).alias("on_loop"),
    )


def _loops(rest: DataFrame, n: int) -> DataFrame:
    """Of nodes that all have a parent among themselves: the loop each of them leads into.

    The image of the 2^k-step map shrinks until it is the set of nodes on loops; the least id
    within 2^k steps, carried along, is then the loop's name once no loop node changes it.
    """
    s, size = cut_counted(rest.select("id", "parent", F.col("parent").alias("j"), F.col("id").alias("m")))
    while True:
        s = cut(hop(s, n, "m").select("id", "parent", F.col("_j").alias("j"), F.least("m", "_m").alias("m")))
        now = s.select("j").distinct().count()
        if now == size:
            break
        size = now
    ring = s.select(F.col("j").alias("id")).distinct().withColumn("on_loop", F.lit(True))
    s = cut(s.join(ring, "id", "left").withColumn("on_loop", F.coalesce("on_loop", F.lit(False))))
    while True:
        step = hop(s, n, "m").select("id", "parent", F.col("_j").alias("j"), F.least("m", "_m").alias("m"), "on_loop", (F.col("m") > F.col("_m")).alias("changed"))
        t, changed = cut_counted(step, "on_loop AND changed")
        s = t.drop("changed")
        if not changed:
            break
    return hop(s, n, "m").select("id", F.col("parent").alias("parent_id"), F.col("_m").alias("root_id"), "on_loop")


def _numbered(step: int):
    return lambda x: F.struct(F.lit(step).alias("step"), x.alias("block"))


def descendants(tree: DataFrame, of: DataFrame, id_col: str = "id") -> DataFrame:
    """All (ancestor, descendant, steps) pairs below the ids of ``of``: a range join on the nested sets.

    A range is cut into blocks of STEPS nodes at multiples of their length, as long as they fit; a
    node lies in one block of each length. So every pair meets in exactly one block, no other
    pair is met, and a block holds at most the longest step of nodes, however large its tree is.
    Rows of ``of`` that are no node or lead into a loop give nothing.
    """
    ok = tree.where("depth >= 0").select("id", "lo", "hi", "depth")
    a = of.select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct().join(ok, "id").where("hi - lo > 1")
    a = a.select(F.col("id").alias("ancestor_id"), (F.col("lo") + 1).alias("b"), "hi", F.col("depth").alias("_d"))
    up = lambda c, s: F.ceil(c / s).cast("long")
    down = lambda c, s: F.floor(c / s).cast("long")
    parts, outer = [], None
    for s in sorted(STEPS, reverse=True):
        first, last = up(F.col("b"), s), down(F.col("hi"), s)  # blocks [first, last) of this length fit
        between = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        if outer is None:
            blocks = between(first, last)
        else:
            # what the longer blocks leave at both ends, or all where no longer one fits
            lo, hi, t = outer
            blocks = F.when(lo < hi, F.concat(between(first, lo * (t // s)), between(hi * (t // s), last))).otherwise(between(first, last))
        parts.append(F.transform(blocks, _numbered(s)))
        outer = (first, last, s)
    a = a.select("ancestor_id", "_d", F.explode(F.concat(*parts)).alias("k")).select("ancestor_id", "_d", "k.step", "k.block")
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), down(F.col("lo"), s).alias("block")) for s in STEPS]))
    d = ok.where("depth > 0").select(F.col("id").alias("descendant_id"), "depth", at.alias("k")).select("descendant_id", "depth", "k.step", "k.block")
    return a.join(d, ["step", "block"]).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("_d")).alias("steps"))


def _below_loops(state: DataFrame, n: int) -> DataFrame:
    """The rows of the nodes below loops with whole sizes; those whose parent is on a loop become roots.

    A node's size is whole once its reach covers what hangs below it, so the rounds go on until the
    jump of every such node lands on a loop. Sizes of nodes on loops mean nothing and are left out.
    """
    ring = cut(_loops(state.where("j IS NOT NULL").select("id", "parent"), n).where("on_loop").select("id"))
    off = lambda s: s.where("j IS NOT NULL").join(ring, "id", "left_anti")
    while off(state).join(ring.select(F.col("id").alias("j")), "j", "left_anti").limit(1).count():
        state = cut(_grown(state, n))
    first = ring.select(F.col("id").alias("parent"), F.lit(True).alias("_first"))
    return off(state).join(first, "parent", "left").select("id", F.when(F.col("_first").isNull(), F.col("parent")).alias("parent"), "j", "size")
