"""All similar pairs between set-valued records: pigeonhole partitioning.

Two sets of sizes s <= l whose Jaccard similarity reaches t differ in at most
H = s + l - 2 ceil(t (s + l) / (1 + t)) tokens. The token universe is split by hash into
H // 2 + 1 segments; in one of them the two sets differ in at most one token. So the smaller
set is indexed and the larger one probes, for each pair of sizes, by segment contents and by
contents with one token deleted. Signature rows carry no sets but a 64-bit sketch of them, whose
differing bits bound the difference from below; the pairs that are left are verified on the
sets. No pair is lost and no token is left out however frequent it is. A signature of many sets
is cut into blocks, so that no task meets all of its pairs.

A segment that one set leaves empty says nothing; the sets in that case are split once more,
by another hash, so that empty signatures gather no group of their own. Exact copies are
joined as one set first.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.session import materialize
from stackroom.skew import lookup

#: Sets of one signature that a task holds against the probing ones; more are cut into blocks of this size.
BLOCK = 4096
#: Times that a set with an empty segment is split anew before the empty signature is used as it is.
RESPLITS = 3


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def max_difference(s: int, l: int, t: Fraction) -> int:
    """Most tokens in which sets of these sizes may differ, or -1 if no such pair is similar."""
    need = -(-(t * (s + l)) // (1 + t))
    return -1 if need > s else int(s + l - 2 * need)


def schemes(size: int, t: Fraction, probe: bool) -> list[tuple[int, int, int]]:
    """(s, l, H) in which a set of this size takes part, as the larger (probe) or the smaller one."""
    out = []
    other = size
    while other > 0 and (h := max_difference(min(size, other), max(size, other), t)) >= 0:
        if h > 0:
            out.append((min(size, other), max(size, other), h))
        other += -1 if probe else 1
    return out


def _signatures(tok: np.ndarray, m: int, tag: int, probe: bool, both: bool, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the segments of the rows of a token matrix, for one side of the join.

    Two kinds of keys: in the first the index side gives whole segments, the probing side whole
    ones and those with a token deleted; in the second (``both``) the index side gives the
    deleted ones and the probing side whole ones. So a match has the odd token on either side.
    """
    n, s = tok.shape
    seg = (_mix(tok, 1000 + depth) % np.uint64(m)).astype(np.int64) if m > 1 else np.zeros((n, s), np.int64)
    val = _mix(tok, 7)
    again = np.zeros(n, bool)
    for k in range(m):
        inside = seg == k
        count = inside.sum(axis=1)
        total = np.where(inside, val, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        for kind in (0, 1)[: 1 + both]:
            full, deleted = (kind == 0 or probe), (kind == 1 and not probe or kind == 0 and probe)
            name = _mix(np.array([tag * 1024 + k * 2 + kind & (2**64 - 1)], np.uint64), 11)[0]
            hollow = np.zeros(n, bool)
            if full:
                ok = count > 0
                yield np.flatnonzero(ok), _mix(total[ok] ^ name, 3)
                hollow |= ~ok
            if deleted:
                r, c = np.nonzero(inside & (count > 1)[:, None])
                with np.errstate(over="ignore"):
                    yield r, _mix((total[r] - val[r, c]) ^ name, 3)
                hollow |= count == 1
            if m == 1 or depth == RESPLITS:
                at = np.flatnonzero(hollow)
                if len(at):
                    yield at, np.full(len(at), _mix(np.array([name], np.uint64), 5)[0])
            else:
                again |= hollow
    at = np.flatnonzero(again)
    if len(at):
        # one new split of the whole set serves all of its hollow segments: it loses no pair by itself
        name = _mix(np.array([tag * 1024 + 1023], np.uint64), 11)[0]
        for r, key in _signatures(tok[at], m, int(name >> np.uint64(12)), probe, True, depth + 1):
            yield at[r], key


def _emit(t: Fraction, probe: bool):
    """Signature rows of one side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["tokens"].str.len().to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                tok = np.stack(b["tokens"].iloc[at].to_numpy()).astype(np.int64)
                ids = b["id"].to_numpy()[at]
                sketch = np.bitwise_or.reduce(np.uint64(1) << (_mix(tok, 5) & np.uint64(63)), axis=1).astype(np.int64)
                for s, l, h in schemes(int(size), t, probe):
                    m = h // 2 + 1
                    # of equal sizes each set plays both sides, and one segment of all tokens has its odd one in the larger set
                    parts = list(_signatures(tok, m, s * 1_000_003 + l, probe, s < l and m > 1))
                    r = np.concatenate([p[0] for p in parts])
                    key = np.concatenate([p[1] for p in parts]).astype(np.int64)
                    if len(r):
                        yield pd.DataFrame({"key": key, "id": ids[r], "n": np.full(len(r), size, np.int32), "sketch": sketch[r]})

    return run


def distinct_sets(sets: DataFrame, id_col: str, items: str, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """(representatives: rep, items, n; members: id, rep). Equal sets share the smallest id as rep.

    Items must be sorted distinct arrays. Null ids and sets below min_size are left out.
    """
    s = sets.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{items}`").alias("items")).where(F.col("id").isNotNull() & (F.size("items") >= min_size))
    s = s.withColumn("h", F.struct(F.xxhash64("items").alias("a"), F.xxhash64(F.lit("second"), "items").alias("b")))
    s = materialize(s, "sets")
    reps = s.groupBy("h").agg(F.min("id").alias("rep"), F.first("items").alias("items"), F.countDistinct("id").alias("n"))
    reps = materialize(reps, "distinct-sets")
    return reps.select("rep", "items", "n"), lookup(s.select("id", "h").distinct(), reps.select("h", "rep"), "h", "inner").select("id", "rep")


def similar_sets(reps: DataFrame, threshold: float | str = "0.8") -> DataFrame:
    """Pairs (rep_a < rep_b, overlap, jaccard) of different sets with Jaccard >= threshold.

    reps: rep, items (sorted distinct arrays, each set once). Exact: candidates come from the
    pigeonhole signatures, whose sides are joined by key, and are compared item by item.
    """
    t = Fraction(str(threshold))
    coded = reps.select(F.col("rep").alias("id"), F.transform("items", lambda x: F.xxhash64(x)).alias("tokens"))
    schema = "key long, id long, n int, sketch long"
    index, probe = materialize(coded.mapInPandas(_emit(t, False), schema), "signatures"), coded.mapInPandas(_emit(t, True), schema)
    big = index.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK).select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    if not (big := materialize(big, "hot-signatures")).isEmpty():
        # each indexed set lies in one block of its signature, each probing one meets all blocks
        index = index.join(big, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
        probe = probe.join(big, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block"))
    else:
        on = F.col("x.key") == F.col("y.key")
    apart = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) * (t.denominator + t.numerator)
    may = apart <= (F.col("x.n") + F.col("y.n")) * (t.denominator - t.numerator)
    j = index.alias("y").join(probe.alias("x"), on & (F.col("x.id") != F.col("y.id")) & may)
    pairs = j.select(F.least("x.id", "y.id").alias("rep_a"), F.greatest("x.id", "y.id").alias("rep_b")).distinct()
    a, b = (reps.select(F.col("rep").alias(f"rep_{s}"), F.col("items").alias(f"items_{s}")) for s in "ab")
    out = pairs.join(a, "rep_a").join(b, "rep_b").withColumn("overlap", F.size(F.array_intersect("items_a", "items_b")))
    union = F.size("items_a") + F.size("items_b") - F.col("overlap")
    return out.where(F.col("overlap") * t.denominator >= union * t.numerator).select("rep_a", "rep_b", "overlap", (F.col("overlap") / union).alias("jaccard"))


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All id pairs (id_a < id_b): of similar sets and within each group of equal sets."""
    a, b = members.select(F.col("id").alias("ia"), F.col("rep").alias("rep_a")), members.select(F.col("id").alias("ib"), F.col("rep").alias("rep_b"))
    across = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b")
    within = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("ia") < F.col("ib")))
    both = across.select("ia", "ib").unionByName(within.select("ia", "ib"))
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def links(pairs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: its class of equal sets and the number of other records similar to it.

    Counts come from class sizes, copies are not expanded into pairs.
    """
    n = reps.select("rep", "n")
    both = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("o")).unionByName(pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("o")))
    out = both.join(n.select(F.col("rep").alias("o"), F.col("n").alias("m")), "o").groupBy("rep").agg(F.sum("m").alias("others"))
    per = n.join(out, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return lookup(members, per, "rep", "inner").select("id", F.col("rep").alias("class_id"), "n_links")
