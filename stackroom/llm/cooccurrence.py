"""Items that appear together: blocked Gram matrix of the binary record-by-item matrix.

The Gram matrix X'X of the sparse record-by-item matrix is summed over record blocks: every
Arrow batch is one block, its transpose product is formed sparsely (rows with many items
densely, in item blocks), each task keeps one accumulator, and only (item, item, count) sums
are shuffled. Items too rare for any reported pair are left out beforehand; that is exact,
since a pair is no more frequent than either of its items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.session import materialize
from stackroom.skew import bucket_offsets, lookup

#: With at most this many frequent items their index is broadcast; more are joined by shuffle.
DENSE_ITEMS = 200_000
#: Rows with more frequent items than this take the dense product, in blocks of ITEM_BLOCK columns.
HEAVY, ITEM_BLOCK = 256, 1024
#: Entries an accumulator holds before it is handed on.
FLUSH = 2_000_000

BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def item_set(tags: Column) -> Column:
    """Set of tags: lower case, outer blanks removed, null and empty dropped, sorted. Null gives an empty set."""
    clean = F.transform(tags, lambda t: F.regexp_replace(F.lower(t), rf"^{BLANK}+|{BLANK}+$", ""))
    return F.coalesce(F.sort_array(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))), F.array().cast("array<string>"))


def _heavy_gram(rows: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse entries of X'X for a few long rows, from dense item blocks."""
    cols = np.unique(np.concatenate(rows))
    at = [np.searchsorted(cols, ids) for ids in rows]

    def block(a: int) -> np.ndarray:
        """The rows' entries in one block of items: as many floats as rows times ITEM_BLOCK, however many items there are."""
        x = np.zeros((len(rows), min(ITEM_BLOCK, len(cols) - a)), np.float32)
        for r, ids in enumerate(at):
            x[r, ids[np.searchsorted(ids, a) : np.searchsorted(ids, a + ITEM_BLOCK)] - a] = 1
        return x

    keys, counts = [], []
    for a in range(0, len(cols), ITEM_BLOCK):
        left = block(a)
        for b in range(a, len(cols), ITEM_BLOCK):
            g = left.T @ (left if a == b else block(b))
            i, j = np.nonzero(g)
            keep = i + a < j + b
            i, j = i[keep], j[keep]
            keys.append(cols[i + a] * m + cols[j + b])
            counts.append(g[i, j].astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def _block_gram(flat: np.ndarray, lens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangle of X'X of one record block as (i * m + j, count); rows are sorted item ids."""
    start = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    keys, counts = [], []
    heavy = np.flatnonzero(lens > HEAVY)
    for h in range(0, len(heavy), 512):
        k, c = _heavy_gram([flat[start[r] : start[r] + lens[r]] for r in heavy[h : h + 512]], m)
        keys.append(k), counts.append(c)
    # entry number e of a row meets the later ones: by distance d, all rows at once
    pos = np.arange(len(flat)) - np.repeat(start, lens)
    left = np.repeat(lens, lens) - pos
    light = np.repeat(lens <= HEAVY, lens)
    d = 1
    at = np.flatnonzero(light & (left > d))
    part = []
    while len(at):
        part.append(flat[at] * m + flat[at + d])
        d += 1
        at = at[left[at] > d]
        if sum(map(len, part)) > FLUSH:
            k, c = np.unique(np.concatenate(part), return_counts=True)
            keys.append(k), counts.append(c)
            part = []
    if part:
        k, c = np.unique(np.concatenate(part), return_counts=True)
        keys.append(k), counts.append(c)
    return _merge(keys, counts)


def _merge(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inv, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def _gram(m: int, index: dict | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = index.value.get if index is not None else None
        keys, counts, held = [], [], 0

        def flush() -> pd.DataFrame:
            k, c = _merge(keys, counts)
            keys.clear(), counts.clear()
            return pd.DataFrame({"i": k // m, "j": k % m, "n": c})

        for b in batches:
            if get:
                rows = [sorted({x for x in map(get, r) if x is not None}) for r in b["items"]]
            else:
                rows = [sorted(set(r)) for r in b["items"]]
            lens = np.array([len(r) for r in rows], np.int64)
            flat = np.fromiter((x for r in rows for x in r), np.int64, int(lens.sum()))
            k, c = _block_gram(flat, lens, m)
            keys.append(k), counts.append(c)
            held += len(k)
            if held > FLUSH:
                k, c = _merge(keys, counts)
                keys[:], counts[:], held = [k], [c], len(k)
                if held > FLUSH // 2:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    return run


def _ranked(freq: DataFrame, buckets: int = 4096) -> DataFrame:
    """id, item, n: any numbering of the items from 0 without gaps, by hashed buckets and their offsets."""
    b = freq.withColumn("b", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    # the window over all buckets sees ``buckets`` rows
    before = bucket_offsets(b.withColumn("_g", F.lit(0)), ["_g"], "b", F.lit(1)).select("b", "_before")
    own = F.row_number().over(W.partitionBy("b").orderBy("item"))
    return b.withColumn("r", own).join(F.broadcast(before), "b").select((F.col("_before") + F.col("r") - 1).cast("long").alias("id"), "item", "n")


def cooccurrence(baskets: DataFrame, items: str, min_count: int = 5, per: int | None = 2000, min_lift: float | None = 3) -> DataFrame:
    """Pairs of items that occur together, with their lift over chance.

    baskets: one row per record with an array of items (a set; repeats count once, null items
    and empty records are ignored). Reported are pairs in at least ``min_count`` records and, with
    ``per``, at least N / per of them, whose lift n(a,b) N / (n(a) n(b)) is at least ``min_lift``.
    Returns ``item_a, item_b, n_ab, n_a, n_b, n, lift`` with item_a < item_b by code points.

    With ``per`` set, at most per * (mean set size) items are frequent, whatever the number of
    records: that bounds the index broadcast to the tasks.
    """
    spark = baskets.sparkSession
    sets = baskets.select(F.array_distinct(F.filter(F.col(f"`{items}`"), lambda x: x.isNotNull())).alias("items")).where(F.size("items") > 0)
    sets = materialize(sets, "baskets")  # counted, ranked and multiplied
    total = sets.count()
    least = max(min_count, -(-total // per) if per else 0)
    freq = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    few = freq.limit(DENSE_ITEMS + 1).collect()
    if len(few) <= DENSE_ITEMS:
        names = sorted(r["item"] for r in few)
        marg = {r["item"]: r["n"] for r in few}
        vocab = spark.createDataFrame([(i, x, marg[x]) for i, x in enumerate(names)], "id long, item string, n long")
        index = spark.sparkContext.broadcast({x: i for i, x in enumerate(names)})
        gram = sets.mapInPandas(_gram(max(1, len(names)), index), "i long, j long, n long")
        named = lambda s: F.broadcast(vocab.select(F.col("id").alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}")))
    else:
        # too many for a broadcast index: ids by hashed buckets, joined by shuffle
        ranged = materialize(freq.orderBy("item"), "items")
        n_items = ranged.count()
        vocab = materialize(_ranked(ranged), "vocab")
        rows = sets.withColumn("k", F.monotonically_increasing_id()).select("k", F.explode("items").alias("item"))
        coded = lookup(rows, vocab.select("item", "id"), "item", "inner").groupBy("k").agg(F.collect_list("id").alias("items"))
        gram = coded.select("items").mapInPandas(_gram(n_items, None), "i long, j long, n long")
        named = lambda s: vocab.select(F.col("id").alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = gram.groupBy("i", "j").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    out = pairs.select(F.col("i").alias("a"), F.col("j").alias("b"), "n_ab").join(named("a"), "a").join(named("b"), "b")
    out = out.withColumn("n", F.lit(total)).withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")))
    if min_lift is not None:
        out = out.where(F.col("n_ab") * F.col("n") >= F.col("n_a") * F.col("n_b") * F.lit(min_lift))
    turned = F.col("item_a") > F.col("item_b")  # ids that are no ranks
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return out.select(swap("item_a", "item_b"), swap("item_b", "item_a"), "n_ab", swap("n_a", "n_b"), swap("n_b", "n_a"), "n", "lift")
