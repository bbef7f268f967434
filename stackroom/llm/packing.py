"""Filling fixed-capacity containers with items: pattern packing.

Only the histogram of lengths decides how to pack, and it has at most as many bins as the
capacity. Patterns of a few lengths that fill a container are enumerated, their repeat counts
fitted to the histogram by non-negative least squares and rounded down, and the rest is packed
by best fit, again by counts. The plan says which places of which containers the items of each
length take by their rank among the items of that length; ranks are counted in hashed buckets,
so a length that a third of all items have is no single task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.session import materialize
from stackroom.skew import bucket_offsets

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Split pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) under a public tokenizer; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL")
    return d.mapInPandas(run, "doc_id long, n_tokens long")


def patterns(lengths: np.ndarray, capacity: int, choices: int = 16, most: int = 6) -> list[tuple[int, ...]]:
    """Patterns of at most ``most`` lengths that fill a container as far as the lengths allow."""
    have = np.sort(lengths)
    out = set()

    def largest(room: int) -> int:
        i = np.searchsorted(have, room, side="right") - 1
        return int(have[i]) if i >= 0 else 0

    for a in have[::-1].tolist():
        room = capacity - a
        fits = have[: np.searchsorted(have, room, side="right")]
        some = np.unique(np.concatenate([fits[-4:], fits[np.linspace(0, len(fits) - 1, choices).astype(int)]])) if len(fits) else []
        out.add((a,))
        for b in some:
            p, left = [a, int(b)], room - int(b)
            while left > 0 and len(p) < most and (c := largest(left)):
                p.append(c)
                left -= c
            out.add(tuple(sorted(p, reverse=True)))
    return sorted(out, key=lambda p: (sum(p), p), reverse=True)


def fit(hist: np.ndarray, pats: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, by accelerated projected gradient."""
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    row = np.fromiter((l for p in pats for l in p), np.int64)
    use = lambda x: np.bincount(row, weights=x[col], minlength=len(hist))
    back = lambda r: np.bincount(col, weights=r[row], minlength=len(pats))
    scale = max(1.0, float(hist.max()))
    h = hist / scale
    v = np.ones(len(pats))
    for _ in range(30):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        x_new = np.maximum(0, y - back(use(y) - h) / norm)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = x_new + (t - 1) / t_new * (x_new - x)
        x, t = x_new, t_new
    return x * scale


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every item of the histogram exactly once. hist[l] counts length l.

    The fitted repeats are rounded down and kept for patterns that leave at most a share of the
    room; what share, and whether the rest looks one item ahead, is decided by trying. One try
    takes no pattern, which is first fit in falling order: the plan is never worse than that.
    """
    left = hist.astype(np.int64)
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return []
    pats = patterns(lengths, capacity)
    x = fit(left, pats)
    tries = [_packed(left.copy(), capacity, pats, x, full, ahead) for full in (1.0, 0.995, 2.0) for ahead in (True, False)]
    return min(tries, key=lambda t: sum(n for _, n in t))


def _packed(left: np.ndarray, capacity: int, pats: list, x: np.ndarray, full: float, ahead: bool) -> list[tuple[tuple[int, ...], int]]:
    out = []

    def take(p: tuple[int, ...], n: int) -> None:
        for l, k in Counter(p).items():
            left[l] -= k * n
        out.append((p, n))

    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1 or sum(pats[i]) < capacity * full:
            continue
        n = min(int(x[i]), *(int(left[l] // k) for l, k in Counter(pats[i]).items()))
        if n > 0:
            take(pats[i], n)
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        p, room, spare = [], capacity, left.copy()
        while room > 0:
            have = np.flatnonzero(spare[: room + 1])
            if not len(have):
                break
            l = int(have[-1])
            # the last two places are chosen together: the pair that leaves the least room
            if ahead and p and len(have) > 1:
                other = have[np.maximum(np.searchsorted(have, room - have, side="right") - 1, 0)]
                ok = (other + have <= room) & ((other != have) | (spare[have] > 1))
                best = np.where(ok, have + other, have)
                l = int(have[np.argmax(best + have * 1e-9)]) if best.max() > l else l
            p.append(l)
            spare[l] -= 1
            room -= l
        take(tuple(sorted(p, reverse=True)), min(int(left[l] // k) for l, k in Counter(p).items()))


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Per length and rank range the containers and offsets; container ids count from 0."""
    seen: Counter = Counter()
    rows, container = [], 0
    for p, n in plan_:
        at = 0
        for l, k in sorted(Counter(p).items(), reverse=True):
            rows.append((l, seen[l], k, container, at))
            seen[l] += k * n
            at += l * k
        container += n
    return pd.DataFrame(rows, columns=["length", "start", "k", "container", "offset"])


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every item in a container: ``doc_id, piece, first_token, n_tokens, container_id, offset``.

    lengths: doc_id (unique) and n_tokens. Items longer than the capacity are cut into full
    pieces and a rest, no other is split. Items of no length and null lengths are in no
    container and have no row. Containers are numbered from 0; full pieces come last.
    """
    spark = lengths.sparkSession
    n = lengths.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n"))
    cut_ = n.select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("piece", "first_token"), "n")
    pieces = cut_.select("doc_id", "piece", "first_token", F.least(F.col("n") - F.col("first_token"), F.lit(capacity)).alias("length"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(256)).cast("int")
    pieces = materialize(pieces.withColumn("b", bucket), "pieces")
    before = bucket_offsets(pieces, ["length"], "b", F.lit(1).cast("long"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most capacity rows
        hist[r["length"]] = r["count"]
    full, hist[capacity] = int(hist[capacity]), 0
    table = slots(plan(hist, capacity) + ([((capacity,), full)] if full else [])).sort_values(["length", "start"])
    held = spark.sparkContext.broadcast((table["length"].to_numpy() * (1 << 44) + table["start"].to_numpy(), *(table[c].to_numpy() for c in ("start", "k", "container", "offset"))))
    w = W.partitionBy("length", "b").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("r", F.row_number().over(w) - 1).join(before, ["length", "b"]).withColumn("rank", F.col("r") + F.col("_before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, k, container, offset = held.value
        for b in batches:
            l, r = b["length"].to_numpy(), b["rank"].to_numpy()
            i = np.searchsorted(key, l * (1 << 44) + r, side="right") - 1
            into = r - start[i]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "piece": b["piece"], "first_token": b["first_token"], "n_tokens": l, "container_id": container[i] + into // k[i], "offset": offset[i] + into % k[i] * l}
            )

    return ranked.select("doc_id", "piece", "first_token", "length", "rank").mapInPandas(
        place, "doc_id long, piece int, first_token long, n_tokens long, container_id long, offset long"
    )


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per container the number of items and the room used and unused."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
