"""Evaluation texts leaking into training text.

The normalised word n-grams of the evaluation items are a small set that is broadcast: pairs of
neighbouring words and of words with one between them, so that even a passage with every second
word altered is met. The documents' windows are
scanned against it, a batch of texts at once; hits that go on from one another form segments, and
the best chain of an item's segments, in order in both texts, is verified word by word: at least
half of the item's words must recur, the same or slightly altered. A gap between two segments
costs the more the longer it is, but no gap is too long for a long enough segment. Words that
several items share as an opening (instructions) are no part of an item.

The scan reads each document once, where it lies: nothing of the corpus is shuffled, and the
work grows with the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.session import materialize

WORD = re.compile(r"[^\W_]+")
#: Distances of the two words of an n-gram.
SKIPS = (1, 2)
#: A gap of g words between two segments costs log2(1 + g / GAP), and TURN more where words are missing on one side.
GAP, TURN = 16, 0.5
#: A single hit further than this from any run of hits of its item is chance.
LONE = 30
#: Parts of a chain that are further apart in the document are spans of their own.
PART_GAP = 40
#: Share of an item's words that make a leak.
SHARE = 0.5
#: Fewest words of a further part of a cut copy; fewer may stand together by chance.
LEAST_REST = 8
#: Bytes of item texts that may be broadcast; a larger test set is checked in several passes.
ITEM_BYTES = 8 << 20
#: Words of texts that are scanned at once.
SCAN_WORDS = 100_000


def fold(text: str) -> str:
    """Lower case with one letter for ё and е; as long as the text, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("ё", "е")


def near(a: str, b: str) -> bool:
    """The same word, or a slight alteration: inflected or with a slip."""
    if a == b:
        return True
    n = min(len(a), len(b))
    if n < 3 or abs(len(a) - len(b)) > 3:
        return False
    same = 0
    while same < n and a[same] == b[same]:
        same += 1
    tail = 0
    while tail < n - same and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return same + tail >= max(2, 0.6 * max(len(a), len(b)))


class Items:
    """The items' words after their shared openings, and for each n-gram where it stands."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.ids = [i for i, _, _ in rows]
        self.words = [WORD.findall(fold(t))[n:] for _, t, n in rows]
        self.code = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.base = len(self.code) + 1
        self.need = np.array([len(w) for w in self.words], np.int64)
        gram, item, pos = [], [], []
        for k, ws in enumerate(self.words):
            c = np.array([self.code[w] for w in ws], np.int64)
            for s in SKIPS:
                if len(c) > s:
                    gram.append(self._gram(c[:-s], c[s:], s))
                    item.append(np.full(len(c) - s, k)), pos.append(np.arange(len(c) - s))
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        gram, item, pos = cat(gram), cat(item), cat(pos)
        order = np.lexsort((pos, item, gram))
        self.gram, first = np.unique(gram[order], return_index=True)
        self.start = np.append(first, len(gram))
        self.item, self.pos = item[order], pos[order]

    def _gram(self, a: np.ndarray, b: np.ndarray, skip: int) -> np.ndarray:
        return (skip * self.base + a) * self.base + b

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, place in the item, distance of the two words) of every n-gram of the codes that stands in an item."""
        parts = []
        for s in SKIPS:
            at = np.flatnonzero((codes[:-s] >= 0) & (codes[s:] >= 0)) if len(codes) > s and len(self.gram) else np.empty(0, np.int64)
            g = self._gram(codes[at], codes[at + s], s)
            i = np.minimum(np.searchsorted(self.gram, g), max(0, len(self.gram) - 1))
            if len(at):
                ok = self.gram[i] == g
                at, i = at[ok], i[ok]
            cnt = self.start[i + 1] - self.start[i] if len(at) else np.empty(0, np.int64)
            src = np.repeat(self.start[i], cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt) if len(at) else np.empty(0, np.int64)
            parts.append((np.repeat(at, cnt), self.item[src], self.pos[src], np.full(len(src), s)))
        return tuple(np.concatenate(x) for x in zip(*parts))


class Segments:
    """Runs of hits on one diagonal: candidate (document and item), places [i0, i1) and [j0, j1), item words hit.

    Of candidates without enough words in runs of several hits nothing is kept, of the others the runs and
    those single hits that stand within LONE words of a run. ``need``: per candidate the fewest words.
    """

    def __init__(self, cand: np.ndarray, at: np.ndarray, pos: np.ndarray, skip: np.ndarray, need: Callable[[np.ndarray], np.ndarray]):
        diagonal = at - pos
        order = np.lexsort((at, diagonal, cand))
        cand, at, pos, skip, diagonal = (x[order] for x in (cand, at, pos, skip, diagonal))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (cand[1:] != cand[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] - at[:-1] > max(SKIPS))
        seg = np.cumsum(fresh) - 1
        size = np.bincount(seg)
        run = size[seg] > 1
        hit = np.unique(np.concatenate([cand[run], cand[run]]) * (1 << 32) + np.concatenate([pos[run], (pos + skip)[run]])) >> 32
        cands, got = np.unique(hit, return_counts=True)
        cands = cands[got >= need(cands)]
        ok = np.isin(cand, cands)
        # of single hits only those near a run of the same candidate
        place = np.sort((cand * (1 << 32) + at)[ok & run])
        here = (cand * (1 << 32) + at)[ok]
        i = np.searchsorted(place, here)
        before = np.abs(here - place[np.maximum(i - 1, 0)]) if len(place) else here
        after = np.abs(place[np.minimum(i, len(place) - 1)] - here) if len(place) else here
        ok[np.flatnonzero(ok)] = np.minimum(before, after) <= LONE
        cand, at, pos, skip, fresh = cand[ok], at[ok], pos[ok], skip[ok], fresh[ok]
        seg = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        self.cand, self.i0, self.j0 = cand[first], pos[first], at[first]
        end = np.maximum.reduceat(pos + skip, first) + 1 if len(first) else np.empty(0, np.int64)
        self.i1, self.j1 = end, self.j0 + (end - self.i0)
        both = np.unique(np.concatenate([seg, seg]) * (1 << 32) + np.concatenate([pos, pos + skip]))
        self.of, self.place = both >> 32, both & 0xFFFFFFFF  # every (segment, item word) that is hit
        self.n = np.bincount(self.of, minlength=len(first))


def best_chains(i0: np.ndarray, i1: np.ndarray, j0: np.ndarray, j1: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, segment before or -1) of the best chain that ends in each segment.

    Rows are candidates, columns their segments in the document's order; n is 0 where a row is
    shorter. All rows are worked at once, column by column.
    """
    score, back = np.zeros(n.shape, np.float32), np.full(n.shape, -1)
    for r in range(n.shape[1]):
        col = slice(r, r + 1)
        lap = np.maximum(np.maximum(i1[:, :r] - i0[:, col], j1[:, :r] - j0[:, col]), 0)
        gap = np.maximum(np.maximum(i0[:, col] - i1[:, :r], j0[:, col] - j1[:, :r]), 0)
        v = score[:, :r] - lap - np.log2(1 + gap.astype(np.float32) / GAP) - TURN * ((j0 - i0)[:, :r] != (j0 - i0)[:, col])
        ok = (n[:, :r] > 0) & (i0[:, :r] < i0[:, col]) & (j0[:, :r] < j0[:, col]) & (i1[:, :r] < i1[:, col]) & (j1[:, :r] < j1[:, col]) & (lap < n[:, col])
        v = np.where(ok, v, -1)
        if r:
            b = v.argmax(axis=1)
            best = v[np.arange(len(v)), b]
            score[:, r] = n[:, r] + np.maximum(best, 0)
            back[:, r] = np.where(best > 0, b, -1)
        else:
            score[:, r] = n[:, r]
    return np.where(n > 0, score, 0), back


def _covered(words: list[str], item: list[str], chain: list[tuple[int, int, int, int]]) -> set[int]:
    """Item words that recur along a chain of segments, the same or slightly altered."""
    held: set[int] = set()
    done = None
    for i0, i1, j0, j1 in chain:
        if done is not None:
            # what stands between two segments, in order
            i, j = done
            if j0 - i0 == j - i:
                held.update(x for x in range(i, i0) if near(words[j + x - i], item[x]))
            elif max(i0 - i, j0 - j) <= 8:
                for x in range(i, i0):
                    for y in range(j, j0):
                        if near(words[y], item[x]):
                            held.add(x)
                            j = y + 1
                            break
        held.update(x for x in range(i0, i1) if near(words[j0 + x - i0], item[x]))
        done = (i1, j1)
    return held


def _parts(chain: list[tuple[int, int, int, int]], held: set[int]) -> list[tuple[int, int, int]]:
    """(first word, word after the last, item words) of the chain's parts."""
    out = []
    for i0, i1, j0, j1 in chain:
        if out and j0 - out[-1][1] <= PART_GAP:
            a, _, i, _ = out.pop()
            out.append((a, j1, i, i1))
        else:
            out.append((j0, j1, i0, i1))
    return [(a, b, sum(1 for x in held if i <= x < k)) for a, b, i, k in out]


def _best(words: list[str], item: list[str], segs: list[tuple[int, ...]]) -> tuple[list[tuple[int, int, int, int]], set[int]]:
    """The best chain of some segments (i0, i1, j0, j1, n, ...) and the item words it covers."""
    if not segs:
        return [], set()
    a = np.array([x[:5] for x in segs], np.int64)[None]
    score, back = best_chains(*(a[:, :, f] for f in range(5)))
    return _walk(segs, score[0], back[0], words, item)


def _walk(segs, score, back, words, item):
    at, chain = int(score.argmax()), []
    while at >= 0:
        chain.append(segs[at][:4])
        at = int(back[at])
    chain.reverse()
    return chain, _covered(words, item, chain)


def _copies(words: list[str], item: list[str], segs: list[tuple], chain: list, held: set[int]) -> list[tuple[int, int, float]]:
    """(first word, word after the last, share) of every copy of an item and every part of one.

    The segments of an accepted chain are taken out and the rest is searched again, until no chain
    holds SHARE of the item. What is left of an item that a copy has only in part counts as the
    other part of it where a chain holds SHARE of the missing words, at least LEAST_REST.
    """
    out, copies = [], []
    free = lambda: [s for s in segs if all(s[3] <= a or s[2] >= b for a, b, _ in out)]
    while chain and len(held) >= SHARE * len(item):
        out += _parts(chain, held)
        copies.append(held)
        segs = free()
        chain, held = _best(words, item, segs)
    for held in copies:
        lacks = set(range(len(item))) - held
        while len(lacks) >= LEAST_REST:
            chain, more = _best(words, item, [s for s in segs if lacks.issuperset(s[5])])
            if len(more) < max(LEAST_REST, SHARE * len(lacks)):
                break
            out += _parts(chain, more)
            segs = free()
            lacks -= more
    return [(a, b, n / len(item)) for a, b, n in out]


def _scan(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first word, word after the last, share) of every leak in some texts."""
    words = [WORD.findall(fold(t)) for t in texts]
    get = items.code.get
    gap = [-1] * max(SKIPS)  # no window reaches from one text into the next
    size = np.array([len(w) + len(gap) for w in words])
    start = np.cumsum(size) - size
    codes = np.fromiter((c for ws in words for c in (*(get(w, -1) for w in ws), *gap)), np.int64, int(size.sum()))
    at, item, pos, skip = items.hits(codes)
    if not len(at):
        return
    doc = np.searchsorted(start, at, side="right") - 1
    m = len(items.words)
    # half of what a leak needs must be hit, the rest may be altered
    s = Segments(doc * m + item, at - start[doc], pos, skip, lambda c: np.maximum(2, items.need[c % m] * SHARE / 2))
    least = lambda c: items.need[c % m] * SHARE / 2.5  # noqa: E731  # what is hit, less the cost of gaps
    # runs alone first: few candidates have a chain of them that single hits could make a leak
    likely = [s.cand[idx[0]] for idx, score, _ in _chained(s, s.n > 2) if score.max() >= least(s.cand[idx[0]])]
    by_seg = np.argsort(s.of, kind="stable")
    places, edge = s.place[by_seg], np.append(0, np.cumsum(s.n))
    for idx, score, back in _chained(s, np.isin(s.cand, likely)):
        c = int(s.cand[idx[0]])
        k = c % m
        if score.max() >= least(c):
            segs = [(int(s.i0[q]), int(s.i1[q]), int(s.j0[q]), int(s.j1[q]), int(s.n[q]), places[edge[q] : edge[q + 1]].tolist()) for q in idx]
            chain, held = _walk(segs, score, back, words[c // m], items.words[k])
            for a, b, share in _copies(words[c // m], items.words[k], segs, chain, held):
                yield c // m, k, a, b, share


def _chained(s: Segments, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segments, scores, segments before) per candidate of some segments, those of like number worked together."""
    order = np.lexsort((s.i0, s.j0, s.cand))
    order = order[which[order]]
    _, first, count = np.unique(s.cand[order], return_index=True, return_counts=True)
    for width in 2 ** np.unique(np.ceil(np.log2(np.maximum(count, 1)))).astype(int):
        group = np.flatnonzero((count <= width) & (count > width // 2))
        step = max(1, 400_000 // int(width))
        for lo in range(0, len(group), step):
            g = group[lo : lo + step]
            col = np.arange(width)
            real = col < count[g][:, None]
            idx = order[np.where(real, first[g][:, None] + col, 0)]
            score, back = best_chains(s.i0[idx], s.i1[idx], s.j0[idx], s.j1[idx], np.where(real, s.n[idx], 0))
            for x in range(len(g)):
                yield idx[x][real[x]], score[x][real[x]], back[x][real[x]]


def _scanned(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, float]]:
    """The leaks of any number of texts, some hundred thousand words at a time."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < 6 * SCAN_WORDS):
            held += len(texts[end])
            end += 1
        for d, *rest in _scan(texts[at:end], items):
            yield at + d, *rest
        at = end


def openings(items: DataFrame, least: int = 3, sharing: int = 3) -> DataFrame:
    """item_id, text, opening: the number of leading words that ``sharing`` or more different items open with.

    items: item_id, text, each row once. Counted over all items, by hashes of their beginnings.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["item_id"], b["text"]):
                h, ws = xxhash.xxh64(), WORD.findall(fold(t))
                begun = []
                for n, w in enumerate(ws, 1):
                    h.update(w + " ")
                    if least <= n < len(ws):
                        begun.append((n, h.intdigest() - (1 << 63)))
                whole = h.intdigest() - (1 << 63)
                out += [(i, t, n, g, whole) for n, g in begun]
            yield pd.DataFrame(out, columns=["item_id", "text", "n", "start", "whole"]).astype({"item_id": "int64", "n": "int32", "start": "int64", "whole": "int64"})

    begun = items.mapInPandas(run, "item_id long, text string, n int, start long, whole long")
    shared = begun.select("start", "whole").distinct().groupBy("start").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= sharing)
    length = begun.join(shared, "start").groupBy("item_id", "text").agg(F.max("n").alias("opening"))
    return items.join(length, ["item_id", "text"], "left").select("item_id", "text", F.coalesce("opening", F.lit(0)).alias("opening"))


def _passes(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, int]:
    """Document columns, the items with their openings, and the number of passes."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).dropna().distinct()
    rows = materialize(openings(rows), "items")
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return d, rows, max(1, min(n, -(-size // ITEM_BYTES)))


def _held(rows: DataFrame, passes: int, s: int):
    """The items of one pass, broadcast: at most ITEM_BYTES of text on average."""
    part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == s).orderBy("item_id", "text")
    return rows.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in part.collect()]))


LEAK = "doc_id long, item_id long, first_word int, last_word int, share double"


def _leaks(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it = held.value
        for b in batches:
            ids = b["doc_id"].tolist()
            got = [(ids[d], it.ids[k], a, e - 1, s) for d, k, a, e, s in _scanned(b["text"].tolist(), it)]
            if got:
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "first_word", "last_word", "share"])

    return run


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Leaked items per document: ``doc_id, item_id, first_word, last_word, share``.

    Null and empty texts have no leak, nor have items without words. A document that holds an item
    several times, or in parts more than PART_GAP words from each other, gives one row per place.
    Places count words of letters and digits. Test sets beyond ITEM_BYTES are checked in several
    passes, whose spans are written one by one; openings count over all items, so that the number
    of passes changes no result.
    """
    return _all_leaks(*_passes(docs, id_col, text_col, items, item_id, item_text))


def _all_leaks(d: DataFrame, rows: DataFrame, passes: int) -> DataFrame:
    out = None
    for s in range(passes):
        held = _held(rows, passes, s)
        part = d.mapInPandas(_leaks(held), LEAK)
        if passes > 1:
            part = materialize(part, "leaks")
            held.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words from a to before b of each span, and what stands between them."""
    place = [m.span() for m in WORD.finditer(fold(text))]
    out, at = [], 0
    for a, b in sorted(spans):
        if place[b - 1][1] <= at:
            continue
        out.append(text[at : max(at, place[a][0])])
        at = place[b - 1][1]
    return "".join(out) + text[at:]


def _cut(ids: list, texts: list[str], spans: dict[int, list[tuple[int, int]]]) -> pd.DataFrame:
    cut = [without_spans(t, spans[i]) if i in spans else t for i, t in enumerate(texts)]
    return pd.DataFrame({"doc_id": ids, "text": cut, "n_removed": [len(spans.get(i, ())) for i in range(len(texts))]})


def cleaned(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Every document with its leaked spans removed: ``doc_id, text, n_removed``.

    All spans are found in the text as it is and cut at once. One pass over the items cuts where it
    scans; of several passes the spans are collected per document first. doc_id must be unique for that.
    """
    d, rows, passes = _passes(docs, id_col, text_col, items, item_id, item_text)
    schema = "doc_id long, text string, n_removed int"
    if passes == 1:
        held = _held(rows, 1, 0)

        def scan_and_cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts, spans = b["text"].tolist(), {}
                for i, _, a, e, _ in _scanned(texts, held.value):
                    spans.setdefault(i, []).append((a, e))
                yield _cut(b["doc_id"].tolist(), texts, spans)

        return d.mapInPandas(scan_and_cut, schema)
    found = _all_leaks(d, rows, passes).groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "last_word")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = {i: [(r["first_word"], r["last_word"] + 1) for r in x] for i, x in enumerate(b["spans"]) if x is not None}
            yield _cut(b["doc_id"].tolist(), b["text"].tolist(), spans)

    return d.join(found, "doc_id", "left").mapInPandas(cut, schema)
