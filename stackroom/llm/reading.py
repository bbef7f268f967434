"""Reading level of each document.

A document's vocabulary demand is the smallest frequency rank r such that the r most frequent
words of its language, counted over the whole corpus, cover a fixed share of its running words.
That rank and measures of sentence complexity are calibrated on labelled documents: least
squares over sums that SQL aggregates, and cut points between the levels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.session import materialize
from stackroom.skew import lookup

#: Fewest words of running prose.
LEAST_WORDS = 75
#: Vocabularies of at most this many words are broadcast for the ranks, larger ones joined by shuffle.
BROADCAST_WORDS = 500_000

FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
LIST_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,4}[.)])\s+\S")
TABLE_RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
UNDERLINE = re.compile(r"\s{0,3}(?:=+|-{2,})\s*$")
LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|!?\[[^\]\n]*\]\[[^\]\n]*\]|\[\[[^\]\n]*\]\]|<https?:[^>\s]*>|https?://\S+|www\.\S+")
CODE = re.compile(r"`[^`\n]+`")
FRONT = re.compile(r"\A﻿?\s*---[ \t]*\n(?:.*\n)*?(?:---|\.\.\.)[ \t]*(?:\n|\Z)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE = re.compile(r"[.!?…]+(?=[\s\"»”)]*(?:\s|$))(?<!\b[гт]\.)(?<!\bт\. [епд]\.)(?<!\bрис\.)(?<!\bп\.)(?<!\bfig\.)(?<!\bno\.)(?<!\bcf\.)(?<!\be\.g\.)(?<!\bi\.e\.)(?<!\bv\.)")
CLAUSE = re.compile(r"[,;:—–]")
VOWELS = re.compile(r"[аеёиоуыэюяaeiouy]+")


def prose(text: str) -> list[str]:
    """Paragraphs of running prose: no front matter, headings, lists, tables, code and links."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.lstrip("﻿ \t\n").startswith("---"):
        text = FRONT.sub("", text, count=1)
    out: list[str] = []
    part: list[str] = []
    fence, in_list, blank = "", False, True

    def close() -> None:
        if part:
            out.append(" ".join(part))
            part.clear()

    for line in text.split("\n"):
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            continue
        if m := FENCE.match(line):
            close()
            fence = m.group(1)
            continue
        s = line.strip()
        if not s:
            close()
            in_list, blank = False, True
            continue
        if HEADING.match(line) or TABLE_RULE.match(line) and "|" in line or s.startswith("|"):
            close()
            in_list = False
        elif UNDERLINE.match(line):
            if len(part) == 1:
                part.clear()
            close()
        elif LIST_ITEM.match(line):
            close()
            in_list = True
        elif in_list or blank and (line.startswith("    ") or line.startswith("\t")):
            pass
        else:
            part.append(CODE.sub(" ", LINK.sub(" ", s.lstrip("> "))))
        blank = False
    close()
    return out


def measures(text: str) -> tuple | None:
    """(language, words, counts, features) of a document's prose, or None below LEAST_WORDS words."""
    parts = prose(text)
    joined = "\n".join(parts)
    words = WORD.findall(joined.lower().replace("ё", "е"))
    n = len(words)
    if n < LEAST_WORDS:
        return None
    cyr = sum("а" <= w[0] <= "я" for w in words)
    lang = "ru" if cyr * 2 >= n else "en"
    ends = len(SENTENCE.findall(joined)) or 1
    lengths = np.array([len(w) for w in words])
    count = Counter(words)
    vowels = sum(len(VOWELS.findall(w)) * k for w, k in count.items())
    f = [
        n / ends,  # words per sentence
        float(lengths.mean()),
        float((lengths >= (10 if lang == "ru" else 9)).mean()),
        len(CLAUSE.findall(joined)) / ends,
        vowels / n,
        float(sum(w in STARTERS for w in words) / ends),
    ]
    return lang, list(count), list(count.values()), f


# Conjunctions and relatives that open a dependent clause.
STARTERS = frozenset(
    "что чтобы если когда хотя потому поскольку так как который которая которое которые вследствие причем тогда пока чем ибо где куда условии "
    "that if when although because while whereas which who whose since unless until notwithstanding insofar inasmuch provided so whether".split()
)

#: Order of the features that calibration uses.
FEATURES = ("word_len", "long_share", "vowels", "clauses", "dependent", "log_sentence", "log_r50", "log_r80", "log_r95", "mean_log_rank")


def cover(ranks: np.ndarray, counts: np.ndarray, shares: tuple[float, ...]) -> list[int]:
    """Smallest ranks whose words cover the shares of the running words."""
    order = np.argsort(ranks, kind="stable")
    r, total = ranks[order], np.cumsum(counts[order])
    return [int(r[min(len(r) - 1, np.searchsorted(total, s * total[-1] - 1e-9))]) for s in shares]


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [(i, *m) for i, t in zip(b["doc_id"], b["text"]) if (m := measures(t))]
        if got:
            yield pd.DataFrame(got, columns=["doc_id", "lang", "words", "counts", "f"])


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Language, word counts and sentence measures of each document with prose enough."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return d.mapInPandas(_measured, "doc_id long, lang string, words array<string>, counts array<int>, f array<double>")


def word_ranks(m: DataFrame) -> DataFrame:
    """(lang, word, rank): rank = number of words at least as frequent in the language.

    Words of one frequency share a rank, so ranks come from the table of frequencies, which has
    at most sqrt(2 * running words) rows; no window sees the vocabulary.
    """
    freq = m.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("freq"))
    steps = freq.groupBy("lang", "freq").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("lang").orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, 0)
    return freq.join(steps.withColumn("rank", F.sum("n").over(w)).drop("n"), ["lang", "freq"]).select("lang", "word", "rank")


def _features(f: list, ranks: np.ndarray, counts: np.ndarray) -> list[float]:
    wps, word_len, long_share, clauses, vowels, sub = f
    r50, r80, r95 = cover(ranks, counts, SHARES)
    mean = float((np.log(ranks) * counts).sum() / counts.sum())
    return [word_len, long_share, vowels, clauses / wps * 100, sub / wps * 100, float(np.log(min(wps, 60))), float(np.log(r50)), float(np.log(r80)), float(np.log(r95)), mean]


#: Shares of the running words that the ranks in FEATURES cover.
SHARES = (0.50, 0.80, 0.95)


def demands(m: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, lang, x): features of each measured document, with its vocabulary ranks."""
    ranks = materialize(word_ranks(m), "ranks")
    schema = "doc_id long, lang string, x array<double>"
    if ranks.count() <= broadcast_words:
        held = m.sparkSession.sparkContext.broadcast({(r["lang"], r["word"]): r["rank"] for r in ranks.toLocalIterator()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            get = held.value
            for b in batches:
                x = []
                for lang, words, counts, f in zip(b["lang"], b["words"], b["counts"], b["f"]):
                    x.append(_features(list(f), np.array([get[lang, w] for w in words], float), np.asarray(counts)))
                yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "x": x})

        return m.mapInPandas(run, schema)
    pairs = m.select("doc_id", "lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("doc_id", F.struct("lang", F.col("w.words").alias("word")).alias("k"), F.col("w.counts").alias("c"))
    got = lookup(pairs, ranks.select(F.struct("lang", "word").alias("k"), "rank"), "k", "inner")
    # a document's own distinct words, never more than its text
    per = got.groupBy("doc_id").agg(F.collect_list(F.struct("rank", "c")).alias("rc"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [_features(list(f), np.array(r, float), np.asarray(c)) for f, r, c in zip(b["f"], b["ranks"], b["cs"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "x": x})

    both = per.select("doc_id", F.col("rc.rank").alias("ranks"), F.col("rc.c").alias("cs")).join(m.select("doc_id", "lang", "f"), "doc_id")
    return both.mapInPandas(run_joined, schema)


def calibrate(x: DataFrame, labels: DataFrame, id_col: str, level_col: str) -> dict[str, list[tuple[int, list[float], float]]]:
    """Linear discriminants per language from sums that SQL aggregates over all labelled documents.

    Every label counts, also several of one document; null labels do not. Returned are
    (level, weights, constant) for each level that has labels; the key '' holds what all
    languages together give, for languages without enough labels of their own.
    """
    k = len(FEATURES)
    lab = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{level_col}`").cast("int").alias("level")).where("level IS NOT NULL AND doc_id IS NOT NULL")
    j = x.join(lab, "doc_id")
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("x")[i] * F.col("x")[h]).alias(f"q{i}_{h}") for i in range(k) for h in range(i, k)]
    rows = j.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n"), *sums).orderBy("lang", "level").collect()
    out = {}
    for lang in ["", *sorted({r["lang"] for r in rows})]:
        mine = [r for r in rows if lang in ("", r["lang"])]
        stats = {}
        for r in mine:
            n, s, q = stats.get(r["level"], (0, np.zeros(k), np.zeros((k, k))))
            qr = np.array([[r[f"q{min(i, h)}_{max(i, h)}"] for h in range(k)] for i in range(k)])
            stats[r["level"]] = (n + r["n"], s + np.array([r[f"s{i}"] for i in range(k)]), q + qr)
        total = sum(n for n, _, _ in stats.values())
        if not total or lang and (total < 3 * k or len(stats) < 2):
            continue
        mean = sum(s for _, s, _ in stats.values()) / total
        sd = np.sqrt(np.maximum(sum(q.diagonal() for _, _, q in stats.values()) / total - mean**2, 1e-9))
        within = sum(q - np.outer(s, s) / n for n, s, q in stats.values()) / total / np.outer(sd, sd)
        inv = np.linalg.inv(within + (0.002 + 2.0 / total) * np.eye(k))
        fits = []
        for level, (n, s, _) in sorted(stats.items()):
            mu = (s / n - mean) / sd
            w = inv @ mu / sd
            fits.append((level, w.tolist(), float(-mu @ inv @ mu / 2 + np.log(n) - w @ mean)))
        out[lang] = fits
    return out


def levels(x: DataFrame, model: dict) -> DataFrame:
    """(doc_id, reading_level): the level with the greatest discriminant, in SQL. Ties take the lower level.

    Without any labels every document has a null level.
    """

    def score(fits: list) -> F.Column:
        if not fits:
            return F.lit(None).cast("int")
        each = [F.struct((sum((F.col("x")[i] * w for i, w in enumerate(ws)), F.lit(c))).alias("s"), F.lit(-lv).alias("l")) for lv, ws, c in fits]
        return (-(F.greatest(*each) if len(each) > 1 else each[0])["l"]).cast("int")

    level = score(model.get("", []))
    for lang, fits in model.items():
        if lang:
            level = F.when(F.col("lang") == lang, score(fits)).otherwise(level)
    return x.select("doc_id", "lang", "x", level.alias("reading_level"))


def reading_levels(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, level_col: str) -> DataFrame:
    """``doc_id, lang, reading_level, x`` for each document with at least LEAST_WORDS words of prose.

    Null, empty and shorter texts have no row. Whole texts and all documents are measured, all
    labels used; the documents' table is written once between the two passes over it.
    """
    m = materialize(measured(docs, id_col, text_col), "measured")
    x = materialize(demands(m), "demands")
    return levels(x, calibrate(x, labels, label_id, level_col))
