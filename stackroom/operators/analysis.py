"""Text analytics beyond counts: summaries, keywords, excerpts, definitions, annotations, entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.functions import text as T


def sentences(text: Column, least: int = 31) -> Column:
    """Sentences of at least ``least`` letters, heading lines dropped."""
    plain = F.regexp_replace(text, r"(?dm)^#{1,6}[ \t][^\r\n]*", "")
    return F.filter(F.transform(F.split(plain, r"[.!?]+\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def position_score(i: Column, n: Column) -> Column:
    """The first three sentences 2, the last two 1.5, others 1."""
    return F.when(i < 3, 2.0).when(i >= n - 2, 1.5).otherwise(1.0)


def sentence_scores(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, ord, sentence, score): tf-idf of the words within the document's sentences times position."""
    s = docs.select(F.col(doc).alias("doc"), sentences(F.col(text)).alias("ss")).where(F.size("ss") > 0)
    e = s.select("doc", F.size("ss").alias("n"), F.posexplode("ss").alias("ord", "sentence"))
    w = e.select("doc", "n", "ord", F.explode(T.words(F.col("sentence"), 3, True, True)).alias("word"))
    tf = w.groupBy("doc", "n", "ord", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(df, ["doc", "word"]).groupBy("doc", "ord").agg(F.sum(F.col("tf") * F.log((F.col("n") + 1) / F.col("df"))).alias("s"))
    return e.join(x, ["doc", "ord"]).select("doc", "ord", "sentence", (F.col("s") * position_score(F.col("ord"), F.col("n"))).alias("score"))


def summary(docs: DataFrame, doc: str, text: str, k: int = 3) -> DataFrame:
    """(doc, summary): the k best sentences in document order; ties take the earlier one."""
    s = sentence_scores(docs, doc, text)
    top = s.withColumn("r", F.row_number().over(W.partitionBy("doc").orderBy(F.desc(F.round("score", 9)), "ord"))).where(F.col("r") <= k)
    return top.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "sentence"))), lambda x: x["sentence"]), ". ").alias("summary"))


def textrank(docs: DataFrame, doc: str, text: str, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(doc, ord, rank) of sentences by word overlap over the sum of log lengths, within each document."""
    s = docs.select(F.col(doc).cast("long").alias("doc"), F.transform(sentences(F.col(text)), lambda x: F.array_distinct(T.words(x))).alias("ws")).where(F.size("ws") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, ws in zip(b["doc"], b["ws"]):
                n = len(ws)
                code: dict = {}
                rows = np.concatenate([np.full(len(w), i) for i, w in enumerate(ws)]) if n else np.empty(0)
                cols = np.array([code.setdefault(x, len(code)) for w in ws for x in w], np.int64)
                size = np.log(np.maximum([len(w) for w in ws], 1)) if n else np.empty(0)
                rank = np.full(n, 1.0)
                block = 2048  # long texts by blocks of rows: n x block similarities at a time
                inc = np.zeros((n, len(code)), np.float32)
                inc[rows.astype(int), cols] = 1
                def weights(a: int) -> np.ndarray:
                    w = inc[a : a + block] @ inc.T
                    w[np.arange(len(w)), np.arange(a, a + len(w))] = 0
                    den = size[a : a + len(w), None] + size[None]
                    return np.where(den > 0, w / np.where(den > 0, den, 1), 0)
                out = np.concatenate([weights(a).sum(axis=1) for a in range(0, n, block)]) if n else np.empty(0)
                for _ in range(rounds):
                    part = np.where(out > 0, rank / np.where(out > 0, out, 1), 0)
                    rank = (1 - damping) + damping * np.concatenate([weights(a) @ part for a in range(0, n, block)])
                yield pd.DataFrame({"doc": d, "ord": np.arange(n, dtype=np.int32), "rank": rank})

    return s.mapInPandas(run, "doc long, ord int, rank double")


def annotations(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, kind, body) of comments, to-dos, notes, warnings, marked text and questions."""
    # The marks of the seven kinds of annotation.
    kinds = {
        "comment": r"<!--\s*(.*?)\s*-->", "todo": r"TODO:?\s*(.+)", "fixme": r"FIXME:?\s*(.+)", "note": r"(?:NOTE|Примечание):\s*(.+)", "warning": r"(?:WARNING|Внимание):\s*(.+)",
        "highlight": r"==([^=]+)==", "question": r"^([^?\n]{3,}\?)\s*$",
    }
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, r"\r?\n")).alias("i", "l"))
    found = F.array(*[F.when(F.col("l").rlike(p), F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_extract("l", p, 1)).alias("body"))) for k, p in kinds.items()])
    return lines.select("doc", (F.col("i") + 1).alias("line"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("doc", "line", "a.kind", "a.body")


def definitions(text: Column) -> Column:
    """array<struct<term, definition>> of bold terms with a dash or colon after them."""
    p = r"\*\*([^*\n]{2,60})\*\*\s*(?:—|-|:)\s*([^\n]{5,})"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("term"), F.regexp_extract_all(text, F.lit(p), 2).alias("definition"))


def abbreviations(text: Column) -> Column:
    """Distinct upper-case abbreviations of two letters or more."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])([A-ZА-ЯЁ]{2,})(?![\p{L}\p{N}])"), 1))


def key_phrases(docs: DataFrame, doc: str, text: str, n: int = 2, k: int = 5) -> DataFrame:
    """(doc, phrase, freq, rank) of the most frequent n-grams of content words in each document."""
    from stackroom.operators.retrieval import top_per

    g = docs.select(F.col(doc).alias("doc"), F.explode(T.ngrams(T.words(F.col(text), 3, True, True), n)).alias("phrase"))
    return top_per(g.groupBy("doc", "phrase").agg(F.count(F.lit(1)).alias("freq")), "doc", "freq", "phrase", k)


def window_pairs(docs: DataFrame, doc: str, text: str, within: int = 10) -> DataFrame:
    """(a < b, n): word pairs at most ``within`` places apart, by offsets within the word array.

    Every place meets the next ``within`` words of its own document; nothing is joined.
    """
    w = docs.select(T.words(F.col(text), 3, True, True).alias("ws")).where(F.size("ws") > 1)
    at = F.posexplode("ws").alias("i", "x")
    near = w.select("ws", at).select("x", F.explode(F.slice("ws", F.col("i") + 2, F.lit(within))).alias("y")).where("x <> y")
    return near.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))
