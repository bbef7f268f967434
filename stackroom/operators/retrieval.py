"""Inverted index and ranked, phrase, proximity, boolean and fuzzy search.

Postings are a table (word, doc, tf); every search is a filter on the word column, so that a
parquet copy written sorted by word answers it from a few row groups.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions import text as T
from stackroom.skew import lookup


def tokens(docs: DataFrame, doc: str, text: str, **how) -> DataFrame:
    """(doc, pos, word) of every document; texts without words have no row."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(T.words(F.col(text), **how)).alias("pos", "word"))


def postings(docs: DataFrame, doc: str, text: str, **how) -> DataFrame:
    """(word, doc, tf, positions), positions counted from 0."""
    return tokens(docs, doc, text, **how).groupBy("word", "doc").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_counts(docs: DataFrame, doc: str, text: str, **how) -> DataFrame:
    """(word, doc, tf, dl): tf in one map-side combined aggregation, dl from the token array's size."""
    t = docs.select(F.col(doc).alias("doc"), T.words(F.col(text), **how).alias("ws")).select("doc", F.size("ws").alias("dl"), F.explode("ws").alias("word"))
    return t.groupBy("word", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tc: DataFrame) -> DataFrame:
    return tc.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_size(docs: DataFrame, text: str, **how) -> DataFrame:
    """One row: n documents and their mean length in words."""
    return docs.select(F.size(T.words(F.col(text), **how)).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column, mode: str = "bm25") -> Column:
    """bm25: ln((N - df + .5) / (df + .5) + 1); plain: ln(N / df); smooth: ln(N / (1 + df))."""
    if mode == "bm25":
        return F.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.log(n / df) if mode == "plain" else F.log(n / (df + 1))


def bm25(docs: DataFrame, doc: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75, mode: str = "bm25") -> DataFrame:
    """(doc, score) of documents with any query word; a word named twice counts twice.

    Only the query's words leave the scan: the aggregation shuffles as many rows as there are hits.
    """
    weight = {w: query.count(w) for w in query}
    ws = docs.select(F.col(doc).alias("doc"), T.words(F.col(text)).alias("ws"))
    stats = ws.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ws")).alias("avgdl"))
    hits = ws.select("doc", F.size("ws").alias("dl"), F.explode(F.filter("ws", lambda w: w.isin(list(weight)))).alias("word"))
    tf = hits.groupBy("doc", "dl", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    qw = F.create_map(*[x for w, k in weight.items() for x in (F.lit(w), F.lit(k))])
    # stats is one row, df one row per query word: both are of proven size
    j = tf.join(F.broadcast(df), "word").join(F.broadcast(stats), F.lit(True))
    part = idf(F.col("n"), F.col("df"), mode) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return j.groupBy("doc").agg(F.sum(part * qw[F.col("word")]).alias("score"))


def tfidf(docs: DataFrame, doc: str, text: str, mode: str = "plain", normalise: bool = True, **how) -> DataFrame:
    """(doc, word, weight) with tf as a share of the document (or raw) times idf."""
    tc = term_counts(docs, doc, text, **how)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    # the commonest words have a row per document: they are spread over several tasks
    j = lookup(tc, document_frequencies(tc).select("word", "df"), "word", "inner").join(F.broadcast(n), F.lit(True))
    tf = F.col("tf") / F.col("dl") if normalise else F.col("tf")
    return j.select("doc", "word", (tf * idf(F.col("n"), F.col("df"), mode)).alias("weight"))


def top_per(df: DataFrame, key: str, score: str, tie: str, n: int) -> DataFrame:
    """The n best rows of each key; ties by the tie column."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def phrase(docs: DataFrame, doc: str, text: str, query: str) -> DataFrame:
    """(doc, n) of documents that hold the words of the phrase in a row, with the number of places."""
    ws = query.lower().split()
    arr = docs.select(F.col(doc).alias("doc"), T.words(F.col(text)).alias("ws"))
    grams = arr.select("doc", F.size(F.filter(T.ngrams(F.col("ws"), len(ws)), lambda g: g == " ".join(ws))).alias("n"))
    return grams.where("n > 0")


def proximity(docs: DataFrame, doc: str, text: str, a: str, b: str, within: int = 5) -> DataFrame:
    """(doc, distance): least distance of the two words in documents where it is at most ``within``."""
    t = docs.select(F.col(doc).alias("doc"), T.words(F.col(text)).alias("ws"))
    at = lambda w: F.filter(F.transform("ws", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    d = F.array_min(F.flatten(F.transform(at(a), lambda i: F.transform(at(b), lambda j: F.abs(i - j)))))
    return t.where(F.array_contains("ws", a) & F.array_contains("ws", b)).select("doc", d.alias("distance")).where(F.col("distance") <= within)


def kwic(docs: DataFrame, doc: str, text: str, word: str, width: int = 40) -> DataFrame:
    """(doc, n, left_context, hit, right_context) of every occurrence, case ignored."""
    low = F.lower(F.col(text))
    parts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("t"), F.split(low, re.escape(word.lower())).alias("p")).where(F.size("p") > 1)
    ends = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * len(word))
    hit = parts.select("doc", "t", F.posexplode(ends).alias("n", "at"))
    return hit.select(
        "doc", "n", F.expr(f"substring(t, greatest(at - {width} + 1, 1), least(at, {width}))").alias("left_context"),
        F.expr(f"substring(t, at + 1, {len(word)})").alias("hit"), F.expr(f"substring(t, at + {len(word) + 1}, {width})").alias("right_context"),
    )


class Parser:
    """Boolean query: OR binds loosest, then AND, then NOT; parentheses group; words side by side are AND."""

    def __init__(self, query: str):
        self.toks = re.findall(r"\(|\)|[^\s()]+", query)

    def parse(self) -> tuple:
        return self._or()

    def _peek(self) -> str:
        return self.toks[0].upper() if self.toks else ""

    def _or(self) -> tuple:
        left = self._and()
        while self._peek() == "OR":
            self.toks.pop(0)
            left = ("or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._not()
        while self.toks and self._peek() not in ("OR", ")"):
            if self._peek() == "AND":
                self.toks.pop(0)
            left = ("and", left, self._not())
        return left

    def _not(self) -> tuple:
        if self._peek() == "NOT":
            self.toks.pop(0)
            return ("not", self._not())
        if self._peek() == "(":
            self.toks.pop(0)
            inner = self._or()
            if self.toks:
                self.toks.pop(0)
            return inner
        return ("word", self.toks.pop(0).lower()) if self.toks else ("all",)


def boolean(query: str, words: Column) -> Column:
    """Predicate over a word array for a boolean query."""

    def of(node: tuple) -> Column:
        if node[0] == "word":
            return F.array_contains(words, node[1])
        if node[0] == "all":
            return F.lit(True)
        if node[0] == "not":
            return ~of(node[1])
        a, b = of(node[1]), of(node[2])
        return a & b if node[0] == "and" else a | b

    return of(Parser(query).parse())


def fuzzy_words(vocabulary: DataFrame, word: str, most: int = 2) -> DataFrame:
    """(word, distance) of vocabulary words within the edit distance; lengths prune before the metric."""
    near = vocabulary.where(F.abs(F.length("word") - len(word)) <= most)
    return near.select("word", F.levenshtein("word", F.lit(word), most).alias("distance")).where("distance >= 0")


def wildcard(pattern: str) -> str:
    """Anchored regular expression of a pattern with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def trigram_similarity(vocabulary: DataFrame, word: str, least: float = 0.5) -> DataFrame:
    """(word, similarity) by Jaccard of padded character trigrams."""
    grams = lambda c: T.shingles(F.concat(F.lit("$"), c, F.lit("$")), 3)
    a, b = grams(F.col("word")), grams(F.lit(word))
    sim = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return vocabulary.select("word", sim.alias("similarity")).where(F.col("similarity") >= least)
