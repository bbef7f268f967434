"""Queries of text analytics over documents and the thesaurus."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions import text as T
from stackroom.operators import analysis as A
from stackroom.operators import thesaurus as TH
from stackroom.plans.corpus import STOP, WORDS
from stackroom.tables import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

SENT = r"ss AS (SELECT doc_id AS doc, list_filter(list_transform(string_split_regex(regexp_replace(text, '(?m)^#{1,6}[ \t][^\r\n]*', '', 'g'), '[.!?]+\s+'), lambda s: trim(s, ' ')), lambda s: length(s) >= 31) AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT doc, len(s) AS n, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS ord FROM ss WHERE len(s) > 0)"


def words_of(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^[а-яёa-z]+$') AND w NOT IN ({STOP}))"


SCORE = f"{SENT}, w AS (SELECT doc, n, ord, unnest({words_of('sentence')}) AS word FROM e), tf AS (SELECT doc, n, ord, word, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT doc, word, count(*) AS df FROM tf GROUP BY ALL), x AS (SELECT doc, ord, sum(tf * ln((n + 1) / df)) AS s FROM tf JOIN df USING (doc, word) GROUP BY ALL), sc AS (SELECT e.doc, e.ord, sentence, s * CASE WHEN e.ord < 3 THEN 2.0::DOUBLE WHEN e.ord >= n - 2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM e JOIN x USING (doc, ord))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


@query(f"WITH {SCORE} SELECT doc, ord::INT AS ord, round(score, 5) AS score FROM sc")
def sentence_importance(spark, d):
    return A.sentence_scores(docs(spark, d), "doc_id", "text").select("doc", "ord", F.round("score", 5).alias("score"))


@query(f"WITH {SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(score, 9) DESC, ord) AS r FROM sc) SELECT doc, string_agg(sentence, '. ' ORDER BY ord) AS summary FROM r WHERE r <= 3 GROUP BY doc")
def extractive_summary(spark, d):
    return A.summary(docs(spark, d), "doc_id", "text")


@query()
def textrank_sentences(spark, d):
    """Tested against a plain loop on a fixture."""
    return A.textrank(docs(spark, d), "doc_id", "text").withColumn("rank", F.round("rank", 6))


@query(r"WITH l AS (SELECT doc_id AS doc, unnest(string_split_regex(text, '\r?\n')) AS l FROM documents) SELECT doc, count(*) AS n_questions FROM l WHERE regexp_matches(l, '^([^?\n]{3,}\?)\s*$') GROUP BY doc")
def question_lines(spark, d):
    return A.annotations(docs(spark, d), "doc_id", "text").where("kind = 'question'").groupBy("doc").agg(F.count(F.lit(1)).alias("n_questions"))


@query()
def annotation_kinds(spark, d):
    return A.annotations(docs(spark, d), "doc_id", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"WITH a AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM documents) SELECT w AS abbreviation, count(DISTINCT doc) AS n_docs FROM a WHERE regexp_full_match(w, '[A-ZА-ЯЁ]{2,}') GROUP BY w")
def abbreviations(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("doc"), F.explode(A.abbreviations(F.col("text"))).alias("abbreviation"))
    return a.groupBy("abbreviation").agg(F.countDistinct("doc").alias("n_docs"))


@query(f"WITH w AS (SELECT doc_id AS doc, {words_of('text')} AS ws FROM documents), g AS (SELECT doc, ws[i] || ' ' || ws[i + 1] AS phrase FROM (SELECT doc, ws, unnest(range(1, len(ws))) AS i FROM w)), f AS (SELECT doc, phrase, count(*) AS freq FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY freq DESC, phrase) AS rank FROM f) SELECT doc, phrase, freq, rank::INT AS rank FROM r WHERE rank <= 5")
def key_phrases(spark, d):
    return A.key_phrases(docs(spark, d), "doc_id", "text")


@query(f"WITH w AS (SELECT {words_of('text')} AS ws FROM documents WHERE text IS NOT NULL), p AS (SELECT ws[i] AS x, unnest(ws[i + 1:i + 10]) AS y FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM w)) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM p WHERE x <> y GROUP BY ALL HAVING count(*) >= 20")
def word_windows(spark, d):
    return A.window_pairs(docs(spark, d), "doc_id", "text").where("n >= 20")


@query(f"WITH w AS (SELECT doc_id AS doc, {WORDS} AS ws FROM documents), c AS (SELECT doc, len(list_filter(ws, lambda x: x IN ('must', 'should', 'important', 'важно', 'нужно', 'главный'))) AS hits, len(ws) AS n FROM w) SELECT CASE WHEN hits >= 3 THEN 'high' WHEN hits >= 1 THEN 'medium' ELSE 'low' END AS priority, count(*) AS n_docs, round(avg(n), 6) AS mean_words FROM c GROUP BY 1")
def priority_by_keywords(spark, d):
    hits = F.size(F.filter("ws", lambda w: w.isin("must", "should", "important", "важно", "нужно", "главный")))
    c = docs(spark, d).select(T.words(F.col("text")).alias("ws"))
    p = F.when(hits >= 3, "high").when(hits >= 1, "medium").otherwise("low")
    return c.select(p.alias("priority"), F.size("ws").alias("n")).groupBy("priority").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_words"))


# thesaurus

CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY exported_at DESC) AS rn FROM thesaurus) WHERE rn = 1)"


def _cur(spark, d, *cols):
    return latest(table(spark, d, "thesaurus"), "term_id", "exported_at", F.col("term"), F.col("origin"), *[F.col(c) for c in cols])


@query(f"WITH {CUR} SELECT origin, count(*) AS n, sum(len(coalesce(synonyms, [])))::BIGINT AS synonyms, sum(len(coalesce(related, [])))::BIGINT AS related, sum(len(coalesce(narrower, [])))::BIGINT AS narrower, sum(len(coalesce(articles, [])))::BIGINT AS articles FROM cur GROUP BY origin")
def thesaurus_stats(spark, d):
    cols = ["synonyms", "related", "narrower", "articles"]
    return _cur(spark, d, *cols).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.array_size(c), F.lit(0))).alias(c) for c in cols])


@query(f"WITH {CUR} SELECT term_id, term, canonical FROM cur WHERE lower(term) = 'цифровой-шлюз' OR list_contains(list_transform(coalesce(synonyms, []), lambda s: lower(s)), 'digital gateway')")
def thesaurus_lookup(spark, d):
    t = _cur(spark, d, "canonical", "synonyms")
    hit = (F.lower("term") == "цифровой-шлюз") | F.exists(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s) == "digital gateway")
    return t.where(hit).select("term_id", "term", "canonical")


@query(f"WITH {CUR}, r AS (SELECT 'synonym' AS relation, term_id, unnest(synonyms) AS target FROM cur UNION ALL SELECT 'related', term_id, unnest(related) FROM cur UNION ALL SELECT 'broader', term_id, unnest(broader) FROM cur UNION ALL SELECT 'narrower', term_id, unnest(narrower) FROM cur UNION ALL SELECT 'article', term_id, unnest(articles) FROM cur) SELECT relation, term_id, target FROM r WHERE target IS NOT NULL AND trim(target) <> ''")
def thesaurus_triples(spark, d):
    names = {"synonym": "synonyms", "related": "related", "broader": "broader", "narrower": "narrower", "article": "articles"}
    t = _cur(spark, d, *names.values())
    tagged = lambda k, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("relation"), x.alias("target")))
    rel = F.concat(*[tagged(k, F.col(c)) for k, c in names.items()])
    return t.select("term_id", F.explode(rel).alias("r")).select("r.relation", "term_id", "r.target").where("target IS NOT NULL AND trim(target) <> ''")


@query(f"WITH {CUR}, w AS (SELECT term_id, term, unnest(list_distinct(string_split_regex(lower(term), '[ _-]+'))) AS word FROM cur), q AS (SELECT * FROM w WHERE term_id % 100 = 0) SELECT q.term_id AS query_id, w.term_id AS term_id, count(*) AS common FROM q JOIN w USING (word) WHERE q.term_id <> w.term_id AND word <> '' GROUP BY ALL")
def terms_sharing_words(spark, d):
    """Terms that share a word with each term whose id is divisible by 100."""
    w = _cur(spark, d).select("term_id", F.explode(F.array_distinct(F.split(F.lower("term"), "[ _-]+"))).alias("word")).where("word <> ''")
    q = w.where("term_id % 100 = 0").withColumnRenamed("term_id", "query_id")
    return q.join(w, "word").where("query_id <> term_id").groupBy("query_id", "term_id").agg(F.count(F.lit(1)).alias("common"))


@query(f"WITH {CUR}, a AS (SELECT term_id, unnest(articles) AS path FROM cur), x AS (SELECT path, count(DISTINCT term_id) AS n_terms, min(term_id) AS first_term FROM a WHERE path IS NOT NULL GROUP BY path) SELECT * FROM x")
def back_of_book_index(spark, d):
    a = _cur(spark, d, "articles").select("term_id", F.explode("articles").alias("path")).where("path IS NOT NULL")
    return a.groupBy("path").agg(F.countDistinct("term_id").alias("n_terms"), F.min("term_id").alias("first_term"))


@query("WITH s AS (SELECT DISTINCT suggestion_id, path, unnest(suggestions) AS s FROM tagging_suggestions), g AS (SELECT suggestion_id, s.tag AS tag, round(max(s.score * s.confidence), 6) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY suggestion_id ORDER BY score DESC, tag) AS rank FROM g) SELECT suggestion_id, tag, score, rank::INT AS rank FROM r WHERE rank <= 5")
def tag_suggestions(spark, d):
    """The five best suggestions of each record by score and confidence."""
    from stackroom.operators.retrieval import top_per

    s = table(spark, d, "tagging_suggestions").select("suggestion_id", F.explode("suggestions").alias("s")).distinct()
    g = s.groupBy("suggestion_id", F.col("s.tag").alias("tag")).agg(F.round(F.max(F.col("s.score") * F.col("s.confidence")), 6).alias("score"))
    return top_per(g, "suggestion_id", "score", "tag", 5)


@query("SELECT s.type AS type, s.source AS source, count(*) AS n, round(avg(s.confidence), 6) AS mean_confidence FROM (SELECT unnest(suggestions) AS s FROM tagging_suggestions) GROUP BY ALL")
def suggestion_sources(spark, d):
    s = table(spark, d, "tagging_suggestions").select(F.explode("suggestions").alias("s"))
    return s.groupBy("s.type", "s.source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s.confidence"), 6).alias("mean_confidence"))


@query(f"WITH {CUR} SELECT count(*) AS n_names, count(DISTINCT k) AS n_keys FROM (SELECT trim(regexp_replace(lower(n), '[\\s_-]+', ' ', 'g'), ' ') AS k FROM (SELECT term AS n FROM cur UNION ALL SELECT canonical FROM cur UNION ALL SELECT unnest(synonyms) FROM cur) WHERE n IS NOT NULL)")
def thesaurus_names(spark, d):
    t = _cur(spark, d, "canonical", "synonyms")
    n = t.select(F.explode(F.concat(F.array("term", "canonical"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("n")).where("n IS NOT NULL")
    return n.agg(F.count(F.lit(1)).alias("n_names"), F.countDistinct(TH.name_key(F.col("n"))).alias("n_keys"))
