"""Queries over ``documents``: index, search, text statistics, structure, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import text as T
from stackroom.operators import retrieval as R
from stackroom.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Words of a document in SQL.
WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
TOK = f"w AS (SELECT doc_id AS doc, {WORDS} AS ws FROM documents), tok AS (SELECT doc, len(ws) AS dl, unnest(ws) AS word FROM w), tc AS (SELECT word, doc, dl, count(*) AS tf FROM tok GROUP BY ALL)"
VOWEL = "[аеёиоуыэюяaeiouy]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"WITH {TOK} SELECT word, count(*) AS df, sum(tf)::BIGINT AS cf FROM tc GROUP BY word")
def term_statistics(spark, d):
    return R.document_frequencies(R.term_counts(docs(spark, d), "doc_id", "text"))


@query(f"""WITH {TOK}, p AS (SELECT doc, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w)
SELECT word, doc, count(*) AS tf, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM p GROUP BY word, doc""")
def concordance_postings(spark, d):
    p = R.postings(docs(spark, d), "doc_id", "text")
    return p.select("word", "doc", "tf", F.array_min("positions").alias("first_pos"), F.array_max("positions").alias("last_pos"))


BM25 = """WITH {tok}, q AS (SELECT * FROM tc WHERE word IN ({q})), df AS (SELECT word, count(*) AS df FROM q GROUP BY word),
s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w)
SELECT doc, round(sum({idf} * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN df USING (word), s GROUP BY doc"""
IDF = {"bm25": "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)", "plain": "ln(n / df)", "smooth": "ln(n / (df + 1))"}


def _bm25(spark, d, q, mode="bm25"):
    return R.bm25(docs(spark, d), "doc_id", "text", q, mode=mode).withColumn("score", F.round("score", 6))


@query(BM25.format(tok=TOK, q="'модуль', 'server'", idf=IDF["bm25"]) + " ORDER BY score DESC, doc LIMIT 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, ["модуль", "server"]).orderBy(F.desc("score"), "doc").limit(10)


@query(BM25.format(tok=TOK, q="'complex', 'чай'", idf=IDF["plain"]))
def bm25_plain_idf(spark, d):
    return _bm25(spark, d, ["complex", "чай"], "plain")


@query(BM25.format(tok=TOK, q="'complex', 'чай'", idf=IDF["smooth"]))
def bm25_smooth_idf(spark, d):
    return _bm25(spark, d, ["complex", "чай"], "smooth")


TFIDF = """WITH {tok}, df AS (SELECT word, count(*) AS df FROM tc GROUP BY word), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc, word, round({tf} * {idf}, 6) AS weight FROM tc JOIN df USING (word), n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, word) AS rank FROM x) SELECT doc, word, weight, rank::INT AS rank FROM r WHERE rank <= {k}"""


@query(TFIDF.format(tok=TOK, tf="tf / dl", idf=IDF["plain"], k=10))
def tfidf_keywords(spark, d):
    x = R.tfidf(docs(spark, d), "doc_id", "text").withColumn("weight", F.round("weight", 6))
    return R.top_per(x, "doc", "weight", "word", 10)


@query(TFIDF.format(tok=TOK, tf="tf", idf=IDF["smooth"], k=5))
def tfidf_raw_smooth(spark, d):
    x = R.tfidf(docs(spark, d), "doc_id", "text", "smooth", False).withColumn("weight", F.round("weight", 6))
    return R.top_per(x, "doc", "weight", "word", 5)


@query(f"""WITH {TOK}, df AS (SELECT word, count(*) AS df FROM tc GROUP BY word), n AS (SELECT count(*) AS n FROM documents)
SELECT word, round(avg(tf * ln(n / (1 + df))), 6) AS mean_weight, count(*) AS n_docs FROM tc JOIN df USING (word), n GROUP BY word ORDER BY mean_weight DESC, word LIMIT 100""")
def tfidf_corpus_top(spark, d):
    x = R.tfidf(docs(spark, d), "doc_id", "text", "smooth", False)
    g = x.groupBy("word").agg(F.round(F.avg("weight"), 6).alias("mean_weight"), F.count(F.lit(1)).alias("n_docs"))
    return g.orderBy(F.desc("mean_weight"), "word").limit(100)


def _ngram_sql(n: int, least: int) -> str:
    gram = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(n))
    return f"WITH {TOK}, g AS (SELECT {gram} AS gram FROM (SELECT ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n})) SELECT gram, count(*) AS freq FROM g GROUP BY gram HAVING count(*) >= {least}"


def _ngrams(spark, d, n, least):
    g = docs(spark, d).select(F.explode(T.ngrams(T.words(F.col("text")), n)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)


@query(_ngram_sql(2, 3))
def bigrams(spark, d):
    return _ngrams(spark, d, 2, 3)


@query(_ngram_sql(3, 2))
def trigrams(spark, d):
    return _ngrams(spark, d, 3, 2)


@query(_ngram_sql(2, 1) + " ORDER BY freq DESC, gram LIMIT 30")
def ngram_top(spark, d):
    return _ngrams(spark, d, 2, 1).orderBy(F.desc("freq"), "gram").limit(30)


@query(f"WITH {TOK} SELECT word, count(*) AS freq FROM tok WHERE regexp_matches(word, '^[а-яёa-z]+$') AND length(word) >= 3 GROUP BY word ORDER BY freq DESC, word LIMIT 50")
def top_words(spark, d):
    t = R.tokens(docs(spark, d), "doc_id", "text", least=3, letters_only=True)
    return t.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "word").limit(50)


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""WITH {TOK}, f AS (SELECT doc, word, count(*) AS freq FROM tok WHERE length(word) >= 3 AND regexp_matches(word, '^[а-яёa-z]+$') AND word NOT IN ({STOP}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY freq DESC, word) AS rank FROM f) SELECT doc, word, freq, rank::INT AS rank FROM r WHERE rank <= 10""")
def keyword_frequency(spark, d):
    t = R.tokens(docs(spark, d), "doc_id", "text", least=3, letters_only=True, stop_words=True)
    return R.top_per(t.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("freq")), "doc", "freq", "word", 10)


@query(f"WITH {TOK} SELECT doc, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'как' AND ws[i + 1] = 'правило'))::INT AS n FROM w WHERE len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'как' AND ws[i + 1] = 'правило')) > 0")
def phrase_positions(spark, d):
    return R.phrase(docs(spark, d), "doc_id", "text", "как правило")


@query("SELECT doc_id AS doc, (10 * (length(lower(text)) - length(replace(lower(text), 'as a rule', ''))) // 9)::INT AS score FROM documents WHERE contains(lower(text), 'as a rule')")
def phrase_substring(spark, d):
    n = T.occurrences(F.col("text"), "as a rule")
    return docs(spark, d).select(F.col("doc_id").alias("doc"), (n * 10).alias("score")).where("score > 0")


@query(f"""WITH {TOK}, p AS (SELECT doc, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w)
SELECT a.doc, min(abs(a.pos - b.pos))::INT AS distance FROM p a JOIN p b ON a.doc = b.doc WHERE a.word = 'server' AND b.word = 'closed' GROUP BY a.doc HAVING min(abs(a.pos - b.pos)) <= 5""")
def proximity_search(spark, d):
    return R.proximity(docs(spark, d), "doc_id", "text", "server", "closed")


def _bool_sql(cond: str) -> str:
    return f"WITH {TOK} SELECT doc FROM w WHERE {cond}"


def _has(w: str) -> str:
    return f"list_contains(ws, '{w}')"


def _boolean(spark, d, q):
    ws = docs(spark, d).select(F.col("doc_id").alias("doc"), T.words(F.col("text")).alias("ws"))
    return ws.where(R.boolean(q, F.col("ws"))).select("doc")


@query(_bool_sql(f"{_has('server')} AND {_has('module')}"))
def boolean_and(spark, d):
    return _boolean(spark, d, "server AND module")


@query(_bool_sql(f"{_has('server')} OR {_has('чай')}"))
def boolean_or(spark, d):
    return _boolean(spark, d, "server OR чай")


@query(_bool_sql(f"{_has('server')} AND NOT {_has('module')}"))
def boolean_not(spark, d):
    return _boolean(spark, d, "server AND NOT module")


@query(_bool_sql(f"({_has('server')} OR {_has('valve')}) AND NOT ({_has('module')} AND {_has('open')})"))
def boolean_nested(spark, d):
    return _boolean(spark, d, "(server OR valve) AND NOT (module AND open)")


@query(f"WITH {TOK}, v AS (SELECT DISTINCT word FROM tok) SELECT word, levenshtein(word, 'modul')::INT AS distance FROM v WHERE levenshtein(word, 'modul') <= 2")
def fuzzy_vocabulary(spark, d):
    v = R.tokens(docs(spark, d), "doc_id", "text").select("word").distinct()
    return R.fuzzy_words(v, "modul")


@query(f"WITH {TOK} SELECT word, count(*) AS freq FROM tok WHERE regexp_full_match(word, 's.*ve.') GROUP BY word")
def wildcard_search(spark, d):
    t = R.tokens(docs(spark, d), "doc_id", "text").where(F.col("word").rlike(R.wildcard("s*ve?")))
    return t.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


@query(f"WITH {TOK} SELECT word, count(DISTINCT doc) AS n_docs FROM tok WHERE regexp_matches(word, 'ation$') GROUP BY word")
def regex_search(spark, d):
    t = R.tokens(docs(spark, d), "doc_id", "text").where(F.col("word").rlike("ation$"))
    return t.groupBy("word").agg(F.countDistinct("doc").alias("n_docs"))


@query(f"""WITH {TOK}, v AS (SELECT DISTINCT word FROM tok), g AS (SELECT word, list_distinct(list_transform(range(1, length(word) + 1), lambda i: substr('$' || word || '$', i, 3))) AS a FROM v WHERE length(word) >= 1),
q AS (SELECT list_distinct(list_transform(range(1, 8), lambda i: substr('$modules$', i, 3))) AS b),
s AS (SELECT word, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM g, q) SELECT word, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.4""")
def trigram_search(spark, d):
    v = R.tokens(docs(spark, d), "doc_id", "text").select("word").distinct()
    return R.trigram_similarity(v, "modules", 0.4).withColumn("similarity", F.round("similarity", 6))


@query("""WITH p AS (SELECT doc_id AS doc, text, string_split(lower(text), 'server') AS p FROM documents), e AS (SELECT doc, text, p, unnest(range(1, len(p))) AS i FROM p WHERE len(p) > 1),
a AS (SELECT doc, text, i, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 6)::BIGINT AS pos FROM e)
SELECT doc, (i - 1)::INT AS n, substr(text, greatest(pos - 39, 1), least(pos, 40)) AS left_context, substr(text, pos + 1, 6) AS hit, substr(text, pos + 7, 40) AS right_context FROM a""")
def kwic_lines(spark, d):
    return R.kwic(docs(spark, d), "doc_id", "text", "server")


# text statistics

STATS = f"""s AS (SELECT doc_id AS doc, text, {WORDS} AS ws, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x, ' ') <> '')) AS sentences FROM documents WHERE text IS NOT NULL AND text <> ''),
m AS (SELECT doc, text, ws, len(ws) AS words, greatest(sentences, 1) AS sentences, list_sum(list_transform(ws, lambda x: greatest(len(regexp_extract_all(x, '{VOWEL}+')), 1)))::BIGINT AS syllables,
list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS chars, len(list_filter(ws, lambda x: len(regexp_extract_all(x, '{VOWEL}+')) >= 3)) AS complex FROM s WHERE len(ws) > 0)"""


def _measured(spark, d):
    s = docs(spark, d).where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").alias("doc"), "text", T.words(F.col("text")).alias("ws"), F.greatest(T.sentence_count(F.col("text")), F.lit(1)).alias("sentences"))
    syl = F.transform("ws", lambda w: T.syllables_groups(w))
    return s.where(F.size("ws") > 0).select(
        "doc", "text", "ws", F.size("ws").alias("words"), "sentences", F.aggregate(syl, F.lit(0), lambda a, x: a + x).alias("syllables"),
        F.aggregate(F.transform("ws", F.length), F.lit(0), lambda a, x: a + x).alias("chars"), F.size(F.filter(syl, lambda x: x >= 3)).alias("complex"),
    )


@query(f"""WITH {STATS} SELECT doc, round(206.835::DOUBLE - 1.015::DOUBLE * words / sentences - 84.6::DOUBLE * syllables / words, 6) AS flesch, round(0.39::DOUBLE * words / sentences + 11.8::DOUBLE * syllables / words - 15.59::DOUBLE, 6) AS flesch_kincaid,
round(0.0588::DOUBLE * (chars / words * 100) - 0.296::DOUBLE * (sentences / words * 100) - 15.8::DOUBLE, 6) AS coleman_liau, round(4.71::DOUBLE * chars / words + 0.5::DOUBLE * words / sentences - 21.43::DOUBLE, 6) AS ari,
round(1.0430::DOUBLE * sqrt(complex * 30 / sentences) + 3.1291::DOUBLE, 6) AS smog, round(0.4::DOUBLE * (words / sentences + 100 * complex / words), 6) AS gunning_fog FROM m""")
def readability_scores(spark, d):
    m = _measured(spark, d)
    w, s, y, c, k = (F.col(x) for x in ("words", "sentences", "syllables", "chars", "complex"))
    got = {"flesch": T.flesch(w, s, y), "flesch_kincaid": T.flesch_kincaid(w, s, y), "coleman_liau": T.coleman_liau(w, s, c), "ari": T.ari(w, s, c), "smog": T.smog(s, k), "gunning_fog": T.gunning_fog(w, s, k)}
    return m.select("doc", *[F.round(v, 6).alias(n) for n, v in got.items()])


FLESCH = "206.835::DOUBLE - 1.015::DOUBLE * words / sentences - 84.6::DOUBLE * syllables / words"


@query(f"""WITH {STATS}, l AS (SELECT CASE WHEN {FLESCH} >= 90 THEN 'very_easy' WHEN {FLESCH} >= 80 THEN 'easy' WHEN {FLESCH} >= 70 THEN 'fairly_easy' WHEN {FLESCH} >= 60 THEN 'standard'
WHEN {FLESCH} >= 50 THEN 'fairly_difficult' WHEN {FLESCH} >= 30 THEN 'difficult' ELSE 'very_difficult' END AS band FROM m) SELECT band, count(*) AS n FROM l GROUP BY band""")
def flesch_bands(spark, d):
    m = _measured(spark, d).select(T.flesch_label(T.flesch(F.col("words"), F.col("sentences"), F.col("syllables"))).alias("band"))
    return m.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATS} SELECT doc, words::INT AS words, round(len(list_distinct(ws)) / words, 6) AS ttr, round(chars / words, 6) AS mean_length, round(syllables / words, 6) AS mean_syllables, round(100 * complex / words, 6) AS complex_pct FROM m")
def vocabulary_metrics(spark, d):
    m = _measured(spark, d)
    ratio = lambda a: F.round(a / F.col("words"), 6)
    return m.select("doc", "words", ratio(F.size(F.array_distinct("ws"))).alias("ttr"), ratio(F.col("chars")).alias("mean_length"), ratio(F.col("syllables")).alias("mean_syllables"), ratio(F.col("complex") * 100).alias("complex_pct"))


@query(f"WITH {STATS} SELECT doc, greatest(1, ceil(words / 200))::INT AS minutes, greatest(1, ceil(words / 150))::INT AS minutes_technical FROM m")
def reading_time(spark, d):
    return _measured(spark, d).select("doc", T.reading_minutes(F.col("words")).alias("minutes"), T.reading_minutes(F.col("words"), 150).alias("minutes_technical"))


@query(f"""WITH {STATS} SELECT doc, sentences::INT AS sentences, round(words / sentences, 6) AS words_per_sentence, CASE WHEN words / sentences < 15 THEN 1.0::DOUBLE WHEN words / sentences < 25 THEN 1.5::DOUBLE ELSE 2.0::DOUBLE END AS complexity FROM m""")
def sentence_complexity(spark, d):
    per = F.col("words") / F.col("sentences")
    return _measured(spark, d).select("doc", "sentences", F.round(per, 6).alias("words_per_sentence"), F.when(per < 15, 1.0).when(per < 25, 1.5).otherwise(2.0).alias("complexity"))


@query("SELECT CASE WHEN regexp_matches(text, '[а-яА-ЯёЁ]') THEN 'RU' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'EN' ELSE 'OTHER' END AS script, count(*) AS n FROM documents GROUP BY 1")
def language_script(spark, d):
    return docs(spark, d).groupBy(T.script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT doc_id AS doc, {WORDS} AS ws FROM documents), c AS (SELECT doc, len(list_filter(ws, lambda x: x IN ('the','and','is','in','to','of','a','that','it','with'))) AS en,
len(list_filter(ws, lambda x: x IN ('и','в','не','на','что','с','как','это','по','для'))) AS ru FROM w) SELECT doc, CASE WHEN en > ru THEN 'en' WHEN ru > en THEN 'ru' ELSE 'unknown' END AS language, CASE WHEN en = ru THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM c""")
def language_by_words(spark, d):
    ws = docs(spark, d).select(F.col("doc_id").alias("doc"), T.words(F.col("text")).alias("ws"))
    hits = lambda names: F.size(F.filter("ws", lambda w: w.isin(names.split())))
    c = ws.select("doc", hits("the and is in to of a that it with").alias("en"), hits("и в не на что с как это по для").alias("ru"))
    return c.select("doc", F.when(F.col("en") > F.col("ru"), "en").when(F.col("ru") > F.col("en"), "ru").otherwise("unknown").alias("language"), F.when(F.col("en") == F.col("ru"), 0.5).otherwise(0.8).alias("confidence"))


# structure

HEAD = r"h AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '(?m)^(#{1,6}[ \t]+[^\r\n]+)', 1)) AS line FROM documents), hh AS (SELECT doc, length(regexp_extract(line, '^(#+)', 1))::INT AS level, trim(regexp_replace(line, '^#+[ \t]+', ''), ' ') AS title FROM h)"


def _headings(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("doc"), F.posexplode(T.headings(F.col("text"))).alias("ord", "h")).select("doc", "ord", "h.level", "h.title")


@query(f"WITH {HEAD} SELECT level, count(*) AS n, count(DISTINCT doc) AS n_docs, count(DISTINCT title) AS n_titles FROM hh GROUP BY level")
def heading_levels(spark, d):
    return _headings(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("n_docs"), F.countDistinct("title").alias("n_titles"))


SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"WITH {HEAD} SELECT doc, {SLUG} AS anchor, count(*) AS n FROM hh GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_anchors(spark, d):
    return _headings(spark, d).groupBy("doc", T.slug(F.col("title")).alias("anchor")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(r"""WITH h AS (SELECT doc_id AS doc, regexp_extract_all(text, '(?m)^(#{1,6})[ \t]+[^\r\n]+', 1) AS a FROM documents), p AS (SELECT doc, unnest(range(2, len(a) + 1)) AS i, a FROM h)
SELECT doc, (i - 1)::INT AS ord, length(a[i - 1])::INT AS prev, length(a[i])::INT AS level FROM p WHERE length(a[i]) > length(a[i - 1]) + 1""")
def skipped_heading_levels(spark, d):
    from pyspark.sql import Window as W

    h = _headings(spark, d).withColumn("prev", F.lag("level").over(W.partitionBy("doc").orderBy("ord")))
    return h.where("level > prev + 1").select("doc", "ord", "prev", "level")


@query(r"""SELECT doc_id AS doc, regexp_extract(u, '\]\(([^)]+)\)', 1) AS url, regexp_extract(u, '\[([^\]]+)\]', 1) AS label FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^!])(\[[^\]]+\]\([^)]+\))', 1)) AS u FROM documents)""")
def markdown_links(spark, d):
    l = docs(spark, d).select(F.col("doc_id").alias("doc"), F.explode(T.links(F.col("text"))).alias("l"))
    return l.select("doc", F.col("l.url").alias("url"), F.col("l.label").alias("label"))


@query(r"""WITH l AS (SELECT unnest(regexp_extract_all(text, '(?:^|[^!])\[[^\]]+\]\(([^)]+)\)', 1)) AS url FROM documents)
SELECT CASE WHEN starts_with(url, 'http') THEN 'external' WHEN starts_with(url, '#') THEN 'anchor' WHEN starts_with(url, 'mailto:') THEN 'mail' ELSE 'internal' END AS kind, count(*) AS n, count(DISTINCT url) AS n_urls FROM l GROUP BY 1""")
def link_kinds(spark, d):
    u = docs(spark, d).select(F.explode(T.links(F.col("text"))).alias("l")).select("l.url")
    kind = F.when(F.col("url").startswith("http"), "external").when(F.col("url").startswith("#"), "anchor").when(F.col("url").startswith("mailto:"), "mail").otherwise("internal")
    return u.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"))


CODE = r"(?s)```(\w*)[ \t]*\r?\n(.*?)```"


@query(rf"""WITH c AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '{CODE}', 1)) AS lang, unnest(regexp_extract_all(text, '{CODE}', 2)) AS code FROM documents)
SELECT lang, count(*) AS n_blocks, count(DISTINCT doc) AS n_docs, sum(length(code))::BIGINT AS chars, sum(len(string_split(code, chr(10))) - 1)::BIGINT AS lines FROM c GROUP BY lang""")
def code_block_stats(spark, d):
    c = docs(spark, d).select(F.col("doc_id").alias("doc"), F.explode(T.code_blocks(F.col("text"))).alias("c")).select("doc", "c.lang", "c.code")
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("doc").alias("n_docs"), F.sum(F.length("code")).alias("chars"), F.sum(F.size(F.split("code", "\n")) - 1).alias("lines"))


@query(rf"""WITH c AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '{CODE}', 2)) AS code FROM documents), k AS (SELECT doc, md5(trim(regexp_replace(lower(code), '\s+', ' ', 'g'), ' ')) AS h, length(code) AS n FROM c)
SELECT h AS code_hash, count(*) AS n, count(DISTINCT doc) AS n_docs FROM k WHERE n > 20 GROUP BY h HAVING count(*) > 1""")
def code_duplicates(spark, d):
    c = docs(spark, d).select(F.col("doc_id").alias("doc"), F.explode(T.code_blocks(F.col("text"))).alias("c")).where(F.length("c.code") > 20)
    h = F.md5(F.trim(F.regexp_replace(F.lower("c.code"), r"\s+", " ")))
    return c.groupBy(h.alias("code_hash")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("n_docs")).where("n > 1")


@query(r"""SELECT doc_id AS doc, len(regexp_extract_all(text, '(?m)^([ \t]*\|[^\r\n]*\|[ \t]*)\r?$', 1))::INT AS table_rows FROM documents WHERE len(regexp_extract_all(text, '(?m)^([ \t]*\|[^\r\n]*\|[ \t]*)\r?$', 1)) > 0""")
def table_row_counts(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("doc"), F.size(T.table_rows(F.col("text"))).alias("table_rows")).where("table_rows > 0")


@query(r"""SELECT count(*) AS n_docs, sum((starts_with(text, '---'))::INT)::BIGINT AS with_front_matter, sum((contains(text, '```'))::INT)::BIGINT AS with_code, sum((regexp_matches(text, '(?m)^#{1,6} '))::INT)::BIGINT AS with_headings,
sum((regexp_matches(text, '(?m)^[ \t]*[-*+] '))::INT)::BIGINT AS with_lists, sum((contains(text, chr(13)))::INT)::BIGINT AS with_crlf, sum((text = '')::INT)::BIGINT AS empty, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM documents""")
def content_overview(spark, d):
    t = F.col("text")
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    return docs(spark, d).agg(
        F.count(F.lit(1)).alias("n_docs"), n(t.startswith("---"), "with_front_matter"), n(t.contains("```"), "with_code"), n(t.rlike("(?m)^#{1,6} "), "with_headings"),
        n(t.rlike(r"(?m)^[ \t]*[-*+] "), "with_lists"), n(t.contains("\r"), "with_crlf"), n(t == "", "empty"), F.sum(F.length(t)).alias("chars"), F.max(F.length(t)).cast("long").alias("longest"),
    )


# duplicates

NORM = r"trim(lower(regexp_replace(regexp_replace(text, '[#*`_\[\]()]', '', 'g'), '\s+', ' ', 'g')), ' ')"


@query(f"SELECT md5({NORM}) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    t = docs(spark, d).where("text IS NOT NULL").groupBy(T.fingerprint(F.col("text")).alias("fingerprint"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents) SELECT md5(line) AS line_hash, count(*) AS n, count(DISTINCT doc) AS n_docs FROM l WHERE length(line) > 40 GROUP BY 1 HAVING count(DISTINCT doc) > 1""")
def line_duplicates(spark, d):
    l = docs(spark, d).select(F.col("doc_id").alias("doc"), F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.length("line") > 40)
    return l.groupBy(F.md5("line").alias("line_hash")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("n_docs")).where("n_docs > 1")


@query("SELECT source, count(*) AS n, count(DISTINCT coalesce(category, '')) AS n_categories, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean_chars, epoch_us(min(fetched_at)) AS first_at, epoch_us(max(fetched_at)) AS last_at FROM documents GROUP BY source")
def source_stats(spark, d):
    return docs(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("category", F.lit(""))).alias("n_categories"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.unix_micros(F.min("fetched_at")).alias("first_at"), F.unix_micros(F.max("fetched_at")).alias("last_at"),
    )
