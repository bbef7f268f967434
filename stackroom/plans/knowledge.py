"""Entities, relations, glossary, classes, topics, metrics of pairs and what is read together."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions import text as T
from stackroom.operators import knowledge as K
from stackroom.plans.catalog import ART, arts
from stackroom.plans.markup import EXC, MD, _excerpts
from stackroom.tables import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Words taken for entities.
DICTIONARY = ["server", "сервер", "фильтр", "filter", "index", "индекс", "pipeline", "garden", "broth", "омлет", "шлюз", "термостат", "чайник", "kettle"]
INLIST = ", ".join(f"'{w}'" for w in DICTIONARY)
WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
ENT = rf"""wd AS (SELECT doc_id AS doc, unnest({WORDS.format("text")}) AS w FROM documents WHERE text IS NOT NULL), hd AS (SELECT doc_id AS doc, lower(trim(unnest(regexp_extract_all(text, '(?m)^#{{1,6}}[ \t]+([^\r\n]+)', 1)))) AS h FROM documents),
en AS (SELECT doc, w AS entity, 'term' AS kind, count(*) AS mentions FROM wd WHERE w IN ({INLIST}) GROUP BY ALL UNION ALL SELECT doc, h, 'heading', count(*) FROM hd WHERE h <> '' GROUP BY ALL),
st AS (SELECT list_sort(list_distinct(list_filter({WORDS.format("s")}, lambda x: x IN ({INLIST})))) AS e FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[.!?]+')) AS s FROM documents)),
rl AS (SELECT a, b, count(*) AS n FROM (SELECT a, unnest(list_filter(e, lambda y: y > a)) AS b FROM (SELECT e, unnest(e) AS a FROM st)) GROUP BY ALL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _ent(spark, d):
    return K.entities(table(spark, d, "documents"), "doc_id", "text", DICTIONARY)


def _rel(spark, d):
    return K.sentence_relations(table(spark, d, "documents"), "doc_id", "text", DICTIONARY)


@query(f"WITH {ENT} SELECT kind, entity, sum(mentions)::BIGINT AS mentions, count(DISTINCT doc) AS n_docs FROM en GROUP BY ALL HAVING count(DISTINCT doc) > 1")
def entity_mentions(spark, d):
    return _ent(spark, d).groupBy("kind", "entity").agg(F.sum("mentions").alias("mentions"), F.countDistinct("doc").alias("n_docs")).where("n_docs > 1")


@query(f"WITH {ENT} SELECT a, b, n FROM rl")
def entity_relations(spark, d):
    return _rel(spark, d)


@query(f"WITH {ENT}, m AS (SELECT entity, sum(mentions)::BIGINT AS mentions FROM en WHERE kind = 'term' GROUP BY 1), r AS (SELECT entity, count(*) AS n FROM (SELECT a AS entity FROM rl UNION ALL SELECT b FROM rl) GROUP BY 1) SELECT entity, mentions, coalesce(n, 0) AS n_relations, mentions + 2 * coalesce(n, 0) AS importance FROM m LEFT JOIN r USING (entity)")
def entity_importance(spark, d):
    return K.importance(_ent(spark, d).where("kind = 'term'"), _rel(spark, d))


@query(f"WITH {ENT}, nm AS (SELECT * FROM (VALUES ('сервер', 'server'), ('фильтр', 'filter'), ('индекс', 'index'), ('чайник', 'kettle')) AS v(alias, name)) SELECT coalesce(name, entity) AS entity, sum(mentions)::BIGINT AS mentions, count(DISTINCT doc) AS n_docs, count(DISTINCT entity) AS aliases FROM en LEFT JOIN nm ON alias = entity WHERE kind = 'term' GROUP BY coalesce(name, entity)")
def merged_entities(spark, d):
    """Entities of two languages under one name."""
    names = spark.createDataFrame([("сервер", "server"), ("фильтр", "filter"), ("индекс", "index"), ("чайник", "kettle")], "alias string, name string")
    return K.merge_entities(_ent(spark, d).where("kind = 'term'"), names)


GL = f"""{MD}, {EXC}, df AS (SELECT id AS article, trim(split_part(text, ' — это ', 1)) AS term, trim(split_part(text, ' — это ', 2)) AS definition FROM ex WHERE kind = 'definition'),
gl AS (SELECT term, arg_min(definition, (article, definition)) AS definition, count(DISTINCT article) AS n_articles, count(*) AS n_uses FROM df WHERE term <> '' GROUP BY term),
gq AS (SELECT *, n_articles * 2 + n_uses AS importance, (CASE WHEN length(definition) >= 20 THEN 40 WHEN length(definition) >= 10 THEN 20 ELSE 0 END + CASE WHEN contains(lower(definition), lower(term)) THEN 0 ELSE 30 END + CASE WHEN len(string_split_regex(trim(definition), '\\s+')) > 2 THEN 30 ELSE 0 END)::INT AS quality FROM gl)"""


def _glossary(spark, d):
    e = _excerpts(spark, d).where("kind = 'definition'")
    part = lambda i: F.trim(F.split("text", " — это ")[i])
    return K.glossary(e.select(F.col("id").alias("article"), part(0).alias("term"), part(1).alias("definition")))


@query(f"WITH {GL} SELECT term, definition, n_articles, n_uses, importance, quality FROM gq")
def glossary_terms(spark, d):
    return _glossary(spark, d)


@query(f"WITH {GL} SELECT CASE WHEN quality >= 70 THEN 'good' WHEN quality >= 40 THEN 'fair' ELSE 'poor' END AS grade, count(*) AS n, round(avg(quality), 6) AS mean_quality, 'https://en.wikipedia.org/wiki/' || replace(min(term), ' ', '_') AS first_link FROM gq GROUP BY 1")
def glossary_quality(spark, d):
    q = F.col("quality")
    g = _glossary(spark, d).groupBy(F.when(q >= 70, "good").when(q >= 40, "fair").otherwise("poor").alias("grade")).agg(n(), F.round(F.avg("quality"), 6).alias("mean_quality"), F.min("term").alias("t"))
    return g.select("grade", "n", "mean_quality", F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("t", F.lit(" "), F.lit("_"))).alias("first_link"))


CLS = " UNION ALL ".join(f"SELECT id, '{c}' AS class, '{no}' AS number, len(list_filter(tags_w, lambda x: x IN ({', '.join(repr(k) for k in ks)}))) + 3 * len(list_filter(title_w, lambda x: x IN ({', '.join(repr(k) for k in ks)}))) AS score FROM cw" for c, (no, ks) in sorted(K.CLASSES.items()))
CLASSED = f"""cw AS (SELECT id, {WORDS.format("array_to_string(tags, ' ')")} AS tags_w, {WORDS.format("title")} AS title_w FROM art), cs AS ({CLS}), bs AS (SELECT id, class, number, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS r FROM cs WHERE score > 0) WHERE r = 1)"""


def _classed(spark, d):
    c = K.classify(T.words(F.array_join("tags", " ")), T.words(F.col("title")))
    return arts(spark, d).select("id", c.alias("c")).where("c IS NOT NULL").select("id", "c.class", "c.number", "c.score")


@query(f"WITH {ART}, {CLASSED} SELECT id, class, number, score::INT AS score, CASE left(number, 1) WHEN '0' THEN 'Z' WHEN '6' THEN 'T' ELSE 'A' END AS other FROM bs")
def keyword_classes(spark, d):
    """Class of each article by keywords in title and tags, with its numbers in two classifications."""
    return _classed(spark, d).withColumn("other", K.other_code(F.col("number")))


@query(f"WITH {ART}, {CLASSED} SELECT number, class, count(*) AS n, round(avg(score), 6) AS mean_score FROM bs GROUP BY ALL")
def class_index(spark, d):
    return _classed(spark, d).groupBy("number", "class").agg(n(), F.round(F.avg("score"), 6).alias("mean_score"))


KW = rf"kw AS (SELECT doc_id AS doc, unnest({WORDS.format('text')}) AS word FROM documents), kf AS (SELECT doc, word, count(*) AS n FROM kw WHERE length(word) >= 4 AND word NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) GROUP BY ALL), kr AS (SELECT doc, word, n, row_number() OVER (PARTITION BY doc ORDER BY n DESC, word) AS r FROM kf)"


def _keywords(spark, d, top):
    from pyspark.sql import Window as W

    w = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(T.words(F.col("text"), 4, stop_words=True)).alias("word")).groupBy("doc", "word").agg(n())
    return w.withColumn("r", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top)


@query(f"WITH {KW}, k AS (SELECT doc, word FROM kr WHERE r <= 10) SELECT x.word AS a, y.word AS b, count(*) AS n FROM k x JOIN k y ON x.doc = y.doc AND x.word < y.word GROUP BY ALL HAVING count(*) >= 3")
def keyword_cooccurrence(spark, d):
    """Pairs among the ten best keywords of each document, in three documents at least."""
    return K.keyword_pairs(_keywords(spark, d, 10))


@query(f"WITH {KW}, c AS (SELECT coalesce(category, '-') AS category, word, count(*) AS n FROM (SELECT doc, word FROM kr WHERE r <= 5) JOIN documents ON doc = doc_id GROUP BY ALL) SELECT category, word, n, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS k FROM c) WHERE k <= 10")
def cluster_topics(spark, d):
    """Ten words that most documents of a category have among their five best."""
    from pyspark.sql import Window as W

    cat = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("category", F.lit("-")).alias("category"))
    c = _keywords(spark, d, 5).join(cat, "doc").groupBy("category", "word").agg(n())
    return c.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "word"))).where("k <= 10")


@query(f"WITH {KW}, t AS (SELECT doc, (r - 1) % 3 AS topic, word, r FROM kr WHERE r <= 9) SELECT doc, topic::INT AS topic, string_agg(word, ' ' ORDER BY r) AS words FROM t GROUP BY ALL")
def document_topics(spark, d):
    return K.topics(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH m AS (SELECT DISTINCT hash, message FROM recent_changes WHERE message IS NOT NULL), s AS (SELECT *, lower(message) AS t FROM m), i AS (SELECT least(10, 5 + CASE WHEN regexp_matches(t, 'fix|todo|важно|important|urgent') THEN 2 ELSE 0 END + CASE WHEN contains(t, '?') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, 'https?://') THEN 1 ELSE 0 END + CASE WHEN length(t) > 40 THEN 1 ELSE 0 END) AS importance, length(t) AS chars FROM s)
SELECT importance::INT AS importance, count(*) AS n, round(avg(chars), 6) AS mean_chars FROM i GROUP BY 1""")
def note_importance(spark, d):
    """Change messages as notes, by importance."""
    m = table(spark, d, "recent_changes").select("hash", "message").where("message IS NOT NULL").distinct()
    return m.groupBy(K.note_importance(F.col("message")).alias("importance")).agg(n(), F.round(F.avg(F.length("message")), 6).alias("mean_chars"))


CURT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY exported_at DESC) AS rn FROM thesaurus) WHERE rn = 1), tw AS (SELECT term_id, term, list_distinct(list_filter(string_split_regex(lower(term), '[ _-]+'), lambda x: x <> '')) AS ws, list_distinct(list_transform(range(1, length(term)), lambda i: substring(lower(term), i, 2))) AS bg FROM cur WHERE term IS NOT NULL), te AS (SELECT term_id, unnest(ws) AS w FROM tw)"
PAIRED = f"""{CURT}, cn AS (SELECT a.term_id AS a, b.term_id AS b, count(*) AS common FROM te a JOIN te b USING (w) WHERE a.term_id % 100 = 0 AND a.term_id <> b.term_id GROUP BY ALL),
mt AS (SELECT a, b, round(common / (len(x.ws) + len(y.ws) - common), 6) AS jaccard, round(len(list_intersect(x.bg, y.bg)) / len(list_distinct(list_concat(x.bg, y.bg))), 6) AS bigrams, round(common / least(len(x.ws), len(y.ws)), 6) AS overlap FROM cn JOIN tw x ON x.term_id = a JOIN tw y ON y.term_id = b)"""


def _metrics(spark, d):
    t = latest(table(spark, d, "thesaurus"), "term_id", "exported_at", F.col("term")).where("term IS NOT NULL")
    t = t.withColumn("ws", F.array_distinct(F.filter(F.split(F.lower("term"), "[ _-]+"), lambda x: x != "")))
    e = t.select("term_id", F.explode("ws").alias("w"))
    cn = e.where("term_id % 100 = 0").withColumnRenamed("term_id", "a").join(e.withColumnRenamed("term_id", "b"), "w").where("a <> b").groupBy("a", "b").agg(n("common"))
    x, y = (t.select(F.col("term_id").alias(s), T.shingles(F.lower("term"), 2).alias(f"t{s}"), F.size("ws").alias(f"n{s}")) for s in "ab")
    j = cn.join(x, "a").join(y, "b")
    return j.select(
        "a", "b", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"),
        F.round(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")), 6).alias("bigrams"), F.round(F.col("common") / F.least("na", "nb"), 6).alias("overlap"),
    )


@query(f"WITH {PAIRED} SELECT a, b, jaccard, bigrams, overlap, greatest(jaccard, bigrams, overlap) - least(jaccard, bigrams, overlap) >= 0.3 AS disagree FROM mt")
def metric_comparison(spark, d):
    """Three likenesses of terms with each hundredth term, and where they disagree by 0.3 or more."""
    spread = F.greatest("jaccard", "bigrams", "overlap") - F.least("jaccard", "bigrams", "overlap")
    return _metrics(spark, d).withColumn("disagree", spread >= 0.3)


@query(f"WITH {PAIRED}, l AS (SELECT 'jaccard' AS metric, jaccard AS v FROM mt UNION ALL SELECT 'bigrams', bigrams FROM mt UNION ALL SELECT 'overlap', overlap FROM mt) SELECT metric, least(4, floor(v * 5))::INT AS bin, count(*) AS n, round(avg(v), 3) AS mean FROM l GROUP BY ALL")
def similarity_histogram(spark, d):
    """Likenesses in five bins, 1.0 in the last."""
    l = _metrics(spark, d).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("jaccard", "bigrams", "overlap")])).alias("l")).select("l.*")
    return l.groupBy("metric", F.least(F.lit(4), F.floor(F.col("v") * 5)).cast("int").alias("bin")).agg(n(), F.round(F.avg("v"), 3).alias("mean"))


@query(f"WITH {PAIRED}, a AS (SELECT CASE WHEN bigrams >= 0.7 THEN 'delete' WHEN jaccard >= 0.5 THEN 'merge' WHEN overlap >= 0.5 THEN 'link' ELSE 'keep' END AS action FROM mt) SELECT action, count(*) AS n FROM a GROUP BY 1")
def merge_plan(spark, d):
    """What to do with pairs of like terms."""
    act = F.when(F.col("bigrams") >= 0.7, "delete").when(F.col("jaccard") >= 0.5, "merge").when(F.col("overlap") >= 0.5, "link").otherwise("keep")
    return _metrics(spark, d).groupBy(act.alias("action")).agg(n())


@query(f"WITH {PAIRED} SELECT a AS term_id, b AS see_id, jaccard, CASE WHEN jaccard >= 0.8 THEN 'strong' WHEN jaccard >= 0.5 THEN 'medium' ELSE 'weak' END AS strength FROM mt WHERE jaccard > 0.3")
def see_redirects(spark, d):
    """Terms so like each hundredth one that one may point to the other."""
    j = F.col("jaccard")
    m = _metrics(spark, d).where(j > 0.3)
    return m.select(F.col("a").alias("term_id"), F.col("b").alias("see_id"), "jaccard", F.when(j >= 0.8, "strong").when(j >= 0.5, "medium").otherwise("weak").alias("strength"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS reader, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT item, count(*) AS readers FROM p GROUP BY 1), c AS (SELECT a.item, b.item AS other, count(*) AS common FROM p a JOIN p b USING (reader) WHERE a.item % 100 = 0 AND a.item <> b.item GROUP BY ALL)
SELECT c.item, other, common, round(1 - common / readers, 6) AS surprise, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY common DESC, other) AS k FROM c) c JOIN s ON s.item = c.other WHERE k <= 5""")
def read_together(spark, d):
    """What the customers of every hundredth part also bought, five each."""
    l, o = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("reader"))
    p = l.join(o, "l_orderkey").select("reader", "item")
    return K.together(p, p.select("item").where("item % 100 = 0")).withColumn("surprise", F.round("surprise", 6))
