"""Queries on similarity: near-duplicates, titles, hybrid recommendations, vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.functions import text as T
from stackroom.operators import catalog as C
from stackroom.operators import similarity as S
from stackroom.plans.catalog import ART, TAGS, arts
from stackroom.plans.corpus import WORDS
from stackroom.session import materialize
from stackroom.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def near_duplicate_classes(spark, d):
    """Tested against brute force; one row per document."""
    return S.near_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query()
def simhash_signatures(spark, d):
    """Tested against Python on a fixture."""
    return table(spark, d, "documents").select("doc_id", S.simhash(T.words(F.col("text"))).alias("simhash"))


TW = "tw AS (SELECT id, title, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''))) AS ws FROM art)"


@query(f"""WITH {ART}, {TW}, q AS (SELECT * FROM tw WHERE id % 100 = 0), p AS (SELECT q.id AS query_id, tw.id AS id, len(list_intersect(q.ws, tw.ws)) / len(list_distinct(list_concat(q.ws, tw.ws))) AS similarity FROM q JOIN tw ON list_has_any(q.ws, tw.ws) AND q.id <> tw.id) SELECT query_id, id, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.5""")
def similar_titles(spark, d):
    """Titles of every hundredth id against all, by shared words."""
    t = arts(spark, d).select("id", F.array_distinct(T.words(F.col("title"))).alias("ws"))
    q = t.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("ws").alias("qs"), F.explode("ws").alias("w"))
    hit = q.join(t.select("id", "ws", F.explode("ws").alias("w")), "w").where("query_id <> id").select("query_id", "id", "qs", "ws").distinct()
    return hit.select("query_id", "id", F.round(S.jaccard(F.col("qs"), F.col("ws")), 6).alias("similarity")).where("similarity >= 0.5")


@query(f"""WITH {ART}, {TAGS}, q AS (SELECT id AS query_id, category AS qc, unnest(tags) AS tag FROM art WHERE id % 100 = 0), p AS (SELECT query_id, id, count(*) AS common, max((qc = category)::INT) AS same FROM q JOIN tg USING (tag) WHERE query_id <> id GROUP BY ALL),
s AS (SELECT query_id, id, 10 * common + 20 * same AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score::BIGINT AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def recommend_by_tags(spark, d):
    """For every hundredth article the five with most common tags and the same category."""
    t = C.article_tags(arts(spark, d)).select("id", "category", "tag")
    q = t.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("category").alias("qc"), "tag")
    p = q.join(t, "tag").where("query_id <> id").groupBy("query_id", "id").agg((F.count(F.lit(1)) * 10 + F.max((F.col("qc") == F.col("category")).cast("int")) * 20).alias("score"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 5")


@query(f"""WITH {ART}, {TW}, x AS (SELECT art.id, tags, ws, category, subcategory FROM art JOIN tw USING (id)), q AS (SELECT * FROM x),
p AS (SELECT q.id AS query_id, x.id AS id, 0.5::DOUBLE * len(list_intersect(q.tags, x.tags)) / greatest(len(list_distinct(list_concat(q.tags, x.tags))), 1) + 0.3::DOUBLE * len(list_intersect(q.ws, x.ws)) / greatest(len(list_distinct(list_concat(q.ws, x.ws))), 1)
+ 0.2::DOUBLE * least(1, (q.category = x.category)::INT + 0.5::DOUBLE * (q.subcategory = x.subcategory)::INT) AS score FROM q JOIN x ON q.id <> x.id AND (list_has_any(q.tags, x.tags) OR list_has_any(q.ws, x.ws))),
r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM p) SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def hybrid_related(spark, d):
    """Tags, title words and category weighed together, for every article; candidates share a tag or a title word."""
    x = arts(spark, d).select("id", S.hashed(F.col("tags")).alias("tags"), S.hashed(T.words(F.col("title"))).alias("ws"), F.xxhash64("category").alias("category"), F.xxhash64("subcategory").alias("subcategory"))
    return S.related(x, 5)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id AS id, list_cosine_similarity(qv, embedding::DOUBLE[]) AS cosine FROM q JOIN embeddings ON query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM p) SELECT query_id, id, round(cosine, 6) AS cosine, rank::INT AS rank FROM r WHERE rank <= 5""")
def vector_neighbours(spark, d):
    v = table(spark, d, "embeddings")
    return S.cosine_to(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), 5).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"""WITH w AS (SELECT doc_id AS id, list_distinct({WORDS}) AS ws FROM documents), q AS (SELECT id AS query_id, ws AS qs FROM w WHERE id % 100 = 0), p AS (SELECT query_id, id, len(list_intersect(qs, ws)) / len(list_distinct(list_concat(qs, ws))) AS similarity FROM q JOIN w ON query_id <> id AND len(ws) > 0 AND len(qs) > 0)
SELECT query_id, id, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.6""")
def similar_word_sets(spark, d):
    """Word-set Jaccard of every hundredth document against all; words count as their 64-bit hashes."""
    w = table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.hashed(T.words(F.col("text"))).alias("ws")).where(F.size("ws") > 0)

    def score(common, sizes, query_sizes, plain, query_plain):
        s = common[0] / (sizes[0] + query_sizes[0] - common[0])
        return np.where(s >= 0.6, s, np.nan)

    return S.answers(w, w.where("id % 100 = 0"), ["ws"], score).select("query_id", "id", F.round("score", 6).alias("similarity"))
