"""Paths, communities, comparisons and layouts of the article graph; evidence for joining orphans to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.operators import graph as G
from stackroom.operators import network as N
from stackroom.operators import similarity as S
from stackroom.plans.catalog import ART, arts
from stackroom.plans.links import E, U, net
from stackroom.session import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Sources of per-source searches: the articles whose id is divisible by 100.
ASKED = "src0 AS (SELECT DISTINCT path AS id FROM orphans_analysis WHERE record_id % 100 = 0 AND path IS NOT NULL)"
PATHS = f"""{E}, {ASKED}, p AS (SELECT id AS source, id AS target, [id] AS nodes FROM src0 UNION ALL SELECT p.source, e.dst, list_append(p.nodes, e.dst) FROM p JOIN e ON p.target = e.src WHERE len(p.nodes) < 5 AND NOT list_contains(p.nodes, e.dst)),
pp AS (SELECT * FROM p WHERE len(nodes) > 1)"""
DEG = "dg AS (SELECT nd.id, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree, coalesce(i.c, 0) AS i, coalesce(o.c, 0) AS o FROM nd LEFT JOIN (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS c FROM e GROUP BY 1) o USING (id))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def asked(spark, d):
    from stackroom.tables import table

    return table(spark, d, "orphans_analysis").where("record_id % 100 = 0").select(F.col("path").alias("id")).where("id IS NOT NULL").distinct()


@query(f"""WITH RECURSIVE {PATHS}, x AS (SELECT source, target, count(DISTINCT n) AS n_inner FROM (SELECT source, target, unnest(nodes[2:len(nodes) - 1]) AS n FROM pp) GROUP BY ALL)
SELECT source, target, count(*) AS n_paths, min(len(nodes))::INT AS least, max(len(nodes))::INT AS most, round(avg(len(nodes)), 6) AS mean, coalesce(any_value(n_inner), 0) AS n_inner FROM pp LEFT JOIN x USING (source, target) GROUP BY ALL""")
def all_paths(spark, d):
    """Simple paths of up to five nodes from every hundredth article, per pair of ends."""
    return N.path_diversity(N.simple_paths(net(spark, d)[1], asked(spark, d))).withColumn("mean", F.round("mean", 6))


@query(f"WITH {E}, {DEG} SELECT id, degree, degree * degree AS impact FROM dg")
def removal_impact(spark, d):
    return N.removal_impact(*net(spark, d))


@query(f"""WITH RECURSIVE {E}, {U}, {DEG}, top AS (SELECT id FROM dg ORDER BY degree DESC, id LIMIT 10), p AS (SELECT id AS source, id AS target, [id] AS nodes FROM top UNION ALL SELECT p.source, u.dst, list_append(p.nodes, u.dst) FROM p JOIN u ON p.target = u.src WHERE len(p.nodes) < 4 AND NOT list_contains(p.nodes, u.dst)),
x AS (SELECT source, target, nodes, unnest(nodes[2:len(nodes) - 1]) AS id FROM p WHERE len(nodes) > 2 AND target IN (SELECT id FROM top)) SELECT source, target, array_to_string(nodes, ' > ') AS path, round(avg(degree), 6) AS importance FROM x JOIN dg USING (id) GROUP BY ALL""")
def critical_paths(spark, d):
    n, e = net(spark, d)
    return N.critical_paths(n, e).select("source", "target", F.array_join("nodes", " > ").alias("path"), r6("importance", "importance"))


MEASURES = f"""{DEG}, ms AS (SELECT 'in_degree' AS measure, id, i::DOUBLE AS value FROM dg UNION ALL SELECT 'out_degree', id, o FROM dg UNION ALL SELECT 'degree', id, degree FROM dg UNION ALL SELECT 'pagerank', path, pagerank FROM art UNION ALL SELECT 'inlinks', path, inlinks FROM art UNION ALL SELECT 'outlinks', path, outlinks FROM art),
bst AS (SELECT measure, id FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, id) AS k FROM ms WHERE value IS NOT NULL AND id IS NOT NULL) WHERE k <= 10), nm AS (SELECT DISTINCT measure FROM bst)"""


@query(f"""WITH {E}, {ART}, {MEASURES} SELECT x.measure AS a, y.measure AS b, (SELECT count(*) FROM bst p JOIN bst q ON p.id = q.id WHERE p.measure = x.measure AND q.measure = y.measure) AS common FROM nm x JOIN nm y ON x.measure < y.measure""")
def centrality_overlap(spark, d):
    """How many of their ten first nodes six measures share."""
    deg, a = G.degrees(*net(spark, d)), arts(spark, d).where("path IS NOT NULL")
    of = lambda df, name, i, v: df.select(F.lit(name).alias("measure"), F.col(i).alias("id"), F.col(v).cast("double").alias("value"))
    parts = [of(deg, m, "id", m) for m in ("in_degree", "out_degree", "degree")] + [of(a, m, "path", m) for m in ("pagerank", "inlinks", "outlinks")]
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p)
    return N.measure_overlap(m)


def _louvain_sql(rounds: int) -> str:
    ctes = [E, U, "tw AS (SELECT count(*) AS m FROM u)", "kk AS (SELECT nd.id, count(u.src) AS k FROM nd LEFT JOIN u ON nd.id = u.src GROUP BY nd.id)", "s0 AS MATERIALIZED (SELECT id, id AS c, k FROM kk)"]
    for i in range(rounds):
        way = "<" if i % 2 == 0 else ">"
        ctes.append(f"""t{i} AS MATERIALIZED (SELECT c, sum(k) AS e FROM s{i} GROUP BY c), l{i} AS MATERIALIZED (SELECT u.src AS id, s.c, count(*) AS l FROM u JOIN s{i} s ON u.dst = s.id GROUP BY ALL),
g{i} AS (SELECT s.id, s.c AS own, s.k, l.c AS c, m * l.l - s.k * t.e AS gain FROM s{i} s JOIN l{i} l ON s.id = l.id AND l.c <> s.c JOIN t{i} t ON t.c = l.c, tw), b{i} AS (SELECT id, c, gain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, c) AS r FROM g{i}) WHERE r = 1),
s{i + 1} AS MATERIALIZED (SELECT s.id, CASE WHEN b.gain > m * coalesce(l.l, 0) - s.k * (t.e - s.k) AND b.c {way} s.c THEN b.c ELSE s.c END AS c, s.k FROM s{i} s JOIN t{i} t ON t.c = s.c LEFT JOIN l{i} l ON l.id = s.id AND l.c = s.c LEFT JOIN b{i} b ON b.id = s.id, tw)""")
    return f"WITH {', '.join(ctes)} SELECT id, c AS community FROM s{rounds}"


@query(_louvain_sql(4))
def louvain_level(spark, d):
    return N.louvain(*net(spark, d))


@query(f"WITH {E}, s AS (SELECT src, dst, string_split(src, '/') AS a, string_split(dst, '/') AS b FROM e), c AS (SELECT *, len(list_filter(range(1, 1 + least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS n FROM s) SELECT src, dst, array_to_string(a[1:n], '/') AS ancestor, (len(a) + len(b) - 2 * n)::INT AS steps FROM c")
def tree_paths(spark, d):
    """Common ancestor in the folder tree and steps between the ends of every link."""
    a, b = F.split("src", "/"), F.split("dst", "/")
    return net(spark, d)[1].select("src", "dst", F.array_join(N.common_ancestor(a, b), "/").alias("ancestor"), N.steps_between(a, b).alias("steps"))


CATS = "nt AS (SELECT category || '/' || subcategory AS node, unnest(tags) AS tag, id FROM art), sz AS (SELECT category || '/' || subcategory AS node, any_value(category) AS category, count(*) AS size FROM art GROUP BY 1), tt AS (SELECT DISTINCT node, tag FROM nt)"


@query(f"""WITH {ART}, {CATS}, cm AS (SELECT x.node AS a, y.node AS b, count(*) AS common FROM tt x JOIN tt y USING (tag) WHERE x.node <> y.node GROUP BY ALL), sc AS (SELECT a, b, common, CASE WHEN p.category = q.category THEN 8 ELSE 6 END + least(2 * common, 20) + CASE WHEN least(p.size, q.size) / greatest(p.size, q.size) > 0.5 THEN 5 ELSE 0 END AS score FROM cm JOIN sz p ON p.node = a JOIN sz q ON q.node = b)
SELECT a, b, common, score::INT AS score, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM sc) WHERE k <= 5""")
def related_categories(spark, d):
    """Five most similar taxonomy nodes of each: tree distance, common tags and likeness of size."""
    a = arts(spark, d).withColumn("node", F.concat_ws("/", "category", "subcategory"))
    size = a.groupBy("node").agg(F.first("category").alias("category"), F.count(F.lit(1)).alias("size"))
    t = a.select("node", F.explode("tags").alias("tag")).distinct()
    common = t.withColumnRenamed("node", "a").join(t.withColumnRenamed("node", "b"), "tag").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    p, q = (size.select(F.col("node").alias(x), F.col("category").alias(f"{x}_cat"), F.col("size").alias(f"{x}_size")) for x in "ab")
    j = common.join(p, "a").join(q, "b")
    score = F.when(F.col("a_cat") == F.col("b_cat"), 8).otherwise(6) + F.least(F.col("common") * 2, F.lit(20)) + F.when(F.least("a_size", "b_size") / F.greatest("a_size", "b_size") > 0.5, 5).otherwise(0)
    w = W.partitionBy("a").orderBy(F.desc("score"), "b")
    return j.withColumn("score", score.cast("int")).withColumn("k", F.row_number().over(w)).where("k <= 5").select("a", "b", "common", "score", "k")


@query(f"""WITH {ART}, {E}, ob AS (SELECT id, path, category, tags, regexp_replace(path, '[^/]*$', '') AS dir FROM art WHERE path IS NOT NULL AND path NOT IN (SELECT dst FROM e) AND id % 100 = 0), ot AS (SELECT id, unnest(tags) AS tag FROM ob), oat AS (SELECT id, unnest(tags) AS tag FROM art WHERE path IS NOT NULL),
cm AS (SELECT o.id AS orphan, a.id AS other, count(*) AS common FROM ot o JOIN oat a USING (tag) WHERE o.id <> a.id GROUP BY ALL), sc AS (SELECT orphan, other, 2 * common + CASE WHEN o.category = a.category THEN 3 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = o.path AND dst = a.path) THEN 5 ELSE 0 END + CASE WHEN o.dir = regexp_replace(a.path, '[^/]*$', '') THEN 1 ELSE 0 END + CASE WHEN a.outlinks > 5 THEN 1 ELSE 0 END AS score FROM cm JOIN ob o ON o.id = orphan JOIN art a ON a.id = other)
SELECT orphan, other, score::INT AS score, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY score DESC, other) AS k FROM sc) WHERE k <= 5""")
def integration_candidates(spark, d):
    """Five articles that best take up each unlinked article (ids divisible by 100): tags, category, link, folder, hub."""
    e = net(spark, d)[1]
    a = arts(spark, d).where("path IS NOT NULL").select(
        "id", "path", S.hashed(F.col("tags")).alias("tags"), F.array(F.xxhash64("path")).alias("places"), F.xxhash64("category").alias("category"),
        F.xxhash64(F.regexp_replace("path", "[^/]*$", "")).alias("dir"), F.coalesce(F.col("outlinks") > 5, F.lit(False)).cast("long").alias("hub"),
    )
    a = materialize(a.repartition(4 * spark.sparkContext.defaultParallelism), "articles")
    o = a.where("id % 100 = 0").join(e.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    to = o.select(F.col("path").alias("src")).distinct().join(e, "src").groupBy(F.col("src").alias("path")).agg(F.collect_set(F.xxhash64("dst")).alias("linked"))
    o = o.join(to, "path", "left").withColumn("places", F.coalesce("linked", F.array().cast("array<bigint>")))

    def score(common, sizes, query_sizes, plain, query_plain):
        got = 2 * common[0] + 3 * (plain[0] == query_plain[0]) + 5 * (common[1] > 0) + (plain[1] == query_plain[1]) + plain[2]
        return np.where(common[0] > 0, got, np.nan)

    s = S.answers(a.drop("path"), o, ["tags", "places"], score, 5).select(F.col("query_id").alias("orphan"), F.col("id").alias("other"), F.col("score").cast("int").alias("score"))
    return s.withColumn("k", F.row_number().over(W.partitionBy("orphan").orderBy(F.desc("score"), "other"))).where("k <= 5").select("orphan", "other", "score", "k")


@query(f"""WITH {E}, {DEG}, t AS (SELECT id, (row_number() OVER (ORDER BY degree DESC, id) - 1)::INT AS rank FROM dg ORDER BY degree DESC, id LIMIT 50)
SELECT id, rank, round(400 + 250 * cos(rank * (2 * 3.141592653589793 / 50)), 4) AS circle_x, round(300 + 250 * sin(rank * (2 * 3.141592653589793 / 50)), 4) AS circle_y, round((rank % 8) * 100.0 + 50, 4)::DOUBLE AS grid_x, round((rank // 8) * 75.0 + 37.5, 4)::DOUBLE AS grid_y FROM t""")
def hub_layout(spark, d):
    """Places of the fifty greatest hubs on a circle and on a grid."""
    top = G.degrees(*net(spark, d)).orderBy(F.desc("degree"), "id").limit(50)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("degree"), "id")) - 1)  # fifty rows
    out = N.circular_layout(ranked, 50)
    return out.select("id", "rank", *[F.round(c, 4).alias(c) for c in ("circle_x", "circle_y", "grid_x", "grid_y")])
