"""Graph queries: suggested-article links and the supplier-part network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.operators import graph as G
from stackroom.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Edges path -> similar article and nodes in SQL.
E = """e AS (SELECT DISTINCT path AS src, dst FROM (SELECT path, unnest(similar_articles) AS dst FROM tagging_suggestions) WHERE path IS NOT NULL AND dst IS NOT NULL AND path <> dst),
nd AS (SELECT DISTINCT path AS id FROM orphans_analysis WHERE path IS NOT NULL UNION SELECT src FROM e UNION SELECT dst FROM e)"""
U = "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
SP = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def net(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = G.simple(table(spark, d, "tagging_suggestions").select(F.col("path").alias("src"), F.explode("similar_articles").alias("dst")))
    paths = table(spark, d, "orphans_analysis").select(F.col("path").alias("id")).where("id IS NOT NULL")
    return paths.unionByName(G.nodes_of(e)).distinct(), e


def r6(name: str):
    return F.round(name, 6).alias(name)


@query(f"WITH {E}, i AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1), o AS (SELECT src AS id, count(*) AS c FROM e GROUP BY 1) SELECT id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM nd LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def degree_centrality(spark, d):
    return G.degrees(*net(spark, d))


@query(f"WITH {E}, i AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1) SELECT coalesce(c, 0) AS in_degree, count(*) AS n FROM nd LEFT JOIN i USING (id) GROUP BY 1")
def backlink_distribution(spark, d):
    return G.degrees(*net(spark, d)).groupBy("in_degree").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E}, i AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1) SELECT id, c AS in_degree FROM i WHERE c >= 3 ORDER BY c DESC, id LIMIT 10")
def citation_hubs(spark, d):
    return G.degrees(*net(spark, d)).where("in_degree >= 3").orderBy(F.desc("in_degree"), "id").limit(10).select("id", "in_degree")


@query(f"WITH {E} SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1)), 9) AS density")
def graph_properties(spark, d):
    return G.properties(*net(spark, d)).withColumn("density", F.round("density", 9))


@query(f"WITH {E} SELECT id FROM nd WHERE id NOT IN (SELECT dst FROM e) AND id NOT IN (SELECT src FROM e)")
def isolated_articles(spark, d):
    return G.degrees(*net(spark, d)).where("degree = 0").select("id")


@query(f"WITH {E} SELECT id FROM nd WHERE id NOT IN (SELECT dst FROM e)")
def orphaned_articles(spark, d):
    n, e = net(spark, d)
    return n.join(e.select(F.col("dst").alias("id")), "id", "left_anti")


@query("""WITH t AS (SELECT event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events), e AS (SELECT DISTINCT src, dst FROM t WHERE src <> dst)
SELECT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""")
def mutual_links(spark, d):
    """Event types that follow each other in both orders."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return G.mutual(table(spark, d, "events").select(F.lag("event_type").over(w).alias("src"), F.col("event_type").alias("dst")))


@query(f"WITH {E} SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL")
def cocitations(spark, d):
    return G.cocitation(net(spark, d)[1], 1)


@query(f"WITH {SP} SELECT x.src AS a, y.src AS b, count(*) AS n FROM e x JOIN e y ON x.dst = y.dst AND x.src <> y.src WHERE x.src % 100 = 0 GROUP BY ALL HAVING count(*) >= 5")
def bibliographic_coupling(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10**12).alias("dst"))
    return G.coupling(e, 5, e.where("src % 100 = 0").select(F.col("src").alias("id")))


@query(f"WITH {E}, i AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1), x AS (SELECT e.dst AS id, coalesce(i.c, 0) AS c FROM e LEFT JOIN i ON e.src = i.id), r AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY c DESC) AS k FROM x) SELECT id, max(least(c, k))::BIGINT AS h, sum((c >= 10)::INT)::BIGINT AS i10, count(*) AS n_citing FROM r GROUP BY id")
def citation_h_index(spark, d):
    return G.h_index(net(spark, d)[1])


def _pr_sql(rounds: int, teleport: str, start: str, tail: str) -> str:
    ctes = [E, "n AS (SELECT count(*) AS n FROM nd)", f"t AS MATERIALIZED (SELECT id, {teleport} AS t FROM nd, n)", "o AS (SELECT src, count(*) AS o FROM e GROUP BY 1)", "eo AS MATERIALIZED (SELECT e.src, e.dst, o FROM e JOIN o USING (src))", f"r0 AS MATERIALIZED (SELECT id, {start} AS rank FROM t)"]
    for i in range(rounds):
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT t.id, 0.15::DOUBLE * t.t + 0.85::DOUBLE * coalesce(f.f, 0) AS rank FROM t LEFT JOIN (SELECT dst AS id, sum(rank / o) AS f FROM eo JOIN r{i} ON eo.src = r{i}.id GROUP BY 1) f USING (id))")
    return f"WITH {', '.join(ctes)} {tail.format(r=f'r{rounds}')}"


@query(_pr_sql(20, "1.0::DOUBLE / n", "t", "SELECT id, round(rank, 9) AS rank FROM {r}"))
def pagerank20(spark, d):
    return G.pagerank(*net(spark, d)).select("id", F.round("rank", 9).alias("rank"))


SEED = "(SELECT count(*) FROM nd WHERE contains(id, '/index/'))"


@query(_pr_sql(10, f"CASE WHEN contains(id, '/index/') THEN 1.0::DOUBLE / {SEED} ELSE 0 END", "t", "SELECT id, round(rank, 9) AS rank FROM {r} WHERE rank > 0"))
def personalized_pagerank(spark, d):
    n, e = net(spark, d)
    return G.pagerank(n, e, 10, seeds=n.where(F.col("id").contains("/index/"))).where("rank > 0").select("id", F.round("rank", 9).alias("rank"))


def _hits_sql(rounds: int) -> str:
    ctes = [E, "s0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM nd)"]
    for i in range(rounds):
        ctes.append(f"""s{i + 1} AS MATERIALIZED (SELECT id, h / sqrt(sum(h * h) OVER ()) AS hub, a / sqrt(sum(a * a) OVER ()) AS authority FROM (SELECT nd.id, coalesce(h.v, 0) AS h, coalesce(a.v, 0) AS a FROM nd
LEFT JOIN (SELECT dst AS id, sum(hub) AS v FROM e JOIN s{i} ON e.src = s{i}.id GROUP BY 1) a USING (id) LEFT JOIN (SELECT src AS id, sum(authority) AS v FROM e JOIN s{i} ON e.dst = s{i}.id GROUP BY 1) h USING (id)))""")
    return f"WITH {', '.join(ctes)} SELECT id, round(hub, 6) AS hub, round(authority, 6) AS authority FROM s{rounds}"


@query(_hits_sql(4))
def hubs_authorities(spark, d):
    return G.hits(*net(spark, d), 4).select("id", r6("hub"), r6("authority"))


def _katz_sql(rounds: int) -> str:
    ctes = [E, "k0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS katz FROM nd)"]
    for i in range(rounds):
        ctes.append(f"k{i + 1} AS MATERIALIZED (SELECT nd.id, 0.1::DOUBLE * coalesce(f.v, 0) + 1 AS katz FROM nd LEFT JOIN (SELECT dst AS id, sum(katz) AS v FROM e JOIN k{i} ON e.src = k{i}.id GROUP BY 1) f USING (id))")
    return f"WITH {', '.join(ctes)} SELECT id, round(katz, 6) AS katz FROM k{rounds}"


@query(_katz_sql(6))
def katz_centrality(spark, d):
    return G.katz(*net(spark, d), 6).select("id", r6("katz"))


@query(f"WITH RECURSIVE {E}, {U}, c AS (SELECT id, id AS component FROM nd UNION SELECT u.dst, c.component FROM c JOIN u ON c.id = u.src) SELECT id, min(component) AS component FROM c GROUP BY id")
def connected_components(spark, d):
    return G.components(*net(spark, d))


@query(f"WITH RECURSIVE {E}, {U}, c AS (SELECT id, id AS component FROM nd UNION SELECT u.dst, c.component FROM c JOIN u ON c.id = u.src), m AS (SELECT id, min(component) AS component FROM c GROUP BY id), s AS (SELECT component, count(*) AS size FROM m GROUP BY 1) SELECT size, count(*) AS n FROM s GROUP BY size")
def component_sizes(spark, d):
    return G.components(*net(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E}, {U}, dg AS (SELECT src AS id, count(*) AS degree FROM u GROUP BY 1), t AS (SELECT a.src AS id, count(*) / 2 AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src GROUP BY 1)
SELECT id, coalesce(degree, 0) AS degree, coalesce(triangles, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) * 2 / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM nd LEFT JOIN dg USING (id) LEFT JOIN t USING (id)""")
def clustering_coefficient(spark, d):
    return G.clustering(*net(spark, d)).select("id", "degree", "triangles", r6("clustering"))


def _lpa_sql(rounds: int) -> str:
    ctes = [E, U, "l0 AS MATERIALIZED (SELECT id, id AS label FROM nd)"]
    for i in range(rounds):
        ctes.append(f"""l{i + 1} AS MATERIALIZED (SELECT nd.id, coalesce(b.label, nd.id) AS label FROM nd LEFT JOIN (SELECT src AS id, label, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS k FROM (SELECT src, label, count(*) AS n FROM u JOIN l{i} ON u.dst = l{i}.id GROUP BY ALL)) b ON nd.id = b.id AND b.k = 1)""")
    return ", ".join(ctes)


@query(f"WITH {_lpa_sql(4)} SELECT id, label FROM l4")
def label_propagation(spark, d):
    return G.label_propagation(*net(spark, d), 4)


@query(f"""WITH {_lpa_sql(4)}, x AS (SELECT a.label AS a, b.label AS b FROM u JOIN l4 a ON u.src = a.id JOIN l4 b ON u.dst = b.id), m AS (SELECT count(*) AS m FROM u), p AS (SELECT a, sum((a = b)::INT) AS inside, count(*) AS ends FROM x GROUP BY a) SELECT round(sum(inside / m - (ends / m) ** 2), 6) AS modularity, count(*) AS n_communities FROM p, m""")
def modularity(spark, d):
    n, e = net(spark, d)
    return G.modularity(e, G.label_propagation(n, e, 4)).select(r6("modularity"), "n_communities")


#: Sources of per-source searches: the articles whose id is divisible by 100, followed until no path goes further.
START = "(SELECT DISTINCT path AS id FROM orphans_analysis WHERE record_id % 100 = 0 AND path IS NOT NULL)"
BFS = f"WITH RECURSIVE {E}, b(source, id, distance) AS (SELECT id AS source, id, 0 AS distance FROM {START} UNION SELECT b.source, e.dst, b.distance + 1 FROM b JOIN e ON b.id = e.src WHERE b.distance < (SELECT count(*) FROM nd)), m AS (SELECT source, id, min(distance)::INT AS distance FROM b GROUP BY ALL)"


def _start(spark, d):
    return table(spark, d, "orphans_analysis").where("record_id % 100 = 0").select(F.col("path").alias("id")).where("id IS NOT NULL").distinct()


@query(f"{BFS} SELECT * FROM m")
def shortest_distances(spark, d):
    e = net(spark, d)[1]
    return G.distances(e, _start(spark, d))


@query(f"{BFS} SELECT source AS id, count(*) AS reach, round(count(*) / sum(distance), 6) AS closeness, round(sum(1 / distance), 6) AS harmonic FROM m WHERE distance > 0 GROUP BY source")
def closeness_harmonic(spark, d):
    e = net(spark, d)[1]
    return G.closeness(e, _start(spark, d)).select("id", "reach", r6("closeness"), r6("harmonic"))


@query(f"{BFS} SELECT id, round(sum(0.5::DOUBLE ** distance), 6) AS influence FROM m WHERE distance > 0 GROUP BY id")
def influence_spread(spark, d):
    e = net(spark, d)[1]
    x = G.distances(e, _start(spark, d)).where("distance > 0")
    return x.groupBy("id").agg(F.round(F.sum(F.pow(F.lit(0.5), F.col("distance"))), 6).alias("influence"))


@query(f"WITH RECURSIVE {E}, b AS (SELECT id, 0 AS steps, id AS root FROM {START} UNION SELECT e.src, b.steps + 1, b.root FROM b JOIN e ON b.id = e.dst WHERE b.steps < (SELECT count(*) FROM nd)), m AS (SELECT root, id, min(steps) AS steps FROM b GROUP BY ALL) SELECT id, min(steps)::INT AS steps FROM m WHERE steps > 0 GROUP BY id")
def affected_files(spark, d):
    e = net(spark, d)[1]
    return G.affected(e, _start(spark, d))


# curated prerequisite-like graph without cycles: from newer to older articles only
DAG = "d AS (SELECT e.src, e.dst FROM e WHERE e.src < e.dst)"


@query(f"WITH RECURSIVE {E}, {DAG}, l AS (SELECT id, 0 AS level FROM nd UNION SELECT d.dst, l.level + 1 FROM l JOIN d ON l.id = d.src) SELECT id, max(level)::INT AS level FROM l GROUP BY id")
def topological_levels(spark, d):
    n, e = net(spark, d)
    return G.topological_levels(n, e.where("src < dst"))


@query(f"WITH RECURSIVE {E}, {DAG}, l AS (SELECT id, 0 AS level FROM nd UNION SELECT d.dst, l.level + 1 FROM l JOIN d ON l.id = d.src) SELECT max(level)::INT AS critical_path, count(DISTINCT level) AS n_levels FROM l")
def critical_path_length(spark, d):
    n, e = net(spark, d)
    return G.topological_levels(n, e.where("src < dst")).agg(F.max("level").alias("critical_path"), F.countDistinct("level").alias("n_levels"))


@query(f"""WITH RECURSIVE {E}, b AS (SELECT id AS source, id, 0 AS distance FROM nd UNION SELECT b.source, e.dst, b.distance + 1 FROM b JOIN e ON b.id = e.src WHERE b.distance < (SELECT count(*) FROM nd)), m AS MATERIALIZED (SELECT source, id, min(distance) AS distance FROM b GROUP BY ALL),
sp AS (SELECT id AS s, id AS t, 0 AS d, [id] AS nodes FROM nd UNION ALL SELECT sp.s, e.dst, sp.d + 1, list_append(sp.nodes, e.dst) FROM sp JOIN e ON sp.t = e.src JOIN m ON m.source = sp.s AND m.id = e.dst AND m.distance = sp.d + 1),
c AS (SELECT s, t, count(*) AS k FROM sp GROUP BY ALL), v AS (SELECT s, t, unnest(nodes[2:len(nodes) - 1]) AS id FROM sp WHERE d > 1) SELECT id, round(sum(1.0::DOUBLE / k), 6) AS betweenness FROM v JOIN c USING (s, t) GROUP BY id""")
def betweenness(spark, d):
    """From all sources, as far as paths go; the SQL lists every shortest path."""
    n, e = net(spark, d)
    return G.betweenness(n, e, n).where("betweenness > 0").select("id", r6("betweenness"))


@query(f"WITH {E}, x AS (SELECT e.src, e.dst, split_part(e.src, '/', 2) AS a, split_part(e.dst, '/', 2) AS b FROM e) SELECT a AS category_from, b AS category_to, count(*) AS n FROM x GROUP BY ALL")
def category_links(spark, d):
    part = lambda c: F.split(c, "/")[1]
    return net(spark, d)[1].groupBy(part("src").alias("category_from"), part("dst").alias("category_to")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E} SELECT '  "' || src || '" -> "' || dst || '";' AS line FROM e""")
def export_dot(spark, d):
    return G.dot(net(spark, d)[1])
