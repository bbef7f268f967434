"""Versions, archives, vocabularies, paths, sitemaps, trends, orphan impact, user pages and arrays of values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.functions import text as T
from stackroom.operators import graph as G
from stackroom.operators import upkeep as K
from stackroom.plans.activity import F_, files
from stackroom.plans.catalog import ART, arts
from stackroom.plans.knowledge import KW, _keywords
from stackroom.plans.links import E, net
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


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# versions


@query(f"WITH {F_}, g AS (SELECT path, author, sum(greatest(insertions - deletions, 0))::BIGINT AS lines FROM f WHERE path IS NOT NULL GROUP BY ALL), t AS (SELECT path, sum(lines) AS total FROM g GROUP BY path) SELECT path, author, lines, round(CASE WHEN total > 0 THEN lines / total END, 6) AS share FROM g JOIN t USING (path)")
def line_authors(spark, d):
    """Whose lines a file holds, from the change log."""
    return K.annotated(files(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {F_}, nw AS (SELECT max(loaded_at) AS now FROM f) SELECT DISTINCT path FROM f, nw WHERE path LIKE '%.md' AND loaded_at >= now - INTERVAL 7 DAY")
def recently_changed_files(spark, d):
    f = files(spark, d)
    now = f.agg(F.max("loaded_at").alias("now"))
    return f.join(F.broadcast(now)).where(F.col("path").endswith(".md") & (F.col("loaded_at") >= F.col("now") - F.expr("INTERVAL 7 DAY"))).select("path").distinct()


@query(r"""WITH p AS (SELECT a.doc_id AS old_id, b.doc_id AS new_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
l AS (SELECT old_id, new_id, CASE WHEN coalesce(x, '') = '' THEN [] ELSE string_split_regex(x, '\r?\n') END AS a, CASE WHEN coalesce(y, '') = '' THEN [] ELSE string_split_regex(y, '\r?\n') END AS b FROM p), ca AS (SELECT old_id, line, count(*) AS c FROM (SELECT old_id, unnest(a) AS line FROM l) GROUP BY ALL), cb AS (SELECT old_id, line, count(*) AS c FROM (SELECT old_id, unnest(b) AS line FROM l) GROUP BY ALL),
k AS (SELECT old_id, sum(least(ca.c, cb.c))::BIGINT AS kept FROM ca JOIN cb USING (old_id, line) GROUP BY 1) SELECT old_id, new_id, (len(b) - coalesce(kept, 0))::INT AS added, (len(a) - coalesce(kept, 0))::INT AS removed, coalesce(kept, 0)::INT AS kept FROM l LEFT JOIN k USING (old_id)""")
def version_changes(spark, d):
    """Lines added, removed and kept between each document and the next by id, as if they were versions."""
    t = table(spark, d, "documents").select("doc_id", "text")
    j = t.select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 1).alias("new_id"), F.col("text").alias("x")).join(t.select(F.col("doc_id").alias("new_id"), F.col("text").alias("y")), "new_id")
    return j.select("old_id", "new_id", K.line_changes(F.col("x"), F.col("y")).alias("c")).select("old_id", "new_id", "c.*")


# archives

FILES = "fl AS (SELECT CASE id % 5 WHEN 0 THEN replace(path, '.md', '.png') WHEN 1 THEN replace(path, '.md', '.json') WHEN 2 THEN replace(path, '.md', '.bin') ELSE path END AS path, coalesce(chars, 0) AS bytes, lower(regexp_extract(CASE id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.json' WHEN 2 THEN '.bin' ELSE '.md' END, '\\.(\\w+)$', 1)) AS ext FROM art WHERE path IS NOT NULL AND path LIKE '%.md')"


def _files(spark, d):
    end = F.when(F.col("id") % 5 == 0, ".png").when(F.col("id") % 5 == 1, ".json").when(F.col("id") % 5 == 2, ".bin").otherwise(".md")
    return arts(spark, d).where("path LIKE '%.md'").select(F.replace("path", F.lit(".md"), end).alias("path"), F.col("chars").alias("bytes"))


@query(f"WITH {ART}, {FILES}, c AS (SELECT CASE WHEN ext IN ('md', 'txt', 'csv') THEN 'text' WHEN ext IN ('py', 'js', 'json') THEN 'code' WHEN ext IN ('zip', 'gz', 'png', 'jpg') THEN 'packed' ELSE 'other' END AS class, bytes FROM fl) SELECT class, count(*) AS n, sum(bytes)::BIGINT AS bytes, round(sum(bytes) / CASE class WHEN 'text' THEN 3.0 WHEN 'code' THEN 2.5 WHEN 'packed' THEN 1.0 ELSE 2.0 END, 4) AS expected_bytes FROM c GROUP BY class")
def archive_compression(spark, d):
    """Sizes by extension class and what they are expected to shrink to."""
    return K.compression(_files(spark, d)).withColumn("expected_bytes", F.round("expected_bytes", 4))


@query(f"WITH {ART}, {FILES} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n_files, sum(bytes)::BIGINT AS bytes, md5(string_agg(md5(path || ':' || bytes), '' ORDER BY path, bytes)) AS digest FROM fl GROUP BY 1")
def archive_manifest(spark, d):
    """Files, bytes and a digest of each folder's list, to check an archive against."""
    f = _files(spark, d).withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    each = F.transform(F.sort_array(F.collect_list(F.struct("path", "bytes"))), lambda x: F.md5(F.concat_ws(":", x["path"], x["bytes"].cast("string"))))
    return f.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(n("n_files"), F.sum("bytes").alias("bytes"), F.md5(F.array_join(each, "")).alias("digest"))


@query("""WITH b AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'diff' WHEN 2 THEN 'incr' ELSE 'copy' END || '_' || o_orderkey || '.zip' AS name, o_orderdate AS d FROM orders), k AS (SELECT name, CASE WHEN contains(name, 'full') THEN 'full' WHEN contains(name, 'diff') THEN 'differential' WHEN contains(name, 'incr') THEN 'incremental' ELSE 'unknown' END AS kind, d FROM b)
SELECT kind, count(*) AS n_removed, min(name) AS first_name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY d DESC, name) AS r FROM k) WHERE r > 10 GROUP BY kind""")
def rotated_backups(spark, d):
    """Backups (orders stand for them) beyond the ten newest of each kind."""
    k = F.col("o_orderkey") % 4
    b = table(spark, d, "orders").select(F.concat(F.when(k == 0, "full").when(k == 1, "diff").when(k == 2, "incr").otherwise("copy"), F.lit("_"), "o_orderkey", F.lit(".zip")).alias("name"), F.col("o_orderdate").alias("at"))
    return K.rotated(b).groupBy("kind").agg(n("n_removed"), F.min("name").alias("first_name"))


# vocabularies, paths, sitemaps


@query(f"WITH {ART}, c AS (SELECT 'category' AS facet, category AS value FROM art UNION ALL SELECT 'subcategory', subcategory FROM art UNION ALL SELECT 'status', status FROM art UNION ALL SELECT 'importance', CASE WHEN quality >= 80 THEN 'high' WHEN quality >= 50 THEN 'medium' ELSE 'low' END FROM art UNION ALL SELECT 'colour', CASE category WHEN 'computers' THEN 'blue' WHEN 'cooking' THEN 'red' WHEN 'garden' THEN 'green' ELSE 'grey' END FROM art) SELECT facet, value, count(*) AS n FROM c GROUP BY ALL")
def rubric_counts(spark, d):
    """Articles by category, subcategory, status, importance and colour in one pass."""
    q, c = F.col("quality"), F.col("category")
    of = {"category": c, "subcategory": F.col("subcategory"), "status": F.col("status"), "importance": F.when(q >= 80, "high").when(q >= 50, "medium").otherwise("low"), "colour": F.when(c == "computers", "blue").when(c == "cooking", "red").when(c == "garden", "green").otherwise("grey")}
    f = arts(spark, d).select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in of.items()])).alias("f"))
    return f.groupBy("f.facet", "f.value").agg(n())


@query(f"WITH {ART} SELECT id, unnest(list_filter([CASE WHEN category NOT IN ('computers', 'cooking', 'household', 'garden', 'study') THEN 'category' END, CASE WHEN status NOT IN ('draft', 'published', 'review', 'deleted') THEN 'status' END, CASE WHEN difficulty NOT IN ('beginner', 'intermediate', 'advanced', 'expert') THEN 'difficulty' END, CASE WHEN subcategory = '-' THEN 'subcategory' END, CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' END], lambda x: x IS NOT NULL)) AS issue FROM art")
def rubric_issues(spark, d):
    """Articles whose rubrics are outside the vocabularies."""
    out = lambda c, *ok: F.when(~F.col(c).isin(*ok), c)
    kinds = [
        out("category", "computers", "cooking", "household", "garden", "study"), out("status", "draft", "published", "review", "deleted"), out("difficulty", "beginner", "intermediate", "advanced", "expert"),
        F.when(F.col("subcategory") == "-", "subcategory"), F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title"),
    ]
    return arts(spark, d).select("id", F.explode(F.array_compact(F.array(*kinds))).alias("issue"))


@query(f"WITH {ART}, a AS (SELECT category, CASE WHEN orphan_type IS NULL THEN 'keep' WHEN quality < 40 THEN 'rewrite' ELSE 'link' END AS action, CASE WHEN quality < 40 THEN 'high' ELSE 'normal' END AS priority, quality FROM art) SELECT category, action, priority, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM a GROUP BY ALL")
def inbox_analytics(spark, d):
    """What is to be done with articles, by category and priority."""
    q = F.col("quality")
    act = F.when(F.col("orphan_type").isNull(), "keep").when(q < 40, "rewrite").otherwise("link")
    return arts(spark, d).groupBy("category", act.alias("action"), F.when(q < 40, "high").otherwise("normal").alias("priority")).agg(n(), r6(F.avg("quality"), "mean_quality"))


@query(f"WITH {ART} SELECT id, unnest(list_filter([CASE WHEN coalesce(path, '') = '' THEN 'no_path' END, CASE WHEN len(string_split(path, '/')) > 6 THEN 'too_deep' END, CASE WHEN len(string_split(path, '/')) > 7 THEN 'many_crumbs' END, CASE WHEN length(trim(coalesce(title, ''))) < 3 THEN 'short_title' END, CASE WHEN path <> lower(path) THEN 'upper_case' END, CASE WHEN contains(path, ' ') THEN 'blank' END], lambda x: x IS NOT NULL)) AS issue FROM art")
def path_issues(spark, d):
    return arts(spark, d).select("id", F.explode(K.path_issues(F.col("path"), F.col("title"))).alias("issue"))


@query(f"WITH {ART}, u AS (SELECT category AS file, CASE WHEN id % 7 = 0 THEN 'ftp://x' ELSE 'https://kb.example/' || (id % 300) END AS url, CASE WHEN id % 11 = 0 THEN 1.5 ELSE 0.5 END AS priority FROM art), r AS (SELECT file, url FROM u GROUP BY ALL HAVING count(*) > 1) SELECT file, 'repeated' AS issue, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT file, 'format', count(*) FROM u WHERE NOT starts_with(url, 'https://') GROUP BY 1 UNION ALL SELECT file, 'priority', count(*) FROM u WHERE priority > 1 GROUP BY 1")
def sitemap_issues(spark, d):
    """Faults of sitemap rows, one file per category."""
    u = arts(spark, d).selectExpr("category AS file", "CASE WHEN id % 7 = 0 THEN 'ftp://x' ELSE 'https://kb.example/' || CAST(id % 300 AS STRING) END AS url", "CASE WHEN id % 11 = 0 THEN 1.5 ELSE 0.5 END AS priority")
    return K.sitemap_issues(u)


# trends and orphans


@query(f"WITH {ART}, {F_}, e AS (SELECT path, count(DISTINCT hash) AS edits FROM f WHERE path IS NOT NULL GROUP BY path), t AS (SELECT id, coalesce(edits, 0)::DOUBLE AS e, greatest(coalesce(age, 0), 1)::DOUBLE AS n, coalesce(inlinks, 0)::DOUBLE AS l, coalesce(quality, 0)::DOUBLE AS q FROM art LEFT JOIN e USING (path)), g AS (SELECT id, CASE WHEN n < 30 THEN e / n ELSE 0 END AS growth, l / sqrt(n) AS viral, q FROM t), m AS (SELECT *, growth * 50 + viral * 30 + q * 0.2::DOUBLE AS momentum FROM g) SELECT id, round(growth, 6) AS growth, round(viral, 6) AS viral, round(momentum, 6) AS momentum, CASE WHEN momentum >= 20 THEN 'rising' WHEN momentum >= 8 THEN 'steady' ELSE 'falling' END AS direction FROM m")
def article_trends(spark, d):
    """Growth, spread, momentum and direction of every article."""
    e = files(spark, d).where("path IS NOT NULL").groupBy("path").agg(F.countDistinct("hash").alias("edits"))
    t = arts(spark, d).join(e, "path", "left").select("id", K.trend(F.col("edits"), F.col("age"), F.col("inlinks"), F.col("quality")).alias("t"))
    return t.select("id", r6("t.growth", "growth"), r6("t.viral", "viral"), r6("t.momentum", "momentum"), "t.direction")


@query(f"WITH {ART}, {E}, o AS (SELECT src AS path, count(*) AS o FROM e GROUP BY 1), ct AS (SELECT category, count(*) AS c FROM art GROUP BY 1), x AS (SELECT id, coalesce(o, 0) AS o, c - 1 AS p, coalesce(pagerank, 0) AS r, len(tags) AS t FROM art LEFT JOIN o USING (path) JOIN ct USING (category) WHERE path IS NOT NULL AND path NOT IN (SELECT dst FROM e)) SELECT id, (o + 2 * p)::BIGINT AS connectivity, CASE WHEN o + 2 * p >= 20 THEN 'high' WHEN o + 2 * p >= 8 THEN 'medium' ELSE 'low' END AS rating, round(r * 0.85::DOUBLE * CASE WHEN o > 0 THEN 1.0 ELSE 0.5 END, 4) AS lost_rank, least(100, t * 10 + o * 5)::INT AS discoverability FROM x")
def orphan_impact(spark, d):
    """What is lost while nothing links to an article: connections, rank, ways to find it."""
    e = net(spark, d)[1]
    a = arts(spark, d).where("path IS NOT NULL").join(e.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    out = e.groupBy(F.col("src").alias("path")).agg(n("o"))
    per = arts(spark, d).groupBy("category").agg((F.count(F.lit(1)) - 1).alias("p"))
    x = a.join(out, "path", "left").join(per, "category")
    i = K.orphan_impact(F.col("o"), F.col("p"), F.col("pagerank"), F.size("tags"))
    return x.select("id", i.alias("i")).select("id", "i.connectivity", "i.rating", F.round("i.lost_rank", 4).alias("lost_rank"), "i.discoverability")


@query(f"WITH {KW}, k AS (SELECT doc, word FROM kr WHERE r <= 20), s AS (SELECT doc, count(*) AS n FROM k GROUP BY doc), c AS (SELECT a.doc, b.doc AS other, count(*) AS common FROM k a JOIN k b USING (word) WHERE a.doc % 100 = 0 AND a.doc <> b.doc GROUP BY ALL), j AS (SELECT c.doc, other, round(common / (x.n + y.n - common), 6) AS jaccard FROM c JOIN s x ON x.doc = c.doc JOIN s y ON y.doc = c.other) SELECT doc, other, jaccard, CASE WHEN jaccard >= 0.3 THEN 'high' WHEN jaccard >= 0.2 THEN 'medium' ELSE 'low' END AS confidence, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY jaccard DESC, other) AS k FROM j WHERE jaccard > 0.1) WHERE k <= 5")
def contextual_links(spark, d):
    """Five documents whose twenty best keywords are most like those of each hundredth document."""
    k = _keywords(spark, d, 20).select("doc", "word")
    size = k.groupBy("doc").agg(n("n"))
    c = k.where("doc % 100 = 0").join(k.select(F.col("doc").alias("other"), "word"), "word").where("doc <> other").groupBy("doc", "other").agg(n("common"))
    j = c.join(size, "doc").join(size.select(F.col("doc").alias("other"), F.col("n").alias("m")), "other")
    j = j.withColumn("jaccard", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6)).where("jaccard > 0.1")
    w = W.partitionBy("doc").orderBy(F.desc("jaccard"), "other")
    conf = F.when(F.col("jaccard") >= 0.3, "high").when(F.col("jaccard") >= 0.2, "medium").otherwise("low")
    return j.withColumn("k", F.row_number().over(w)).where("k <= 5").select("doc", "other", "jaccard", conf.alias("confidence"), "k")


@query(f"WITH {E}, {ART}, c AS (SELECT count(DISTINCT path) AS n, count(DISTINCT path) FILTER (path IN (SELECT src FROM e) OR path IN (SELECT dst FROM e)) AS linked, avg(quality) AS q FROM art WHERE path IS NOT NULL) SELECT round(100 * linked / n, 6) AS coverage, round(q, 6) AS mean_score, round(0.6::DOUBLE * 100 * linked / n + 0.4::DOUBLE * q, 6) AS quality FROM c")
def cross_reference_quality(spark, d):
    """Share of linked articles, mean score and both together."""
    e = net(spark, d)[1]
    a = arts(spark, d).where("path IS NOT NULL").join(G.nodes_of(e).select(F.col("id").alias("path"), F.lit(1).alias("linked")).distinct(), "path", "left")
    c = a.agg(F.countDistinct("path").alias("n"), F.countDistinct(F.when(F.col("linked") == 1, F.col("path"))).alias("l"), F.avg("quality").alias("q"))
    cover = 100 * F.col("l") / F.col("n")
    return c.select(r6(cover, "coverage"), r6("q", "mean_score"), r6(0.6 * cover + 0.4 * F.col("q"), "quality"))


# users and tool runs


@query("SELECT c_custkey AS user_id, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY c_custkey LIMIT 100 OFFSET 100")
def user_page(spark, d):
    """The second page of a hundred users."""
    c, nt = table(spark, d, "customer"), table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return c.join(nt, "c_nationkey").orderBy("c_custkey").offset(100).limit(100).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "nation")


@query("WITH x AS (SELECT event_type AS tool, user_id % 3 AS place, value, (event_type = 'error')::INT AS failed, (event_id % 4 = 0)::INT AS cached FROM events) SELECT tool, place::INT AS place, count(*) AS n, round(avg(value), 6) AS mean_ms, round(avg(failed), 6) AS error_rate, round(avg(cached), 6) AS cache_hits FROM x GROUP BY ALL")
def tool_metrics(spark, d):
    """Runs, mean time, errors and cache hits by tool and place; event types stand for tools."""
    e = table(spark, d, "events").select(F.col("event_type").alias("tool"), (F.col("user_id") % 3).cast("int").alias("place"), "value", (F.col("event_type") == "error").cast("int").alias("f"), (F.col("event_id") % 4 == 0).cast("int").alias("c"))
    return e.groupBy("tool", "place").agg(n(), r6(F.avg("value"), "mean_ms"), r6(F.avg("f"), "error_rate"), r6(F.avg("c"), "cache_hits"))


@query("WITH f AS (SELECT unnest(['html', 'json', 'csv']) AS type), t AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN 'csv' ELSE 'md' END AS type, n_chars FROM documents) SELECT type, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM t WHERE type IN (SELECT type FROM f) GROUP BY type")
def artefacts_by_type(spark, d):
    """Files of three types; documents stand for files."""
    k = F.col("doc_id") % 4
    t = table(spark, d, "documents").select(F.when(k == 0, "html").when(k == 1, "json").when(k == 2, "csv").otherwise("md").alias("type"), "n_chars")
    return t.where(F.col("type").isin("html", "json", "csv")).groupBy("type").agg(n(), F.sum("n_chars").alias("bytes"))


# arrays and drawing

VALS = "vl AS (SELECT l_orderkey AS id, list((l_quantity - 20)::INT ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1)"


def _values(spark, d):
    v = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") - 20).cast("int").alias("q")))), lambda x: x["q"])
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(v.alias("v"))


@query(f"WITH {VALS} SELECT id, array_to_string(list_filter(v, lambda x: x > 5), ',') AS greater, array_to_string(list_filter(v, lambda x: x < 5), ',') AS less, array_to_string(list_filter(v, lambda x: x <> 5), ',') AS unequal, array_to_string(list_filter(v, lambda x: x > 0), ',') AS positive, array_to_string(list_filter(v, lambda x: x < 0), ',') AS negative, array_to_string(list_filter(v, lambda x: x <> 0), ',') AS non_zero FROM vl")
def array_filters(spark, d):
    j = lambda c, name: F.array_join(c.cast("array<string>"), ",").alias(name)
    v = F.col("v")
    return _values(spark, d).select("id", *[j(K.keep(v, r, b), r) for r, b in (("greater", 5), ("less", 5), ("unequal", 5), ("positive", None), ("negative", None), ("non_zero", None))])


@query(f"WITH {VALS} SELECT id, array_to_string(list_sort(v), ',') AS ascending, array_to_string(list_reverse_sort(v), ',') AS descending, array_to_string(list_reverse(v), ',') AS reversed, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]), ',') AS once, coalesce(list_position(list_sort(v), 10), 0)::INT - 1 AS ten_at FROM vl")
def array_orders(spark, d):
    j = lambda c, name: F.array_join(c.cast("array<string>"), ",").alias(name)
    v = F.col("v")
    return _values(spark, d).select("id", *[j(K.arranged(v, h), h) for h in ("ascending", "descending", "reversed")], j(K.arranged(v, "unique"), "once"), K.found_at(v, F.lit(10)).alias("ten_at"))


@query("WITH c AS (SELECT term_id, exported_at, list_filter(string_split(term, ''), lambda x: x <> '') AS c FROM (SELECT DISTINCT term_id, exported_at, term FROM thesaurus WHERE term IS NOT NULL)), k AS (SELECT term_id, exported_at, c, list_distinct(c) AS d FROM c), h AS (SELECT term_id, exported_at, len(c)::INT AS n, len(d)::INT AS different, list_sum(list_transform(d, lambda k: -len(list_filter(c, lambda x: x = k)) / len(c) * log2(len(list_filter(c, lambda x: x = k)) / len(c)))) AS entropy FROM k) SELECT n, count(*) AS n_terms, round(avg(different / n), 6) AS ratio, round(avg(entropy), 6) AS entropy FROM h GROUP BY n")
def character_entropy(spark, d):
    """Terms by length: share of different characters and their entropy."""
    t = table(spark, d, "thesaurus").select("term_id", "exported_at", "term").where("term IS NOT NULL").distinct().select(K.character_stats(F.col("term")).alias("s")).select("s.*")
    return t.groupBy("n").agg(n("n_terms"), r6(F.avg("ratio"), "ratio"), r6(F.avg("entropy"), "entropy"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey::STRING AS region FROM nation")
def delimited_rows(spark, d):
    """Delimited text of the nations, written and read back."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))), lambda r: F.concat_ws(",", r["n_nationkey"].cast("string"), r["n_name"], r["n_regionkey"].cast("string"))), "\n")
    t = table(spark, d, "nation").agg(F.concat(F.lit("id,name,region\n"), text).alias("t"))  # 25 rows by construction
    return t.select(F.explode(K.parsed_lines(F.col("t"))).alias("r")).select(F.col("r")["id"].cast("bigint").alias("id"), F.col("r")["name"].alias("name"), F.col("r")["region"].alias("region"))


HEX = "('0x' || left(md5({0} || ':' || o_orderkey), 8))::BIGINT"


@query(f"SELECT o_orderkey AS id, (({HEX.format(7)}) % 6 + 1)::INT AS dice, (({HEX.format(8)}) % 2)::INT AS coin, (({HEX.format(9)}) % 1000)::INT AS number, (left(h, 8) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]) AS uuid FROM (SELECT o_orderkey, md5('10:' || o_orderkey) AS h FROM orders)")
def seeded_draws(spark, d):
    """Dice, coins, numbers and identifiers drawn by seed: the same on every run."""
    k = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), K.drawn(k, 7, 1, 6).alias("dice"), K.drawn(k, 8, 0, 1).alias("coin"), K.drawn(k, 9, 0, 999).alias("number"), K.drawn_id(k, 10).alias("uuid"))
