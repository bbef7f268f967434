"""Reports derived from articles, links, thesaurus and change log: leaders, growth, rankings, recommendations, contents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.functions import text as T
from stackroom.operators import catalog as C
from stackroom.operators import graph as G
from stackroom.plans.activity import C_, commits
from stackroom.plans.catalog import ART, TAGS, arts
from stackroom.plans.knowledge import CURT, KW, _keywords
from stackroom.plans.links import BFS, E, U, _start, net
from stackroom.plans.network import DEG
from stackroom.tables import latest, table

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


# graph


def _eigen_sql(rounds: int) -> str:
    ctes = [E, U, "x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM nd)"]
    for i in range(rounds):
        ctes.append(f"x{i + 1} AS MATERIALIZED (SELECT id, v / sqrt(sum(v * v) OVER ()) AS x FROM (SELECT nd.id, x{i}.x + coalesce(s.v, 0) AS v FROM nd JOIN x{i} USING (id) LEFT JOIN (SELECT src AS id, sum(x{i}.x) AS v FROM u JOIN x{i} ON u.dst = x{i}.id GROUP BY 1) s USING (id)))")
    return f"WITH {', '.join(ctes)} SELECT id, round(x, 6) AS eigenvector FROM x{rounds}"


@query(_eigen_sql(10))
def eigenvector_centrality(spark, d):
    """Ten rounds of the power method on the undirected graph, each node keeping its own value besides."""
    return G.eigenvector(*net(spark, d), 10).select("id", r6("eigenvector", "eigenvector"))


@query(f"{BFS} SELECT max(distance)::INT AS diameter, round(avg(distance), 6) AS mean_distance, count(*) AS n_pairs, count(DISTINCT source) AS n_sources FROM m WHERE distance > 0")
def distance_summary(spark, d):
    """Longest and mean distance from every hundredth article."""
    x = G.distances(net(spark, d)[1], _start(spark, d)).where("distance > 0")
    return x.agg(F.max("distance").alias("diameter"), r6(F.avg("distance"), "mean_distance"), n("n_pairs"), F.countDistinct("source").alias("n_sources"))


@query(f"WITH {E}, {DEG} SELECT id, CASE WHEN i = 0 THEN 'entry' ELSE 'advanced' END AS kind FROM dg WHERE i = 0 AND o > 0 OR i >= 2 AND o = 0")
def entry_and_advanced(spark, d):
    """Where reading can begin (nothing before, something after) and where it ends (two before, nothing after)."""
    g = G.degrees(*net(spark, d)).where("in_degree = 0 AND out_degree > 0 OR in_degree >= 2 AND out_degree = 0")
    return g.select("id", F.when(F.col("in_degree") == 0, "entry").otherwise("advanced").alias("kind"))


@query(f"WITH {E}, {DEG} SELECT least(degree, 5)::INT AS degree_class, count(*) AS n, sum(i)::BIGINT AS in_links, sum(o)::BIGINT AS out_links FROM dg GROUP BY 1")
def degree_classes(spark, d):
    return G.degrees(*net(spark, d)).groupBy(F.least("degree", F.lit(5)).cast("int").alias("degree_class")).agg(n(), F.sum("in_degree").alias("in_links"), F.sum("out_degree").alias("out_links"))


@query(f"WITH RECURSIVE {ART}, {TAGS}, pr AS (SELECT x.tag AS a, y.tag AS b FROM tg x JOIN tg y ON x.id = y.id AND x.tag < y.tag GROUP BY ALL HAVING count(*) >= 4), e2 AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), c AS (SELECT a AS tag, a AS cluster FROM e2 UNION SELECT e2.b, c.cluster FROM c JOIN e2 ON c.tag = e2.a), m AS (SELECT tag, min(cluster) AS cluster FROM c GROUP BY tag) SELECT cluster, count(*) AS n, string_agg(tag, ', ' ORDER BY tag) AS tags FROM m GROUP BY cluster")
def tag_clusters(spark, d):
    """Tags linked by standing together in four articles or more."""
    p = C.tag_pairs(C.article_tags(arts(spark, d)), 4).select(F.col("tag_a").alias("src"), F.col("tag_b").alias("dst"))
    c = G.components(G.nodes_of(p), p)
    return c.groupBy(F.col("component").alias("cluster")).agg(n(), F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("tags"))


@query(f"WITH {ART}, {E}, p AS (SELECT path, category, subcategory, tags FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) AS r FROM art WHERE path IS NOT NULL) WHERE r = 1) SELECT src, dst, array_to_string(list_sort(list_intersect(x.tags, y.tags)), ',') AS common_tags, x.category = y.category AS same_category, x.category = y.category AND x.subcategory = y.subcategory AS same_shelf FROM e JOIN p x ON x.path = src JOIN p y ON y.path = dst")
def link_explanations(spark, d):
    """Why two linked articles are alike: common tags, category and shelf."""
    p = arts(spark, d).where("path IS NOT NULL").groupBy("path").agg(F.min_by(F.struct("category", "subcategory", "tags"), "id").alias("p"))
    x, y = p.select(F.col("path").alias("src"), F.col("p").alias("x")), p.select(F.col("path").alias("dst"), F.col("p").alias("y"))
    same = F.col("x.category") == F.col("y.category")
    j = net(spark, d)[1].join(x, "src").join(y, "dst")
    return j.select("src", "dst", F.array_join(F.sort_array(F.array_intersect("x.tags", "y.tags")), ",").alias("common_tags"), same.alias("same_category"), (same & (F.col("x.subcategory") == F.col("y.subcategory"))).alias("same_shelf"))


# categories and articles


@query(f"WITH {ART}, r AS (SELECT category, id, quality, row_number() OVER (PARTITION BY category ORDER BY quality DESC, id) AS k FROM art WHERE quality IS NOT NULL), m AS (SELECT category, round(avg(quality), 6) AS mean_quality FROM art GROUP BY 1) SELECT category, id AS leader, quality, mean_quality, rank() OVER (ORDER BY mean_quality DESC)::INT AS place FROM r JOIN m USING (category) WHERE k = 1")
def category_leaders(spark, d):
    """Best article of each category, and the categories' places by mean quality."""
    a = arts(spark, d)
    g = a.groupBy("category").agg(F.min(F.when(F.col("quality").isNotNull(), F.struct((-F.col("quality")).alias("q"), "id"))).alias("b"), F.round(F.avg("quality"), 6).alias("mean_quality")).where("b IS NOT NULL")
    return g.select("category", F.col("b.id").alias("leader"), (-F.col("b.q")).alias("quality"), "mean_quality", F.rank().over(W.orderBy(F.desc("mean_quality"))).alias("place"))  # a row per category


@query(f"WITH {ART} SELECT category, strftime(modified, '%Y-%m') AS month, count(*) AS n, sum(words)::BIGINT AS words FROM art WHERE modified IS NOT NULL GROUP BY ALL")
def category_growth(spark, d):
    return arts(spark, d).where("modified IS NOT NULL").groupBy("category", F.date_format("modified", "yyyy-MM").alias("month")).agg(n(), F.sum("words").alias("words"))


@query(f"WITH {ART}, w AS (SELECT category, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 4))) AS word FROM art), c AS (SELECT category, word, count(*) AS n FROM w GROUP BY ALL) SELECT category, word, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS k FROM c) WHERE k <= 10")
def category_keywords(spark, d):
    """Ten commonest title words of each category."""
    w = arts(spark, d).select("category", F.explode(F.array_distinct(T.words(F.col("title"), 4))).alias("word")).groupBy("category", "word").agg(n())
    return w.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "word"))).where("k <= 10").select("category", "word", "n")


@query(f"WITH {ART}, g AS (SELECT 'author' AS grouping, author AS value FROM art UNION ALL SELECT 'year', strftime(modified, '%Y') FROM art WHERE modified IS NOT NULL UNION ALL SELECT 'type', coalesce(orphan_type, 'linked') FROM art) SELECT grouping, value, count(*) AS n FROM g GROUP BY ALL")
def source_groups(spark, d):
    """Articles as sources by author, year and type, in one pass."""
    of = F.array_compact(F.array(F.struct(F.lit("author").alias("grouping"), F.col("author").alias("value")), F.when(F.col("modified").isNotNull(), F.struct(F.lit("year").alias("grouping"), F.date_format("modified", "yyyy").alias("value"))), F.struct(F.lit("type").alias("grouping"), F.coalesce("orphan_type", F.lit("linked")).alias("value"))))
    return arts(spark, d).select(F.explode(of).alias("g")).groupBy("g.grouping", "g.value").agg(n())


@query(f"WITH {ART}, t AS (SELECT 'longest' AS list, id, words::DOUBLE AS value FROM art UNION ALL SELECT 'best', id, quality FROM art UNION ALL SELECT 'most_linked', id, inlinks FROM art UNION ALL SELECT 'rank', id, pagerank FROM art) SELECT list, k::INT AS k, id, value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, id) AS k FROM t WHERE value IS NOT NULL) WHERE k <= 10")
def top_articles(spark, d):
    """First ten articles by length, quality, links and rank: each list by a global top ten."""
    a = arts(spark, d)
    out = None
    for name, c in (("longest", "words"), ("best", "quality"), ("most_linked", "inlinks"), ("rank", "pagerank")):
        top = a.where(F.col(c).isNotNull()).select("id", F.col(c).cast("double").alias("value")).orderBy(F.desc("value"), "id").limit(10)
        part = top.select(F.lit(name).alias("list"), F.row_number().over(W.orderBy(F.desc("value"), "id")).alias("k"), "id", "value")  # ten rows
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {ART}, t AS (SELECT difficulty, count(*) AS n, round(sum(words / CASE difficulty WHEN 'beginner' THEN 220.0 WHEN 'intermediate' THEN 200.0 WHEN 'advanced' THEN 170.0 WHEN 'expert' THEN 140.0 ELSE 200.0 END), 4) AS minutes FROM art GROUP BY difficulty) SELECT difficulty, n, minutes, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct FROM t")
def difficulty_distribution(spark, d):
    """Articles by difficulty and the minutes they take at the speed of that difficulty."""
    dc = F.col("difficulty")
    speed = F.when(dc == "beginner", 220.0).when(dc == "advanced", 170.0).when(dc == "expert", 140.0).otherwise(200.0)
    g = arts(spark, d).groupBy("difficulty").agg(n(), F.round(F.sum(F.col("words") / speed), 4).alias("minutes"))
    total = g.agg(F.sum("n").alias("all"))
    return g.join(F.broadcast(total)).select("difficulty", "n", "minutes", r6(100.0 * F.col("n") / F.col("all"), "pct"))


QM = ("completeness", "structure", "links", "examples", "readability", "freshness")


@query(f"WITH {ART}, q AS (" + " UNION ALL ".join(f"SELECT id, '{m}' AS part, qm.{m} AS score FROM art" for m in QM) + ") SELECT id, part, score, CASE WHEN score < 25 THEN 'high' ELSE 'normal' END AS priority FROM q WHERE score < 50")
def quality_recommendations(spark, d):
    """Parts of quality under fifty, to be worked on."""
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("part"), F.col(f"qm.{m}").alias("score")) for m in QM]))
    q = arts(spark, d).select("id", parts.alias("p")).select("id", "p.*").where("score < 50")
    return q.withColumn("priority", F.when(F.col("score") < 25, "high").otherwise("normal"))


@query(f"WITH {ART}, s AS (SELECT id, unnest(list_filter([CASE WHEN length(coalesce(title, '')) < 10 THEN 'title_short' END, CASE WHEN length(title) > 60 THEN 'title_long' END, CASE WHEN len(tags) = 0 THEN 'no_tags' END, CASE WHEN coalesce(words, 0) < 300 THEN 'thin' END, CASE WHEN coalesce(outlinks, 0) = 0 THEN 'no_links' END], lambda x: x IS NOT NULL)) AS issue FROM art) SELECT issue, count(*) AS n, min(id) AS first_id FROM s GROUP BY issue")
def seo_issues(spark, d):
    t, z = F.coalesce("title", F.lit("")), lambda c: F.coalesce(c, F.lit(0))
    kinds = [F.when(F.length(t) < 10, "title_short"), F.when(F.length(t) > 60, "title_long"), F.when(F.size("tags") == 0, "no_tags"), F.when(z("words") < 300, "thin"), F.when(z("outlinks") == 0, "no_links")]
    return arts(spark, d).select("id", F.explode(F.array_compact(F.array(*kinds))).alias("issue")).groupBy("issue").agg(n(), F.min("id").alias("first_id"))


@query(f"WITH {ART} SELECT CASE WHEN coalesce(inlinks, 0) >= 10 THEN 'high' WHEN coalesce(inlinks, 0) >= 3 THEN 'medium' WHEN coalesce(inlinks, 0) >= 1 THEN 'low' ELSE 'none' END AS engagement, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM art GROUP BY 1")
def engagement_distribution(spark, d):
    i = F.coalesce("inlinks", F.lit(0))
    return arts(spark, d).groupBy(F.when(i >= 10, "high").when(i >= 3, "medium").when(i >= 1, "low").otherwise("none").alias("engagement")).agg(n(), r6(F.avg("quality"), "mean_quality"))


@query(f"WITH {ART}, p AS (SELECT len(string_split(path, '/'))::INT AS depth FROM art WHERE path IS NOT NULL) SELECT depth, count(*) AS n, depth > 5 AS deep FROM p GROUP BY depth")
def path_depths(spark, d):
    g = arts(spark, d).where("path IS NOT NULL").groupBy(F.size(F.split("path", "/")).alias("depth")).agg(n())
    return g.withColumn("deep", F.col("depth") > 5)


@query(f"WITH {ART} SELECT id, title, strftime(modified, '%Y-%m-%d') AS day, CASE WHEN quality >= 90 THEN 'quality' WHEN words >= 900 THEN 'size' ELSE 'links' END AS reason FROM art WHERE modified IS NOT NULL AND (quality >= 90 OR words >= 900 OR inlinks >= 10)")
def milestones(spark, d):
    """Articles that stand out, for a timeline."""
    m = arts(spark, d).where("modified IS NOT NULL AND (quality >= 90 OR words >= 900 OR inlinks >= 10)")
    return m.select("id", "title", F.date_format("modified", "yyyy-MM-dd").alias("day"), F.when(F.col("quality") >= 90, "quality").when(F.col("words") >= 900, "size").otherwise("links").alias("reason"))


# texts


@query(r"""WITH t AS (SELECT doc_id AS doc, text, instr(lower(text), 'сервер') AS p FROM documents WHERE text IS NOT NULL) SELECT doc, p::INT AS place, substring(text, greatest(p - 20, 1), 46) AS context FROM t WHERE p > 0""")
def highlighted_context(spark, d):
    """First place of a word in each document with what stands around it."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.instr(F.lower("text"), "сервер").alias("p")).where("p > 0")
    return t.select("doc", F.col("p").alias("place"), F.expr("substring(text, greatest(p - 20, 1), 46)").alias("context"))


@query(r"""WITH h AS (SELECT doc_id AS doc, regexp_extract_all(text, '(?m)^(#{1,6})[ \t]+([^\r\n]+)', 1) AS l, regexp_extract_all(text, '(?m)^(#{1,6})[ \t]+([^\r\n]+)', 2) AS t FROM documents) SELECT doc, array_to_string(list_transform(range(1, len(l) + 1), lambda i: repeat('  ', length(l[i]) - 1) || '- ' || trim(t[i])), chr(10)) AS toc FROM h WHERE len(l) > 0""")
def tables_of_contents(spark, d):
    """Contents of each document as an indented list."""
    p = F.lit(r"(?m)^(#{1,6})[ \t]+([^\r\n]+)")
    h = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.regexp_extract_all("text", p, F.lit(1)).alias("l"), F.regexp_extract_all("text", p, F.lit(2)).alias("t")).where(F.size("l") > 0)
    line = F.zip_with("l", "t", lambda l, t: F.concat(F.repeat(F.lit("  "), F.length(l) - 1), F.lit("- "), F.trim(t)))
    return h.select("doc", F.array_join(line, "\n").alias("toc"))


@query(f"WITH {KW}, t AS (SELECT word, sum(n)::BIGINT AS n FROM kf GROUP BY word ORDER BY n DESC, word LIMIT 50) SELECT word, n, round(12 + 36 * (n - (SELECT min(n) FROM t)) / greatest((SELECT max(n) - min(n) FROM t), 1), 4) AS size FROM t")
def word_cloud(spark, d):
    """The fifty commonest words with sizes from 12 to 48."""
    w = table(spark, d, "documents").select(F.explode(T.words(F.col("text"), 4, stop_words=True)).alias("word")).groupBy("word").agg(n()).orderBy(F.desc("n"), "word").limit(50)
    ends = w.agg(F.min("n").alias("a"), F.max("n").alias("b"))
    return w.join(F.broadcast(ends)).select("word", "n", F.round(12 + 36 * (F.col("n") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1)), 4).alias("size"))


@query(f"WITH {KW}, k AS (SELECT doc, word FROM kr WHERE r <= 10), s AS (SELECT word, count(*) AS c FROM k GROUP BY word), top AS (SELECT word FROM s ORDER BY c DESC, word LIMIT 5) SELECT a.word, b.word AS other, count(*) AS n FROM k a JOIN top ON a.word = top.word JOIN k b ON a.doc = b.doc AND a.word <> b.word GROUP BY ALL HAVING count(*) >= 3")
def related_words(spark, d):
    """Keywords that stand in documents with the five commonest ones."""
    k = _keywords(spark, d, 10).select("doc", "word")
    top = k.groupBy("word").agg(n("c")).orderBy(F.desc("c"), "word").limit(5).select("word")
    j = k.join(F.broadcast(top), "word").join(k.select("doc", F.col("word").alias("other")), "doc").where("word <> other")
    return j.groupBy("word", "other").agg(n()).where("n >= 3")


# thesaurus


@query(f"WITH {CURT}, s AS (SELECT term_id, lower(unnest(synonyms)) AS synonym FROM cur) SELECT DISTINCT s.term_id, c.term_id AS synonym_id, synonym FROM s JOIN cur c ON lower(c.term) = synonym AND c.term_id <> s.term_id")
def synonym_terms(spark, d):
    """Synonyms that are terms themselves."""
    t = latest(table(spark, d, "thesaurus"), "term_id", "exported_at", F.col("term"), F.col("synonyms"))
    s = t.select("term_id", F.explode("synonyms").alias("synonym")).select("term_id", F.lower("synonym").alias("synonym"))
    return s.join(t.select(F.lower("term").alias("synonym"), F.col("term_id").alias("synonym_id")), "synonym").where("term_id <> synonym_id").select("term_id", "synonym_id", "synonym").distinct()


@query(f"WITH {CURT}, l AS (SELECT term_id, term, len(coalesce(synonyms, [])) AS s, len(coalesce(related, [])) AS r, len(coalesce(broader, [])) AS b, len(coalesce(articles, [])) AS a FROM cur) SELECT term_id, (CASE WHEN s > 0 THEN 25 ELSE 0 END + CASE WHEN r > 0 THEN 25 ELSE 0 END + CASE WHEN b > 0 THEN 25 ELSE 0 END + CASE WHEN a > 0 THEN 25 ELSE 0 END)::INT AS quality, (2 * a + s + r)::INT AS importance FROM l")
def term_quality(spark, d):
    """How fully each term is described, and how much hangs on it."""
    cols = ("synonyms", "related", "broader", "articles")
    t = latest(table(spark, d, "thesaurus"), "term_id", "exported_at", F.col("term"), *[F.col(c) for c in cols])
    size = {c: F.coalesce(F.array_size(c), F.lit(0)) for c in cols}
    q = sum((F.when(size[c] > 0, 25).otherwise(0) for c in cols), F.lit(0))
    return t.select("term_id", q.alias("quality"), (2 * size["articles"] + size["synonyms"] + size["related"]).alias("importance"))


@query(f"WITH {CURT}, w AS (SELECT term_id, term, list_filter(string_split_regex(term, '[ _-]+'), lambda x: x <> '') AS ws FROM cur WHERE term IS NOT NULL) SELECT upper(array_to_string(list_transform(ws, lambda x: x[1]), '')) AS initials, count(*) AS n, min(term_id) AS first_id FROM w WHERE len(ws) > 1 GROUP BY 1")
def compound_terms(spark, d):
    """Terms of several words by their initials."""
    t = latest(table(spark, d, "thesaurus"), "term_id", "exported_at", F.col("term")).where("term IS NOT NULL").withColumn("ws", F.filter(F.split("term", "[ _-]+"), lambda x: x != "")).where(F.size("ws") > 1)
    return t.groupBy(F.upper(F.array_join(F.transform("ws", lambda x: F.substring(x, 1, 1)), "")).alias("initials")).agg(n(), F.min("term_id").alias("first_id"))


# change log


@query(f"WITH {C_} SELECT author, count(*) AS n_commits, round(avg(files), 6) AS mean_files, round(avg(length(coalesce(message, ''))), 6) AS mean_message, round(avg((isodow(cts) >= 6)::INT), 6) AS weekend_share, count(DISTINCT cts::DATE) AS n_days FROM cm GROUP BY author")
def contributor_patterns(spark, d):
    c = commits(spark, d)
    return c.groupBy("author").agg(
        n("n_commits"), r6(F.avg("files"), "mean_files"), r6(F.avg(F.length(F.coalesce("message", F.lit("")))), "mean_message"), r6(F.avg((F.weekday("at") >= 5).cast("int")), "weekend_share"), F.countDistinct(F.to_date("at")).alias("n_days"),
    )


@query(f"WITH {C_} SELECT strftime(cts, '%Y-%m') AS version, lower(regexp_extract(coalesce(message, ''), '^(\\w+)', 1)) AS kind, count(*) AS n, sum(insertions)::BIGINT AS insertions FROM cm GROUP BY ALL")
def version_summary(spark, d):
    """Changes of each month by the first word of their message."""
    return commits(spark, d).groupBy(F.date_format("at", "yyyy-MM").alias("version"), F.lower(F.regexp_extract(F.coalesce("message", F.lit("")), r"^(\w+)", 1)).alias("kind")).agg(n(), F.sum("insertions").alias("insertions"))
