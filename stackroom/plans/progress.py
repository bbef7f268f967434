"""Reading progress, goals, achievements, suggestions and series of articles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.operators import progress as P
from stackroom.plans.catalog import ART, arts
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


#: Reads in SQL: views of the event stream, event ids standing for what is read.
RD = "rd AS (SELECT user_id AS reader, ts::TIMESTAMP AS at_time, json_extract_string(props, '$.k')::INT % 8 AS category FROM events WHERE event_type = 'view')"


def _reads(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select(F.col("user_id").alias("reader"), F.col("ts").cast("timestamp").alias("at"), (F.get_json_object("props", "$.k").cast("int") % 8).alias("category"))


@query(f"WITH {RD}, nw AS (SELECT max(ts)::TIMESTAMP AS now FROM events) SELECT reader, sum((at_time >= date_trunc('day', now))::INT)::BIGINT AS today, sum((at_time >= date_trunc('week', now))::INT)::BIGINT AS week, sum((at_time >= date_trunc('month', now))::INT)::BIGINT AS month FROM rd, nw WHERE at_time <= now GROUP BY reader")
def goal_progress(spark, d):
    now = table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("now"))
    return P.goal_counts(_reads(spark, d).join(F.broadcast(now)), F.col("now"))


ST = f"""{RD}, dy AS (SELECT DISTINCT reader, at_time::DATE AS day FROM rd), rn AS (SELECT reader, day - (row_number() OVER (PARTITION BY reader ORDER BY day))::INT AS run FROM dy), sk AS (SELECT reader, max(n) AS streak FROM (SELECT reader, run, count(*) AS n FROM rn GROUP BY ALL) GROUP BY reader),
ct AS (SELECT reader, max(n) AS category FROM (SELECT reader, category, count(*) AS n FROM rd GROUP BY ALL) GROUP BY reader), ss AS (SELECT reader, count(*) AS reads, any_value(streak) AS streak, any_value(ct.category) AS category FROM rd JOIN sk USING (reader) JOIN ct USING (reader) GROUP BY reader),
ac AS (SELECT reader, name AS achievement, CASE kind WHEN 'reads' THEN reads WHEN 'streak' THEN streak ELSE category END::BIGINT AS value, threshold FROM ss, (VALUES {", ".join(f"('{a}', '{k}', {t})" for a, k, t in P.ACHIEVEMENTS)}) AS v(name, kind, threshold))"""


def _achievements(spark, d):
    r = _reads(spark, d)
    streak = P.longest_streak(r.select("reader", F.to_date("at").alias("day")))
    best = r.groupBy("reader", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("reader").agg(F.max("n").alias("category"))
    return P.achievements(r.groupBy("reader").agg(F.count(F.lit(1)).alias("reads")).join(streak, "reader", "left").join(best, "reader", "left"))


@query(f"WITH {ST} SELECT reader, achievement, value, threshold, value >= threshold AS unlocked FROM ac")
def achievements(spark, d):
    return _achievements(spark, d)


@query(f"WITH {ST} SELECT reader, achievement, round(value / threshold, 6) AS progress, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY value / threshold DESC, achievement) AS k FROM ac WHERE value < threshold) WHERE k <= 5")
def next_achievements(spark, d):
    return P.next_achievements(_achievements(spark, d)).select("reader", "achievement", F.round("progress", 6).alias("progress"), "k")


#: Read articles in SQL: published ones; in progress: reviewed ones. Series are the subcategories, parts by id.
SR = "pt AS (SELECT category || '/' || subcategory AS series, (id % 12 + 1)::BIGINT AS part, id AS article, difficulty_score AS difficulty FROM art), p1 AS (SELECT series, part, min(article) AS article, arg_min(difficulty, article) AS difficulty, count(*) - 1 AS again FROM pt GROUP BY ALL)"


def _chains(spark, d):
    return P.chains(arts(spark, d).select(F.concat_ws("/", "category", "subcategory").alias("series"), (F.col("id") % 12 + 1).cast("bigint").alias("part"), F.col("id").alias("article"), F.col("difficulty_score").alias("difficulty")))


@query(f"""WITH {ART}, {SR.replace("arg_min(difficulty, article)", "arg_min_null(difficulty, article)")}, g AS (SELECT series, count(*)::INT AS n_parts, sum(again)::BIGINT AS n_repeated, list(difficulty ORDER BY part) FILTER (difficulty IS NOT NULL) AS df, list(part ORDER BY part) AS ps FROM p1 GROUP BY series), m AS (SELECT *, list_filter(range(1, list_max(ps) + 1), lambda x: NOT list_contains(ps, x)) AS ms FROM g)
SELECT series, n_parts, n_repeated, round(list_avg(df), 6) AS mean_difficulty, list_min(df)::INT AS least, list_max(df)::INT AS greatest, coalesce(list_sort(df) = df, true) AS progressive, array_to_string(ms, ',') AS missing, len(ms)::INT AS n_missing, greatest(0, 100 - 10 * len(ms) - 5 * n_repeated)::BIGINT AS score FROM m""")
def chain_reports(spark, d):
    """Difficulty, missing parts and score of every series."""
    return P.chain_report(_chains(spark, d)).withColumn("mean_difficulty", F.round("mean_difficulty", 6))


@query(f"WITH {ART}, {SR} SELECT series, article, (row_number() OVER w)::INT AS place, lag(article) OVER w AS previous, lead(article) OVER w AS next FROM p1 WINDOW w AS (PARTITION BY series ORDER BY part)")
def chain_navigation(spark, d):
    return P.chain_navigation(_chains(spark, d))


@query(f"WITH {ART}, {SR}, c AS (SELECT series, list(CAST(article AS STRING) ORDER BY part) AS m FROM p1 GROUP BY series), r AS (SELECT series, list_filter(m, lambda x: x <> m[1]) AS w FROM c), e AS (SELECT series, list_concat(list_concat(w[1:1], ['new']), w[2:]) AS w FROM r) SELECT series, array_to_string(w, ',') AS members FROM e")
def edited_chains(spark, d):
    """Each series without its first article and with a new one in second place."""
    c = _chains(spark, d).select("series", F.transform("parts", lambda p: p["article"].cast("string")).alias("m"))
    return c.select("series", F.array_join(P.edited_chain(F.col("m"), F.lit("new"), F.lit(2), F.col("m")[0]), ",").alias("members"))


@query(f"WITH {ART}, c AS (SELECT category, count(*) AS n_articles, sum((status = 'published')::INT)::BIGINT AS n_published FROM art WHERE subcategory = '-' GROUP BY category UNION ALL SELECT category || '/' || subcategory, count(*), sum((status = 'published')::INT)::BIGINT FROM art WHERE subcategory <> '-' GROUP BY 1) SELECT * FROM c WHERE n_articles >= 3 AND n_published * 10 < n_articles * 9")
def new_chain_ideas(spark, d):
    """Groups of three articles and more of which less than nine in ten are published."""
    name = F.when(F.col("subcategory") == "-", F.col("category")).otherwise(F.concat_ws("/", "category", "subcategory"))
    g = arts(spark, d).groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n_articles"), F.count_if(F.col("status") == "published").alias("n_published"))
    return g.where("n_articles >= 3 AND n_published * 10 < n_articles * 9")


@query(f"WITH {ART}, c AS (SELECT category, avg((status = 'published')::INT) AS done FROM art GROUP BY category ORDER BY done, category LIMIT 3), s AS (SELECT id, art.category, round(50 - 50 * done, 6) AS score, row_number() OVER (PARTITION BY art.category ORDER BY id) AS k FROM art JOIN c USING (category) WHERE status <> 'published') SELECT category, id, score, k::INT AS k FROM s WHERE k <= 5")
def gap_fillers(spark, d):
    """First five open articles of each of the three least complete categories."""
    a = arts(spark, d)
    done = a.groupBy("category").agg(F.avg((F.col("status") == "published").cast("int")).alias("done")).orderBy("done", "category").limit(3)
    # the smallest ids by a bounded aggregate per block of ids, then among those
    open_ = a.where("status <> 'published'").join(F.broadcast(done), "category").withColumn("b", F.floor(F.col("id") / 4096))
    w = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("id"))
    some = open_.withColumn("k", w("category", "b")).where("k <= 5").withColumn("k", w("category")).where("k <= 5")
    return some.select("category", "id", F.round(50 - 50 * F.col("done"), 6).alias("score"), "k")


@query(f"WITH {ART} SELECT id, title, words FROM art WHERE status IN ('review', 'in-review', 'draft') AND modified IS NOT NULL ORDER BY modified DESC, id LIMIT 5")
def continue_reading(spark, d):
    return arts(spark, d).where("status IN ('review', 'in-review', 'draft') AND modified IS NOT NULL").orderBy(F.desc("modified"), "id").limit(5).select("id", "title", "words")


SUG = """t AS (SELECT DISTINCT owner, tag FROM (SELECT owner, unnest(tags) AS tag FROM own)), ca AS (SELECT DISTINCT owner, category FROM own), ev AS (SELECT owner, article, 10 AS s FROM (SELECT id AS article, unnest(tags) AS tag FROM cand) JOIN t USING (tag) UNION ALL SELECT owner, id, 20 FROM cand JOIN ca USING (category)),
sg AS (SELECT owner, article, sum(s)::BIGINT AS score FROM ev WHERE (owner, article) NOT IN (SELECT owner, id FROM own) GROUP BY ALL) SELECT owner, article, score, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, article) AS k FROM sg) WHERE k <= 5"""


@query(f"WITH {ART}, own AS (SELECT 'latest' AS owner, id, category, tags FROM (SELECT * FROM art WHERE status = 'published' AND modified IS NOT NULL ORDER BY modified DESC, id LIMIT 5)), cand AS (SELECT * FROM art WHERE status <> 'published'), {SUG}")
def related_to_recent(spark, d):
    """Open articles most like the five published last."""
    a = arts(spark, d)
    own = a.where("status = 'published' AND modified IS NOT NULL").orderBy(F.desc("modified"), "id").limit(5).select(F.lit("latest").alias("owner"), F.col("id").alias("article"), "category", "tags")
    return P.suggested(a.where("status <> 'published'").select(F.col("id").alias("article"), "category", "tags"), own)


@query(f"WITH {ART}, own AS (SELECT category || '/' || subcategory AS owner, id, category, tags FROM art), cand AS (SELECT * FROM art WHERE coalesce(inlinks, 0) = 0), {SUG}")
def chain_candidates(spark, d):
    """Articles without links to them that fit each series best."""
    a = arts(spark, d)
    own = a.select(F.concat_ws("/", "category", "subcategory").alias("owner"), F.col("id").alias("article"), "category", "tags")
    return P.suggested(a.where("coalesce(inlinks, 0) = 0").select(F.col("id").alias("article"), "category", "tags"), own)
