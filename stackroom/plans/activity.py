"""Queries over the change log, the event stream and the orders: activity in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.operators import sequence as S
from stackroom.skew import pairs_within
from stackroom.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Changed files and commits in SQL: repeated rows once, one commit per hash.
F_ = "f AS (SELECT DISTINCT change_id, hash, author, email, path, message, insertions, deletions, files_count, category, (loaded_at AT TIME ZONE 'UTC') AS loaded_at FROM recent_changes)"
C_ = F_ + """, cm AS (SELECT hash, min(author) AS author, min(message) AS message, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, max(files_count)::INT AS files, min(loaded_at) AS cts FROM f GROUP BY hash)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recent_changes").select("change_id", "hash", "author", "email", "path", "message", "insertions", "deletions", "files_count", "category", "loaded_at").distinct()


def commits(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("hash").agg(
        F.min("author").alias("author"), F.min("message").alias("message"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.max("files_count").alias("files"), F.min("loaded_at").alias("at"),
    )


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def micros(c: str, name: str | None = None):
    """Microseconds since 1970 of a timestamp with or without zone; without one it is read as the session's."""
    return F.unix_micros(F.col(c).cast("timestamp")).alias(name or c)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"WITH {C_} SELECT author, count(*) AS n_commits, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, epoch_us(min(cts)) AS first_at, epoch_us(max(cts)) AS last_at FROM cm GROUP BY author")
def contributor_stats(spark, d):
    return commits(spark, d).groupBy("author").agg(n("n_commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.unix_micros(F.min("at")).alias("first_at"), F.unix_micros(F.max("at")).alias("last_at"))


@query(f"WITH {F_} SELECT path, count(DISTINCT hash) AS n_commits, count(DISTINCT author) AS n_authors, sum(insertions + deletions)::BIGINT AS churn, epoch_us(max(loaded_at)) AS last_at FROM f WHERE path IS NOT NULL GROUP BY path ORDER BY churn DESC, path LIMIT 20")
def hotspots(spark, d):
    g = files(spark, d).where("path IS NOT NULL").groupBy("path").agg(F.countDistinct("hash").alias("n_commits"), F.countDistinct("author").alias("n_authors"), F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.unix_micros(F.max("loaded_at")).alias("last_at"))
    return g.orderBy(F.desc("churn"), "path").limit(20)


@query(f"WITH {F_} SELECT path, count(*) AS n_changes, date_diff('day', max(loaded_at)::DATE, DATE '2026-03-01')::INT AS idle_days FROM f WHERE path IS NOT NULL GROUP BY path")
def edit_counts(spark, d):
    g = files(spark, d).where("path IS NOT NULL").groupBy("path").agg(n("n_changes"), F.max("loaded_at").alias("m"))
    return g.select("path", "n_changes", F.datediff(F.lit("2026-03-01").cast("date"), F.to_date("m")).alias("idle_days"))


@query(f"""WITH {F_}, g AS (SELECT path, count(*) AS edits, date_diff('day', max(loaded_at)::DATE, DATE '2026-03-01') AS days FROM f WHERE path IS NOT NULL GROUP BY path)
SELECT path, round(1.5::DOUBLE * ln(1 + edits) + 2 * exp(-days / 30.0::DOUBLE), 6) AS popularity FROM g ORDER BY popularity DESC, path LIMIT 50""")
def popularity(spark, d):
    g = files(spark, d).where("path IS NOT NULL").groupBy("path").agg(n("edits"), F.datediff(F.lit("2026-03-01").cast("date"), F.to_date(F.max("loaded_at"))).alias("days"))
    p = 1.5 * F.log(1 + F.col("edits")) + 2 * F.exp(-F.col("days") / 30.0)
    return g.select("path", r6(p, "popularity")).orderBy(F.desc("popularity"), "path").limit(50)


@query(f"WITH {C_} SELECT hour(cts)::INT AS hour, count(*) AS n FROM cm GROUP BY 1")
def hour_histogram(spark, d):
    return commits(spark, d).groupBy(F.hour("at").alias("hour")).agg(n())


@query(f"WITH {C_}, h AS (SELECT unnest(range(0, 24))::INT AS hour), c AS (SELECT hour(cts) AS hour, count(*) AS n FROM cm GROUP BY 1) SELECT h.hour, coalesce(n, 0) AS n FROM h LEFT JOIN c USING (hour)")
def activity_heatmap(spark, d):
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(hour_histogram(spark, d), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {C_} SELECT isodow(cts)::INT AS weekday, count(*) AS n, round(avg(insertions), 6) AS mean_insertions FROM cm GROUP BY 1")
def weekday_histogram(spark, d):
    return commits(spark, d).groupBy((F.weekday("at") + 1).alias("weekday")).agg(n(), r6(F.avg("insertions"), "mean_insertions"))


KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{p}') THEN '{k}'" for k, p in S.COMMIT_KINDS) + " ELSE 'other' END"


@query(f"WITH {C_} SELECT {KIND} AS kind, count(*) AS n, count(DISTINCT author) AS n_authors FROM cm GROUP BY 1")
def commit_kinds(spark, d):
    return commits(spark, d).groupBy(S.commit_kind(F.col("message")).alias("kind")).agg(n(), F.countDistinct("author").alias("n_authors"))


@query(f"WITH {C_}, s AS (SELECT insertions + deletions AS c FROM cm) SELECT CASE WHEN c < 10 THEN 'tiny' WHEN c < 50 THEN 'small' WHEN c < 200 THEN 'medium' WHEN c < 500 THEN 'large' ELSE 'huge' END AS size, count(*) AS n FROM s GROUP BY 1")
def commit_sizes(spark, d):
    return commits(spark, d).groupBy(S.size_class(F.col("insertions") + F.col("deletions")).alias("size")).agg(n())


RISK = "(CASE WHEN insertions + deletions > 500 THEN 40 WHEN insertions + deletions > 200 THEN 25 WHEN insertions + deletions > 50 THEN 10 ELSE 0 END + CASE WHEN files > 10 THEN 30 WHEN files > 5 THEN 15 ELSE 0 END + CASE WHEN deletions > insertions THEN 25 ELSE 0 END)"


@query(f"WITH {C_}, r AS (SELECT hash, {RISK} AS points FROM cm) SELECT hash, points, CASE WHEN points >= 80 THEN 'critical' WHEN points >= 50 THEN 'high' WHEN points >= 25 THEN 'medium' ELSE 'low' END AS level FROM r")
def commit_risk(spark, d):
    p = S.risk(F.col("insertions") + F.col("deletions"), F.col("files"), F.col("deletions"), F.col("insertions"))
    return commits(spark, d).select("hash", p.alias("points")).withColumn("level", S.risk_level(F.col("points")))


@query(f"""WITH {C_}, m AS (SELECT author, (CASE WHEN length(message) BETWEEN 10 AND 72 THEN 40 ELSE 10 END + CASE WHEN len(string_split(trim(message), ' ')) >= 2 THEN 20 ELSE 0 END + CASE WHEN regexp_matches(message, '^[А-ЯЁA-Z]') THEN 20 ELSE 0 END + CASE WHEN ends_with(message, '.') THEN 0 ELSE 20 END) AS score FROM cm)
SELECT author, round(avg(score), 6) AS mean_score, min(score)::INT AS worst FROM m GROUP BY author""")
def message_quality(spark, d):
    return commits(spark, d).select("author", S.message_score(F.col("message")).alias("score")).groupBy("author").agg(r6(F.avg("score"), "mean_score"), F.min("score").alias("worst"))


@query(f"WITH {C_}, w AS (SELECT unnest(string_split_regex(lower(message), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM cm) SELECT word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY word ORDER BY n DESC, word LIMIT 15")
def message_words(spark, d):
    w = commits(spark, d).select(F.explode(F.split(F.lower("message"), r"[^\p{L}\p{N}_]+")).alias("word")).where(F.length("word") > 2)
    return w.groupBy("word").agg(n()).orderBy(F.desc("n"), "word").limit(15)


@query(f"""WITH {C_}, a AS (SELECT author, count(*) AS c FROM cm GROUP BY author), x AS (SELECT row_number() OVER (ORDER BY c DESC, author) AS k, sum(c) OVER (ORDER BY c DESC, author) AS upto, sum(c) OVER () AS total FROM a), b AS (SELECT min(k)::INT AS bus_factor FROM x WHERE upto * 2 >= total)
SELECT bus_factor, CASE WHEN bus_factor < 3 THEN 'critical' WHEN bus_factor < 5 THEN 'medium' ELSE 'low' END AS risk FROM b""")
def bus_factor(spark, d):
    return S.bus_factor(commits(spark, d), "author")


@query(f"""WITH {C_}, dd AS (SELECT cts::DATE AS day, count(*) AS n FROM cm GROUP BY 1), x AS (SELECT n, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS t FROM dd), g AS (SELECT avg(n) FILTER (k <= t // 2) AS earlier, avg(n) FILTER (k > t // 2) AS later FROM x)
SELECT round(earlier, 6) AS earlier, round(later, 6) AS later, CASE WHEN later > earlier * 1.2 THEN 'accelerating' WHEN later < earlier * 0.8 THEN 'slowing' ELSE 'stable' END AS trend FROM g""")
def velocity_trend(spark, d):
    return S.velocity(commits(spark, d), "at").select(r6("earlier", "earlier"), r6("later", "later"), "trend")


@query(f"""WITH {C_}, dd AS (SELECT DISTINCT author AS key, cts::DATE AS day FROM cm WHERE author IS NOT NULL), a AS (SELECT key, day, day - row_number() OVER (PARTITION BY key ORDER BY day)::INT AS g FROM dd) SELECT key, min(day)::DATE::VARCHAR AS start_day, count(*) AS days FROM a GROUP BY key, g""")
def streaks(spark, d):
    return S.streaks(commits(spark, d), "author", "at").withColumn("start_day", F.col("start_day").cast("string"))


@query(f"""WITH {C_}, dd AS (SELECT DISTINCT author AS key, cts::DATE AS day FROM cm WHERE author IS NOT NULL), a AS (SELECT key, day, day - row_number() OVER (PARTITION BY key ORDER BY day)::INT AS g FROM dd), s AS (SELECT key, count(*) AS days FROM a GROUP BY key, g) SELECT key AS author, max(days) AS longest, count(*) AS n_streaks FROM s GROUP BY key""")
def longest_streaks(spark, d):
    return S.streaks(commits(spark, d), "author", "at").groupBy(F.col("key").alias("author")).agg(F.max("days").alias("longest"), n("n_streaks"))


@query(f"""WITH {C_}, m AS (SELECT author, strftime(cts, '%Y-%m') AS month, count(*) AS n FROM cm GROUP BY ALL), x AS (SELECT *, avg(n) OVER (PARTITION BY author) AS mean, count(*) OVER (PARTITION BY author) AS k FROM m) SELECT author, month, n, round(mean, 6) AS mean FROM x WHERE k >= 3 AND n >= 2 * mean""")
def activity_spikes(spark, d):
    return S.spikes(S.monthly(commits(spark, d), "at", "author"), "author").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {C_}, m AS (SELECT strftime(cts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT author) AS n_authors FROM cm GROUP BY 1) SELECT month, n, n_authors, CASE WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS intensity, coalesce(n - lag(n) OVER (ORDER BY month), 0)::BIGINT AS delta FROM m""")
def monthly_activity(spark, d):
    m = commits(spark, d).groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(n(), F.countDistinct("author").alias("n_authors"))
    i = F.when(F.col("n") > 20, "high").when(F.col("n") > 5, "medium").otherwise("low")
    return m.select("month", "n", "n_authors", i.alias("intensity"), F.coalesce(F.col("n") - F.lag("n").over(W.orderBy("month")), F.lit(0)).alias("delta"))


@query(f"""WITH {F_}, p AS (SELECT DISTINCT author, path FROM f WHERE author IS NOT NULL AND path IS NOT NULL) SELECT a.author AS a, b.author AS b, count(*) AS n_files FROM p a JOIN p b ON a.path = b.path AND a.author < b.author GROUP BY ALL ORDER BY n_files DESC, a, b LIMIT 10""")
def collaboration_pairs(spark, d):
    """Author pairs by common files; a file of many authors is cut into blocks."""
    p = files(spark, d).where("author IS NOT NULL AND path IS NOT NULL").select("path", "author").distinct()
    return pairs_within(p, "path", "author").groupBy("a", "b").agg(n("n_files")).orderBy(F.desc("n_files"), "a", "b").limit(10)


FK = "CASE WHEN path IS NULL THEN 'unknown' WHEN contains(lower(path), '/index/') THEN 'index' WHEN regexp_matches(lower(path), '\\.(md|markdown)$') THEN 'article' WHEN regexp_matches(lower(path), '\\.(json|ya?ml|toml|cfg|ini)$') THEN 'config' ELSE 'other' END"


@query(f"WITH {F_}, k AS (SELECT author, {FK} AS kind, count(*) AS n FROM f GROUP BY ALL) SELECT author, kind, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY author), 6) AS pct FROM k")
def author_specialization(spark, d):
    k = files(spark, d).groupBy("author", S.file_kind(F.col("path")).alias("kind")).agg(n())
    return k.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("author")), 6))


@query(f"WITH {F_} SELECT coalesce(category, 'none') AS category, count(*) AS n_files, count(DISTINCT hash) AS n_commits, sum(insertions)::BIGINT AS insertions FROM f GROUP BY 1")
def change_categories(spark, d):
    return files(spark, d).groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(n("n_files"), F.countDistinct("hash").alias("n_commits"), F.sum("insertions").alias("insertions"))


@query(f"WITH {F_}, t AS (SELECT path, loaded_at, row_number() OVER (PARTITION BY path ORDER BY loaded_at DESC, change_id DESC) AS k, lag(loaded_at) OVER (PARTITION BY path ORDER BY loaded_at, change_id) AS before FROM f WHERE path IS NOT NULL), g AS (SELECT path, avg((epoch_us(loaded_at) - epoch_us(before)) / 86400000000) AS days FROM t WHERE k <= 5 AND before IS NOT NULL GROUP BY path) SELECT path, round(days, 6) AS mean_days, CASE WHEN days < 1 THEN 'always' WHEN days < 7 THEN 'daily' WHEN days < 30 THEN 'weekly' WHEN days < 90 THEN 'monthly' WHEN days < 365 THEN 'yearly' ELSE 'never' END AS changefreq FROM g")
def change_frequency(spark, d):
    """Mean of the five most recent intervals of each file."""
    f = files(spark, d).where("path IS NOT NULL").select("path", "loaded_at", "change_id", F.pmod(F.xxhash64("change_id"), F.lit(64)).alias("salt"))
    newest = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("loaded_at"), F.desc("change_id")))
    # the six newest of each salted part of a file, then of the file: five intervals reach from the first to the sixth
    six = f.withColumn("k", newest("path", "salt")).where("k <= 6").withColumn("k", newest("path")).where("k <= 6")
    g = six.groupBy("path").agg((F.count(F.lit(1)) - 1).alias("n"), F.max("loaded_at").alias("b"), F.min("loaded_at").alias("a")).where("n > 0")
    g = g.withColumn("days", (F.unix_micros("b") - F.unix_micros("a")) / 86400000000 / F.col("n"))
    x = F.col("days")
    c = F.when(x < 1, "always").when(x < 7, "daily").when(x < 30, "weekly").when(x < 90, "monthly").when(x < 365, "yearly").otherwise("never")
    return g.select("path", r6(x, "mean_days"), c.alias("changefreq"))


@query(f"WITH {C_}, dd AS (SELECT cts::DATE AS day, count(*) AS n FROM cm GROUP BY 1), x AS (SELECT day, n, coalesce((date_diff('day', lag(day) OVER (ORDER BY day), day) > 2)::INT, 1) AS new FROM dd), c AS (SELECT day, n, sum(new) OVER (ORDER BY day)::BIGINT AS cluster FROM x) SELECT cluster, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, sum(n)::BIGINT AS n FROM c GROUP BY cluster")
def day_clusters(spark, d):
    c = S.gap_clusters(commits(spark, d), "at", 2)
    return c.withColumn("first_day", F.col("first_day").cast("string")).withColumn("last_day", F.col("last_day").cast("string"))


# event stream

GAP = "e AS (SELECT user_id AS key, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000)::INT, 1) AS new FROM events), s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING)::INT AS session FROM e)"


@query(f'WITH {GAP} SELECT key, session, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY key, session')
def sessionize_gap30(spark, d):
    s = S.sessions(table(spark, d, "events"), "user_id", "ts", 1800)
    return s.select("key", "session", micros("start"), micros("end"), "n")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, approx_quantile(value, 0.5) IS NOT NULL AS has_median FROM events GROUP BY event_type")
def event_stats(spark, d):
    v = table(spark, d, "events")
    return v.groupBy("event_type").agg(n(), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value"), "mean"), F.median("value").isNotNull().alias("has_median"))


@query("WITH t AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before AS event_from, event_type AS event_to, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY ALL")
def event_transitions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select(F.lag("event_type").over(w).alias("event_from"), F.col("event_type").alias("event_to"))
    return t.where("event_from IS NOT NULL").groupBy("event_from", "event_to").agg(n())


@query("SELECT epoch_us(ts) // 3600000000 AS hour_number, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_hours(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(n(), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.floor(F.unix_seconds(F.col("w.start").cast("timestamp")) / 3600).alias("hour_number"), "event_type", "n", "total")


@query("SELECT user_id, event_id, epoch_us(ts) AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_user(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", "x.event_id", micros("x.ts", "ts"), "x.value")


@query("SELECT event_type, (json_extract(props, '$.k'))::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(n())


# orders as jobs of a service


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_cost FROM orders GROUP BY ALL")
def job_stats(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(n(), F.round(F.avg("o_totalprice"), 4).alias("mean_cost"))


@query("SELECT o_orderpriority AS tool, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS done, count(*) - sum((o_orderstatus = 'F')::INT)::BIGINT AS rest, round(100.0::DOUBLE * sum((o_orderstatus = 'F')::INT) / count(*), 6) AS success_pct FROM orders GROUP BY 1 ORDER BY n DESC, tool LIMIT 5")
def job_success(spark, d):
    done = F.sum((F.col("o_orderstatus") == "F").cast("int"))
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tool")).agg(n(), done.alias("done"))
    return g.select("tool", "n", "done", (F.col("n") - F.col("done")).alias("rest"), F.round(F.col("done") * 100.0 / F.col("n"), 6).alias("success_pct")).orderBy(F.desc("n"), "tool").limit(5)


@query("SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def job_page(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.offset(50).limit(50).select("o_orderkey", "o_custkey", micros("o_orderdate"))


@query("SELECT r_name, n_name, count(*) AS n_customers, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def region_taxonomy(spark, d):
    c, nn, rr = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(nn, c.c_nationkey == nn.n_nationkey).join(rr, nn.n_regionkey == rr.r_regionkey).groupBy("r_name", "n_name").agg(n("n_customers"), F.round(F.sum("c_acctbal"), 4).alias("balance"))
