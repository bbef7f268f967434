"""Queries of streaming and incremental operators; the batch SQL is what the stream must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.operators import incremental as I
from stackroom.streaming import events as S
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


def _events(spark, d):
    return S.read(spark, d, "events.parquet", "ts")


def _hour(c):
    return F.floor(F.unix_seconds(c) / 3600)


@query("SELECT epoch_us(ts) // 3600000000 AS hour_number, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = S.run(S.tumbling(_events(spark, d), "ts", "1 hour", "event_type"), "complete")
    return out.select(_hour("window_start").alias("hour_number"), "event_type", "n")


@query("WITH e AS (SELECT epoch_us(ts) // 1800000000 AS h, event_type FROM events), s AS (SELECT h - unnest([0, 1]) AS half_hour, event_type FROM e) SELECT half_hour, event_type, count(*) AS n FROM s GROUP BY ALL")
def stream_sliding(spark, d):
    out = S.run(S.sliding(_events(spark, d), "ts", "1 hour", "30 minutes", "event_type"), "complete")
    return out.select(F.floor(F.unix_seconds("window_start") / 1800).alias("half_hour"), "event_type", "n")


@query('WITH e AS (SELECT user_id AS key, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000)::INT, 1) AS new FROM events), s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT key, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY key, g')
def stream_sessions(spark, d):
    out = S.run(S.sessions(_events(spark, d), "ts", "user_id", 1800), "complete")
    return out.select("key", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("SELECT DISTINCT event_id FROM events")
def stream_deduplicated(spark, d):
    return S.run(S.deduplicated(_events(spark, d), "event_id"), "append").select("event_id")


@query("SELECT user_id, epoch_us(ts) AS ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_latest(spark, d):
    out = S.run(S.latest(_events(spark, d), "user_id", "ts", "event_id"), "complete")
    return out.select("user_id", F.unix_micros("ts").alias("ts"), "event_id")


@query("WITH r AS (SELECT user_id AS key, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT key, max(n) AS n_seen, string_agg(event_type, ',' ORDER BY event_id) AS history FROM r WHERE k <= 10 GROUP BY key")
def stream_bounded_history(spark, d):
    out = S.run(S.bounded_history(_events(spark, d), "user_id", "event_id", "event_type"), "update")
    # an update per batch and key: the one that has seen most is the last
    last = out.groupBy("key").agg(F.max(F.struct("n_seen", "history")).alias("x"))
    return last.select("key", "x.n_seen", F.array_join("x.history", ",").alias("history"))


@query("WITH g AS (SELECT user_id AS key, epoch_us(ts) // 600000000 AS ten_minutes, count(*) AS n FROM events GROUP BY ALL) SELECT key, ten_minutes, n, least(n, 3) AS allowed FROM g")
def stream_rate_limit(spark, d):
    out = S.run(S.rate_limited(_events(spark, d), "user_id", "ts", 3, "10 minutes"), "complete")
    return out.select("key", F.floor(F.unix_seconds("window_start") / 600).alias("ten_minutes"), "n", "allowed")


# incremental

V = "v AS (SELECT record_id, min(loaded_at) AS a, max(loaded_at) AS b FROM orphans_analysis GROUP BY 1)"


@query(f"WITH {V}, x AS (SELECT o.record_id AS id, max(metadata.content_length) FILTER (loaded_at = a) AS h0, max(metadata.content_length) FILTER (loaded_at = b) AS h1 FROM orphans_analysis o JOIN v USING (record_id) GROUP BY 1) SELECT id AS key, 'changed' AS change FROM x WHERE h0 IS DISTINCT FROM h1")
def change_capture(spark, d):
    """Records whose content length differs between their first and their last version."""
    o = table(spark, d, "orphans_analysis").select("record_id", "loaded_at", F.col("metadata.content_length").alias("c"))
    ends = o.groupBy("record_id").agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b"))
    j = o.join(ends, "record_id")
    return I.changes(j.where("loaded_at = a"), j.where("loaded_at = b"), "record_id", F.col("c"))


@query("WITH h AS (SELECT md5(text) AS h, doc_id, fetched_at FROM documents WHERE text IS NOT NULL), f AS (SELECT h, arg_min(doc_id, (fetched_at, doc_id)) AS first_id, count(*) AS c FROM h GROUP BY h) SELECT doc_id AS key, first_id AS duplicate_of FROM h JOIN f USING (h) WHERE c > 1 AND doc_id <> first_id")
def duplicate_history(spark, d):
    t = table(spark, d, "documents").select("doc_id", "fetched_at", F.md5("text").alias("h"))
    return I.first_seen(t, "h", "fetched_at", "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 2000 DAY")
def retention(spark, d):
    o = table(spark, d, "orders")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0]).cast("timestamp")
    return I.expired(o, "o_orderdate", now, 2000 * 24, F.col("o_orderstatus") == "F").select("o_orderkey")


@query("WITH s AS (SELECT o_orderkey AS id, o_orderdate AS taken_at, CASE WHEN o_orderkey % 50 = 0 THEN 'full' ELSE 'incremental' END AS kind FROM orders), l AS (SELECT max(taken_at) AS since FROM s WHERE kind = 'full') SELECT id, kind FROM s, l WHERE taken_at > since AND kind = 'incremental' OR taken_at = since")
def backup_chain(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"), F.when(F.col("o_orderkey") % 50 == 0, "full").otherwise("incremental").alias("kind"))
    return I.backup_chain(s).select("id", "kind")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, -2.0::DOUBLE FROM customer WHERE c_custkey % 7 = 0")
def keyed_upsert(spark, d):
    """All customers as state; a third is changed, a seventh comes new under other keys."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(-2.0).alias("c_acctbal"))
    return I.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)).unionByName(new), "c_custkey")


@query("SELECT n_regionkey, s_suppkey, s_acctbal FROM (SELECT n_regionkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE r <= 10")
def keep_newest(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return I.keep_newest(s.join(n, s.s_nationkey == n.n_nationkey), "s_acctbal", 10, "n_regionkey").select("n_regionkey", "s_suppkey", "s_acctbal")
