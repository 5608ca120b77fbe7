"""Registered streaming queries: each runs a real Structured
Streaming query over the events / conversations files with ``availableNow``
and returns the sink; the batch twins carry the SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.plans.registry import query
from kestrel.session import Tables
from kestrel.streaming import ops as S


def _closed(spark, sf):
    return S.closed(S.event_stream(spark, sf), Tables(spark, sf).events)


def _plain(df):
    """Times without a zone, as the given tables have them."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name
                       for f in df.schema.fields])


RATE_SQL = """SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, user_id, n, n >= 3 AS over_limit
FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * k) MINUTE AS window_start, user_id, count(*) AS n
  FROM events, range(0, 4) t(k) GROUP BY ALL)"""


@query("r01_sliding_rate_batch", RATE_SQL)
def r01_sliding_rate_batch(spark, sf):
    return S.sliding_rate_batch(Tables(spark, sf).events, "user_id", limit=3)


@query("r01b_sliding_rate_stream", RATE_SQL)
def r01b_sliding_rate_stream(spark, sf):
    return _plain(S.run_available_now(S.sliding_rate(_closed(spark, sf), "user_id", limit=3), "rate"))


@query("r01c_per_event_rate", """SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000
  RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS events_in_window FROM events""")
def r01c_per_event_rate(spark, sf):
    return S.per_event_rate(Tables(spark, sf).events, "user_id")


@query("r02_sessions_stream", """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
    THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, sum(value) AS value
FROM s GROUP BY user_id, k""")
def r02_sessions_stream(spark, sf):
    return _plain(S.run_available_now(S.sessions(_closed(spark, sf), "user_id"), "sessions"))


@query("r03_running_counters", "SELECT conv_id, count(*) AS message_count, max(turn) AS last_message FROM conversations GROUP BY ALL")
def r03_running_counters(spark, sf):
    return S.running_counters(Tables(spark, sf).conversations)


@query("r03b_running_counters_stream", "SELECT conv_id, count(*) AS message_count, max(turn) AS last_message FROM conversations GROUP BY ALL")
def r03b_running_counters_stream(spark, sf):
    """The counters after three micro-batches, which split the turns of a conversation."""
    msgs = Tables(spark, sf).conversations
    stream = S.arrivals(msgs, F.timestamp_seconds(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3600))), 3)
    return S.latest_counters(S.run_available_now(S.counter_updates(stream), "counters"))


@query("r04_tumbling_kpis_stream", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS events,
  sum(value) AS value FROM events GROUP BY ALL""")
def r04_tumbling_kpis_stream(spark, sf):
    return _plain(S.run_available_now(S.tumbling_kpis(_closed(spark, sf)), "kpis")).drop("approx_users")


@query("r04b_tumbling_users_stream", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS events,
  count(DISTINCT user_id) AS users, sum(value) AS value FROM events GROUP BY ALL""")
def r04b_tumbling_users_stream(spark, sf):
    return _plain(S.kpis_of_users(S.run_available_now(S.user_kpis(_closed(spark, sf)), "user-kpis")))


@query("r05_stateful_alerts_stream")
def r05_stateful_alerts_stream(spark, sf):
    return S.run_available_now(S.stateful_alerts(S.event_stream(spark, sf)), "alerts")


@query("r06_dedupe_stream", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, event_type, min(ts) AS first_ts,
  count(*) AS n FROM events GROUP BY ALL""")
def r06_dedupe_stream(spark, sf):
    return _plain(S.run_available_now(S.sent_once(_closed(spark, sf), ["user_id", "event_type"]), "sent"))


def _dealt(spark, sf):
    """The events in four micro-batches, up to 30 minutes out of order, and the closing row."""
    events = Tables(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("ts") + F.make_interval(mins=F.pmod(F.xxhash64("event_id"), F.lit(31)).cast("int"))
    return S.arrivals(events, late, 4, "ts")


@query("r06b_sent_once_stream", """WITH e AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events)
SELECT user_id, event_type, ts, ts + INTERVAL 6 HOUR AS held_until FROM e WHERE before IS NULL OR ts > before + INTERVAL 6 HOUR""")
def r06b_sent_once_stream(spark, sf):
    """Sent when the user had no event of the type in the six hours before."""
    rows = S.run_available_now(S.once(_dealt(spark, sf), ["user_id", "event_type"], quiet="6 hours"), "sent-once")
    return _plain(rows.where("sent").drop("sent"))


@query("r07b_ttl_cache_stream", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events),
m(user_id, stored) AS (SELECT user_id, min(ts) FROM e GROUP BY user_id
  UNION ALL SELECT m.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = m.user_id AND e.ts > m.stored + INTERVAL 2 DAY)
    FROM m WHERE m.stored IS NOT NULL),
u AS (SELECT * FROM m WHERE stored IS NOT NULL)
SELECT user_id, stored, stored + INTERVAL 2 DAY AS expires, (SELECT count(*) FROM events v WHERE v.user_id = u.user_id
  AND v.ts >= u.stored AND v.ts <= u.stored + INTERVAL 2 DAY) - 1 AS hits FROM u""")
def r07b_ttl_cache_stream(spark, sf):
    """A cache entry per user that lives two days: when it was stored, when it expires, its hits."""
    rows = S.run_available_now(S.once(_dealt(spark, sf), ["user_id"], quiet="2 days", refresh=False), "ttl")
    return _plain(rows.groupBy("user_id", F.col("held_until").alias("expires")).agg(
        F.min("ts").alias("stored"), F.count_if(~F.col("sent")).alias("hits")))


@query("r07_retention_filter", "SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def r07_retention_filter(spark, sf):
    return S.retention_filter(Tables(spark, sf).events, "ts", 7)


@query("r08_stream_static_enrich", """SELECT e.*, w.weight FROM events e LEFT JOIN (VALUES ('purchase', 1.0::DOUBLE), ('click', 0.1::DOUBLE),
  ('view', 0.05::DOUBLE), ('signup', 2.0::DOUBLE), ('error', 0.0::DOUBLE)) w(event_type, weight) ON e.event_type = w.event_type""")
def r08_stream_static_enrich(spark, sf):
    static = spark.createDataFrame([("purchase", 1.0), ("click", 0.1), ("view", 0.05), ("signup", 2.0), ("error", 0.0)],
                                   "event_type string, weight double")
    return _plain(S.run_available_now(S.enrich(S.event_stream(spark, sf), static, "event_type"), "enrich"))
