"""Structured Streaming forms of the time-driven checks.

Every operator takes a streaming (or batch) DataFrame and returns one; the
batch twins in this module compute the same result on a static table so a
stream run with ``availableNow`` can be checked against them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import scratch_path


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", max_files: int = 1) -> DataFrame:
    """A file stream over one table of a scale-factor folder."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    s = (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
         .option("maxFilesPerTrigger", max_files).parquet(sf_dir))
    # event time must be a (session-zone) TIMESTAMP for watermarks
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields
                          if isinstance(f.dataType, T.TimestampNTZType)})


def closed(stream: DataFrame, events: DataFrame, ts: str = "ts", after: str = "30 days") -> DataFrame:
    """``stream`` and one closing row, ``after`` beyond the latest time of the
    static ``events`` and null elsewhere.  It moves the watermark past every
    window of the data, so an ``availableNow`` run emits them all; the closing
    row's own windows stay open and never come out."""
    spark = stream.sparkSession
    path = scratch_path(spark, "closing")
    row = _closing_row(events, ts, after, stream.schema)
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(row.schema).parquet(path))


def _closing_row(events: DataFrame, ts: str, after: str, schema: T.StructType | None = None) -> DataFrame:
    end = F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {after}")
    return events.agg(F.max(ts).alias(ts)).select(*[
        (end if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in (schema or events.schema).fields])


def sliding_rate(events: DataFrame, key: str, ts: str = "ts", size: str = "1 hour", slide: str = "15 minutes",
                 watermark: str = "10 minutes", limit: int = 60) -> DataFrame:
    """Events per key in sliding windows; ``over_limit`` when count >= limit."""
    g = events.withWatermark(ts, watermark).groupBy(F.window(ts, size, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n",
                    (F.col("n") >= limit).alias("over_limit"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """R2: session windows per key (idle timeout = gap): start, end, events."""
    g = events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), key).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return g.select(key, F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "events", "value")


def running_counters(msgs: DataFrame, key: str = "conv_id", ts: str = "turn") -> DataFrame:
    """message_count and last message per conversation (update mode)."""
    return msgs.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"), F.max(ts).alias("last_message"))


def tumbling_kpis(events: DataFrame, ts: str = "ts", size: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per tumbling window and event type: events, users (approximate: streams
    have no exact distinct in bounded state), value."""
    g = events.withWatermark(ts, watermark).groupBy(F.window(ts, size), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id").alias("approx_users"),
        F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "events", "approx_users", "value")


def user_kpis(events: DataFrame, ts: str = "ts", size: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """R4, first step: one state row per tumbling window, event type and user."""
    g = events.withWatermark(ts, watermark).groupBy(F.window(ts, size), "event_type", "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "user_id", "events", "value")


def kpis_of_users(rows: DataFrame) -> DataFrame:
    """R4, second step over the sink of ``user_kpis``: exact users per window and event type."""
    return rows.groupBy("window_start", "event_type").agg(
        F.sum("events").alias("events"), F.count("user_id").alias("users"), F.sum("value").alias("value"))


ALERT_STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()),
                            T.StructField("m2", T.DoubleType()), T.StructField("last", T.DoubleType())])
ALERT_OUT = "user_id long, ts timestamp, value double, prev double, z double, alert string"


def _alert_fn(z_high: float, jump_pct: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        n, mean, m2, last = state.get if state.exists else (0, 0.0, 0.0, None)
        out = []
        for pdf in pdfs:
            for ts, v in pdf.sort_values("ts")[["ts", "value"]].itertuples(index=False):
                sd = (m2 / n) ** 0.5 if n > 1 else None
                z = (v - mean) / sd if sd else None
                alert = None
                if z is not None and abs(z) > z_high:
                    alert = "anomaly"
                elif last not in (None, 0) and abs(v - last) / abs(last) * 100 > jump_pct:
                    alert = "jump"
                out.append((key[0], ts, v, last, z, alert))
                n += 1
                d = v - mean
                mean += d / n
                m2 += d * (v - mean)
                last = v
        state.update((n, mean, m2, last))
        yield pd.DataFrame(out, columns=["user_id", "ts", "value", "prev", "z", "alert"])
    return fn


def stateful_alerts(events: DataFrame, z_high: float = 3.0, jump_pct: float = 500.0) -> DataFrame:
    """Per user keep (count, mean, M2, last value) in state; flag a new
    value whose z against the history exceeds ``z_high`` (population sigma)
    or that jumps more than ``jump_pct`` % from the previous value."""
    ev = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return ev.groupBy("user_id").applyInPandasWithState(
        _alert_fn(z_high, jump_pct), ALERT_OUT, ALERT_STATE.simpleString(), "append", "NoTimeout")


def sent_once(events: DataFrame, keys: Sequence[str], ts: str = "ts", size: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """One row per ``keys`` and window: the time of the first event, which is
    sent, and the number of events, of which the others are held back.  State of
    a window goes once the watermark has passed it."""
    g = events.withWatermark(ts, watermark).groupBy(F.window(ts, size), *keys).agg(
        F.min(ts).alias("first_ts"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "first_ts", "n")


def arrivals(events: DataFrame, arrival, files: int, ts: str | None = None, after: str = "30 days") -> DataFrame:
    """A file stream that brings the rows of a static table in ``files`` micro-batches by
    the order of ``arrival`` (a column of times), one file each; several rows of a key
    can thus come in different batches and out of the order of their own times.  With
    ``ts`` a last file has a closing row, as in ``closed``."""
    spark = events.sparkSession
    at = events.withColumn("_arrival", F.col(arrival) if isinstance(arrival, str) else arrival)
    low, high = at.agg(F.min(F.unix_micros(F.col("_arrival").cast("timestamp"))), F.max(F.unix_micros(F.col("_arrival").cast("timestamp")))).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // files))
    dealt = at.withColumn("_file", F.floor((F.unix_micros(F.col("_arrival").cast("timestamp")) - F.lit(low or 0)) / F.lit(step)))
    path = scratch_path(spark, "arrivals")
    for i in range(files):  # one after the other: the file source takes the oldest first
        dealt.where(F.col("_file") == i).drop("_arrival", "_file").repartition(1).write.mode("append").parquet(path)
    if ts:
        _closing_row(events, ts, after).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


ONCE_STATE = "keys array<string>, until array<long>, counts array<int>, waiting array<long>"
#: keys as text and back, without loss
_KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _once_fn(quiet_us: int, refresh: bool):
    """The state of a bucket of keys: per key (as text) when its hold ends (0: none) and how
    many times wait for the watermark, then these times by key and in order.  A time is
    decided once the watermark has passed it, so the order in which rows come does not
    matter."""
    from bisect import bisect_right

    import numpy as np

    def decide(until, who, times):
        """``times`` by key and in order, ``who`` their key's place in ``until``: sent or not, and the end of the hold."""
        first = np.diff(who, prepend=-1) != 0
        if refresh:  # every event holds the next: gaps decide, all at once
            return times > np.where(first, until[who], np.roll(times, 1) + quiet_us), times + quiet_us
        starts, all_times, sent, ends = np.flatnonzero(first).tolist(), times.tolist(), [], []
        for at, stop in zip(starts, [*starts[1:], len(all_times)]):  # only a sent event holds; its holds are found by bisection
            end = int(until[who[at]])
            while at < stop:
                go = all_times[at] > end
                if go:
                    end = all_times[at] + quiet_us
                to = at + 1 if go else bisect_right(all_times, end, at, stop)
                sent += [go] * (to - at)
                ends += [end] * (to - at)
                at = to
        return np.array(sent, dtype=bool), np.array(ends, dtype="int64")

    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        keys, until, counts, waiting = state.get if state.exists else ([], [], [], [])
        mark = state.getCurrentWatermarkMs() * 1000  # what is not after it came too late
        new_keys, new_times = [np.array(keys, dtype=object)], [np.array(waiting, dtype="int64")]
        for p in () if state.hasTimedOut else pdfs:
            p = p[p["_us"] > mark] if mark > 0 else p
            new_keys.append(p["_key"].to_numpy(object))
            new_times.append(p["_us"].to_numpy("int64"))
        codes, keys = pd.factorize(np.concatenate(new_keys))  # the keys of the state come first, in their order
        who = np.concatenate([np.repeat(np.arange(len(counts)), np.array(counts, dtype="int64")), codes[len(counts):]])
        times = np.concatenate(new_times)
        until = np.concatenate([np.array(until, dtype="int64"), np.zeros(len(keys) - len(until), dtype="int64")])
        order = np.lexsort((times, who))
        who, times = who[order], times[order]
        due = times <= mark
        out_who, out_times = who[due], times[due]
        sent, ends = decide(until, out_who, out_times)
        until[out_who] = ends  # the last of a key stays
        who, times = who[~due], times[~due]
        waits = np.bincount(who, minlength=len(keys))
        live = (waits > 0) | (until > mark)
        if not live.any():
            state.remove()  # nothing waits and nothing is held: the bucket's state expires
        else:
            state.update((keys[live].tolist(), until[live].tolist(), waits[live].tolist(), times.tolist()))
            wake = int(np.concatenate([times, until[live & (waits == 0)]]).min())
            state.setTimeoutTimestamp(max(wake // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame({"key": keys[out_who], "us": out_times, "sent": sent, "until": ends})
    return fn


def once(events: DataFrame, keys: Sequence[str], ts: str = "ts", quiet: str = "1 hour", watermark: str = "1 hour",
         refresh: bool = True, buckets: int = 1024) -> DataFrame:
    """Every event of a key with ``sent`` and the time until which it holds
    later ones back.

    With ``refresh`` an event is sent when none of its key came within ``quiet`` before it
    (sent-once tracking); without, when none was *sent* within it (a cache entry with a
    time to live: the sent event is the miss that stores it, the others are hits).  An
    event exactly ``quiet`` later is still held.  Times are decided when the watermark
    has passed them, so rows may come in any order within ``watermark``; later ones are
    dropped.  A key's state goes when its hold has ended and nothing waits: the state is
    bounded by the keys and events of the last ``quiet`` and ``watermark``.  Null times
    have no place and are left out; null keys are a key.

    The keys are dealt to ``buckets`` by their hash, and Python is called once per bucket
    and micro-batch, not once per key.  A bucket's state is read and written as a whole,
    so very many keys in small micro-batches want more buckets.  A started stream keeps
    its number."""
    quiet_us = int(pd.Timedelta(quiet).total_seconds() * 1_000_000)
    kinds = T.StructType([T.StructField(f"k{i}", events.schema[k].dataType) for i, k in enumerate(keys)])
    at = events.select(*keys, F.col(ts).cast("timestamp").alias("_at")).where("_at IS NOT NULL").withWatermark("_at", watermark)
    text = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), _KEY_TEXT)
    rows = at.select("_at", F.unix_micros("_at").alias("_us"), text.alias("_key")).withColumn(
        "_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(
        _once_fn(quiet_us, refresh), "key string, us long, sent boolean, until long", ONCE_STATE, "append", "EventTimeTimeout")
    return rows.withColumn("_k", F.from_json("key", kinds, _KEY_TEXT)).select(
        *[F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)], F.timestamp_micros("us").alias(ts), "sent",
        F.timestamp_micros("until").alias("held_until"))


def _counter_fn(key, pdfs: Iterator[pd.DataFrame], state):
    count, last = state.get if state.exists else (0, None)
    for pdf in pdfs:
        seen = pdf["_last"].dropna()
        count += len(pdf)
        if len(seen):
            last = int(seen.max()) if last is None else max(last, int(seen.max()))
    state.update((count, last))
    yield pd.DataFrame({"k": [key[0]], "message_count": [count], "last_message": pd.array([last], dtype="Int64")})


def counter_updates(msgs: DataFrame, key: str = "conv_id", ts: str = "turn") -> DataFrame:
    """R3 in stream: after every micro-batch one row per conversation that it touched, with
    the count and the last message so far.  The counts of a key only grow, so a sink that
    gets a batch twice reads the same through ``latest_counters``."""
    kind = msgs.schema[key].dataType.simpleString()
    rows = msgs.select(key, F.col(ts).cast("long").alias("_last")).groupBy(key).applyInPandasWithState(
        _counter_fn, f"k {kind}, message_count long, last_message long", "count long, last long", "append", "NoTimeout")
    return rows.withColumnRenamed("k", key)


def latest_counters(updates: DataFrame, key: str = "conv_id") -> DataFrame:
    """The counters as they stand: per key the update with the highest count."""
    return updates.groupBy(key).agg(F.max("message_count").alias("message_count"),
                                    F.max_by("last_message", "message_count").alias("last_message"))


def retention_filter(df: DataFrame, ts: str, days: int = 30, reference=None) -> DataFrame:
    """R7 (batch form): keep rows younger than ``days`` relative to the latest
    timestamp (state TTL is the streaming form: watermark + timeout)."""
    ref = F.lit(reference).cast("timestamp") if reference is not None else df.agg(F.max(ts)).scalar()
    return df.where(F.col(ts) > ref - F.make_interval(days=F.lit(days)))


def enrich(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; Spark broadcasts ``static`` if its size allows."""
    return stream.join(static, key, "left")


def run_available_now(df: DataFrame, name: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a streaming frame to completion (``availableNow``) into a parquet
    sink in the shared checkpoint folder; return the sink as a batch frame.
    ``progress`` gets, per micro-batch, its input rows and the rows in state."""
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_ckpt")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    for p in q.recentProgress if progress is not None else ():
        state = p["stateOperators"] or [{}]
        progress.append({"rows": p["numInputRows"], "state": state[0].get("numRowsTotal", 0)})
    return spark.read.schema(df.schema).parquet(out)


def sliding_rate_batch(events: DataFrame, key: str, ts: str = "ts", size_minutes: int = 60, slide_minutes: int = 15,
                       limit: int = 60) -> DataFrame:
    """R1 batch twin (same windows as ``F.window``)."""
    return sliding_rate(events, key, ts, f"{size_minutes} minutes", f"{slide_minutes} minutes", "0 seconds", limit) \
        if events.isStreaming else events.groupBy(F.window(ts, f"{size_minutes} minutes", f"{slide_minutes} minutes"), key).agg(
            F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"),
                                                 F.col("window.end").alias("window_end"), key, "n",
                                                 (F.col("n") >= limit).alias("over_limit"))


def per_event_rate(events: DataFrame, key: str, ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """R1 exact per-event form: events of the same key within the trailing
    ``seconds`` (a RANGE window on epoch seconds)."""
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("events_in_window", F.count(F.lit(1)).over(w))
