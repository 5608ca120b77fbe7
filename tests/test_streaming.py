"""Stateful stream operators over several micro-batches: order, late rows, expiry."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kestrel.streaming import ops as S

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, batches, **kwargs):
    """``batches``: lists of (key, minute); a last batch far ahead closes all."""
    rows = [(k, at(m), at(i)) for i, b in enumerate(batches) for k, m in b]
    events = spark.createDataFrame(rows, "k string, ts timestamp, arrival timestamp")
    progress = []
    out = S.run_available_now(S.once(S.arrivals(events, "arrival", len(batches)).drop("arrival"), ["k"], **kwargs), "t", progress=progress)
    return sorted((r.k, round((r.ts - T0).total_seconds() / 60)) for r in out.where("sent").collect()), progress


@pytest.mark.parametrize("refresh, want", [
    # 59 and 61 lie in two clock hours but are two minutes apart; 300 is five hours on; 100 came out of order
    (True, [("a", 0), ("a", 300), ("b", 59), ("late", 290)]),
    (False, [("a", 0), ("a", 61), ("a", 300), ("b", 59), ("late", 290)])])
def test_sent_once_over_batches(spark, refresh, want):
    batches = [[("a", 0), ("a", 30), ("b", 59)], [("a", 61), ("b", 61)], [("a", 120), ("late", 290)], [("a", 100), ("a", 300), ("late", 3)],
               [("end", 100_000)]]
    got, progress = run(spark, batches, quiet="1 hour", watermark="2 hours", refresh=refresh)
    assert [x for x in got if x[0] != "end"] == want
    # (late, 3) came more than two hours behind 290 and is gone
    states = [p["state"] for p in progress]
    assert max(states) >= 2 and states[-1] <= 1  # only the closing key is left: the others' state has expired


def test_events_exactly_quiet_apart_are_held(spark):
    got, _ = run(spark, [[("a", 0), ("a", 60), ("a", 121)], [("end", 9_999)]], quiet="1 hour", watermark="0 seconds")
    assert [x for x in got if x[0] == "a"] == [("a", 0), ("a", 121)]


def test_null_times_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None, at(0)), (None, at(0), at(0)), ("z", at(9_999), at(1))], "k string, ts timestamp, arrival timestamp")
    out = S.run_available_now(S.once(S.arrivals(rows, "arrival", 2).drop("arrival"), ["k"]), "t")
    assert [r.k for r in out.where(F.col("k").isNull() | (F.col("k") == "a")).collect()] == [None]
    none = S.run_available_now(S.once(S.arrivals(rows.limit(0), "arrival", 2), ["k"]), "t")
    assert none.count() == 0


def test_many_keys_are_few_states(spark):
    """Keys are decided by the bucket, not one call of Python and one state row for each."""
    rows = spark.range(5000).select("id", F.lit(at(0)).alias("ts"), F.lit(at(0)).alias("a")).union(
        spark.createDataFrame([(-1, at(9_999), at(1))], "id long, ts timestamp, a timestamp"))
    progress = []
    out = S.run_available_now(S.once(S.arrivals(rows, "a", 2).drop("a"), ["id"]), "t", progress=progress)
    assert out.where("sent").select("id").distinct().count() == out.count() == 5000
    assert max(p["state"] for p in progress) <= 1024


@pytest.mark.parametrize("refresh", [True, False])
def test_buckets_of_keys_equal_one_key_at_a_time(spark, refresh):
    rng = random.Random(3)
    rows = [(rng.choice([None, 0, 2**60, 2**60 + 1]), rng.choice([None, "", "a", 'b"{}']), rng.randrange(600), rng.randrange(5)) for _ in range(500)]
    rows = [(a, b, at(m + 100 * i), at(i)) for a, b, m, i in rows] + [(9, "end", at(99_999), at(5))]
    events = spark.createDataFrame(rows, "a long, b string, ts timestamp, arrival timestamp")
    out = S.run_available_now(S.once(S.arrivals(events, "arrival", 6).drop("arrival"), ["a", "b"], quiet="20 minutes", watermark="1 day",
                                     refresh=refresh, buckets=3), "t")
    want = []
    for key in {r[:2] for r in rows if r[0] != 9}:
        until = dt.datetime.min
        for ts in sorted(r[2] for r in rows if r[:2] == key):
            sent = ts > until
            until = ts + dt.timedelta(minutes=20) if sent or refresh else until
            want.append((*key, ts, sent, until))
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_keys_of_any_type_come_back_as_they_were(spark):
    keys = [(dt.datetime(1890, 1, 1, 0, 0, 0, 1), dt.date(2024, 2, 29), Decimal("0.10"), 0.1, b"\x00\xff", True, [1, None], at(1)),
            (at(0), None, Decimal("0.20"), float("inf"), b"", False, None, None), (None, None, None, None, None, None, [], at(1))]
    rows = [(*k, at(0), at(0)) for k in keys] + [(*keys[0][:2], None, *keys[0][3:], at(9_999), at(1))]
    kinds = "k0 timestamp, k1 date, k2 decimal(10, 2), k3 double, k4 binary, k5 boolean, k6 array<int>, k7 timestamp_ntz"
    events = spark.createDataFrame(rows, f"{kinds}, ts timestamp, a timestamp")
    out = S.run_available_now(S.once(S.arrivals(events, "a", 2).drop("a"), [f"k{i}" for i in range(8)], buckets=1), "t")
    assert out.schema.simpleString() == events.drop("a").withColumns({"sent": F.lit(True), "held_until": F.lit(at(0))}).schema.simpleString()
    assert sorted(map(repr, [tuple(r)[:8] for r in out.where("sent").collect()])) == sorted(map(repr, keys))


def test_counters_over_batches(spark):
    rows = spark.createDataFrame([(1, 0, at(0)), (1, 1, at(1)), (2, 5, at(0)), (1, None, at(2)), (3, None, at(2))], "conv_id long, turn long, a timestamp")
    updates = S.run_available_now(S.counter_updates(S.arrivals(rows, "a", 3)), "t")
    assert updates.count() == 5
    got = {(r.conv_id, r.message_count, r.last_message) for r in S.latest_counters(updates.union(updates)).collect()}
    assert got == {(1, 3, 1), (2, 1, 5), (3, 1, None)}
