"""Streams against the same operators over tables, in whatever order rows arrive."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import windows
from millrace.streaming import events

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
FAR = "event_id < 0"


def arrived(spark, path, rows, files):
    """``rows`` as files that a stream takes one by one; behind them two rows of far later, so that the watermark passes all others."""
    order = list(rows)
    step = -(-len(order) // files)
    late = [(-1, datetime.datetime(2031, 1, 1), -1, "late", 0.0, None), (-2, datetime.datetime(2032, 1, 1), -1, "late", 0.0, None)]
    parts = [order[i : i + step] for i in range(0, len(order), step)] + [[x] for x in late]
    for i, part in enumerate(parts):
        target = path / f"{i:03d}"
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(target))
        for f in target.glob("*.parquet"):
            f.rename(path / f"in-{i:03d}.parquet")
    return events.watch(spark, str(path) + "/in-*.parquet", EVENTS, files=1)


@pytest.fixture
def rows(spark):
    found = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).collect()
    users = {r.user_id for r in found}
    keep = sorted(users)[:12]
    return sorted((tuple(r) for r in found if r.user_id in keep), key=lambda r: (r[1], r[0]))


def drained(spark, stream, path):
    dropped = events.drain(stream, lambda df, i: df.write.mode("append").parquet(str(path / "out")), str(path / "state"), 240)
    return spark.read.parquet(str(path / "out")), dropped


def by_table(df, gap, span):
    """Each row's session by the operators over tables, as the id of its first row."""
    seconds = F.unix_micros("ts") / 1e6
    parted = windows.gap_sessions(df, ["user_id"], ["ts", "event_id"], seconds, gap, F.col("event_type") == "purchase")
    parted = windows.span_sessions(parted.withColumn("o", F.struct("ts", "event_id")), ["user_id", "session"], "o", seconds, span)
    first = parted.groupBy("user_id", "session", "part").agg(F.min_by("event_id", "o").alias("first"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return parted.join(first, ["user_id", "session", "part"])


@pytest.mark.parametrize("arrival", ["in order", "near by", "any"])
def test_sessions_as_over_tables(spark, tmp_path, rows, arrival):
    gap, span, late = 40_000.0, 86_400.0, "3 days" if arrival == "near by" else "20000 days" if arrival == "any" else "0 seconds"
    rng = random.Random(4)
    order = rows if arrival == "in order" else sorted(rows, key=lambda r: r[1].timestamp() + rng.random() * 2 * 86_400) if arrival == "near by" else rng.sample(rows, len(rows))
    if arrival == "any":
        late = "10 years"  # the two rows behind come 7 years later, so nothing settles before; a third row ends that
        order = [*order, (-3, datetime.datetime(2045, 1, 1), -1, "late", 0.0, None)]
    stream = arrived(spark, tmp_path, order, 5)
    kept = events.bounded_sessions(stream, "ts", ["user_id"], "event_id", late, gap, span, F.col("event_type") == "purchase", each=True)
    got, dropped = drained(spark, kept, tmp_path)
    want = by_table(spark.createDataFrame(rows, EVENTS), gap, span)
    assert dropped == (1 if arrival == "any" else 0)  # -2, which comes two files after -3
    assert {(r.event_id, r.first, r.start, r.at) for r in got.where("event_id >= 0").collect()} == {(r.event_id, r.first, r.start, r.ts) for r in want.collect()}
    assert got.where("event_id >= 0").count() == len(rows)


def test_closed_sessions_and_their_state(spark, tmp_path, rows):
    """Every session once, when it is closed; of closed ones nothing is kept."""
    stream = arrived(spark, tmp_path, rows, 4)
    closed = events.bounded_sessions(stream, "ts", ["user_id"], "event_id", "1 hour", 40_000.0, 86_400.0, F.col("event_type") == "purchase")
    query = closed.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240) is not False
    want = by_table(spark.createDataFrame(rows, EVENTS), 40_000.0, 86_400.0).select("user_id", "start", "end", "first", "n").distinct()
    got = spark.read.parquet(str(tmp_path / "out")).where("first >= 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_counted(spark, tmp_path, rows):
    """A row behind the watermark is dropped and counted, and changes no session."""
    stream = arrived(spark, tmp_path, [*rows, (10**6, rows[0][1], rows[0][2], "view", 0.0, None)], len(rows) + 1 if len(rows) < 8 else 6)
    got, dropped = drained(spark, events.bounded_sessions(stream, "ts", ["user_id"], "event_id", "1 minute", 40_000.0, each=True), tmp_path)
    assert dropped == 1 and got.where("event_id = 1000000").count() == 0 and got.where("event_id >= 0").count() == len(rows)


def test_requests_with_their_answers(spark, tmp_path, rows):
    """Answers in time, too late, before their request, and none, as a join over tables has them."""
    rng = random.Random(6)
    asked = [(r[0], r[1]) for r in rows]
    answers = [(i, at + datetime.timedelta(seconds=rng.choice([-5, 0, 20, 60, 61, 500])), 200 + i % 3) for i, at in asked if rng.random() < 0.8]
    far = [(-1, datetime.datetime(2031, 1, 1)), (-2, datetime.datetime(2032, 1, 1))]
    for name, some, schema in (("q", asked, "id long, ts timestamp"), ("a", answers, "id long, ts timestamp, status int")):
        for i, part in enumerate([some[::2], some[1::2], *([(*x, 0)[: len(some[0])]] for x in far)]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name / f"{i}"))
    streams = [events.watch(spark, str(tmp_path / n) + "/*", s, files=1) for n, s in (("q", "id long, ts timestamp"), ("a", "id long, ts timestamp, status int"))]
    got, dropped = drained(spark, events.answered(*streams, "id", "ts", "60 seconds", "100 days"), tmp_path)
    ok = {i: (at, s) for i, at, s in answers}
    want = {(i, at, *(ok[i] if i in ok and 0 <= (ok[i][0] - at).total_seconds() <= 60 else (None, None))) for i, at in asked}
    assert {tuple(r) for r in got.where("id >= 0").collect()} == want and got.where("id >= 0").count() == len(asked) and dropped == 0


def test_windows_and_repeats_as_over_tables(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, EVENTS)
    got, _ = drained(spark, events.counted(arrived(spark, tmp_path, rows, 3), "ts", ["event_type"], "1 hour", "1 hour"), tmp_path)
    want = df.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
    assert sorted(map(tuple, got.where("event_type <> 'late'").collect())) == sorted(map(tuple, want.collect()))
    other = tmp_path / "second"
    got, _ = drained(spark, events.sessions(arrived(spark, other, rows, 3), "ts", ["user_id"], "6 hours", "1 hour"), other)
    want = df.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "user_id", "n")
    assert sorted(map(tuple, got.where("user_id >= 0").collect())) == sorted(map(tuple, want.collect()))
    third = tmp_path / "third"
    got, _ = drained(spark, events.without_repeats(arrived(spark, third, [*rows[:40], *rows[:40]], 2), "ts", ["event_id"], "1000 days"), third)
    assert sorted(r.event_id for r in got.where(f"NOT ({FAR})").collect()) == sorted(r[0] for r in rows[:40])
