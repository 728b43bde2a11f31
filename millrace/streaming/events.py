"""Captured events as streams: draining, windows, sessions, requests with their answers, repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keeps the state of sessions, with timers, outside the memory of the JVM.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of the files that appear under ``path``, at most ``files`` in one batch."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, timeout: int | None = None) -> int:
    """Hands all events that are there now to ``sink(batch, number)`` and stops; what was handed over isn't handed over again.

    ``checkpoint`` is a shared folder that holds how far the stream was read. The result is how many rows came too late
    for the operators with state. A stream that isn't done after ``timeout`` seconds is stopped, with an error.
    """
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout} s")
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def counted(stream: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Events per key and window; those later than ``late`` behind the newest are left out, and state is dropped with them."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def without_repeats(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class Sessions(StatefulProcessor):
    """Rows wait in the state until the watermark passes them, so whatever their arrival they are taken in order; then they go to the key's open session.

    A session is closed by its last row, if that ends it, by the first row that is too far behind, or by a watermark that
    is; then nothing of the key is kept but rows that wait. A key has one timer, at the next time that anything can be done.
    """

    def __init__(self, names: list[str], kind: str, gap: int | None, span: int | None, each: bool) -> None:
        self.names, self.kind, self.gap, self.span, self.each = names, kind, gap, span, each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, id {self.kind}, ends boolean")
        self.open = handle.getValueState("open", f"start long, first {self.kind}, last long, n long, ended boolean")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        return self.advanced(key, [(r["__at"], r["__id"], r["__ends"]) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.timer.clear()
        return self.advanced(key, [], timerValues.getCurrentWatermarkInMs())

    def far(self, session: tuple, at: int) -> bool:
        start, _, last, _, ended = session
        return ended or self.gap is not None and at - last > self.gap or self.span is not None and at - start > self.span

    def advanced(self, key: tuple, new: list[tuple], watermark: int) -> Iterator[Row]:
        now = watermark * 1000  # rows up to here have all come: later ones of such times are late
        held = sorted([*(tuple(r) for r in self.waiting.get()), *new], key=lambda r: r[:2]) if self.waiting.exists() else sorted(new, key=lambda r: r[:2])
        session = tuple(self.open.get()) if self.open.exists() else None
        taken = 0
        for at, which, ends in held:
            if at > now:
                break
            taken += 1
            if session and self.far(session, at):
                yield from self.closed(key, session)
                session = None
            start, first, _, n, _ = session or (at, which, at, 0, False)
            session = (start, first, at, n + 1, ends)
            if self.each:
                yield Row(*self.names)(*key, which, at, start, first)
        if session and self.far(session, now):
            yield from self.closed(key, session)
            session = None
        rest = held[taken:]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.open.update(session) if session else self.open.clear()
        times = [rest[0][0]] if rest else []
        if session:
            times += [session[2] + self.gap + 1] if self.gap is not None else []
            times += [session[0] + self.span + 1] if self.span is not None else []
        before = self.timer.get()[0] if self.timer.exists() else None
        after = -(-min(times) // 1000) if times else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(after)
                self.timer.update((after,))

    def closed(self, key: tuple, session: tuple) -> Iterator[Row]:
        if not self.each:
            start, first, last, n, _ = session
            yield Row(*self.names)(*key, start, last, first, n)


def bounded_sessions(stream: DataFrame, time: str, keys: list[str], order: str, late: str, gap: float | None = None, span: float | None = None, ends: Column | None = None, each: bool = False) -> DataFrame:
    """Sessions of each key, told apart by their first row: a row begins one where it comes more than ``gap`` seconds after
    the row before it, or more than ``span`` after the session's first, or where the row before ``ends`` one.

    Rows are ordered by ``time``, then by ``order``, which is unique and not null, in whatever order they arrive within
    ``late``; the result is that of ``gap_sessions`` and then ``span_sessions`` over a table. Rows: (``keys``, start, end,
    first, n) of every session that is closed, or with ``each`` (``keys``, ``order``, at, start, first) of every row that the
    watermark has passed. Rows without a time are left out. State is kept in RocksDB: the session's setting is changed to it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    flag = F.lit(False) if ends is None else F.coalesce(ends, F.lit(False))
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late).select(*keys, time, F.unix_micros(F.col(time)).alias("__at"), F.col(order).alias("__id"), flag.alias("__ends"))
    micros = lambda x: None if x is None else round(x * 1_000_000)
    names = [*keys, order, "at", "start", "first"] if each else [*keys, "start", "end", "first", "n"]
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    told = f"`{order}` {kinds[order]}, at long, start long, first {kinds[order]}" if each else f"start long, `end` long, first {kinds[order]}, n long"
    found = rows.groupBy(*keys).transformWithState(Sessions(names, kinds[order], micros(gap), micros(span), each), f"{named}, {told}", "Append", "eventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in (("at", "start") if each else ("start", "end"))})


def answered(requests: DataFrame, responses: DataFrame, key: str, time: str, within: str, late: str) -> DataFrame:
    """Requests (``key``, ``time``, …) with their responses (``key``, ``time``, …) that come not before them and at most ``within`` after; requests without one get nulls.

    Columns of responses other than the key have ``response_`` before their names. Both streams may be ``late``; a request
    without an answer comes out when the watermark has passed the time in which one could come, and is then forgotten.
    """
    left = requests.withWatermark(time, late)
    right = responses.select(F.col(key).alias("__key"), *[F.col(c).alias(f"response_{c}") for c in responses.columns if c != key]).withWatermark(f"response_{time}", late)
    at, answer = F.col(time), F.col(f"response_{time}")
    on = (F.col(key) == F.col("__key")) & (answer >= at) & (answer <= at + F.expr(f"INTERVAL {within}"))
    return left.join(right, on, "left_outer").drop("__key")
