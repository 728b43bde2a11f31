"""Ranks in groups, and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import materialized


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with their ranks from 1. Spark keeps ``k`` rows a key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def top_children(nodes: DataFrame, roots: Column, k: int, depth: int, id_col: str = "id", parent_col: str = "parent", order: list[Column] = ()) -> DataFrame:
    """``nodes`` with ``depth``: the roots, and level by level the first ``k`` children of every node kept, down to ``depth``."""
    level = nodes.where(roots).withColumn("depth", F.lit(0))
    out = level
    for d in range(1, depth + 1):
        above = level.select(F.col(id_col).alias("__above"))
        level = top_of_each(nodes.join(above, F.col(parent_col) == F.col("__above")).drop("__above"), [parent_col], list(order), k, "__rank").drop("__rank")
        level = materialized(level.withColumn("depth", F.lit(d)))
        out = out.unionByName(level)
    return out


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], seconds: Column, gap: float, ends: Column | None = None, name: str = "session", bucket: Column | None = None) -> DataFrame:
    """``df`` with the number of each row's session in its key, from 0.

    A session begins where ``seconds`` is more than ``gap`` after the row before, or where that row ``ends`` one. A key
    with a large share of all rows is split by ``bucket``, an expression that never falls along ``order``: borders then
    come from one line per bucket.
    """
    rows = df.withColumns({
        "__key": F.struct(*keys), "__bucket": F.lit(0) if bucket is None else bucket,  # a record of keys is equal to another with nulls in the same places
        "__at": F.struct(seconds.alias("s"), F.coalesce(F.lit(False) if ends is None else ends, F.lit(False)).alias("e")),
    })

    def begins(before: Column, now: Column) -> Column:
        return F.coalesce(before.isNotNull() & ((now["s"] - before["s"] > gap) | before["e"]), F.lit(False)).cast("long")

    inside = Window.partitionBy("__key", "__bucket").orderBy(*order)
    across = Window.partitionBy("__key").orderBy("__bucket")
    flagged = rows.withColumn("__begins", begins(F.lag("__at").over(inside), F.col("__at")))
    local = flagged.withColumn("__local", F.sum("__begins").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # A bucket's first row begins a session by what the bucket before it ends in; buckets then add up.
    place = F.struct(*order)
    each = local.groupBy("__key", "__bucket").agg(F.min_by("__at", place).alias("__head"), F.max_by("__at", place).alias("__tail"), F.max("__local").alias("__n"))
    opened = each.withColumn("__opens", begins(F.lag("__tail").over(across), F.col("__head")))
    so_far = F.coalesce(F.sum(F.col("__n") + F.col("__opens")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = opened.select("__key", "__bucket", (so_far + F.col("__opens")).alias("__shift"))
    return local.join(shift, ["__key", "__bucket"]).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__local") + F.col("__shift")).alias(name))


def span_sessions(df: DataFrame, keys: list[str], order: str, seconds: Column, span: float, name: str = "part") -> DataFrame:
    """``df`` with the number of each row's part in its key: a part begins where a row is more than ``span`` after the part's first.

    Each border depends on the one before, so a key is walked in order, from border to border by search; rows stream
    through a task in batches, with a few numbers kept, so a key of any length takes bounded memory. Give the keys of
    ``gap_sessions`` to keep keys short. A row without a time is in the part that is open where ``order`` has it.
    """
    names = df.columns
    sorted_rows = df.withColumns({"__seconds": seconds.cast("double"), "__key": F.xxhash64(*keys)})
    kinds = dict(df.dtypes)
    plain = [F.col(f"`{k}`") + F.lit(0.0) if kinds[k] in ("double", "float") else F.col(f"`{k}`") for k in keys]  # 0.0 is -0.0
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    told = F.to_json(F.struct(*[x.alias(k) for x, k in zip(plain, keys)]), micros)  # as text, in full
    sorted_rows = sorted_rows.withColumn("__same", told).repartition(F.col("__key")).sortWithinPartitions("__same", order)
    at = len(names)

    def walk(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, latest, part = None, None, None, 0  # of the key that is open: the part's first time, the last time seen, the part's number
        for table in tables:
            own, times = np.array(table.column(at + 2).to_pylist(), object), table.column(at).to_numpy(zero_copy_only=False).astype(float)
            out = np.zeros(len(own), np.int64)
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
            for a, b in zip(edges, edges[1:]):
                if own[a] != key:
                    key, start, latest, part = own[a], None, None, 0
                run = times[a:b]
                known = np.flatnonzero(~np.isnan(run))
                if len(known):  # a missing time counts as the one before it
                    before = np.searchsorted(known, np.arange(len(run)), side="right") - 1
                    run = np.where(before >= 0, run[known[np.maximum(before, 0)]], run[known[0]] if latest is None else latest)
                    start = run[0] if start is None else start
                    latest, i = run[-1], 0
                    while True:
                        j = i + int(np.searchsorted(run[i:] - start, span, side="right"))
                        out[a + i : a + j] = part
                        if j >= len(run):
                            break
                        start, part, i = run[j], part + 1, j
                else:
                    out[a:b] = part
            yield pa.RecordBatch.from_arrays([*table.columns[:at], pa.array(out, pa.int64())], names=[*names, name])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return sorted_rows.mapInArrow(walk, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{name}` long"]))
