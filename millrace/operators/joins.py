"""Enrichment by key and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import materialized


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """Each row with its line of ``table``; rows without one go. Spark broadcasts the table only if its size allows that."""
    right = table.select(*[F.col(f"`{c}`").alias(f"__{c}" if c in rows.columns else c) for c in table.columns])
    named = lambda c: f"__{c}" if c in rows.columns else c
    joined = rows.join(right, [rows[f"`{a}`"] == right[f"`{named(b)}`"] for a, b in on.items()])
    return joined.drop(*[f"__{c}" for c in table.columns if c in rows.columns])


def lookup_or_key(rows: DataFrame, table: DataFrame, key: str, table_key: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of ``table`` under the row's key, or, if there is none or it is empty, the key as text.

    ``table_key`` should be unique in ``table``.
    """
    dim = table.select(F.col(f"`{table_key}`").alias("__key"), F.col(f"`{value}`").cast("string").alias("__value"))
    joined = rows.join(dim, F.col(f"`{key}`") == F.col("__key"), "left")
    return joined.withColumn(name, F.coalesce(F.nullif("__value", F.lit("")), F.col(f"`{key}`").cast("string"))).drop("__key", "__value")


def latest_before(rows: DataFrame, marks: DataFrame, time: str, mark_time: str, values: list[str], by: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """Each row with ``values`` of the latest mark of its group at or before its time, null if there is none (as-of join).

    Rows and marks go through one sort a group. A group with a large share of all rows is split by ``bucket``, an
    expression of ``time`` that never falls as it rises (such as ``date_trunc``): each bucket is sorted in a task of its
    own, and the last mark before a bucket comes from one line per bucket. Marks of equal time: the largest values win.
    """
    by = list(by)
    bucket = F.lit(0) if bucket is None else bucket
    left = rows.select("*", F.col(time).alias("__time"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.select(F.struct(*values)).schema[0].dataType).alias("__mark"))
    mark = F.struct(*[F.col(v) for v in values])
    right = marks.select(*[F.col(b) for b in by], F.col(mark_time).alias("__time"), F.lit(0).alias("__kind"), mark.alias("__mark"))
    if mark_time != time and time in rows.columns:
        right = right.withColumn(time, F.col("__time"))
    elif time not in right.columns:
        right = right.withColumn(time, F.col("__time"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__bucket", bucket)
    inside = Window.partitionBy(*by, "__bucket").orderBy("__time", "__kind", "__mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("__near", F.last("__mark", ignorenulls=True).over(inside)).where("__kind = 1")
    ends = both.groupBy(*by, "__bucket").agg(F.max(F.when(F.col("__kind") == 0, F.struct("__time", "__mark"))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__bucket").alias("__b"), F.last("__end", ignorenulls=True).over(before)["__mark"].alias("__carried"))
    on = F.col("__bucket") == F.col("__b")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__{b}"))
    found = near.join(carried, on).withColumn("__found", F.coalesce("__near", "__carried"))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("__found")[v].alias(v) for v in values])


def with_headings(rows: DataFrame, headings: DataFrame, time: str, text: str, heading_time: str, title: str, by: list[str] = ()) -> DataFrame:
    """(``by``, time, kind, text): the rows of each group with a heading before the first row that isn't earlier; those after its last row are left out.

    In order of time and kind, headings (0) come before rows (1). The last times, a row for each group, are written
    first, so that adaptive execution can split a group of many headings. Null groups are a group.
    """
    by = list(by)
    own = rows.select(*by, F.col(time).alias("time"), F.lit(1).alias("kind"), F.col(text).alias("text"))
    marks = headings.select(*by, F.col(heading_time).alias("time"), F.lit(0).alias("kind"), F.concat(F.lit("[Chapter] "), title).alias("text"))
    end = rows.groupBy(*by).agg(F.max(time).alias("__end")).select(*[F.col(b).alias(f"__{b}") for b in by], "__end")
    on = F.col("time") <= F.col("__end")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__{b}"))
    shown = marks.join(materialized(end) if by else F.broadcast(end), on).select(*own.columns)  # else one row
    return own.unionByName(shown)


def at_least_value(rows: DataFrame, column: str, condition: Column | None = None) -> DataFrame:
    """Rows whose value is the smallest (among those that meet ``condition``): one aggregate, whose one row is broadcast."""
    some = rows if condition is None else rows.where(condition)
    least = some.agg(F.min(F.col(f"`{column}`")).alias("__least"))
    return rows.join(F.broadcast(least), F.col(f"`{column}`") == F.col("__least"), "left_semi")


def enrich(rows: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """Each row with the columns of every table under its key, null where a table has no line."""
    for t in tables:
        rows = rows.join(t, key, "left")
    return rows


def not_seen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys ``seen`` doesn't have."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")
