"""Grouping: distinct rows, first and best of a group, lists and their totals. All aggregate before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """The first row of each key in ``order``, which should be unique in a key.

    An aggregate of whole rows, not a window: a key of any size is one row from each task. Columns that can't be ordered
    follow the row's order columns.
    """
    pick = F.max_by if descending else F.min_by
    rank = F.struct(*[F.col(f"`{c}`") for c in order])
    held = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(pick(held, rank).alias("__row")).select("__row.*")


def collect_group(df: DataFrame, keys: list[str], member: Column, first: dict[str, tuple[str, str]] = {}) -> DataFrame:
    """A row for each key: ``members``, its sorted distinct values, and for each of ``first``, name to (column, order), the first non-empty text in order.

    ``members`` is as long as a key's distinct values are many; give ``member`` few values.
    """
    some = {name: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(o))).alias(name) for name, (c, o) in first.items()}
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("members"), *some.values())


def shortest(df: DataFrame, keys: list[str], text: str, name: str = "shortest") -> DataFrame:
    """The shortest text of each key, the smaller by code point of equally long ones."""
    return df.groupBy(*keys).agg(F.min_by(F.col(text), F.struct(F.char_length(text), F.col(text))).alias(name))


def list_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + F.coalesce(e.cast("double"), F.lit(0.0)))


def list_mean(x: Column) -> Column:
    """Null for an empty list; null members don't count."""
    some = F.array_compact(x)
    return F.try_divide(list_sum(some), F.size(some))


def best(df: DataFrame, keys: list[str], what: str, by: str, tie: str, name: str) -> DataFrame:
    """``what`` of the row with the largest ``by`` in each key, the smaller ``tie`` on equal ones."""
    return df.groupBy(*keys).agg(F.max_by(F.col(what), F.struct(F.col(by), -F.col(tie))).alias(name))


def ordered_text(df: DataFrame, keys: list[str], text: str, order: str, separator: str, name: str) -> DataFrame:
    """The texts of each key in order, joined; as long as the key has rows, so give keys of bounded size."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda p: p["t"])
    return df.groupBy(*keys).agg(F.array_join(parts, separator).alias(name))


def unpivot(df: DataFrame, ids: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, metrics, name, value)


def count_where(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """A row for each key with how many rows meet each condition."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
