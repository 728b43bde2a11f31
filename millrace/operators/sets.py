"""Concatenation, fallback, unnesting and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import materialized


def concat(*some: DataFrame) -> DataFrame:
    """All rows of all tables; columns go by name."""
    return reduce(lambda a, b: a.unionByName(b), some)


def concat_distinct(*some: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Without repeated rows, or with one row, from the earliest table, for each of ``keys``."""
    if keys is None:
        return concat(*some).distinct()
    named = concat(*[t.withColumn("__table", F.lit(i)) for i, t in enumerate(some)])
    rest = [c for c in named.columns if c not in keys and c != "__table"]
    held = F.struct("__table", *[F.col(f"`{c}`") for c in rest])
    return named.groupBy(*keys).agg(F.min(held).alias("__row")).select(*[F.col(f"`{k}`") if k in keys else F.col(f"__row.`{k}`") for k in some[0].columns])


def fallback(*some: DataFrame) -> DataFrame:
    """The rows of the first table that has any; each before the last is asked for one row, and only the one found is read in full."""
    return next((t for t in some[:-1] if not t.isEmpty()), some[-1])


def in_all(*some: DataFrame) -> DataFrame:
    """The distinct rows that every table has; columns go by name."""
    return reduce(lambda a, b: a.intersect(b.select(*a.columns)), some)


def in_first_only(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The distinct rows of the first table that no other has."""
    return reduce(lambda a, b: a.subtract(b.select(*a.columns)), others, first.distinct())


def unnest(df: DataFrame, *path: str, keep: list[str] = ()) -> DataFrame:
    """Lists in lists as rows: ``path`` are the names of the lists, each in the members of the one before; the last ones are ``value``."""
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.col(f"`{path[0]}`")).alias("value"))
    for name in path[1:]:
        rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.col("value").getField(name)).alias("value"))
    return rows


def map_rows_of(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """A row for each entry of a map."""
    return df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.col(f"`{column}`")).alias("key", "value"))


def tree_levels(nodes: DataFrame, roots: Column, depth: int, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``nodes`` reachable from the roots with their ``depth``, down to ``depth`` levels; one join a level, which is written before the next."""
    level = nodes.where(roots).withColumn("depth", F.lit(0))
    out = level
    for d in range(1, depth + 1):
        above = level.select(F.col(id_col).alias("__above"))
        level = materialized(nodes.join(above, F.col(parent_col) == F.col("__above"), "left_semi").withColumn("depth", F.lit(d)))
        out = out.unionByName(level)
    return out
