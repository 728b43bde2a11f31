"""Joins of intervals that overlap, by buckets of several widths, so that neither long intervals nor full buckets go to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import materialized

#: How much wider the buckets of a level are than those of the level below, the levels there can be, and rows of a bucket that stay together.
FACTOR, LEVELS, TOGETHER = 8, 20, 10_000


def level_of(start: Column, end: Column, width: float) -> Column:
    """The first level whose buckets are as wide as the interval is long, so it lies in two of them at most."""
    steps = F.ceil(F.log((end - start) / F.lit(float(width))) / F.log(F.lit(float(FACTOR))))
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), steps)).cast("int")


def levels_in(rows: DataFrame) -> list[int]:
    return sorted(r["__level"] for r in rows.select("__level").distinct().collect())  # LEVELS at most


def in_buckets(rows: DataFrame, width: float, own: list[int], other: list[int]) -> DataFrame:
    """A row for each bucket of an interval at every level where it can meet one of the other side: at its own the shorter ones, at wider ones those that belong there."""
    at = F.array(*[F.lit(k) for k in sorted({*own, *other})]).cast("array<int>")
    low = min(other) if other else LEVELS
    at = F.filter(at, lambda k: (k == F.col("__level")) & (k >= low) | (k > F.col("__level")) & k.isin(other))
    wide = F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), F.col("__at"))
    first, last = F.floor(F.col("__start") / wide), F.ceil(F.col("__end") / wide) - 1
    return rows.withColumn("__at", F.explode(at)).withColumn("__wide", wide).withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def overlapping(left: DataFrame, right: DataFrame, ends_left: tuple[str, str], ends_right: tuple[str, str], width: float, by: list[str] = (), together: int = TOGETHER) -> DataFrame:
    """All columns of ``left`` and, with ``right_`` before their names, of ``right`` for every pair of half-open intervals that overlap, of equal ``by``.

    Starts and ends are numbers; ``width`` is about the length of the most intervals. A longer one is put into wider
    buckets, FACTOR times by level, so each is in two buckets a level, whatever its length, and a pair meets at the level
    of its longer one; it counts in the bucket in which the later one starts. Buckets of more than ``together`` rows of
    the left are split, and their rows of the right are copied to each part. Intervals that are empty or have a null end
    overlap with none; a null ``by`` is equal to none. Both sides are read twice, to plan and to join.
    """
    by = list(by)
    a = left.withColumns({"__start": F.col(f"`{ends_left[0]}`").cast("double"), "__end": F.col(f"`{ends_left[1]}`").cast("double"), "__x": F.struct(*[F.col(f"`{c}`") for c in left.columns])})
    b = right.withColumns({"__start": F.col(f"`{ends_right[0]}`").cast("double"), "__end": F.col(f"`{ends_right[1]}`").cast("double"), "__y": F.struct(*[F.col(f"`{c}`") for c in right.columns])})
    a, b = (t.select(*by, "__start", "__end", x).where(F.col("__start") < F.col("__end")).withColumn("__level", level_of(F.col("__start"), F.col("__end"), width)) for t, x in ((a, "__x"), (b, "__y")))
    of_a, of_b = levels_in(a), levels_in(b)
    a, b = in_buckets(a, width, of_a, of_b), in_buckets(b, width, of_b, of_a)
    key = [*by, "__at", "__bucket"]
    sizes = materialized(a.groupBy(*key).agg(F.count("*").alias("__rows")).where(F.col("__rows") > together))
    least = (sizes.agg(F.sum("__rows")).first()[0] or 0) / 100_000  # so fewer than 100,000 buckets are split: a table to broadcast
    full = F.broadcast(sizes.where(F.col("__rows") > least).select(*key, F.ceil(F.col("__rows") / together).cast("int").alias("__parts")))
    part = F.coalesce(F.pmod(F.xxhash64("__x"), F.col("__parts")).cast("int"), F.lit(0))
    dealt = a.join(full, key, "left").withColumn("__part", part).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    copied = b.join(full, key, "left").withColumn("__part", copies).select(*key, "__part", "__y", *[F.col(c).alias(f"{c}b") for c in ("__start", "__end", "__level")])
    pairs = dealt.join(copied, [*key, "__part"])
    meets = (F.col("__start") < F.col("__endb")) & (F.col("__startb") < F.col("__end")) & (F.greatest("__level", "__levelb") == F.col("__at"))
    once = F.floor(F.greatest("__start", "__startb") / F.col("__wide")) == F.col("__bucket")
    return pairs.where(meets & once).select("__x.*", *[F.col(f"__y.`{c}`").alias(f"right_{c}") for c in right.columns])
