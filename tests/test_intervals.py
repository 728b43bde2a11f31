"""Overlapping intervals against every pair compared."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals


@pytest.mark.parametrize("width, together", [(10, 10_000), (1, 3), (10_000, 5)])
def test_overlaps(spark, width, together):
    """Lengths from far below to far above a bucket, negative places, ends that touch, hot buckets, repeated rows, nulls."""
    rng = random.Random(width)
    def some(n, tag):
        out = []
        for i in range(n):
            start = rng.choice([0, rng.randrange(-500, 500), rng.randrange(-10**6, 10**6)])
            out.append((rng.choice("ab") if i % 9 else None, start, start + rng.choice([0, 1, 5, 10, 80, 640, 5120, 10**6, -3]), f"{tag}{i // 2 * 2}"))
        return out + [("a", None, 5, "n"), ("a", 5, None, "n"), ("a", 1, 2, "twice"), ("a", 1, 2, "twice")]
    left, right = some(150, "l"), some(120, "r")
    a, b = (spark.createDataFrame(x, "k string, s long, e long, name string").withColumn("__at", F.lit("clash")) for x in (left, right))
    b = b.withColumnsRenamed({"s": "from", "e": "to"})
    meets = lambda x, y: None not in (*x[1:3], *y[1:3]) and max(x[1], y[1]) < min(x[2], y[2])
    got = intervals.overlapping(a, b, ("s", "e"), ("from", "to"), width, together=together)
    assert got.columns == ["k", "s", "e", "name", "__at", "right_k", "right_from", "right_to", "right_name", "right___at"]
    want = collections.Counter((x, y) for x in left for y in right if meets(x, y))
    assert collections.Counter(((r.k, r.s, r.e, r.name), (r.right_k, r.right_from, r.right_to, r.right_name)) for r in got.collect()) == want
    by = intervals.overlapping(a, b, ("s", "e"), ("from", "to"), width, ["k"], together)
    assert by.count() == sum(n for (x, y), n in want.items() if x[0] == y[0] and x[0])
    plan = by._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlapping(a.limit(0), b, ("s", "e"), ("from", "to"), width).count() == 0 == intervals.overlapping(a, b.limit(0), ("s", "e"), ("from", "to"), width).count()


def test_long_intervals_stay_few_rows(spark):
    """An interval over millions of buckets is two rows a level."""
    a = spark.createDataFrame([(0, 10**12), (5, 6)], "s long, e long")
    rows = a.withColumns({"__start": F.col("s").cast("double"), "__end": F.col("e").cast("double")})
    rows = rows.withColumn("__level", intervals.level_of(F.col("__start"), F.col("__end"), 10))
    levels = intervals.levels_in(rows)
    assert intervals.in_buckets(rows, 10, levels, levels).count() <= 2 * 2 * len(levels)
    assert intervals.overlapping(a, a, ("s", "e"), ("s", "e"), 10).count() == 4
