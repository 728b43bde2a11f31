"""Summaries that are stored and merged: distinct counts, quantiles and frequent items of any period from those of its days, without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a count of distinct values (its standard error is about 1.04 / 2 ** (DISTINCT / 2)), of a quantile sketch (at 200 a
#: rank is within about 1.65 %), and of frequent items: a count is off by rows / ITEMS at most, that of an item not told, 0, too.
DISTINCT, QUANTILES, ITEMS = 12, 200, 10_000
#: Items that a sketch tracks for that. Its table has the power of 2 from TRACKED / 0.75 on; a count is off by 3.5 x rows / table,
#: and an item is told only if it has more than that for certain, so one not told may have twice as many.
TRACKED = 7 * ITEMS * 3 // 4
FAMILIES = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double"}


def family(df: DataFrame, column: str) -> str:
    """bigint or double: the kind of numbers that a quantile sketch is of."""
    kind = dict(df.dtypes)[column]
    if kind not in FAMILIES:
        raise ValueError(f"{column} is no number: {kind}")
    return FAMILIES[kind]


def states(df: DataFrame, keys: list[str], distinct: list[str] = (), numbers: list[str] = (), frequent: list[str] = ()) -> DataFrame:
    """(``keys``, rows, distinct_…, quantiles_…, frequent_…): a row for each key with the states of its columns, to be stored.

    Each is a mergeable aggregate, built in every task before the shuffle, so a key of any share of the rows sends a state
    a task. States have a fixed size, whatever the rows. Nulls are counted in ``rows`` alone.
    """
    out = [F.count("*").alias("rows")]
    out += [F.hll_sketch_agg(F.col(f"`{c}`"), DISTINCT).alias(f"distinct_{c}") for c in distinct]
    out += [getattr(F, f"kll_sketch_agg_{family(df, c)}")(F.col(f"`{c}`").cast(family(df, c)), QUANTILES).alias(f"quantiles_{c}") for c in numbers]
    out += [F.expr(f"approx_top_k_accumulate(`{c}`, {TRACKED})").alias(f"frequent_{c}") for c in frequent]
    return df.groupBy(*keys).agg(*out)


def merged(some: DataFrame, keys: list[str], numbers: dict[str, str] | None = None) -> DataFrame:
    """The states of all rows of equal ``keys`` in one, as ``states`` over their rows would be; of any number of states.

    ``numbers`` says of which quantiles are of whole numbers (bigint); others are of doubles.
    """
    kinds = numbers or {}
    out = [F.sum("rows").alias("rows")]
    for c in some.columns:
        what, _, of = c.partition("_")
        if what == "distinct":
            out.append(F.hll_union_agg(F.col(f"`{c}`")).alias(c))
        elif what == "quantiles":
            out.append(getattr(F, f"kll_merge_agg_{kinds.get(of, 'double')}")(F.col(f"`{c}`"), QUANTILES).alias(c))
        elif what == "frequent":
            out.append(F.expr(f"approx_top_k_combine(`{c}`, {TRACKED})").alias(c))
    return some.groupBy(*keys).agg(*out)


def distinct_count(state: str) -> Column:
    """How many distinct values a state has seen, about; 0 for none."""
    return F.coalesce(F.hll_sketch_estimate(F.col(f"`{state}`")), F.lit(0)).cast("long")


def quantile(state: str, share: float, kind: str = "double") -> Column:
    """The value that about ``share`` of a state's numbers don't exceed; null for none."""
    column = F.col(f"`{state}`")
    some = getattr(F, f"kll_sketch_get_n_{kind}")(column) > 0
    return F.when(some, getattr(F, f"kll_sketch_get_quantile_{kind}")(column, F.lit(float(share))))


def frequent_items(state: str, k: int) -> Column:
    """array<struct<item, count>> of the ``k`` most frequent values, about, the most frequent first.

    Values that are not certain to stand out are left out: where all are rare, the array is empty.
    """
    return F.expr(f"approx_top_k_estimate(`{state}`, {k})")
