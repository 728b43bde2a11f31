"""The steps of a record pipeline: select, map, filter, sort, limit and what goes with them.

Steps never gather rows. Rows have no order of their own: steps that need one take it as ``order``, ending in a unique key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StepError(ValueError):
    """A step that can't be planned; raised before any job runs."""


def at_path(df: DataFrame, path: str, start: Column | None = None) -> Column:
    """The value at ``a.b[0].c``; what is missing is null, empty parts are passed over, a bare number is a name, not an index.

    Text is read as JSON from there on, and gives text.
    """
    x = start
    kind: T.DataType = df.schema if start is None else df.select(start.alias("x")).schema[0].dataType
    parts = re.findall(r"\[([^\]]*)\]|([^.\[\]]+)", path)
    for k, (index, name) in enumerate(parts):
        if index and not index.isdigit():
            raise StepError(f"[{index}] in {path!r} is no position")
        if isinstance(kind, T.StringType):
            rest = "".join(f"[{i}]" if i else f"['{n}']" for i, n in parts[k:])
            return F.get_json_object(x, "$" + rest)
        if index and isinstance(kind, T.ArrayType):
            x, kind = F.get(x, F.lit(int(index))), kind.elementType
        elif name and isinstance(kind, T.StructType) and name in kind.names:
            x, kind = (F.col(f"`{name}`") if x is None else x.getField(name)), kind[name].dataType
        elif name and isinstance(kind, T.MapType):
            x, kind = F.try_element_at(x, F.lit(name)), kind.valueType
        else:
            return F.lit(None)
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]) if x is None else x


def select_path(df: DataFrame, path: str, keep: list[str] = ()) -> DataFrame:
    """The rows of the list at ``path`` (records as columns, other members as ``value``), else the record or value there.

    ``keep`` are columns that stay; ``pos`` is a member's position in its list.
    """
    x = at_path(df, path)
    kind = df.select(x.alias("x")).schema[0].dataType
    own = [F.col(f"`{c}`") for c in keep]
    if isinstance(kind, T.ArrayType):
        rows = df.select(*own, F.posexplode(x).alias("pos", "__value"))
        kind, kept = kind.elementType, [*own, F.col("pos")]
    else:
        rows, kept = df.select(*own, x.alias("__value")), own
    if isinstance(kind, T.StructType):
        return rows.select(*kept, "__value.*")
    return rows.select(*kept, F.col("__value").alias("value"))


def map_rows(df: DataFrame, **columns: Column | object) -> DataFrame:
    """One row each: the columns named, from expressions or constants."""
    return df.select(*[(c if isinstance(c, Column) else F.lit(c)).alias(name) for name, c in columns.items()])


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds; plain comparisons reach the scan."""
    return df.where(condition)


def sort_keys(by: str | Column, descending: bool = False, tie: list[str] = ()) -> list[Column]:
    """Missing values last when ascending, first when descending; ``tie`` keeps equal rows in order."""
    x = F.col(f"`{by}`") if isinstance(by, str) else by
    return [F.desc_nulls_first(x) if descending else F.asc_nulls_last(x), *[F.col(f"`{t}`") for t in tie]]


def sort_rows(df: DataFrame, by: str | Column, descending: bool = False, tie: list[str] = ()) -> DataFrame:
    return df.orderBy(*sort_keys(by, descending, tie))


def count_of(n: object) -> int:
    """A limit: a whole number from 0, or a text of one."""
    if isinstance(n, str) and n.isdigit():
        n = int(n)
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise StepError(f"{n!r} is no limit")
    return n


def first_rows(df: DataFrame, n: object) -> DataFrame:
    return df.limit(count_of(n))


def page(df: DataFrame, offset: object, n: object) -> DataFrame:
    return df.offset(count_of(offset)).limit(count_of(n))


def top(df: DataFrame, by: str | Column, n: object, descending: bool = True, tie: list[str] = ()) -> DataFrame:
    """Sort and limit in one: each task keeps ``n`` rows."""
    return df.orderBy(*sort_keys(by, descending, tie)).limit(count_of(n))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named, null where there is none of that name."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def is_empty(df: DataFrame, x: Column) -> Column:
    """Null, empty text, empty list or map."""
    kind = df.select(x.alias("x")).schema[0].dataType
    if isinstance(kind, T.StringType):
        return x.isNull() | (x == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return x.isNull() | (F.size(x) == 0)
    return x.isNull()


def as_list(df: DataFrame, x: Column) -> Column:
    """A list as it is, null as an empty one, any other value as a list of it."""
    kind = df.select(x.alias("x")).schema[0].dataType
    if isinstance(kind, T.ArrayType):
        return F.coalesce(x, F.array().cast(kind))
    return F.when(x.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(x))


def download_status(df: DataFrame, url: str = "url", kind: str = "media") -> DataFrame:
    """``df`` with download_type, download_url, download_path (the last path segment without parameters) and download_status."""
    path = F.substring_index(F.substring_index(F.col(f"`{url}`"), "/", -1), "?", 1)
    return df.withColumns({"download_type": F.lit(kind), "download_url": F.col(f"`{url}`"), "download_path": path, "download_status": F.lit("pending")})


def image_names(df: DataFrame, images: str, key: str) -> DataFrame:
    """(key, position, url, file): the distinct images of each row, named ``img_001.ext`` in their order; the ending is that of the address, jpg without one."""
    rows = df.select(F.col(f"`{key}`"), F.posexplode(F.array_distinct(F.col(f"`{images}`"))).alias("position", "url"))
    plain = F.regexp_extract("url", r"\.([^.?#&]*)[^.]*$", 1)  # behind the last full stop, to a mark of parameters
    told = F.when(F.col("url").contains("wx_fmt="), F.regexp_extract("url", "wx_fmt=([^&? ]*)", 1)).when(plain.rlike(r"^[\p{L}\p{N}]{1,5}$"), plain)
    ending = F.coalesce(F.nullif(told, F.lit("")), F.lit("jpg"))
    return rows.withColumn("file", F.format_string("img_%03d.%s", F.col("position") + 1, ending))
