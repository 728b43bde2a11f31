"""JSON without a schema as Spark's VARIANT: kinds, members, lists in records, merged schemas; all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of records that are searched.
LEVELS = 4
MEMBER = "array<struct<keys:array<string>,value:variant>>"


def variant(text: Column) -> Column:
    """JSON text as a variant; null where it is no JSON, has a name twice in a record, or is larger than a variant may be."""
    return F.try_parse_json(text)


def told(value: Column, kind: str) -> Column:
    """Whether Spark's name for a variant's type begins with ``kind``."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def kind_of(value: Column) -> Column:
    """boolean, number, array, object or string; null and everything else are string."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "BOOLEAN", "boolean").when(name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("string")
    )


def members(value: Column) -> Column:
    """map<name, variant> of a record, empty for anything else."""
    held = F.when(told(value, "OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(held, F.create_map().cast("map<string,variant>"))


def items(value: Column) -> Column:
    """array<variant> of a list, null for anything else."""
    return F.when(told(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def inside(value: Column, levels: int = LEVELS) -> Column:
    """array<struct<keys, value>>: all members of a record and of the records in it, down to ``levels``, level by level; ``keys`` are the names on the way."""
    def below(keys: Column, x: Column) -> Column:
        return F.transform(F.map_entries(members(x)), lambda e: F.struct(F.concat(keys, F.array(e["key"])).alias("keys"), e["value"].alias("value")))

    def further(level: Column, left: int) -> Column:
        if not left:
            return level
        return F.concat(level, let(F.flatten(F.transform(level, lambda m: below(m["keys"], m["value"]))), lambda x: further(x, left - 1)))

    return let(below(F.array().cast("array<string>"), value), lambda x: further(x, levels - 1))


def longest_list(value: Column, levels: int = LEVELS) -> Column:
    """struct<path, items> of the longest list of two or more with a record among them, not inside a list; null if there is none.

    ``value`` itself may be it, with an empty path; of equal ones the last counts, with names in ascending order, members before what comes after.
    """
    def lists(v: Column) -> Column:
        itself = F.array(F.struct(F.array().cast("array<string>").alias("keys"), v.alias("value"))).cast(MEMBER)
        found = F.filter(F.concat(itself, inside(v, levels)), lambda m: told(m["value"], "ARRAY"))
        found = F.transform(found, lambda m: F.struct(m["keys"].alias("keys"), items(m["value"]).alias("items")))
        return F.filter(found, lambda x: (F.size(x["items"]) >= 2) & F.exists(x["items"], lambda e: told(e, "OBJECT")))

    def best(fit: Column) -> Column:  # variants have no order
        return let(F.array_max(F.transform(fit, lambda x: F.struct(F.size(x["items"]).alias("n"), x["keys"].alias("keys")))), lambda b: at(fit, b["keys"]))

    def at(fit: Column, keys: Column) -> Column:
        return F.when(keys.isNotNull(), F.struct(F.array_join(keys, ".").alias("path"), F.get(F.filter(fit, lambda x: x["keys"] == keys), F.lit(0))["items"].alias("items")))

    return let(let(value, lists), best)


def field_names(value: Column, levels: int = LEVELS) -> Column:
    """Dotted names of a record's fields in ascending order, each before those inside it; an array for anything else too."""
    return F.transform(F.array_sort(F.transform(inside(value, levels), lambda m: m["keys"])), lambda k: F.array_join(k, "."))


def field_kinds(value: Column) -> Column:
    """map<name, kind> of a record's own fields."""
    return F.map_from_entries(F.array_sort(F.transform(F.map_entries(members(value)), lambda e: F.struct(e["key"].alias("key"), kind_of(e["value"]).alias("value")))))


def merged_schema(value: Column) -> Column:
    """An aggregate: the one schema, as Spark writes it, that all variants of a group have; VARIANT where they disagree."""
    return F.schema_of_variant_agg(value)


def entry_rows(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """A row (``keep``, pos, key, value) for each member of a variant that is a record, or a list, whose key is null; none for others."""
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__value"))
    found = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__value").outer()))
    return found.select(*[F.col(f"`{c}`") for c in keep], "pos", "key", "value")


def field_profile(df: DataFrame, column: str, keys: list[str] = (), levels: int = LEVELS) -> DataFrame:
    """(``keys``, path, kind, n): how many rows have a field of that kind at a dotted path, in all rows' records, not their first alone.

    Rows are counted before the shuffle; a result has as many rows as there are paths and kinds.
    """
    named = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(inside(F.col(f"`{column}`"), levels)).alias("__m"))
    return named.groupBy(*keys, F.array_join("__m.keys", ".").alias("path"), kind_of(F.col("__m.value")).alias("kind")).agg(F.count("*").alias("n"))
