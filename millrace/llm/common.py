"""Helpers shared by the corpus operators: lineage cuts, running totals over split groups, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the context's, or the one that ``spark.checkpoint.dir`` names.

    Only where neither is set and Spark runs on this machine alone (tests) a temporary one is made; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared checkpoint folder, so that losing an executor costs no history."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path, in the shared checkpoint folder of the session."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows in a batch for Python, at most: texts are long, and both sides hold a batch.
BATCH_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in a batch for Python to BATCH_ROWS, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, group: list[str], order: list[str], value: str, before: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same group that come earlier in ``order``."""
    return scan(df, group, order, {before: ("sum", value)}).withColumn(before, F.coalesce(before, F.lit(0)))


def scan(df: DataFrame, group: list[str], order: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each of ``wanted``, name to ("sum" or "max", column), over earlier rows of the same group.

    No group is gathered in one task: rows are range-partitioned on (group, order), which splits large groups, summed
    inside each range, and shifted by the totals of the ranges before it. Rows equal in group and order come in any order.
    Nulls are a group of their own, and sort first within one. The first row of a group gets null.
    """
    keys = [*group, *order]
    ranged = cut(df.repartitionByRange(parts(df.sparkSession), *keys).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    how = {"sum": F.sum, "max": F.max}
    totals = ranged.groupBy("__range", *group).agg(*[how[f](c).alias(f"__t{i}") for i, (f, c) in enumerate(wanted.values())])
    shift = totals.select(
        F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        *[how[f](f"__t{i}").over(earlier).alias(f"__s{i}") for i, (f, _) in enumerate(wanted.values())],
    )
    local = ranged.withColumns({name: how[f](c).over(inside) for name, (f, c) in wanted.items()})
    on = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(shift, on)
    none = F.lit(0)
    final = {
        name: F.greatest(name, f"__s{i}") if f == "max"
        else F.when(F.col(name).isNotNull() | F.col(f"__s{i}").isNotNull(), F.coalesce(name, none) + F.coalesce(f"__s{i}", none))
        for i, (name, (f, _)) in enumerate(wanted.items())
    }
    return joined.withColumns(final).select(*df.columns, *wanted)


#: Rows of a key that stay together in a join, and keys that are split at most.
TOGETHER, MOST_SPLIT = 2000, 100_000


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, __parts) of the keys with more than TOGETHER rows, in parts of TOGETHER rows.

    A key with at most one in MOST_SPLIT of all these keys' rows is left out, so there are fewer than MOST_SPLIT: a table
    small enough to be broadcast, found without an order of all keys.
    """
    sizes = cut(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > TOGETHER))
    least = (sizes.agg(F.sum("__n")).first()[0] or 0) / MOST_SPLIT
    return sizes.where(F.col("__n") > least).select(key, F.ceil(F.col("__n") / TOGETHER).cast("int").alias("__parts"))


def split_join(rows: DataFrame, table: DataFrame, key: str, by: str, heavy: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on their column ``key``, with ``heavy`` keys (of ``rows``, if not given) split over tasks.

    Rows of such a key go to parts by a hash of their column ``by``, and the key's rows in ``table`` to each part.
    """
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    heavy = F.broadcast(heavy.select(F.col(heavy.columns[0]).alias(key), "__parts"))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))
    dealt = rows.join(heavy, key, "left").withColumn("__part", part).drop("__parts")
    copied = table.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [key, "__part"]).drop("__part")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b long, undirected); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Minima are aggregated before the
    shuffle; they come back by joins that are followed by another shuffle, so adaptive execution splits the partition
    of a node with many neighbours.
    """
    now = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    seen = None
    while True:
        both = now.union(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        large = cut(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(large.join(down, "a").selectExpr("b AS a", "m AS b").where("a <> b").union(down.selectExpr("a", "m AS b")).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.selectExpr("a AS node", "b AS component").union(now.selectExpr("b AS node", "b AS component").distinct())


#: Bits of a filter of ids: 4 MB whatever the number of ids.
FILTER_BITS = 25


def filter_place(id_column: Column) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(1 << FILTER_BITS))


def filter_maps(ids: DataFrame) -> DataFrame:
    """(bucket, bits) of the places of all ``ids`` (id): at most 1024 rows of 4 kB, made by Spark's bitmap aggregate."""
    places = ids.select((filter_place(F.col("id")) + 1).alias("p"))
    return places.groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))


def marked(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``__hit``: true where the id is in ``ids`` (id) or shares its place in a filter of fixed size with one that is; false for a null id."""
    maps = cut(filter_maps(ids).withColumnsRenamed({"bucket": "__bucket", "bits": "__bits"}))
    place = filter_place(F.col(f"`{id_col}`"))
    joined = rows.join(F.broadcast(maps), F.floor(place / 32768) + 1 == F.col("__bucket"), "left")
    at = (place % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias("__hit"))


def without(rows: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``rows`` but those whose id is in ``gone`` (id). Only rows that a filter of fixed size lets through are shuffled; rows with a null id stay."""
    gone = cut(gone.where("id IS NOT NULL").distinct())
    judged = marked(rows, id_col, gone)
    kept = judged.where("__hit").drop("__hit").join(gone.select(F.col("id").alias("__gone")), F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    return judged.where("NOT __hit").drop("__hit").unionByName(kept)
