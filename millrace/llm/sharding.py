"""Sharding by jump consistent hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import running


def jump(key: Column, shards: int) -> Column:
    """struct<b, j>: the shard of ``key`` among ``shards``, and the first larger shard count minus one at which it moves.

    The key jumps forward from shard b to floor((b + 1) / r), r uniform in (0, 1] and drawn from a hash of key and b,
    until it would leave the range; so it moves only ever into a shard that was appended. The number of jumps is about
    ln(shards); the fold allows 64 + 8 ln(shards) of them, or ``shards`` if that is fewer, which is the most there can be; that a key
    needs more has a chance below exp(-200).
    """
    steps = min(shards, 64 + math.ceil(8 * math.log(shards)))

    def step(s: Column, _: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, s["j"]), 11).cast("double") + 1) / float(2**53)
        further = F.least(F.floor((s["j"] + 1) / uniform), F.lit(2**53)).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), further.alias("j"))).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``shard`` (0 to shards - 1), ``grown_shard`` (with one shard more) and ``slot``.

    Shards follow from the id and the shard count alone: the law is ``key``. Slots number a shard's rows from 0 without
    gaps, by id, then size, then checksum; repeated rows get slots of their own, a null id is a key like any other,
    a null text has 1 byte and a null checksum. Other columns are not read, so their names can't clash.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).cast("long").alias("text_crc32"),
        jump(F.col(id_col), shards).alias("__jump"),
    )
    placed = rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        F.col("__jump.b").cast("int").alias("shard"),
        F.when(F.col("__jump.j") == shards, F.lit(shards)).otherwise(F.col("__jump.b")).cast("int").alias("grown_shard"),
        F.lit(1).cast("long").alias("__one"),
    )
    return running(placed, ["shard"], ["doc_id", "size", "text_crc32"], "__one", "slot").drop("__one")
