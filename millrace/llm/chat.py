"""Chat formatting: a dialogue rendered once from the view of every participant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import running

#: Turns in one rendered piece at most; a longer dialogue comes as consecutive pieces, so that none is gathered in one task whatever its length.
PIECE = 256


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    system: str = "system", piece: int = PIECE,
) -> DataFrame:
    """(conv_id, perspective, piece, n_turns, text, spans) for every dialogue and every participant in it.

    The participants are the distinct speakers but ``system``. In a perspective its speaker's turns are
    ``<|assistant|>``, other speakers' ``<|user:NAME|>``, and system turns stay ``<|system|>``; each ends in ``<|end|>``.
    ``spans`` (array of struct start, length; in characters of ``text``) are the parts to train on: the speaker's words
    with their end mark. ``<|`` in words and names becomes ``< |``, so words can't pose as marks, and ``|>`` in names
    ``| >``, so no name closes its own mark.

    Turns go by turn number, then speaker, then words, nulls first. A dialogue of any length is cut into pieces of
    ``piece`` turns, whose texts join to the whole; positions are counted without gathering a dialogue. A null speaker
    is the participant ``unknown``, null words are empty, repeated rows are turns of their own, rows whose dialogue id is
    null are one dialogue, and a dialogue of system turns only has no perspective and no row. Other columns aren't read.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.replace(safe(F.coalesce(F.col(role_col), F.lit("unknown"))), F.lit("|>"), F.lit("| >")).alias("role"), safe(F.coalesce(F.col(text_col), F.lit(""))).alias("words"),
        F.lit(1).cast("long").alias("__one"),
    )
    placed = running(rows, ["conv_id"], ["turn", "role", "words"], "__one", "__at")
    views = placed.where(F.col("role") != system).select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()
    seen = placed.join(views, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    mine = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == system, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), "role", F.lit("|>\n")))
    seen = seen.select(
        "conv_id", "perspective", F.floor(F.col("__at") / piece).cast("long").alias("piece"), "__at", mine.alias("__mine"),
        head.alias("__head"), F.concat("words", F.lit("<|end|>\n")).alias("__body"),
    )
    key = ["conv_id", "perspective", "piece"]
    so_far = Window.partitionBy(*key).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = seen.withColumn("__end", F.sum(F.length("__head") + F.length("__body")).over(so_far))
    turn = F.struct("__at", F.concat("__head", "__body").alias("part"), "__mine", (F.col("__end") - F.length("__body")).alias("start"), F.length("__body").cast("long").alias("length"))
    whole = ends.groupBy(*key).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    spans = F.transform(F.filter("__turns", lambda t: t["__mine"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select(
        *key, F.size("__turns").alias("n_turns"), F.array_join(F.transform("__turns", lambda t: t["part"]), "").alias("text"), spans.alias("spans"),
    )
