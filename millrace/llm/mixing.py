"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, heavy_keys, running, split_join, words


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and divide ``share`` of all sizes by them. A target
    stops at ``most`` times its source's size; what is over is shared again by weight among the others until none is
    above. The level of the shares only rises, so each round is one aggregate over the sources; two sums reach the driver.
    """
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running(
        totals.select("*", F.col("source").isNull().cast("int").alias("__null"), F.lit(0).alias("__all"), F.lit(1).cast("long").alias("__one")),
        ["__all"], ["__null", "source"], "__one", "__rank",
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked.select("source", "source_size", weight.alias("weight")))
    ceiling = F.col("source_size") * F.lit(float(most))
    whole, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = min(share, most) * float(whole or 0)
    level, before = goal / all_weight if all_weight else 0.0, -1.0
    while level > before * (1 + 1e-12):
        full = ceiling <= F.col("weight") * F.lit(level)
        spent, left = sources.agg(F.sum(F.when(full, ceiling).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, (goal - spent) / left if left else level
    return sources.select("source", "source_size", F.least(ceiling, F.col("weight") * F.lit(level)).alias("target"))


def draw(seed: int, id_col: str, text_col: str) -> Column:
    """A row's draw, the same in every run and every copy of the row."""
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))


def shares(rate: Column, hashed: Column) -> tuple[Column, Column, Column]:
    """Of a wanted number of copies: the certain ones, the probability of one more, and the odds by which rows are ranked for it."""
    sure = F.floor(rate + 1e-9)  # a ratio of doubles that should be whole counts as whole
    p = F.greatest(rate - sure, F.lit(0.0))
    uniform = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(2**53)
    odds = F.when(p > 1e-9, (uniform / (1 - uniform)) / (p / (1 - p))).otherwise(F.lit(float("inf")))
    return sure.cast("int"), F.when(p > 1e-9, p).otherwise(0.0), odds


def wanted_times(level: Column, importance: Column, most: float) -> Column:
    """How often a document is wanted; once each where a source has no words, so that no level makes its words a target."""
    return F.when(level == float("inf"), F.lit(1.0)).otherwise(F.least(F.lit(float(most)), level * importance))


def importance_of(importance_col: str | None) -> Column:
    """A row's importance to three digits, so that a source has few different ones; null and what is smaller counts as 1e-6."""
    if importance_col is None:
        return F.lit(1.0)
    x = F.greatest(F.coalesce(F.col(f"`{importance_col}`").cast("double"), F.lit(0.0)), F.lit(1e-6))
    step = F.pow(F.lit(10.0), F.floor(F.log10(x)) - 2)
    return F.round(x / step) * step


def source_levels(rows: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(source, source_size, target, level): documents are wanted ``level`` times their importance, at most ``most`` times.

    The level at which sizes times these numbers add up to the target follows from the sums over a source's documents
    of equal importance, from the largest down: those wanted ``most`` times come first.
    """
    classes = rows.groupBy("source", "importance").agg(F.sum("size").alias("size"))
    joined = classes.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    down = Window.partitionBy("source").orderBy(F.desc("importance"))
    before = F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("importance") * F.col("size")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.try_divide(F.col("target") - F.lit(float(most)) * before, rest)
    found = joined.withColumn("level", level)
    first = F.max_by("level", F.when(F.col("level") * F.col("importance") <= most * (1 + 1e-12), F.col("importance")))
    return found.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.coalesce(first, F.lit(float("inf"))).alias("level"))


#: Sources up to which a table with a row for each is broadcast.
FEW = 100_000


def by_source(rows: DataFrame, table: DataFrame, source_col: str, by: str, counted: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` (``__source``, ...; checkpointed, a row a source); sources of many rows are split."""
    if table.count() <= FEW:
        return rows.join(F.broadcast(table), F.col(f"`{source_col}`").eqNullSafe(F.col("__source"))).drop("__source")
    key = F.struct(F.coalesce("__source", F.lit("")).alias("s"), F.col("__source").isNull().alias("n"))
    own = F.struct(F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("s"), F.col(f"`{source_col}`").isNull().alias("n"))
    heavy = heavy_keys(counted.select(F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n")).alias("__key")), "__key")
    return split_join(rows.withColumn("__key", own), table.select(key.alias("__key"), *[c for c in table.columns if c != "__source"]), "__key", by, heavy).drop("__key")


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target, ``copies`` (how often it is taken),
    and how that came: ``level``, ``sure``, ``p``, ``drawn``, ``odds`` and ``draw``.

    A document is wanted level times importance times, at most ``most`` times; a source's level is such that the words
    wanted are its target. The whole part of that is certain. For the fraction p left, documents of a source are ranked
    by the odds of a uniform draw over the odds of p, and taken in this order while the words so far, to the middle of
    the next document, stay below the words that the fractions stand for: a sample of fixed size with unequal
    probabilities. Draws are hashes of ``seed``, id and the text's checksum, so reruns agree.

    Rows alike in id and text are taken alike; rows without words count 0 and are taken as the order has it, once each in
    a source that has no words at all; a null source is a source; without ``importance_col`` all are of equal importance, and a null, zero or negative one counts
    as 1e-6. Sources of any size are split over tasks.
    """
    rows = cut(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"), importance_of(importance_col).alias("importance"),
        draw(seed, id_col, text_col).alias("draw"),
    ))
    levels = cut(source_levels(rows, source_targets(rows, weights, share, most), most).withColumnRenamed("source", "__source"))
    wanted = by_source(rows, levels, "source", "doc_id", rows)
    sure, p, odds = shares(wanted_times(F.col("level"), F.col("importance"), most), F.col("draw"))
    wanted = cut(wanted.withColumns({"sure": sure, "p": p, "odds": odds}))
    quota = cut(wanted.groupBy(F.col("source").alias("__source")).agg(F.sum(F.col("p") * F.col("size")).alias("__quota")))
    ranked = running(wanted, ["source"], ["odds", "doc_id", "draw"], "size", "__before")
    ranked = by_source(ranked, quota, "source", "doc_id", rows)
    mine = F.struct("odds", "doc_id", "draw")
    taken = (F.col("p") > 0) & (F.col("__before") + F.col("size") / 2 <= F.col("__quota"))
    last = cut(ranked.groupBy(F.col("source").alias("__source")).agg(F.max(F.when(taken, mine)).alias("__last")))
    drawn = (F.col("p") > 0) & F.coalesce(mine <= F.col("__last"), F.lit(False))
    whole = by_source(wanted, last, "source", "doc_id", rows)
    return whole.select("doc_id", "source", "size", "source_size", "target", (F.col("sure") + drawn.cast("int")).alias("copies"), "level", "sure", "p", drawn.alias("drawn"), "odds", "draw")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance_col: str | None = None,
) -> DataFrame:
    """``docs`` with every row repeated as often as ``mix_documents`` takes it; columns as they were.

    Rows drawn are the first of their source in its order, so the last one drawn tells them: texts are shuffled only
    where there are more than FEW sources, and each row decides by its source's line in a table.
    """
    plan = cut(mix_documents(docs, weights, share, most, seed, id_col, text_col, source_col, importance_col))
    last = F.max(F.when(F.col("drawn"), F.struct("odds", "doc_id", "draw")))
    table = cut(plan.groupBy(F.col("source").alias("__source")).agg(F.first("level").alias("__level"), last.alias("__last")))
    own = draw(seed, id_col, text_col)
    sure, p, odds = shares(wanted_times(F.col("__level"), importance_of(importance_col), most), own)
    mine = F.struct(odds.alias("odds"), F.col(f"`{id_col}`").alias("doc_id"), own.alias("draw"))
    times = sure + F.coalesce((p > 0) & (mine <= F.col("__last")), F.lit(False)).cast("int")
    joined = by_source(docs, table, source_col, id_col, plan).withColumn("__times", times).where("__times > 0")
    repeated = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def by_length(docs: DataFrame, text_col: str = "text", name: str = "__importance") -> DataFrame:
    """``docs`` with an importance that grows with the logarithm of the words, so that longer documents are repeated first."""
    return docs.withColumn(name, F.floor(F.log2(words(F.col(f"`{text_col}`")) + 1.0)) + 1)
