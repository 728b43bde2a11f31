"""Trees of any depth in reading order: pointers up a bushy tree, or along the walk around a stringy one, are doubled until all reach an end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import before, materialized, with_position
from millrace.operators.steps import StepError

#: Where the walk ends, and where it breaks off, as the node it would come back to is not there.
END, LOST = -1, -2


def walked(nodes: DataFrame, order: list[Column], id_col: str, parent_col: str, roots: Column | None) -> tuple[DataFrame, int]:
    """``nodes`` with ``__pos`` (roots first, then siblings together, in order), ``__top`` (a root), ``__first``, ``__n`` (position of the first child, children) and ``__rank`` among siblings, and how many there are."""
    top = F.col(f"`{parent_col}`").isNull() if roots is None else F.coalesce(roots, F.lit(False))
    rows = nodes.where(F.col(f"`{id_col}`").isNotNull()).withColumn("__top", top).where(F.col("__top") | F.col(f"`{parent_col}`").isNotNull())
    above = F.when(~F.col("__top"), F.col(f"`{parent_col}`"))
    placed = materialized(with_position(rows, [F.desc("__top"), above.asc(), *order, F.col(f"`{id_col}`").asc()], "__pos"))
    twice = placed.groupBy(F.col(f"`{id_col}`").alias("id")).count().where("count > 1").limit(1).collect()
    if twice:
        raise StepError(f"two nodes have the id {twice[0]['id']}")
    families = materialized(placed.groupBy(above.alias("__above")).agg(F.min("__pos").alias("__first"), F.count("*").alias("__n")))
    joined = placed.join(families.select(F.col("__above").alias("__own"), "__first", "__n"), F.col(f"`{id_col}`") == F.col("__own"), "left").drop("__own")
    start = families.where("__above IS NOT NULL").select("__above", F.col("__first").alias("__start"))  # the roots' own starts at 0
    joined = joined.join(start, above == F.col("__above"), "left").drop("__above")
    return materialized(joined.withColumn("__rank", F.col("__pos") - F.coalesce("__start", F.lit(0))).drop("__start").withColumn("__n", F.coalesce("__n", F.lit(0)))), placed.count()


def ranked(steps: DataFrame, n: int) -> DataFrame:
    """(el, left, deep) of the elements (el, next, deep) of lists that reach END: how many there are from each to the end, and the sum of ``deep`` over them.

    Every round doubles how far a pointer goes; elements that don't get anywhere in as many rounds as the longest list
    could take are on a cycle.
    """
    now, rounds = materialized(steps.withColumn("left", F.lit(1).cast("long"))), 0
    while not now.where("next >= 0").isEmpty():
        if 1 << rounds > n:
            raise StepError("nodes that are their own ancestors")
        ahead = now.select(F.col("el").alias("__at"), F.col("next").alias("__next"), F.col("deep").alias("__deep"), F.col("left").alias("__left"))
        gone = now.join(ahead, F.col("next") == F.col("__at"), "left")
        further = F.when(F.col("next") < 0, F.col("next")).otherwise(F.coalesce("__next", F.lit(LOST)))
        now = materialized(gone.select("el", further.alias("next"), (F.col("deep") + F.coalesce("__deep", F.lit(0))).alias("deep"), (F.col("left") + F.coalesce("__left", F.lit(0))).alias("left")))
        rounds += 1
    return now.where(F.col("next") == END).select("el", "left", "deep")


def below(inner: DataFrame, n: int) -> DataFrame:
    """(pos, size) of the nodes with children (pos, up, many): the nodes of the subtree of each, itself included.

    ``many`` is summed over ever more generations: in a round a node adds the sums of those whose pointer is at it.
    """
    now, rounds = materialized(inner.select("pos", F.col("up").alias("next"), F.col("many").alias("sum"))), 0
    while not now.where("next >= 0").isEmpty():
        if 1 << rounds > n:
            raise StepError("nodes that are their own ancestors")
        ahead = now.select(F.col("pos").alias("__at"), F.col("next").alias("__next"))
        more = now.where("next >= 0").groupBy(F.col("next").alias("__to")).agg(F.sum("sum").alias("__more"))
        gone = now.join(ahead, F.col("next") == F.col("__at"), "left").join(more, F.col("pos") == F.col("__to"), "left")
        further = F.when(F.col("next") < 0, F.col("next")).otherwise(F.coalesce("__next", F.lit(LOST)))
        now = materialized(gone.select("pos", further.alias("next"), (F.col("sum") + F.coalesce("__more", F.lit(0))).alias("sum")))
        rounds += 1
    return now.select("pos", (F.col("sum") + 1).alias("size"))


def climbed(tree: DataFrame, n: int) -> DataFrame:
    """(pos, depth, tour, out) of ``tree`` (pos, up, many, lead): what ``toured`` returns, from the sizes of subtrees.

    A child starts one behind its parent and all of its earlier siblings' subtrees, which are the difference of two running
    sums of sizes by position: at the child and at the first one (``lead``). So a node's own share is one minus the sum
    at its first child, plus its own, and the shares of its ancestors add up.
    """
    sizes = below(tree.where("many > 0"), n)
    placed = tree.join(sizes.select(F.col("pos").alias("__at"), "size"), F.col("pos") == F.col("__at"), "left").withColumn("size", F.coalesce("size", F.lit(1)))
    placed = materialized(before(placed, "pos", "size", n, "earlier").select("pos", "up", "lead", "size", "earlier", (F.col("many") > 0).alias("inner")))
    first = placed.where("lead").select(F.col("up").alias("__own"), F.col("earlier").alias("__first"))
    share = placed.where("inner").join(first, F.col("pos") == F.col("__own"))
    steps = share.select(F.col("pos").alias("el"), F.col("up").alias("next"), (F.col("earlier") + 1 - F.col("__first")).alias("deep"))
    above = ranked(steps, n)
    joined = placed.join(above, F.col("up") == F.col("el"), "left").where((F.col("up") == END) | F.col("el").isNotNull())
    depth, start = F.coalesce("left", F.lit(0)), F.col("earlier") + F.coalesce("deep", F.lit(0))
    return joined.select("pos", depth.alias("depth"), (2 * start - depth).alias("tour"), (2 * start - depth + 2 * F.col("size") - 1).alias("out"))


def toured(kept: DataFrame, many: Column, tops: int, n: int) -> DataFrame:
    """(pos, depth, tour, out) of the nodes that hang on a root: the steps of the walk at which it enters and leaves each.

    The walk enters every node, goes through its children and leaves it; ranking its steps takes as many rounds as the
    logarithm of twice the number of nodes, each a join by unique keys.
    """
    enter, leave = 2 * F.col("__pos"), 2 * F.col("__pos") + 1
    entered = kept.select(enter.alias("el"), F.when(many > 0, 2 * F.col("__first")).otherwise(leave).alias("next"), F.lit(1).cast("long").alias("deep"))
    last = F.when(F.col("__top"), F.col("__rank") + 1 >= tops).otherwise(F.col("__rank") + 1 >= F.col("__siblings"))
    back = F.when(F.col("__up") < 0, F.col("__up")).otherwise(2 * F.col("__up") + 1)
    left = kept.select(leave.alias("el"), F.when(last, back).when(F.col("__up") == LOST, F.lit(LOST)).otherwise(2 * F.col("__pos") + 2).alias("next"), F.lit(-1).cast("long").alias("deep"))
    tour = ranked(entered.unionByName(left), 4 * n)
    whole = F.lit(tour.agg(F.max("left")).first()[0])
    ins = tour.where("el % 2 = 0").select((F.col("el") / 2).cast("long").alias("pos"), (-F.col("deep")).alias("depth"), (whole - F.col("left")).alias("tour"))
    return ins.join(tour.where("el % 2 = 1").select(((F.col("el") - 1) / 2).cast("long").alias("pos"), (whole - F.col("left")).alias("out")), "pos")


def reading_order(
    nodes: DataFrame, order: list[Column], id_col: str = "id", parent_col: str = "parent", roots: Column | None = None,
    children: int | None = None, levels: int | None = None, more: str | None = None,
) -> DataFrame:
    """``nodes`` with ``position`` and ``depth``, each before its children and they in ``order``, then by id, as one reads a discussion.

    Where at most two thirds of the nodes have children, only these are doubled, as often as the logarithm of the depth
    (``climbed``); else the walk around the tree is ranked (``toured``), whatever the depth. ``roots`` are the rows
    without a parent, or those of a condition; what hangs on none of them is left out, as are null ids. With
    ``children`` only a node's first so many, and with ``levels`` only so many levels are there; then a column
    ``hidden`` says how many children of a node are left out, and with ``more`` a row behind its descendants does,
    null but for ``hidden``, its depth, position, parent and, in the column ``more``, ``[+n more]``. Equal ids, and nodes
    that are their own ancestors, are errors.
    """
    placed, n = walked(nodes, order, id_col, parent_col, roots)
    kept = placed if children is None else placed.where(F.col("__top") | (F.col("__rank") < children))
    many = F.col("__n") if children is None else F.least("__n", F.lit(children))
    parent = placed.select(F.col(f"`{id_col}`").alias("__id"), F.col("__pos").alias("__over"), many.alias("__siblings"))
    up = F.when(F.col("__top"), F.lit(END)).otherwise(F.coalesce("__over", F.lit(LOST))).cast("long")
    kept = materialized(kept.join(parent, ~F.col("__top") & (F.col(f"`{parent_col}`") == F.col("__id")), "left").withColumn("__up", up).drop("__id", "__over"))
    if 3 * kept.where(many > 0).count() <= 2 * n:
        tour = climbed(kept.select(F.col("__pos").alias("pos"), F.col("__up").alias("up"), many.alias("many"), (~F.col("__top") & (F.col("__rank") == 0)).alias("lead")), n)
    else:
        tour = toured(kept, many, placed.where("__top").count(), n)
    tour = tour.select(F.col("pos").alias("__at"), F.col("depth").cast("int").alias("depth"), F.col("tour").alias("__tour"), F.col("out").alias("__out"))
    ins = kept.join(tour, F.col("__at") == F.col("__pos")).drop("__at")
    if children is None and levels is None:  # of the steps before a node's, a depth more enter than leave
        return ins.select(*nodes.columns, "depth", F.shiftright(F.col("__tour") + F.col("depth"), 1).alias("position"))
    hidden = (F.col("__n") - F.when(F.col("depth") + 1 >= levels, F.lit(0)).otherwise(many)) if levels is not None else F.col("__n") - many
    ins = (ins if levels is None else ins.where(F.col("depth") < levels)).withColumn("hidden", hidden.cast("long"))
    if more is not None:
        ins = materialized(ins)
        names = {f.name: f.dataType for f in nodes.schema.fields}
        notes = ins.where("hidden > 0").select(
            *[F.col(f"`{id_col}`").cast(kind).alias(c) if c == parent_col else F.lit(None).cast(kind).alias(c) for c, kind in names.items()],
            (F.col("depth") + 1).cast("int").alias("depth"), "hidden", F.col("__out").alias("__tour"), F.concat(F.lit("[+"), F.col("hidden").cast("string"), F.lit(" more]")).alias(more),
        )
        ins = ins.withColumn(more, F.lit(None).cast("string")).select(*notes.columns).unionByName(notes)
    wanted = [*nodes.columns, "depth", "hidden", *([more] if more is not None else [])]
    return with_position(ins.select(*wanted, "__tour"), [F.col("__tour").asc()], "position").drop("__tour")
