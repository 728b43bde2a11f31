"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products in them, one representative a group."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.cells import SAMPLE, assign, kmeans, lengths, matrix, merge_centres, nearest, sampled, uniform, unit, usable
from millrace.llm.common import components, cut

#: Vectors per fine cell aimed at; coarse cells at most; the nearest coarse cells, and in each the nearest fine ones, that
#: a vector is in; rows of one block of a cell; rows that a fine cell's centre is learned from; and rows that are dealt to
#: their fine cells in one task.
PER_CELL, MOST_COARSE, COARSE, FINE, BLOCK, LEARNT, DEALT = 400, 1024, 3, 3, 8192, 40, 10_000


def near_duplicates(vectors: DataFrame, least: float = 0.9, per_cell: int = PER_CELL, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors link if their cosine in double precision is at least ``least``. Equal vectors are one, with a weight.
    Spherical k-means has two levels, a bounded sample learning the coarse cells and one of each coarse cell its fine
    cells, so cells keep their size whatever the number of rows. A vector is compared in the COARSE times FINE cells
    nearest to it, a pair in the first cell that both share, so it counts once; pairs that share no cell are missed
    (measured recall: README). Centres share a cell where enough pairs of a sample of their vectors link, so a dense
    group is in one, and vectors that only have a direction in common are not. Cells larger than ``block`` rows are compared block against block in tasks of their own. A
    task reports how many each vector links with and a forest of links, not its pairs, so what leaves it grows with its rows.

    Null, zero and non-finite vectors link with nothing: 0 links, themselves, kept. So does a row with a null id, whose
    component is null. Vectors link only with those of their length. Rows with the same id are one node with the links
    of all, each reported with its own number; repeated rows are other vectors.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    good = rows.where("ok AND id IS NOT NULL")
    groups = cut(good.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("w")))
    found = [compare(groups.where(F.size("vector") == d), n, least, per_cell, block) for d, n, _ in lengths(groups)]
    found = reduce(DataFrame.unionByName, found) if found else rows.limit(0).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("other"))
    again = good.groupBy("id").agg(F.count("*").alias("k")).where("k > 1")
    named = good.join(again, "id", "left_semi").join(groups.select("vector", F.col("id").alias("first")), "vector")
    forest = components(found.where("other IS NOT NULL").selectExpr("id AS a", "other AS b").union(named.selectExpr("id AS a", "first AS b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    solved = groups.join(linked, "id", "left").join(forest, F.col("id") == F.col("node"), "left")
    solved = solved.select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).cast("long").alias("links"), F.coalesce("component", "id").alias("component"))
    joined = rows.join(solved, F.col("ok") & F.col("id").isNotNull() & (F.col("vector") == F.col("v")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def placed_in_cells(groups: DataFrame, n: int, least: float, per_cell: int) -> DataFrame:
    """(id, w, vector, cells) of the n distinct vectors (id, vector, w) of one length: ``cells`` are those that each is compared in."""
    _, some = sampled(groups, n)
    some = unit(some)
    centres = kmeans(some, min(MOST_COARSE, round(math.sqrt(n / per_cell))), True)
    placed = cut(assign(groups, centres, COARSE, None, merge_centres(centres, least, some)))
    in_coarse = placed.withColumn("coarse", F.explode("cells"))
    sizes = in_coarse.groupBy("coarse").agg(F.count("*").alias("n")).collect()  # MOST_COARSE rows at most
    plan = groups.sparkSession.createDataFrame(
        [(r["coarse"], max(1, round(r["n"] / per_cell)), min(1.0, SAMPLE / r["n"], LEARNT * max(1, round(r["n"] / per_cell)) / r["n"]), -(-r["n"] // DEALT)) for r in sizes], "coarse int, k int, rate double, parts int",
    )
    in_coarse = in_coarse.join(F.broadcast(plan), "coarse")

    def learn(table: pa.Table) -> pa.Table:
        coarse, k = table.column("coarse")[0].as_py(), table.column("k")[0].as_py()
        x = unit(matrix(table.column("vector")))
        x = x[np.lexsort((*x.T[::-1], table.column("id").to_numpy()))]
        fine = kmeans(x, min(k, max(1, len(x) // 4)), True)
        cells = merge_centres(fine, least, x)
        return pa.table({"coarse": pa.array(np.full(len(fine), coarse, np.int32)), "cell": pa.array(cells.astype(np.int32)), "centre": pa.array(fine.tolist(), pa.list_(pa.float64()))})

    chosen = in_coarse.where(uniform(12) < F.col("rate")).select("coarse", "k", "id", "vector")
    fine = cut(chosen.groupBy("coarse").applyInArrow(learn, "coarse int, cell int, centre array<double>"))
    fine = fine.join(F.broadcast(plan.select("coarse", "parts")), "coarse").select("coarse", "cell", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = in_coarse.select("coarse", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "w", "vector", (F.col("coarse") == F.element_at("cells", 1)).alias("carries"))

    def deal(own: pa.Table, fine: pa.Table) -> pa.Table:
        coarse = own.column("coarse")[0].as_py() if own.num_rows else 0
        carries, codes = own.column("carries"), np.empty((0, 1), np.int64)
        if own.num_rows:
            cells = fine.column("cell").to_numpy() if fine.num_rows else np.zeros(1, np.int64)
            x = unit(matrix(own.column("vector")))
            centres = matrix(fine.column("centre")) if fine.num_rows else x[:1]
            codes = (np.int64(coarse) << 32) + nearest(x, centres, FINE, cells)
        offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
        vector = pc.if_else(carries.combine_chunks(), own.column("vector").combine_chunks(), pa.scalar(None, own.schema.field("vector").type))
        return pa.table({"id": own.column("id"), "w": own.column("w"), "vector": vector, "codes": pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))})

    coded = dealt.groupBy("coarse", "part").cogroup(fine.groupBy("coarse", "part")).applyInArrow(deal, "id long, w long, vector array<double>, codes array<long>")
    return cut(coded.groupBy("id").agg(F.max("w").alias("w"), F.max("vector").alias("vector"), F.sort_array(F.flatten(F.collect_list("codes"))).alias("cells")))


def joined_labels(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the labels ``top``, roots of a forest over rows, equal for the rows of each pair (a, b)."""
    while len(a):
        x, y = top[a], top[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top != top[top]).any():
            top[:] = top[top]


def compare(groups: DataFrame, n: int, least: float, per_cell: int, block: int) -> DataFrame:
    """(id, links, other) of n distinct vectors (id, vector, w) of one length: link counts by weight, and links that hold components together."""
    placed = placed_in_cells(groups, n, least, per_cell).withColumn("cell", F.explode("cells"))
    large = cut(placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).where("n > 1"))
    dealt = placed.join(large, "cell", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("cell", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "id", "w", "vector", "cells")

    def run(table: pa.Table) -> pa.Table:
        cell, x, y = (table.column(c)[0].as_py() for c in ("cell", "x", "y"))
        table = table.sort_by("id")
        ids, w, b = (table.column(c).to_numpy() for c in ("id", "w", "b"))
        v, codes = unit(matrix(table.column("vector"))), table.column("cells").combine_chunks()
        width = int(codes.value_lengths().to_numpy().max())
        shared = np.full((len(ids), width), np.iinfo(np.int64).max)
        shared[np.arange(width) < codes.value_lengths().to_numpy()[:, None]] = codes.flatten().to_numpy()
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        links, top = np.zeros(len(ids)), np.arange(len(ids))
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            p, q = np.nonzero(v[own] @ v[right].T >= least)
            i, j = own[p], right[q]
            once = i < j if x == y else np.ones(len(i), bool)
            i, j = i[once], j[once]
            for k in range(0, len(i), 65536):
                a, c = i[k : k + 65536], j[k : k + 65536]
                here = np.ones(len(a), bool)
                for code in range(width):  # a pair belongs to the smallest cell that both are in: to an earlier one, if they share it
                    earlier = shared[a, code] < cell
                    here &= ~(earlier & (shared[a, code][:, None] == shared[c]).any(axis=1))
                a, c = a[here], c[here]
                links += np.bincount(a, w[c], len(ids)) + np.bincount(c, w[a], len(ids))
                joined_labels(top, a, c)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some].astype(np.int64), "other": pa.array(ids[top[some]], mask=top[some] == some)})

    return cut(dealt.groupBy("cell", "x", "y").applyInArrow(run, "id long, links long, other long"))
