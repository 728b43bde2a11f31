"""Approximate nearest neighbours: inverted lists, scanned dimension by dimension with early abandoning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.cells import assign, kmeans, lengths, matrix, sampled, usable
from millrace.llm.common import cut

#: Lists are LISTS times the root of the number of rows, at most MOST_LISTS; a row is in its OVERLAP nearest, a query probes its PROBES nearest.
LISTS, MOST_LISTS, OVERLAP, PROBES = 5, 4096, 4, 96
#: Dimensions of one column block, rows of one block of a list, queries that a task answers, and how many standard
#: deviations a partial distance may be above what it should be for a neighbour before a candidate is given up.
COLUMNS, BLOCK, QUERIES, SURENESS = 16, 4096, 8192, 3.0
#: Rows that bound a query before its first list, whatever the number of rows; never a result themselves.
BOUNDING = 2048


def rotation(n: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix: distances stay, and any block of rotated dimensions is a fair sample of a difference."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision; differences whose squares would leave its range are scaled first."""
    difference = a - b
    top = np.abs(difference).max(axis=1)
    scale = np.where((top > 1e-140) & (top < 1e140) | (top == 0), 1.0, top)
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.sqrt(((difference / scale[:, None]) ** 2).sum(axis=1)) * scale
    return np.where(np.isinf(top), np.inf, out)


def most_share(seen: int, dims: int, sureness: float) -> float:
    """The share of a squared distance that ``seen`` of ``dims`` rotated dimensions hold at most, but for chances beyond
    ``sureness`` standard deviations: under a random rotation it follows a beta distribution."""
    return min(1.0, seen / dims + sureness * math.sqrt(2 * seen * (dims - seen) / (dims * dims * (dims + 2))))


def scan_list(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, columns: int = COLUMNS, sureness: float = SURENESS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rotated vectors that aren't given up.

    Block by block of rotated dimensions a pair whose partial squared distance is more than ``most_share`` of its
    query's squared bound is given up: the hypothesis that the row is within the bound is rejected. All pairs are
    measured by matrix products at first, and pair by pair once most are gone.
    """
    dims = rows.shape[1]
    squares = bounds**2 * (1 + 1e-9)
    partial = np.zeros((len(queries), len(rows)))
    pairs = None
    for at in range(0, dims, columns):
        a, b = queries[:, at : at + columns], rows[:, at : at + columns]
        limit = squares * most_share(min(at + columns, dims), dims, sureness)
        if pairs is None:
            partial += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
            alive = partial <= limit[:, None] + 1e-9 * squares[:, None]
            if 4 * np.count_nonzero(alive) < alive.size or at + columns >= dims:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            q, r = pairs
            partial = partial + ((a[q] - b[r]) ** 2).sum(axis=1)
            ok = partial <= limit[q]
            pairs, partial = (q[ok], r[ok]), partial[ok]
    return pairs


def best_of(query: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k nearest different ids, by distance, then id."""
    order = np.lexsort((far, ids, query))
    first = np.r_[True, (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])][: len(order)]
    some = order[first]
    some = some[np.lexsort((ids[some], far[some], query[some]))]
    start = np.flatnonzero(np.r_[True, query[some][1:] != query[some][:-1]])
    rank = np.arange(len(some)) - np.repeat(start, np.diff(np.r_[start, len(some)])) if len(some) else np.empty(0, np.int64)
    return some[rank < k]


def group_lists(counts: np.ndarray, block: int) -> np.ndarray:
    """Of each list the first part it is in: small lists share a part of about ``block`` rows, a larger one has as many parts of its own as it has blocks."""
    out, part, held = np.zeros(len(counts), np.int64), 0, 0
    small = np.flatnonzero(counts <= block)
    for c in small.tolist():
        if held and held + counts[c] > block:
            part, held = part + 1, 0
        out[c] = part
        held += counts[c]
    part += len(small) > 0
    for c in np.flatnonzero(counts > block).tolist():
        out[c] = part
        part += -(-int(counts[c]) // block)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, probes: int = PROBES, overlap: int = OVERLAP, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the k nearest found among all other rows, by Euclidean distance.

    ``is_query`` is a condition on the column ``id``. The lists are those of a k-means fitted on a bounded sample; every
    row is in its ``overlap`` nearest lists, and a query probes its ``probes`` nearest, whatever the number of rows
    (recall: README). BOUNDING rows of the sample bound each query's distance before its first list, by the 4k-th nearest
    of them, which is farther than the k-th of all; results come from lists alone. Lists are dealt to parts of about ``block`` rows, large ones split, and parts with many queries are answered in several tasks.

    Ties go to the smaller id. Vectors that are null, zero or not finite, or with a null id, take no part; vectors are
    compared with those of their length. Rows with the same id are candidates each, but never of a query with that id;
    of candidates with one id the nearest counts. Components of any finite size are compared without overflow.
    """
    rows = cut(usable(vectors, id_col, vector_col).where("ok AND id IS NOT NULL").select("id", "vector"))
    none = rows.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    found = [search_length(rows.where(F.size("vector") == d), is_query, d, n, scale, k, probes, overlap, block) for d, n, scale in lengths(rows)] if probes > 0 else []
    if not found:
        return none
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_length(rows: DataFrame, is_query: Column, dims: int, n: int, scale: float, k: int, probes: int, overlap: int, block: int) -> DataFrame:
    """(query_id, vec_id, score) of candidates among n vectors of one length, the nearest that each part of the lists has for a query."""
    spark = rows.sparkSession
    some_ids, some = sampled(rows, n)
    bounding = np.random.default_rng(17).permutation(len(some))[:BOUNDING]
    centres = kmeans(some / scale, min(MOST_LISTS, math.ceil(LISTS * math.sqrt(n)), max(1, len(some) // 4)), False)
    listed = cut(assign(rows, centres, overlap, scale).withColumn("cells", F.array_distinct("cells")))
    sizes = {r["cell"]: r["n"] for r in listed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one for each centre
    counts = np.array([sizes.get(c, 0) for c in range(len(centres))])
    blocks, group = np.maximum(1, -(-counts // block)), group_lists(counts, block)
    held = spark.sparkContext.broadcast((centres, group, blocks, some_ids[bounding], some[bounding]))  # bounded by MOST_LISTS and BOUNDING
    asking = rows.where(is_query)
    turns = max(1, math.ceil(asking.count() * min(1.0, probes / len(centres)) / QUERIES))

    def probe(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, group, blocks, some_ids, some = held.value
        square, scaled = (centres * centres).sum(axis=1), some / scale
        lengths_of = (scaled * scaled).sum(axis=1)
        for table in tables:
            whole = matrix(table.column(1)) if table.num_rows else np.empty((0, dims))
            for at in range(0, table.num_rows, 256):
                x, names = whole[at : at + 256], table.column(0).slice(at, 256).to_numpy()
                order = (square - 2 * (x / scale) @ centres.T).argsort(axis=1, kind="stable")[:, :probes]
                close = lengths_of - 2 * (x / scale) @ scaled.T
                out = []
                for i, name in enumerate(names.tolist()):
                    top = np.argpartition(close[i], 8 * k)[: 8 * k + 1] if len(some) > 8 * k + 1 else np.arange(len(some))
                    for chosen in (top, np.arange(len(some))):  # the second only if there are many copies among the first
                        chosen = chosen[some_ids[chosen] != name]
                        far = distance(some[chosen], x[i])
                        b = best_of(np.zeros(len(chosen), np.int64), some_ids[chosen], far, 4 * k)
                        if len(b) == 4 * k:
                            break
                    bound = float(far[b].max()) if len(b) == 4 * k else math.inf
                    asked: dict[int, list[int]] = {}
                    for c in order[i].tolist():  # nearest list first
                        for j in range(blocks[c]):
                            asked.setdefault(int(group[c]) + j, []).append(c)
                    out += [(name, x[i], bound, part, own) for part, own in asked.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.list_(pa.int32())))],
                    names=["id", "vector", "bound", "part", "cells"],
                )

    asked = cut(asking.select("id", "vector").mapInArrow(probe, "id long, vector array<double>, bound double, part int, cells array<int>"))
    places = spark.createDataFrame([(c, int(group[c]), int(blocks[c])) for c in range(len(centres))], "cell int, first int, blocks int")
    stored = listed.select("id", "vector", F.explode("cells").alias("cell")).join(F.broadcast(places), "cell")
    part = (F.col("first") + F.pmod(F.xxhash64("id", "vector"), F.col("blocks"))).cast("int").alias("part")
    stored = stored.select("id", "vector", F.lit(None).cast("double").alias("bound"), part, F.array("cell").alias("cells"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), F.lit(False).alias("asks"))
    wanted = asked.select("id", "vector", "bound", "part", "cells", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int").alias("turn"), F.lit(True).alias("asks"))

    def run(both: pa.Table) -> pa.Table:
        asks = both.column("asks").to_numpy()
        own, asking = both.filter(pa.array(~asks)), both.filter(pa.array(asks))
        q_of, ids, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        names = asking.column("id").to_numpy()
        if len(own) and len(asking):
            x, q, turn = matrix(own.column("vector")), matrix(asking.column("vector")), rotation(dims) / scale
            rx, rq, row_ids, bounds = x @ turn, q @ turn, own.column("id").to_numpy(), asking.column("bound").to_numpy().copy()
            cell = own.column("cells").combine_chunks().flatten().to_numpy()
            lists = asking.column("cells").combine_chunks()
            asked_of, asked = np.repeat(np.arange(len(asking)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            for c in np.unique(cell).tolist():
                rows, who = np.flatnonzero(cell == c), asked_of[asked == c]
                for at in range(0, len(who), 512):
                    mine = who[at : at + 512]
                    a, b = scan_list(rq[mine], rx[rows], bounds[mine] / scale)
                    a, b = mine[a], rows[b]
                    other = names[a] != row_ids[b]
                    a, b = a[other], b[other]
                    exact = distance(x[b], q[a])
                    ok = exact <= bounds[a]
                    q_of, ids, far = np.r_[q_of, a[ok]], np.r_[ids, row_ids[b[ok]]], np.r_[far, exact[ok]]
                    keep = best_of(q_of, ids, far, k)
                    q_of, ids, far = q_of[keep], ids[keep], far[keep]
                    full = np.flatnonzero(np.bincount(q_of, minlength=len(names)) == k)
                    last = np.searchsorted(q_of, full, side="right") - 1
                    bounds[full] = np.minimum(bounds[full], far[last])
        return pa.table({"query_id": names[q_of], "vec_id": ids, "score": far})

    return wanted.unionByName(stored).groupBy("part", "turn").applyInArrow(run, "query_id long, vec_id long, score double")
