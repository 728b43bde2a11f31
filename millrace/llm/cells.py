"""Vectors and the cells they fall in: validity, samples, k-means, assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that k-means learns from at most, about.
SAMPLE = 20_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, ok): vectors as double arrays; ok if not null, not empty, all components finite, not all zero."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(F.forall("vector", finite), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    return rows.withColumn("ok", good)


def lengths(rows: DataFrame) -> list[tuple[int, int, float]]:
    """(length, rows, scale) of the vectors of ``rows``: vectors are compared with those of their length only, one search a length.

    ``scale`` is a power of two near the largest component; vectors divided by it have squares in the range of doubles.
    """
    largest = F.array_max(F.transform("vector", F.abs))
    found = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(largest).alias("top")).orderBy("d").collect()
    return [(r["d"], r["n"], 2.0 ** (math.frexp(r["top"])[1] - 1)) for r in found]


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths, without nulls, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither large nor tiny components leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def uniform(seed: int) -> Column:
    """A draw from 0 to 1 by id and vector, so that copies of a vector are drawn one by one."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "vector"), 11).cast("double") / float(2**53)


def sampled(rows: DataFrame, n: int, sample: int = SAMPLE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about ``sample`` of the n rows (id, vector), chosen by hash; of one at least, if there is any."""
    got = rows.where(uniform(seed) < min(1.0, sample / max(n, 1))).select("id", "vector").toArrow()
    if not got.num_rows:
        got = rows.select("id", "vector").orderBy("id", "vector").limit(1).toArrow()
    x, ids = matrix(got.column("vector")), got.column("id").to_numpy()
    order = np.lexsort((*x.T[::-1], ids))
    return ids[order], x[order]


def kmeans(x: np.ndarray, k: int, spherical: bool, steps: int = 12, seed: int = 11) -> np.ndarray:
    """k centres of the rows x; of length one, if ``spherical``."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps if k > 1 else 1):
        own = nearest(x, centres, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        sums[own[order][first]] = np.add.reduceat(x[order], first, axis=0)
        centres = np.where((counts == 0)[:, None], x[rng.choice(len(x), k)], sums / np.maximum(counts, 1)[:, None])
        if spherical:
            centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


#: Rows of each centre by which two centres are compared, and the share of their pairs that must link for one cell: then a
#: comparison of the whole cell costs some ten products a link at most.
COMPARED, LINKED = 16, 0.1


def merge_centres(centres: np.ndarray, least: float, x: np.ndarray) -> np.ndarray:
    """Of each centre of length one its cell: centres share one if enough pairs of their own rows of ``x`` have a cosine of at least ``least``, and so do those that such centres connect.

    Centres are means, and so closer to each other than their rows are; only rows show whether a group is dense.
    """
    own = nearest(x, centres, 1)[:, 0]
    order = np.argsort(own, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
    few = rank < COMPARED
    held, there = np.zeros((len(centres), COMPARED, x.shape[1])), np.zeros((len(centres), COMPARED), bool)
    held[own[few], rank[few]], there[own[few], rank[few]] = x[few], True
    close = np.eye(len(centres), dtype=bool)
    for i in range(len(centres)):
        near = i + 1 + np.flatnonzero(centres[i + 1 :] @ centres[i] >= least)
        for at in range(0, len(near), 256):
            j = near[at : at + 256]
            pairs = there[i][:, None] & there[j][:, None, :]
            linked = (np.matmul(held[i], held[j].transpose(0, 2, 1)) >= least) & pairs
            close[i, j[linked.sum(axis=(1, 2)) >= LINKED * np.maximum(1, pairs.sum(axis=(1, 2)))]] = True
    close |= close.T
    cells = np.full(len(centres), -1, np.int64)
    for i in range(len(centres)):
        if cells[i] < 0:
            new = np.arange(len(centres)) == i
            while new.any():
                cells[new] = i
                new = close[new].any(axis=0) & (cells < 0)
    return np.unique(cells, return_inverse=True)[1]


def nearest(x: np.ndarray, centres: np.ndarray, m: int, cells: np.ndarray | None = None) -> np.ndarray:
    """Of each row the m nearest centres, nearest first; the m nearest cells, by their nearest centre, if ``cells`` has each centre's cell."""
    square, found = (centres * centres).sum(axis=1), []
    order = None if cells is None else np.argsort(cells, kind="stable")
    for at in range(0, max(1, len(x)), 4096):
        far = square - 2 * (x[at : at + 4096] @ centres.T)
        if cells is not None:
            far = np.minimum.reduceat(far[:, order], np.flatnonzero(np.diff(cells[order], prepend=-1)), axis=1)
        take = min(m, far.shape[1])
        if take == 1:
            found.append(far.argmin(axis=1)[:, None])
            continue
        some = np.argpartition(far, take - 1, axis=1)[:, :take]
        found.append(np.take_along_axis(some, np.take_along_axis(far, some, axis=1).argsort(axis=1, kind="stable"), axis=1))
    return np.concatenate(found)


def assign(rows: DataFrame, centres: np.ndarray, m: int, scale: float | None = None, merged: np.ndarray | None = None) -> DataFrame:
    """``rows`` (with a column ``vector``) and ``cells``, the m nearest cells of each: of vectors divided by ``scale``, or of length one.

    ``merged`` has each centre's cell if some share one.
    """
    held = rows.sparkSession.sparkContext.broadcast((centres, merged))  # some thousand centres at most, as callers see to
    names = rows.columns

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            if table.num_rows:
                x = matrix(table.column(names.index("vector")))
                own = nearest(unit(x) if scale is None else x / scale, held.value[0], m, held.value[1]).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*table.columns, cells], names=[*names, "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "cells array<int>"]))
