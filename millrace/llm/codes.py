"""Vector code compression: product codes over whole numbers, screened by float32 products and settled in int64."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import split_join

#: Largest relative rounding of a float32, and of a float64 operation.
ROUNDING, FINE = 2.0**-24, 2.0**-53
#: Rows compared at once.
BLOCK = 8192


@dataclass
class Codebooks:
    """``entries``: of each part its entries' components, (parts, entries, width); ``length`` and ``limit``: of vectors and components; ``scale``: whole numbers to 1."""

    entries: np.ndarray
    length: int
    limit: int
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def clean(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is not null and holds neither nulls nor components that are not finite."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    return vectors.where(F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def whole(column: pa.Array, length: int, limit: int, scale: int) -> np.ndarray:
    """floor(scale * x) of an array column as rows of ``length`` numbers within ``limit``; missing ends are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    flat = np.clip(flat, -limit, limit).astype(np.int64)
    if len(sizes) and (sizes == length).all():
        return flat.reshape(-1, length)
    out = np.zeros((len(sizes), length), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of whole numbers the nearest entry, ties to the lower index, and the squared distance, both exact.

    A float32 matrix product gives |c|^2 - 2 x.c within an interval: n products of rounded factors, added in any order,
    are off by at most g = (n + 2) u / (1 - (n + 2) u) times |x| |c|. Every entry whose interval reaches the least upper
    end is computed again in int64; no other can be nearest.
    """
    n = x.shape[1] + 2
    off = n * ROUNDING / (1 - n * ROUNDING)
    square = (entries * entries).sum(axis=1).astype(np.float64)
    length = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    narrow = entries.astype(np.float32).T
    best, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        some = x[at : at + BLOCK]
        screened = square - 2.0 * (some.astype(np.float32) @ narrow).astype(np.float64)
        reach = np.sqrt((some.astype(np.float64) ** 2).sum(axis=1))[:, None] * (1 + 1e-9) * length
        slack = 2 * off * reach + 16 * FINE * (square + 2 * reach)
        row, entry = np.nonzero(screened - slack <= (screened + slack).min(axis=1, keepdims=True))
        exact = np.full(screened.shape, np.iinfo(np.int64).max)
        gap = some[row] - entries[entry]
        exact[row, entry] = (gap * gap).sum(axis=1)
        best[at : at + BLOCK] = exact.argmin(axis=1)
        far[at : at + BLOCK] = exact.min(axis=1)
    return best, far


def columns_of(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, vector) of the clean rows, whatever other columns there are."""
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    return clean(rows, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def train_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of all clean rows, None if there are none; the table is read once a round, so give a stored one.

    They start as the parts of the rows with the smallest ids (null last, equal ids by vector); each round takes
    componentwise floor(sum / count) of the parts nearest to an entry, and leaves an entry without any. Tasks send a sum
    for each entry and position, so what reaches the driver depends on the vectors' length alone. Components x become
    floor(scale * x). Vectors shorter than the longest, or than a multiple of ``parts``, count as filled up with 0, and
    numbers beyond what keeps distances in int64 (2 ** 27 at 64 components) as that.
    """
    rows = columns_of(vectors, id_col, vector_col, None).select("id", "vector")
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    length = width * parts
    limit = 1 << ((62 - (length - 1).bit_length()) // 2 - 1)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column(0).combine_chunks()
    books = Codebooks(whole(first, length, limit, scale).reshape(-1, parts, width).transpose(1, 0, 2), length, limit, scale)
    for _ in range(rounds):
        books = improved(rows, books)
    return books


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round over ``rows`` (id, vector)."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.entries.shape

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for table in tables:
            x = whole(table.column(0), own.length, own.limit, own.scale).reshape(-1, parts, width)
            for p in range(parts):
                best, _ = nearest_entries(x[:, p], own.entries[p])
                order = best.argsort(kind="stable")
                heads = np.flatnonzero(np.diff(best[order], prepend=-1))
                if len(heads):
                    sums[p, best[order][heads]] += np.add.reduceat(x[order, p], heads, axis=0)
                counts[p] += np.bincount(best, minlength=entries)
        used = np.argwhere(counts > 0)
        if len(used):
            p, e = used.T
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * width + 1, width, dtype=np.int32)), pa.array(sums[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), flat], names=["part", "entry", "n", "sums"])

    found = rows.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode("sums"))
    totals = found.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()  # a row for each number of the codebooks
    new = books.entries.copy()
    for r in totals:
        new[r.part, r.entry, r.pos] = r.total // r.n
    return Codebooks(new, books.length, books.limit, books.scale)


def encode_vectors(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(``id_col``, label, code, error, label_error) of every clean row: two hex digits a part, and squared distances in whole numbers.

    ``label_error`` sums the errors of rows of an equal label, nulls together (at most the largest long); labels of many
    rows are split over tasks. A row for each row: repeated rows and null ids have theirs. Without codebooks no rows.
    """
    rows = columns_of(vectors, id_col, vector_col, label_col)
    kind = rows.schema["label"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for table in tables:
            if own is None or not table.num_rows:
                continue
            parts, entries, width = own.entries.shape
            x = whole(table.column(2), own.length, own.limit, own.scale).reshape(-1, parts, width)
            codes, error = np.empty((len(x), parts), np.uint8 if entries <= 256 else np.uint16), np.zeros(len(x), np.int64)
            for p in range(parts):
                best, far = nearest_entries(x[:, p], own.entries[p])
                codes[:, p] = best
                error += far
            digits = codes.astype(codes.dtype.newbyteorder(">")).tobytes().hex()
            step = 2 * parts * codes.itemsize
            yield pa.RecordBatch.from_arrays([table.column(0), table.column(1), pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    coded = rows.mapInArrow(run, f"id long, label {kind}, code string, error long")
    coded = coded.withColumn("key", F.struct("label"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    totals = coded.groupBy("key").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), most).cast("long").alias("label_error"))
    joined = split_join(coded, totals, "key", "id")
    return joined.select(F.col("id").alias(id_col), "label", "code", "error", "label_error")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", **how: int) -> DataFrame:
    """``encode_vectors`` by the rows' own codebooks, with the ``codebooks_sha256`` of these; ``how`` as in ``train_codebooks``."""
    books = train_codebooks(vectors, id_col, vector_col, **how)
    return encode_vectors(vectors, books, id_col, vector_col, label_col).withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))
