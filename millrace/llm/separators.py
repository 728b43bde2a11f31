"""Token counts of the documents in flat, unindexed token files, by a scan for their end marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, scan, short_batches
from millrace.llm.tokens import WordTokenizer, batches, default_tokenizer

#: Ids of one block.
BLOCK = 1 << 16
BLOCKS = "stream string, block long, ids binary, doc_ids array<long>"
BLOCK_SCHEMA = pa.schema([("stream", pa.string()), ("block", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])


def token_blocks(docs: DataFrame, end_id: int, dtype: str = "<u2", tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The texts as flat token streams, one for each task, in blocks of ``block`` ids that pay no heed to documents.

    After each text's ids, in which strings of special tokens are ordinary text, comes ``end_id``. Ids that don't fit ``dtype`` are an error. ``doc_ids`` are the documents whose end mark the block holds, a manifest that
    the scan doesn't read. A null text is its end mark only.
    """
    path = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)
    width, most = np.dtype(dtype).itemsize, int(np.iinfo(dtype).max)
    if not 0 <= end_id <= most:
        raise ValueError(f"end id {end_id} doesn't fit {dtype}")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream, end = WordTokenizer(path, marks_as_text=True), f"part-{TaskContext.get().partitionId():05d}", np.array([end_id], dtype).tobytes()
        rest, due, number = b"", [], 0  # ids not sent yet; (position in them after the end mark, document)
        step = block * width

        def full(rest: bytes, due: list, number: int, last: bool):
            out, at, k = [], 0, 0
            while len(rest) - at >= step or last and at < len(rest):
                to = min(at + step, len(rest))
                own = []
                while k < len(due) and due[k][0] <= to:
                    own.append(due[k][1])
                    k += 1
                out.append((stream, number, rest[at:to], own))
                number, at = number + 1, to
            return out, rest[at:], [(p - at, d) for p, d in due[k:]], number

        for table in tables:
            keys = table.column(0).to_pylist()
            for at, some in batches(table.column(1)):
                pieces, position = [rest], len(rest)
                for doc, ids in zip(keys[at : at + len(some)], encoder.encode(some)):
                    ids = np.frombuffer(ids, "<u4")
                    if len(ids) and int(ids.max()) > most:
                        raise ValueError(f"id {int(ids.max())} doesn't fit {dtype}")
                    ids = ids.astype(dtype).tobytes() + end
                    pieces.append(ids)
                    position += len(ids)
                    due.append((position, doc))
                out, rest, due, number = full(b"".join(pieces), due, number, False)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)
        out, *_ = full(rest, due, number, True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, BLOCKS)


def write_token_files(blocks: DataFrame, path: str) -> None:
    """Writes little-endian 32-bit ids below 2 ** 24 as flat files, a file for each partition, rows in their order.

    Spark's text writer ends every row with a separator; the zero byte that such an id ends with serves as that.
    """
    cut = F.expr("substring(ids, 1, octet_length(ids) - 1)").cast("string")
    blocks.where(F.octet_length("ids") > 0).select(cut.alias("value")).write.option("lineSep", "\x00").text(path)


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u4", block: int = BLOCK) -> DataFrame:
    """Flat token files (of less than 2 GB each) as blocks; the stream is the file's path. A file that ends in part of an id is an error."""
    width = np.dtype(dtype).itemsize

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for name, content in zip(table.column(0).to_pylist(), table.column(1)):
                data = memoryview(content.as_buffer())
                if len(data) % width:
                    raise ValueError(f"{name} ends in part of an id of {width} bytes")
                for number, at in enumerate(range(0, len(data), block * width)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([bytes(data[at : at + block * width])], pa.binary()), pa.array([None], pa.list_(pa.int64()))], schema=BLOCK_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def count_tokens(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(stream, ordinal, start, n_tokens, ended, doc_id) of every document in the blocks of flat streams.

    Each block is searched on its own for ``end_id``; how many ids and end marks precede a block and where the last of
    these is follow from a prefix scan over block totals, which stitches documents that cross borders. ``n_tokens`` is
    without the end mark. Ids behind a stream's last end mark are a document with ``ended`` false. ``doc_id`` is null
    unless the blocks name their documents. Blocks without ids, or null, count as empty; a stream without ids has no row.
    """

    def search(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            sizes, ends = [], []
            for ids in table.column(2).to_pylist():
                found = np.frombuffer(ids or b"", dtype)
                sizes.append(len(found))
                ends.append(np.flatnonzero(found == end_id).astype(np.int64))
            flat = np.concatenate(ends) if ends else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [table.column(0), table.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())), table.column(3)],
                names=["stream", "block", "n_ids", "ends", "doc_ids"],
            )

    found = blocks.select("stream", "block", "ids", "doc_ids").mapInArrow(search, "stream string, block long, n_ids long, ends array<long>, doc_ids array<long>")
    found = cut(found.withColumns({"n_ends": F.size("ends").cast("long")}))  # a number for each document; the scans read it twice, the ids once
    placed = scan(found, ["stream"], ["block"], {"before": ("sum", "n_ids"), "ended_before": ("sum", "n_ends")})
    placed = placed.withColumns({"before": F.coalesce("before", F.lit(0)), "ended_before": F.coalesce("ended_before", F.lit(0))})
    placed = placed.withColumn("__last", F.when(F.col("n_ends") > 0, F.col("before") + F.element_at("ends", -1)))
    placed = scan(placed, ["stream"], ["block"], {"__open": ("max", "__last")})
    first = F.coalesce(F.col("__open") + 1, F.lit(0))
    exploded = placed.select("stream", "before", "ended_before", "ends", "doc_ids", first.alias("__first"), F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("__first")).otherwise(F.col("before") + F.get("ends", F.col("i") - 1) + 1)
    whole = exploded.select(
        "stream", (F.col("ended_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("before") + F.col("end") - start).alias("n_tokens"),
        F.lit(True).alias("ended"), F.get("doc_ids", F.col("i")).alias("doc_id"),
    )
    tails = placed.groupBy("stream").agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("__last") + 1, F.lit(0)).alias("start"))
    tails = tails.where("n > start").select("stream", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"), F.lit(None).cast("long").alias("doc_id"))
    return whole.unionByName(tails)


def count_document_tokens(docs: DataFrame, end_id: int = 49407, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``count_tokens`` of the texts' own token streams."""
    return count_tokens(token_blocks(docs, end_id, tokenizer=tokenizer, id_col=id_col, text_col=text_col), end_id)
