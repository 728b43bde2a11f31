"""Packing documents into windows of tokens by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import short_batches
from millrace.llm.tokens import REMEMBERED, WordTokenizer, batches, default_tokenizer

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
#: Pieces that wait in one task for partners: with windows of 2048 ids at most 64 MB.
WAITING = 8192


def closest_fill(counts: dict[int, int], window: int, lengths: list[int] | None = None) -> dict[int, int]:
    """The multiset of lengths, the longest present among them, whose sum is closest below or at ``window``.

    Bit i of ``reach`` says that some multiset sums to i. Lengths enter from long to short, each in binary multiples of
    its count, until the window itself is reached; walking back through the layers gives how often each length is used. ``lengths`` are
    the keys of ``counts`` from long to short.
    """
    lengths = sorted(counts, reverse=True) if lengths is None else lengths
    longest = lengths[0]
    room = window - longest
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        left = min(counts[length] - (length == longest), room // length)
        multiple = 1
        while left > 0:
            k = min(multiple, left)
            layers.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            multiple *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {longest: 1}
    for length, k, before in reversed(layers):
        if not before >> total & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return used


def pack(waiting: dict[int, list], window: int, left: int) -> Iterator[list]:
    """Lists of pieces, one for each window, taken from ``waiting`` until at most ``left`` pieces are in it."""
    counts = {n: len(p) for n, p in waiting.items() if p}
    lengths = sorted(counts, reverse=True)
    held = sum(counts.values())
    while held > left:
        used = closest_fill(counts, window, lengths)
        size = sum(used.values())
        times = min(-(-(held - left) // size), *(counts[n] // k for n, k in used.items()))
        for _ in range(times):
            yield [waiting[n].pop() for n, k in used.items() for _ in range(k)]
        for n, k in used.items():
            counts[n] -= times * k
        held -= times * size
        if not all(counts[n] for n in used):
            lengths = [n for n in lengths if counts[n]]


def pack_documents(
    docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    waiting: int = WAITING, remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids (little-endian uint32).

    A document is its ids by the plain call of the tokenizer, and ``end_id``; its full windows are sequences of their own
    and the remainder is one piece. Each task packs the remainders of its rows by minimum bin slack: whenever ``waiting``
    of them wait, windows are filled, longest piece first, until half are left, and all at the task's end. So nothing is
    shuffled and memory is bounded; a window stays unfilled only where no choice of the waiting pieces fills it, mostly
    the last ones of a task. ``remembered`` bounds the bytes of words that a task keeps with their ids; fewer are slower.
    A null or empty text is ``end_id`` only, a null id is kept, repeated rows are documents of
    their own, an empty table gives no rows, and other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordTokenizer(path, remembered), int(end_id).to_bytes(4, "little")
        pool: dict[int, list] = {}
        held, sequence, out = 0, TaskContext.get().partitionId() << 33, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)
            out.clear()
            return batch

        def place(left: int) -> None:
            nonlocal sequence, held
            for pieces in pack(pool, window, left):
                offset = 0
                for doc, start, size, ids in pieces:
                    out.append((doc, start, len(ids) // 4, size, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            held = sum(map(len, pool.values()))

        for table in tables:
            keys = table.column(0).to_pylist()
            for at, some in batches(table.column(1)):
                for doc, ids in zip(keys[at : at + len(some)], encoder.encode(some)):
                    ids += end
                    size = len(ids) // 4
                    full = size - size % window
                    for start in range(0, full, window):
                        out.append((doc, start, window, size, sequence, 0, ids[start * 4 : (start + window) * 4]))
                        sequence += 1
                    if size > full:
                        pool.setdefault(size - full, []).append((doc, full, size, ids[full * 4 :]))
                        held += 1
                if held >= waiting:
                    place(waiting // 2)
                if out:
                    yield flush()
        place(0)
        if out:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
