"""Substring dedup by a relative Lempel-Ziv parse: documents are factored against the words of all documents with smaller ids.

The reference is indexed in blocks, one for each shuffle partition. A window of ``width`` words belongs to the phrase that
its smallest gram names (``phrases``), so equal windows look in the same block, whatever stands around them.

1. Phrases whose anchor occurs in one document only can hold no repeated window and are left out.
2. Each document is parsed from left to right: a phrase that an earlier document holds, word for word, goes on with the
   factor or begins one.
3. A factor ends at a phrase that no earlier document holds as a whole. If its anchor occurs elsewhere in other words, the
   factor may reach into it or another begin there: its windows are looked up one by one, once for all copies.

Windows found are the document's factors of at least ``width`` words. Hashes of phrases and windows are compared together
with those of their anchors, 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, marked, short_batches
from millrace.llm.hashing import SPACE
from millrace.llm.phrases import raw_bytes, windows, word_hashes
from millrace.llm.tokens import batches

WIDTH = 50
PHRASES = "doc long, copy long, anchor long, phrase long, start int, n int"
LOOSE = "doc long, copy long, anchor long, start int, windows array<long>"
KEPT = "id long, n_words long, n_removed long, kept string, factors array<struct<start:long,words:long,source:long>>"


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, copy) of all rows; ``copy`` tells texts of one id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("copy"))


def phrases_of(texts: DataFrame, width: int) -> DataFrame:
    """The phrases of all texts with an id: anchor, hash, first window and number of windows."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            ids, copies = table.column(0).to_numpy(), table.column(2).to_numpy()
            for at, some in batches(table.column(1)):
                for w in windows(*word_hashes([raw_bytes(t) for t in some]), width):
                    own, n = w.texts[w.heads] + at, np.diff(np.append(w.heads, len(w.texts)))
                    held = [ids[own], copies[own], w.anchors[w.heads].view(np.int64), w.phrases.view(np.int64), w.starts[w.heads].astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["doc", "copy", "anchor", "phrase", "start", "n"])

    return texts.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, PHRASES)


def windows_of(texts: DataFrame, loose: DataFrame, width: int) -> DataFrame:
    """The hashes of the windows of ``loose`` phrases (doc, copy, anchor, start, n), read again from the texts that have any."""
    wanted = cut(loose.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("phrases")))  # as many as the text's own
    near = marked(texts.where("id IS NOT NULL"), "id", wanted.select(F.col("doc").alias("id"))).where("__hit").drop("__hit")
    joined = near.withColumnRenamed("id", "doc").join(wanted, ["doc", "copy"]).select("doc", "copy", "text", "phrases")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for at, some in batches(table.column(2)):
                hashes, counts = word_hashes([raw_bytes(t) for t in some])
                every = np.concatenate([np.empty(0, np.uint64), *(w.hashes for w in windows(hashes, counts, width))]).view(np.int64)
                sizes = np.maximum(counts - width + 1, 0)
                lists = table.column(3).slice(at, len(some))
                flat, own = lists.flatten(), np.repeat(np.arange(len(some)), pa.compute.list_value_length(lists).to_numpy())
                anchors, starts, n = (flat.field(i).to_numpy() for i in range(3))
                ends = np.cumsum(n.astype(np.int64))
                places = np.repeat((np.cumsum(sizes) - sizes)[own] + starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                found = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(every[places]))
                take = pa.array(own + at)
                yield pa.RecordBatch.from_arrays([table.column(0).take(take), table.column(1).take(take), pa.array(anchors), pa.array(starts), found], names=["doc", "copy", "anchor", "start", "windows"])

    return joined.mapInArrow(run, LOOSE)


def repeated_spans(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, copy, start, n, source): runs of n windows of a document that a document with a smaller id, ``source``, holds too.

    ``texts`` are (id, text, copy). Keys of many rows, common phrases and windows, are aggregated before they are shuffled
    and joined by plain joins that adaptive execution splits: what they are joined with is written first.
    """
    short_batches(texts.sparkSession)
    phrases = phrases_of(texts, width)
    shared = cut(phrases.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor"))
    phrases = cut(phrases.join(shared, "anchor", "left_semi"))
    index = cut(phrases.groupBy("anchor", "phrase").agg(F.min("doc").alias("source")))
    several = cut(index.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"))
    placed = phrases.join(index, ["anchor", "phrase"])
    whole = placed.where("doc > source").select("doc", "copy", "start", "n", "source")
    loose = placed.where("doc = source").select("doc", "copy", "anchor", "start", "n").join(several, "anchor", "left_semi")
    single = cut(windows_of(texts, loose, width)).select("doc", "copy", "anchor", "start", F.posexplode("windows").alias("i", "window"))
    first = cut(single.groupBy("anchor", "window").agg(F.min("doc").alias("source"), F.max("doc").alias("high")).where("source < high").drop("high"))
    found = single.join(first, ["anchor", "window"]).where("doc > source")
    return whole.unionByName(found.select("doc", "copy", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"), "source"))


def factored(starts: np.ndarray, n: np.ndarray, sources: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Factors (first word, words, source), greedily: one goes on as long as the next window has its source."""
    order = np.lexsort((sources, starts))
    starts, ends, sources = starts[order], (starts + n)[order], sources[order]
    head = np.ones(len(starts), bool)
    head[1:] = (sources[1:] != sources[:-1]) | (starts[1:] > np.maximum.accumulate(ends)[:-1])
    first = np.flatnonzero(head)
    return [(s, e - s + width - 1, d) for s, e, d in zip(starts[first].tolist(), np.maximum.reduceat(ends, first).tolist() if len(first) else [], sources[first].tolist())]


def kept_words(raw: bytes, factors: list[tuple[int, int, int]]) -> tuple[int, int, bytes]:
    """Number of words, how many a factor covers, and the others, joined by single blanks."""
    codes = np.frombuffer(raw + b" ", np.uint8)
    part = SPACE[codes]
    starts, ends = np.flatnonzero(~part & np.concatenate([[True], part[:-1]])), np.flatnonzero(part & np.concatenate([[False], ~part[:-1]]))
    step = np.zeros(len(starts) + 1, np.int64)
    for s, n, _ in factors:
        step[s] += 1
        step[s + n] -= 1
    keep = np.cumsum(step[:-1]) == 0
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[starts[keep]] += 1
    inside[ends[keep] + 1] -= 1  # with the byte behind the word, which becomes a blank
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    out = np.where(part, np.uint8(32), codes)[inside].tobytes()
    return len(starts), int(len(starts) - keep.sum()), out[:-1]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(``id_col``, n_words, n_removed, kept, factors) of every row: its text without the words of factors that repeat a document with a smaller id.

    Words are parted by ASCII white space and compared as they are. A word goes if a window of ``width`` words around it
    also starts in a document with a smaller id; windows are judged on the texts as given, and what repeats within a
    document alone stays. ``kept`` are the other words, joined by one blank; ``factors`` have their first word, number of
    words and the smallest document that holds them. A row for each row: texts that are null or shorter than ``width``
    words lose nothing; a null id comes before and after none, so its text stays and is no reference; rows with one id
    are no reference for each other.
    """
    texts = texts_of(docs, id_col, text_col)
    spans = repeated_spans(texts, width).groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "n", "source")).alias("spans"))
    spans = cut(spans)
    rows = marked(texts, "id", spans.select(F.col("doc").alias("id")))
    near = rows.where("__hit").join(spans.withColumnsRenamed({"doc": "id"}), ["id", "copy"], "left").select("id", "text", "spans")
    far = rows.where("NOT __hit").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64())]))
        for table in tables:
            for at, some in batches(table.column(1)):
                lists, out, factors = table.column(2).slice(at, len(some)), [], []
                flat = lists.flatten()
                edges = np.cumsum(np.append(0, pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()))
                starts, n, sources = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
                for i, text in enumerate(some):
                    a, b = edges[i], edges[i + 1]
                    own = factored(starts[a:b], n[a:b], sources[a:b], width) if b > a else []
                    out.append(kept_words(raw_bytes(text), own))
                    factors.append([{"start": s, "words": w, "source": d} for s, w, d in own])
                words, removed, kept = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([table.column(0).slice(at, len(some)), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, kind)], names=["id", "n_words", "n_removed", "kept", "factors"])

    return near.unionByName(far).mapInArrow(run, KEPT).withColumnRenamed("id", id_col)
