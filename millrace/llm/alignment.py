"""Cross-tokenizer alignment: which tokens of two tokenizers lie over each other, and how often in the whole corpus.

Two tokens of a text are linked if their bytes overlap. As the tokens of either side follow each other without gaps, every
link is one stretch between neighbouring ends of either side, so all links of a text are the union of its token ends.

Multiplicities of linked id pairs, by document, are shuffled by the id of side B as sorted streams, which Spark spills. A
task reads an id's counts first, takes their maximum, and then streams its postings past them; what they add to each
document is summed by document. Ids go to a fixed number of ranges, and each range's blocks of documents to as many tasks
as there are rows for: a frequent id is split, and a document gets a contribution from each range at most.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import parts, shared_folder, short_batches
from millrace.llm.tokens import batches

#: A stretch that both sides cut off from the rest: from white space that is one blank or line feed between other
#: characters to before the next such. Longer white space, and such at the end, is inside.
CHUNK = re.compile(r"\s*\S+(?:(?:\s{2,}|[^\S \n])\S+)*(?:\s+\Z)?|\s+")
#: Goes before every text that is encoded, and its tokens are taken off.
LEAD = " a"
#: Bytes of chunks kept with their links by a Python worker, what one takes besides, and the longest kept, in characters.
REMEMBERED, ENTRY, LONGEST = 150_000_000, 330, 60
#: Documents and links of a block of postings, at most, but for one document.
DOCS, LINKS = 2048, 1_000_000
#: Ranges that B's ids are dealt to, whatever the number of tasks, so a document gets as many contributions at most; blocks
#: that a task takes of a range, about, and blocks whose sums it holds at once.
RANGES, TOGETHER, HELD = 16, 32, 64
ROWS = "block long, b int, a array<int>, d array<int>, m array<int>, place int, doc long, n_a long, n_b long, n_groups long, n_links long, groups string"
SUMS = "block long, d array<int>, best array<long>, total array<long>"


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenPairs:
    """Links and groups of texts under a byte-level tokenizer (A) and a sentencepiece model (B).

    A chunk's tokens don't depend on what stands around it: A parts words before white space, and no piece of B goes on
    over white space that follows another character (else texts are encoded whole). So chunks are looked up, and those
    not met before are encoded together. They are kept in two generations, so the frequent ones stay.
    """

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        bytes_of, vocabulary = byte_characters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        n, m = len(self.bytes_a), len(pieces)
        self.names = np.array([f"{i}{mark}" for k, marks in ((n, ",|"), (m, ",;")) for mark in marks for i in range(k)], object)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}  # forgotten next, unless met again
        self.held, self.remembered = 0, remembered

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides of texts that begin with LEAD, without its tokens."""
        a = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [np.array(x, np.int64) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]  # B puts the blank before
        return [self.after(x, self.sizes_a) for x in a], [self.after(x, self.sizes_b) for x in b]

    @staticmethod
    def after(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return ids[np.searchsorted(np.cumsum(sizes[ids]), len(LEAD)) + 1 :]

    def learn(self, new: list[str]) -> dict[str, tuple | None]:
        """Of each chunk its groups as text, its links (b << 32 | a) as bytes, and numbers of tokens A, B and groups; None where a side's bytes differ from it."""
        runs, own = [[]], []
        for chunk in new:  # white space at a chunk's end would join the next one's
            (own.append([chunk]) if chunk[-1].isspace() or not self.apart else runs[0].append(chunk))
        runs = [r for r in (*runs, *own) if r]
        out: dict[str, tuple | None] = {}
        if not runs:
            return out
        for run, a, b in zip(runs, *self.encoded([LEAD + "".join(r) for r in runs])):
            raw = "".join(run).encode()
            same = b"".join([self.bytes_a[i] for i in a.tolist()]) == raw and b"".join([self.bytes_b[i] for i in b.tolist()]) == raw
            if same:
                out.update(zip(run, self.aligned([len(c.encode()) for c in run], a, b)))
            elif len(run) == 1:
                out[run[0]] = None
            else:
                for half in (run[: len(run) // 2], run[len(run) // 2 :]):
                    out |= self.learn(half)
        return out

    def aligned(self, sizes: list[int], a: np.ndarray, b: np.ndarray) -> list[tuple]:
        """An entry for each chunk of a run, given the chunks' sizes in bytes and the run's ids."""
        ends = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs: merged
        twice = every[1:] == every[:-1]
        common, every = every[1:][twice], every[np.append(~twice, True)]
        in_common = lambda x: common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x
        links = b[np.searchsorted(ends_b, every)] << 32 | a[np.searchsorted(ends_a, every)]
        n, m = len(self.bytes_a), len(self.bytes_b)
        names = np.concatenate([a + n * in_common(ends_a), 2 * n + b + m * in_common(ends_b)])
        order = np.argsort(np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1]), kind="stable")
        names = self.names[names[order]].tolist()
        at = [np.append(0, np.searchsorted(x, ends, side="right")) for x in (every, ends_a, ends_b, common)]
        packed = links.tobytes()
        cuts, tokens = (8 * at[0]).tolist(), (at[1] + at[2]).tolist()
        n_a, n_b, n_groups = (np.diff(x).tolist() for x in at[1:])
        return [("".join(names[p:q]), packed[i:j], x, y, z) for p, q, i, j, x, y, z in zip(tokens, tokens[1:], cuts, cuts[1:], n_a, n_b, n_groups)]

    def remember(self, entries: dict[str, tuple | None]) -> None:
        self.known |= entries
        self.held += sum(ENTRY + 2 * len(c) + (len(e[0]) + len(e[1]) if e else 0) for c, e in entries.items())

    def align(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """The entries of each text's chunks, in turn; None for texts that are null, empty, or that a side doesn't give back."""
        chunks = [(CHUNK.findall(" " + t) if self.apart else [" " + t]) if t else [] for t in texts]
        if 2 * self.held > self.remembered:
            self.older, self.known, self.held = self.known, {}, 0
        missing = {c for own in chunks for c in own if c not in self.known}
        met = {c: self.older[c] for c in missing if c in self.older}
        new = self.learn([c for c in missing if c not in met])
        self.remember(met | {c: e for c, e in new.items() if len(c) <= LONGEST})
        long = {c: e for c, e in new.items() if len(c) > LONGEST}
        for own in chunks:
            found = [long[c] if c in long else self.known[c] for c in own] if long else list(map(self.known.__getitem__, own))
            yield None if not found or None in found else found


@lru_cache(maxsize=1)
def token_pairs(path_a: str, path_b: str) -> TokenPairs:
    """One for a Python worker, which takes many tasks."""
    return TokenPairs(path_a, path_b)


def default_pair() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """Rows of ROWS: one for each document, with ``place`` in its block, and one for each id of B in a block, with its postings (a, document's place, multiplicity)."""
    short_batches(docs.sparkSession)
    schema = pa.schema([("block", pa.int64()), ("b", pa.int32()), *((c, pa.list_(pa.int32())) for c in "adm"), ("place", pa.int32()), ("doc", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string())])

    def built(n: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def postings(block: int, links: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
        pairs, own = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
        places = np.repeat(np.arange(len(counts)), counts)
        keys, m = np.unique(own.astype(np.int64) * len(counts) + places, return_counts=True)
        pairs, places = pairs[keys // len(counts)], keys % len(counts)
        heads = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
        offsets = pa.array(np.append(heads, len(pairs)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, places, m)]
        for at in range(0, len(heads), 2000):
            n = min(2000, len(heads) - at)
            yield built(n, block=pa.array(np.full(n, block)), b=pa.array((pairs[heads[at : at + n]] >> 32).astype(np.int32)), **{c: x.slice(at, n) for c, x in zip("adm", lists)})

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, number = token_pairs(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        links, counts, held = [], [], 0  # of the open block's documents
        for table in tables:
            for at, some in batches(table.column(1)):
                facts, places, blocks = [], [], []
                for found in encoder.align(some):
                    own = b"".join([e[1] for e in found]) if found else b""
                    text = "".join([e[0] for e in found])[:-1] if found else ""
                    facts.append((*((sum(e[i] for e in found) if found else 0) for i in (2, 3, 4)), len(own) // 8, hashlib.sha256(text.encode()).hexdigest() if digest and text else text))
                    if len(counts) == DOCS or counts and held + len(own) > 8 * LINKS:
                        yield from postings(task | number, links, counts)
                        links, counts, held, number = [], [], 0, number + 1
                    places.append(len(counts))
                    blocks.append(task | number)
                    links.append(own)
                    counts.append(len(own) // 8)
                    held += len(own)
                kinds = (pa.int64(),) * 4 + (pa.string(),)
                named = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups"), (pa.array(c, k) for c, k in zip(zip(*facts), kinds))))
                yield built(len(some), block=pa.array(blocks), place=pa.array(places, pa.int32()), doc=table.column(0).slice(at, len(some)), **named)
        if held:
            yield from postings(task | number, links, counts)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, ROWS)


def contributions(streams: DataFrame) -> DataFrame:
    """SUMS of streams sorted by b in each part: rows of kind 0 have an id's counts (a, n), those of kind 1 behind them its postings of a block (a, d, m)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.empty(0, np.int64), np.empty(0, np.int64)  # of the ids that may go on
        slots: dict[int, int] = {}
        best, total = (np.zeros((HELD, DOCS), np.int64) for _ in range(2))
        touched = np.zeros((HELD, DOCS), bool)

        def flush() -> Iterator[pa.RecordBatch]:
            if slots:
                k = len(slots)
                row, place = np.nonzero(touched[:k])
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=k))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place.astype(np.int32), best[row, place], total[row, place])]
                yield pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int64()), *lists], names=["block", "d", "best", "total"])
                for x in (best, total, touched):
                    x[:k] = 0
                slots.clear()

        for table in tables:
            b, kind = (table.column(i).to_numpy() for i in (0, 1))
            sizes = pa.compute.list_value_length(table.column(3)).to_numpy()
            code = np.repeat(b.astype(np.int64) << 32, sizes) | table.column(3).flatten().to_numpy()
            is_count = np.repeat(kind == 0, sizes)
            codes, where = np.unique(np.concatenate([codes, code[is_count]]), return_index=True)
            n = np.concatenate([n, table.column(6).flatten().to_numpy()])[where]
            rows = np.flatnonzero(kind == 1)
            if len(rows):
                code, own = code[~is_count], np.repeat(np.arange(len(rows)), sizes[rows])
                heads = np.flatnonzero(np.diff(codes >> 32, prepend=-1))
                most = np.repeat(np.maximum.reduceat(n, heads), np.diff(np.append(heads, len(codes))))
                at = np.searchsorted(codes, code)
                d, m = (table.column(i).flatten().to_numpy().astype(np.int64) for i in (4, 5))
                blocks = table.column(2).take(pa.array(rows)).to_numpy()
                names, which = np.unique(blocks, return_inverse=True)
                for lot in range(0, len(names), HELD):
                    now = names[lot : lot + HELD]
                    if len(slots.keys() | set(now.tolist())) > HELD:
                        yield from flush()
                    slot = np.array([slots.setdefault(x, len(slots)) for x in now.tolist()])
                    chosen = (which[own] >= lot) & (which[own] < lot + HELD)
                    flat = slot[which[own][chosen] - lot] * DOCS + d[chosen]
                    np.add.at(best.ravel(), flat, m[chosen] * (n[at] == most[at])[chosen])
                    np.add.at(total.ravel(), flat, (m * n[at])[chosen])
                    touched.ravel()[flat] = True
            going = codes >> 32 == (int(b[-1]) if len(b) else -1)  # the next batch may have more of the last id
            codes, n = codes[going], n[going]
        yield from flush()

    return streams.select("b", "kind", "block", "a", "d", "m", "n").mapInArrow(run, SUMS)


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """(``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    Side A encodes a blank and the text, side B the text, before which it puts the blank; strings of special tokens are
    ordinary text. ``groups`` has, for each stretch between common ends, A's ids, ``|``, B's ids. A pair of ids counts as
    often as it is linked in the whole corpus; ``count_sum`` adds the counts of all links of a text, ``n_best`` is how many
    links have the highest count of their B id, ties included. Texts that are null, empty or not given back by both sides
    have no tokens: zeros and empty groups. A row for each row: ids may be null or come again. ``digest`` gives the
    lowercase hex SHA-256 of groups in their place, which are some five times as long as their text.

    Texts are encoded once and written to the shared folder as blocks of postings. Per id of B a task holds its counts,
    which the vocabulary of A bounds.
    """
    spark = docs.sparkSession
    one, two = default_pair() if path_a is None or path_b is None else (None, None)
    path = shared_folder(spark)
    aligned_blocks(docs, path_a or one, path_b or two, id_col, text_col, digest).write.parquet(path)
    rows = spark.read.schema(ROWS).parquet(path)
    postings = rows.where("b IS NOT NULL").select("block", "b", "a", "d", "m")
    pairs = postings.select("b", F.explode(F.arrays_zip("a", "m")).alias("x")).groupBy("b", "x.a").agg(F.sum("x.m").alias("n"))
    counts = pairs.groupBy("b").agg(F.collect_list(F.struct("a", "n")).alias("x")).select("b", F.col("x.a").alias("a"), F.col("x.n").alias("n"))
    blocks = rows.where("b IS NULL").agg(F.countDistinct("block")).first()[0]
    salts = -(-blocks // TOGETHER)
    lot = F.pmod(F.xxhash64("b"), F.lit(RANGES)).cast("int")
    none = F.lit(None).cast("array<int>")
    dealt = postings.select("b", F.lit(1).alias("kind"), "block", "a", "d", "m", F.lit(None).cast("array<long>").alias("n"), lot.alias("lot"), F.pmod(F.xxhash64("block"), F.lit(max(1, salts))).cast("int").alias("salt"))
    copied = counts.select("b", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "a", none.alias("d"), none.alias("m"), "n", lot.alias("lot"), F.explode(F.sequence(F.lit(0), F.lit(max(1, salts) - 1))).alias("salt"))
    streams = dealt.unionByName(copied).repartition(parts(spark), "lot", "salt").sortWithinPartitions("lot", "salt", "b", "kind")
    sums = contributions(streams).select("block", F.explode(F.arrays_zip("d", "best", "total")).alias("x")).groupBy("block", F.col("x.d").alias("place")).agg(F.sum("x.best").alias("n_best"), F.sum("x.total").alias("count_sum"))
    facts = rows.where("b IS NULL").select("block", "place", "doc", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return facts.join(sums, ["block", "place"], "left").select(F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
