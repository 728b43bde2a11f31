"""Repeated rows, null ids, clashing columns and very long texts where the other tests have none, and jumps redone in plain Python."""

import collections
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chat, language, licenses, neighbours, packing, separators, sharding
from millrace.llm.tokens import default_tokenizer
from tests.llm.test_operators import SF, frame, odd_rows


def test_licences_in_repeated_rows(spark):
    model = licenses.train_licenses(licenses.sample_paragraphs(spark.read.parquet(f"{SF}/documents.parquet")))
    text = "First words.\nReleased under the MIT License.\nLast words."
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text, "en", "a"), (None, text, "en", "a"), (2, None, "en", "a")]
    got = collections.Counter((r.doc_id, r.family, r.paragraph, r.confirmed) for r in licenses.scan_licenses(frame(spark, rows).withColumns({"family": F.lit(0), "paragraph": F.lit("x")}), model).collect())
    assert got == {(1, "mit", 1, True): 2, (None, "mit", 1, True): 2}


def test_packing_of_repeated_rows_and_null_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = [*odd_rows(), (None, "one more", "en", "a"), (7, "two words", "fr", "b"), (7, "two words", "fr", "b")]
    got = packing.pack_documents(frame(spark, rows).withColumns({"offset": F.lit("x"), "length": F.lit(0)})).collect()
    want = collections.Counter()
    for i, t, _, _ in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want and sum(r.start == 0 for r in got if r.doc_id == 7) == 3
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_token_counts_of_repeated_rows_and_long_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [*odd_rows(), (None, "", "en", "a"), (7, "two words", "fr", "b"), (50, long, "en", "a")]
    got = collections.Counter((r.doc_id, r.n_tokens) for r in separators.count_document_tokens(frame(spark, rows).withColumns({"stream": F.lit(0), "block": F.lit("x")})).collect())
    assert got == collections.Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows)


def test_language_of_a_long_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'fr' OR lang = 'de'")
    model = language.train_languages(docs)
    french = docs.where("lang = 'fr' AND length(text) > 400").orderBy("doc_id").first().text
    long = spark.createDataFrame([(1, french)], "doc_id long, text string").select("doc_id", F.repeat(F.concat("text", F.lit(" ")), -(-6_000_000 // len(french))).alias("text"))
    one = language.identify(long, model).first()
    assert (one.lang_pred, 0 < one.score <= 1) == ("fr", True)


def test_dialogues_of_long_texts(spark):
    """Words of 3 MB and repeated turns come out whole, in every view."""
    long = "long words " * 270_000
    rows = [("c", 1, "ann", long), ("c", 2, "bob", "short"), ("c", 2, "bob", "short"), (None, 1, None, None), (None, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumns({"perspective": F.lit(1), "words": F.lit("x"), "__at": F.lit(2)})
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(got) == {("c", "ann"), ("c", "bob"), (None, "unknown")}
    ann, bob = got["c", "ann"], got["c", "bob"]
    assert ann.text == f"<|assistant|>\n{long}<|end|>\n" + "<|user:bob|>\nshort<|end|>\n" * 2 and ann.spans[0].length == len(long) + len("<|end|>\n")
    assert bob.n_turns == 3 and len(bob.spans) == 2 and got[None, "unknown"].n_turns == 2


def test_neighbours_among_clashing_columns(spark):
    x = np.random.default_rng(2).standard_normal((40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (5, x[5].tolist())]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = plain.withColumns({"id": F.lit("x"), "vector": F.lit(1), "cells": F.lit(2), "part": F.lit(3), "bound": F.lit("y"), "score": F.lit(0), "query_id": F.lit(9), "rank": F.lit(8)})
    a, b = (sorted(map(tuple, neighbours.search(t, F.col("id") % 10 == 0, k=5).collect())) for t in (plain, clash))
    assert a == b and len(a) == 20
    for q in range(0, 40, 10):
        far = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in enumerate(x) if i != q)[:5]
        assert [i for _, _, i, _ in sorted(r for r in a if r[0] == q)] == [i for _, i in far]


def test_jumps_in_plain_python(spark):
    """The shards of some hundred keys by the loop of the published algorithm, with the same draws."""
    def draw(key, j):
        first = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        return ((xxhash.xxh64(struct.pack("<q", j), seed=first).intdigest() >> 11) + 1) / 2**53

    def shard(key, n):
        b, j = -1, 0
        while j < n:
            b, j = j, int((j + 1) / draw(key, j))
        return b

    keys = [*range(-50, 400), 2**62, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    for n in (1, 2, 8, 9, 1000):
        got = {r.id: r.b for r in df.select("id", sharding.jump(F.col("id"), n)["b"].alias("b")).collect()}
        assert got == {k: shard(k, n) for k in keys}
