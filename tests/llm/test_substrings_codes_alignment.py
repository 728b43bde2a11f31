"""Substring dedup, vector codes and token alignment against brute force, and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, codes, substrings
from millrace.llm.phrases import windows, word_hashes
from tests.llm.test_operators import frame, odd_rows, words_of


def removed(rows, width):
    """Kept words of each (id, text) row, and how many went."""
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def by_id(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("width", [4, 50])
def test_substrings_against_brute_force(spark, width):
    """Passages, near copies with edits near one another, periodic texts, passages that end where others begin."""
    rng = random.Random(width)
    word = lambda: f"w{rng.randrange(60 if width == 4 else 4000)}"
    passages = [[word() for _ in range(rng.choice([width - 1, width, width + 7, 3 * width]))] for _ in range(12)]
    base = [word() for _ in range(6 * width)]
    rows = []
    for i in range(90):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(2 * width))] + (rng.choice(passages) + rng.choice(passages) if rng.random() < 0.3 else rng.choice(passages))
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
        if i % 10 == 0:
            w = ["x", "y", "z"][: 1 + i % 3] * (width * rng.randrange(1, 5)) + w
        rows.append((1000 - i if i % 2 else i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(None, rows[3][1]), (2000, rows[3][1]), (2000, rows[3][1]), (2000, rows[6][1]), (2001, "A" + rows[3][1]), (2002, None), (2003, ""), (2004, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "copy": F.lit(0), "start": F.lit(1), "__hit": F.lit(True)})
    got = substrings.dedup_substrings(docs.repartition(5), width=width)
    assert by_id(got.drop("factors").collect()) == by_id(removed(rows, width))
    for r in got.where("size(factors) > 0").collect():
        assert all(f["source"] < r.doc_id and f["words"] >= width for f in r.factors)


def test_substrings_odd_rows(spark):
    rows = odd_rows()
    got = substrings.dedup_substrings(frame(spark, rows))
    assert by_id(got.drop("factors").collect()) == by_id(removed([(i, t) for i, t, _, _ in rows], 50))
    assert substrings.dedup_substrings(frame(spark, rows).limit(0)).count() == 0
    one, two = (got.where(f"doc_id = {i}").first() for i in (1, 2))
    assert one.n_removed == 0 and two.kept == "" and [tuple(f) for f in two.factors] == [(0, 200, 1)]


def test_long_texts(spark):
    """Texts longer than a run of windows are cut alike; a passage across the cut is found."""
    rng = random.Random(1)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, " ".join(long.split()[131_000:131_200])), (2, "some words before " + long), (3, long)]
    got = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 200, 3: 300_000}


def test_windows_have_their_anchor_by_content():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(200))) for _ in range(30)]
    own = collections.defaultdict(set)
    for w in windows(*word_hashes([t.encode() for t in texts]), 10):
        for t, s, a, h in zip(w.texts.tolist(), w.starts.tolist(), w.anchors.tolist(), w.hashes.tolist()):
            own[tuple(texts[t].split()[s : s + 10])].add((a, h))
    assert sum(map(len, own.values())) == len(own) == len({h for x in own.values() for _, h in x})


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes and books of (id, vector) rows in whole numbers of any size."""
    width = len(rows[0][1]) // parts
    x = [[[int(np.floor(scale * v)) for v in vec[p * width : (p + 1) * width]] for p in range(parts)] for _, vec in sorted(rows, key=lambda r: r[0])]
    books = [[x[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    best = lambda v, book: min(range(len(book)), key=lambda j: (far(v, book[j]), j))
    for _ in range(rounds):
        for p in range(parts):
            own = [best(v[p], books[p]) for v in x]
            for j in range(len(books[p])):
                mine = [v[p] for v, o in zip(x, own) if o == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = {}
    for (i, _), v in zip(sorted(rows, key=lambda r: r[0]), x):
        own = [best(v[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{o:02x}" for o in own), sum(far(v[p], books[p][o]) for p, o in enumerate(own)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "large"])
def test_codes_against_whole_numbers(spark, kind):
    rng = np.random.default_rng(7)
    n = {"few": 5}.get(kind, 120)
    x = rng.normal(size=(n, 16)) * {"large": 5000.0, "spread": 1.0}.get(kind, 0.001)
    if kind == "ties":
        x = rng.integers(-2, 3, (n, 16)) / 4096
    rows = [(int(i), [float(np.float32(v)) for v in vec]) for i, vec in zip(rng.permutation(n), x)]
    want, digest = plain_codes(rows)
    labels = {i: (None if i % 3 == 0 else i % 2) for i, _ in rows}
    totals = collections.Counter()
    for i, (_, e) in want.items():
        totals[labels[i]] += e
    table = spark.createDataFrame([(i, v, labels[i], "x") for i, v in rows], "vec_id long, embedding array<float>, label int, key string")
    got = codes.compress_vectors(table.repartition(3)).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest} and len(got) == n
    assert all(r.label_error == totals[labels[r.vec_id]] for r in got)


def test_codes_odd_vectors(spark, monkeypatch):
    """Rows that hold null or endless components go; short ones are filled up; equal ids and labels of many rows are all there."""
    monkeypatch.setattr("millrace.llm.common.TOGETHER", 3)
    good = [(1, [1.0] * 8, "a"), (2, [0.5] * 8, "a"), (2, [0.25] * 8, None), (None, [2.0] * 8, None), (5, [3.0] * 3, "b"), (6, [], "b"), (7, [0.0] * 8, "a"), (8, [1e300] * 8, "a"), *((i, [0.5] * 8, "a") for i in range(10, 20))]
    bad = [(3, None, "a"), (4, [1.0, None] * 4, "a"), (9, [float("nan")] * 8, "a"), (30, [float("inf")] * 8, None)]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label string").withColumns({"id": F.lit(1), "error": F.lit("x"), "__part": F.lit(1)})
    got = codes.compress_vectors(table).collect()
    assert collections.Counter(r.vec_id for r in got) == collections.Counter(i for i, _, _ in good)
    assert all(re.fullmatch("[0-9a-f]{16}", r.code) and r.label_error == sum(q.error for q in got if q.label == r.label) for r in got)
    assert codes.compress_vectors(table.limit(0)).count() == 0


def test_screening_keeps_the_nearest():
    """Distances that float32 can't tell apart are settled exactly, ties by index."""
    rng = np.random.default_rng(3)
    for size in (5, 1 << 12, 1 << 26):
        entries = rng.integers(-size, size, (40, 9)) // 7 * 7
        entries[20:] = entries[:20] + rng.integers(-1, 2, (20, 9))
        entries[30] = entries[3]
        x = entries[rng.integers(0, 40, 3000)] + rng.integers(-2, 3, (3000, 9))
        far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        best, gap = codes.nearest_entries(x, entries)
        assert (best == far.argmin(axis=1)).all() and (gap == far.min(axis=1)).all()


def aligned(rows):
    """Every contract column by walking over the tokens of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_pair()
    a_side, b_side = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_side.encode_special_tokens = True
    letters = {**{chr(i): i for i in range(256)}, **alignment.byte_characters()}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    counts, every = collections.Counter(), []
    for i, t in rows:
        ids = (a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)) if t else ([], [])
        raw = ([bytes(letters[c] for c in a_side.id_to_token(x)) for x in ids[0]], [piece(b_side.id_to_piece(x)) for x in ids[1]])
        if not t or b"".join(raw[0]) != (" " + t).encode() or b"".join(raw[1]) != (" " + t).encode():
            every.append((i, 0, 0, 0, [], ""))
            continue
        ends = [[sum(map(len, r[: k + 1])) for k in range(len(r))] for r in raw]
        links, groups, k, m = [], [], 0, 0
        while k < len(ids[0]) and m < len(ids[1]):
            links.append((ids[0][k], ids[1][m]))
            e, f = ends[0][k], ends[1][m]
            k, m = k + (e <= f), m + (f <= e)
        x = y = 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, ids[0][x:p])) + "|" + ",".join(map(str, ids[1][y:q])))
            x, y = p, q
        counts.update(links)
        every.append((i, len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(i, a, b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), s) for i, a, b, g, links, s in every]


ODD_TEXTS = [
    " ", "a  b", "  x\n\ny \tz  ", "\n", "tail \n", "tail\n", "x▁y and more words", "<s>a</s><|endoftext|>", " a　b c", "日本語 テスト é\x00\x1c b", "don't 's 'll we've", "\n a", "q\n\nr\ns t",
    "a" * 3000 + " " + "b " * 50, "1234567 89,5 %", "é " * 40 + "é",
]


def test_alignment_against_brute_force(spark, monkeypatch):
    """Small blocks, ids split over tasks, sums flushed early, chunks forgotten."""
    for name, value in (("DOCS", 16), ("RANGES", 3), ("TOGETHER", 2), ("HELD", 2)):
        monkeypatch.setattr(alignment, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([*enumerate(ODD_TEXTS, 90_000), (None, "null id"), (7, "twice"), (7, "twice"), (7, None), (8, "")], "doc_id long, text string")
    every = docs.unionByName(odd)
    rows = [tuple(r) for r in every.collect()]
    found = alignment.align_tokenizers(every.withColumns({"b": F.lit("clash"), "place": F.lit(1), "block": F.lit(2)}).repartition(4))
    assert by_id(found.collect()) == by_id(aligned(rows))
    digests = alignment.align_tokenizers(odd, digest=True).collect()
    assert collections.Counter(r.groups for r in digests) == collections.Counter(hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in aligned([tuple(r) for r in odd.collect()]))
    assert alignment.align_tokenizers(docs.limit(0)).count() == 0


def test_chunks_forgotten_and_met_again():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(500)) for _ in range(20)]
    small, large = alignment.TokenPairs(*alignment.default_pair(), remembered=300_000), alignment.TokenPairs(*alignment.default_pair())
    assert [list(small.align([t])) for t in texts] == [[x] for x in large.align(texts)]
    assert small.held <= 300_000 < large.held


def test_alignment_of_long_texts(spark):
    text = "".join(random.Random(4).choices("abc é\n", k=3_000_000))
    rows = [(1, text), (2, "x" * 1_000_000)]
    got = {r.doc_id: r for r in alignment.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got[1].n_links >= max(got[1].n_a, got[1].n_b) > 0 and got[2].n_links > 0
