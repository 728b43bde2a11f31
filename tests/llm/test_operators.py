"""Every operator against brute force or exact round trips, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import collections
import math
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, jaccard, language, licenses, mixing, neardup, neighbours, packing, queries, separators, sharding
from millrace.llm.cells import unit
from millrace.llm.common import split_join
from millrace.llm.tokens import WordTokenizer, default_tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents with columns more whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS).withColumns({"id": F.lit(-1), "size": F.lit("x"), "__at": F.lit(0)})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows():
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(200))
    near = base.split()
    near[7] = near[90] = "changed"
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (4, None, None, "a"), (5, "", "en", "b"), (6, "two words", "en", "b"), (7, "two words", "fr", "b"),
        (8, " \t\n", None, "a"), (9, "Two WORDS", "en", None), (10, "x " * 30_000, "en", "a"), (11, "é" * 50, "fr", "a"), (2, base, "en", "a"), (None, base, "en", "a"),
    ]


def components(sets, least=80):
    ids = sorted(sets)
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in ids:
        for j in ids:
            m = len(sets[i] & sets[j])
            if i < j and m and 100 * m >= least * (len(sets[i]) + len(sets[j]) - m):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_odd_rows(spark):
    """A row for each row, repeated and null ids too."""
    rows = [*odd_rows(), (None, base_of(odd_rows()), "en", "a"), (None, None, "en", "a"), (14, None, "en", "a"), (14, "Two words", "en", "a")]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_similar(frame(spark, rows)).collect())
    want = [(1, 196, 1), (2, 196, 1), (3, 196, 1), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 1, 6), (10, 1, 10), (11, 1, 11), (2, 196, 1)]
    assert got == collections.Counter([*want, (None, 196, None), (None, 196, None), (None, 0, None), (14, 0, 14), (14, 1, 6)])
    assert jaccard.join_similar(frame(spark, odd_rows()).limit(0)).count() == 0


def base_of(rows):
    return rows[0][1]


def test_jaccard_repeated_ids(spark):
    """Two texts of one id hold what links with either together."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (3, a, "en", "s"), (4, b, "en", "s"), (9, "x", "en", "s")]
    got = {(r.doc_id, r.component_id) for r in jaccard.join_similar(frame(spark, rows)).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_split_join(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 9000, 2).select(F.col("id").alias("k"), F.lit("x").alias("v")).union(spark.createDataFrame([(0, "y")], "k long, v string"))
    want = rows.join(table, "k").select("k", "id", "v").collect()
    assert sorted(split_join(rows, table, "k", "id").select("k", "id", "v").collect()) == sorted(want)


def test_jaccard_families_against_brute_force(spark):
    """Families of copies with many edits, around and below the similarity, and texts that share a passage only."""
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(6):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 150]))]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(9)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(100000)}"
            rows.append((i, " ".join(own), "en", "a"))
            i += 1
        for _ in range(5):
            rows.append((i, " ".join(base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(30)]), "en", "a"))
            i += 1
    want = components({k: shingles(t) for k, t, _, _ in rows})
    got = {r.doc_id: r.component_id for r in jaccard.join_similar(frame(spark, rows)).collect()}
    assert got == want


def test_jaccard_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = components({r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()})
    assert {r.doc_id: r.component_id for r in queries.op5_ngram_jaccard_join(spark, SF).collect()} == want


@pytest.mark.parametrize("partitions, waiting", [(1, 8192), (4, 8192), (2, 20)])
def test_packing_round_trip(spark, partitions, waiting):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = [r for r in odd_rows() if r[0] is not None][:-1]
    rows += [(30, "hello <|endoftext|> world", "en", "a"), (31, "a<|startoftext|>b", "en", "a"), (32, "x <|ENDOFTEXT|> é 漢字", "en", "a"), (33, "w" * 100_000 + " z" * 40_000, "en", "a")]
    docs = frame(spark, rows).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(docs.repartition(partitions), waiting=waiting).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        own = sorted(pieces[doc])
        whole = [x for _, ids, _ in own for x in ids]
        assert whole == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] and own[0][2] == len(whole)
        assert [s for s, _, _ in own] == np.cumsum([0] + [len(ids) for _, ids, _ in own])[:-1].tolist()
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(n for own in places.values() for _, n in own)
    assert tokens / (2048 * len(places)) > (0.97 if waiting > 20 else 0.9)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_closest_fill_is_optimal(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
    used = packing.closest_fill(counts, 64)
    best, longest = {max(counts)}, max(counts)
    rest = [n for n, k in counts.items() for _ in range(k - (n == longest))]
    for n in rest:
        best |= {b + n for b in best if b + n <= 64}
    assert sum(n * k for n, k in used.items()) == max(best) and all(k <= counts[n] for n, k in used.items()) and used[longest] >= 1


@pytest.mark.parametrize("block", [1, 3, 64, 65536])
def test_token_counts_whatever_the_blocks(spark, block):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(frame(spark, [(9001, None, None, "a"), (9002, "", "en", "a")]), allowMissingColumns=True)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.select("doc_id", "text").collect()}
    blocks = separators.token_blocks(docs, 49407, block=block)
    got = {r.doc_id: r.n_tokens for r in separators.count_tokens(blocks, 49407).collect()}
    assert got == want
    assert separators.count_tokens(blocks.limit(0), 49407).count() == 0


def test_token_ids_that_do_not_fit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a few words"), (2, "<|endoftext|>")], "doc_id long, text string")
    with pytest.raises(ValueError):
        separators.token_blocks(docs, 300, dtype="u1")
    with pytest.raises(Exception, match="doesn't fit"):
        separators.token_blocks(docs, 200, dtype="u1").collect()
    assert {r.doc_id for r in separators.count_document_tokens(docs).collect()} == {1, 2}
    (tmp_path / "part-1").write_bytes(b"\x01\x00\x00")
    with pytest.raises(Exception, match="ends in part"):
        separators.read_token_files(spark, str(tmp_path / "part-1"), "<u2").collect()


def test_token_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    separators.write_token_files(separators.token_blocks(docs, 49407, dtype="<u4", block=100), str(tmp_path / "flat"))
    found = separators.count_tokens(separators.read_token_files(spark, str(tmp_path / "flat") + "/part-*", block=64), 49407, "<u4")
    assert sorted(r.n_tokens for r in found.collect()) == sorted(r.n_tokens for r in separators.count_document_tokens(docs).collect())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    told = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(told) > 100 and sum(r.lang == r.lang_pred for r in told) / len(told) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_word_memory():
    """Words forgotten and met again have the same ids."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(500)) for _ in range(40)]
    small, large = WordTokenizer(default_tokenizer(), remembered=200_000), WordTokenizer(default_tokenizer())
    assert [small.encode([t])[0] for t in texts] == large.encode(texts)
    assert small.held <= 200_000 < large.held


def test_language_odd_rows(spark):
    docs = frame(spark, [*odd_rows(), (40, "½", "en", "a"), (41, "² ³", "en", "a"), (42, "Ⅷ", "en", "a"), (43, "½ é", "fr", "a")])
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, language.train_languages(docs)).collect()}
    assert {i for i, lang, score in got if lang == "und"} == {4, 5, 8, 40, 41, 42} and all(score == 0 for _, lang, score in got if lang == "und")
    assert language.train_languages(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


ODD_TEXTS = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "qxz vkjw bdfg " + " ".join("".join(random.Random(k).choices("bcdfghjklmnpqrstvwxz", k=6)) for k in range(40)),
    "9vKq2ZtXw7RbYp0LsHnE4mJcUgDf8aQiTzWx5oVkBy3hGrNlSe6MdPuCjF1AtIqZ7vXwKyRb2LpHn0EsJm4cUgTf8DaQ",
]


@pytest.mark.parametrize("langs", [["en"], ["de", "en", "fr"], ["de", "en", "es", "fr"]])
def test_language_stage_rejects_the_unlike(spark, langs):
    """Whatever the number of labels: unlearned languages and gibberish go, learned ones and short clean texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isin(langs))
    docs = docs.where("text <> ''")
    fold = language.in_fold(F.col("doc_id"))
    short = docs.where(fold).select((F.col("doc_id") + 10_000).alias("doc_id"), F.regexp_extract("text", r"^\S+(\s+\S+){0,5}", 0).alias("text")).where("rlike(text, '[a-z]{2}')")
    new = docs.where(fold).select((F.col("doc_id") + 20_000).alias("doc_id"), "text")
    odd = spark.createDataFrame(list(enumerate(ODD_TEXTS, 30_000)), "doc_id long, text string")
    every = docs.where(~fold).unionByName(short, True).unionByName(new, True).unionByName(odd, True)
    kept = collections.Counter(r.doc_id // 10_000 for r in corpus_pipeline.language_stage(spark, every, SF).select("doc_id").collect())
    assert kept[3] == 0
    assert kept[0] >= 0.95 * docs.where(~fold).count() and kept[1] >= 0.9 * short.count() and kept[2] >= 0.9 * new.count()


def test_licences(spark, licence_model):
    docs, model = spark.read.parquet(f"{SF}/documents.parquet"), licence_model
    planted = frame(spark, [(i, "Some words here.\n" + t + "\nand more.", "en", "a") for i, t in enumerate(own[0] for own in licenses.TEMPLATES.values())] + [(900, None, None, "a"), (901, "\n\n", "en", "a")])
    got = {r.doc_id: r for r in licenses.scan_licenses(planted, model).collect() if r.confirmed}
    for i, family in enumerate(licenses.TEMPLATES):
        assert got[i].family == family and got[i].paragraph == 1 and got[i].start == 17
    assert not set(got) & {900, 901}
    assert licenses.scan_licenses(planted.limit(0), model).count() == 0
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in licenses.scan_licenses(docs, model).collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == texts[r.doc_id].split("\n")[r.paragraph]


# Notices of licences that are not among the templates.
UNSEEN = [
    "Licensed under the European Union Public Licence, Version 1.2 or later.", "Distributed under the Boost Software License, Version 1.0.", "This file is licensed under the Artistic License 2.0; see the file LICENSE for details.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Released under the Open Software License version 3.0.", "This work is licensed under the terms of the CeCILL license, version 2.1.",
]


def test_unknown_licences(spark, licence_model):
    """Notices of other licences are found and unknown; sentences that only use their words are no find; paragraphs of whole licences are confirmed."""
    plain = ["He walked under the bridge, and the version of events he told was free of charge.", "The library is open to the public on every work day.", "All copies of the map show the above road, but none of the notice boards."]
    whole = "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(i, t, "en", "a") for i, t in enumerate([*UNSEEN, *plain, whole])]
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(frame(spark, rows), licence_model).collect():
        got[r.doc_id].append((r.family, r.confirmed))
    assert sum(got[i] == [("unknown", False)] for i in range(len(UNSEEN))) >= len(UNSEEN) - 1
    assert not any(got[len(UNSEEN) + i] for i in range(len(plain))) and got[len(rows) - 1] == [("mit", True)] * 2


def test_short_licences(spark, licence_model):
    """An unseen licence in the words of a known one is unknown, not that one; short forms of known ones are theirs."""
    ids = ["Zlib", "EUPL-1.2", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "OSL-3.0", "EPL-2.0", "BSL-1.0", "Artistic-2.0", "WTFPL", "NCSA", "CDDL-1.0", "PostgreSQL"]
    others = [f"SPDX-License-Identifier: {i}" for i in ids] + ["Licensed under the EUPL License, Version 2.0.", "Licensed under CC BY-ND 4.0.", "Released under the Zlib License."]
    known = {"This project is MIT licensed.": "mit", "license: MIT": "mit", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: BSD-2-Clause": "bsd", "License: Apache-2.0": "apache", "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl"}
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(frame(spark, [(i, t, "en", "a") for i, t in enumerate([*others, *known])]), licence_model).collect():
        got[r.doc_id].add((r.family, r.confirmed))
    for i, t in enumerate(others):
        assert got[i] <= {("unknown", False)}, t
    assert sum(got[i] == {("unknown", False)} for i in range(len(ids))) >= 10
    for i, (t, family) in enumerate(known.items(), len(others)):
        assert got[i] == {(family, True)}, t


def test_calibration(spark, licence_model):
    """Of windows judged with about the same probability, about that share holds a licence: variants of notices against lines held out."""
    rng = random.Random(1)
    lines = licenses.sample_paragraphs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(language.in_fold(F.col("doc_id"))), sample=600)
    known = [licenses.pairs(t) for own in licenses.TEMPLATES.values() for t in own]
    lines = [" ".join(t.split()[:30]) for t in lines if not any(len(licenses.pairs(t) & k) >= 0.3 * len(k) for k in known)]
    notices = [[w for w in t.split() if rng.random() > 0.15] for own in licenses.TEMPLATES.values() for t in own for _ in range(4)]
    words = licenses.hash_words([*lines, *map(" ".join, notices)], licenses.MARKS)
    some = np.flatnonzero(words.counts)
    _, chance = licence_model.judge(words.hashes, (np.cumsum(words.counts) - words.counts)[some], words.counts[some])
    true, error = some >= len(lines), 0.0
    for low in np.arange(0, 1, 0.1):
        here = (chance >= low) & ((chance < low + 0.1) | (low > 0.85))
        error += abs(chance[here].sum() - true[here].sum())
    assert error / len(some) < 0.05
    assert ((chance >= licence_model.least) & ~true).sum() <= 0.01 * len(lines) and ((chance >= licence_model.least) & true).sum() >= 0.95 * len(notices)


def test_very_long_texts(spark, licence_model):
    """Texts of 11 MB of many words, and of 50 MB in one word."""
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_250_000)), lambda i: F.concat(F.lit("w"), (i % 800_000 + 1_000_000).cast("string"))), " ")
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("MIT\n"), long, F.lit(" Released under the MIT License.")).alias("text"))
    docs = docs.union(docs.select(F.lit(2).cast("long"), "text")).union(spark.range(1).select(F.lit(3).cast("long"), F.repeat(F.lit("x"), 50_000_000)))
    got = {r.doc_id: r for r in jaccard.join_similar(docs).collect()}
    assert got[1].n_shingles == got[2].n_shingles > 800_000 and (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3) and got[3].n_shingles == 1
    finds = licenses.scan_licenses(docs.where("doc_id <> 2"), licence_model).collect()
    assert [(r.doc_id, r.family, r.paragraph) for r in finds if r.confirmed] == [(1, "mit", 1)]


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.train_licenses(licenses.sample_paragraphs(spark.read.parquet(f"{SF}/documents.parquet")))


def test_wrapped_licences(spark, licence_model):
    """Notices of every family wrapped at 25 to 70 characters, as a paragraph of their own and inside a longer one."""
    plain, rows, want = "Nothing that matters is said on this line.", [], {}
    for family, own in licenses.TEMPLATES.items():
        for template in own:
            for width in (25, 45, 70):
                for around in ("\n\n", "\n"):
                    text = plain + around + "\n".join(textwrap.wrap(template, width)) + around + plain
                    want[len(rows)] = family
                    rows.append((len(rows), text, "en", "a"))
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(frame(spark, rows), licence_model).collect():
        if r.confirmed:
            got[r.doc_id].add(r.family)
            text = rows[r.doc_id][1]
            assert text[: r.start].count("\n") == r.paragraph and 0 < r.length <= len(text) - r.start
    assert [i for i in want if got[i] != {want[i]}] == []


def test_licences_in_long_lines(spark, licence_model):
    """A notice anywhere in a line of 20 to 400 other words is found."""
    rng = random.Random(8)
    spare = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(40).collect() for w in r.text.split()[:50]]
    rows, want = [], {}
    for family, own in licenses.TEMPLATES.items():
        for template in own:
            for n in (20, 80, 400):
                around = [rng.choice(spare) for _ in range(n)]
                at = rng.randint(0, n)
                want[len(rows)] = family
                rows.append((len(rows), " ".join([*around[:at], template, *around[at:]]), "en", "a"))
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(frame(spark, rows), licence_model).collect():
        if r.confirmed:
            got[r.doc_id].add(r.family)
            assert (r.paragraph, r.start, r.length) == (0, 0, len(rows[r.doc_id][1]))
    assert sum(got[i] == {want[i]} for i in want) >= 0.97 * len(want)


def test_chat_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op6_chat_formatting"]).fetchall()
    got = queries.op6_chat_formatting(spark, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and got


def test_chat_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, None, "who"), (2, 0, "system", "x"), (None, 0, "ann", "n")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(turns.withColumn("words", F.lit(1))).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = got[1, "ann"]
    assert ann.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user:bob|>\n<|end|>\n<|user:unknown|>\nwho<|end|>\n"
    assert [ann.text[s.start : s.start + s.length] for s in ann.spans] == ["hi < |end|><|end|>\n"]
    posing = chat.rotate_perspectives(spark.createDataFrame([(1, 0, "a|>b<|", "x"), (1, 1, "c", "y")], turns.schema)).where("perspective = 'c'").first()
    assert posing.text == "<|user:a| >b< ||>\nx<|end|>\n<|assistant|>\ny<|end|>\n"
    pieces = chat.rotate_perspectives(turns, piece=2).where("conv_id = 1 AND perspective = 'ann'").orderBy("piece").collect()
    assert "".join(p.text for p in pieces) == ann.text
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:15] + 0.1 * rng.standard_normal((15, 16)), base[:3] * 2.0]))]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] + [0.0] * 14), (1004, [1.0]), (1005, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "w": F.lit(2)}), rows


def test_near_duplicate_vectors(spark):
    df, rows = vectors(spark)
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 1000 or i == 1005}
    links = {i: [j for j in good if j != i and good[i] @ good[j] >= 0.9] for i in good}
    top = {i: i for i in good}
    for _ in range(10):
        for i in good:
            top[i] = min([top[i], *(top[j] for j in links[i])])
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        n, component = (len(links[i]), top[i]) if i in good else (0, i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, component, i == component)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicate_odd_vectors(spark):
    """Other lengths link among themselves, null ids with nothing, repeated ids are one node, any finite size has a direction."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.05, 0.0]), (5, [1e300, 1e299]), (6, [1e-300, 0.0]), (None, [1.0, 0.0]), (None, None), (7, [0.0, 1.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [])]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 4, 1, False), (6, 4, 1, False), (None, 0, None, True), (None, 0, None, True), (7, 1, 1, False), (7, 4, 1, False), (8, 1, 1, False), (9, 0, 9, True)]
    assert got == sorted(want, key=str)


def test_near_duplicate_blocks(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(hot_vectors(600))], "vec_id long, embedding array<double>")
    a = neardup.near_duplicates(df, block=40).collect()
    assert sorted(a) == sorted(neardup.near_duplicates(df).collect()) and sum(r.n_links for r in a) > 30_000


def hot_vectors(n):
    """Directions of which a third are near copies of one (mean cosine 0.93) and a tenth are near copies, at cosines of 0.9 to 0.95, of another tenth."""
    rng = np.random.default_rng(4)
    some = lambda k: unit(rng.standard_normal((k, 64)))
    x, hot, more = some(n), n // 3, n // 10
    x[:hot] = x[0] + np.sqrt(0.07 / 0.93) * some(hot)
    base, cosine = x[hot + more : hot + 2 * more], rng.uniform(0.9, 0.95, (more, 1))
    away = some(more)
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    x[hot : hot + more] = cosine * base + np.sqrt(1 - cosine**2) * away
    return unit(x)


def test_near_duplicate_recall(spark):
    """12000 vectors in some hundred cells on two levels: the links of a dense third, and those planted at cosines of 0.9 to 0.95."""
    x = hot_vectors(12_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    groups = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, w long, vector array<double>")
    assert neardup.placed_in_cells(groups, len(x), 0.9, 60).select(F.explode("cells")).distinct().count() > 100
    got = np.array([r.n_links for r in neardup.near_duplicates(df, per_cell=60).orderBy("vec_id").collect()])
    want = np.concatenate([(x[at : at + 1000] @ x.T >= 0.9).sum(axis=1) - 1 for at in range(0, len(x), 1000)])
    assert (got <= want).all()
    assert got.sum() >= 0.99 * want.sum() and got[4000:6400].sum() >= 0.98 * want[4000:6400].sum() > 2000


def test_vectors_with_a_common_direction(spark):
    """Vectors of a mean cosine of 0.6, of which hardly any link, stay in many cells, and planted pairs are found."""
    rng = np.random.default_rng(8)
    n, more = 12_000, 600
    x = unit(math.sqrt(0.6) * np.eye(64)[0] + math.sqrt(0.4) * unit(rng.standard_normal((n, 64))))
    away = rng.standard_normal((more, 64))
    away = unit(away - (away * x[:more]).sum(axis=1, keepdims=True) * x[:more])
    cosine = rng.uniform(0.905, 0.95, (more, 1))
    x = np.concatenate([x, cosine * x[:more] + np.sqrt(1 - cosine**2) * away])
    groups = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, w long, vector array<double>")
    assert neardup.placed_in_cells(groups, len(x), 0.9, 200).select(F.explode("cells")).distinct().count() > 20
    df = groups.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df, per_cell=200).collect()}
    assert sum(got[n + i] > 0 for i in range(more)) >= 0.98 * more


@pytest.mark.parametrize("n", [500, 12_000])
def test_nearest_neighbours(spark, n):
    """Directions without any clusters, the worst there are, against brute force."""
    x = np.random.default_rng(6).standard_normal((n, 64)).astype(np.float32).astype(float)
    x[7] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0][0] == (7, 0.0)
    hits = 0
    for q in range(0, n, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((v, i) for i, v in enumerate(d.tolist()) if i != q)[:10]
        hits += len({i for _, i in best} & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and all(abs(d[i] - s) < 1e-9 for i, s in got[q]) and [(s, i) for i, s in got[q]] == sorted((s, i) for i, s in got[q])
    assert hits >= 0.93 * n / 10  # all of it by lists: without any there is nothing
    if n == 500:
        assert neighbours.search(df, F.col("id") % 100 == 0, probes=0).count() == 0


def test_nearest_neighbours_odd_vectors(spark):
    df, _ = vectors(spark)
    assert {r.query_id for r in neighbours.search(df, F.col("id") % 2 == 0).collect()} == {*range(0, 58, 2)}
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1.5e200, 0.0]), (4, [1.0]), (5, [3.0]), (5, [2.0]), (6, [1e-200, 1e-200]), (None, [1.0]), (7, [1e200, 0.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=2).collect()}
    assert got[1, 1] == (7, 0.0) and got[1, 2] == (3, 5e199) and got[2, 1] == (3, 5e199) and got[6, 1] == (1, 1e200) and got[6, 2] == (7, 1e200)
    assert got[4, 1] == (5, 1.0) and (4, 2) not in got and got[5, 1] == (4, 1.0)


def test_scan_gives_up_no_neighbour():
    """Of pairs within the bound hardly any are given up; of those far beyond it nearly all, before their last dimensions."""
    rng = np.random.default_rng(3)
    turn = neighbours.rotation(64)
    q, x = rng.standard_normal((50, 64)), rng.standard_normal((2000, 64))
    far = np.sqrt(((q[:, None] - x) ** 2).sum(axis=2))
    bounds = np.sort(far, axis=1)[:, 20]
    a, b = neighbours.scan_list(q @ turn, x @ turn, bounds)
    kept = np.zeros(far.shape, bool)
    kept[a, b] = True
    near = far <= bounds[:, None]
    assert (kept & near).sum() >= 0.98 * near.sum() and not (kept & (far > 1.001 * bounds[:, None])).any()


def test_mixing(spark):
    rows = queries.op9_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(rows) == sorted(queries.op9_mixing(spark, "/root/testdata/sf0.01").collect())
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == len(words_of(docs[r.doc_id].text)) and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        size[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights, full, goal = dict(zip(order, [5, 2, 1] * len(order))), set(), 1.5 * sum(size.values())
    while True:
        level = (goal - sum(2 * size[s] for s in full)) / sum(weights[s] for s in order if s not in full) if len(full) < len(order) else 0
        more = {s for s in order if s not in full and weights[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in order:
        assert abs(target[s] - (2 * size[s] if s in full else weights[s] * level)) < 1e-6 * goal
        assert abs(taken[s] - target[s]) <= max(docs_size for docs_size in [r.size for r in rows if docs[r.doc_id].source == s]) + 1


def test_mixing_draws(spark):
    """Levels, certain copies, Pareto order and quota against a plain version; inclusion rates near the wanted ones."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 3, 9, 30, 90]), "en", rng.choice(["a", "b", "b", None])) for i in range(4000)]
    docs = mixing.by_length(frame(spark, rows))
    plan = mixing.mix_documents(docs, importance_col="__importance").collect()
    mean = collections.defaultdict(list)
    for source in ("a", "b", None):
        own = [r for r in plan if r.source == source]
        importance = {r.doc_id: math.floor(math.log2(r.size + 1)) + 1 for r in own}
        low, high = 0.0, 100.0
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(r.size * min(2, level * importance[r.doc_id]) for r in own) < own[0].target else (low, level)
        want = {r.doc_id: min(2, level * importance[r.doc_id]) for r in own}
        assert all(abs(r.sure + r.p - want[r.doc_id]) < 1e-6 for r in own)
        assert all(r.p == 0 or abs(r.odds - u / (1 - u) / (r.p / (1 - r.p))) <= 1e-9 * r.odds for r in own for u in [(((r.draw % 2**64) >> 11) + 0.5) / 2**53])
        quota, so_far, drawn = sum(r.p * r.size for r in own), 0, set()
        for r in sorted(own, key=lambda r: (r.odds, r.doc_id)):
            if r.p > 0 and so_far + r.size / 2 <= quota:
                drawn.add(r.doc_id)
            so_far += r.size
        assert drawn == {r.doc_id for r in own if r.drawn}
        for r in own:
            mean[source, r.size].append((r.copies, want[r.doc_id]))
    assert len({w for own in mean.values() for _, w in own if w % 1}) > 3
    for own in mean.values():
        expected, n = own[0][1], len(own)
        p = expected % 1
        assert abs(sum(c for c, _ in own) / n - expected) <= 4 * math.sqrt(p * (1 - p) / n) + 2 / n


def test_mixing_many_sources(spark, monkeypatch):
    """The way for more sources than are broadcast."""
    docs = mixing.by_length(frame(spark, odd_rows()))
    want = sorted(mixing.mixed(docs, importance_col="__importance").collect(), key=str)
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(mixing.mixed(docs, importance_col="__importance").collect(), key=str) == want


def test_mixing_odd_rows(spark):
    docs = frame(spark, odd_rows())
    assert mixing.mix_documents(docs).count() == len(odd_rows())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0
    plan = sum(r.copies for r in mixing.mix_documents(docs).collect())
    assert out.count() == plan
    empty = frame(spark, [(1, "a b c", "en", "full"), (2, "", "en", "empty"), (3, None, "en", "empty")])
    assert sorted(r.doc_id for r in mixing.mixed(empty).where("source = 'empty'").collect()) == [2, 3]  # once each, as no level makes words of them


def test_sharding(spark):
    docs = frame(spark, odd_rows()).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    eight, nine = (sorted(sharding.shard_documents(docs, n).collect(), key=str) for n in (8, 9))
    grown = {r.doc_id: r.grown_shard for r in eight}
    assert grown == {r.doc_id: r.shard for r in nine} and len(eight) == docs.count()
    assert all(r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 for r in eight)
    slots = collections.defaultdict(list)
    for r in eight:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(texts[r.doc_id].encode())) for r in eight)
    assert sharding.shard_documents(docs.limit(0), 8).count() == 0
    moved = spark.range(40_000).select(sharding.jump(F.col("id"), 20)["b"].alias("a"), sharding.jump(F.col("id"), 21)["b"].alias("b")).where("a <> b")
    assert moved.where("b <> 20").count() == 0 and 1500 < moved.count() < 2350


def test_pipeline_odd_rows(spark):
    """Null, empty, very long, repeated rows, clashing columns and empty tables go through every stage."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("the of a house river under walks slowly green old and".split()) for _ in range(n))
    rows = [(i, prose(60), "en", rng.choice(["a", "b", None])) for i in range(60)] + [(100, prose(40_000), "en", "a"), (None, prose(50), "en", None), (102, None, None, None), (103, "", "en", "a"), (104, "½", "en", "a")]
    rows += [rows[0], rows[0], (105, rows[1][1], "en", "b")]
    docs = frame(spark, rows)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
        sizes.append({r[0] for r in out.select("doc_id").distinct().collect()})
    assert sizes[0] == {*range(60), 100, None, 105} and sizes[1] == {*range(60), 100, None} and sizes[3] <= sizes[2] <= sizes[1]


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept.append((name, docs, out))
        docs = out
    (_, whole, told), (_, _, single), (_, _, mix), (_, _, packed) = kept
    assert told.columns == whole.columns == single.columns == mix.columns
    assert told.where("text IS NULL").count() == 0 and told.count() >= 0.9 * whole.where("trim(text) <> ''").count()
    want = components({r.doc_id: shingles(r.text) for r in told.select("doc_id", "text").collect()})
    assert {r.doc_id for r in single.select("doc_id").collect()} == {i for i, c in want.items() if i == c}
    sizes = {r.doc_id: r.copies for r in mixing.mix_documents(mixing.by_length(single), importance_col="__importance").collect()}
    copies = collections.Counter(r.doc_id for r in mix.select("doc_id").collect())
    assert copies == collections.Counter({k: v for k, v in sizes.items() if v})
    assert packed.where("start = 0").count() == mix.count()
