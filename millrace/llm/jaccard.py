"""Jaccard similarity join on word shingles by adaptive multi-match prefixes.

Three facts carry the join. A pair with Jaccard similarity s shares at least s times the larger set, so a document of
which less than s of the shingles occur in any other document links with nothing. In one order of all shingles, rare ones
first, two linked documents share at least l of the first n - ceil(s * n) + l of each, and more if their sizes ask for a
larger intersection than that. And classes need no more links than hold them together, so pairs that are already
connected needn't be looked at.

1. Shingle hashes of all documents, in sorted blocks, are dealt to hash ranges; each range counts in how many documents a
   hash occurs, and each document gets back how many of its shingles are shared.
2. Documents with the same set become one. Those with enough shared shingles are read again for their sets.
3. Exact frequencies of these order each set. Every document picks the l that costs least (``prefix``).
4. Each posting list proposes one pivot against its other members. Where a list still spans several components,
   its entries are joined as far as their positions allow: the first shingle that two sets share leaves each as many
   more as the intersection still needs. Only pairs with l matches in their prefixes, whichever way they were proposed,
   are verified on whole sets.

Joins split the keys that have many rows (``split_join``): lists of common shingles, pivots of many pairs, equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import FILTER_BITS, components, cut, filter_maps, filter_place, heavy_keys, parts, short_batches, split_join
from millrace.llm.hashing import mix, shingle_sets
from millrace.llm.tokens import batches

#: Longest prefix extension considered, and work of verifying a pair per shingle against that of one list entry.
MOST_MATCHES, VERIFY = 8, 0.05
SIGN = np.uint64(0x9E3779B97F4A7C15)


def planes(x: np.ndarray) -> bytes:
    """Sorted values as differences, byte by byte: high bytes are runs of zeros, which shuffle compression removes."""
    d = np.diff(x, prepend=np.zeros(1, x.dtype))
    return d.view(np.uint8).reshape(len(d), x.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, dtype: type = np.uint64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    d = np.frombuffer(b, np.uint8).reshape(size, -1).T
    return np.cumsum(np.ascontiguousarray(d).view(dtype).ravel(), dtype=dtype)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, equal for equal sets."""
    one = [mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0) for s in sets]
    two = [mix(s ^ SIGN).sum(dtype=np.uint64) if len(s) else np.uint64(0) for s in sets]
    return np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


DEALT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("single", pa.binary()), ("owner", pa.binary()), ("several", pa.binary()), ("head", pa.binary())])
BACK = pa.schema([("block", pa.int64()), ("counts", pa.binary()), ("head", pa.binary())])
COUNTED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])


def shared_counts(docs: DataFrame, ranges: int, bits: int, words: int) -> DataFrame:
    """(id, n, shared, f1, f2) of each row (id, text): set size, at least how many of its shingles occur in other rows, fingerprints.

    Blocks send a row to each range in which they have a hash, so there are never more rows than shingles. ``shared`` is counted on the first ``bits`` bits of hashes, so it may be too large by chance, never too small. A hash
    that a block holds more than once is sent once, without owners: a shingle of any frequency is few rows to its range.
    """
    most = 256 if ranges <= 512 else 4096
    kind = np.uint8 if most == 256 else np.uint16

    def deal(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        edges = np.array([-(-(r << bits) // ranges) for r in range(1, ranges)], np.uint64)

        def block(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            key = task | number
            sizes = np.array([len(s) for s in sets], np.int64)
            hashes = (np.concatenate(sets) if sets else np.empty(0, np.uint64)) >> np.uint64(64 - bits)
            order = hashes.argsort(kind="stable")
            hashes, owner = hashes[order], np.repeat(np.arange(len(sets)), sizes)[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(hashes)))
            local = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sets))
            one, two = fingerprints(sets)
            known = np.array([i is not None for i in ids])
            head = b"".join(x.astype(np.int64).tobytes() for x in (np.array([i or 0 for i in ids]), known, sizes, local, one, two))
            single, several = first[times == 1], first[times > 1]
            a, b = hashes[single], hashes[several]
            x, y = [0, *np.searchsorted(a, edges).tolist(), len(a)], [0, *np.searchsorted(b, edges).tolist(), len(b)]
            who = owner[single].astype(kind)
            rows = [(r, key, planes(a[x[r] : x[r + 1]]), who[x[r] : x[r + 1]].tobytes(), planes(b[y[r] : y[r + 1]]), None) for r in range(ranges) if x[r] < x[r + 1] or y[r] < y[r + 1]]
            return batch(DEALT, [*rows, (key % ranges, key, None, None, None, head)])

        ids: list = []
        sets: list[np.ndarray] = []
        held = 0
        for table in tables:
            keys = table.column(0).to_pylist()
            for at, some in batches(table.column(1)):
                for i, s in zip(keys[at : at + len(some)], shingle_sets(some, words)):
                    ids.append(i)
                    sets.append(s)
                    held += len(s)
                    if len(ids) == most or held > 8192 * most:
                        yield block(ids, sets)
                        ids, sets, held, number = [], [], 0, number + 1
        if ids:
            yield block(ids, sets)

    def count(table: pa.Table) -> pa.Table:
        keys, singles, owners, several, heads = (table.column(c).to_pylist() for c in ("block", "single", "owner", "several", "head"))
        out = [(k, None, h) for k, h in zip(keys, heads) if h is not None]
        own = [i for i, h in enumerate(heads) if h is None]
        if own:
            parts_ = [unplanes(singles[i]) for i in own]
            rest = [unplanes(several[i]) for i in own]
            sizes = np.array([len(p) for p in parts_])
            every = np.concatenate([*parts_, *rest])
            weight = np.concatenate([np.ones(sizes.sum(), np.int64), np.full(len(every) - sizes.sum(), 2, np.int64)])
            order = every.argsort(kind="stable")
            s = every[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total = np.add.reduceat(weight[order], first)
            flag = np.empty(len(every), bool)
            flag[order] = np.repeat(total > 1, np.diff(np.append(first, len(s))))
            at = 0
            for i, n in zip(own, sizes.tolist()):
                counts = np.bincount(np.frombuffer(owners[i], kind)[flag[at : at + n]], minlength=1).astype("<u4")
                out.append((keys[i], counts.tobytes(), None))
                at += n
        return pa.Table.from_batches([batch(BACK, out)])

    def gather(table: pa.Table) -> pa.Table:
        head = next(h for h in table.column("head").to_pylist() if h is not None)
        ids, known, n, shared, one, two = np.frombuffer(head, np.int64).reshape(6, -1)
        shared = shared.copy()
        for counts in table.column("counts").to_pylist():
            if counts is not None:
                c = np.frombuffer(counts, "<u4")
                shared[: len(c)] += c
        return pa.table([pa.array(ids, mask=known == 0), n, shared, one, two], schema=COUNTED)

    dealt = docs.mapInArrow(deal, "part int, block long, single binary, owner binary, several binary, head binary")
    back = dealt.groupBy("part").applyInArrow(count, "block long, counts binary, head binary")
    return back.groupBy("block").applyInArrow(gather, "id long, n long, shared long, f1 long, f2 long")


def read_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(id, n, tokens) of the documents (id, f1, f2) in ``chosen``.

    A bit map of hashed ids, of fixed size, keeps most other texts from being hashed; what it lets through is joined.
    """
    place = filter_place(F.col("id"))
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in filter_maps(chosen).collect():
        table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for t in tables:
            p = t.column(2).to_numpy()
            some = np.flatnonzero(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            if len(some):
                own = t.take(pa.array(some))
                keys = own.column(0)
                for at, part in batches(own.column(1)):
                    sets = shingle_sets(part, words)
                    one, two = fingerprints(sets)
                    sizes = np.array([len(s) for s in sets], np.int64)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), pa.array(one), pa.array(two), pa.array(sizes), tokens], schema=schema)

    found = docs.where("id IS NOT NULL").select("id", "text", place.alias("p")).mapInArrow(run, "id long, f1 long, f2 long, n long, tokens array<long>")
    return found.join(chosen.select("id", "f1", "f2"), ["id", "f1", "f2"], "left_semi").dropDuplicates(["id", "f1", "f2"]).select("id", "n", "tokens")


def prefix(frequencies: np.ndarray, n: int, least: int) -> tuple[int, int]:
    """(l, length): how many matches to require of a set with these ascending ``frequencies``, and the prefix for it.

    Each list in the prefix costs its other entries; of these matches at most a l-th are candidates, and verifying one
    costs in proportion to n. The l with the smallest sum wins.
    """
    need = -(-least * n // 100)
    best, cost = 1, np.inf
    others = np.cumsum(frequencies - 1)
    for matches in range(1, min(MOST_MATCHES, need) + 1):
        entries = others[n - need + matches - 1]
        here = entries + entries / matches * VERIFY * n
        if here < cost:
            best, cost = matches, here
    return best, n - need + best


LISTS = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("l", pa.int32()), ("s", pa.int64()), ("middle", pa.float64()), ("at", pa.int64())])


def postings(sets: DataFrame, ranges: int, least: int) -> DataFrame:
    """(token, id, n, l, s, middle, at) of the prefixes of ``sets`` (id, n, tokens; checkpointed, as its blocks are formed twice).

    ``s`` is how many of a set's shingles occur in another, ``middle`` is the mean frequency of a set's shingles: the text
    that others were copied from has the largest of its kind. ``at`` is the token's position in the set's order.
    """

    def blocks(tables: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
        task, number, ids, sets_, held = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for t in tables:
            lists = t.column(2)
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for k, i in enumerate(t.column(0).to_pylist()):
                ids.append(i)
                sets_.append(flat[offsets[k] : offsets[k + 1]].view(np.uint64))
                held += len(sets_[-1])
                if len(ids) == 2048 or held > 400_000:
                    yield task | number, ids, sets_
                    ids, sets_, held, number = [], [], 0, number + 1
        if ids:
            yield task | number, ids, sets_

    sent = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary())])
    came = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("times", pa.binary())])
    whole = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])

    def deal(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([-(-(r << 64) // ranges) for r in range(1, ranges)], np.uint64)
        for key, _, own in blocks(tables):
            u, times = np.unique(np.concatenate(own), return_counts=True)
            x = [0, *np.searchsorted(u, edges).tolist(), len(u)]
            times = times.astype("<u4")
            yield batch(sent, [(r, key, planes(u[x[r] : x[r + 1]]), times[x[r] : x[r + 1]].tobytes()) for r in range(ranges) if x[r] < x[r + 1]])

    def count(table: pa.Table) -> pa.Table:
        own = [unplanes(h) for h in table.column("hashes").to_pylist()]
        u, inverse = np.unique(np.concatenate(own), return_inverse=True)
        times = np.concatenate([np.frombuffer(t, "<u4") for t in table.column("times").to_pylist()])
        total = np.bincount(inverse, weights=times).astype("<u4")[inverse]
        cuts = np.cumsum([0] + [len(o) for o in own])
        return pa.Table.from_batches([batch(came, [(p, b, total[c:d].tobytes()) for p, b, c, d in zip(table.column("part").to_pylist(), table.column("block").to_pylist(), cuts, cuts[1:])])])

    def bundle(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, own in blocks(tables):
            yield batch(whole, [(key, np.array(ids, np.int64).tobytes(), np.array([len(s) for s in own], np.int64).tobytes(), np.concatenate(own).tobytes())])

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            ids, sizes = (np.frombuffer(left.column(c)[0].as_py(), np.int64) for c in ("ids", "sizes"))
            tokens = np.frombuffer(left.column("tokens")[0].as_py(), np.uint64)
            u, inverse = np.unique(tokens, return_inverse=True)
            back = sorted(zip(right.column("part").to_pylist(), right.column("times").to_pylist()))
            times = np.concatenate([np.frombuffer(t, "<u4") for _, t in back]).astype(np.int64)[inverse]
            cuts = np.cumsum(np.concatenate([[0], sizes]))
            for i, c, d in zip(ids.tolist(), cuts, cuts[1:]):
                own, often, n = tokens[c:d], times[c:d], int(d - c)
                common = int((often > 1).sum())
                if 100 * common < least * n:
                    continue
                by = np.lexsort((own, often))
                l, length = prefix(often[by], n, least)
                at = np.flatnonzero(often[by[:length]] > 1)
                by = by[at]
                out.append(pa.RecordBatch.from_arrays([pa.array(own[by].view(np.int64)), pa.array(np.full(len(by), i)), pa.array(np.full(len(by), n)), pa.array(np.full(len(by), l, np.int32)), pa.array(np.full(len(by), common)), pa.array(np.full(len(by), often.mean())), pa.array(at)], schema=LISTS))
        return pa.Table.from_batches(out, schema=LISTS)

    dealt = sets.mapInArrow(deal, "part int, block long, hashes binary, times binary")
    back = dealt.groupBy("part").applyInArrow(count, "part int, block long, times binary")
    bundles = sets.mapInArrow(bundle, "block long, ids binary, sizes binary, tokens binary")
    return bundles.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(order, "token long, id long, n long, l int, s long, middle double, at long")


def attached(pairs: DataFrame, table: DataFrame, names: list[str], heavy: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns ``names`` of both in ``table`` (id, ...), ending in a and b; ``heavy`` are sets of many pairs."""
    first = split_join(pairs, table.select(*[F.col(x).alias(f"{x}b") for x in names], F.col("id").alias("b")), "b", "a", heavy)
    return split_join(first, table.select(*[F.col(x).alias(f"{x}a") for x in names], F.col("id").alias("a")), "a", "b", heavy)


def matching(pairs: DataFrame, prefixes: DataFrame, least: int, heavy: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes (id, n, l, t) share as many tokens as they were lengthened for."""
    both = attached(pairs, prefixes, ["n", "l", "t"], heavy).withColumn("l", F.least("la", "lb"))
    return both.where(F.size(F.array_intersect("ta", "tb")) >= least_matches("na", "nb", "l", least)).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, least: int, heavy: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    common = F.size(F.array_intersect("tokensa", "tokensb"))
    return attached(pairs, sets, ["n", "tokens"], heavy).where(100 * common >= least * (F.col("na") + F.col("nb") - common)).select("a", "b")


def needed(x: str, y: str, least: int) -> Column:
    """Least intersection of two sets of sizes x and y that reaches the similarity."""
    return F.ceil(least * (F.col(x) + F.col(y)) / F.lit(100 + least))


def possible(x: str, y: str, least: int) -> Column:
    """Whether two sets' sizes n and numbers of shingles s that occur elsewhere allow the similarity; ``x`` and ``y`` are patterns of column names."""
    nx, ny, sx, sy = x.format("n"), y.format("n"), x.format("s"), y.format("s")
    return (100 * F.least(nx, ny) >= least * F.greatest(nx, ny)) & (needed(nx, ny, least) <= F.least(sx, sy))


def least_matches(nx: str, ny: str, l: str, least: int) -> Column:
    """Matches that prefixes for ``l`` have at least if the sets reach the similarity.

    All but ceil(least% of n) - l of a set lie in its prefix, and of the shingles that both have those before the end of
    the shorter-reaching prefix are in both; so a pair that needs a larger intersection needs as many more matches.
    """
    return needed(nx, ny, least) - F.ceil(least * F.greatest(nx, ny) / F.lit(100)) + F.col(l)


def alike(lists: DataFrame) -> DataFrame:
    """``lists`` with tokens of the same list as one, at the earliest of their positions in each set; lists of one entry are left out.

    The shingles of a passage that some documents share have one list; its entries then count once for all of them.
    Lists are compared by their lengths and two 64-bit exclusive-ors of hashed entries.
    """
    marks = lists.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    marks = cut(marks.where("c > 1"))
    first = marks.groupBy("c", "x", "y").agg(F.min("token").alias("first"))
    named = split_join(lists, marks.join(first, ["c", "x", "y"]).select("token", "first"), "token", "id")
    return named.groupBy(F.col("first").alias("token"), "id", "n", "l", "s", "middle").agg(F.min("at").alias("at"))


def across(named: DataFrame, least: int, heavy: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components ``c`` whose positions in a list allow the similarity.

    Where two sets share their first token, in the one order, neither has fewer tokens left than they need in common. So
    the smaller set's token is among its first n - needed(n, n) + 1, the larger one's among its first n - least% of n + 1,
    and those of both fit the pair.
    """
    small = named.where(F.col("at") + needed("n", "n", least) <= F.col("n")).select("token", *[F.col(x).alias(f"{x}a") for x in ("id", "n", "s", "c", "at")])
    large = named.where(100 * (F.col("n") - F.col("at")) >= least * F.col("n")).select("token", *[F.col(x).alias(f"{x}b") for x in ("id", "n", "s", "c", "at")])
    met = split_join(large, small, "token", "idb", heavy).where(
        ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("ida") < F.col("idb"))) & (F.col("ca") != F.col("cb"))
        & possible("{}a", "{}b", least) & (F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= needed("na", "nb", least))
    )
    return met.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()


def around_pivots(named: DataFrame, step: int, least: int, heavy: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's sets with the list's pivot: the most central set at first, later any of its components'."""
    rank = -F.col("middle") if step == 0 else F.xxhash64(F.lit(step), "c").cast("double")
    pivots = named.groupBy("token").agg(F.min(F.struct(rank.alias("h"), "id", "n", "s", "c")).alias("p"))
    pairs = split_join(named, pivots, "token", "id", heavy).where((F.col("c") != F.col("p.c")) & possible("{}", "p.{}", least))
    return pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def link(lists: DataFrame, sets: DataFrame, least: int, rounds: int = 1) -> DataFrame:
    """Links (a, b) that hold all components of the similarity together.

    Round by round each list proposes a pivot; at last ``across`` joins what is left.
    """
    prefixes = cut(lists.groupBy("id", "n", "l").agg(F.collect_list("token").alias("t")))
    named = cut(alike(lists).withColumn("c", F.col("id")))
    long, links = heavy_keys(named, "token"), None  # lists only get shorter
    for step in range(rounds + 1):
        if links is not None:
            now = components(links)
            named = named.drop("c").join(now, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component")
            named = cut(named)
            named = cut(split_join(named, lists_of_several(named), "token", "id", long))
            if named.isEmpty():
                break
        pairs = cut(around_pivots(named, step, least, long) if step < rounds else across(named, least, long))
        heavy = heavy_keys(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "id")
        found = cut(verify(matching(pairs, prefixes, least, heavy), sets, least, heavy))
        links = found if links is None else cut(links.union(found))
    return links


def lists_of_several(named: DataFrame) -> DataFrame:
    """Tokens whose lists still span more than one component."""
    ends = named.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y"))
    return ends.where("x <> y").select("token")


def join_similar(docs: DataFrame, least: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link if 100 * intersection >= ``least`` * union of their sets of distinct ``words``-word shingles. Words
    are runs of anything but ASCII white space, lower-cased in A-Z; a text with fewer words is one shingle; one without
    words, or null, has none and links with nothing. A component's id is the smallest doc_id reachable by links.

    There is a row for each row of ``docs``, with its own set size. Rows with the same id are one node with the links of
    all; a row without words is alone whatever its id. A row with a null id links with nothing and has a null component.
    Shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = docs.count()
    ranges = max(parts(spark), -(-n // 3000), 1)
    bits = min(56, max(40, (n * 1024).bit_length() + 10))
    counted = cut(shared_counts(rows, ranges, bits, words))
    groups = cut(counted.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("shared").alias("shared")))
    alive = groups.where(100 * F.col("shared") >= least * F.col("n"))
    sets = cut(read_sets(rows, alive, words))
    lists = cut(postings(sets, ranges, least))
    links = link(lists, sets, least)
    spoken = cut(counted.where("n > 0 AND id IS NOT NULL").select("id", "n", F.struct("f1", "f2").alias("set")))
    groups = groups.select(F.struct("f1", "f2").alias("set"), F.col("id").alias("first"))
    again = spoken.groupBy("id").agg(F.count("*").alias("k")).where("k > 1")
    named = spoken.select("id", "set").join(again, "id", "left_semi").join(groups, "set")
    whole = components(links.union(named.selectExpr("id AS a", "first AS b").where("a <> b")))
    solved = groups.join(whole, F.col("first") == F.col("node"), "left").select("set", F.coalesce("component", "first").alias("component"))
    every = split_join(spoken, solved, "set", "id").select("id", "n", "component")
    every = every.union(counted.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component")))
    return every.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
