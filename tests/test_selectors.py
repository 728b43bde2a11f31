"""Selectors from examples against a walk over random trees."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import pages

SCHEMA = "k string, node int, parent int, tag string, class string, pick boolean"


def induced(rows):
    """(container, selector, n) of one page's picked rows."""
    by = {r[1]: r for r in rows}
    picked = [r[1] for r in rows if r[5]]
    if not picked:
        return None

    def path(n):
        return path(by[n][2]) + [n] if by[n][2] in by else [n]

    paths = [path(n) for n in picked]
    k = 0
    while all(len(p) > k and p[k] == paths[0][k] for p in paths):
        k += 1
    top = paths[0][k - 1] if k else None
    classes = lambda n: [c for c in (by[n][4] or "").split() if len(c) < 40 and not re.match(pages.STYLING, c)][:3]
    if len(picked) < 2 or top is None or len({len(p) for p in paths}) > 1 or any(len(p) == k for p in paths):
        return top, None, len(picked)
    parts = []
    for level in zip(*(p[k:] for p in paths)):
        if len({by[n][3] for n in level}) > 1:
            return top, None, len(picked)
        parts.append(".".join([by[level[0]][3], *(c for c in classes(level[0]) if all(c in classes(n) for n in level))]))
    return top, " > ".join(parts), len(picked)


@pytest.mark.parametrize("seed", range(2))
def test_path_selectors(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in [*(f"p{i}" for i in range(40)), None]:
        n = rng.randrange(2, 30)
        own = []
        for i in range(n):
            parent = None if i == 0 else rng.randrange(max(0, i - 4), i) if rng.random() < 0.95 else 999
            own.append((k, i, parent, rng.choice(["div", *["li"] * 8] if seed else ["li"]), rng.choice([None, "a b", "b a c d", "b js-x w-1", "a  b"]), False))
        above = max(range(n), key=lambda x: sum(r[2] == x for r in own))
        depths = {}
        for i, r in enumerate(own):
            depths[i] = depths.get(r[2], 0) + 1
        level = rng.choice([rng.sample(range(n), min(n, 3)), [i for i in range(n) if own[i][2] == above], [i for i in range(n) if depths[i] == depths[n - 1]], [rng.randrange(n)]])
        rows += [(*r[:5], i in set(level)) for i, r in enumerate(own)]
    got = {r.k: (r.container, r.selector, r.n) for r in pages.path_selector(spark.createDataFrame([r for r in rows if r[0]], SCHEMA).repartition(3), ["k"], F.col("pick")).collect()}
    want = {k: induced([r for r in rows if r[0] == k]) for k in {r[0] for r in rows} if k}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert any(s for _, s, _ in got.values()) and any(s is None for _, s, _ in got.values())


def test_path_of_two_lists(spark):
    """Elements of two lists: the path leads through both from the element that holds them."""
    rows = [("k", 0, None, "main", "", False), ("k", 1, 0, "ul", "menu left", False), ("k", 2, 0, "ul", "menu right", False), ("k", 3, 1, "li", "row-1 item on", True), ("k", 4, 1, "li", "item", True), ("k", 5, 2, "li", "item off", True), ("k", 6, 5, "a", "", False)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = pages.path_selector(df, ["k"], F.col("pick")).first()
    assert (one.container, one.container_tag, one.selector, one.n) == (0, "main", "ul.menu > li.item", 3)
    assert pages.path_selector(df, ["k"], F.col("node").isin(3, 6)).first().selector is None and pages.path_selector(df, ["k"], F.col("node") == 3).first().selector is None
    assert pages.path_selector(df, ["k"], F.col("node").isin(2, 5)).first().selector is None and pages.path_selector(df, ["k"], F.lit(False)).count() == 0
    assert {r.node: [s.node for s in r.path] for r in pages.ancestor_paths(df, ["k"]).collect()}[6] == [0, 2, 5, 6]


def test_portions():
    """Rows stay in order and whole; a portion ends with the row that fills it."""
    texts = [None, "", "x" * 10, *("y" * (k % 700) for k in range(5000)), "z" * 3_000_000, "end"]
    got = list(pages.portions(pa.array(["before", *texts])[1:]))
    assert [x for _, some in got for x in some] == texts and [k for k, _ in got] == [sum(len(s) for _, s in got[:i]) for i in range(len(got))]
    assert len(got) >= 7 and all(sum(len(x or "") + pages.ROW for x in some[:-1]) < pages.PARSED for _, some in got) and list(pages.portions(pa.array([], "string"))) == []


def test_a_worker_holds_few_parsed_pages(spark):
    """Of 5000 pages in one batch no more are held parsed than come to a portion."""
    alive = [0]

    class Parsed(dict):
        def __init__(self, text):
            alive[0] += 1
            super().__init__(text=text, alive=alive[0])

        def __del__(self):
            alive[0] -= 1

    df = spark.range(5000).select("id", F.concat(F.lit("page "), "id").alias("html"), F.lit(1).alias("other")).coalesce(1)
    got = pages.with_parsed(df, ["id"], "html", "p", pa.struct([("text", pa.string()), ("alive", pa.int64())]), "struct<text:string,alive:bigint>", Parsed)
    assert got.columns == ["id", "p"] and got.where("p.text <> concat('page ', id)").count() == 0 and got.count() == 5000
    assert got.agg(F.max("p.alive")).first()[0] <= 2 * pages.PARSED // pages.ROW


def test_page_selectors_parse_once(spark, tmp_path):
    """What is computed after the elements doesn't parse pages again."""
    menu = "<html><body><ul><li><a href='/a'>a</a></li><li><a href='/b'>b</a></li></ul></body></html>"
    spark.createDataFrame([(1, "u", menu), (2, "v", "<p>x</p>"), (3, "w", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = queries.page_selectors(spark, str(tmp_path))
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and df.collect() == [(1, "ul", "li > a", 2)]
