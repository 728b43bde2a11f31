"""Values, texts, numbers and addresses on one row of mixed kinds, and on addresses with known patterns."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import numbers, text, urls, variants
from millrace.functions.values import Values
from millrace.operators import endpoints

c = F.col


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql("""SELECT 7 AS places, 'Late Train' AS line, CAST(NULL AS STRING) AS remark, 31 AS delay, 0.5D AS share, true AS open, false AS full, named_struct('stop', 'Harbour', 'track', CAST(NULL AS INT)) AS next,
        array('east', 'night') AS marks, 'lines/31/time.table.csv' AS plan, '<i>new</i> stop <br' AS note, '\t Late Train \n' AS padded, '20' AS twenty, '3' AS three, array() AS none, map('z', 1, 'm', 2) AS m""")


def one(df, x):
    return df.select(x.alias("x")).first()["x"]


def test_values(row):
    v = Values(row)
    cases = [
        (v.plus(c("delay"), F.lit(1)), 32), (v.plus(c("twenty"), c("three")), "203"), (v.plus(c("twenty"), c("delay")), "51"), (v.plus(c("line"), c("delay")), "Late Train31"), (v.plus(c("line"), c("remark")), None),
        (v.minus(c("twenty"), c("delay")), -11.0), (v.times(c("delay"), c("share")), 15.5), (v.over(c("delay"), F.lit(0)), None), (v.remainder(F.lit(-9), F.lit(4)), -1), (v.remainder(c("delay"), F.lit(0)), None),
        (v.minus(c("open"), c("delay")), None), (v.greater(c("three"), c("twenty")), False), (v.greater(c("line"), c("twenty")), True), (v.less(c("remark"), c("delay")), False), (v.at_least(c("delay"), F.lit(31)), True),
        (v.at_most(c("open"), F.lit(1)), False), (v.same(c("delay"), F.lit("31")), False), (v.same(c("remark"), F.lit(None)), True), (v.differs(c("delay"), F.lit(31.0)), False),
        (v.either(c("remark"), c("line")), "Late Train"), (v.either(c("full"), c("delay")), "31"), (v.both(c("delay"), c("line")), "Late Train"), (v.choose(c("open"), F.lit("in"), F.lit("out")), "in"),
        (v.truthy(c("none")), False), (v.truthy(c("next")), True), (v.truthy(c("remark")), False), (v.negated(c("full")), True), (v.text("+", c("places"), " / ", c("remark"), c("marks"), c("full")), '+7 / ["east","night"]false'),
        (v.json(c("next")), '{"stop":"Harbour","track":null}'), (v.json(c("line")), '"Late Train"'), (v.keys(c("m")), ["m", "z"]), (v.keys(c("next")), ["stop", "track"]), (v.keys(c("places")), []),
        (v.length(c("marks")), 2), (v.length(F.lit("ß→")), 5), (v.length(c("next")), 2), (v.length(c("places")), 0), (v.whole_number(c("twenty")), 20), (v.whole_number(c("share")), 0), (v.whole_number(F.lit(7.9), True), 7),
        (v.whole_number(c("open")), 1), (v.whole_number(F.lit("8 ")), 0), (v.double(F.lit("0x1")), 0.0), (v.double(F.lit("-5e-1")), -0.5), (v.smallest(c("delay"), c("twenty"), c("places")), 7), (v.largest(c("places")), 7), (v.smallest(c("three")), None),
    ]
    got = row.select(*[x.alias(f"c{i}") for i, (x, _) in enumerate(cases)]).first()
    assert [(i, got[i]) for i in range(len(cases))] == [(i, want) for i, (_, want) in enumerate(cases)]


def test_texts(row):
    cases = [
        (text.default(F.lit(""), F.lit("-")), "-"), (text.join(c("marks")), "east,night"), (text.trim(c("padded")), "Late Train"), (text.truncate(c("line"), 4), "Late..."), (text.truncate(c("line"), 10), "Late Train"), (text.replace(c("twenty"), "", "."), ".2.0."),
        (text.first(c("marks")), "east"), (text.last(c("marks")), "night"), (text.first(c("none")), None), (text.slugify(F.lit("__Über  alle-Maßen (2)__")), "über-allemaßen-2"), (text.sanitize(c("note")), "new stop "), (text.sanitize(F.lit("2 > 1 <x")), "2  1 "),
        (text.ext(c("plan")), ".csv"), (text.ext(F.lit("plan")), ""), (text.basename(c("plan")), "time.table.csv"), (text.urlencode(F.lit("ö/1 *~")), "%C3%B6%2F1%20%2A~"), (text.urldecode(F.lit("7%2b8+9%4")), "7+8 9%4"),
        (text.rounded(F.lit(-0.5)), -1.0), (text.ceiling(F.lit(-1.2)), -1.0), (text.unique(F.array(F.lit(None), F.lit("b"), F.lit(None), F.lit("b"))), [None, "b"]), (text.split(F.lit("1;2;")), ["1;2;"]),
        (text.split(F.lit("1;2;"), ";"), ["1", "2", ""]), (text.math_round(F.lit(None).cast("double")), 0), (text.unescape(F.lit("&lt;&amp;gt;")), "<&gt;"), (text.urls_in(F.lit('["http://a.test/b?c=1", "http://a.test/b?c=1"]')), ["http://a.test/b?c=1"]),
        (text.safe_filename(F.lit("7*8?.txt")), "7_8__txt"), (numbers.format_size(F.lit(2_340_000)), "2.3 MB"), (numbers.format_size(F.lit(12)), "12 bytes"), (numbers.suffixed(F.lit("3.5m")), 3500000.0), (numbers.suffixed(F.lit("few")), None),
        (numbers.duration(F.lit(7265)), "2:01:05"), (numbers.duration(F.lit(5)), "0:05"), (numbers.epoch_date(F.lit(-86401)), "1969-12-30"), (numbers.epoch_millis_date(F.lit(172_800_000)), "1970-01-03"),
        (text.join_nested(F.from_json(F.lit('[{"b":[{"t":"x"},{"t":null},{"t":"y"}]},{"b":null},{"b":[{"t":"z"}]}]'), "array<struct<b:array<struct<t:string>>>>"), "b", "t"), "x y z"),
    ]
    got = row.select(*[x.alias(f"c{i}") for i, (x, _) in enumerate(cases)]).first()
    assert [(i, got[i]) for i in range(len(cases))] == [(i, want) for i, (_, want) in enumerate(cases)]


@pytest.mark.parametrize("url, want", [
    ("FTP://Files.Test:21/Pub", "ftp://files.test:21/Pub"), ("https://maps.test/tile/0042/9", "https://maps.test/tile/:id/:id"), ("https://maps.test/v/9zk31mq7/", "https://maps.test/v/:id"), ("https://maps.test/v/zkmqabcd", "https://maps.test/v/zkmqabcd"),
    ("https://maps.test/part/KX77T4Q1M2?b&a=&b=2", "https://maps.test/part/KX77T4Q1M2?a&b"), ("https://maps.test/part/Kx77t4q1m2", "https://maps.test/part/:id"), ("https://maps.test/walk-12-of-90", "https://maps.test/walk-12-of-90"), ("https://maps.test/#", "https://maps.test#"),
    ("https://maps.test/a?x=1#/see/12345/?y=2&x", "https://maps.test/a?x#/see/:id?x&y"), ("maps/12#7", "maps/12#:id"), ("https://maps.test", "https://maps.test"), ("", ""),
])
def test_command_patterns(spark, url, want):
    assert one(spark.range(1), urls.command_pattern(F.lit(url))) == want


def test_endpoint_addresses(spark):
    df = spark.range(1)
    assert one(df, urls.endpoint_pattern(F.lit("http://Bus.Test:8080/stop/77/0a1b2c3d4e/BVq1w2e3r4t5/now?to=5&timestamp=1&from=2#map"))) == "bus.test/stop/{id}/{hex}/{bvid}/now?from={}&to={}"
    assert one(df, urls.endpoint_pattern(F.lit("bus/77"))) == "bus/77"
    assert [one(df, urls.site_name(F.lit(u))) for u in ("https://x.com/bus", "https://www.bus.org.jp/", "https://live.bus.test", "https://bus/", "bus")] == ["twitter", "bus", "bus", "bus", "site"]
    assert [one(df, urls.capability_name(F.lit(u))) for u in ("https://bus.test/Trending", "https://bus.test/v1/Next-Stops/88", "https://bus.test/0/")] == ["hot", "next_stops", "data"]
    assert one(df, urls.templated(F.lit("http://Bus.test/find?keyword=a+b&limit=3&page=1&via=2"))) == "http://bus.test/find?keyword=:keyword&limit=:limit&page=:page&via=2"
    assert one(df, urls.with_parameters(F.lit("bus"), {"to": F.lit("a&b"), "no": F.lit(None).cast("string"), "n": F.lit(4)})) == "bus?to=a%26b&n=4"
    assert urls.glob_pattern("*.a?b/**") == r".*\.a.b/.*.*"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.sampled_from(["", "a", "7", "-2.5", " 3", "1e2", "nan"]))), min_size=1, max_size=8))
def test_arithmetic_by_rows(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a long, b string")
    v = Values(df)
    got = df.orderBy("i").select(v.greater(c("a"), c("b")).alias("g"), v.over(c("a"), c("b")).alias("d"), v.either(c("a"), c("b")).alias("e")).collect()
    for r, (a, b) in zip(got, rows):
        x = None if b is None or b in ("", "a", " 3") else float(b)
        assert r.g == (a is not None and x is not None and x == x and a > x) or (x is not None and x != x)
        assert r.d == (None if a is None or not x or x != x else a / x)
        assert r.e == (str(a) if a else b)


def test_variants(spark):
    """Lists, names and kinds of records against plain Python on nested JSON; no Python worker in the plan."""
    def lists(value, path=(), depth=0):
        if isinstance(value, list):
            return [(len(value), path, value)] if len(value) >= 2 and any(isinstance(e, dict) for e in value) else []
        return [x for k in sorted(value) for x in lists(value[k], (*path, k), depth + 1)] if isinstance(value, dict) and depth < 4 else []

    def names(value, levels=4):
        return [n for k in sorted(value) for n in (k, *(f"{k}.{m}" for m in names(value[k], levels - 1)))] if isinstance(value, dict) and levels else []

    rng = random.Random(3)

    def some(depth):
        kind = rng.choice("oooaaansbx") if depth else "o"
        if kind == "o":
            return {rng.choice(["list", "a", "b.c", "Title", "url", "é"]): some(depth - 1) for _ in range(rng.randrange(4))}
        return [some(depth - 1) for _ in range(rng.randrange(4))] if kind == "a" else {"n": rng.choice([1, 2.5, 10**12]), "s": "text", "b": True, "x": None}[kind]

    values = [some(rng.randrange(1, 7)) for _ in range(300)] + [[{"t": 1}, 2], [1, 2], {"p": [{"x": 1}, 0], "q": [{"y": {"z": [1]}}, 0]}, 7]
    texts = [json.dumps(v) for v in values] + [None, "", "no json", '{"a": 1, "a": 2}', "[" * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, response_body string").withColumn("response", F.lit("clash"))
    read = endpoints.read_bodies(rows.drop("response"), "response_body")
    assert "Python" not in read._jdf.queryExecution().toString() and "InArrow" not in read._jdf.queryExecution().toString()
    got = {r.i: r.response for r in read.collect()}
    kind = lambda v: {bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}.get(type(v), "string")
    for i, v in enumerate(values):
        found = lists(v)
        if not found:
            assert got[i] is None
            continue
        n, path, items = max(found, key=lambda x: (x[0], x[1]))
        first = items[0] if isinstance(items[0], dict) else {}
        assert (got[i].item_path, got[i].item_count) == (".".join(path), n) and got[i].fields == names(first) and got[i].kinds == {k: kind(x) for k, x in first.items()}
    assert all(got[i] is None for i in range(len(values), len(texts)))
    held = spark.createDataFrame([(1, '{"a": {"b": 1}, "c": "x"}'), (2, '{"a": 2}'), (3, "[5, 6]"), (4, None), (5, "9")], "i long, t string").select("i", variants.variant(F.col("t")).alias("v"))
    assert {tuple(r) for r in variants.field_profile(held, "v").collect()} == {("a", "object", 1), ("a.b", "number", 1), ("c", "string", 1), ("a", "number", 1)}
    assert [(r.i, r.pos, r.key) for r in variants.entry_rows(held, "v", ["i"]).orderBy("i", "pos").collect()] == [(1, 0, "a"), (1, 1, "c"), (2, 0, "a"), (3, 0, None), (3, 1, None)]
    assert held.where("i <= 2").agg(variants.merged_schema(F.col("v"))).first()[0] == "OBJECT<a: VARIANT, c: STRING>"


def test_sizes_round_the_exact_value(spark):
    """Doubles beside a half, halves themselves, and sizes in all units, as Python prints them."""
    rng = random.Random(1)
    xs = [0.25, 0.35, 0.75, 1.15, 1.45, 0.05, 99.95, 749.25, 0.0, 3.0, 2.0**47 + 0.25, 2.0**60, *(k / 20 for k in range(1, 4000, 2)), *((rng.randrange(1, 10**12) * 10 + 5) / 100 for _ in range(2000)), *(rng.random() * 10 ** rng.randrange(14) for _ in range(2000))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numbers.one_decimal(c("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in got if r.y != "%.1f" % r.x] == []
    sizes = [1000, 1001, 1050, 149_850, 749_250, 10**6, 10**6 + 1, 1_450_000, 10**9, 1_150_000_000, 2**63 - 1, None]
    want = ["1000 bytes", "1.0 KB", "1.1 KB", "149.8 KB", "749.2 KB", "1000.0 KB", "1.0 MB", "1.4 MB", "1000.0 MB", "1.1 GB", "9223372036.9 GB", None]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(numbers.format_size(c("n"))).collect()] == want
