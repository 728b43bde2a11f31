"""Steps, stored queries, profiling, pages, rendering and streams on small tables."""

import datetime
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace import queries
from millrace.operators import endpoints, groups, joins, order, pages, sets, steps, windows
from millrace.plans import stored, table_functions
from millrace.sources import read, write
from millrace.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.sql(queries.ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        assert got == sorted([plain(dict(zip(found.columns, r))[c]) for c in columns] for r in found.fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_steps(spark):
    df = spark.sql("SELECT named_struct('list', array(named_struct('a', 1), named_struct('a', 2)), 'n', array(5, 6)) AS data, '{\"x\":[{\"y\":3}]}' AS js")
    assert [tuple(r) for r in steps.select_path(df, "data.list").collect()] == [(0, 1), (1, 2)]
    assert [r.value for r in steps.select_path(df, "data..n").collect()] == [5, 6]
    assert steps.select_path(df, "data.n[1]").first().value == 6 and steps.select_path(df, "data.n[7]").first().value is None
    assert steps.select_path(df, "data.n.1").first().value is None and steps.select_path(df, "js.x[0].y").first().value == "3"
    for wrong in (-1, "x", 1.5, True, None):
        with pytest.raises(steps.StepError):
            steps.first_rows(df, wrong)
    with pytest.raises(steps.StepError):
        steps.select_path(df, "data.n[-1]")
    assert steps.project(df, ["js", "none"]).first().none is None
    images = spark.sql("SELECT 1 AS k, array('u/a.png', 'u/b', 'u/a.png') AS i")
    assert [r.file for r in steps.image_names(images, "i", "k").orderBy("position").collect()] == ["img_001.png", "img_002.jpg"]


def test_pushdown(spark, capsys):
    steps.keep(read.table(spark, SF, "orders"), F.col("o_totalprice") > 1000).select("o_orderkey").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_positions_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("v"), "id").unionByName(spark.createDataFrame([(None, -1)], "v long, id long"))
    rows = order.with_position(df, steps.sort_keys("v", True, ["id"])).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(1001)) and rows[0].v is None
    assert [(r.v, r.id) for r in rows[1:]] == sorted(((i * 37 % 101, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))


def test_joins_and_sets(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), (None, 3)], "k string, t long")
    marks = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), (None, 1, "z")], "k string, at long, m string")
    assert {(r.k, r.t): r.m for r in joins.latest_before(rows, marks, "t", "at", ["m"], ["k"], F.floor(F.col("t") / 2)).collect()} == {("a", 1): None, ("a", 5): "y", ("b", 2): None, (None, 3): "z"}
    assert joins.lookup_or_key(rows, spark.createDataFrame([("a", "")], "id string, name string"), "k", "id", "name", "n").where("k = 'a'").first().n == "a"
    assert sets.fallback(rows.limit(0), rows).count() == 4 and sets.fallback(rows.limit(0)).count() == 0
    assert groups.first_of_each(rows, ["k"], ["t"]).count() == 3
    gaps = windows.gap_sessions(rows, ["k"], ["t"], F.col("t"), 3, bucket=F.floor(F.col("t") / 2))
    assert {(r.k, r.t): r.session for r in gaps.collect()} == {("a", 1): 0, ("a", 5): 1, ("b", 2): 0, (None, 3): 0}


def test_span_sessions(spark):
    """Missing times belong to the open part; keys go over borders of batches and may be null."""
    rows = [("a", i, None if i in (0, 4, 9) else float(i * 10)) for i in range(12)] + [("b", 0, None), ("b", 1, None), (None, 0, 5.0), (None, 1, 90.0)]
    want, start, part = {}, None, 0
    for k, i, t in rows[:12]:
        if t is not None:
            start = t if start is None else start
            if t - start > 25:
                start, part = t, part + 1
        want[k, i] = part
    want |= {("b", 0): 0, ("b", 1): 0, (None, 0): 0, (None, 1): 1}
    df = spark.createDataFrame(rows, "k string, i int, t double")
    for batch in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r.k, r.i): r.part for r in windows.span_sessions(df, ["k"], "i", F.col("t"), 25.0).collect()}
        assert got == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert windows.span_sessions(df.limit(0), ["k"], "i", F.col("t"), 1.0).count() == 0


def test_span_sessions_of_keys_alike(spark):
    """Keys that differ by a microsecond, or beyond a double's shown digits, are different; 0.0 and -0.0 are not."""
    at = [datetime.datetime(2024, 1, 1, 0, 0, 0, k) for k in (1, 2)]
    rows = [(a, d, i, float(100 * i)) for i in range(2) for a in at for d in (0.1, 0.1 + 2**-56)] + [(None, -0.0, 0, 0.0), (None, 0.0, 1, 9.0)]
    df = spark.createDataFrame(rows, "a timestamp, d double, i int, t double").withColumn("n", F.col("a").cast("timestamp_ntz"))
    for keys in (["a", "d"], ["n", "d"]):
        got = [(r.a, r.d, r.i, r.part) for r in windows.span_sessions(df.repartition(1), keys, "i", F.col("t"), 25.0).collect()]
        assert sorted(p for *_, p in got) == [0] * 6 + [1] * 4 and all(p == i for a, _, i, p in got if a)


def test_stored_orders(spark):
    """Every step after a keyed source, a sort and a map: an order stays where its columns do, and ends with them."""
    t = spark.createDataFrame([(3, 30, 1, [1, 2]), (1, 10, 2, [3]), (2, 20, 3, [])], "id long, v long, w long, list array<int>")
    tables = {"t": t, "u": t.select("id", "v"), "p": spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string"), "requests": log(spark, [("https://a.example/x", "GET", {}, None, 200, '{"a": 1}')])}
    run = lambda *more, key="id", table="t": stored.run(spark, stored.parse(json.dumps({"site": "s", "name": "n", "pipeline": [{"source": {"table": table, "key": key}}, *more]})), tables.__getitem__)
    narrow = {"map": {"id": "${{ item.id }}", "v": "${{ item.v }}"}}
    assert sorted(r.v for r in run(narrow, {"union": "u"}).collect()) == [10, 10, 20, 20, 30, 30]
    assert run(narrow, {"fallback": "u"}).count() == 3 and run({"unpivot": {"ids": ["w"], "metrics": ["id", "v"]}}).count() == 6
    assert [r.id for r in run({"unpivot": {"ids": ["id"], "metrics": ["v"]}}).collect()] == [1, 2, 3]
    assert run({"read": {"keys": ["page_id"]}}, key="page_id", table="p").count() == 1 and run({"read": {"keys": ["url"]}}, key="page_id", table="p").count() == 1
    assert run({"snapshot": {"keys": ["url"]}}, key="page_id", table="p").count() >= 1
    assert run({"select": "list"}).count() == 3
    assert [r.id for r in run({"explode": "list"}).collect()] == [1, 3, 3] and [r.id for r in run({"join": {"table": "u", "left": "id", "right": "id", "how": "left"}}).collect()] == [1, 2, 3]
    assert [r.w for r in run({"distinct": {"by": ["w"], "order": ["id"]}}, {"sort": {"by": "v", "order": "desc"}}).collect()] == [1, 3, 2]
    assert [r.id for r in run({"topk": {"by": ["w"], "sort": "v", "k": 1}}, {"download": {"url": "w"}}).collect()] == [1, 2, 3]
    assert [tuple(r) for r in run({"group": {"by": ["w"], "agg": {"n": "count(*)"}}}).collect()] == [(1, 1), (2, 1), (3, 1)]
    assert [r.id for r in run({"sort": "nothing"}).collect()] == [1, 2, 3]
    assert [r.value for r in run({"sort": {"by": "v", "order": "desc"}}, {"map": "${{ item.id }}"}, {"offset": 1}).collect()] == [2, 1]
    assert [tuple(r) for r in run({"limit": 2}, {"offset": 1}, {"map": {"id": "${{ item.id }}", "i": "${{ index }}"}}).collect()] == [(2, 0)] and run({"offset": 5}).count() == 0
    assert "SinglePartition" not in run({"sort": "v"}, {"offset": 1}).drop("x")._jdf.queryExecution().executedPlan().toString().split("Scan ExistingRDD")[0]
    with pytest.raises(steps.StepError):
        stored.run(spark, stored.parse("site: s\nname: n\npipeline: [{source: t}, {offset: 1}]"), tables.__getitem__)


def test_stored_missing_fields(spark):
    t = spark.createDataFrame([(1, ("x", [(5,)]), {"k": "y"}, "text")], "id long, s struct<a:string,l:array<struct<n:int>>>, m map<string,string>, t string")
    run = lambda what: tuple(stored.run(spark, stored.parse(json.dumps({"site": "s", "name": "n", "pipeline": [{"source": {"table": "t"}}, {"map": what}]})), {"t": t}.__getitem__).first())
    there = {"a": "${{ item.s.a }}", "b": "${{ item.s.l[0].n }}", "c": "${{ item.m.k }}", "d": "${{ item.T }}", "e": "${{ item.`id` + 1 }}", "f": "${{ 'item.none' }}", "g": "${{ named_struct('item', 2).item }}"}
    assert run(there) == ("x", 5, "y", "text", 2, "item.none", 2)
    gone = ["item.none", "item.none.at[0].all", "item.s.none", "item.s.l[0].none", "item.t.length", "item.id[0]", "item.none | default(null) | string", "item.none + 1", "upper(item.none)"]
    assert run({f"c{i}": f"${{{{ {x} }}}}" for i, x in enumerate(gone)}) == (None,) * 6 + ("",) + (None, None) or run({f"c{i}": f"${{{{ {x} }}}}" for i, x in enumerate(gone)})[:6] == (None,) * 6


def test_table_functions(spark):
    """Columns follow from arguments; lateral calls, table arguments, errors that tell what is wrong."""
    table_functions.install(spark)
    t = spark.createDataFrame([(1, "a, 1\n\nb,x, y\nc"), (2, None), (3, "")], "id int, t string")
    t.createOrReplaceTempView("texts_of_lines")
    got = spark.sql("SELECT id, f.* FROM texts_of_lines, LATERAL parse_lines(t, 'word, n int') f ORDER BY id, line")
    assert got.dtypes == [("id", "int"), ("line", "bigint"), ("word", "string"), ("n", "bigint")] and [tuple(r) for r in got.collect()] == [(1, 0, "a", 1), (1, 2, "b", None), (1, 3, "c", None)]
    for wrong in ("parse_lines(t, t)", "parse_lines(t, '')", "parse_lines(t, 'a,a')", "parse_lines(t, 'a date')"):
        with pytest.raises(Exception, match="columns|constant"):
            spark.sql(f"SELECT f.* FROM texts_of_lines, LATERAL {wrong} f").collect()
    run = lambda step, table=t: stored.run(spark, stored.parse(json.dumps({"site": "s", "name": "n", "pipeline": [{"source": {"table": "t", "key": "id"}}, {"table_function": step}]})), {"t": table}.__getitem__)
    assert [r.word for r in run({"name": "parse_lines", "args": {"text": "${{ item.t }}", "columns": "word"}}).collect()] == ["a, 1", "b,x, y", "c"]
    with pytest.raises(steps.StepError, match="id"):
        run({"name": "parse_lines", "args": {"text": "${{ item.t }}", "columns": "id"}})
    with pytest.raises(steps.StepError):
        run({"name": "range(5)); --"})
    marks = spark.createDataFrame([(i, k, x) for k in ("a", "b", None) for i, x in enumerate([5, None, 6, 20, 21])], "id int, k string, at int").repartition(4)
    got = run({"name": "number_sessions", "partition": "k", "order": ["id"], "args": {"time": "at", "gap": 10}}, marks)
    assert {(r.k, r.id): r.session for r in got.collect()} == {(k, i): int(i > 2) for k in ("a", "b", None) for i in range(5)}
    assert run({"name": "number_sessions", "partition": "k", "args": {"time": "at", "gap": 10}}, marks.limit(0)).count() == 0
    with pytest.raises(Exception, match="no column"):
        run({"name": "number_sessions", "partition": "k", "args": {"time": "none", "gap": 10}}, marks).count()

    @table_functions.table_function("twice")
    class Twice:
        @staticmethod
        def analyze(x):
            return table_functions.AnalyzeResult(table_functions.T.StructType([table_functions.T.StructField("again", x.dataType)]))

        def eval(self, x):
            yield (x,)
            yield (x,)

    assert run({"name": "twice", "args": {"x": "${{ item.id }}"}}).dtypes[-1] == ("again", "int") and run({"name": "twice", "args": {"x": "${{ item.id }}"}}).count() == 6


def test_stored_timeouts(spark, monkeypatch):
    slow = {"t": spark.range(10**12).select(F.hash("id").alias("h"))}
    text = "site: s\nname: n\ntimeout: {}\npipeline: [{{source: t}}, {{group: {{by: [], agg: {{s: sum(item.h)}}}}}}]"
    monkeypatch.setitem(stored.STEPS, "group", lambda run, df, what: df.agg(F.sum("h").alias("s")))
    assert stored.parse(text.format(45)).timeout == 45 and stored.parse("site: s\nname: n\ntimeoutSeconds: 2").timeout == 2 and stored.parse("site: s\nname: n").timeout is None
    with pytest.raises(TimeoutError, match="1 s"):
        stored.execute(spark, stored.parse(text.format(1)), slow.__getitem__)
    monkeypatch.setenv("MILLRACE_TIMEOUT", "1")
    with pytest.raises(TimeoutError, match="1.0 s"):
        stored.execute(spark, stored.parse(text.format(500)), slow.__getitem__)
    monkeypatch.setenv("MILLRACE_TIMEOUT", "soon")
    assert stored.execute(spark, stored.parse("site: s\nname: n\npipeline: [{source: t}]"), {"t": spark.range(3)}.__getitem__, then=lambda df: df.count()) == 3
    for wrong in ("0", "no", "true", "-1"):
        with pytest.raises(steps.StepError):
            stored.parse(text.format(wrong))


def test_set_operations(spark):
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "x"), (1, "x"), (2, None), (3, "y")], [(2, None), (1, "x"), (4, "z")]))
    assert sorted(map(tuple, sets.in_all(a, b.select("v", "k")).collect())) == [(1, "x"), (2, None)]
    assert sorted(map(tuple, sets.in_first_only(a, b).collect())) == [(3, "y")]
    assert sets.in_first_only(a).count() == 3 and sets.in_all(a.limit(0), b).count() == 0
    assert sets.fallback(a.limit(0), b, a).count() == 3 and sets.fallback(a.limit(0)).count() == 0


PLAIN = "site: s\nname: n\nargs: {n: {type: int, default: 2}}\npipeline:\n  - source: {table: t, key: id}\n"


def test_stored_expressions(spark):
    t = spark.createDataFrame([(1, 5, "a|b", "args.n"), (2, None, "", "x"), (3, 0, None, "}} it"), (4, 7, "c", None)], "id long, v long, w string, x string")
    run = lambda steps_text, given=None: [tuple(r) for r in stored.run(spark, stored.parse(PLAIN + steps_text), {"t": t}.__getitem__, given).collect()]
    kept = lambda condition: [r[0] for r in run(f"  - filter: {json.dumps(condition)}")]
    assert kept("item.v") == [1, 4] and kept("!item.v") == [2, 3] and kept("item.v && item.w") == [1, 4] and kept("!item.v || item.x = 'args.n'") == [1, 2, 3]
    assert kept("item.v > args.n") == [1, 4] and kept("item.x = 'args.n'") == [1] and kept(["item.v", "item.w | length"]) == [1, 4] and kept("(item.w | default('q')) && !(item.v && item.x)") == [2, 3, 4]
    assert kept("index % 2 && item.v") == [4] and kept("${{ item.w | replace('|', '') | length }}") == [1, 4] and kept("item.v <> 5") == [3, 4]
    assert run("  - map: {a: \"${{ item.w | split('|') | last | default(args.n) }}\", b: \"<${{ item.x }}|${{ '}}' || '|' }}>\"}") == [("b", "<args.n|}}|>"), ("2", "<x|}}|>"), ("2", "<}} it|}}|>"), ("c", "<|}}|>")]
    assert run("  - limit: 2\n  - map: {i: \"${{ index }}\"}") == [(0,), (1,)]
    assert run("  - limit: 1000000000\n  - map: {i: \"${{ index }}\", of: \"the index\"}")[-1] == (3, "the index")

    @stored.filter_function("doubled_text")
    def doubled_text(v, x, times=2):
        return F.repeat(v.shown(x), times)

    assert run("  - map: {a: \"${{ item.id | doubled_text(3) }}\"}")[1] == ("222",)
    for wrong in ("  - map: {a: \"${{ item.w | nothing }}\"}", "  - map: {a: \"${{ item.w | truncate(item.id) }}\"}", "  - map: {a: \"${{ item.w | replace('x') }}\"}", "  - evaluate: nothing"):
        with pytest.raises(steps.StepError):
            run(wrong)
    with pytest.raises(steps.StepError):
        stored.run(spark, stored.parse("site: s\nname: n\npipeline: [{source: t}, {map: {i: '${{ index }}'}}]"), {"t": t}.__getitem__)


def test_stored_files_and_timeout(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "j"))
    query = stored.parse(f"site: s\nname: n\npipeline: [{{source: {{file: '{tmp_path / 'j'}', kind: json, schema: id long, key: id}}}}]")
    df = stored.run(spark, query, lambda name: None)
    assert stored.within(spark, 60, df.count) == 3
    slow = spark.range(10**12).select(F.sum(F.hash("id")))
    with pytest.raises(TimeoutError):
        stored.within(spark, 1, slow.collect)
    assert stored.within(spark, 60, df.count) == 3


STORED = """
site: s
name: n
args: {n: {type: int, default: 2}, word: {required: true, choices: [x, y]}}
columns: [rank, label, missing]
pipeline:
  - source: {table: t, key: id}
  - navigate: somewhere
  - filter: item.v IS NOT NULL
  - sort: {by: v, order: desc}
  - map: {rank: "${{ index + 1 }}", label: "${{ args.word }}-${{ item.id }}${{ NULL }}", it's: "a'b"}
  - limit: ${{ args.n }}
"""


def test_stored_query(spark, tmp_path):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, 7)], "id long, v long")
    query = stored.parse(STORED)
    with pytest.warns(UserWarning, match="navigate"):
        got = stored.run(spark, query, {"t": t}.__getitem__, {"word": "x'"[:1]})
    assert [tuple(r) for r in got.collect()] == [(1, "x-3", None), (2, "x-4", None)]
    assert query.needs_capture
    for wrong in ({}, {"word": "z"}, {"word": "x", "n": "many"}, {"word": "x", "other": 1}):
        with pytest.raises(steps.StepError):
            query.bind(wrong)
    for text in ("name: n", "site: s\nname: n\npipeline: [{nothing: 1}]", "site: s\nname: n\npipeline: [{limit: 1, map: 2}]"):
        with pytest.raises(steps.StepError):
            stored.parse(text)
    (tmp_path / "a.yaml").write_text(STORED)
    (tmp_path / "b.yml").write_text("site: [")
    with pytest.warns(UserWarning, match="b.yml"):
        found = stored.load(str(tmp_path))
    assert list(found) == [("s", "n")] and stored.catalog(spark, found).first().args == ["n", "word"]
    assert stored.Argument("b", "bool").value("YES") is True and stored.Argument("f", "number").value("2.5") == 2.5
    bad = stored.parse("site: s\nname: n\npipeline: [{source: t}, {filter: '${{ item.v }} and more'}]")
    with pytest.raises(steps.StepError):
        stored.run(spark, bad, {"t": t}.__getitem__)

    @stored.step("doubled")
    def doubled(run, df, what):
        return df.unionByName(df)

    assert stored.run(spark, stored.parse("site: s\nname: n\npipeline: [{source: t}, {doubled: 1}]"), {"t": t}.__getitem__).count() == 8


def log(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + read.REQUEST)


def test_endpoints(spark):
    body = json.dumps({"data": {"list": [{"title": "a", "url": "u", "author": {"name": "x"}}, {"title": "b"}], "short": [1, 2]}})
    ct = {"content-type": "application/json", "Authorization": "x", "X-S-Common": "y"}
    rows = [
        ("https://a.example/api/list/1?page=1&limit=5&q=x&ts=9", "GET", ct, None, 200, None), ("https://a.example/api/list/2?q=y&page=1&limit=5", "GET", ct, None, 200, body), ("https://a.example/i.png", "GET", {"content-type": "image/png"}, None, 200, None),
        ("https://a.example/api/gone", "GET", ct, None, 404, body), ("https://a.example/plain", "GET", {}, None, None, "no json"), ("https://a.example/x/feed", "POST", {}, None, None, None), ("", "GET", {}, None, 200, None),
    ]
    found = {r.pattern: r for r in endpoints.endpoints(log(spark, rows), "i").collect()}
    assert set(found) == {"a.example/api/list/{id}?limit={}&page={}&q={}", "a.example/x/feed"}
    best = found["a.example/api/list/{id}?limit={}&page={}&q={}"]
    assert best.url.endswith("list/2?q=y&page=1&limit=5") and best.response.item_path == "data.list" and best.response.item_count == 2
    assert best.roles == {"title": "title", "url": "url", "author": "author"} and best.response.kinds["author"] == "object"
    assert best.score == 10 + 5 + 2 + 6 + 3 + 3 + 2 + 2 + 2 and best.confidence == 1.0 and best.auth == ["bearer", "signature"] and best.strategy == "intercept"
    named = endpoints.capabilities(endpoints.endpoints(log(spark, rows), "i")).orderBy("rank").collect()
    assert [r.name for r in named] == ["list", "feed"] and named[0].columns == ["title", "url", "author"] and named[1].columns == ["title", "url"]
    assert endpoints.wanted("Show popular things") == "hot" and endpoints.wanted("") is None
    choices = spark.createDataFrame([("hot", 0.5), ("search", 0.9)], "name string, confidence double")
    assert endpoints.choose(choices, "ranking").first().name == "hot" and endpoints.choose(choices).first().name == "search"
    probes = spark.createDataFrame([("u", "public", False), ("u", "header", True), ("w", "cookie", False)], "url string, strategy string, success boolean")
    assert {r.url: (r.strategy, round(r.confidence, 1)) for r in endpoints.cascade(probes, "url").collect()} == {"u": ("header", 0.8), "w": ("cookie", 0.3)}
    assert endpoints.endpoints(log(spark, rows).limit(0), "i").count() == 0
    assert read.first_response(log(spark, rows), "/api/gone", "i", "data.list[0].title").first().response == "a"


PAGE = """<html lang="en"><head><title>T &amp; U</title><meta name="author" content="Ann"><script>var x = "<p>";</script></head><body><nav><a href="/x">menu menu menu</a></nav>
<article><h1>Head</h1><p>First, with commas, and words.<p>Second <b>bold</b> part.</article><ul><li class="r a">1</li><li class="r b">2</li><li class="r">3</li><li class="r">4</li></ul><div style="display: none">gone</div></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>open")], "k long, html string")
    got = {r.k: r for r in pages.articles(df, ["k"]).withColumn("md", pages.markdown(F.col("title"), F.col("content"))).collect()}
    assert got[1].title == "T & U" and got[1].byline == "Ann" and got[1].lang == "en"
    assert got[1].textContent == "Head\nFirst, with commas, and words.\nSecond bold part." and got[1].excerpt.startswith("First") and got[1].md.startswith("# T & U\n\n# Head\n\nFirst")
    assert got[2].textContent is None and got[4].textContent == "open"
    tree = pages.snapshot(df, ["k"]).where("k = 1")
    assert tree.where("tag = 'script'").count() == 0 and tree.where("text = 'gone'").count() == 0 and tree.where("tag = 'a'").first().href == "/x"
    runs = pages.repeated_runs(tree.withColumn("class", F.lit("r")), ["k"], depth=1)
    assert [(r.n) for r in runs.collect()] == [4]
    assert pages.list_selector(tree, ["k"], F.col("text").isin("1", "2")).first().selector == "li.r"


def test_rendering(spark, tmp_path):
    df = spark.createDataFrame([("Ann", 3, {"r": "x"}), ("B|b", None, None)], "name string, age long, meta map<string,string>")
    assert write.render(df, "csv", ["name", "none"]) == "name,none\nAnn,\nB|b,\n"
    assert "| B\\|b |  |" in write.render(df, "MD", ["name", "age"]) and json.loads(write.render(df, "json"))[0]["meta"] == {"r": "x"}
    assert '{"r":"x"}' in write.render(df) and "Elapsed: 250ms | Source: here" in write.render(df, seconds=0.25, source="here")
    assert [write.render(df.limit(0), k) for k in ("table", "csv", "json", "yaml")] == ["(empty)", "", "[]", "[]\n"]
    for kind in ("csv", "json", "markdown", "parquet"):
        write.write(df, str(tmp_path / kind), kind)
    lines = [r.value for r in spark.read.text(str(tmp_path / "markdown" / "part-*")).collect()]
    assert lines.count("| name | age | meta |") == lines.count("| --- | --- | --- |") == 1 and "| B\\|b |  |  |" in lines
    assert "First 1 rows" in write.render(df, rows=1) and "First" not in write.render(df, rows=2) and write.render(None) == "(no data)" and write.render(None, "json") == "null"
    with pytest.warns(UserWarning, match="first 1 rows"):
        write.render(df, "csv", rows=1)
    assert "| age  | 3 " in write.render(df.limit(1), columns=["name", "age"], record=True) and json.loads(write.render(df, "json", record=True))["name"] == "Ann"
    assert read.records(spark, str(tmp_path / "csv"), "csv").count() == 2 and read.records(spark, str(tmp_path / "json"), "json").count() == 2


def test_streams(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = events.watch(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    batches = []
    for _ in range(2):
        events.drain(stream, lambda df, i: batches.append(df.count()), str(tmp_path / "state"), 60)
    assert sum(batches) == spark.read.parquet(f"{SF}/events.parquet").count()
    for k, f in enumerate((lambda s: events.counted(s, "ts", ["event_type"], "1 hour", "1 day"), lambda s: events.sessions(s, "ts", ["user_id"], "1 hour", "1 day"), lambda s: events.without_repeats(s, "ts", ["event_type"], "1 hour"))):
        events.drain(f(stream), lambda df, i: df.write.mode("append").parquet(str(tmp_path / f"out{k}")), str(tmp_path / f"state{k}"), 60)
        assert spark.read.parquet(str(tmp_path / f"out{k}")).count() > 0
