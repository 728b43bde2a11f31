"""Request archives in ranges of any size, and files written all or not at all."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import endpoints
from millrace.operators import steps
from millrace.sources import read, sink, write


def requests(n):
    rng = random.Random(n)
    for i in range(n):
        text = "".join(rng.choices('ab{}[]",\\\n é€  ', k=rng.choice([0, 5, 300, 3000])))
        yield {"url": f"https://a.example/{'api' if i % 3 else 'img'}/{i}?q={rng.randrange(5)}", "method": rng.choice(["GET", "POST"]), "headers": {"content-type": "application/json"}, "body": None, "status": rng.choice([200, 404, None]), "response_body": text}


def har(some):
    entries = [
        {"_initiator": {"type": "other"}, "request": {"method": r["method"], "url": r["url"], "headers": [{"name": "Accept", "value": "x"}], "postData": {"text": "p"}},
         "response": {"status": r["status"] or 0, "content": {"mimeType": "application/json", "text": r["response_body"]}}, "startedDateTime": "now", "nested": [{"request": {"url": "not one"}}]}
        for r in some
    ]
    return {"log": {"version": "1.2", "pages": [{"startedDateTime": "then", "id": "p"}, {"id": "q"}], "entries": entries, "comment": {"a": [{"b": 1}]}}}


@pytest.mark.parametrize("split", [1000, 1, 1 << 20])
def test_archive_of_lines(spark, tmp_path, split):
    """Every record once, whatever the ranges: of one byte, of less than a record, and with borders at line ends."""
    some = list(requests(4 if split == 1 else 150))
    if split == 1:
        some = [r | {"response_body": (r["response_body"] or "")[:20]} for r in some]
    lines = [json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(some)]
    lines.insert(2, "no json")
    lines.insert(4, "")
    (tmp_path / "one.jsonl").write_text("\n".join(lines), encoding="utf-8", newline="")
    got = read.archive(spark, str(tmp_path / "one.jsonl"), split)
    if split == 1:
        assert got.rdd.getNumPartitions() == os.path.getsize(tmp_path / "one.jsonl")
        got = got.coalesce(8)
    rows = got.orderBy("offset").collect()
    assert [r.broken for r in rows if r.broken is not None] == ["no json\n"]
    assert [(r.url, r.method, r.status, r.response_body) for r in rows if r.broken is None] == [(r["url"], r["method"], r["status"], r["response_body"]) for r in some]
    assert len({r.offset for r in rows}) == len(rows)


@pytest.mark.parametrize("split, indent", [(1000, 2), (1000, None), (1 << 20, 2), (5000, "\t"), (333, 1)])
def test_archive_of_a_browser(spark, tmp_path, split, indent):
    some = list(requests(25))
    (tmp_path / "log.har").write_text(json.dumps(har(some), indent=indent, ensure_ascii=False), encoding="utf-8", newline="")
    got = read.archive(spark, f"file://{tmp_path}/log.har", split)
    assert (got.rdd.getNumPartitions() == 1) == (indent is None or split == 1 << 20)
    rows = got.orderBy("offset").collect()
    assert [(r.url, r.method, r.status, r.response_body, r.body) for r in rows] == [(r["url"], r["method"], r["status"], r["response_body"], "p") for r in some]
    assert rows[0].headers == {"accept": "x", "content-type": "application/json"}


def test_archive_folder_and_filters(spark, tmp_path):
    some = list(requests(200))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text("".join(json.dumps(r) + "\r\n" for r in some[:90]))
    (tmp_path / "a" / "y.jsonl.gz").write_bytes(gzip.compress("".join(json.dumps(r) + "\n" for r in some[90:]).encode()))
    (tmp_path / "a" / "empty.jsonl").write_text("")
    (tmp_path / "a" / "_SUCCESS").write_text("x")
    log = read.archive(spark, str(tmp_path), 2000)
    assert log.count() == 200 and log.select("file", "offset").distinct().count() == 200
    for condition, keep in (
        (F.col("url").contains("api"), lambda r: "api" in r["url"]), ((F.col("status") == 200) & (F.col("method") != "GET"), lambda r: r["status"] == 200 and r["method"] != "GET"),
        (F.col("status").isNull(), lambda r: r["status"] is None), (~F.col("status").isin(200), lambda r: r["status"] == 404), (F.col("url").startswith("https://a.example/img/1"), lambda r: r["url"].startswith("https://a.example/img/1")),
        ((F.col("url") > "https://a.example/b") & (F.col("status") >= 300), lambda r: r["url"] > "https://a.example/b" and (r["status"] or 0) >= 300),
    ):
        assert sorted(r.url for r in log.where(condition).collect()) == sorted(r["url"] for r in some if keep(r))
    plan = log.where(F.col("url").contains("api"))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x and "RuntimeFilters" not in x]
    assert endpoints.endpoints(log.where("file LIKE '%x.jsonl'").withColumn("at", F.col("offset")), "at").count() > 0
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        read.archive(spark, str(tmp_path / "nowhere")).count()


def test_archive_of_a_long_record(spark, tmp_path):
    """A record over many ranges belongs to the first; the ranges inside it have none."""
    long = {"url": "u", "method": "GET", "response_body": "x" * 3_000_000}
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(r) for r in ({"url": "a"}, long, {"url": "z"})) + "\n")
    rows = read.archive(spark, str(tmp_path / "one.jsonl"), 100_000).orderBy("offset").collect()
    assert [(r.url, len(r.response_body or "")) for r in rows] == [("a", 0), ("u", 3_000_000), ("z", 0)]


def there(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def killed(partition):
    def run(tables):
        import os
        import signal

        from pyspark import TaskContext

        for table in tables:
            if TaskContext.get().partitionId() == partition:
                os.kill(os.getpid(), signal.SIGKILL)
            yield table
    return run


def test_markdown_files_are_one_table(spark, tmp_path):
    df = spark.range(0, 100, 1, 5).select("id", F.concat(F.lit("a|"), "id").alias("text"), F.array("id").alias("list"))
    path = tmp_path / "table"
    write.write(df.union(df.limit(0)), str(path), "markdown")
    names = [f["name"] for f in sink.manifest(str(path))["commits"][0]["files"]]
    assert there(path) == sorted([*names, sink.MANIFEST]) and len(names) == 6
    text = "".join((path / n).read_text() for n in names)
    assert text.split("\n") == ["| id | text | list |", "| --- | --- | --- |", *(f"| {i} | a\\|{i} | [{i}] |" for i in range(100)), ""]
    head, lines = write.markdown_rows(df.limit(1))
    sink.write_markdown(lines, head, str(path), overwrite=False)
    commits = sink.manifest(str(path))["commits"]
    assert len(commits) == 2 and [f["rows"] for f in commits[1]["files"]] == [1]
    assert "".join((path / f["name"]).read_text() for c in commits for f in c["files"]).count("| --- | --- | --- |") == 1
    before = there(path)
    broken = df.mapInArrow(killed(3), df.schema)  # the worker of one task dies when others have written
    with pytest.raises(Exception):
        write.write(broken, str(path), "markdown")
    assert there(path) == before and sink.manifest(str(path))["commits"] == commits
    write.write(df.where("id < 0"), str(path), "markdown")
    assert there(path) == [sink.MANIFEST, "part-00000-head.md"]
    with pytest.raises(Exception):
        write.write(broken, str(tmp_path / "new"), "markdown")
    assert not (tmp_path / "new").exists() or there(tmp_path / "new") == []


def test_articles_and_their_status(spark, tmp_path):
    rows = [(1, "A/b: c", "text é", "Ann", ["u", "v", "u"]), (2, "A/b: c", "x" * 2500, None, None), (3, None, "y", "Bo", []), (4, "none", "", "Cy", ["w"]), (5, "nil", None, None, None), (6, "..", "dots", None, None)]
    df = spark.createDataFrame(rows, "k long, title string, content string, author string, pictures array<string>").repartition(3)
    got = sink.save_articles(df, str(tmp_path / "out"), author="author", images="pictures", key="k")
    told = {r.path or r.title: (r.title, r.author, r.status, r.size, r.images) for r in got.collect()}
    assert told == {
        "A_b_ c-1/article.md": ("A/b: c", "Ann", "ok", "7 bytes", 3), "A_b_ c-2/article.md": ("A/b: c", "-", "ok", "2.5 KB", 0), "article-3/article.md": ("article", "Bo", "ok", "1 bytes", 0),
        "none": ("none", "-", "failed", "No content to save", None), "nil": ("nil", "-", "failed", "No content to save", None), "__-6/article.md": ("..", "-", "ok", "4 bytes", 0),
    }
    for r in got.where("status = 'ok'").collect():
        content = (tmp_path / "out" / r.part / r.path).read_text()
        assert content == next(c for k, _, c, _, _ in rows if r.path.split("/")[0].endswith(f"-{k}"))
    before = there(tmp_path / "out")
    broken = df.mapInArrow(killed(1), df.schema)
    with pytest.raises(Exception):
        sink.save_articles(broken, str(tmp_path / "out"), key="k")
    assert there(tmp_path / "out") == before
    assert sink.save_articles(df.limit(1), str(tmp_path / "out"), key="k").count() == 1 and len(there(tmp_path / "out")) == 3
    assert sink.save_articles(df.limit(0), str(tmp_path / "none")).count() == 0


def test_image_names(spark):
    urls = ["https://a.example/x.png", "https://a.example/x.png", "//b.example/y?wx_fmt=gif&a=1", "https://c.example/z.tar.webp#top", "https://d.example/plain", "https://e.example/p.JPEG?x=1.5", "https://f.example/q.toolong"]
    df = spark.createDataFrame([(1, urls)], "k int, images array<string>")
    assert [r.file for r in steps.image_names(df, "images", "k").orderBy("position").collect()] == ["img_001.png", "img_002.gif", "img_003.webp", "img_004.jpg", "img_005.5", "img_006.jpg"]
