"""Reading of web pages: element tables, article text, repeated structures. One page is parsed at a time, inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import materialized

# Elements without content, those whose text no one reads, and those that hold no article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template"}
ASIDE = {"nav", "aside", "footer", "header", "form", "button", "select"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "div", "section", "article", "br", "tr"}

ELEMENT = pa.struct([
    ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("role", pa.string()), ("id", pa.string()),
    ("class", pa.string()), ("href", pa.string()), ("src", pa.string()), ("text", pa.string()), ("hidden", pa.bool_()),
])
ELEMENT_SQL = "struct<node:int,parent:int,depth:int,tag:string,role:string,id:string,class:string,href:string,src:string,text:string,hidden:boolean>"


class Elements(HTMLParser):
    """The elements of a page in document order, with the text that is directly in each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p" and self.open and self.rows[self.open[-1]]["tag"] == "p":
            self.open.pop()
        a = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else None
        style = a.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in a or "display:none" in style or "visibility:hidden" in style or (parent is not None and self.rows[parent]["hidden"])
        self.rows.append({
            "node": len(self.rows), "parent": parent, "depth": len(self.open), "tag": tag, "role": a.get("role"), "id": a.get("id"), "class": a.get("class"),
            "href": a.get("href"), "src": a.get("src"), "text": [], "hidden": hidden,
        })
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and data.strip():
            self.rows[self.open[-1]]["text"].append(data)


def elements_of(html: str | None) -> list[dict]:
    parser = Elements()
    parser.feed(html or "")
    parser.close()
    return [r | {"text": "".join(r["text"]).strip()} for r in parser.rows]


#: Characters of pages that a task parses before it hands on what it found; a row counts as ROW more.
PARSED, ROW = 1_000_000, 1000


def portions(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows that come to PARSED characters, or of one longer text."""
    held, size = [], 0
    for k, x in enumerate(texts):
        held.append(x.as_py())
        size += len(held[-1] or "") + ROW
        if size >= PARSED:
            yield k + 1 - len(held), held
            held, size = [], 0
    if held:
        yield len(texts) - len(held), held


def with_parsed(df: DataFrame, keys: list[str], html: str, name: str, kind: pa.DataType, sql: str, parse) -> DataFrame:
    """``keys`` and what ``parse`` makes of every page. A worker holds the batch that it reads and what a few pages are parsed to."""
    names, n = list(dict.fromkeys(keys)), len(set(keys))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for first, texts in portions(table.column(n)):
                own = table.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns[:n], pa.array([parse(x) for x in texts], kind)], names=[*names, name])

    rows = df.select(*names, F.col(html).alias("__html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{name}` {sql}"]))


def snapshot(pages: DataFrame, keys: list[str], html: str = "html", hidden: bool = False) -> DataFrame:
    """The elements of every page as rows: ``keys``, node, parent, depth, tag, role, id, class (100 characters), href, src, text (200, if the element holds nothing else).

    Scripts and styles are left out, hidden elements too unless asked for. A null or empty page has none.
    """
    parsed = with_parsed(pages, keys, html, "__elements", pa.list_(ELEMENT), f"array<{ELEMENT_SQL}>", elements_of)
    parents = F.array_compact(F.transform("__elements", lambda e: e["parent"]))
    shown = F.transform("__elements", lambda e: e.withField("text", F.when(~F.array_contains(F.col("__parents"), e["node"]), e["text"])))
    rows = parsed.withColumn("__parents", F.array_distinct(parents)).select(*keys, F.explode(shown).alias("e")).select(*keys, "e.*")
    rows = rows.where(~F.col("tag").isin(*sorted(SILENT)))
    rows = rows if hidden else rows.where("NOT hidden")
    return rows.withColumns({"class": F.left("class", F.lit(100)), "text": F.left(F.nullif("text", F.lit("")), F.lit(200))}).drop("hidden")


ARTICLE = pa.struct([(n, pa.int64() if n == "length" else pa.string()) for n in ("title", "byline", "dir", "lang", "content", "textContent", "length", "excerpt", "siteName", "publishedTime")])
ARTICLE_SQL = "struct<title:string,byline:string,dir:string,lang:string,content:string,textContent:string,length:bigint,excerpt:string,siteName:string,publishedTime:string>"


class Article(HTMLParser):
    """Text blocks of a page, each with the container that it is in and how much of it is link text, and what the head says."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.titles: dict[str, list[str]] = {"title": [], "h1": []}
        self.open: list[tuple[str, int]] = []
        self.blocks: list[tuple[int, str, list[str]]] = []  # container, tag, text
        self.linked: dict[int, int] = {}
        self.count = 0
        self.fresh = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.meta |= {k: a[k] for k in ("lang", "dir") if k in a}
        if tag == "meta" and (key := a.get("property") or a.get("name") or a.get("itemprop")):
            self.meta.setdefault(key.lower(), a.get("content", ""))
        if tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        if tag in BLOCKS:
            self.fresh = True
        if tag not in VOID:
            self.count += 1
            self.open.append((tag, self.count))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        tags = [t for t, _ in self.open]
        for t in self.titles:
            if t in tags:
                self.titles[t].append(data)
        if not data.strip() or any(t in SILENT or t in ASIDE or t == "title" for t in tags):
            return
        holders = [i for t, i in self.open if t in ("article", "main")] or [i for t, i in self.open if t in ("section", "div", "td", "body", "html")]
        home = holders[-1] if holders else 0
        if self.fresh or not self.blocks or self.blocks[-1][0] != home:
            self.blocks.append((home, next((t for t in reversed(tags) if t in BLOCKS), "p"), []))
            self.fresh = False
        self.blocks[-1][2].append(data)
        if "a" in tags:
            self.linked[home] = self.linked.get(home, 0) + len(data)


def article_of(html: str | None) -> dict | None:
    page = Article()
    page.feed(html or "")
    page.close()
    blocks = [(home, tag, " ".join("".join(t).split())) for home, tag, t in page.blocks]
    weight: dict[int, float] = {}
    for home, _, text in blocks:
        weight[home] = weight.get(home, 0) + len(text) + 25 * text.count(",")
    for home, n in page.linked.items():
        weight[home] -= 2 * n
    if not weight:
        return None
    best = max(weight, key=lambda h: (weight[h], -h))
    own = [(tag, text) for home, tag, text in blocks if home == best]
    text = "\n".join(t for _, t in own)
    title = " ".join("".join(page.titles["title"] or page.titles["h1"]).split()) or None
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    return {
        "title": page.meta.get("og:title") or title, "byline": page.meta.get("author"), "dir": page.meta.get("dir"), "lang": page.meta.get("lang"),
        "content": "".join(f"<{g}>{escape(t)}</{g}>" for g, t in ((g if g[0] == "h" or g in ("li", "blockquote", "pre") else "p", t) for g, t in own)),
        "textContent": text, "length": len(text),
        "excerpt": page.meta.get("description") or page.meta.get("og:description") or next((t for g, t in own if g == "p"), None),
        "siteName": page.meta.get("og:site_name"), "publishedTime": page.meta.get("article:published_time") or page.meta.get("time"),
    }


def articles(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """The article of every page: ``keys``, title, byline, dir, lang, content, textContent, length, excerpt, siteName, publishedTime.

    The article is the ``article`` or ``main`` element, or else the container, with most text and commas and least link
    text. Navigation, scripts and forms are no part of it. A page without text has nulls.
    """
    return with_parsed(pages, keys, html, "__article", ARTICLE, ARTICLE_SQL, article_of).select(*keys, "__article.*")


def markdown(title: Column, content: Column) -> Column:
    """An article's content as Markdown, under its title."""
    out = content
    for n in range(1, 7):
        out = F.regexp_replace(out, f"<h{n}>(.*?)</h{n}>", "#" * n + " $1\n\n")
    out = F.regexp_replace(F.regexp_replace(out, "<li>(.*?)</li>", "- $1\n"), "<(?:p|pre|blockquote)>(.*?)</(?:p|pre|blockquote)>", "$1\n\n")
    return F.concat(F.coalesce(F.concat(F.lit("# "), title, F.lit("\n\n")), F.lit("")), F.replace(F.replace(out, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")))


def signatures(elements: DataFrame, keys: list[str]) -> DataFrame:
    """``snapshot`` rows with ``signature``: tag, class, role, how many children (in ranges from 5 on) and the first four children's tags."""
    kids = elements.where("parent IS NOT NULL").groupBy(*keys, F.col("parent").alias("node")).agg(F.count("*").alias("__n"), F.array_sort(F.collect_list(F.struct("node", "tag"))).alias("__kids"))
    joined = elements.join(kids, [*keys, "node"], "left")
    n = F.coalesce("__n", F.lit(0))
    size = F.when(n <= 4, n.cast("string")).when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")
    tags = F.concat(F.array_join(F.transform(F.slice("__kids", 1, 4), lambda k: F.concat(k["tag"], F.lit(","))), ""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return joined.withColumn("signature", F.concat_ws("|", "tag", F.trim(text("class")), text("role"), size, F.coalesce(tags, F.lit("")))).drop("__n", "__kids")


def repeated_runs(elements: DataFrame, keys: list[str], depth: int = 8, least: int = 4) -> DataFrame:
    """Runs of ``least`` or more neighbouring siblings with one signature, ``depth`` or deeper: keys, parent, signature, first_node, n."""
    rows = signatures(elements, keys).where(F.col("depth") >= depth)
    among = Window.partitionBy(*keys, "parent").orderBy("node")
    alike = Window.partitionBy(*keys, "parent", "signature").orderBy("node")
    islands = rows.withColumn("__run", F.row_number().over(among) - F.row_number().over(alike))
    return islands.groupBy(*keys, "parent", "signature", "__run").agg(F.min("node").alias("first_node"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__run")


def list_selector(elements: DataFrame, keys: list[str], examples: Column) -> DataFrame:
    """(keys, selector) that finds the elements marked by ``examples`` and their like: the tag, and the classes that all of them have; null if tags or depths differ."""
    some = elements.where(examples).withColumn("__classes", F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: c != ""))))
    each = some.select(*keys, "node", "tag", "depth", F.explode_outer("__classes").alias("__class"))
    per = each.groupBy(*keys, "__class").agg(F.count_distinct("node").alias("__n"))
    whole = some.groupBy(*keys).agg(F.count("*").alias("__all"), F.min("tag").alias("tag"), F.max("tag").alias("__tag"), F.min("depth").alias("__d"), F.max("depth").alias("__e"))
    shared = whole.join(per, keys, "left").groupBy(*keys, "tag", "__tag", "__d", "__e").agg(F.array_sort(F.collect_set(F.when(F.col("__n") == F.col("__all"), F.col("__class")))).alias("__shared"))
    selector = F.concat("tag", F.array_join(F.transform("__shared", lambda c: F.concat(F.lit("."), c)), ""))
    return shared.select(*keys, F.when((F.col("tag") == F.col("__tag")) & (F.col("__d") == F.col("__e")), selector).alias("selector"))


# The beginnings of class names that styling tools make, which say nothing of what an element is; classes of a piece.
STYLING, PIECE_CLASSES, PIECE_LENGTH = r"^(js-|_|svelte-|css-|sc-|styled-|w-|h-|p-|m-|text-|bg-|flex-|grid-|col-|row-)", 3, 40
PATH = "array<struct<node:long,tag:string,classes:array<string>>>"


def ancestor_paths(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, node, path) of every element: its ancestors from the top, and itself last, as struct<node, tag, classes>.

    Each round doubles how far up a path goes, so there are as many as the logarithm of the depth. A parent that isn't
    among the elements ends a path. ``classes`` are the first three that no styling tool has made.
    """
    named = F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: (c != "") & (F.length(c) < PIECE_LENGTH) & ~c.rlike(STYLING))
    own = F.struct(F.col("node").cast("long").alias("node"), "tag", F.slice(named, 1, PIECE_CLASSES).alias("classes"))
    now = materialized(elements.select(F.struct(*keys).alias("__page"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("up"), F.array(own).cast(PATH).alias("path")))
    for _ in range(40):
        if now.where("up IS NOT NULL").isEmpty():
            break
        ahead = now.select(F.col("__page").alias("__p"), F.col("node").alias("__at"), F.col("up").alias("__up"), F.col("path").alias("__before"))
        joined = now.join(ahead, (F.col("__page") == F.col("__p")) & (F.col("up") == F.col("__at")), "left")
        now = materialized(joined.select("__page", "node", F.col("__up").alias("up"), F.concat(F.coalesce("__before", F.array().cast(PATH)), "path").alias("path")))
    return now.select("__page.*", "node", "path")


def path_selector(elements: DataFrame, keys: list[str], examples: Column) -> DataFrame:
    """(``keys``, container, container_tag, selector, n) of every page with elements marked by ``examples``: a path that leads from the nearest element that holds all of them to each.

    A level's piece is the tag and the classes that all have there, in the order of the first. ``selector`` is null for a
    single example, for examples at different depths below the container, or of different tags at a level, or of which
    one holds another. Levels are compared by counts, so a page of many examples is not gathered.
    """
    chosen = elements.where(examples).select(*keys, "node").distinct()
    pages_of = elements.join(chosen.select(*keys).distinct(), keys, "left_semi")
    paths = ancestor_paths(pages_of, keys).join(chosen, [*keys, "node"], "left_semi")
    levels = materialized(paths.select(*keys, "node", F.size("path").alias("__size"), F.posexplode("path").alias("__level", "__step")))
    whole = paths.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.size("path")).alias("__low"), F.max(F.size("path")).alias("__high"))
    each = levels.groupBy(*keys, "__level").agg(F.count("*").alias("__n"), F.min("__step.node").alias("__first"), F.max("__step.node").alias("__last"), F.min("__step.tag").alias("__tag"), F.max("__step.tag").alias("__other"))
    each = each.join(whole, keys).withColumn("__same", (F.col("__n") == F.col("n")) & (F.col("__first") == F.col("__last")))
    common = each.groupBy(*keys).agg(F.max(F.when(F.col("__same"), F.struct("__level", F.col("__first").alias("node"), F.col("__tag").alias("tag")))).alias("__top"))
    split = levels.select(*keys, "__level", "node", F.posexplode_outer("__step.classes").alias("__at", "__class"))
    shared = split.groupBy(*keys, "__level", "__class").agg(F.count_distinct("node").alias("__n"), F.min_by("__at", "node").alias("__at")).join(whole.select(*keys, "n"), keys)
    shared = shared.where((F.col("__n") == F.col("n")) & F.col("__class").isNotNull()).groupBy(*keys, "__level").agg(F.array_sort(F.collect_list(F.struct("__at", "__class"))).alias("__classes"))
    piece = F.concat("__tag", F.array_join(F.transform(F.coalesce("__classes", F.array().cast("array<struct<__at:int,__class:string>>")), lambda c: F.concat(F.lit("."), c["__class"])), ""))
    below = each.join(common, keys).where(F.col("__top").isNull() | (F.col("__level") > F.col("__top.__level"))).join(shared, [*keys, "__level"], "left")
    parts = below.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__level", piece.alias("piece")))).alias("__parts"), F.bool_and(F.col("__tag") == F.col("__other")).alias("__alike"))
    out = whole.join(common, keys).join(parts, keys, "left")
    fit = (F.col("n") >= 2) & (F.col("__low") == F.col("__high")) & F.col("__top").isNotNull() & F.coalesce("__alike", F.lit(False))
    return out.select(*keys, F.col("__top.node").alias("container"), F.col("__top.tag").alias("container_tag"), F.when(fit, F.array_join(F.transform("__parts", lambda p: p["piece"]), " > ")).alias("selector"), "n")
