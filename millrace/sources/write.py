"""Results as files, and rendered as text for people."""

from __future__ import annotations

import csv
import io
import json
import warnings

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.steps import project
from millrace.sources.sink import write_markdown

FORMATS = {"table": "table", "json": "json", "yaml": "yaml", "csv": "csv", "md": "markdown", "markdown": "markdown"}


def flat(df: DataFrame) -> DataFrame:
    """Lists, records and maps as JSON text, for formats without them."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Files of one kind, a part from each task: parquet, orc, json, csv (with a header), markdown or text.

    Markdown files are one table together, with one header in the first, and are there all or not at all (``sink``).
    """
    if kind == "csv":
        flat(df).write.option("header", "true").option("escape", '"').csv(path)
    elif kind in ("markdown", "md"):
        head, lines = markdown_rows(df)
        write_markdown(lines, head, path)
    else:
        df.write.format(kind).save(path)


def markdown_rows(df: DataFrame) -> tuple[str, DataFrame]:
    """The header of a Markdown table with its rule, and each row as a line, the pipe escaped."""
    escape = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    shown = flat(df)
    lines = shown.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[escape(F.col(f"`{c}`")) for c in shown.columns]), F.lit(" |")).alias("value"))
    head = ["| " + " | ".join(c.replace("|", "\\|") for c in df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(head) + "\n", lines


def format_of(name: str) -> str:
    """The format meant, in any case; ``table`` for names unknown."""
    return FORMATS.get(name.lower(), "table")


def plain(x: object) -> object:
    """Rows as dictionaries, at any depth."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def cell(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True, default=str) if isinstance(x, (dict, list)) else str(x)


def render(df: DataFrame | None, kind: str = "table", columns: list[str] | None = None, rows: int = 1000, title: str | None = None, seconds: float | None = None, source: str | None = None, record: bool = False) -> str:
    """The first ``rows`` rows as text. ``columns`` are shown in table, csv and markdown; json and yaml show all.

    Only these rows reach the driver; results of any size go to files with ``write``. If there are more, the line under
    table and markdown says so, and a warning does for the others. An empty table reads ``(empty)``, in csv nothing, in
    json and yaml ``[]``; no table at all reads ``(no data)``, ``null`` in json and yaml. ``record`` shows the first row
    alone: as keys and values, in json and yaml as an object. Seconds and source stand under table and markdown, if given.
    """
    kind = format_of(kind)
    if df is None:
        return {"json": "null", "yaml": "null\n", "csv": ""}.get(kind, "(no data)")
    shown = df if columns is None or kind in ("json", "yaml") else project(df, columns)
    names = shown.columns
    rows = 1 if record else rows
    got = [plain(r) for r in shown.limit(rows + 1).collect()]
    more, got = len(got) > rows and not record, got[:rows]
    if more and kind in ("json", "yaml", "csv"):
        warnings.warn(f"only the first {rows} rows are shown", stacklevel=2)
    if record and got and kind in ("json", "yaml"):
        got = got[0]
    elif record and got:
        names, got = ["key", "value"], [{"key": k, "value": got[0][k]} for k in names]
    if kind == "json":
        return json.dumps(got, ensure_ascii=False, indent=2, default=str)
    if kind == "yaml":
        import yaml

        return yaml.safe_dump(got, allow_unicode=True, sort_keys=False) if got else "[]\n"
    cells = [[cell(r[c]) for c in names] for r in got]
    if kind == "csv":
        if not got:
            return ""
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue()
    if not got:
        return "(empty)"
    if kind == "markdown":
        body = "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in line) + " |" for line in [names, ["---"] * len(names), *cells])
        head = f"## {title}\n\n" if title else ""
    else:
        widths = [max(map(len, column)) for column in zip(names, *cells)]
        line = lambda some: "| " + " | ".join(x.ljust(w) for x, w in zip(some, widths)) + " |"
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        body, head = "\n".join([rule, line(names), rule, *map(line, cells), rule]), f"{title}\n" if title else ""
    foot = " | ".join(x for x in (f"First {rows} rows" if more else "", "" if seconds is None else f"Elapsed: {elapsed(seconds)}", f"Source: {source}" if source else "") if x)
    return head + body + (f"\n\n{foot}" if foot else "")


def elapsed(seconds: float) -> str:
    return f"{round(seconds * 1000)}ms" if seconds < 1 else f"{seconds:.1f}s"
