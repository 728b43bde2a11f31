"""Stored queries: YAML with parameters, columns and steps, run as chained DataFrames.

Expressions are Spark SQL, parsed and optimized by Spark; a row is ``item``, parameters are ``args.name`` and reach SQL
as named parameters, never as text. A string with ``${{ … }}`` marks is an expression if it is one mark, else text with
the marks' values in it. In a mark, what an expression gives can go on through filters: ``item.title | truncate(30)``.
"""

from __future__ import annotations

import ast
import os
import re
import threading
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text
from millrace.functions.values import Values
from millrace.operators import groups, joins, order, pages, sets, steps, windows
from millrace.operators.steps import StepError
from millrace.plans import table_functions
from millrace.sources import read

#: A mark ends at the first two braces outside quotes and inner braces.
MARK = re.compile(r"""\$\{\{((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\{[^{}]*\}|[^{}'"]|[{'"](?!\}\})|\}(?!\}))*?)\}\}""", re.S)
#: Texts in quotes, which rewriting leaves alone, and other pieces of an expression.
QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
#: Steps that only act on a page; rows pass through them.
PAGE_STEPS = ("navigate", "click", "type", "wait", "press", "scroll", "screenshot")
#: Rows up to which a limit makes positions by one window.
FEW = 100_000

#: What a value in a mark can go through: a function of Values over the frame, the value and the arguments.
FILTERS: dict[str, Callable[..., Column]] = {
    "default": lambda v, x, other="": text.default(*v.common(x, F.lit(other))), "join": lambda v, x, separator=",": text.join(x, separator),
    "upper": lambda v, x: text.upper(x), "lower": lambda v, x: text.lower(x), "trim": lambda v, x: text.trim(x),
    "truncate": lambda v, x, n=50: text.truncate(x, n), "replace": lambda v, x, old, new: text.replace(x, old, new),
    "keys": lambda v, x: v.keys(x), "length": lambda v, x: v.length(x), "first": lambda v, x: text.first(x), "last": lambda v, x: text.last(x), "json": lambda v, x: v.json(x),
    "slugify": lambda v, x: text.slugify(x), "sanitize": lambda v, x: text.sanitize(x), "ext": lambda v, x: text.ext(x), "basename": lambda v, x: text.basename(x),
    "urlencode": lambda v, x: text.urlencode(x), "urldecode": lambda v, x: text.urldecode(x),
    "abs": lambda v, x: text.absolute(x), "round": lambda v, x: text.rounded(x), "ceil": lambda v, x: text.ceiling(x), "floor": lambda v, x: text.floor(x),
    "string": lambda v, x: v.shown(x), "str": lambda v, x: v.shown(x), "int": lambda v, x: v.whole_number(x), "float": lambda v, x: v.double(x),
    "reverse": lambda v, x: text.reverse(x), "unique": lambda v, x: text.unique(x), "split": lambda v, x, separator=",": text.split(x, separator),
}
#: Functions for ``evaluate``, by name: of a run, a DataFrame and the step's other settings.
FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


def pieces(what: str, mark: str) -> list[str]:
    """``what`` parted at each ``mark`` (``|``, ``&&``, ``||`` or a comma) outside quotes and brackets."""
    out, depth = [""], 0
    for piece in re.findall(rf"{QUOTED}|\|\||&&|.", what, re.S):
        depth += (piece in "([{") - (piece in ")]}") if len(piece) == 1 else 0
        if piece == mark and not depth:
            out.append("")
        else:
            out[-1] += piece
    return [x.strip() for x in out]


def enclosed(what: str) -> bool:
    """Whether the bracket that ``what`` begins with closes at its end."""
    depth, found = 0, re.findall(rf"{QUOTED}|.", what, re.S)
    for i, piece in enumerate(found):
        depth += (piece == "(") - (piece == ")")
        if not depth:
            return i == len(found) - 1
    return False


@dataclass
class Argument:
    name: str
    type: str = "str"
    required: bool = False
    default: object = None
    choices: list[str] = field(default_factory=list)

    def value(self, given: object) -> object:
        """What was given, in the argument's type; an error names the argument."""
        if given is None:
            if self.required and self.default is None:
                raise StepError(f"{self.name} is required")
            return self.default
        if self.choices and str(given) not in map(str, self.choices):
            raise StepError(f"{self.name} is none of {', '.join(map(str, self.choices))}")
        told = str(given).lower()
        try:
            if self.type == "int":
                return int(given)
            if self.type == "number":
                return float(given)
        except ValueError:
            raise StepError(f"{self.name} is no {self.type}: {given!r}") from None
        if self.type in ("bool", "boolean"):
            if told not in ("true", "1", "yes", "false", "0", "no"):
                raise StepError(f"{self.name} is no bool: {given!r}")
            return told in ("true", "1", "yes")
        return str(given)


@dataclass
class StoredQuery:
    site: str
    name: str
    steps: list[tuple[str, object]]
    args: list[Argument] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    description: str = ""
    func: Callable[[SparkSession, dict], DataFrame] | None = None
    timeout: float | None = None  # seconds, for ``execute``

    def bind(self, given: dict) -> dict:
        unknown = set(given) - {a.name for a in self.args}
        if unknown:
            raise StepError(f"unknown arguments: {', '.join(sorted(unknown))}")
        return {a.name: a.value(given.get(a.name)) for a in self.args}

    @property
    def needs_capture(self) -> bool:
        return any(name in (*PAGE_STEPS, "intercept", "collect", "snapshot", "evaluate") for name, _ in self.steps)


def parse(text: str) -> StoredQuery:
    """A query from YAML; an error tells what is missing."""
    import yaml

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or not raw.get("site") or not raw.get("name"):
        raise StepError("a stored query has a site and a name")
    args = [Argument(n, **{k: v for k, v in (a or {}).items() if k in ("type", "required", "default", "choices")}) for n, a in (raw.get("args") or {}).items()]
    found = []
    for i, step in enumerate(raw.get("pipeline") or []):
        if not isinstance(step, dict) or len(step) != 1:
            raise StepError(f"step {i} has not one name")
        (name, what), = step.items()
        if name not in STEPS and name not in PAGE_STEPS:
            raise StepError(f"step {i}: no step {name}")
        found.append((name, what))
    timeout = next((raw[k] for k in ("timeout", "timeoutSeconds", "timeout_seconds") if raw.get(k) is not None), None)
    if timeout is not None and (isinstance(timeout, bool) or not isinstance(timeout, (int, float)) or timeout <= 0):
        raise StepError(f"a timeout is a number of seconds: {timeout!r}")
    return StoredQuery(raw["site"], raw["name"], found, args, raw.get("columns") or [], raw.get("description") or "", timeout=timeout)


def load(*folders: str) -> dict[tuple[str, str], StoredQuery]:
    """The queries in ``.yaml`` and ``.yml`` files below the folders, by (site, name), later folders first; files that can't be read are warned of."""
    found = {}
    for folder in folders:
        for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml")):
            try:
                q = parse(path.read_text(encoding="utf-8"))
            except Exception as e:  # one bad file must not hide the others
                warnings.warn(f"{path}: {e}", stacklevel=2)
                continue
            found[q.site, q.name] = q
    return found


def catalog(spark: SparkSession, queries: dict[tuple[str, str], StoredQuery]) -> DataFrame:
    rows = [(q.site, q.name, q.description, [a.name for a in q.args], q.columns, [n for n, _ in q.steps]) for _, q in sorted(queries.items())]
    return spark.createDataFrame(rows, "site string, name string, description string, args array<string>, columns array<string>, steps array<string>")


class Run:
    """One run of a stored query: the tables, the bound arguments and the order that the rows have."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame], args: dict) -> None:
        self.spark, self.tables, self.args = spark, tables, args
        self.order: list[tuple[str, bool]] = []  # column, whether descending
        self.bound: int | None = None  # rows at most, if a limit says so
        self.captured: DataFrame | None = None  # the requests that ``intercept`` has seen

    def keys(self) -> list[Column]:
        return [F.desc_nulls_first(f"`{c}`") if descending else F.asc_nulls_last(f"`{c}`") for c, descending in self.order]

    def settle(self, df: DataFrame) -> None:
        """Forgets an order by columns that a step has taken away: its rows have none then."""
        if not {c for c, _ in self.order} <= set(df.columns):
            self.order = []

    def sql(self, df: DataFrame, select: str, tail: str = "") -> DataFrame:
        """``SELECT select FROM df AS item tail``; ``args.x`` is the named parameter x."""
        used: set[str] = set()

        def bound(m: re.Match) -> str:
            if m[1] is None:
                return m[0]
            used.add(m[1])
            return f":{m[1]}"

        query = re.sub(rf"{QUOTED}|(?<![\w.])args\.([A-Za-z_]\w*)", bound, f"SELECT {select} FROM \0 AS item {tail}", flags=re.S)
        query = known_fields(query, df.schema, self.spark.conf.get("spark.sql.caseSensitive") == "true")
        query = query.replace("{", "{{").replace("}", "}}").replace("\0", "{__rows}")  # braces are the query's own
        return self.spark.sql(query, args={k: v for k, v in self.args.items() if k in used}, __rows=df)

    def piped(self, df: DataFrame, what: object) -> tuple[DataFrame, object]:
        """``df`` with a column for each mark in ``what`` whose value goes through filters, and ``what`` with the columns' names for these marks."""
        if isinstance(what, dict):
            out = {}
            for k, v in what.items():
                df, out[k] = self.piped(df, v)
            return df, out
        if isinstance(what, list):
            members = []
            for v in what:
                df, v = self.piped(df, v)
                members.append(v)
            return df, members
        if not isinstance(what, str):
            return df, what
        for m in list(MARK.finditer(what)):
            if len(pieces(m[1], "|")) > 1:
                df, name = self.filtered_value(df, m[1])
                what = what.replace(m[0], "${{ item.`" + name + "` }}", 1)
        return df, what

    def filtered_value(self, df: DataFrame, what: str) -> tuple[DataFrame, str]:
        """``df`` with a column for an expression and the filters behind it, and its name."""
        start, *rest = pieces(what, "|")
        name = f"__p{sum(c.startswith('__p') for c in df.columns)}"
        df = self.sql(df, f"*, ({start}) AS `{name}`")
        for call in rest:
            m = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", call, re.S)
            if not m or m[1] not in FILTERS:
                raise StepError(f"no filter {call!r}")
            given = [self.constant(x) for x in pieces(m[2] or "", ",") if x]
            try:
                df = df.withColumn(name, FILTERS[m[1]](Values(df), F.col(f"`{name}`"), *given))
            except TypeError as e:
                raise StepError(f"filter {call!r}: {e}") from None
        return df, name

    def constant(self, what: str) -> object:
        """A filter's argument: a number, a text or a parameter."""
        if m := re.fullmatch(r"args\.(\w+)", what):
            return self.args[m[1]]
        try:
            return ast.literal_eval({"true": "True", "false": "False", "null": "None"}.get(what, what))
        except (ValueError, SyntaxError):
            raise StepError(f"{what!r} is no constant") from None

    def truth(self, df: DataFrame, what: object) -> tuple[DataFrame, Column, str | None]:
        """``df``, a column that says which rows meet a condition, and its SQL if it is a plain one.

        Conditions are SQL; of any kind, as truthy; joined by ``&&`` and ``||``, negated by ``!``; or a list, all of which must hold.
        """
        for mark, add in (("||", Column.__or__), ("&&", Column.__and__)):
            some = what if isinstance(what, list) else pieces(self.condition(what), mark)
            if isinstance(what, list) or len(some) > 1:
                out = None
                for x in some:
                    df, here, _ = self.truth(df, x)
                    out = here if out is None else (Column.__and__ if isinstance(what, list) else add)(out, here)
                return df, F.lit(True) if out is None else out, None
        plain = self.condition(what).strip()
        if plain.startswith("!") and not plain.startswith("!="):
            df, here, _ = self.truth(df, plain[1:])
            return df, ~here, None
        if plain.startswith("(") and plain.endswith(")") and enclosed(plain):
            return self.truth(df, plain[1:-1])
        if len(pieces(plain, "|")) > 1:
            df, name = self.filtered_value(df, plain)
            return df, Values(df).truthy(F.col(f"`{name}`")), None
        if self.sql(df.limit(0), f"({plain}) AS x").schema[0].dataType.simpleString() == "boolean":
            name = f"__p{sum(c.startswith('__p') for c in df.columns)}"
            df = self.sql(df, f"*, coalesce(({plain}), false) AS `{name}`")
            return df, F.col(f"`{name}`"), plain
        name = f"__p{sum(c.startswith('__p') for c in df.columns)}"
        df = self.sql(df, f"*, ({plain}) AS `{name}`")
        return df, Values(df).truthy(F.col(f"`{name}`")), None

    def expression(self, what: object) -> str:
        """Spark SQL for a constant, a text, a text with marks, or a list or record of such."""
        if isinstance(what, dict):
            return "named_struct(" + ", ".join(f"{quoted(k)}, {self.expression(v)}" for k, v in what.items()) + ")"
        if isinstance(what, list):
            return "array(" + ", ".join(map(self.expression, what)) + ")"
        if not isinstance(what, str):
            return "NULL" if what is None else str(what)
        marks = MARK.findall(what)
        if not marks:
            return quoted(what)
        if MARK.fullmatch(what.strip()) and len(marks) == 1:
            return f"({marks[0].strip()})"
        parts = MARK.split(what)
        return "concat(" + ", ".join(quoted(p) if i % 2 == 0 else f"coalesce(CAST(({p.strip()}) AS STRING), '')" for i, p in enumerate(parts) if i % 2 or p) + ")"

    def condition(self, what: str) -> str:
        marks = MARK.findall(what)
        if marks and not MARK.fullmatch(what.strip()):
            raise StepError(f"a condition is one expression: {what!r}")
        return marks[0] if marks else what

    def number(self, what: object) -> int:
        """A limit: a number, or one mark over the arguments, computed here."""
        if isinstance(what, str) and MARK.search(what):
            what = self.sql(self.spark.range(1), f"{self.condition(what)} AS n").first()["n"]
        return steps.count_of(what)

    def indexed(self, df: DataFrame, what: object) -> DataFrame:
        """``df`` with its rows' positions as ``index``, if an expression names it."""
        if "index" in df.columns or not re.search(r"\bindex\b", re.sub(QUOTED, "", marked(what), flags=re.S)):
            return df
        if not self.order:
            raise StepError("positions need an order: give the source a key, or sort")
        return order.rank_few(df, self.keys()) if self.bound is not None and self.bound <= FEW else order.with_position(df, self.keys())

    def requests(self, name: str | None = None) -> DataFrame:
        """The request log: a table ``requests``, or one named."""
        return self.tables(name or "requests")


def marked(what: object) -> str:
    """All expressions in the marks of a value."""
    if isinstance(what, (dict, list)):
        return " ".join(map(marked, what.values() if isinstance(what, dict) else what))
    return " ".join(MARK.findall(what)) if isinstance(what, str) else ""


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: A field of a row, and what is taken of it.
FIELD = re.compile(rf"{QUOTED}|(?<![\w.`])item((?:\s*\.\s*(?:[A-Za-z_]\w*|`[^`]+`)|\[[^\[\]]*\])+)(?!\s*\()", re.S)


def known_fields(query: str, schema: T.StructType, exact: bool) -> str:
    """``query`` with NULL for every field of ``item`` that its rows don't have, as rows of other shapes may; what is taken of such a field is null too."""
    same = (lambda a, b: a == b) if exact else (lambda a, b: a.lower() == b.lower())

    def told(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        kind: T.DataType = schema
        for piece in re.findall(r"`[^`]+`|\w+|\[[^\[\]]*\]", re.sub(r"\[[^\[\]]*\]", "[0]", m[1])):
            if isinstance(kind, T.StructType) and not piece.startswith("["):
                found = [f for f in kind.fields if same(f.name, piece.strip("`"))]
                if not found:
                    return "NULL"
                kind = found[0].dataType
            elif isinstance(kind, T.MapType):
                kind = kind.valueType
            elif isinstance(kind, T.ArrayType):
                kind = kind.elementType
            elif isinstance(kind, (T.StructType, T.VariantType)):
                return m[0]  # by position or path: Spark's to judge
            else:
                return "NULL"  # a number or a text has no fields
        return m[0]

    return FIELD.sub(told, query)


def source(run: Run, df: DataFrame | None, what: object) -> DataFrame:
    """A table by name, or files: ``{file: path, kind: json, schema: ...}``; ``key`` names what its rows are ordered by."""
    what = {"table": what} if isinstance(what, str) else what
    run.order = [(c, False) for c in ([what["key"]] if isinstance(what.get("key"), str) else what.get("key", []))]
    run.bound = None
    return read.records(run.spark, what["file"], what.get("kind"), what.get("schema")) if "file" in what else run.tables(what["table"])


def mapped(run: Run, df: DataFrame, what: object) -> DataFrame:
    df, what = run.piped(run.indexed(df, what), what)
    hidden = {f"__o{i}": F.col(f"`{c}`") for i, (c, _) in enumerate(run.order)}  # what the rows are ordered by goes along
    df = df.withColumns(hidden) if hidden else df
    run.order = [(name, descending) for name, (_, descending) in zip(hidden, run.order)]
    wanted = what.items() if isinstance(what, dict) else [("value", what)]
    out = run.sql(df, ", ".join([*(f"{run.expression(v)} AS `{k}`" for k, v in wanted), *hidden]))
    return out.withColumns({k: F.col(f"`{k}`").cast("string") for k, kind in out.dtypes if kind == "void"})  # null without a kind can't be stored


def filtered(run: Run, df: DataFrame, what: object) -> DataFrame:
    named = run.indexed(df, [f"${{{{ {run.condition(x)} }}}}" for x in (what if isinstance(what, list) else [what])])
    with_truth, holds, plain = run.truth(named, what)
    out = run.sql(named, "*", f"WHERE {plain}") if plain is not None else with_truth.where(holds)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def ordered(run: Run, df: DataFrame, what: object) -> DataFrame:
    what = {"by": what} if isinstance(what, str) else what
    new = [(what["by"], what.get("order") == "desc"), *((t, False) for t in what.get("tie", []))]
    run.order = [*((c, d) for c, d in new if c in df.columns), *run.order]  # by a field that no row has, nothing moves
    return df


def limited(run: Run, df: DataFrame, what: object) -> DataFrame:
    """The first rows; up to FEW of them by Spark's ordered limit, which holds them in one task, more by their positions."""
    n = run.number(what)
    run.bound = n if run.bound is None else min(n, run.bound)
    if run.order and n > FEW:
        return order.with_position(df, run.keys(), "__place").where(F.col("__place") < n).drop("__place")
    return (df.orderBy(*run.keys()) if run.order else df).limit(n)


def after(run: Run, df: DataFrame, what: object) -> DataFrame:
    """The rows behind the first ``what``, by their positions; few rows by Spark's ordered offset, which holds them in one task."""
    n = run.number(what)
    if not run.order:
        raise StepError("an offset needs an order: give the source a key, or sort")
    few, run.bound = run.bound is not None and run.bound <= FEW, None if run.bound is None else max(0, run.bound - n)
    if few:
        return df.orderBy(*run.keys()).offset(n)
    return order.with_position(df, run.keys(), "__place").where(F.col("__place") >= n).drop("__place")


def anew(step: Callable[[Run, DataFrame, object], DataFrame]) -> Callable[[Run, DataFrame, object], DataFrame]:
    """A step that makes rows of another kind, which have no order and no bound, of the columns that a query names."""
    def run_it(run: Run, df: DataFrame, what: object) -> DataFrame:
        run.order, run.bound = [], None
        return step(run, df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")]), what)

    return run_it


def many(step: Callable[[Run, DataFrame, object], DataFrame]) -> Callable[[Run, DataFrame, object], DataFrame]:
    """A step after which there can be more rows than a limit before it has left."""
    def run_it(run: Run, df: DataFrame, what: object) -> DataFrame:
        run.bound = None
        return step(run, df, what)

    return run_it


def intercepted(run: Run, df: DataFrame | None, what: object) -> DataFrame:
    """The captured requests whose address the pattern matches, as rows; with ``collect: false`` they wait for ``collect`` and rows stay."""
    what = {"pattern": what} if isinstance(what, str) else what
    pattern = MARK.sub(lambda m: str(run.sql(run.spark.range(1), f"({m[1]}) AS x").first()["x"]), what["pattern"])
    run.captured = read.matching(run.requests(what.get("table")), pattern)
    if what.get("collect", True):
        run.order, run.bound = [], None
        return run.captured
    return df if df is not None else run.captured.limit(0)


def collected(run: Run, df: DataFrame | None, what: dict) -> DataFrame:
    """What ``intercept`` has captured, its responses read by ``schema``, or by a function registered for ``parse``; at ``select`` if given."""
    log = run.captured if run.captured is not None else run.requests(what.get("table"))
    run.captured, run.order, run.bound = None, [], None
    if "parse" in what:
        return function_named(what["parse"])(run, log, what)
    rows = read.parsed(log, what["schema"])
    return steps.select_path(rows, what["select"]) if "select" in what else rows


def function_named(name: str) -> Callable[..., DataFrame]:
    if name not in FUNCTIONS:
        raise StepError(f"no function {name!r}: register it by stored.function")
    return FUNCTIONS[name]


def evaluated(run: Run, df: DataFrame, what: object) -> DataFrame:
    """Rows through a function that is registered by name."""
    what = {"function": what} if isinstance(what, str) else what
    run.order, run.bound = [], None
    return function_named(what["function"])(run, df, what)


def snapped(run: Run, df: DataFrame, what: dict | None) -> DataFrame:
    """The elements of every page in ``html``, by ``keys``."""
    what = what or {}
    run.order, run.bound = [], None
    return pages.snapshot(df, what.get("keys", ["page_id"]), what.get("html", "html"), bool(what.get("include_hidden", False)))


def joined(run: Run, df: DataFrame, what: dict) -> DataFrame:
    table = run.tables(what["table"])
    if what.get("how", "inner") == "left":
        right = table.select(F.col(f"`{what['right']}`").alias("__right"), *[F.col(f"`{c}`") for c in table.columns if c not in df.columns])
        return df.join(right, F.col(f"`{what['left']}`") == F.col("__right"), "left").drop("__right")
    return joins.lookup(df, table, {what["left"]: what["right"]})


def grouped(run: Run, df: DataFrame, what: dict) -> DataFrame:
    run.order, run.bound = [(k, False) for k in what["by"]], None
    keys = ", ".join(f"`{k}`" for k in what["by"])
    return run.sql(df, ", ".join([keys, *(f"{run.condition(v)} AS `{k}`" for k, v in what["agg"].items())]), f"GROUP BY {keys}")


def united(run: Run, df: DataFrame, what: object) -> DataFrame:
    names = [what] if isinstance(what, str) else what
    return sets.concat(df, *[run.tables(n).select(*df.columns) for n in names])


def tabled(run: Run, df: DataFrame, what: dict) -> DataFrame:
    """Rows through a table function, by its ``name`` and ``args``.

    Without ``partition`` it is called for each row, and the row stands before each of its rows; with it, once for the
    rows of each key, in ``order``, and its rows are the result.
    """
    table_functions.install(run.spark)
    if not re.fullmatch(r"[A-Za-z_]\w*", what["name"]):
        raise StepError(f"no table function {what['name']!r}")
    given = ", ".join(f"{k} => {run.expression(v)}" for k, v in (what.get("args") or {}).items())
    if "partition" not in what:
        run.bound = None
        out = run.sql(df, "item.*, __f.*", f", LATERAL {what['name']}({given}) AS __f")
    else:
        run.order, run.bound = [], None
        names = lambda some: "(" + ", ".join(f"`{c}`" for c in ([some] if isinstance(some, str) else some)) + ")"
        table = f"TABLE({{__rows}}) PARTITION BY {names(what['partition'])}" + (f" ORDER BY {names(what['order'])}" if what.get("order") else "")
        visible = df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])
        out = run.spark.sql(f"SELECT * FROM {what['name']}({', '.join(x for x in (f'{what.get('rows', 'rows')} => {table}', given) if x)})", __rows=visible)
    if len(set(out.columns)) < len(out.columns):
        raise StepError(f"{what['name']} gives columns that the rows have: {', '.join(sorted({c for c in out.columns if out.columns.count(c) > 1}))}")
    return out


STEPS: dict[str, Callable[[Run, DataFrame, object], DataFrame]] = {
    "table_function": tabled,
    "source": source, "fetch": source, "map": mapped, "filter": filtered, "sort": ordered, "limit": limited, "join": many(joined), "group": grouped, "union": anew(united),
    "intercept": intercepted, "collect": collected, "evaluate": evaluated, "snapshot": snapped,
    "read": anew(lambda run, df, what: pages.articles(df, (what or {}).get("keys", ["page_id", "url"]))),
    "select": anew(lambda run, df, what: steps.select_path(df, what)),
    "offset": after,
    "distinct": lambda run, df, what: groups.first_of_each(df, what["by"], what["order"]),
    "explode": many(lambda run, df, what: df.withColumn(what, F.explode(what))),
    "unpivot": many(lambda run, df, what: groups.unpivot(df, what["ids"], what["metrics"])),
    "topk": lambda run, df, what: windows.top_of_each(df, what["by"], steps.sort_keys(what["sort"], what.get("order") == "desc", what.get("tie", [])), run.number(what["k"])),
    "fallback": anew(lambda run, df, what: sets.fallback(df, *[run.tables(n).select(*df.columns) for n in ([what] if isinstance(what, str) else what)])),
    "matching": lambda run, df, what: read.matching(df, what),
    "tap": anew(lambda run, df, what: read.first_response(df, what["url"], what["order"], what.get("select"))),
    "download": lambda run, df, what: steps.download_status(df, what.get("url", "url"), what.get("type", "media")),
}


def step(name: str) -> Callable:
    """Registers a step; the last of a name counts."""
    def add(f: Callable[[Run, DataFrame, object], DataFrame]) -> Callable:
        STEPS[name] = f
        return f
    return add


def function(name: str) -> Callable:
    """Registers a function of (run, rows, settings) for ``evaluate`` and ``collect``; the last of a name counts."""
    def add(f: Callable[..., DataFrame]) -> Callable:
        FUNCTIONS[name] = f
        return f
    return add


def filter_function(name: str) -> Callable:
    """Registers a filter for marks: a function of (Values over the rows, the column, constants) to a column; the last of a name counts."""
    def add(f: Callable[..., Column]) -> Callable:
        FILTERS[name] = f
        return f
    return add


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """What ``action`` (a write, a count) returns, or a TimeoutError after ``seconds``, its Spark jobs cancelled."""
    context, group, late = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "stored query", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


#: Seconds that ``execute`` gives a query that names none, unless the environment does.
TIMEOUT, TIMEOUT_NAME = 60.0, "MILLRACE_TIMEOUT"


def execute(spark: SparkSession, query: StoredQuery, tables: Callable[[str], DataFrame], given: dict | None = None, then: Callable[[DataFrame], object] = DataFrame.collect, timeout: float | None = None) -> object:
    """What ``then`` (a collect, a write) makes of the query's result, in the seconds given here, or else by the environment's MILLRACE_TIMEOUT, the query's ``timeout``, or 60.

    The limit holds for what the steps compute as well. A query that isn't done is a TimeoutError, its jobs cancelled.
    """
    told = os.environ.get(TIMEOUT_NAME)
    try:
        seconds = timeout or (float(told) if told else None) or query.timeout or TIMEOUT
    except ValueError:
        seconds = query.timeout or TIMEOUT  # a text that is no number counts as none
    return within(spark, seconds, lambda: then(run(spark, query, tables, given)))


#: Steps that can come first.
FIRST = ("source", "fetch", "intercept", "collect")


def run(spark: SparkSession, query: StoredQuery, tables: Callable[[str], DataFrame], given: dict | None = None) -> DataFrame:
    """The query's result as a DataFrame; nothing is computed before it is used, but the positions of unlimited rows."""
    args = query.bind(given or {})
    if query.func is not None:
        return query.func(spark, args)
    held, df = Run(spark, tables, args), None
    for i, (name, what) in enumerate(query.steps):
        if name in PAGE_STEPS and name not in STEPS:
            warnings.warn(f"step {i}: {name} acts on a page; rows pass through", stacklevel=2)
            continue
        if df is None and name not in FIRST:
            raise StepError(f"step {i}: {name} has no rows before it")
        df = STEPS[name](held, df, what)
        held.settle(df)
    if df is None:
        raise StepError("the query has no source")
    out = df.orderBy(*held.keys()) if held.order else df
    hidden = [c for c in out.columns if c.startswith("__")]
    return steps.project(out, query.columns) if query.columns else out.drop(*hidden)
