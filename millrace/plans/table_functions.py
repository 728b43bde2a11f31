"""Table functions in SQL and stored queries: several rows from a value, or from a table's rows by key and in order; what columns they have follows from their arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Table functions by the name that SQL knows them by.
TABLE_FUNCTIONS: dict[str, object] = {}


def table_function(name: str):
    """Registers a class with ``analyze`` and ``eval`` as a table function; the last of a name counts."""
    def add(cls: type) -> type:
        TABLE_FUNCTIONS[name] = cls
        return cls
    return add


def install(spark: SparkSession) -> None:
    """Makes all table functions known to a session's SQL."""
    for name, cls in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))


def constant(argument: AnalyzeArgument | None, name: str, default: object = None) -> object:
    """The value of an argument that the columns follow from."""
    if argument is None:
        return default
    if argument.isTable or argument.value is None:
        raise ValueError(f"{name} is a constant that is not null")
    return argument.value


@table_function("parse_lines")
class ParseLines:
    """``parse_lines(text, columns, separator)``: a row for each line of a text that isn't blank, with its number from 0 and a column for each name in ``columns``.

    Fields are parted by ``separator``, a comma if it isn't given; missing ones are null, and what is too much belongs to
    the last. A name may say a type, ``n int``; what is no such value is null. A null text has no rows.
    """

    KINDS = {"string": T.StringType(), "int": T.LongType(), "double": T.DoubleType()}

    @staticmethod
    def fields(columns: str) -> list[tuple[str, str]]:
        found = [(*c.split(), "string")[:2] for c in columns.split(",") if c.strip()]
        if not found or len({n for n, _ in found}) < len(found) or any(k not in ParseLines.KINDS for _, k in found):
            raise ValueError(f"columns are different names, each with a type of {', '.join(ParseLines.KINDS)}: {columns!r}")
        return found

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument, separator: AnalyzeArgument = None) -> AnalyzeResult:
        constant(separator, "separator")
        named = [T.StructField(n, ParseLines.KINDS[k]) for n, k in ParseLines.fields(constant(columns, "columns"))]
        return AnalyzeResult(T.StructType([T.StructField("line", T.LongType()), *named]))

    def eval(self, text: str, columns: str, separator: str = ",") -> Iterator[tuple]:
        fields = self.fields(columns)
        for number, line in enumerate((text or "").split("\n")):
            if line.strip():
                parts = [p.strip() for p in line.split(separator, len(fields) - 1)]
                yield (number, *(self.value(parts[i] if i < len(parts) else None, k) for i, (_, k) in enumerate(fields)))

    @staticmethod
    def value(x: str | None, kind: str) -> object:
        if x is None or kind == "string":
            return x
        try:
            return int(x) if kind == "int" else float(x)
        except ValueError:
            return None


@table_function("number_sessions")
class NumberSessions:
    """``number_sessions(TABLE(rows) PARTITION BY key ORDER BY time, time, gap)``: the rows with the number of their session in the key, from 0.

    A session begins where ``time`` (a column of numbers, by name) is more than ``gap`` after the row before. Rows stream
    through in the order that the call names, and one time is kept; a key is one task, as every partition of a call is.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, time: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        name = constant(time, "time")
        constant(gap, "gap")
        if not rows.isTable or name not in rows.dataType.names:
            raise ValueError(f"the rows have no column {name}")
        if "session" in rows.dataType.names:
            raise ValueError("the rows have a column session already")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("session", T.LongType())]))

    def __init__(self) -> None:
        self.latest, self.session = None, 0

    def eval(self, rows: T.Row, time: str, gap: float) -> Iterator[tuple]:
        at = rows[time]
        if at is not None:
            self.session += self.latest is not None and at - self.latest > gap
            self.latest = at
        yield (*rows, int(self.session))
