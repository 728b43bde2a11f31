"""Values whose kinds mix, as records from the web have them: truth, arithmetic, comparison, text.

A missing operand never raises: arithmetic on it gives null, comparison false. Kinds are read from the frame's schema
when the expression is built, so every result is a plain built-in expression that Catalyst can optimize.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a number: no white space around it, as in ``1``, ``-2.5``, ``.5``, ``1e3``, ``inf``, ``nan``.
NUMERIC = r"^[+-]?(?i:inf|infinity|nan|\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?)$"
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def parsed(text: Column) -> Column:
    """The number that a text is, as double, else null."""
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def finite(number: Column) -> Column:
    """Null for NaN and the infinities, which records can't hold."""
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def sorted_record(x: Column, kind: T.DataType) -> Column:
    """The value with the keys of every record and map in it in code-point order."""
    if isinstance(kind, T.StructType):
        names = sorted(f.name for f in kind.fields)
        own = F.struct(*[sorted_record(x.getField(n), kind[n].dataType).alias(n) for n in names])
        return F.when(x.isNotNull(), own)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: sorted_record(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(x)))
    return x


class Values:
    """Expressions over the columns of ``df``.

    A whole number stays a bigint under + - * %, other results are doubles, and NaN and infinities become null.
    """

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def kind(self, x: Column) -> T.DataType:
        return self.df.select(x.alias("x")).schema[0].dataType

    def is_number(self, x: Column) -> bool:
        return isinstance(self.kind(x), T.NumericType)

    def is_whole(self, x: Column) -> bool:
        return isinstance(self.kind(x), WHOLE)

    def is_text(self, x: Column) -> bool:
        return isinstance(self.kind(x), T.StringType)

    def number(self, x: Column) -> Column:
        """As double: numbers and texts that are numbers; anything else, booleans too, is null."""
        if self.is_number(x):
            return x.cast("double")
        return parsed(x) if self.is_text(x) else F.lit(None).cast("double")

    def truthy(self, x: Column) -> Column:
        """False for null, false, 0, empty text, list, record and map."""
        kind = self.kind(x)
        if isinstance(kind, T.BooleanType):
            own = x
        elif isinstance(kind, T.NumericType):
            own = x != 0
        elif isinstance(kind, T.StringType):
            own = x != ""
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            own = F.size(x) > 0
        elif isinstance(kind, T.StructType):
            own = F.lit(len(kind.fields) > 0) & x.isNotNull()
        elif isinstance(kind, T.NullType):
            own = F.lit(False)
        else:
            own = x.isNotNull()
        return F.coalesce(own, F.lit(False))

    def negated(self, x: Column) -> Column:
        return ~self.truthy(x)

    def common(self, *some: Column) -> list[Column]:
        """The operands in one kind: as they are, all as doubles, or all as text."""
        kinds = [self.kind(x) for x in some if not isinstance(self.kind(x), T.NullType)]
        if len({k.simpleString() for k in kinds}) <= 1:
            return [x.cast(kinds[0]) if kinds else x for x in some]
        if all(isinstance(k, WHOLE) for k in kinds):
            return [x.cast("long") for x in some]
        if all(isinstance(k, T.NumericType) for k in kinds):
            return [x.cast("double") for x in some]
        return [F.when(x.isNotNull(), self.shown(x)) for x in some]

    def either(self, a: Column, b: Column) -> Column:
        """``a`` if it is truthy, else ``b``: an operand, not a boolean."""
        x, y = self.common(a, b)
        return F.when(self.truthy(a), x).otherwise(y)

    def both(self, a: Column, b: Column) -> Column:
        """``a`` if it isn't truthy, else ``b``."""
        x, y = self.common(a, b)
        return F.when(self.truthy(a), y).otherwise(x)

    def choose(self, condition: Column, then: Column, other: Column) -> Column:
        x, y = self.common(then, other)
        return F.when(self.truthy(condition), x).otherwise(y)

    def shown(self, x: Column) -> Column:
        """As text: null is empty, lists and records are compact JSON with keys in order, numbers and booleans as JSON writes them."""
        kind = self.kind(x)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(self.json(x), F.lit(""))
        return F.coalesce(x.cast("string"), F.lit(""))

    def json(self, x: Column) -> Column:
        """Compact JSON with keys in order and nulls kept; of any value, texts in quotes."""
        kind = self.kind(x)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.to_json(sorted_record(x, kind), {"ignoreNullFields": "false"}), F.lit("null"))
        held = F.to_json(F.array(x), {"ignoreNullFields": "false"})
        return F.substring(held, F.lit(2), F.length(held) - 2)

    def text(self, *parts: Column | str) -> Column:
        """Interpolation: the parts as text, one after another; Python strings stand for themselves."""
        return F.concat(*[F.lit(p) if isinstance(p, str) else self.shown(p) for p in parts])

    def whole(self, a: Column, b: Column) -> bool:
        return self.is_whole(a) and self.is_whole(b)

    def plus(self, a: Column, b: Column) -> Column:
        """Two texts are joined, even if both are numbers; two numbers, or a number and a text that is one, are added; a text
        that isn't is joined with what the other shows. Where a text may be a number in some rows only, the result is text."""
        if self.is_text(a) and self.is_text(b):
            return F.concat(a, b)
        if self.whole(a, b):
            return F.try_add(a.cast("long"), b.cast("long"))
        if self.is_number(a) and self.is_number(b):
            return finite(a.cast("double") + b.cast("double"))
        if self.is_text(a) or self.is_text(b):
            total = finite(self.number(a) + self.number(b))
            as_text = F.when(total == F.floor(total), total.cast("decimal(38,0)").cast("string")).otherwise(total.cast("string"))
            return F.when(self.number(a).isNotNull() & self.number(b).isNotNull(), as_text).otherwise(F.concat(self.shown(a), self.shown(b)))
        return F.lit(None).cast("double")

    def minus(self, a: Column, b: Column) -> Column:
        return F.try_subtract(a.cast("long"), b.cast("long")) if self.whole(a, b) else finite(self.number(a) - self.number(b))

    def times(self, a: Column, b: Column) -> Column:
        return F.try_multiply(a.cast("long"), b.cast("long")) if self.whole(a, b) else finite(self.number(a) * self.number(b))

    def over(self, a: Column, b: Column) -> Column:
        """A double; null for division by 0."""
        return finite(F.try_divide(self.number(a), self.number(b)))

    def remainder(self, a: Column, b: Column) -> Column:
        """With the sign of ``a``; null for 0."""
        if self.whole(a, b):
            return F.try_mod(a.cast("long"), b.cast("long"))
        return finite(F.try_mod(self.number(a), self.number(b)))

    def _compare(self, a: Column, b: Column, how) -> Column:
        if self.is_number(a) and self.is_number(b):
            return F.coalesce(how(a, b), F.lit(False))
        x, y = self.number(a), self.number(b)
        if self.is_text(a) and self.is_text(b):
            return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), how(x, y)).otherwise(how(a, b)), F.lit(False))
        return F.coalesce(how(x, y), F.lit(False))

    def less(self, a: Column, b: Column) -> Column:
        """Numbers, and texts that are numbers, by size; other texts by code point; anything else is false, never null.

        In ``keep`` write ``a < b`` for columns of one kind instead: there null is dropped anyhow, and it reaches the scan.
        """
        return self._compare(a, b, lambda x, y: x < y)

    def greater(self, a: Column, b: Column) -> Column:
        return self._compare(a, b, lambda x, y: x > y)

    def at_most(self, a: Column, b: Column) -> Column:
        return self._compare(a, b, lambda x, y: x <= y)

    def at_least(self, a: Column, b: Column) -> Column:
        return self._compare(a, b, lambda x, y: x >= y)

    def same(self, a: Column, b: Column) -> Column:
        """Equal in kind and value: a number never equals a text, null equals null. Whole numbers and doubles compare by size."""
        kinds = [self.kind(a), self.kind(b)]
        alike = all(isinstance(k, T.NumericType) for k in kinds) or kinds[0] == kinds[1] or kinds[0].simpleString() == kinds[1].simpleString()
        if alike or any(isinstance(k, T.NullType) for k in kinds):
            return a.eqNullSafe(b)
        return a.isNull() & b.isNull()

    def differs(self, a: Column, b: Column) -> Column:
        return ~self.same(a, b)

    def length(self, x: Column) -> Column:
        """Bytes of a text, members of a list, map or record, else 0."""
        kind = self.kind(x)
        if isinstance(kind, T.StringType):
            own = F.octet_length(x)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            own = F.when(x.isNotNull(), F.size(x))
        elif isinstance(kind, T.StructType):
            own = F.when(x.isNotNull(), F.lit(len(kind.fields)))
        else:
            own = F.lit(None)
        return F.coalesce(own.cast("long"), F.lit(0).cast("long"))

    def keys(self, x: Column) -> Column:
        """Sorted names of a record or map, else an empty list."""
        kind = self.kind(x)
        if isinstance(kind, T.StructType):
            own = F.when(x.isNotNull(), F.array(*[F.lit(n) for n in sorted(f.name for f in kind.fields)]))
        elif isinstance(kind, T.MapType):
            own = F.array_sort(F.map_keys(x))
        else:
            own = F.lit(None).cast("array<string>")
        return F.coalesce(own, F.array().cast("array<string>"))

    def whole_number(self, x: Column, truncate: bool = False) -> Column:
        """Bigint: whole numbers stay, other numbers are 0 (cut off with ``truncate``), texts are parsed or 0, true is 1, anything else 0."""
        kind = self.kind(x)
        if isinstance(kind, WHOLE):
            own = x.cast("long")
        elif isinstance(kind, T.NumericType):
            own = x.try_cast("long") if truncate else F.lit(0).cast("long")
        elif isinstance(kind, T.StringType):
            own = F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("long"))
        elif isinstance(kind, T.BooleanType):
            own = x.cast("long")
        else:
            own = F.lit(None).cast("long")
        return F.coalesce(own, F.lit(0).cast("long"))

    def double(self, x: Column) -> Column:
        """Double: numbers, texts that are numbers, else 0."""
        return F.coalesce(self.number(x), F.lit(0.0))

    def smallest(self, *some: Column) -> Column:
        """Of those that are numbers (texts aren't), or null."""
        own = [x.cast("double") if not all(self.is_whole(y) for y in some if self.is_number(y)) else x for x in some if self.is_number(x)]
        return F.lit(None).cast("double") if not own else own[0] if len(own) == 1 else F.least(*own)

    def largest(self, *some: Column) -> Column:
        own = [x.cast("double") if not all(self.is_whole(y) for y in some if self.is_number(y)) else x for x in some if self.is_number(x)]
        return F.lit(None).cast("double") if not own else own[0] if len(own) == 1 else F.greatest(*own)
