"""Text, list and number functions of record pipelines, each a built-in expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import lower, upper  # noqa: F401  letters of all scripts, as they are

#: White space at a text's ends, of all scripts.
ENDS = r"(?U)^\s+|\s+$"


def default(x: Column, other: Column) -> Column:
    """``other`` for null and empty text; 0 and false stay."""
    return F.when(x.isNull() | (x.cast("string") == ""), other).otherwise(x)


def join(x: Column, separator: str = ",") -> Column:
    """The members of a list in one text; null members read ``null``."""
    return F.array_join(F.transform(x, lambda e: e.cast("string")), separator, "null")


def trim(x: Column) -> Column:
    return F.regexp_replace(x, ENDS, "")


def truncate(x: Column, n: int = 50) -> Column:
    """The first ``n`` characters and ``...`` if there are more."""
    return F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def replace(x: Column, old: str, new: str) -> Column:
    """Every ``old``, taken literally; an empty one is put between all characters and at both ends."""
    if old == "":
        return F.when(x == "", F.lit(new)).otherwise(F.concat(F.lit(new), F.array_join(F.split(x, ""), new), F.lit(new)))
    return F.replace(x, F.lit(old), F.lit(new))


def first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def last(x: Column) -> Column:
    return F.try_element_at(x, F.lit(-1))


def slugify(x: Column) -> Column:
    """Lower case; letters and numbers of any script stay, blanks and ``_`` become ``-``, other characters go, runs and ends of ``-`` too."""
    kept = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s_]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), "^-+|-+$", "")


def sanitize(x: Column) -> Column:
    """Without what stands between ``<`` and ``>``; a ``<`` that isn't closed takes the rest, a stray ``>`` goes."""
    return F.replace(F.regexp_replace(x, "<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def strip_tags(x: Column) -> Column:
    """Without closed tags; a ``<`` that isn't closed stays."""
    return F.regexp_replace(x, "<[^>]+>", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def unescape(x: Column) -> Column:
    """The five common character references resolved, the ampersand last."""
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return x


def ext(x: Column) -> Column:
    """From the last full stop on, that included; empty without one."""
    return F.regexp_extract(x, r"(\.[^.]*)$", 1)


def basename(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def urlencode(x: Column) -> Column:
    """Percent encoding of all bytes but letters, digits and ``-._~``; null reads ``null``."""
    out = F.url_encode(F.coalesce(x.cast("string"), F.lit("null")))
    for raw, mark in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return out


def urldecode(x: Column) -> Column:
    """Percent codes as bytes and ``+`` as blank; a ``%`` that begins no code stays. Bytes that aren't UTF-8 are replaced."""
    return F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def absolute(x: Column) -> Column:
    return F.abs(x)


def rounded(x: Column) -> Column:
    """A double; halves go away from 0."""
    return F.round(x.cast("double")).cast("double")


def ceiling(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def math_abs(x: Column) -> Column:
    """Like ``math_floor``, ``math_ceil`` and ``math_round``: null counts as 0, and the result is whole but here."""
    return F.abs(F.coalesce(x, F.lit(0)))


def math_floor(x: Column) -> Column:
    return F.floor(F.coalesce(x.cast("double"), F.lit(0.0))).cast("long")


def math_ceil(x: Column) -> Column:
    return F.ceil(F.coalesce(x.cast("double"), F.lit(0.0))).cast("long")


def math_round(x: Column) -> Column:
    return F.round(F.coalesce(x.cast("double"), F.lit(0.0))).cast("long")


def string(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def reverse(x: Column) -> Column:
    return F.reverse(x)


def unique(x: Column) -> Column:
    """The first of equal members; nulls are equal."""
    return F.array_distinct(x)


def split(x: Column, separator: str = ",") -> Column:
    """At every ``separator``, taken literally."""
    return F.split(x, "\\Q" + separator + "\\E", -1)


def first_nonempty(*some: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in some])


def leading_names(x: Column, n: int = 3, more: str = " et al.") -> Column:
    """The first ``n`` members, and ``more`` if there are others."""
    return F.concat(F.array_join(F.slice(x, 1, n), ", "), F.when(F.size(x) > n, F.lit(more)).otherwise(F.lit("")))


def labelled(x: Column, labels: dict[str, str], other: str) -> Column:
    """The label of the first key that occurs in ``x``."""
    out = None
    for key, label in labels.items():
        out = F.when(x.contains(key), label) if out is None else out.when(x.contains(key), label)
    return F.lit(other) if out is None else out.otherwise(other)


def urls_in(x: Column) -> Column:
    """All distinct web addresses in a text or JSON, in order."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(https?://[^\s\"'<>\\]+)"), F.lit(1)))


def safe_filename(x: Column, n: int = 80, dots: bool = False) -> Column:
    """Letters, numbers, ``-``, ``_`` and blanks stay (full stops with ``dots``), others become ``_``; at most ``n`` characters."""
    return F.left(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}\-_ " + ("." if dots else "") + "]", "_")), F.lit(n))


def join_nested(x: Column, *path: str, separator: str = " ") -> Column:
    """The members at ``path`` of lists in lists, all levels in order, in one text: of ``[{b: [{t: 1}]}, …]`` by ``b``, ``t``; null members are left out."""
    def field(name: str) -> Callable[[Column], Column]:
        return lambda e: e.getField(name)

    for name in path[:-1]:
        x = F.flatten(F.filter(F.transform(x, field(name)), lambda e: e.isNotNull()))
    return F.array_join(F.transform(x, field(path[-1])), separator)
