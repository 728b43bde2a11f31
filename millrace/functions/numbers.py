"""Numbers, sizes, times and durations as pages write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column) -> Column:
    """A number that is not negative with one decimal, as C and Rust print it: the double's exact value is rounded, halves to even.

    ``format_string`` rounds the shortest decimals that name the double, so 0.35, which is a little less, becomes 0.4.
    Ten times the fraction is ``ten`` and the small rest that its sum of 8 and 2 times loses; the rest decides what looks like a half.
    """
    whole = F.floor(x).cast("long")
    part = x - whole
    ten = part * 8.0 + part * 2.0
    rest, low = part * 2.0 - (ten - part * 8.0), F.floor(ten).cast("long")
    up = (ten - low > 0.5) | ((ten - low == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 == 1))))
    k = low + up.cast("long")
    return F.when(x < 2.0**63, F.concat((whole + F.floor(k / 10)).cast("string"), F.lit("."), (k % 10).cast("string"))).otherwise(F.format_string("%.1f", x))


def format_size(n: Column) -> Column:
    """Bytes in decimal units with one decimal above 1000, else ``n bytes``."""
    unit = lambda factor, name: F.concat(one_decimal(n / float(factor)), F.lit(f" {name}"))
    return F.when(n > 10**9, unit(10**9, "GB")).when(n > 10**6, unit(10**6, "MB")).when(n > 10**3, unit(10**3, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def suffixed(x: Column) -> Column:
    """``1.5K`` and ``2M`` as numbers; thousands may be parted by commas; null if it is no number."""
    plain = F.upper(F.replace(F.trim(x), F.lit(","), F.lit("")))
    factor = F.when(plain.endswith("K"), 1e3).when(plain.endswith("M"), 1e6).when(plain.endswith("B"), 1e9).otherwise(1.0)
    return F.regexp_replace(plain, "[KMB]$", "").try_cast("double") * factor


def fixed(x: Column, n: int) -> Column:
    """Rounded to ``n`` decimals, halves away from 0, as a number."""
    return F.round(x.cast("double"), n)


def duration(seconds: Column) -> Column:
    """``m:ss``, from one hour on ``h:mm:ss``."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s % 60))).otherwise(F.concat_ws(":", m.cast("string"), two(s % 60)))


def epoch_date(seconds: Column, hours: int = 0) -> Column:
    """``yyyy-MM-dd`` at a fixed offset from UTC, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds + hours * 3600) / 86400).cast("int")).cast("string")


def epoch_millis_date(millis: Column) -> Column:
    return epoch_date(F.floor(millis / 1000))


def iso_date(x: Column) -> Column:
    """The date at the beginning of an ISO time."""
    return F.substring(x, 1, 10)
