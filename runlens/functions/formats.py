"""Numbers, durations and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of short numbers, largest first.
SUFFIXES = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "k"))


def significant(value: Column, digits: int) -> Column:
    """Rounded to significant digits."""
    magnitude = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), digits - 1 - magnitude)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def nice_step(raw: Column) -> Column:
    """The least of 1, 2, 5 or 10 times a power of ten that is not below a positive number: a distance between ticks."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    head = raw / size
    return size * F.when(head <= 1, 1).when(head <= 2, 2).when(head <= 5, 5).otherwise(10)


def plain_number(value: Column) -> Column:
    """Without trailing zeros or exponent."""
    text = F.format_string("%.10f", value)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def compact(value: Column, digits: int = 3) -> Column:
    """1234567 as 1.23M; missing values as a dash."""
    size = F.abs(value)
    out = plain_number(significant(value, digits))
    for scale, suffix in reversed(SUFFIXES):
        out = F.when(size >= scale, F.concat(plain_number(significant(value / scale, digits)), F.lit(suffix))).otherwise(out)
    return F.when(value.isNull(), "—").otherwise(out)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _parts(seconds: Column) -> tuple[Column, Column, Column, Column]:
    s = seconds.cast("long")
    return F.floor(s / 86400), F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60), s % 60


def duration(seconds: Column) -> Column:
    """The two largest units: 1d 02h, 3h 04m, 5m, 6s."""
    d, h, m, s = _parts(F.greatest(F.lit(0), F.round(seconds)))
    text = F.when(d > 0, F.concat(d.cast("string"), F.lit("d "), _two(h), F.lit("h"))).when(h > 0, F.concat(h.cast("string"), F.lit("h "), _two(m), F.lit("m")))
    return F.coalesce(text.when(m > 0, F.concat(m.cast("string"), F.lit("m"))).when(seconds.isNotNull(), F.concat(s.cast("string"), F.lit("s"))), F.lit("—"))


def clock(seconds: Column) -> Column:
    """hh:mm:ss, with days in front if any."""
    d, h, m, s = _parts(F.greatest(F.lit(0), F.floor(seconds)))
    hms = F.concat_ws(":", _two(h), _two(m), _two(s))
    return F.when(d > 0, F.concat(d.cast("string"), F.lit("d "), hms)).otherwise(hms)


def ago(seconds: Column) -> Column:
    return F.when(seconds < 60, "just now").otherwise(F.concat(duration(seconds), F.lit(" ago")))


def iso_time(epoch: Column) -> Column:
    """UTC to the second, whatever the session's time zone."""
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(epoch).cast("decimal(18,6)"))
    return F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + since, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
