"""Scalar column functions (all JVM-side, usable inside any select).

Every function takes and returns a ``Column`` so it composes with the rest
of ``pyspark.sql.functions`` and stays inside whole-stage code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classes import is_floating

# Fixed values that decide results.
# Text accepted as a number: optional sign, digits with optional fraction (or
# a bare fraction), optional exponent.  Applied to trimmed text.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# A value "looks like a date" when it contains one of these two shapes.
DATE_PATTERN = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})|(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
# Formats tried when converting date text, in order of preference
# (year first, then month first, then day first).
DATE_FORMATS = (
    "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d", "yyyy/M/d",
    "M/d/yyyy", "M-d-yyyy", "M/d/yy", "d/M/yyyy", "d-M-yyyy", "d/M/yy",
    "yyyy-M-d H:m", "yyyy-M-d'T'H:m", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d'T'H:m:sXXX",
)
# Shape of the text each format can parse (trimmed), so a parse is attempted
# only where it can succeed; month-first and day-first formats share shapes
# and are told apart by the parser's range checks.
_YMD = r"\d{4}-\d{1,2}-\d{1,2}"
DATE_FORMAT_SHAPES = {
    "yyyy-M-d H:m:s": rf"^{_YMD} \d{{1,2}}:\d{{1,2}}:\d{{1,2}}$",
    "yyyy-M-d'T'H:m:s": rf"^{_YMD}T\d{{1,2}}:\d{{1,2}}:\d{{1,2}}$",
    "yyyy-M-d": rf"^{_YMD}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "yyyy-M-d H:m": rf"^{_YMD} \d{{1,2}}:\d{{1,2}}$",
    "yyyy-M-d'T'H:m": rf"^{_YMD}T\d{{1,2}}:\d{{1,2}}$",
    "yyyy-M-d H:m:s.SSSSSS": rf"^{_YMD} \d{{1,2}}:\d{{1,2}}:\d{{1,2}}\.\d{{1,6}}$",
    "yyyy-M-d'T'H:m:s.SSSSSS": rf"^{_YMD}T\d{{1,2}}:\d{{1,2}}:\d{{1,2}}\.\d{{1,6}}$",
    "yyyy-M-d'T'H:m:sXXX": rf"^{_YMD}T\d{{1,2}}:\d{{1,2}}:\d{{1,2}}(Z|[+-]\d{{2}}:\d{{2}})$",
}
# Text read as missing by the CSV source.
NULL_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "#N/A", "-NaN", "-nan",
               "<NA>", "#NA", "#N/A N/A", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN")


def named(name: str) -> Column:
    """The top-level column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_digest(columns: list[Column]) -> list[Column]:
    """Two 64-bit hashes of a row: equal rows have equal ones, and of n different rows two share both with a
    chance below n^2 / 2^128.  NULL is a value of its own; -0.0 equals 0.0 and NaN equals NaN."""
    missing_flags = [c.isNull() for c in columns]
    return [F.xxhash64(*columns, *missing_flags).alias("__tw_h0"), F.xxhash64(F.lit("row"), *missing_flags, *reversed(columns)).alias("__tw_h1")]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c, dtype: T.DataType | None = None) -> Column:
    """H5: missing = NULL, or NaN for floating columns."""
    c = _col(c)
    if dtype is not None and is_floating(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def not_missing(c, dtype: T.DataType | None = None) -> Column:
    return ~missing(c, dtype)


def nan_to_null(c, dtype: T.DataType | None = None) -> Column:
    c = _col(c)
    if dtype is not None and is_floating(dtype):
        return F.when(~F.isnan(c), c)
    return c


def parse_number(c) -> Column:
    """H1: coercing number parse; text that is not a plain number is NULL."""
    t = F.trim(_col(c).cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def _try_format(t: Column, fmt: str) -> Column:
    shape = DATE_FORMAT_SHAPES.get(fmt)
    parsed = F.try_to_timestamp(t, F.lit(fmt))
    if fmt.endswith("XXX"):  # an instant: its time in UTC, whatever the session's zone
        parsed = F.to_utc_timestamp(parsed, F.current_timezone())
    return F.when(t.rlike(shape), parsed) if shape else parsed


def parse_date(c, formats=DATE_FORMATS) -> Column:
    """H2: coercing date parse with the first format that fits."""
    t = F.trim(_col(c).cast("string"))
    return F.coalesce(*[_try_format(t, f) for f in formats]).cast("timestamp_ntz")


def parse_date_with(c, fmt: str) -> Column:
    t = F.trim(_col(c).cast("string"))
    return _try_format(t, fmt).cast("timestamp_ntz")


def date_signatures(fmt: str) -> list[str]:
    """What is left of a text of the format without its digits: a test cheaper than the shape, and as strict about the separators."""
    left = re.sub("[a-zA-SU-Z]+", "", fmt.replace("'", ""))
    return [left + zone for zone in ("Z", "+:", "-:")] if fmt.endswith("XXX") else [left]


def looks_like_date(c) -> Column:
    """H3: date pattern match."""
    return _col(c).cast("string").rlike(DATE_PATTERN)


def clip(c, lower, upper) -> Column:
    """H4: clip into [lower, upper]; NULL stays NULL (greatest/least skip nulls)."""
    c = _col(c)
    lo = lower if isinstance(lower, Column) else F.lit(lower)
    hi = upper if isinstance(upper, Column) else F.lit(upper)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.least(c, hi), lo))


def fill(c, value, dtype: T.DataType | None = None) -> Column:
    """H6: replace missing values (NULL, and NaN for floats)."""
    c = _col(c)
    v = value if isinstance(value, Column) else F.lit(value)
    if dtype is not None and is_floating(dtype):
        return F.when(missing(c, dtype), v).otherwise(c)
    return F.coalesce(c, v)


def is_whole(c) -> Column:
    """H7: whole-number test."""
    return (_col(c) % 1) == 0


def standard_score(c, mean, std) -> Column:
    """H8: (x - mean) / std, 0 where std is 0 or unknown."""
    m = mean if isinstance(mean, Column) else F.lit(mean)
    s = std if isinstance(std, Column) else F.lit(std)
    return F.coalesce((_col(c) - m) / F.nullif(s, F.lit(0.0)), F.lit(0.0))


def date_parts(c, prefix: str) -> list[Column]:
    """H9: year, month, day and day of week (Monday = 0)."""
    c = _col(c)
    return [F.year(c).alias(f"{prefix}_year"), F.month(c).alias(f"{prefix}_month"),
            F.dayofmonth(c).alias(f"{prefix}_day"), F.weekday(c).alias(f"{prefix}_dayofweek")]


def round_half_even(c, scale: int = 2) -> Column:
    """Rounding as numpy does it: scale the binary value by 10^scale,
    round half to even, scale back (pandas ``round`` and ``describe().round``)."""
    f = float(10 ** scale)
    return F.bround(_col(c) * F.lit(f), 0) / F.lit(f)


def round_half_up(c, scale: int = 2) -> Column:
    """Half away from zero on the scaled binary value, as SQL engines round
    doubles (``round(x, scale)`` in DuckDB, C ``round``)."""
    f = float(10 ** scale)
    return F.round(_col(c) * F.lit(f), 0) / F.lit(f)
