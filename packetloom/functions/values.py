"""Coercion, cleaning and checks of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_IPV4 = r"^(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\z"
_INF = float("inf")


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, also the non-ASCII kinds."""
    return F.regexp_replace(text, _EDGE_BLANKS, "")


def is_finite(number: Column) -> Column:
    """False for the infinities and NaN (which sorts above them); NULL stays."""
    return F.abs(number) < F.lit(_INF)


def clean_number(number: Column, default: float = 0.0) -> Column:
    """Replace NULL, NaN and the infinities."""
    return F.when(is_finite(number), number).otherwise(F.lit(default))


def parse_double(text: Column) -> Column:
    """Text as a double, NULL when unreadable.

    The cast alone would also accept Java spellings such as ``1.5d`` or
    ``0x1p3``; none of these letters occurs in a finite decimal number.
    """
    return F.when(~text.rlike("[dDfFxXpP]"), text.try_cast("double"))


def coerce_double(value: Column, default: float = 0.0) -> Column:
    """Read text as a finite double, else the default."""
    return clean_number(parse_double(value.cast("string")), default)


def coerce_long(value: Column, default: int = 0) -> Column:
    """``coerce_double`` cut toward zero."""
    return F.coalesce(coerce_double(value, float(default)).try_cast("bigint"), F.lit(default).cast("bigint"))


def sanitize(text: Column, limit: int = 1000) -> Column:
    """Delete markup characters, then keep the first ``limit`` characters."""
    return F.substring(F.translate(text, "<>&", ""), 1, limit)


def is_valid_ipv4(text: Column) -> Column:
    """Four groups of one to three digits, none above 255; NULL is invalid."""
    octets = F.split(text, r"\.")
    in_range = F.forall(octets, lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    return F.coalesce(text.rlike(_IPV4) & in_range, F.lit(False))


def valid_threshold(value: Column) -> Column:
    """A confidence threshold lies in [0, 1]."""
    return F.coalesce(value.between(0.0, 1.0) & ~F.isnan(value), F.lit(False))


def check_threshold(value: float) -> float:
    """Reject a threshold argument that is no number in [0, 1]."""
    if not isinstance(value, (int, float)):
        raise ValueError("threshold must be a number")
    if not 0.0 <= value <= 1.0:
        raise ValueError("threshold must be between 0.0 and 1.0")
    return float(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where a zero or missing denominator gives 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fraction, for either timestamp type."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000000.0)
