"""Expressions for text, number, label and time cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that stand for "nothing here" in the logs.
UNSET = ("-",)
UNSET_OR_EMPTY = ("-", "(empty)")
BLANK_UNSET_OR_EMPTY = ("", "-", "(empty)")


def null_markers(column: Column, markers: Sequence[str]) -> Column:
    """NULL where the text is one of the markers. No other word is treated as missing."""
    return F.when(~column.isin(*markers), column) if markers else column


def is_blank(column: Column) -> Column:
    """True for NULL and for text that is a missing marker after trimming."""
    text = F.trim(column.cast("string"))
    return F.coalesce(text.isin(*BLANK_UNSET_OR_EMPTY), F.lit(True))


def to_number(column: Column) -> Column:
    """Double, or NULL for text that is no number."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def fill_category(column: Column, filler: str = "missing") -> Column:
    return F.coalesce(column, F.lit(filler))


def tidy_label(column: Column) -> Column:
    return F.lower(F.trim(column))


def tidy_detail(column: Column, filler: str = "Not specified") -> Column:
    """Trimmed detailed label; missing markers become the filler."""
    text = F.trim(column)
    return F.when(text.isin(*BLANK_UNSET_OR_EMPTY), F.lit(filler)).otherwise(text)


def label_code(column: Column, codes: dict[str, int]) -> Column:
    """Class name to number; anything else becomes NULL."""
    return _lookup(column, codes).cast("int")


def label_name(column: Column, codes: dict[str, int], other: str = "Unknown") -> Column:
    """Number back to class name."""
    return F.coalesce(_lookup(column, {code: name for name, code in codes.items()}), F.lit(other))


def _lookup(column: Column, pairs: dict) -> Column:
    (key, value), *rest = pairs.items()
    chain = F.when(column == F.lit(key), F.lit(value))
    for key, value in rest:
        chain = chain.when(column == F.lit(key), F.lit(value))
    return chain


def epoch_to_timestamp(column: Column) -> Column:
    """Epoch seconds with six decimals to a UTC timestamp; the decimal keeps microseconds exact."""
    micros = column.try_cast("decimal(20,6)") * F.lit(1_000_000)
    return F.timestamp_micros(micros.cast("bigint"))


def tidy_domain(column: Column) -> Column:
    """Trimmed, lower-case, without the root dot."""
    return F.rtrim(F.lower(F.trim(column)), F.lit("."))


def drop_wildcard(column: Column) -> Column:
    return F.regexp_replace(column, r"^\*\.", "")


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Rounded share in percent; 0 when the whole is 0."""
    share = part.cast("double") * F.lit(100.0).cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    return F.round(F.coalesce(share, F.lit(0.0)), digits)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as double; 0 when the denominator is 0 or NULL."""
    return F.coalesce(
        F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))), F.lit(0.0)
    )
