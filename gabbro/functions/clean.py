"""Typed cleaning of raw strings. Every function takes and gives Columns, never raises on bad input
(ANSI mode stays on: only try_* conversions touch raw data) and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """Trimmed, inner white space (also no-break spaces) as single blanks."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def clean_decimal(c: Column, precision: int = 10, scale: int = 2) -> Column:
    """A decimal from text with a decimal comma or point. Known characters are kept (digits, sign,
    separators), so currency signs, words and no-break spaces go; anything left that is no number is null."""
    kept = F.regexp_replace(F.regexp_replace(c, r"[^0-9,.\-]", ""), ",", ".")
    return kept.try_cast(f"decimal({precision},{scale})")


def clean_int(c: Column, strict: bool = False) -> Column:
    """An integer; lenient: other characters than digits and sign go first, strict: they make it null."""
    return (F.trim(c) if strict else F.regexp_replace(c, r"[^0-9\-]", "")).try_cast("int")


def clean_status(c: Column) -> Column:
    return F.upper(F.trim(c))


def parse_ts(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A timestamp in exactly this format, else null."""
    return F.try_to_timestamp(F.trim(c), F.lit(fmt))


def dual_ts(c: Column) -> Column:
    """A timestamp from ISO text or from epoch milliseconds in text."""
    digits = c.rlike(r"^\d{11,}$")
    return F.when(digits, F.timestamp_millis(F.when(digits, c).try_cast("bigint"))).otherwise(F.try_to_timestamp(c))


def row_hash(*cols: str) -> Column:
    """A digest that tells ('a', null) from (null, 'a'): nulls have a mark of their own."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u001f\u0000")) for c in cols]), 256)


def reasons(**rules: Column) -> Column:
    """array<string> of the names of the rules that hold; a rule that is null doesn't."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def completeness(*cols: str) -> list[Column]:
    """Share of rows with a value, for each column."""
    return [(F.count(c) / F.count(F.lit(1))).alias(f"{c}_complete") for c in cols]


def plausible_scale(price: Column, reference: Column, factor: int = 10) -> Column:
    """True where a price looks like cents against a known reference price."""
    return F.coalesce(price > reference * factor, F.lit(False))
