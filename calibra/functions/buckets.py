"""Scalar building blocks: buckets, portable hashes, ordered rules, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decile(x: Column, closed: str = "left") -> Column:
    """Ten-wide bands: left-closed 0, 10, ... 90, or right-closed 0 (1-10) to 9 (91-100)."""
    return (F.floor(x / F.lit(10.0)) * 10).cast("int") if closed == "left" else F.floor((x - 1) / F.lit(10.0)).cast("int")


def quarter_label(day: Column) -> Column:
    """A quarter in short, as in Q1 '24 for early 2024."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" '"), F.date_format(day, "yy"))


def log_bin(x: Column, parts: int = 4) -> Column:
    """The lower edge of a logarithmic bin, ``parts`` to a decade."""
    return F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(x, F.lit(0.01))) * parts) / F.lit(float(parts)))


def equal_width(x: Column, low: Column, high: Column, k: int) -> Column:
    """Bin 1..k of a range that the data sets, closed on the right; the least value is in bin 1."""
    return F.greatest(F.lit(1), F.ceil((x - low) / ((high - low) / F.lit(float(k))))).cast("int")


def portable_bucket(text: Column, n: int = 100) -> Column:
    """A bucket that any engine with MD5 gives alike: the first 32 bits modulo n."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def seeded_order(seed: int, text: Column) -> Column:
    """A key for deterministic samples: SHA-256 of 'seed:text'."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), text.cast("string")), 256)


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first rule whose pattern occurs in the upper-case text."""
    out = None
    for pattern, value in rules:
        hit = F.upper(text).contains(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise) if out is not None else otherwise


def leading_category(event: Column) -> Column:
    """The leading capitals and digits of an event ticker, else 'independent'."""
    return F.when(event.isNull() | (event == ""), "independent").otherwise(F.coalesce(F.nullif(F.regexp_extract(event, "^([A-Z0-9]+)", 1), F.lit("")), F.lit("independent")))


def cents(dollars: Column, rounded: bool = False) -> Column:
    """Dollar text as cents: cut off as floats are, or rounded."""
    x = dollars.try_cast("double") * 100
    return (F.round(x) if rounded else x).cast("int")


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def short_number(x: Column) -> Column:
    """1,234 / 1.2M / 3.4B."""
    return F.when(x >= 1e9, F.format_string("%.1fB", x / F.lit(1e9))).when(x >= 1e6, F.format_string("%.1fM", x / F.lit(1e6))).otherwise(F.format_number(x, 0))
