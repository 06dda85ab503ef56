"""Uniform numbers from a key, equal on every run and in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13


def unit_hash(*parts: Column, digits: int = HEX_DIGITS, start: int = 1) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ``:`` (13 digits fill a double)."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return hex_fraction(F.md5(text), start, digits)


def hex_fraction(digest: Column, start: int, digits: int) -> Column:
    piece = F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
    return piece / F.lit(float(16**digits))
