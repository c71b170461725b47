"""Text clean-up and comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def match_key(value: Column) -> Column:
    """Form in which names are compared: letter case and outer spaces do not count."""
    return F.upper(F.trim(value))


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def yes_flag(value: Column, word: str) -> Column:
    """True when the text is *word*; anything else, NULL included, is false."""
    return F.coalesce(match_key(value) == word, F.lit(False))
