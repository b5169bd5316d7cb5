"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two or more letters, digits or underscores of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def squeeze_spaces(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def contains_none(column: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | column.contains(part)
    return ~found


def keep_letters(column: Column, letters: str) -> Column:
    """Every character outside ``letters`` (a character-class body) becomes a space."""
    return F.regexp_replace(column, f"[^{letters}]", " ")


def number_from_substring(column: Column, start: int, length: int, drop: Sequence[str]) -> Column:
    """A float cut out by position; an empty piece is NULL."""
    piece = F.substring(column, start, length)
    for char in drop:
        piece = F.replace(piece, F.lit(char), F.lit(""))
    return F.nullif(piece, F.lit("")).try_cast("float")


def path_segment(column: Column, position: int) -> Column:
    """The part at ``position`` (from 0) of a '/'-separated path, NULL when missing."""
    return F.get(F.split(column, "/"), position)


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
