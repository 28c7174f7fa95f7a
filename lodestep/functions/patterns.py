"""Patterns of dump rows, and columns that take rows apart.

The text group uses possessive quantifiers: it accepts the same strings as the
usual alternation of plain and escaped characters, but the matcher needs no
stack, however long the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MAX_PAGE_ID

# Parts of the rows of a dump.
UINT = r"\d+"
INT = r"-?\d+"
TEXT = r"[^'\\]*+(?:\\[^\n][^'\\]*+)*+"
TEXT_OR_NULL = rf"(?:'{TEXT}'|NULL)"
FRACTION = r"(?:0(?:\.\d+)?|1(?:\.0+)?|\.\d+)"
DIGITS_OR_NULL = r"(?:'\d*'|NULL)"

# The columns of the rows, in order; groups are kept.
ROWS = {
    "page": [f"({UINT})", f"({INT})", f"'({TEXT})'", "[01]", "[01]", FRACTION, r"'\d*'", DIGITS_OR_NULL, UINT, UINT, TEXT_OR_NULL, TEXT_OR_NULL],
    "redirect": [f"({UINT})", f"({INT})", f"'({TEXT})'", TEXT_OR_NULL, TEXT_OR_NULL],
    "linktarget": [f"({UINT})", f"({INT})", f"'({TEXT})'"],
    "pagelinks": [f"({UINT})", INT, f"({UINT})"],
}


def row_pattern(relation: str) -> str:
    return r"\(" + ",".join(ROWS[relation]) + r"\)"


def rows(line: Column, relation: str) -> Column:
    """Array of the rows in a line of a dump."""
    return F.regexp_extract_all(line, F.lit(row_pattern(relation)), 0)


def groups(row: Column, relation: str) -> list[Column]:
    """The kept columns of a row, as strings."""
    n = sum(part.startswith("(") and not part.startswith("(?") or part.startswith("'(") for part in ROWS[relation])
    return [F.regexp_extract(row, row_pattern(relation), i + 1) for i in range(n)]


def page_id(digits: Column) -> Column:
    """A page id, or null for digits that are none."""
    value = digits.try_cast("long")
    return F.when(value.between(0, MAX_PAGE_ID), value)


def namespace(digits: Column) -> Column:
    return digits.try_cast("int")


def linktarget_id(digits: Column) -> Column:
    """A link target id, 64 bits without sign, or null."""
    value = digits.try_cast("decimal(20,0)")
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)
