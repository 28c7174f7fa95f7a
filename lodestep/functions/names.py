"""Names of databases and dump files, versions, and page addresses."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of the names.
DATABASE = r"^wp-([a-zA-Z]+)-([0-9]+)$"
DUMP = r"^([a-zA-Z]+)wiki-([0-9]+)-(.+)\.sql\.gz$"
KINDS = ("page", "redirect", "linktarget", "pagelinks")


@dataclass(frozen=True, order=True)
class Metadata:
    """Language and date of a database."""

    language_code: str
    date_code: str

    @property
    def name(self) -> str:
        return f"wp-{self.language_code}-{self.date_code}"

    def dates_apart(self, other: Metadata) -> int | None:
        """Above 0 if this date is the later one, 0 if they are the same; None for another language."""
        if self.language_code != other.language_code:
            return None
        return (self.date_code > other.date_code) - (self.date_code < other.date_code)


def parse_database(name: str) -> Metadata | None:
    found = re.match(DATABASE, name)
    return Metadata(*found.groups()) if found else None


def parse_dump(name: str) -> tuple[Metadata, str] | None:
    """Metadata and kind of a dump file's name."""
    found = re.match(DUMP, name)
    return (Metadata(found[1], found[2]), found[3]) if found else None


def format_dump(metadata: Metadata, kind: str) -> str:
    return f"{metadata.language_code}wiki-{metadata.date_code}-{kind}.sql.gz"


def database_parts(name: Column) -> list[Column]:
    """language_code and date_code of a column of names; null where the name isn't a database's."""
    ok = name.rlike(DATABASE)
    return [F.when(ok, F.regexp_extract(name, DATABASE, i)).alias(n) for i, n in ((1, "language_code"), (2, "date_code"))]


def dump_parts(name: Column) -> list[Column]:
    ok = name.rlike(DUMP)
    return [F.when(ok, F.regexp_extract(name, DUMP, i)).alias(n) for i, n in ((1, "language_code"), (2, "date_code"), (3, "kind"))]


def page_url(language_code: Column | str, title: Column) -> Column:
    code = F.lit(language_code) if isinstance(language_code, str) else language_code
    return F.concat(F.lit("https://"), code, F.lit(".wikipedia.org/wiki/"), title)
