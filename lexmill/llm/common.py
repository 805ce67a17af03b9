"""What the operators share: tables in the cluster's shared folder, which cut lineage, and word classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.storage import drop_path, fresh_path, shared_dir, written, written_at

__all__ = ["SPACE_RE", "WHITESPACE", "WORD_RE", "bound", "drop_path", "free_name", "fresh_path", "shared_dir", "word_count", "words_of", "written", "written_at"]

#: Words of the contracts: runs of anything but space, TAB, LF, VT, FF and CR.
WHITESPACE = " \t\n\x0b\f\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"

def word_count(text: Column) -> Column:
    """Number of words as a long, 0 for null, counted in the JVM without building an array."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of words, empty for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE, -1))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once for each row: Catalyst would copy the expression into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
