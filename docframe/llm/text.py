"""Column expressions over raw text that several operators share. Null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the word contract has it, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_CLASS + "+")
    )


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unnamed(df: DataFrame) -> DataFrame:
    """The input under names of its own (``_c0`` and so on), so that no column of it meets one that an operator makes."""
    return df.toDF(*[f"_c{k}" for k in range(len(df.columns))])


def column_of(df: DataFrame, name: str) -> str:
    """Name of an input column in :func:`unnamed`: the one of exactly this name, else of this name in another case."""
    same = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"the input has no column {name}")
    return f"_c{same[0]}"


def restored(df: DataFrame, columns: list[str], made: list[str]) -> DataFrame:
    """The input's columns by their names, without those that ``made`` replaces in any case, and then ``made``."""
    taken = {c.lower() for c in made}
    kept = [F.col(f"_c{k}").alias(c) for k, c in enumerate(columns) if c.lower() not in taken]
    return df.select(*kept, *made)
