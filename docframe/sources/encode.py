"""RTF from tables, for queries and tests: plain text to escaped bodies, bodies to documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WRITTEN = {"\\": "\\\\", "{": "\\{", "}": "\\}", "\n": "\\par\n", "\t": "\\tab "}
_SPECIAL = re.compile(r"[\\{}]|[^ -~]")


def escape(text: str, codepage: str | None = None) -> str:
    """Public rules only: braces and backslashes escaped, lines end in a paragraph, other characters as bytes of the
    code page where it has them, else as numbers."""

    def one(m: re.Match) -> str:
        c = m[0]
        if c in _WRITTEN:
            return _WRITTEN[c]
        if codepage and (raw := c.encode(codepage, "ignore")):
            return "".join(f"\\'{b:02x}" for b in raw)
        units = c.encode("utf-16-le", "surrogatepass")
        numbers = [int.from_bytes(units[k : k + 2], "little", signed=True) for k in range(0, len(units), 2)]
        return "".join(f"\\u{n}?" for n in numbers)

    return _SPECIAL.sub(one, text)


def rtf_escape(text: str, codepage: str | None = None) -> Column:
    """``escape`` of a column, given by name."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: escape(t or "", codepage))

    return run(F.col(text))


def rtf_document(body: Column) -> Column:
    """The bytes of a document with this body (ASCII)."""
    return F.concat(F.lit("{\\rtf1\\ansi\\uc1 "), body, F.lit("}")).cast("binary")
