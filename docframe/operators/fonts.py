"""Fonts of documents: names mapped by the caller, declared line boxes, style strings, faces to measure with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families that are written without quotes, and the longest name of a family.
GENERIC = ("serif", "sans-serif", "monospace", "system-ui")
MAX_NAME = 200
#: Characters of one run and of one font that a sample holds.
RUN_SAMPLE, FONT_SAMPLE = 128, 512


@dataclass(frozen=True)
class Face:
    """What one family measures: advance of a grapheme, ascent and descent, in ems (``points``: in points at any size).

    ``widths`` gives advances of single graphemes; all others take ``advance``.
    """

    advance: float = 0.5
    ascent: float = 0.8
    descent: float = 0.2
    points: bool = False
    widths: dict[str, float] = field(default_factory=dict)

    def width(self, grapheme: str, size: float) -> float:
        return self.widths.get(grapheme, self.advance) * (1.0 if self.points else size)

    def box(self, size: float, line_box: float | None) -> tuple[float, float]:
        """Ascent and descent; a declared line box (in ems) replaces their sum and keeps their ratio."""
        up, down = (self.ascent, self.descent) if self.points else (self.ascent * size, self.descent * size)
        if line_box is not None and line_box == line_box:  # null may come as NaN
            scale = line_box * size / (up + down) if up + down > 0 else 0.0
            up, down = up * scale, down * scale
        return up, down


#: The measurer of tests: every grapheme five points wide, ascent eight, descent two.
FIXED = Face(5.0, 8.0, 2.0, True)


def _literal(values: dict, kind: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.lit(None).cast(f"map<string,{kind}>")


def clean_family(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[\x00-\x1f]", ""), 1, MAX_NAME)


def resolve_fonts(
    fonts: DataFrame, mapping: dict[str, str] | None = None, line_heights: dict[str, float] | None = None, fallback: str | None = None
) -> DataFrame:
    """Add ``family`` (the mapped name, else its own, else the fallback, else serif) and ``line_box`` (declared by the
    document's own name; only positive finite values count). Both maps are options of the caller, not data."""
    boxes = {k: float(v) for k, v in (line_heights or {}).items() if 0 < v < float("inf")}
    name = F.coalesce(_literal(mapping or {}, "string")[F.col("name")], F.col("name"))
    family = F.coalesce(F.when(F.length(name) > 0, name), F.lit(fallback or None), F.lit("serif"))
    return fonts.withColumn("family", family).withColumn("line_box", _literal(boxes, "double")[F.col("name")])


def font_style(family: Column, size: Column, bold: Column, italic: Column, fallback: str | None = None) -> Column:
    """A style string: italic, bold, size, family and fallbacks; generic families bare, other names quoted."""
    def quoted(c: Column) -> Column:
        inner = F.regexp_replace(clean_family(c), r'(["\\])', r"\\$1")
        return F.when(c.isin(*GENERIC), c).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))

    shown = F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(size.cast("string"))
    tail = F.concat(F.lit(", "), quoted(F.lit(fallback))) if fallback else F.lit("")
    return F.concat(
        F.when(italic, "italic ").otherwise(""), F.when(bold, "bold ").otherwise(""), shown, F.lit("px "), quoted(family), tail, F.lit(", serif")
    )


def font_samples(runs: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, family, sample): visible text of each family in document order, for preparing faces.

    A report of bounded length by design: 128 characters of a run and 512 of a family.
    """
    seen = runs.where("kind = 'text' and not style.hidden and text <> ''").select(
        "doc_id", F.col("style.font_id").alias("id"), "seq", F.substring("text", 1, RUN_SAMPLE).alias("part")
    )
    named = seen.join(fonts.select("doc_id", "id", "family"), ["doc_id", "id"], "left").withColumn("family", F.coalesce("family", F.lit("serif")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "part")))
    return named.groupBy("doc_id", "family").agg(F.substring(F.array_join(F.transform(parts, lambda x: x["part"]), ""), 1, FONT_SAMPLE).alias("sample"))
