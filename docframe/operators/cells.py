"""Table rows: boundaries to cells (gaps and islands), and the fallbacks of padding, borders and shading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.sources.rtf import paragraph_texts, prop, runs

#: Border widths in points.
HAIR, DEFAULT_WIDTH, MIN_WIDTH, MAX_WIDTH = 0.25, 0.5, 0.25, 12.0
STYLES = ("none", "single", "double", "dotted", "dashed", "other")
SIDES = {"top": "t", "left": "l", "bottom": "b", "right": "r"}


def rows(events: DataFrame) -> DataFrame:
    h = F.coalesce(prop("trrh"), F.lit(0))
    kind = F.when(h == 0, "auto").when(h > 0, "atLeast").otherwise("exact")
    align = F.when(prop("trqc").isNotNull(), "center").when(prop("trqr").isNotNull(), "right").otherwise("left")
    return events.where("etype = 'rowdef'").select(
        "doc_id", "block", (F.coalesce(prop("trleft"), F.lit(0)) / 20.0).alias("left"), kind.alias("height_kind"),
        F.when(h != 0, F.abs(h) / 20.0).alias("height"), align.alias("align"), F.col("props").alias("row_props"),
    )


def _padding(side: str) -> Column:
    """Cell, then row, then half the gap (left and right) or 0; units other than points do not count; none below 0."""
    c = SIDES[side]

    def own(props: str, head: str) -> Column:
        unit = F.col(props)[f"{head}padf{c}"] if head == "cl" else F.coalesce(F.col(props)[f"{head}paddf{c}"], F.col(props)[f"{head}padf{c}"])
        value = F.col(props)[f"{head}pad{c}"] if head == "cl" else F.col(props)[f"{head}padd{c}"]
        return F.when(value.isNotNull() & (unit.isNull() | (unit == 3)), F.greatest(value, F.lit(0)) / 20.0)

    gap = F.greatest(F.coalesce(F.col("row_props")["trgaph"], F.lit(0)), F.lit(0)) / 20.0 if c in "lr" else F.lit(0.0)
    return F.coalesce(own("props", "cl"), own("row_props", "tr"), gap)


def _border(props: str, name: str) -> Column:
    """A declared side as a struct; null where it was not declared."""
    p = F.col(props)
    style = F.get(F.array(*[F.lit(s) for s in STYLES]), F.when(p[f"{name}_none"].isNull(), p[f"{name}_style"].cast("int")).otherwise(0))
    width = F.when(p[f"{name}_hair"].isNotNull(), F.lit(HAIR)).otherwise(
        F.least(F.greatest(F.coalesce(p[f"{name}_w"] / 20.0, F.lit(DEFAULT_WIDTH)), F.lit(MIN_WIDTH)), F.lit(MAX_WIDTH))
    )
    color = F.when(p[f"{name}_cf"] > 0, p[f"{name}_cf"])
    return F.when(p[name].isNotNull(), F.struct(width.alias("width"), color.alias("color"), style.alias("style")))


def _boundaries(events: DataFrame) -> DataFrame:
    """Cell definitions with ``ok`` (the boundary is accepted), ``bare`` (it continues a merge) and ``island``."""
    d = events.where("etype = 'celldef'").select("doc_id", "block", F.col("cell").alias("i"), "props").join(rows(events), ["doc_id", "block"])
    right = prop("cellx") / 20.0
    order = Window.partitionBy("doc_id", "block").orderBy("i")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("right", right).withColumn("_max", F.greatest(F.col("left"), F.coalesce(F.max("right").over(past), F.col("left"))))
    d = d.withColumn("ok", F.col("right") > F.col("_max"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first_ok = F.col("ok") & (F.sum(F.col("ok").cast("int")).over(upto) == 1)
    begins = F.col("ok") & (prop("clmrg").isNull() | first_ok)
    d = d.withColumn("bare", F.col("ok") & ~begins)
    return d.withColumn("island", F.greatest(F.lit(1), F.sum(begins.cast("int")).over(upto)))


def cell_paragraphs(events: DataFrame) -> DataFrame:
    """(doc_id, block, para_seq, island, text): the paragraphs of resolved cells; islands of a row count from 1.

    Contents beyond the last definition join it; paragraphs without any run in a continuation cell are left out.
    """
    d = _boundaries(events)
    key = ["doc_id", "block", "cell", "para_in_cell"]
    filled = runs(events).where("cell is not null").select(*key).distinct().withColumn("_filled", F.lit(True))
    texts = paragraph_texts(events).where("cell is not null").join(filled, key, "left")
    last = d.groupBy("doc_id", "block").agg(F.max("i").alias("_last"))
    place = d.select("doc_id", "block", "i", "island", "bare")
    return (
        texts.join(last, ["doc_id", "block"]).withColumn("i", F.least("cell", "_last")).join(place, ["doc_id", "block", "i"])
        .where(~F.col("bare") | F.col("_filled")).select("doc_id", "block", "para_seq", "island", "text")
    )


def cells(events: DataFrame) -> DataFrame:
    """Resolved cells (doc_id, block, cell_idx, island, right, padding, borders, vertical_align, shading, text).

    A boundary that is not beyond the last accepted one is dropped and its content joins the cell to its left;
    continuation cells of a horizontal merge join theirs.
    """
    d = _boundaries(events)
    content = cell_paragraphs(events).groupBy("doc_id", "block", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_seq", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    head = d.where("ok").groupBy("doc_id", "block", "island").agg(
        F.max_by("right", "i").alias("right"), F.min_by("props", "i").alias("props"), F.max_by("props", "i").alias("last_props"),
        F.first("row_props").alias("row_props"), F.first("left").alias("row_left"),
    )
    ends = Window.partitionBy("doc_id", "block")
    head = head.withColumns({"_first": F.col("island") == F.min("island").over(ends), "_end": F.col("island") == F.max("island").over(ends)})
    inner = lambda flag, outer, side: F.when(F.col(flag), F.coalesce(_border("row_props", outer), _border("row_props", side))).otherwise(_border("row_props", side))
    borders = F.struct(
        F.coalesce(_border("props", "clbrdrt"), _border("row_props", "trbrdrt"), _border("row_props", "trbrdrh")).alias("top"),
        F.coalesce(_border("props", "clbrdrl"), inner("_first", "trbrdrl", "trbrdrv")).alias("left"),
        F.coalesce(_border("props", "clbrdrb"), _border("row_props", "trbrdrb"), _border("row_props", "trbrdrh")).alias("bottom"),
        F.coalesce(_border("last_props", "clbrdrr"), inner("_end", "trbrdrr", "trbrdrv")).alias("right"),
    )

    def shading(props: str, h: str) -> Column:
        back, fore, level = F.col(props)[f"{h}cbpat"], F.col(props)[f"{h}cfpat"], F.col(props)[f"{h}shdng"]
        index = lambda c: F.when(c > 0, c)
        some = index(back).isNotNull() | index(fore).isNotNull() | level.isNotNull()
        return F.when(some, F.struct(index(back).alias("background"), index(fore).alias("foreground"), F.when(level.isNotNull(), F.least(F.greatest(level, F.lit(0)), F.lit(10000))).alias("intensity")))

    valign = F.when(prop("clvertalc").isNotNull(), "center").when(prop("clvertalb").isNotNull(), "bottom").otherwise("top")
    return head.join(content, ["doc_id", "block", "island"], "left").select(
        "doc_id", "block", (F.row_number().over(ends.orderBy("island")) - 1).alias("cell_idx"), "island", "right",
        F.struct(*[_padding(s).alias(s) for s in SIDES]).alias("padding"), borders.alias("borders"), valign.alias("vertical_align"),
        F.coalesce(shading("props", "cl"), shading("row_props", "tr")).alias("shading"), F.coalesce("text", F.lit("")).alias("text"),
    )


def blend(background: Column, foreground: Column, intensity: Column) -> Column:
    """Fill of a shaded cell from ``#rrggbb`` colours: white and black where absent; none without any part."""
    back, fore = F.coalesce(background, F.lit("#ffffff")), F.coalesce(foreground, F.lit("#000000"))
    channel = lambda c, at: F.conv(F.substring(c, at, 2), 16, 10).cast("double")
    mixed = lambda at: F.floor(channel(back, at) + (channel(fore, at) - channel(back, at)) * intensity / 10000.0 + 0.5).cast("int")
    return F.when(intensity.isNull(), background).otherwise(F.format_string("#%02x%02x%02x", mixed(2), mixed(4), mixed(6)))
