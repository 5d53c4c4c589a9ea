"""The nested model of a document: one row each, for export as JSON and for layout. Analytics belong on the flat tables.

``model_schema.ddl`` beside this module holds the declared fields. ``python -m docframe.plans.model --write`` writes it
from what the engine makes, ``--check`` fails where the two differ.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators import cells as C
from docframe.operators import lists as L
from docframe.operators import pictures as P
from docframe.operators.document import Parts
from docframe.sources import rtf as R

DECLARED = Path(__file__).with_name("model_schema.ddl")


def _style(s: Column) -> Column:
    flag = lambda n: F.coalesce(s[n], F.lit(False)).alias(n)
    index = lambda n: F.when(s[n] > 0, s[n]).alias(n)
    return F.struct(
        s["font_id"].alias("fontId"), (s["half_points"] / 2.0).alias("fontSize"), flag("bold"), flag("italic"), flag("underline"), flag("strike"),
        index("color"), index("highlight"), flag("hidden"), F.coalesce(s["shift"], F.lit(0.0)).alias("baseline"),
    )


def _paragraphs(events: DataFrame) -> DataFrame:
    """(doc_id, block, para_seq, para): structs of paragraphs; text of a list that has no marker of its own comes first."""
    marks = L.markers(events).select("doc_id", "para_seq", "marker", "follow", "level", F.col("left_indent").alias("_li"), F.col("first_line_indent").alias("_fi"))
    whole = R.paragraph_runs(events).join(marks, ["doc_id", "para_seq"], "left")
    run = lambda text, style, image: F.struct(
        F.when(image.isNull(), "text").otherwise("image").alias("kind"), F.when(image.isNull(), text).alias("text"),
        F.when(image.isNull(), _style(style)).alias("style"), image.alias("imageId"),
    )
    own = F.transform("r", lambda x: run(x["text"], x["style"], x["image_id"]))
    cached = F.array(run(F.col("p.list_text"), F.col("p.mark_style"), F.lit(None).cast("string")))
    runs = F.when(F.col("marker").isNull() & (F.length("p.list_text") > 0), F.concat(cached, own)).otherwise(own)
    style = F.struct(
        F.col("p.align").alias("align"), F.coalesce("_li", "p.left_indent", F.lit(0.0)).alias("leftIndent"), F.col("p.right_indent").alias("rightIndent"),
        F.coalesce("_fi", "p.first_line_indent", F.lit(0.0)).alias("firstLineIndent"), F.col("p.space_before").alias("spaceBefore"),
        F.col("p.space_after").alias("spaceAfter"), F.col("p.line_spacing").alias("lineSpacing"), F.col("p.page_break_before").alias("pageBreakBefore"),
    )
    marker = F.when(F.col("marker").isNotNull(), F.struct(F.col("marker").alias("text"), "follow", "level"))
    para = F.struct(F.lit("paragraph").alias("kind"), runs.alias("runs"), style.alias("style"), _style(F.col("p.mark_style")).alias("markStyle"), marker.alias("listMarker"))
    return whole.select("doc_id", "block", "para_seq", para.alias("para"))


def document_model(events: DataFrame) -> DataFrame:
    """(doc_id, model) of documents that were read. Blocks are of kind paragraph, pageBreak or row; fields of other
    kinds are null. What is gathered in a row is one document, which the scan bounds. Pass events that were written
    (``runtime.write_stage``): they are read several times."""
    in_order = lambda *keys: lambda a, b: F.coalesce(*[F.when(a[k] != b[k], F.when(a[k] < b[k], -1).otherwise(1)) for k in keys], F.lit(0))
    gather = lambda df, keys, value, name, by=("doc_id",): df.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v"))), in_order(*keys)), lambda x: x["v"]).alias(name)
    )
    para = _paragraphs(events)
    placed = C.cell_paragraphs(events).select("doc_id", "block", "para_seq", "island")
    cells = C.cells(events).drop("text")
    row = ("doc_id", "block")
    content = gather(para.join(placed, ["doc_id", "block", "para_seq"]), ["para_seq"], F.col("para"), "_content", (*row, "island"))
    cells = cells.join(content, [*row, "island"], "left")
    inside = F.coalesce("_content", F.array().cast(cells.schema["_content"].dataType))
    no_border = lambda s: F.when(F.col(f"borders.{s}.style") != "none", F.col(f"borders.{s}")).alias(s)
    cell = F.struct("right", inside.alias("blocks"), "padding", F.struct(*[no_border(s) for s in C.SIDES]).alias("borders"), F.col("vertical_align").alias("verticalAlign"), "shading")
    rows = gather(cells, ["cell_idx"], cell, "cells", row).join(C.rows(events), [*row])
    height = F.struct(F.col("height_kind").alias("kind"), F.col("height").alias("value"))
    whole_rows = cells.select("doc_id", "block").distinct()
    free = para.join(whole_rows, ["doc_id", "block"], "left_anti")
    blocks = (
        free.select("doc_id", "block", F.col("para_seq").alias("seq"), "para.*")
        .unionByName(events.where("etype = 'pagebreak'").select("doc_id", "block", "seq", F.lit("pageBreak").alias("kind")), allowMissingColumns=True)
        .unionByName(rows.select("doc_id", "block", F.lit(0).alias("seq"), F.lit("row").alias("kind"), "cells", "left", height.alias("height"), "align"), allowMissingColumns=True)
    )
    one = F.struct(*[c for c in blocks.columns if c not in ("doc_id", "block", "seq")])
    images = P.with_pixels(R.images(events))
    raster = F.when(F.col("raster").isNotNull(), F.struct(F.col("pixel_width").alias("width"), F.col("pixel_height").alias("height"), F.col("raster").alias("data")))
    parts = [
        gather(R.fonts(events), ["font_seq"], F.struct("id", "name", "charset", "codepage"), "fonts"),
        gather(R.colors(events), ["idx"], F.col("rgb"), "colors"),
        gather(blocks, ["block", "seq"], one, "blocks"),
        gather(images, ["image_seq"], F.struct(F.col("image_id").alias("id"), "format", "data", "width", "height", raster.alias("raster")), "images"),
        gather(R.diagnostics(events), ["diag_seq"], F.struct("code", "message", "offset"), "diagnostics"),
    ]
    out = R.documents(events).where("error_code is null")
    for p in parts:
        out = out.join(p, "doc_id", "left")
    some = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    fields = [F.col("schema_version").alias("schemaVersion"), "page", F.col("default_tab").alias("defaultTab"), *[some(c) for c in ("fonts", "colors", "blocks", "images", "diagnostics")]]
    return out.select("doc_id", F.struct(*fields).alias("model"))


def model_json(events: DataFrame) -> DataFrame:
    """(doc_id, json): null fields are left out, bytes are in base 64."""
    return document_model(events).select("doc_id", F.to_json("model").alias("json"))


def declared_type() -> str:
    """The model's type, as declared."""
    return "struct<" + ",".join(DECLARED.read_text().split()) + ">"


def made_fields(spark: SparkSession) -> str:
    """The model's fields as the engine makes them, one on each line."""
    none = R.parse(spark.createDataFrame([], "doc_id string, content binary"))
    return "".join(f"{f.name}:{f.dataType.simpleString()}\n" for f in document_model(none).schema["model"].dataType.fields)


def write_json(events: DataFrame, path: str) -> None:
    """JSON lines of doc_id and model, one for each document that was read."""
    document_model(events).write.json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, model) of JSON lines; fields that are not declared are dropped."""
    return spark.read.schema(f"doc_id string, model {declared_type()}").json(path)


def models_of_json(rows: DataFrame) -> DataFrame:
    """(doc_id, model) of (doc_id, json). A text that is no model has the error ``InvalidModel`` in its layout."""
    return rows.select("doc_id", F.from_json("json", declared_type()).alias("model"))


def parts_of_model(models: DataFrame) -> Parts:
    """What a layout takes, from stored models (doc_id, model): pass rows that were written, they are read several times.

    Columns and one explode for each table, no shuffle. Missing lists are empty; a model that is null or has no page has
    the error ``InvalidModel`` and no pages.
    """
    m = models.select("doc_id", "model.*", (F.col("model").isNull() | F.col("model.page").isNull()).alias("_bad"))
    good = m.where("not _bad")
    each = lambda name, at: good.select("doc_id", F.posexplode(name).alias(at, "v"))
    documents = m.select(
        "doc_id", F.col("schemaVersion").alias("schema_version"), "page", F.coalesce("defaultTab", F.lit(36.0)).alias("default_tab"),
        F.when(F.col("_bad"), "InvalidModel").alias("error_code"), F.lit(None).cast("bigint").alias("error_offset"),
    )
    blocks = each("blocks", "block").select("doc_id", "block", "v.*")
    rows = blocks.where("kind = 'row'").select("doc_id", "block", F.coalesce("left", F.lit(0.0)).alias("left"), F.col("height.kind").alias("height_kind"), F.col("height.value").alias("height"), "align")
    cells = blocks.where("kind = 'row'").select("doc_id", "block", F.posexplode("cells").alias("cell_idx", "c")).select(
        "doc_id", "block", "cell_idx", (F.col("cell_idx") + 1).alias("island"), "c.right", "c.padding", "c.borders", F.col("c.verticalAlign").alias("vertical_align"), "c.shading"
    )
    one = lambda block, island, p: F.struct(
        block.alias("block"), island.cast("int").alias("island"), p["runs"].alias("runs"), p["style"].alias("style"), p["markStyle"].alias("mark"), p["listMarker"].alias("marker")
    )
    inside = lambda b, i: F.flatten(F.transform(b["cells"], lambda c, k: F.transform(c["blocks"], lambda p: one(i, k + 1, p))))
    found = F.flatten(F.transform("blocks", lambda b, i: F.when(b["kind"] == "paragraph", F.array(one(i, F.lit(None), b))).when(b["kind"] == "row", inside(b, i)).otherwise(F.array())))
    paras = good.select("doc_id", F.posexplode(found).alias("para_seq", "x")).select("doc_id", "para_seq", "x.*")

    def style(s: Column) -> Column:
        return F.struct(
            s["fontId"].alias("font_id"), (s["fontSize"] * 2).alias("half_points"), *[s[n].alias(n) for n in ("bold", "italic", "underline", "strike", "color", "highlight", "hidden")],
            s["baseline"].alias("shift"),
        )

    runs = F.transform(
        F.filter("runs", lambda r: (r["kind"] == "image") | ~F.coalesce(r["style"]["hidden"], F.lit(False))),
        lambda r: F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), style(r["style"]).alias("style"), r["imageId"].alias("image_id")),
    )
    s = lambda name: F.col(f"style.{name}")
    p = F.struct(
        s("align").alias("align"), s("leftIndent").alias("left_indent"), s("rightIndent").alias("right_indent"), s("firstLineIndent").alias("first_line_indent"),
        F.coalesce(s("spaceBefore"), F.lit(0.0)).alias("space_before"), F.coalesce(s("spaceAfter"), F.lit(0.0)).alias("space_after"), s("lineSpacing").alias("line_spacing"),
        F.coalesce(s("pageBreakBefore"), F.lit(False)).alias("page_break_before"), style(F.col("mark")).alias("mark_style"), F.lit(None).cast("string").alias("list_text"),
    )
    own = F.struct(s("leftIndent").alias("left_indent"), s("firstLineIndent").alias("first_line_indent"))
    paragraphs = paras.select("doc_id", "block", "para_seq", p.alias("p"), runs.alias("r"), F.col("marker.text").alias("marker"), F.col("marker.follow").alias("follow"), own.alias("_own"))
    stage = F.when(F.col("v.code").isin(*R.RESOLVED), "resolve").otherwise("parse")
    return Parts(
        documents,
        each("fonts", "font_seq").select("doc_id", "font_seq", "v.id", "v.name", "v.charset", "v.codepage"),
        each("colors", "idx").select("doc_id", "idx", F.col("v").alias("rgb")),
        each("images", "image_seq").select("doc_id", "image_seq", F.col("v.id").alias("image_id"), "v.format", "v.data", "v.width", "v.height"),
        rows, cells, paragraphs, paras.where("island is not null").select("doc_id", "block", "para_seq", "island"),
        blocks.where("kind = 'pageBreak'").select("doc_id", "block"),
        each("diagnostics", "diag_seq").select("doc_id", "diag_seq", stage.alias("stage"), "v.code", "v.message", "v.offset"),
    )


def main(argv: list[str]) -> int:
    if argv not in (["--write"], ["--check"]):
        print("usage: python -m docframe.plans.model --write|--check", file=sys.stderr)
        return 2
    made = made_fields(SparkSession.builder.getOrCreate())
    if argv == ["--write"]:
        DECLARED.write_text(made)
        return 0
    return 0 if DECLARED.exists() and DECLARED.read_text() == made else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
