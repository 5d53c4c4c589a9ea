"""Pages as SVG text, from the display list of a layout.

A page is one row: its steps are gathered in the order of paint, which the layout's limits bound. Shapes and glyphs are
columns; only the pixels of metafiles, which no SVG shows as they are, are packed as PNG in Python, in Arrow batches.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.operators import pictures as P
from docframe.operators.document import Layout
from docframe.runtime import ensure_importable

_ORDER = ("layer", "line", "piece", "step")


def png(rgba: bytes, width: int, height: int) -> bytes:
    """Pixels of four bytes each, row by row, as a PNG file."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + rgba[k : k + 4 * width] for k in range(0, 4 * width * height, 4 * width))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def picture_urls(images: DataFrame) -> DataFrame:
    """(doc_id, image_id, url): data URLs of the pictures that can be shown, from ``rtf.images``."""
    ensure_importable(images.sparkSession)

    @F.pandas_udf("binary")
    def packed(rgba: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else png(r, int(w), int(h)) for r, w, h in zip(rgba, width, height)], dtype=object)

    probed = P.with_pixels(images)
    url = lambda kind, data: F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(data))
    file = F.col("format").isin("png", "jpeg")
    made = packed(F.when(~file, F.col("raster")), F.col("pixel_width"), F.col("pixel_height"))
    return probed.select(
        "doc_id", "image_id", F.when(F.col("format") == "png", url("png", F.col("data"))).when(file, url("jpeg", F.col("data"))).otherwise(url("png", made)).alias("url")
    ).where("url is not null")


def _number(c: Column) -> Column:
    """At most three decimals, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.3f", c + 0.0), r"\.?0+$", "")


def _escaped(c: Column) -> Column:
    """Text or attribute of XML; what XML cannot hold is left out."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        clean = F.replace(clean, F.lit(raw), F.lit(named))
    return clean


def page_svg(layout: Layout, urls: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, svg) of each page. ``urls`` (:func:`picture_urls`) are the pictures; without them, or where one
    is missing, a picture is left out."""
    steps = layout.display_list
    if urls is None:
        steps = steps.withColumn("url", F.lit(None).cast("string"))
    else:
        steps = steps.join(urls.select("doc_id", F.lit("image").alias("op"), F.col("image_id").alias("text"), "url"), ["doc_id", "op", "text"], "left")
    x, y, w, h = (_number(F.col(c)) for c in ("x", "y", "width", "height"))
    far, low = _number(F.col("x") + F.col("width")), _number(F.col("y") + F.col("height"))
    ink, op = _escaped(F.col("color")), F.col("op")
    at = lambda fmt, *c: F.format_string(fmt, *c)
    shape = (
        F.when(op == "fill", at('<rect x="%s" y="%s" width="%s" height="%s" fill="%s"/>', x, y, w, h, ink))
        .when(op == "stroke", at('<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="%s" stroke-width="%s"/>', x, y, far, y, ink, h))
        .when(op == "outline", at('<rect x="%s" y="%s" width="%s" height="%s" fill="none" stroke="%s" stroke-width="0.5"/>', x, y, w, h, ink))
        .when(op == "diagonal", at('<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="%s" stroke-width="0.5"/>', x, y, far, low, ink))
        .when(op == "text", at('<text x="%s" y="%s" fill="%s" style="font: %s" xml:space="preserve">%s</text>', x, y, ink, _escaped(F.col("font")), _escaped(F.col("text"))))
        .when((op == "image") & F.col("url").isNotNull(), at('<image x="%s" y="%s" width="%s" height="%s" preserveAspectRatio="none" href="%s"/>', x, y, w, h, F.col("url")))
    )
    drawn = steps.select("doc_id", "page", *_ORDER, shape.alias("shape"), "width", "height").where("shape is not null")
    sheet = F.struct(_number(F.col("width")).alias("w"), _number(F.col("height")).alias("h"))
    whole = drawn.groupBy("doc_id", "page").agg(
        F.max(F.when(F.col("layer") == 0, sheet)).alias("s"), F.sort_array(F.collect_list(F.struct(*_ORDER, "shape"))).alias("v")
    )
    top = at('<svg xmlns="http://www.w3.org/2000/svg" width="%spt" height="%spt" viewBox="0 0 %s %s">', F.col("s.w"), F.col("s.h"), F.col("s.w"), F.col("s.h"))
    return whole.select("doc_id", "page", F.concat_ws("\n", top, F.transform("v", lambda r: r["shape"]), F.lit("</svg>")).alias("svg"))


def write_svg(pages: DataFrame, path: str) -> None:
    """Rows of :func:`page_svg` as Parquet, read again with ``spark.read.parquet``: a page is a row, not a file."""
    pages.write.option("compression", "zstd").parquet(path)
