"""Pictures: pixel dimensions, bitmaps inside metafiles, display sizes, admission by document.

PNG headers are read by SQL functions. JPEG frames and metafile records are walks over bytes, so those rows (and only
their bytes) go through one Arrow UDF; a picture is decoded on its own, and a damaged one is a reason, not an exception.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.runtime import ensure_importable

# Limits of one bitmap, one document, one display size (points), and the size without any authored one.
MAX_AXIS, MAX_DIB_PIXELS, MAX_DOCUMENT_PIXELS = 32767, 4_000_000, 32_000_000
MAX_POINTS, DEFAULT_WIDTH, DEFAULT_HEIGHT = 14400.0, 72.0, 54.0
# WMF functions with a DIB, and the bytes of their fields before it.
WMF_DIB_AT = {0x0F43: 22, 0x0B41: 20, 0x0940: 16}
# EMF records with a DIB, and where they keep offset and size of its header and of its bits.
EMF_DIB_AT = {76: 84, 77: 84, 81: 48}
PLACEABLE, COMMENT, COMMENT_HEADER = b"\xd7\xcd\xc6\x9a", 0x0626, 34

PROBED = "struct<width:int,height:int,rgba:binary,reason:string>"


def _records(data: bytes, at: int, head: str, unit: int, least: int) -> Iterator[tuple[int, bytes]]:
    """(kind, whole record) of a metafile up to its first broken record; ``head`` unpacks size and kind by name."""
    size_first = head == "<IH"
    width = struct.calcsize(head)
    while at + least <= len(data):
        one, two = struct.unpack_from(head, data, at)
        size, kind = (one * unit, two) if size_first else (two, one)
        if size < max(least, width) or at + size > len(data):
            return
        yield kind, data[at : at + size]
        at += size


def _header_end(dib: bytes) -> int | None:
    """Bytes of a DIB's header with its palette; None for headers too old to read."""
    if len(dib) < 36:
        return None
    size, (bits,), (used,) = struct.unpack_from("<I", dib)[0], struct.unpack_from("<H", dib, 14), struct.unpack_from("<I", dib, 32)
    if size < 40:
        return None
    return size + (4 * (used or 1 << bits) if bits <= 8 else 0)


def emf_dibs(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, bits) of each blit of an EMF."""
    for kind, record in _records(data, 0, "<II", 1, 8):
        at = EMF_DIB_AT.get(kind)
        if at is None or len(record) < at + 16:
            continue
        info_at, info_n, bits_at, bits_n = struct.unpack_from("<4I", record, at)
        if info_n and bits_n and info_at + info_n <= len(record) and bits_at + bits_n <= len(record):
            yield record[info_at : info_at + info_n], record[bits_at : bits_at + bits_n]


def wmf_dibs(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, bits) of each blit of a WMF, then those of an EMF that its comments carry in pieces."""
    inner = bytearray()
    for kind, record in _records(data, 40 if data.startswith(PLACEABLE) else 18, "<IH", 2, 6):
        body = record[6:]
        if kind in WMF_DIB_AT:
            dib = body[WMF_DIB_AT[kind] :]
            end = _header_end(dib)
            if end is not None and end < len(dib):
                yield dib[:end], dib[end:]
        elif kind == COMMENT and len(body) >= 8:
            escape, n = struct.unpack_from("<HH", body)
            if escape == 15 and body[4:8] == b"WMFC" and COMMENT_HEADER <= n <= len(body) - 4:
                inner += body[4 + COMMENT_HEADER : 4 + n]
    yield from emf_dibs(bytes(inner))


def decode_dib(info: bytes, bits: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, RGBA with the top row first) of an uncompressed DIB, whole arrays at a time."""
    if len(info) < 20:
        return None
    size, w, h, _, depth, packing = struct.unpack_from("<IiiHHI", info)
    rows = abs(h)
    if size < 40 or packing or not 0 < w <= MAX_AXIS or not 0 < rows <= MAX_AXIS or w * rows > MAX_DIB_PIXELS:
        return None
    stride = (w * depth + 31) // 32 * 4
    if depth not in (1, 4, 8, 16, 24, 32) or stride * rows > len(bits):
        return None
    raw = np.frombuffer(bits, np.uint8, stride * rows).reshape(rows, stride)
    raw = raw[::-1] if h > 0 else raw
    out = np.full((rows, w, 4), 255, np.uint8)
    if depth <= 8:
        colours = np.frombuffer(info[size : size + (len(info) - size) // 4 * 4] if len(info) > size else b"", np.uint8).reshape(-1, 4)
        flags = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)[:, :w]
        index = flags @ (1 << np.arange(depth - 1, -1, -1))
        if index.max() >= len(colours):
            return None
        out[..., :3] = colours[index][..., 2::-1]
    elif depth == 16:
        value = raw[:, : 2 * w].copy().view("<u2").astype(np.uint32)
        fives = np.stack([value >> 10, value >> 5, value], axis=-1) & 31
        out[..., :3] = (fives * 255 + 15) // 31
    else:
        n = depth // 8
        out[..., :3] = raw[:, : n * w].reshape(rows, w, n)[..., 2::-1]
    return w, rows, out.tobytes()


def metafile_bitmap(data: bytes, emf: bool) -> tuple[int, int, bytes] | str:
    """The last blit that can be decoded (a mask comes before its picture), or why there is none."""
    found = list(emf_dibs(data) if emf else wmf_dibs(data))
    decoded = (decode_dib(*dib) for dib in reversed(found))
    return next(filter(None, decoded), "UnsupportedBitmap" if found else "NoBitmap")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG's frame header, turned if its EXIF orientation says so."""
    at, turned = 2, False
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + n]
        if mark == 0xE1 and part[:6] == b"Exif\0\0":
            turned = _orientation(part[6:]) >= 5
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if len(part) < 5:
                return None
            h, w = struct.unpack_from(">HH", part, 1)
            return (h, w) if turned else (w, h)
        if n < 2 or mark in (0xD9, 0xDA):
            return None
        at += 2 + n
    return None


def _orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    (first,) = struct.unpack_from(order + "I", tiff, 4)
    if first + 2 > len(tiff):
        return 1
    (n,) = struct.unpack_from(order + "H", tiff, first)
    for at in range(first + 2, min(first + 2 + 12 * n, len(tiff) - 11), 12):
        tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at)
        if tag == 0x0112 and kind == 3:
            return value if 1 <= value <= 8 else 1
    return 1


def _probe(kind: str | None, data: bytes | None) -> tuple:
    if data is None or kind not in ("jpeg", "wmf", "emf"):
        return None, None, None, None
    if kind == "jpeg":
        return (*(jpeg_size(data) or (None, None)), None, None)
    got = metafile_bitmap(data, kind == "emf")
    return (None, None, None, got) if isinstance(got, str) else (*got, None)


def with_pixels(images: DataFrame) -> DataFrame:
    """Add pixel_width, pixel_height, raster (RGBA of a metafile's bitmap) and raster_reason (why there is none)."""
    ensure_importable(images.sparkSession)

    @F.pandas_udf(PROBED)
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, bodies in batches:
            found = [_probe(k, d) for k, d in zip(kinds, bodies)]
            yield pd.DataFrame(found, columns=["width", "height", "rgba", "reason"]).astype({"width": "Int32", "height": "Int32", "rgba": object, "reason": object})

    png = F.col("format") == "png"
    side = lambda at: F.conv(F.hex(F.substring("data", at, 4)), 16, 10).cast("int")
    header = png & (F.octet_length("data") >= 24)
    return (
        images.withColumn("_p", probe("format", F.when(~png, F.col("data"))))
        .withColumns({
            "pixel_width": F.when(header, side(17)).otherwise(F.col("_p.width")),
            "pixel_height": F.when(header, side(21)).otherwise(F.col("_p.height")),
            "raster": F.col("_p.rgba"), "raster_reason": F.col("_p.reason"),
        })
        .drop("_p")
    )


def with_display_size(probed: DataFrame) -> DataFrame:
    """Add display_width and display_height in points: the authored size, else pixels at 96 for each inch (PNG and
    JPEG), else the default size."""
    raster = F.col("format").isin("png", "jpeg")
    size = lambda own, px, default: F.coalesce(F.col(own), F.when(raster, F.col(px) * 72.0 / 96.0), F.lit(default))
    return probed.withColumns({
        "display_width": size("width", "pixel_width", DEFAULT_WIDTH), "display_height": size("height", "pixel_height", DEFAULT_HEIGHT),
    })


def admission(probed: DataFrame) -> DataFrame:
    """Add ``refused``: why a picture makes its document be refused, or null.

    Pixels are summed along each document's pictures, of which the scan allows a few hundred: a window by document.
    """
    df = probed if "display_width" in probed.columns else with_display_size(probed)
    area = F.col("pixel_width").cast("bigint") * F.col("pixel_height")
    order = Window.partitionBy("doc_id").orderBy("image_seq").rowsBetween(Window.unboundedPreceding, 0)
    decoded = F.col("format").isin("png", "jpeg") | F.col("raster").isNotNull()
    spent = F.sum(F.when(decoded, F.coalesce(area, F.lit(0))).otherwise(0)).over(order)
    good = lambda c, most: F.coalesce(F.col(c).between(1, most), F.lit(False))
    shown = lambda c: (F.col(c) > 0) & (F.col(c) <= MAX_POINTS)
    return df.withColumn(
        "refused",
        F.when(~(shown("display_width") & shown("display_height")), "display-size")
        .when(decoded & ~(good("pixel_width", MAX_AXIS) & good("pixel_height", MAX_AXIS)), "pixel-size")
        .when(decoded & (spent > MAX_DOCUMENT_PIXELS), "pixel-budget"),
    )


def picture_diagnostics(probed: DataFrame) -> DataFrame:
    """(doc_id, image_id, stage, code) of pictures that are shown by approximation or by a placeholder."""
    metafile = F.col("format").isin("wmf", "emf")
    code: Column = F.when(metafile & F.col("raster").isNotNull(), "approximated-metafile-bitmap").when(metafile, "unsupported-vector-image")
    rows = probed.select(
        "doc_id", "image_id",
        F.array_compact(F.array(
            F.when(code.isNotNull(), F.struct(F.lit("parse").alias("stage"), code.alias("code"))),
            F.when(F.col("raster").isNull() & ~F.col("format").isin("png", "jpeg"), F.struct(F.lit("resources").alias("stage"), F.lit("unsupported-image-format").alias("code"))),
        )).alias("_d"),
    )
    return rows.select("doc_id", "image_id", F.inline("_d"))
