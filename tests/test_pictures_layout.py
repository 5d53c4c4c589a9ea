import struct

import numpy as np
import pytest

from docframe.operators import layout as Y
from docframe.operators import pictures as P


def dib(w, h, depth, rows, palette=()):
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, 0, 0, 0, len(palette), 0) + b"".join(bytes([b, g, r, 0]) for r, g, b in palette)
    return info, b"".join(r + b"\0" * (-len(r) % 4) for r in rows)


def emf(info, bits, kind=81):
    at = 48 if kind == 81 else 84
    head = struct.pack("<II", kind, at + 16 + len(info) + len(bits)) + b"\0" * (at - 8)
    return head + struct.pack("<4I", at + 16, len(info), at + 16 + len(info), len(bits)) + info + bits


@pytest.mark.parametrize(
    ("made", "first"),
    [
        (dib(2, 1, 1, [b"\x40"], [(1, 2, 3), (9, 8, 7)]), (1, 2, 3)),
        (dib(2, 1, 4, [b"\x10"], [(1, 2, 3), (9, 8, 7)]), (9, 8, 7)),
        (dib(1, 2, 8, [b"\x00", b"\x01"], [(1, 2, 3), (9, 8, 7)]), (9, 8, 7)),  # bottom row first
        (dib(1, -2, 8, [b"\x00", b"\x01"], [(1, 2, 3), (9, 8, 7)]), (1, 2, 3)),
        (dib(1, 1, 16, [struct.pack("<H", 31 << 10)]), (255, 0, 0)),
        (dib(1, 1, 24, [b"\x03\x02\x01"]), (1, 2, 3)),
        (dib(1, 1, 32, [b"\x03\x02\x01\x00"]), (1, 2, 3)),
    ],
)
@pytest.mark.parametrize("kind", [76, 81])
def test_dibs(made, first, kind):
    w, h, rgba = P.metafile_bitmap(emf(*made, kind=kind), True)
    assert len(rgba) == 4 * w * h and tuple(rgba[:3]) == first and rgba[3] == 255


def test_damaged_metafiles_give_reasons():
    assert P.metafile_bitmap(b"", True) == P.metafile_bitmap(b"\0" * 30, False) == "NoBitmap"
    info, bits = dib(1, 1, 8, [b"\x05"], [(1, 2, 3)])
    assert P.metafile_bitmap(emf(info, bits), True) == "UnsupportedBitmap"  # outside its palette
    good = emf(*dib(1, 1, 24, [b"\x03\x02\x01"]))
    assert P.metafile_bitmap(good + emf(info, bits), True)[:2] == (1, 1)
    rng = np.random.default_rng(1)
    for _ in range(300):
        data = bytearray(good)
        data[rng.integers(len(data))] = rng.integers(256)
        P.metafile_bitmap(bytes(data[: rng.integers(len(data) + 1)]), True)
        P.metafile_bitmap(bytes(data), False)


def test_emf_in_wmf_comments():
    inner, wmf = emf(*dib(1, 1, 24, [b"\x03\x02\x01"])), b"\0" * 18
    for piece in (inner[:40], inner[40:]):
        body = struct.pack("<HH", 15, 34 + len(piece)) + b"WMFC" + b"\0" * 30 + piece
        body += b"\0" * (len(body) % 2)
        wmf += struct.pack("<IH", (6 + len(body)) // 2, 0x0626) + body
    assert P.metafile_bitmap(wmf, False) == (1, 1, b"\x01\x02\x03\xff")


def test_jpeg_sizes():
    frame = b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 4
    exif = b"Exif\0\0MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    assert P.jpeg_size(b"\xff\xd8" + frame) == (40, 30)
    assert P.jpeg_size(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + frame) == (30, 40)
    assert P.jpeg_size(b"\xff\xd8\xff\xda\0\2") is P.jpeg_size(b"") is None


def texts(lines):
    return ["".join(p["text"] for p in line["pieces"]) for line in lines]


def test_flow():
    assert texts(Y.flow("hi abcdef", 35)) == ["hi", "abcdef"]
    assert texts(Y.flow("abcdefghij", 20)) == ["abcd", "efgh", "ij"]
    assert texts(Y.flow("one\ntwo\n", 100)) == ["one", "two", ""]
    assert texts(Y.flow("", 100)) == [""]
    assert texts(Y.flow("ab", 2)) == ["a", "b"]  # one character at least
    assert texts(Y.flow("漢字、漢", 10)) == ["漢", "字、", "漢"]
    (line,) = Y.flow("a\tb", 200, left=10)
    assert [p["width"] for p in line["pieces"]] == [5, 21, 5]  # 10 + 5 to the stop at 36
    first, second = Y.flow("aaaa bbbb", 30, first=5)
    assert (first["start"], first["room"], second["start"], second["room"]) == (5, 25, 0, 30)


def test_justified_pieces_fill_the_line(spark):
    df = spark.createDataFrame([(1, "aa bb cc", "justify", 0.0, 0.0, 0.0)], "doc_id int, text string, align string, left_indent double, right_indent double, first_line_indent double")
    got = Y.fragments(Y.lay_lines(df, 30.0), ["doc_id"]).orderBy("line", "piece").collect()
    assert [(r.line, r.text, r.x, r.width) for r in got] == [(0, "aa", 0, 10), (0, " ", 10, 10), (0, "bb", 20, 10), (1, "cc", 0, 10)]


def test_rows_are_cut_at_lines(spark):
    rows = spark.createDataFrame([("d", 0, 30.0, [30.0]), ("d", 1, 30.0, [10.0, 20.0, 30.0]), ("d", 2, 100.0, [100.0]), ("d", 3, 0.0, None)], "doc_id string, block int, height double, stops array<double>")
    got = Y.split_rows(rows, 50.0, ["block"]).collect()
    assert [(r.block, r.page, r.y, r.cut_from, r.cut_to, r.closing) for r in got] == [
        (0, 0, 0, 0, 30, True), (1, 0, 30, 0, 20, False), (1, 1, 0, 20, 30, True), (2, 2, 0, 0, 100, False), (2, 3, 0, 100, 100, True),
    ]
