"""Sinks, stored models and streams: what leaves the engine, and what comes back in."""

import base64
import struct
import xml.etree.ElementTree as ET
import zlib

import pytest

from docframe.operators import document as D
from docframe.operators.fonts import FIXED
from docframe.plans import model as M
from docframe.runtime import write_stage
from docframe.sources import rtf as R
from docframe.sources import sinks as S
from docframe.streaming.arrivals import keep_arrivals

HEAD = r"{\rtf1\ansi{\fonttbl{\f0 Alpha;}{\f1 Beta;}}{\colortbl;\red255\green0\blue0;}\paperw6000\paperh4000\margl400\margr400\margt400\margb400\f0\fs20 "
PNG = "89504e470d0a1a0a0000000d49484452000000100000000c08020000"
ROW = r"\trowd\trbrdrt\brdrs\clshdng5000\cellx2000\clvertalc\clmrg\cellx3000\cellx4000\intbl one\par two\cell three\cell four\cell\row "
DOCS = {
    "plain": HEAD + r"Hello \f1 wor\cf1\ul ld\v no\v0\par\page " + ROW + r"\pard\qr e<&>nd{\pict\pngblip\picwgoal400\pichgoal400 " + PNG + r"}\par}",
    "lists": r"{\rtf1{\*\listtable{\list{\listlevel\levelnfc0\levelfollow1\levelstartat3{\leveltext\'02\'00.;}{\levelnumbers\'01;}\fi-360\li720}\listid1}}{\*\listoverridetable{\listoverride\listid1\ls1}}\ls1 one\par two\par\pard{\listtext x }y\par}",
    "cut": HEAD + r"\trowd\clvertalb\trbrdrt\brdrs\cellx2000\intbl " + r"x\par " * 20 + r"y\cell\row}",
    "lost": HEAD + r"{\pict\emfblip\picwgoal400\pichgoal200 00}\strike s\par}",
    "margins": HEAD.replace(r"\margl400", r"\margl9000") + "x}",
    "dropped": HEAD + r"\trowd\cellx0\intbl kept\cell\row}",
    "empty": HEAD + "}",
}
VIEWS = ("pages", "lines", "fragments", "rules", "display_list", "diagnostics", "errors")


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, bytearray(v.encode())) for k, v in DOCS.items()]
    return write_stage(R.parse(spark.createDataFrame(rows, "doc_id string, content binary")), "test-events")


@pytest.fixture(scope="module")
def laid(events):
    return D.lay_out(events, default=FIXED)


def rows(df):
    names = sorted(c for c in df.columns if c not in ("para_seq", "diag_seq", "_"))
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_a_stored_model_is_laid_out_like_its_document(spark, events, laid, tmp_path):
    path = str(tmp_path / "models")
    M.write_json(events, path)
    again = D.lay_out_parts(M.parts_of_model(M.read_json(spark, path)), default=FIXED)
    for view in VIEWS:
        assert rows(getattr(again, view)) == rows(getattr(laid, view)), view


def test_models_that_are_none(spark):
    told = spark.createDataFrame([("null", None), ("text", "no json"), ("bare", "{}"), ("page", '{"page":{"width":100,"height":100,"marginLeft":1,"marginRight":1,"marginTop":1,"marginBottom":1}}')], "doc_id string, json string")
    got = D.lay_out_parts(M.parts_of_model(M.models_of_json(told)))
    assert {tuple(r) for r in got.errors.collect()} == {(k, "InvalidModel") for k in ("null", "text", "bare")}
    assert [tuple(r) for r in got.pages.collect()] == [("page", 0, 100.0, 100.0)]
    none = D.lay_out_parts(M.parts_of_model(M.models_of_json(told.limit(0))))
    assert [getattr(none, v).count() for v in VIEWS] == [0] * len(VIEWS)


def test_the_declared_fields_are_those_made(spark):
    assert M.DECLARED.read_text() == M.made_fields(spark)
    assert M.main(["--check"]) == 0 and M.main([]) == 2


def test_pages_as_svg(events, laid):
    urls = S.picture_urls(R.images(events))
    pages = {(r["doc_id"], r["page"]): ET.fromstring(r["svg"]) for r in S.page_svg(laid, urls).collect()}
    assert set(pages) == {(r["doc_id"], r["page"]) for r in laid.pages.collect()}
    tags = lambda key: [e.tag.rsplit("}", 1)[-1] for e in pages[key]]
    assert tags(("empty", 0))[0] == "rect"
    first = [e for e in pages["plain", 0] if e.tag.endswith("text")]
    assert "".join(e.text for e in first) == "Hello world" and first[-1].get("fill") == "#ff0000"
    assert first[0].get("style") == 'font: 10px "Alpha", serif' and first[0].get("x") == "20" and first[0].get("y") == "28"
    second = pages["plain", 1]
    assert "e<&>nd" in [e.text for e in second]
    (image,) = [e for e in second if e.tag.endswith("image")]
    assert image.get("href") == "data:image/png;base64," + base64.b64encode(bytes.fromhex(PNG)).decode() and image.get("width") == "20"
    assert tags(("lost", 0)) == ["rect", "rect", "rect", "line", "text", "line"]  # page, box, outline, diagonal, text, strike
    box, edge, slash = list(pages["lost", 0])[1:4]
    assert (box.get("fill"), edge.get("stroke"), edge.get("stroke-width")) == ("#f1f3f5", "#9aa3ac", "0.5")
    assert [slash.get(k) for k in ("x1", "y1", "x2", "y2")] == ["20", "20", "40", "30"]
    bare = S.page_svg(laid).where("svg like '%<image%'")
    assert bare.count() == 0


def test_png_of_pixels():
    data = S.png(bytes(range(24)), 2, 3)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">IIBB", data[16:26]) == (2, 3, 8, 6)
    at = data.index(b"IDAT")
    (size,) = struct.unpack(">I", data[at - 4 : at])
    lines = zlib.decompress(data[at + 4 : at + 4 + size])
    assert lines == b"".join(b"\0" + bytes(range(k, k + 8)) for k in (0, 8, 16))


def test_arrivals_are_kept_once(spark, tmp_path):
    came, out = tmp_path / "in", str(tmp_path / "out")
    came.mkdir()
    put = lambda name, body: (came / name).write_bytes(body)
    run = lambda: keep_arrivals(spark, str(came), out, "test", lambda e: R.document_texts(e), want={"doc", "doctext"}).awaitTermination(60)
    told = lambda: sorted((r["doc_id"].rsplit("/", 1)[-1], r["text"]) for r in spark.read.parquet(out).collect())
    put("a.rtf", rb"{\rtf1 A\par}")
    put("a.txt", rb"{\rtf1 no\par}")
    assert run() and told() == [("a.rtf", "A")]
    put("b.rtf", rb"{\rtf1 B\par C\par}")
    assert run() and told() == [("a.rtf", "A"), ("b.rtf", "B\nC")]
    assert run() and len(told()) == 2
