import hashlib
import json
import random

import pytest

from docframe.operators import document as D
from docframe.operators import layout as Y
from docframe.operators.fonts import FIXED, Face, font_samples, font_style, resolve_fonts
from docframe.sources import corpus
from docframe.sources import rtf as R

HEAD = r"{\rtf1\ansi{\fonttbl{\f0 Alpha;}{\f1 Beta;}}{\colortbl;\red255\green0\blue0;}\paperw6000\paperh4000\margl400\margr400\margt400\margb400\f0\fs20 "
PNG = "89504e470d0a1a0a0000000d49484452000000100000000c08020000"


def laid(spark, bodies, **options):
    rows = [(k, bytearray(b.encode())) for k, b in bodies.items()]
    return D.lay_out(R.parse(spark.createDataFrame(rows, "doc_id string, content binary")), **({"default": FIXED} | options))


def item(text=None, **values):
    base = {"text": text, "image_id": None, "width": 0.0, "height": 0.0, "family": "a", "line_box": None, "font": "", "font_size": 10.0, "shift": 0.0}
    return base | {"color": "#000000", "highlight": None, "underline": False, "strike": False, "shown": True} | values


def frame(**values):
    return {"left_indent": 0.0, "first_line_indent": 0.0, "right_indent": 0.0, "align": "left", "spacing_kind": "auto", "spacing_value": None} | values


def texts(got):
    return ["".join(f["text"] or "<>" for f in ln["fragments"]) for ln in got["lines"]]


def test_lines_agree_with_the_plain_flow():
    r, setter = random.Random(5), D.Setter({}, FIXED)
    for _ in range(300):
        text = "".join(r.choice("ab   \tcd\n漢字。「") for _ in range(r.randrange(40)))
        column, left, first = r.choice([12, 30, 61.0, 200]), r.choice([0.0, 7.0]), r.choice([-5.0, 0.0, 9.0])
        cut = r.randrange(len(text) + 1)  # a change of style changes no line
        got = setter.lines([item(text[:cut]), item(text[cut:])], item(""), column, 1e9, frame(left_indent=left, first_line_indent=first), 36.0)
        want = Y.flow(text, column, left, 0.0, first)
        assert texts(got) == ["".join(p["text"] for p in ln["pieces"]) for ln in want], (text, column)
        assert [ln["x"] for ln in got["lines"]] == pytest.approx([ln["start"] for ln in want])
        assert got["heights"] == [10.0] * len(want)


def test_line_boxes_shifts_and_spacing():
    setter = D.Setter({"Big": Face(1.0, 1.5, 0.5)}, FIXED)
    line = lambda items, **f: setter.lines(items, item(""), 500.0, 700.0, frame(**f), 36.0)
    got = line([item("a"), item("b", family="big", font_size=20.0)])
    assert got["heights"] == [40.0] and [f["baseline"] for f in got["lines"][0]["fragments"]] == [30.0, 30.0]
    assert line([item("b", family="big", line_box=1.0)])["heights"] == [10.5]  # 7.5 and 2.5 beside 8 and 2 of the mark
    assert line([item("b", family="big", line_box=float("nan"))])["heights"] == [20.0]
    raised = line([item("a", shift=4.0)])
    assert raised["heights"] == [14.0] and raised["lines"][0]["fragments"][0]["baseline"] == 8.0
    assert line([item("a")], spacing_kind="exact", spacing_value=4.0)["heights"] == [4.0]
    assert line([item("a")], spacing_kind="multiple", spacing_value=1.5)["heights"] == [15.0]
    image = line([item("a"), item(None, image_id="i", width=30.0, height=50.0), item("b")])
    assert image["heights"] == [52.0] and texts(image) == ["a<>b"]
    assert [(f["x"], f["y"], f["height"]) for f in image["lines"][0]["fragments"]] == [(0.0, 0.0, 52.0), (5.0, 0.0, 50.0), (35.0, 0.0, 52.0)]


def test_line_codes():
    setter = D.Setter({}, FIXED)
    run = lambda items, column, room=700.0, **f: setter.lines(items, item(""), column, room, frame(**f), 36.0)["codes"]
    assert run([item("a b")], 100.0) == []
    assert run([item(None, image_id="i", width=120.0, height=5.0)], 100.0) == ["oversized-inline"]
    assert run([item("a")], 100.0, room=9.0) == ["oversized-line"]
    assert run([item("a")], 10.0, left_indent=20.0) == ["narrow-column", "oversized-inline"]


@pytest.fixture(scope="module")
def sample(spark):
    row = r"\trowd\trbrdrt\brdrs\cellx2000\clvertalc\cellx4000\intbl one\par two\cell three\cell\row "
    tall = r"\pard\trowd\clvertalb\trbrdrt\brdrs\cellx2000\intbl " + r"x\par " * 20 + r"y\cell\row "
    return laid(spark, {
        "a": HEAD + r"Hello \f1 wor\cf1\ul ld\par" + row + r"\pard\qr end{\pict\pngblip\picwgoal400\pichgoal400 " + PNG + r"} x\par\page new\par}",
        "tall": HEAD + "t\\par" + tall + "}",
        "bad": "nope",
        "margins": HEAD.replace(r"\margl400", r"\margl9000") + "x}",
        "many": HEAD + r"\page " * 6 + "}",
        "empty": HEAD + "}",
        "dropped": HEAD + r"\trowd\cellx0\intbl kept\cell\row}",
        "complex": HEAD + r"\u1488?\par\pard\ls9 x\par}",
    }, max_pages=5)


def test_document_geometry(sample):
    got = [tuple(r) for r in sample.lines.where("doc_id = 'a'").orderBy("page", "line").select("page", "x", "y", "width", "height").collect()]
    assert got == [(0, 20.0, 20.0, 55.0, 10.0), (0, 20.0, 30.0, 15.0, 10.0), (0, 20.0, 40.0, 15.0, 10.0), (0, 120.0, 35.0, 25.0, 10.0),
                   (0, 235.0, 50.0, 45.0, 22.0), (1, 265.0, 20.0, 15.0, 10.0)]
    first = sample.fragments.where("doc_id = 'a' and page = 0 and line = 0").orderBy("piece").collect()
    assert [(f["text"], f["color"], f["underline"]) for f in first] == [("Hello", "#000000", False), (" ", "#000000", False), ("wor", "#000000", False), ("ld", "#ff0000", True)]
    assert first[0]["font"] == '10px "Alpha", serif' and first[0]["baseline"] == 28.0
    paint = sample.display_list.where("doc_id = 'a'").groupBy("op").count().collect()
    assert {r["op"]: r["count"] for r in paint} == {"fill": 4, "text": 11, "stroke": 8, "image": 1}  # an underlined picture has no line


def test_rows_are_cut_over_pages(sample):
    lines = sample.lines.where("doc_id = 'tall'").groupBy("page").count().orderBy("page").collect()
    assert [tuple(r) for r in lines] == [(0, 16), (1, 6)]  # 160 points of content for each page
    assert sample.rules.where("doc_id = 'tall'").groupBy("page").count().orderBy("page").collect() == [(0, 2), (1, 1)]


def test_document_errors_and_diagnostics(sample):
    errors = {r["doc_id"]: r["error_code"] for r in sample.errors.collect()}
    assert errors == {"bad": "InvalidHeader", "margins": "InvalidPage", "many": "PageLimit"}
    assert {r["doc_id"] for r in sample.pages.select("doc_id").distinct().collect()} == {"a", "tall", "empty", "dropped", "complex"}
    assert [r["text"] for r in sample.fragments.where("doc_id = 'dropped'").collect()] == ["kept"]
    codes = {(r["doc_id"], r["code"]) for r in sample.diagnostics.where("stage <> 'parse'").collect()}
    assert codes == {("tall", "unsupported-split-row-alignment"), ("dropped", "invalid-table-definition"), ("complex", "complex-script-layout"), ("complex", "unresolved-list-reference")}


def test_no_documents(spark):
    got = D.lay_out(R.parse(spark.createDataFrame([], "doc_id string, content binary")))
    assert [getattr(got, n).count() for n in ("pages", "lines", "fragments", "rules", "display_list", "diagnostics", "errors")] == [0] * 7


def test_document_model(spark):
    from docframe.plans.model import model_json

    row = r"\trowd\cellx2000\clmrg\cellx3000\cellx4000\intbl one\par two\cell\cell three\cell\row "
    bodies = {"a": HEAD + r"x\b y\par\page " + row + r"\pard z{\pict\pngblip " + PNG + r"}\par}", "bad": "nope", "empty": r"{\rtf1}"}
    events = R.parse(spark.createDataFrame([(k, bytearray(v.encode())) for k, v in bodies.items()], "doc_id string, content binary"))
    got = {r["doc_id"]: json.loads(r["json"]) for r in model_json(events).collect()}
    assert set(got) == {"a", "empty"} and got["empty"]["blocks"] == got["empty"]["images"] == []
    m = got["a"]
    assert [b["kind"] for b in m["blocks"]] == ["paragraph", "pageBreak", "row", "paragraph"]
    assert [(r["text"], r["style"]["bold"], r["style"]["fontSize"]) for r in m["blocks"][0]["runs"]] == [("x", False, 10.0), ("y", True, 10.0)]
    cells = m["blocks"][2]["cells"]
    assert [c["right"] for c in cells] == [150.0, 200.0]
    assert [["".join(r["text"] for r in b["runs"]) for b in c["blocks"]] for c in cells] == [["one", "two"], ["three"]]
    assert [r["kind"] for r in m["blocks"][3]["runs"]] == ["text", "image"] and m["images"][0]["id"] == m["blocks"][3]["runs"][1]["imageId"]
    assert [f["name"] for f in m["fonts"]] == ["Alpha", "Beta"] and m["page"]["width"] == 300.0 and m["schemaVersion"] == 2


def test_fonts(spark):
    from pyspark.sql import functions as F

    events = R.parse(spark.createDataFrame([("a", bytearray((HEAD + r"one \f1 two\v  no\par}").encode()))], "doc_id string, content binary"))
    fonts = resolve_fonts(R.fonts(events), {"Alpha": "Other", "Beta": ""}, {"Beta": 1.2, "Alpha": -1.0}, "monospace")
    assert [tuple(r) for r in fonts.orderBy("id").select("family", "line_box").collect()] == [("Other", None), ("monospace", 1.2)]
    assert {(r["family"], r["sample"]) for r in font_samples(R.runs(events), fonts).collect()} == {("Other", "one "), ("monospace", "two")}
    style = spark.range(1).select(font_style(F.lit('A "b"'), F.lit(10.5), F.lit(True), F.lit(True), "serif")).first()[0]
    assert style == 'italic bold 10.5px "A \\"b\\"", serif, serif'


def test_corpus(spark, tmp_path):
    real = tmp_path / "fixtures" / "real"
    real.mkdir(parents=True)
    for name in ("a.rtf", "stray.rtf", "a.pdf"):
        (real / name).write_bytes(name.encode())
    digest = lambda n: hashlib.sha256(n.encode()).hexdigest()
    good = {
        "id": "a-1.2", "producer": {"application": "x", "version": "1", "generator": "g", "platform": "p", "packages": ["q"]}, "features": ["f"], "commands": ["c"],
        "fonts": [{"family": "A", "package": "b", "path": "c", "sha256": "0" * 64}],
        "artifacts": [{"path": f"fixtures/real/{n}", "kind": k, "sha256": digest(n), "producedBy": "x"} for n, k in (("a.rtf", "document"), ("a.pdf", "pdf"))],
        "deltas": [{"id": "d", "classification": "font", "summary": "s", "measured": "m", "status": "open"}],
    }
    bad = json.loads(json.dumps(good)) | {"id": "Bad Id", "features": []}
    bad["producer"]["version"] = " "
    bad["artifacts"] = [{"path": "fixtures/real/gone", "kind": "odd", "sha256": "", "producedBy": ""}, {"path": "/etc/x", "kind": "document", "sha256": "", "producedBy": "x"},
                        {"path": "fixtures/real/a.pdf", "kind": "text", "sha256": "1", "producedBy": "x"}]
    bad["deltas"] = [{"id": "d", "classification": "odd", "summary": "", "measured": None, "status": "x"}] * 2
    files = corpus.digests(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)), str(tmp_path))
    run = lambda docs: corpus.problems(corpus.read_manifest(spark, _write(tmp_path, docs)), files)
    assert [tuple(r) for r in run([good]).collect()] == [(None, "fixtures/real/stray.rtf", "not-in-manifest")]
    assert "no-documents" in {r["problem"] for r in run([]).collect()}
    assert "id-used-twice" in {r["problem"] for r in run([good, good]).collect()}
    found = {r["problem"] for r in run([bad]).where("document is not null").collect()}
    assert found == {"bad-id", "producer-version-missing", "no-features", "unknown-kind", "produced-by-missing", "file-missing", "path-outside", "digest-differs",
                     "unknown-classification", "summary-missing", "measurement-missing", "unknown-status", "delta-id-used-twice"}


def _write(folder, docs):
    path = folder / f"manifest{len(docs)}{len(json.dumps(docs))}.json"
    path.write_text(json.dumps({"documents": docs}))
    return str(path)
