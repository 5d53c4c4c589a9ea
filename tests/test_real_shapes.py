"""Documents in the shapes that word processors write, from bytes to pages: what comes out of each step."""

import pytest

from docframe.operators import cells, document, lists
from docframe.operators.fonts import FIXED
from docframe.plans.model import document_model
from docframe.sources import rtf

#: A letter as office programs write it: style sheet, defaults, information, associated fonts, language marks.
LETTER = rb"""{\rtf1\adeflang1025\ansi\ansicpg1252\uc1\adeff0\deff0\stshfdbch0\stshfloch31506\deflang1033
{\fonttbl{\f0\fbidi \froman\fcharset0\fprq2{\*\panose 02020603050405020304}Times New Roman;}{\f1\fswiss\fcharset204\fprq2 Body\u233?;}}
{\colortbl;\red0\green0\blue0;\red192\green0\blue0;}{\*\defchp \fs22\f0 }{\*\defpap \ql \li0\ri0\sa160\sl259\slmult1 }
{\stylesheet{\ql\li0\ri0 \snext0 Normal;}{\s1\b\fs32 heading 1;}}{\*\rsidtbl \rsid1}{\*\generator Somebody's writer 1.0;}
{\info{\title A letter}{\author Nobody}{\creatim\yr2024\mo1\dy2}}\paperw12240\paperh15840\margl1440\margr1440\margt1440\margb1440
\widowctrl\ftnbj \fet0{\*\wgrffmtfilter 2450}\sectd \ltrsect\linex0\endnhere
\pard\plain \ltrpar\ql \li0\ri0\sb120 {\rtlch\fcs1 \af0 \ltrch\fcs0 \b\insrsid1 Dear {\cf2 reader},\par }
\pard\plain {\rtlch \ltrch\fcs0 \insrsid1 It costs 5\u160 ?\'80 {\*\bkmkstart a}today{\*\bkmkend a}\endash  no more.\par}
{\field{\*\fldinst { HYPERLINK "http://example.org" }}{\fldrslt {\ul\cf1 a link}}}\par
\pard {\f1 \'cf\'f0\'e8\'e2\'e5\'f2}\par}"""

#: A bullet list and a numbered one, each item with the cached label that old readers show.
LIST = rb"""{\rtf1\ansi\deff0{\fonttbl{\f0 Serif;}{\f3\fcharset2 Symbols;}}
{\*\listtable{\list\listtemplateid1\listhybrid{\listlevel\levelnfc23\levelnfcn23\leveljc0\levelfollow0\levelstartat1{\leveltext\leveltemplateid1\'01\u8226 ?;}{\levelnumbers;}\f3\fi-360\li720}\listid11}
{\list{\listlevel\levelnfc0\levelfollow1\levelstartat3{\leveltext\'02\'00.;}{\levelnumbers\'01;}\fi-360\li720}{\listlevel\levelnfc4\levelstartat1{\leveltext\'04\'00.\'01);}{\levelnumbers\'01\'03;}}\listid12}}
{\*\listoverridetable{\listoverride\listid11\listoverridecount0\ls1}{\listoverride\listid12\listoverridecount0\ls2}}
\pard\ls1{\listtext\f3\'b7\tab}apples\par{\listtext\f3\'b7\tab}pears\par
\pard\ls2\ilvl0{\listtext 3. }one\par\ilvl1{\listtext 3.a) }deep\par\ilvl1 deeper\par\ilvl0 two\par\pard plain\par}"""

#: A table with borders that the row gives, a merged pair of cells, a shaded one, and text between rows.
TABLE = rb"""{\rtf1\ansi{\colortbl;\red255\green255\blue255;\red0\green0\blue0;}
\trowd\trgaph100\trleft0\trbrdrt\brdrs\brdrw20\trbrdrl\brdrs\trbrdrb\brdrs\trbrdrr\brdrs\clcbpat1\clcfpat2\clshdng5000\cellx2000\clmgf\cellx4000\clmrg\cellx6000
\pard\intbl a\cell b\cell\cell\row
\trowd\trrh-400\clvertalc\clbrdrt\brdrnone\cellx2000\cellx6000\pard\intbl c\par more\cell d\cell\row\pard after\par}"""

#: Sections: one that flows on inside its group, one that breaks.
SECTIONS = rb"{\rtf1 one\sect{\sectd\sbknone two\sect}three\sect four\par}"

DOCS = {"letter": LETTER, "list": LIST, "table": TABLE, "sections": SECTIONS}


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, bytearray(v)) for k, v in DOCS.items()]
    return rtf.parse(spark.createDataFrame(rows, "doc_id string, content binary")).cache()


def of(df, doc, *columns, order="para_seq"):
    return [tuple(r) for r in df.where(f"doc_id = '{doc}'").orderBy(order).select(*columns).collect()]


def test_letter(events):
    assert of(rtf.paragraph_texts(events), "letter", "text") == [
        ("Dear reader,",), ("It costs 5\u00a0€ today– no more.",), ("a link",), ("Привет",),
    ]
    p = of(rtf.paragraphs(events), "letter", "space_before", "space_after", "line_spacing.kind", "line_spacing.value")
    assert p[0] == (6.0, 8.0, "multiple", 259 / 240) and p[1] == (0.0, 8.0, "multiple", 259 / 240)
    runs = of(rtf.runs(events), "letter", "text", "font_size", "style.bold", "style.color", order="seq")
    assert runs[:3] == [("Dear ", 11.0, True, None), ("reader", 11.0, True, 2), (",", 11.0, True, None)] and {r[1] for r in runs} == {11.0}
    assert [r[1] for r in of(rtf.fonts(events), "letter", "font_seq", "name", order="font_seq")] == ["Times New Roman", "Bodyé"]
    codes = {c for (c,) in of(rtf.diagnostics(events), "letter", "code", order="diag_seq")}
    assert {"unsupported-stylesheet", "unknown-destination", "unsupported-destination"} <= codes


def test_list(events):
    got = of(lists.markers(events), "list", "marker", "follow", "left_indent", "first_line_indent")
    assert got[:3] == [("•", "tab", 36.0, -18.0), ("•", "tab", 36.0, -18.0), ("3.", "space", 36.0, -18.0)]
    assert [m for m, *_ in got[2:]] == ["3.", "3.a)", "3.b)", "4."]
    assert [t for (t,) in of(rtf.paragraph_texts(events), "list", "text")] == ["apples", "pears", "one", "deep", "deeper", "two", "plain"]


def test_table(events):
    got = of(cells.cells(events), "table", "block", "right", "text", "vertical_align", "shading.intensity", order=["block", "cell_idx"])
    assert got == [(0, 100.0, "a", "top", 5000), (0, 300.0, "b", "top", None), (1, 100.0, "c\nmore", "center", None), (1, 300.0, "d", "top", None)]
    tops = of(cells.cells(events), "table", "borders.top.style", "borders.top.width", order=["block", "cell_idx"])
    assert tops == [("single", 1.0), ("single", 1.0), ("none", 0.5), (None, None)]
    assert of(cells.rows(events), "table", "height_kind", "height", order="block") == [("auto", None), ("exact", 20.0)]
    assert of(rtf.paragraph_texts(events).where("cell is null"), "table", "text") == [("after",)]


def test_sections(events):
    assert events.where("doc_id = 'sections' and etype = 'pagebreak'").count() == 2


def test_model_and_pages(events):
    laid = document.lay_out(events, default=FIXED)
    pages = {r["doc_id"]: r["count"] for r in laid.pages.groupBy("doc_id").count().collect()}
    assert pages == {"letter": 1, "list": 1, "table": 1, "sections": 3} and laid.errors.count() == 0
    lines = {r["doc_id"]: r["count"] for r in laid.lines.groupBy("doc_id").count().collect()}
    assert lines == {"letter": 4, "list": 7, "table": 6, "sections": 4}
    first = laid.fragments.where("doc_id = 'list' and line = 0").orderBy("piece").collect()
    assert [f["text"] for f in first][0].startswith("•") and first[-1]["text"].endswith("apples")
    model = {r["doc_id"]: r["model"] for r in document_model(events).collect()}
    assert [len(model[k]["blocks"]) for k in DOCS] == [4, 7, 3, 6]


def test_variable_heights(spark):
    """Lines of different heights over pages: each document against a plain fold."""
    import random

    rng = random.Random(3)
    sizes = {f"d{k}": [rng.choice([10, 14, 18, 24, 40, 61]) for _ in range(rng.randrange(1, 60))] for k in range(12)}
    body = lambda hs: "".join(f"\\fs{2 * h} x\\par" for h in hs)
    rows = [(k, ("{\\rtf1\\paperw4000\\paperh4000\\margl200\\margr200\\margt200\\margb200" + body(v) + "}").encode()) for k, v in sizes.items()]
    laid = document.lay_out(rtf.parse(spark.createDataFrame(rows, "doc_id string, content binary")), default=FIXED)
    got = {}
    for r in laid.lines.orderBy("doc_id", "page", "line").collect():
        got.setdefault(r["doc_id"], []).append((r["page"], round(r["y"], 6), round(r["height"], 6)))
    for doc, hs in sizes.items():
        want, page, y = [], 0, 10.0
        for h in hs:
            up, down = FIXED.box(float(h), None)
            height = max(1.0, up + down)
            if y + height > 190.0 + 0.001 and y > 10.0:
                page, y = page + 1, 10.0
            want.append((page, round(y, 6), round(height, 6)))
            y += height
        assert got[doc] == want
