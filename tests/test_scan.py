"""The scan of one document: texts, styles, tables, lists, pictures and what is told of them."""

import random

import pytest

from docframe.sources.encode import escape
from docframe.sources.scan import scan


def events(data, kind):
    return [e for e in scan(data) if e["etype"] == kind]


def texts(data):
    return [e["text"] for e in events(data, "run") if e.get("text") is not None]


def told(data):
    return [e["text"] for e in events(data, "diag")]


@pytest.mark.parametrize(
    "data, expected",
    [
        (rb"{\rtf1\ansi Tea {\b and} cake\par}", ["Tea ", "and", " cake"]),
        (rb"{\rtf1 {\i one {\b two} three} four\par}", ["one ", "two", " three", " four"]),
        (rb"{\rtf1 C:\\dir \{braces\}\par}", ["C:\\dir {braces}"]),
        (rb"{\rtf1\ansi caf\'e9 cr\'e8me\par}", ["café crème"]),
        (rb"{\rtf1\ansicpg1253 \'ea\'e1\'eb\'e7\par}", ["καλη"]),
        (rb"{\rtf1{\fonttbl{\f5\fcharset128 G;}}\f5\'93\'fa\'96\'7b\par}", ["日本"]),
        (rb"{\rtf1\uc1 \u1078?\u1091?\u1082?\par}", ["жук"]),
        (rb"{\rtf1\uc3 \u1078abc\u1091\'41\'42\'43d\par}", ["жуd"]),
        (rb"{\rtf1\uc0 \u1078\u1091 ok\par}", ["жуok"]),
        (rb"{\rtf1\uc2{\uc \u1078xyz}\u1091vwz\par}", ["жyzуz"]),
        (rb"{\rtf1 \u-10180?\u-9018?\par}", ["\U0001f0c6"]),
        (rb"{\rtf1 \u-10180?x\par}", ["�x"]),
        (rb"{\rtf1 before{\*\secret hidden \u1078?}after\par}", ["beforeafter"]),
        (rb"{\rtf1{\field{\*\fldinst PAGE}{\fldrslt 7}} of 9\par}", ["7 of 9"]),
        (rb"{\rtf1{\upr{plain}{\*\ud \u269?aj}}\par}", ["čaj"]),
        (rb"{\rtf1{\ud not here}x\par}", ["x"]),
        (rb"{\rtf1 up\line down\tab right\~wide\_joined\par}", ["up\ndown\tright\u00a0wide\u2011joined"]),
        (b"{\\rtf1 first\\\r\nsecond\\\nthird\\par}", ["first", "second", "third"]),
        (b"{\\rtf1 skips \\bin4 {\\}}the bytes\\par}", ["skips the bytes"]),
        (rb"{\rtf1{\header top}{\footnote low}body\par}", ["body"]),
        (rb"{\rtf1 {\nonshppict{\pict\pngblip 00}}{\*\shppict ignored text}seen\par}", ["seen"]),
    ],
)
def test_text(data, expected):
    got = texts(data)
    assert got == expected or "".join(got) == "".join(expected)


@pytest.mark.parametrize(
    "data, code",
    [
        (rb"{\rtf1{\pict\bin7 abc}}", "TruncatedBinary"), (rb"{\rtf1 \bin-3 a}", "NegativeBinaryLength"), (rb"{\rtf1 {\b", "UnterminatedGroup"),
        (rb"{\rtf1 done}}", "UnexpectedGroupEnd"), (rb"rtf1 no brace", "InvalidHeader"), (rb"{words first\rtf1}", "InvalidHeader"),
        (rb"{\rtf3 of another version}", "InvalidHeader"), (rb"{\rtf1 one}two", "InvalidHeader"), (b"{\\rtf1" + b"{" * 300 + b"}" * 301, "NestingLimit"),
        (b"{\\rtf1" + b"\\par" * 100_002 + b"}", "ParagraphLimit"), (b"", "InvalidHeader"), (None, "InvalidHeader"),
    ],
)
def test_errors(data, code):
    assert [e["text"] for e in scan(data)] == [code]


@pytest.mark.parametrize(
    "data, codes",
    [
        (rb"{\rtf1\qwerty\qwerty{\*\strange x}}", ["unsupported-control", "unknown-destination"]),
        (rb"{\rtf1\itap1 a\itap2 b\par}", ["unsupported-nested-table"]),
        (rb"{\rtf1\trowd\clbghoriz\cellx500\intbl x\cell\row}", ["approximated-table-cell-pattern"]),
        (rb"{\rtf1\rtlch\rtlpar\trkeep\trkeepfollow}", ["unsupported-bidirectional-text", "unsupported-table-keep"]),
        (rb"{\rtf1\trowd\trpaddl9\trpaddfl2\cellx500\intbl x\cell\row}", ["unsupported-table-padding-unit"]),
        (rb"{\rtf1\trowd\cellx500\cellx400\clmrg\cellx900\intbl x\cell y\cell z\cell\row}", ["invalid-table-definition"]),
        (rb"{\rtf1\trowd\clmrg\cellx500\intbl x\cell\row}", ["invalid-table-merge"]),
        (rb"{\rtf1\pard\ls4 x\par}", ["unresolved-list-reference"]),
        (rb"{\rtf1{\*\defchp\fs30}{\*\defpap\li20}x\par}", []),
        (b"{\\rtf1\\" + b"w" * 40 + b"5 x}", ["control-name-too-long"]),
        (rb"{\rtf1 \'zz x\'4}", ["invalid-hex-escape"]),
    ],
)
def test_diagnostics(data, codes):
    assert told(data) == codes


@pytest.mark.parametrize("digits", [11, 400, 5000, 20_000])
def test_long_parameters_are_cut_to_ten_digits(digits):
    data = b"{\\rtf1\\fs" + b"00000000" + b"36" + b"9" * (digits - 10) + b" x\\li-" + b"9" * digits + b" y\\par}"
    run, para = events(data, "run")[0], events(data, "para")[0]
    assert run["style"]["half_points"] == 36 and para["props"]["li"] == -(1 << 31)
    assert told(data) == ["control-parameter-overflow"] * 2


def test_default_styles_feed_plain_and_pard():
    data = rb"{\rtf1{\*\defchp\fs40\b}{\*\defpap\li240\qc}a\plain b\par\pard c\par\ql d\par}"
    assert [(e["text"], e["style"]["half_points"], e["style"]["bold"]) for e in events(data, "run")] == [("a", 24, False), ("b", 40, True), ("c", 40, True), ("d", 40, True)]
    assert [e["props"] for e in events(data, "para")] == [{}, {"li": 240, "qc": 1}, {"li": 240, "ql": 1}]


def test_default_font_is_taken_where_nothing_else_is_set():
    data = rb"{\rtf1\deff3 a{\f1 b\plain c}\deff5 d\plain e\par}"
    assert [(e["text"], e["style"]["font_id"]) for e in events(data, "run")] == [("a", 3), ("b", 1), ("cd", 3), ("e", 5)]


def test_section_breaks_belong_to_their_group():
    assert len(events(rb"{\rtf1 a\sect{\sbknone b\sect}c\sect d\par}", "pagebreak")) == 2
    assert len(events(rb"{\rtf1\sbknone a\sect\sectd b\sect}", "pagebreak")) == 1


def test_fonts():
    data = rb"{\rtf1{\fonttbl{\f1\fcharset204 \'cb\'e8\'f1\'f2;}{\f2 Caf\u233?\~One;}{\f1 Again;}{\f7 without an end}}x\par}"
    got = [(e["text"], e["props"]) for e in events(data, "font")]
    assert got == [("Again", {"id": 1}), ("Café One", {"id": 2})]
    cyrillic = rb"{\rtf1{\fonttbl{\f1\fcharset204 \'cb\'e8\'f1\'f2;}}x\par}"
    assert [(e["text"], e["props"]) for e in events(cyrillic, "font")] == [("Лист", {"id": 1, "charset": 204, "codepage": 1251})]


def test_colours():
    data = rb"{\rtf1{\colortbl;\red9\green8\blue7;\red300\green0\blue0;\red1\green1;}x\par}"
    assert [e["props"] for e in events(data, "color")] == [{}, {"red": 9, "green": 8, "blue": 7}, {}, {}]


LISTS = (
    rb"{\*\listtable{\list{\listlevel\levelnfc23{\leveltext\'01\u8226 ?;}{\levelnumbers;}\li360}\listid3}"
    rb"{\list{\listlevel\levelnfc0\levelstartat4{\leveltext\'03<\'00>;}{\levelnumbers\'02;}}{\listlevel{\leveltext}{\levelnumbers}}\listid4}}"
    rb"{\*\listoverridetable{\listoverride\listid3\ls1}{\listoverride\listid4{\lfolevel\levelstartat9}{\lfolevel\levelstartat2}\ls2}}"
)


def test_lists():
    data = rb"{\rtf1" + LISTS + rb"\pard\ls1 x\par\ls2\ilvl y\par}"
    levels = [(e["props"]["list"], e["props"]["level"], e["text"], e["numbers"], e["props"].get("li")) for e in events(data, "listlevel")]
    assert levels == [(3, 0, "•", [], 360), (4, 0, "<\0>", [2], None), (4, 1, "", [], None)]
    assert [(e["props"], e["numbers"]) for e in events(data, "listoverride")] == [({"ls": 1, "list": 3}, []), ({"ls": 2, "list": 4}, [9, 2])]
    assert [e["props"] for e in events(data, "para")] == [{"ls": 1}, {"ls": 2, "ilvl": 0}] and not told(data)
    odd = rb"{\rtf1{\*\listtable{\list{\listlevel\levelnfc77{\leveltext\'02\'00.;}{\levelnumbers\'01;}}\listid1}}{\*\listoverridetable{\listoverride\listid1\ls1}}\ls1\ilvl5 x\par}"
    assert told(odd) == ["unsupported-list-number-format", "unsupported-list-level"]


def test_bullets_are_shown(spark):
    from docframe.operators import lists
    from docframe.sources import rtf

    rows = [("d", rb"{\rtf1" + LISTS + rb"\pard\ls1 x\par\ls2 y\par\ls2 z\par}")]
    got = lists.markers(rtf.parse(spark.createDataFrame(rows, "doc_id string, content binary"))).orderBy("para_seq").collect()
    assert [r["marker"] for r in got] == ["•", "<9>", "<10>"] and got[0]["left_indent"] == 18.0


def test_rows_hold_every_paragraph_until_they_end():
    data = rb"{\rtf1\trowd\cellx900\cellx1800 one\par two\cell three\cell\row after\par}"
    assert [(e["cell"], e["item"], e["plain"]) for e in events(data, "para")] == [(0, 0, "one"), (0, 1, "two"), (1, 0, "three"), (None, 0, "after")]
    assert told(rb"{\rtf1\trowd\cellx900\intbl never ended\cell}") == ["incomplete-table-row"]
    wide = rb"{\rtf1\trowd" + b"".join(b"\\cellx%d" % k for k in range(1, 302)) + rb"\intbl" + rb" a\cell" * 301 + rb"\row}"
    assert len(events(wide, "celldef")) == 256 and len(events(wide, "para")) == 301 and told(wide) == ["table-cell-limit"]


def test_pictures():
    png = b"89504e470d0a1a0a"
    data = rb"{\rtf1{\pict\pngblip\picwgoal100 " + png + rb"\'ab 0}{\pict\wmetafile8\bin3 abc}{\pict 12zz}\par}"
    got = [(e["text"], e["data"], e["props"]) for e in events(data, "image")]
    assert got == [("png", bytes.fromhex(png.decode()) + b"\xab", {"picwgoal": 100}), ("wmf", b"abc", {}), ("unknown", b"\x12", {})]
    assert told(data) == ["odd-picture-hex", "invalid-picture-hex", "unsupported-image-format"]
    big = rb"{\rtf1{\pict\pngblip " + b"00" * 900_000 + b"}}"
    assert len(events(big, "image")[0]["data"]) == 900_000


def test_limits_count_units(monkeypatch):
    monkeypatch.setattr("docframe.sources.scan.MAX_TEXT", 10)
    pair = rb"\u-10180?\u-9018?"
    assert texts(rb"{\rtf1 " + pair * 5 + rb"\par}") == ["\U0001f0c6" * 5]
    for body in (pair * 6, rb"\ansicpg65001 " + "\U0001f0c6".encode() * 6, b"x" * 11):
        assert [e["text"] for e in scan(rb"{\rtf1 " + body + rb"\par}")] == ["TextLimit"]


def test_wanted_events_only():
    data = rb"{\rtf1{\colortbl;}one {\v secret}\par two\par}"
    assert [(e["etype"], e["plain"], e["shown"]) for e in scan(data, frozenset({"doc", "doctext"}))] == [("doc", "one secret\ntwo", "one \ntwo")]
    assert [(e["plain"], e["shown"]) for e in scan(data, frozenset({"para", "text"}))] == [("one secret", "one "), ("two", None)]
    assert {e["etype"] for e in scan(data, frozenset({"run"}))} == {"run"}


@pytest.mark.parametrize("seed", range(4))
def test_mutations_never_raise(seed):
    rng = random.Random(seed)
    parts = [
        rb"\trowd\cellx99\intbl x\cell\row", rb"{\pict\pngblip 8950}", rb"\u945?", rb"\'e9", rb"\fs" + b"7" * 5000, LISTS, rb"{\*\defchp\fs1}", rb"{\fonttbl{\f0\fcharset128 \u9?A;}}",
        rb"{\upr{a}{\*\ud b}}", rb"\nestcell\nestrow", rb"{\listtext 1.}", rb"\sect\page", rb"\ansicpg1200 ab", rb"\uc-5\u", rb"\bin2 ab", rb"\ls2\ilvl9 ", rb"{\field{\fldrslt r}}",
    ]
    for _ in range(300):
        b = bytearray(rb"{\rtf1\ansi " + b"".join(rng.choice(parts) for _ in range(6)) + rb"\par}")
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 3)] = bytes(rng.choice(b"\\{}a1 *'\x80;") for _ in range(rng.randint(0, 3)))
        assert scan(bytes(b))[0]["etype"] in ("doc", "error")


def test_escape_round_trip():
    for text in ("a{b}\\c\td", "é中\U0001f600", "x" * 100, "~€œ\x7f"):
        for page in (None, "cp1252"):
            assert "".join(texts(b"{\\rtf1\\uc1 " + escape(text, page).encode() + b"\\par}")) == text


def test_files_over_the_limit_give_an_error_row(spark, tmp_path):
    from docframe.sources import rtf
    from docframe.sources.scan import MAX_BYTES

    (tmp_path / "small.rtf").write_bytes(rb"{\rtf1 A\par}")
    with (tmp_path / "large.rtf").open("wb") as f:
        f.truncate(MAX_BYTES + 1)
    told = lambda df: {(r["doc_id"].rsplit("/", 1)[-1], r["error_code"], r["error_offset"]) for r in df.collect()}
    want = {("small.rtf", None, None), ("large.rtf", "InputTooLarge", 0)}
    assert told(rtf.documents(rtf.parse(rtf.read_files(spark, str(tmp_path))))) == want
    events = rtf.parse(rtf.read_stream(spark, str(tmp_path)))
    stream = rtf.documents(events).writeStream.format("memory").queryName("over_limit").trigger(availableNow=True).start()
    assert stream.awaitTermination(60)
    assert told(spark.table("over_limit")) == want
