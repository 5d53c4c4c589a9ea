"""The sequential part of reading RTF: one document's bytes to a list of raw events.

A scope stack makes a property's value depend on what was open, so this is the one step that cannot be relational.
Events carry raw parameters; units, fallbacks, lookups, numbering and geometry are resolved by column expressions
downstream. An event is (etype, block, cell, item, text, image, style, props):

font, color, para, run, pagebreak, rowdef, celldef, image, listlevel, listoverride, diag, doc, error

Paragraphs also carry their text in order (``plain``, and ``shown`` where hidden text makes that differ), and on demand
the document does, so that reading text needs no shuffle.
"""

from __future__ import annotations

import codecs
import re

# Limits of the format's reader.
MAX_BYTES, MAX_DEPTH, MAX_TOKENS, MAX_TEXT, MAX_PARAGRAPHS = 16 << 20, 256, 2_000_000, 2_000_000, 100_000
MAX_IMAGES, MAX_IMAGE_BYTES, MAX_CELLS, MAX_LEVELS, MAX_LISTS, MAX_DIAGNOSTICS = 256, 8 << 20, 256, 9, 512, 512

# Charset numbers and their code pages.
CHARSET_CODEPAGE = {
    0: 1252, 2: 42, 77: 10000, 78: 10001, 79: 10003, 80: 10008, 81: 10002, 83: 10005, 84: 10004, 85: 10006, 86: 10081,
    87: 10021, 88: 10029, 89: 10007, 128: 932, 129: 949, 130: 1361, 134: 936, 136: 950, 161: 1253, 162: 1254, 163: 1258,
    177: 1255, 178: 1256, 186: 1257, 204: 1251, 222: 874, 238: 1250, 254: 437, 255: 850,
}
# Code pages and Python codecs.
CODECS = {
    866: "cp866", 874: "cp874", 932: "cp932", 936: "gb18030", 54936: "gb18030", 949: "cp949", 51949: "cp949",
    950: "big5hkscs", 1200: "utf_16_le", 1201: "utf_16_be", 819: "cp1252", 10000: "mac_roman", 10007: "mac_cyrillic",
    20866: "koi8_r", 21866: "koi8_u", 38598: "iso8859_8", 51932: "euc_jp", 65001: "utf_8",
} | {n: f"cp{n}" for n in range(1250, 1259)} | {28590 + n: f"iso8859_{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)}
# Named characters.
NAMED = {
    "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“",
    "rdblquote": "”", "emspace": " ", "enspace": " ", "qmspace": " ", "zwj": "‍", "zwnj": "‌",
    "zwbo": "​", "zwnbo": "﻿", "tab": "\t", "line": "\n", "softline": "\n",
}
# Destinations that are skipped, those that lead somewhere, and words that are known and ignored.
SKIPPED = frozenset(
    "fldinst info generator header footer headerl headerr headerf footerl footerr footerf footnote annotation blipuid "
    "themedata colorschememapping filetbl revtbl rsidtbl xmlnstbl bookmark bkmkstart bkmkend object objdata datastore "
    "stylesheet pn nesttableprops nonshppict".split()
)
ROUTED = frozenset(
    "fonttbl colortbl defchp defpap pict listtable listoverridetable field fldrslt upr ud shppict nonesttables listtext "
    "pntext".split()
)
IGNORED = frozenset(
    "froman fswiss fmodern fscript fdecor ftech fnil fcharset cpg red green blue viewkind lang langfe langnp langfenp "
    "ltrch ltrpar adjustright aspalpha aspnum faauto keep keepn tx tqr tqc tqdec ltrrow lastrow trautofit tblind "
    "tblindtype trwWidth trftsWidth trwWidthA trftsWidthA trwWidthB trftsWidthB clwWidth clftsWidth brdrtbl".split()
)
# Words that are read and only told about.
DIAGNOSED = (
    {w: "unsupported-section-geometry" for w in "pgwsxn pghsxn marglsxn margrsxn margtsxn margbsxn guttersxn lndscpsxn".split()}
    | {w: "unsupported-bidirectional-text" for w in ("rtlch", "rtlpar", "rtlrow", "fbidi")}
    | {w: "unsupported-associated-font-run" for w in ("loch", "hich", "dbch")}
    | {w: "unsupported-widow-control" for w in ("widowctrl", "widctlpar", "nowidctlpar")}
    | {w: "unsupported-vertical-cell-merge" for w in ("clvmgf", "clvmrg")}
    | {"clbg" + w: "approximated-table-cell-pattern" for w in "horiz vert fdiag bdiag cross dcross dkhor dkvert dkfdiag dkbdiag dkcross dkdcross".split()}
    | {"trhdr": "unsupported-table-header-row", "trkeep": "unsupported-table-keep", "trkeepfollow": "unsupported-table-keep"}
)
BORDER_STYLES = (
    {w: "single" for w in ("brdrs", "brdrth", "brdrtnthsg", "brdrengrave", "brdremboss")}
    | {w: "double" for w in ("brdrdb", "brdrtriple", "brdrtnthtnthlg")}
    | {"brdrdot": "dotted"}
    | {w: "dashed" for w in ("brdrdash", "brdrdashsm", "brdrdashd", "brdrdashdd", "brdrdashdotstr")}
    | {w: "other" for w in ("brdrwavy", "brdrwavydb", "brdrinset", "brdroutset", "brdrframe")}
)
BORDER_STYLE_CODES = {"none": 0, "single": 1, "double": 2, "dotted": 3, "dashed": 4, "other": 5}
# Number formats of list levels that have digits of their own, or none.
NUMBER_FORMATS = frozenset((0, 1, 2, 3, 4, 22, 23, 255))

PAGE_WORDS = frozenset("paperw paperh margl margr margt margb".split())
ROW_WORDS = frozenset("trleft trgaph trrh trql trqc trqr trcbpat trcfpat trshdng".split())
CELL_WORDS = frozenset("clmgf clmrg clvertalt clvertalc clvertalb clcbpat clcfpat clshdng".split())
PADDING = re.compile(r"^(clpad|trpadd)(f?)([ltrb])$")
BORDER_SIDE = re.compile(r"^(clbrdr[tlbr]|trbrdr[tlbrhv])$")
PICTURE_WORDS = frozenset("picw pich picwgoal pichgoal picscalex picscaley".split())
PICTURE_IGNORED = frozenset("piccropt piccropb piccropl piccropr bliptag picbmp picbpp".split())
PICTURE_FORMATS = {"pngblip": "png", "jpegblip": "jpeg", "wmetafile": "wmf", "emfblip": "emf"}
PARA_NUMBERS = {"li": "li", "lin": "li", "ri": "ri", "rin": "ri", "fi": "fi", "sb": "sb", "sa": "sa", "sl": "sl", "slmult": "slmult"}
ALIGNMENTS = ("ql", "qc", "qr", "qj")
TOGGLES = {"b": "bold", "i": "italic", "ul": "underline", "strike": "strike", "v": "hidden"}
CHARACTER = frozenset("f fs cf highlight up dn super sub nosupersub ulnone".split()) | frozenset(TOGGLES)
PARAGRAPH = frozenset(PARA_NUMBERS) | frozenset(ALIGNMENTS) | {"pagebb"}
CODEPAGES = {"ansi": 1252, "mac": 10000, "pc": 437, "pca": 850}
PLAIN_STYLE = {
    "font_id": 0, "half_points": 24, "bold": False, "italic": False, "underline": False, "strike": False, "color": None,
    "highlight": None, "hidden": False, "shift": 0.0,
}
VISIBLE = frozenset(("body", "side", "leveltext", "levelnumbers"))

#: Groups: 1 open, 2 close, 3 word, 4 its number, 5 hex, 6 symbol, 7 text, 8 line ends. No match: a lone backslash ends it all.
TOKEN = re.compile(
    rb"(\{)|(\})|\\(?:([A-Za-z]+)(-?[0-9]+)? ?|'([0-9a-fA-F]{2})|([^A-Za-z]))|([^\\{}\r\n]+)|([\r\n]+)", re.S
)
LOW, HIGH = -(1 << 31), (1 << 31) - 1


class ScanError(Exception):
    def __init__(self, code: str, at: int):
        super().__init__(code)
        self.code, self.at = code, at


def _undefined(e: UnicodeError) -> tuple[str, int]:
    """Bytes that a Windows code page leaves open: control characters below A0, replaced above."""
    return "".join(chr(b) if b < 0xA0 else "�" for b in e.object[e.start : e.end]), e.end


codecs.register_error("rtf_undefined", _undefined)


def decode(data: bytes, codepage: int) -> tuple[str, bool, bool]:
    """Text, whether bytes were malformed, whether the code page is unknown and mattered."""
    if data.isascii() and codepage not in (1200, 1201):
        return data.decode("ascii"), False, False
    codec = CODECS.get(codepage)
    windows = codec is None or codec.startswith(("cp125", "cp874"))
    text = data.decode(codec or "cp1252", errors="rtf_undefined" if windows else "replace")
    return text, "�" in text, codec is None


def whole(parts: list[str]) -> str:
    """Parts joined; UTF-16 units that came one by one are paired, and lone ones replaced."""
    text = "".join(parts)
    if text.isascii():
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class _Scope:
    __slots__ = ("dest", "locked", "style", "para", "uc", "pictures", "upr", "breaks", "fresh", "starred")

    def inner(self) -> _Scope:
        new = _Scope()
        new.dest, new.locked, new.style, new.para, new.uc = self.dest, self.locked, self.style, self.para, self.uc
        new.pictures, new.upr, new.breaks, new.fresh, new.starred = self.pictures, self.upr, self.breaks, True, False
        return new


class Scanner:
    """One document. ``events()`` is the whole result; a fatal error gives a single ``error`` event.

    ``keep`` names the event types that are wanted. Texts of paragraphs come with ``text`` among them, that of the
    document only with ``doctext``.
    """

    def __init__(self, data: bytes, keep: frozenset[str] | None = None):
        self.data, self.keep, self.out = data, keep, []
        self.with_text = keep is None or "text" in keep
        self.lines: list[tuple[str, str]] | None = [] if keep is not None and "doctext" in keep else None
        self.at = self.skip = self.text_units = self.paragraphs = self.blocks = self.images = 0
        self.codepage, self.default_font, self.page = 1252, 0, {}
        self.interned: dict[tuple, dict] = {}
        self.plain = self.styled(PLAIN_STYLE)
        self.default_style, self.default_para = self.plain, {}
        self.fonts: dict[int, dict] = {}
        self.font: dict | None = None
        self.color: dict = {}
        self.colors = 0
        self.raw, self.raw_page, self.raw_dest, self.raw_style = bytearray(), 1252, "body", self.plain
        self.runs: list[tuple] = []
        self.side: list[str] = []
        self.level_text: list[str] = []
        self.row: dict | None = None
        self.pict: dict | None = None
        self.seen: set = set()
        self.lists: dict[int, list] = {}
        self.overrides: dict[int, dict] = {}
        self.open_list = self.open_level = self.open_override = None
        s = self.scope = _Scope()
        s.dest, s.locked, s.style, s.para, s.uc, s.pictures, s.upr, s.breaks, s.fresh, s.starred = "body", False, self.plain, {}, 1, True, False, True, True, False
        self.para, self.stack = {}, []

    def styled(self, style: dict) -> dict:
        """One object for each style, so that equal ones are the same."""
        return self.interned.setdefault(tuple(style.values()), style)

    def emit(self, etype: str, **fields) -> None:
        if self.keep is None or etype in self.keep:
            fields["etype"] = etype
            self.out.append(fields)

    def diagnose(self, code: str, message: str = "", at: int | None = None) -> None:
        if (code, message) not in self.seen and len(self.seen) < MAX_DIAGNOSTICS:
            self.seen.add((code, message))
            self.emit("diag", text=code, props={"offset": self.at if at is None else at}, message=message or code)

    # ---- text
    def add_bytes(self, data: bytes) -> None:
        s = self.scope
        font = self.fonts.get(s.style["font_id"])
        page = self.codepage if font is None or font["codepage"] is None else font["codepage"]
        if self.raw:
            if page != self.raw_page or s.style is not self.raw_style or s.dest != self.raw_dest:
                self.flush_raw()
            else:
                self.raw += data
                return
        if page not in (1200, 1201) and data.isascii():
            return self.put(data.decode("ascii"), s.dest, s.style)
        self.raw_page, self.raw_dest, self.raw_style = page, s.dest, s.style
        self.raw += data

    def flush_raw(self) -> None:
        if self.raw:
            text, malformed, unknown = decode(bytes(self.raw), self.raw_page)
            self.raw.clear()
            if malformed:
                self.diagnose("text-decoding-error", f"code page {self.raw_page}")
            if unknown:
                self.diagnose("unsupported-codepage", f"code page {self.raw_page}")
            self.put(text, self.raw_dest, self.raw_style)

    def add_text(self, text: str) -> None:
        if self.scope.dest in VISIBLE:
            self.flush_raw()
            self.put(text, self.scope.dest, self.scope.style)

    def put(self, text: str, dest: str, style: dict) -> None:
        self.text_units += len(text) if text.isascii() else len(text) + sum(c > "￿" for c in text)
        if self.text_units > MAX_TEXT:
            raise ScanError("TextLimit", self.at)
        if dest == "side":
            self.side.append(text)
        elif dest in ("leveltext", "levelnumbers"):
            self.level_text.append(text)
        elif self.runs and self.runs[-1][2] is style and self.runs[-1][0] == "text":
            self.runs[-1][1].append(text)
        else:
            self.runs.append(("text", [text], style))

    # ---- paragraphs and rows
    def end_paragraph(self, force: bool) -> None:
        self.flush_raw()
        if not force and not self.runs:
            return
        self.paragraphs += 1
        if self.paragraphs > MAX_PARAGRAPHS:
            raise ScanError("ParagraphLimit", self.at)
        if "ls" in self.para:
            self.check_list(self.para["ls"], self.para.get("ilvl", 0))
        item = (self.para, self.scope.style, whole(self.side), self.runs)
        self.runs, self.side, self.para = [], [], self.scope.para
        if self.row is not None:  # between a row's definition and its end all paragraphs are the cell's
            self.row["open"].append(item)
        else:
            self.put_paragraph(item, self.next_block(), None, 0)

    def next_block(self) -> int:
        self.blocks += 1
        if self.blocks > MAX_PARAGRAPHS:
            raise ScanError("ParagraphLimit", self.at)
        return self.blocks - 1

    def put_paragraph(self, item: tuple, block: int, cell: int | None, k: int) -> None:
        para, mark, side, runs = item
        runs = [(kind, whole(body) if kind == "text" else body, style) for kind, body, style in runs]
        plain = shown = None
        if self.with_text or self.lines is not None:
            plain = "".join([body for kind, body, _ in runs if kind == "text"])
            if any(style["hidden"] for _, _, style in runs):
                shown = "".join([body for kind, body, style in runs if kind == "text" and not style["hidden"]])
            if self.lines is not None:
                self.lines.append((plain, plain if shown is None else shown))
        if self.keep is None or "para" in self.keep:
            texts = {"plain": plain, "shown": shown} if self.with_text else {}
            self.emit("para", block=block, cell=cell, item=k, text=side, style=mark, props={n: v for n, v in para.items() if n != "intbl"}, **texts)
        if self.keep is None or "run" in self.keep:
            for j, (kind, body, style) in enumerate(runs):
                self.emit("run", block=block, cell=cell, item=k, sub=j, style=style, **{kind: body})

    def open_row(self) -> dict:
        if self.row is None:
            self.row = {"props": {}, "defs": [], "def": {}, "cells": [], "open": [], "border": None, "over": False}
        return self.row

    def close_cell(self) -> None:
        row = self.row
        if len(row["cells"]) < MAX_CELLS:
            row["cells"].append(row["open"])
        else:
            row["over"] = True
            row["cells"][-1] += row["open"]
        row["open"] = []

    def spill_row(self, code: str) -> None:
        """The open row's content as paragraphs of the body."""
        row, self.row = self.row, None
        if any(row["cells"]):
            self.diagnose(code)
        for item in (item for cell in row["cells"] for item in cell):
            self.put_paragraph(item, self.next_block(), None, 0)

    def drop_row(self) -> None:
        """A row that never ends keeps its content."""
        self.flush_raw()
        if self.row is not None:
            if self.runs:
                self.end_paragraph(True)
            if self.row["open"]:
                self.close_cell()
            self.spill_row("incomplete-table-row")

    def end_row(self) -> None:
        self.flush_raw()
        if self.row is None and not self.runs:
            return
        row = self.open_row()
        if self.runs or row["open"]:
            self.end_paragraph(True)
            self.close_cell()
        self.scope.para = {k: v for k, v in self.scope.para.items() if k != "intbl"}
        if row["over"]:
            self.diagnose("table-cell-limit")
        if any(unit != 3 and name.replace("f", "", 1) in props for props in (row["props"], *row["defs"]) for name, unit in props.items() if (m := PADDING.match(name)) and m[2]):
            self.diagnose("unsupported-table-padding-unit")
        if not row["defs"]:
            return self.spill_row("invalid-table-definition")
        self.row, reach, first = None, row["props"].get("trleft", 0), True
        for d in row["defs"]:
            if d["cellx"] <= reach:
                self.diagnose("invalid-table-definition", "a boundary that does not lie beyond the one before")
                continue
            if first and d.get("clmrg"):
                self.diagnose("invalid-table-merge")
            reach, first = d["cellx"], False
        block = self.next_block()
        self.emit("rowdef", block=block, props=row["props"])
        for i, d in enumerate(row["defs"]):
            self.emit("celldef", block=block, cell=i, props=d)
        for i, cell in enumerate(row["cells"]):
            for k, item in enumerate(cell):
                self.put_paragraph(item, block, i, k)

    def page_break(self) -> None:
        self.end_paragraph(False)
        self.drop_row()
        self.emit("pagebreak", block=self.next_block())

    # ---- groups
    def open_group(self) -> None:
        self.skip = 0
        if len(self.stack) >= MAX_DEPTH:
            raise ScanError("NestingLimit", self.at)
        self.scope.fresh = False
        self.stack.append(self.scope)
        self.scope = self.scope.inner()

    def close_group(self) -> None:
        self.skip = 0
        if not self.stack:
            raise ScanError("UnexpectedGroupEnd", self.at)
        old, parent = self.scope, self.stack.pop()
        if self.pict is not None and self.pict["depth"] == len(self.stack) + 1:
            self.end_picture()
        if self.raw and (parent.dest != old.dest or parent.style is not old.style):
            self.flush_raw()
        if self.open_list or self.open_level or self.open_override:
            self.end_lists(old.dest, parent.dest)
        self.scope = parent

    def destination(self, word: str) -> bool:
        """Turn to the destination that a group's first word names; False if it names none."""
        s = self.scope
        if word in SKIPPED:
            s.dest, s.locked = "skip", True
            if word == "nonshppict":
                s.pictures = False
            elif word == "stylesheet":
                self.diagnose("unsupported-stylesheet")
            elif word == "pn":
                self.diagnose("unsupported-list-semantics")
            elif word != "nesttableprops":
                self.diagnose("unsupported-destination", word)
        elif word == "pict":
            if self.pict is not None:
                self.diagnose("nested-picture")
            if self.pict is not None or not s.pictures:
                s.dest, s.locked = "skip", True
            else:
                self.flush_raw()
                s.dest, self.pict = "pict", {"props": {}, "format": None, "data": bytearray(), "half": b"", "style": s.style, "depth": len(self.stack), "at": self.at}
        elif word in ("leveltext", "levelnumbers"):
            if s.dest != "listtable":
                return False
            self.level_text = []
            s.dest = word
        elif word in ("fonttbl", "colortbl", "listtable", "listoverridetable", "defchp", "defpap"):
            s.dest = word
        elif word == "shppict":
            s.dest, s.pictures = "container", True
        elif word in ("fldrslt", "nonesttables") or word == "ud" and s.upr:
            s.dest = "body"
        elif word in ("field", "upr", "ud"):
            s.dest, s.upr = "skip", s.upr or word == "upr"
        elif word in ("listtext", "pntext"):
            s.dest = "side"
        else:
            return False
        return True

    # ---- header tables
    def end_font(self) -> None:
        self.flush_font_name()
        f, self.font = self.font, None
        if f is not None and f["id"] is not None and (name := whole(f["parts"]).strip()):
            page = CHARSET_CODEPAGE.get(f["charset"]) if f["codepage"] is None else f["codepage"]
            self.fonts[f["id"]] = {"name": name, "charset": f["charset"], "codepage": page}

    def flush_font_name(self) -> None:
        f = self.font
        if f is not None and f["name"]:
            page = CHARSET_CODEPAGE.get(f["charset"]) if f["codepage"] is None else f["codepage"]
            f["parts"].append(decode(bytes(f["name"]), self.codepage if page is None else page)[0])
            f["name"].clear()

    def the_font(self, number: int | None = None) -> dict:
        if self.font is None:
            self.font = {"id": number, "charset": None, "codepage": None, "name": bytearray(), "parts": []}
        return self.font

    def font_word(self, word: str, n: int | None) -> None:
        if word == "f":
            self.end_font()
            self.the_font(n)
        elif word in ("fcharset", "cpg"):
            self.flush_font_name()
            self.the_font()["charset" if word == "fcharset" else "codepage"] = n
        elif word == "uc":
            self.scope.uc = max(0, 1 if n is None else n)
        elif word == "u":
            self.flush_font_name()
            self.the_font()["parts"].append(chr((n or 0) & 0xFFFF))
            self.skip = self.scope.uc

    def font_bytes(self, data: bytes) -> None:
        *ended, rest = data.replace(b"\t", b"").split(b";")
        for name in ended:
            self.the_font()["name"] += name
            self.end_font()
        if rest:
            self.the_font()["name"] += rest

    def list_word(self, word: str, n: int | None) -> None:
        depth = len(self.stack)
        level, override = self.open_level, self.open_override
        if word == "list":
            self.open_list = {"depth": depth, "id": 0, "levels": []}
        elif word == "listlevel":
            self.open_level = {"depth": depth, "startat": 1, "nfc": 0, "follow": 0, "template": "", "places": []}
        elif word == "listoverride":
            self.open_override = {"depth": depth, "ls": 0, "list": 0, "starts": {}, "told": 0, "level": 0}
        elif word == "listid" and (self.open_list or override):
            if self.open_list:
                self.open_list["id"] = n or 0
            else:
                override["list"] = n or 0
        elif word == "ls" and override:
            override["ls"] = n or 0
        elif word == "lfolevel" and override:
            override["level"] = min(override["told"], MAX_LEVELS - 1)
        elif word == "levelstartat" and (level or override):
            n = 1 if n is None else n
            if level:
                level["startat"] = n
            else:
                override["starts"].setdefault(override["level"], n)
                override["told"] += 1
        elif level and word in ("levelnfc", "levelnfcn"):
            if (n or 0) in NUMBER_FORMATS:
                level["nfc"] = n or 0
            else:
                self.diagnose("unsupported-list-number-format")
        elif level and word == "levelfollow":
            level["follow"] = n or 0
        elif level and word in ("li", "lin", "fi"):
            level["fi" if word == "fi" else "li"] = n or 0

    def end_lists(self, dest: str, outer: str) -> None:
        depth = len(self.stack)
        if dest in ("leveltext", "levelnumbers") and outer != dest:
            text, self.level_text = whole(self.level_text), []
            if self.open_level and dest == "leveltext":  # its first character counts those that follow
                self.open_level["template"] = text[1 : 1 + ord(text[0])] if text else ""
            elif self.open_level:
                self.open_level["places"] = [ord(c) for c in text.split(";")[0]]
        if self.open_level and self.open_level["depth"] > depth:
            level, self.open_level = self.open_level, None
            if self.open_list and len(self.open_list["levels"]) < MAX_LEVELS:
                self.open_list["levels"].append(level)
        if self.open_list and self.open_list["depth"] > depth:
            done, self.open_list = self.open_list, None
            if len(self.lists) < MAX_LISTS:
                self.lists[done["id"]] = done["levels"]
        if self.open_override and self.open_override["depth"] > depth:
            done, self.open_override = self.open_override, None
            if len(self.overrides) < MAX_LISTS:
                self.overrides[done["ls"]] = done

    def check_list(self, ls: int, level: int) -> None:
        override = self.overrides.get(ls)
        levels = self.lists.get(override["list"]) if override else None
        if levels is None:
            self.diagnose("unresolved-list-reference", "the list of an override" if override else "an override")
        elif levels and level >= len(levels):
            self.diagnose("unsupported-list-level")

    def list_events(self) -> None:
        for number, levels in self.lists.items():
            for k, lv in enumerate(levels):
                props = {"list": number, "level": k} | {w: lv[w] for w in ("startat", "nfc", "follow", "li", "fi") if w in lv}
                self.emit("listlevel", text=lv["template"], props=props, numbers=lv["places"])
        for ls, o in self.overrides.items():
            starts = [o["starts"].get(k) for k in range(1 + max(o["starts"], default=-1))]
            self.emit("listoverride", props={"ls": ls, "list": o["list"]}, numbers=starts)

    # ---- pictures
    def picture_hex(self, data: bytes) -> None:
        digits = data.translate(None, b" \t\n\x0c\r")
        clean = re.sub(rb"[^0-9A-Fa-f]+", b"", digits)
        if len(clean) != len(digits):
            self.diagnose("invalid-picture-hex")
        clean = self.pict["half"] + clean
        even = len(clean) & ~1
        self.pict["half"] = clean[even:]
        self.picture_data(bytes.fromhex(clean[:even].decode()))

    def picture_data(self, data: bytes) -> None:
        self.pict["data"] += data
        if len(self.pict["data"]) > MAX_IMAGE_BYTES:
            raise ScanError("ImageByteLimit", self.at)

    def end_picture(self) -> None:
        p, self.pict = self.pict, None
        if p["half"]:
            self.diagnose("odd-picture-hex", at=p["at"])
        data, fmt = bytes(p["data"]), p["format"]
        right = {"png": data[:8] == b"\x89PNG\r\n\x1a\n", "jpeg": data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"}
        if self.images >= MAX_IMAGES:
            raise ScanError("ImageLimit", self.at)
        if not right.get(fmt, True):
            self.diagnose("image-signature-mismatch", at=p["at"])
        if fmt is None:
            self.diagnose("unsupported-image-format", at=p["at"])
        name = f"image-{self.images}"
        self.emit("image", image=name, item=self.images, text=fmt or "unknown", data=data, props=p["props"])
        self.images += 1
        self.flush_raw()
        self.runs.append(("image", name, p["style"]))

    def picture_word(self, word: str, n: int | None) -> None:
        if word in PICTURE_FORMATS:
            self.pict["format"] = PICTURE_FORMATS[word]
        elif word in PICTURE_WORDS:
            if n is None:
                self.pict["props"].pop(word, None)
            else:
                self.pict["props"][word] = n
        elif word not in PICTURE_IGNORED:
            self.diagnose("unsupported-picture-control", word)

    # ---- controls
    def word(self, word: str, n: int | None) -> None:
        s = self.scope
        fresh, starred, s.fresh, s.starred = s.fresh, s.starred, False, False
        if s.locked:
            return
        if starred and word not in ROUTED and word not in SKIPPED:
            s.dest, s.locked = "skip", True
            self.diagnose("unknown-destination", word)
            return
        if fresh and self.destination(word):
            return
        dest = s.dest
        if dest == "skip":
            return
        if dest == "fonttbl":
            return self.font_word(word, n)
        if dest == "colortbl":
            if word in ("red", "green", "blue"):
                self.color[word] = n if n is not None and 0 <= n <= 255 else None
            return
        if dest == "pict":
            return self.picture_word(word, n)
        if dest in ("listtable", "listoverridetable"):
            return self.list_word(word, n)
        if dest == "defchp":
            if word in CHARACTER:
                self.default_style = self.character(self.default_style, word, n)
            return
        if dest == "defpap":
            if word in PARAGRAPH:
                self.default_para = self.paragraph(self.default_para, word, n)
            return
        if word == "par":
            self.end_paragraph(True)
        elif word == "u":
            self.flush_raw()
            self.put(chr((n or 0) & 0xFFFF), dest if dest in VISIBLE else "body", s.style)
            self.skip = s.uc
        elif word in NAMED:
            self.add_text(NAMED[word])
        elif word in CHARACTER:
            self.set_style(self.character(s.style, word, n))
        elif word in PARAGRAPH:
            self.set_para(self.paragraph(s.para, word, n))
        elif word == "plain":
            self.set_style(self.default_style)
        elif word == "pard":
            self.set_para(self.default_para)
        elif word == "uc":
            s.uc = max(0, 1 if n is None else n)
        elif word in CODEPAGES or word == "ansicpg" and n is not None:
            self.flush_raw()
            self.codepage = CODEPAGES.get(word, n)
        elif word == "deff":
            if n is not None:
                self.default_font = n
                self.default_style = self.styled(dict(self.default_style, font_id=n))
                if s.style is self.plain:
                    s.style = self.styled(dict(s.style, font_id=n))
        elif word == "ls":
            self.set_para({k: v for k, v in s.para.items() if k != "ls"} | ({} if n is None else {"ls": n}), True)
        elif word == "ilvl":
            self.set_para(dict(s.para, ilvl=min(max(n or 0, 0), MAX_LEVELS - 1)), True)
        elif word == "page":
            self.page_break()
        elif word == "sect":
            self.end_paragraph(True)
            self.drop_row()
            if s.breaks:
                self.emit("pagebreak", block=self.next_block())
        elif word in ("sbknone", "sbkcol"):
            s.breaks = False
        elif word in ("sbkpage", "sbkeven", "sbkodd", "sectd"):
            s.breaks = True
        elif word in PAGE_WORDS:
            if n is not None and n <= 0 and word in ("paperw", "paperh"):
                self.diagnose("invalid-page-geometry")
            elif n is not None:
                self.page[word] = n
        elif word == "landscape":
            self.page[word] = 1 if n is None else n
        elif word == "deftab":
            if n is not None:
                self.page[word] = n
        elif not self.table_word(word, n):
            if word in DIAGNOSED:
                self.diagnose(DIAGNOSED[word])
            elif word not in IGNORED and word != "rtf":
                self.diagnose("unsupported-control", word)

    def set_style(self, style: dict) -> None:
        if style is not self.scope.style:
            self.flush_raw()
            self.scope.style = style

    def set_para(self, para: dict, always: bool = False) -> None:
        """The state of the scope, and of the paragraph that is open unless its label is being read."""
        self.scope.para = para
        if always or self.scope.dest != "side":
            self.para = para

    def character(self, style: dict, word: str, n: int | None) -> dict:
        if word in ("fs", "up", "dn") and n is not None:
            low, high = (1, 4096) if word == "fs" else (-4096, 4096)
            if not low <= n <= high:
                self.diagnose("character-value-out-of-range", word)
                n = min(max(n, low), high)
        size = style["half_points"] / 2
        if word in TOGGLES:
            new = {TOGGLES[word]: n is None or n != 0}
        elif word == "ulnone":
            new = {"underline": False}
        elif word == "f":
            new = {"font_id": self.default_font if n is None else n}
        elif word == "fs":
            new = {"half_points": 24 if n is None else n}
        elif word in ("cf", "highlight"):
            new = {"color" if word == "cf" else word: n if n and n > 0 else None}
        else:
            half = 6 if n is None else n
            new = {"shift": {"up": half / 2, "dn": -half / 2, "super": size / 3, "sub": -size / 6, "nosupersub": 0.0}[word]}
        return self.styled({**style, **new})

    @staticmethod
    def paragraph(para: dict, word: str, n: int | None) -> dict:
        if word in ALIGNMENTS:
            return {k: v for k, v in para.items() if k not in ALIGNMENTS} | {word: 1}
        if word == "pagebb":
            return dict(para, pagebb=1 if n is None else n)
        return dict(para, **{PARA_NUMBERS[word]: n or 0})

    def table_word(self, word: str, n: int | None) -> bool:
        if word == "trowd":
            row = self.open_row()
            row |= {"props": {}, "defs": [], "def": {}, "border": None, "over": False}
        elif word == "intbl":
            self.set_para(dict(self.scope.para, intbl=1 if n is None else n), True)
            if self.para["intbl"]:
                self.open_row()
        elif word == "cellx":
            row = self.open_row()
            if len(row["defs"]) < MAX_CELLS:
                row["defs"].append(dict(row["def"], cellx=n or 0))
            else:
                row["over"] = True
            row["def"], row["border"] = {}, None
        elif word == "cell":
            self.open_row()
            self.end_paragraph(True)
            self.close_cell()
        elif word == "row":
            self.end_row()
        elif word == "itap":
            if n is not None and n > 1:
                self.diagnose("unsupported-nested-table")
        elif word == "nestcell":
            self.diagnose("unsupported-nested-table")
            self.add_text("\t")
        elif word == "nestrow":
            self.diagnose("unsupported-nested-table")
            self.flush_raw()
            if self.runs and self.runs[-1][0] == "text":
                kind, parts, style = self.runs.pop()
                if last := "".join(parts).removesuffix("\t"):
                    self.runs.append((kind, [last], style))
            self.end_paragraph(True)
        elif word in ROW_WORDS:
            props = self.open_row()["props"]
            if word in ("trql", "trqc", "trqr"):
                for k in ("trql", "trqc", "trqr"):
                    props.pop(k, None)
            if word != "trshdng" or n is not None:
                props[word] = (1 if word.startswith("trq") else 0) if n is None else n
        elif word in CELL_WORDS:
            pending = self.open_row()["def"]
            if word.startswith("clvertal"):
                for k in ("clvertalt", "clvertalc", "clvertalb"):
                    pending.pop(k, None)
            if word == "clmrg" and n == 0:
                pending.pop(word, None)
            elif word != "clshdng" or n is not None:
                pending[word] = (0 if word in ("clcbpat", "clcfpat") else 1) if n is None else n
        elif BORDER_SIDE.match(word):
            row = self.open_row()
            row["border"] = word
            target = row["def"] if word[:2] == "cl" else row["props"]
            for k in ("w", "cf", "hair", "none"):
                target.pop(f"{word}_{k}", None)
            target |= {word: 1, f"{word}_style": BORDER_STYLE_CODES["single"]}  # there, until it is said to be none
        elif word in BORDER_STYLES or word in ("brdrnone", "brdrnil", "brdrw", "brdrcf", "brdrhair"):
            if self.row is not None and self.row["border"]:
                side = self.row["border"]
                target = self.row["def"] if side[:2] == "cl" else self.row["props"]
                if word == "brdrw":
                    target[f"{side}_w"] = max(0, n or 0)
                elif word == "brdrcf":
                    target[f"{side}_cf"] = n or 0
                elif word in ("brdrnone", "brdrnil"):
                    target[f"{side}_none"] = 1
                else:
                    target[f"{side}_style"] = BORDER_STYLE_CODES[BORDER_STYLES.get(word, "single")]
                    if word == "brdrhair":
                        target[f"{side}_hair"] = 1
        elif PADDING.match(word):
            (self.open_row()["def"] if word[:2] == "cl" else self.open_row()["props"])[word] = 0 if n is None else n
        else:
            return False
        return True

    # ---- the loop
    def events(self) -> list[dict]:
        try:
            self.run()
        except ScanError as e:
            return [{"etype": "error", "text": e.code, "props": {"offset": e.at}}]
        self.list_events()
        body, self.out = self.out, []
        texts = {}
        if self.lines is not None:
            texts = {"plain": "\n".join([a for a, _ in self.lines]), "shown": "\n".join([b for _, b in self.lines])}
        self.emit("doc", props=self.page, **texts)
        for k, (i, f) in enumerate(self.fonts.items()):
            props = {"id": i} | {x: f[x] for x in ("charset", "codepage") if f[x] is not None}
            self.emit("font", item=k, text=f["name"], props=props)
        return self.out + body

    def run(self) -> None:
        data = self.data
        size = len(data)
        if size > MAX_BYTES:
            raise ScanError("InputTooLarge", 0)
        if not data.startswith(b"{\\rtf"):
            raise ScanError("InvalidHeader", 0)
        token, pos, tokens = TOKEN.match, 0, 0
        while pos < size:
            self.at = pos
            m = token(data, pos)
            if m is None:
                self.diagnose("truncated-control")
                break
            kind = m.lastindex
            pos = m.end()
            if kind == 8:
                continue
            if not self.stack and tokens:
                if m.group().strip(b" \t\x0c"):
                    raise ScanError("UnexpectedGroupEnd" if kind == 2 else "InvalidHeader", self.at)
                continue
            tokens += len(m[7]) if kind == 7 else 1
            if tokens > MAX_TOKENS:
                raise ScanError("TokenLimit", self.at)
            if kind == 7:
                self.byte(m[7])
            elif kind == 3 or kind == 4:
                word, n = m[3], None
                if kind == 4:
                    n = self.number(m[4])
                if len(word) > 32:
                    self.long_word()
                elif word == b"bin":
                    pos = self.binary(pos, n or 0)
                elif self.skip:
                    self.skip -= 1
                else:
                    self.word(word.decode(), n)
                    if word == b"u" and self.skip and data[pos : pos + 1] == b"?":  # the usual stand-in
                        self.skip, pos, tokens = self.skip - 1, pos + 1, tokens + 1
            elif kind == 1:
                self.open_group()
            elif kind == 2:
                self.close_group()
            elif kind == 5:
                self.hex_byte(bytes.fromhex(m[5].decode()))
            else:
                self.symbol(m[6])
        if self.stack:
            raise ScanError("UnterminatedGroup", size)
        if not re.match(rb"\{\\rtf0*1(?![0-9])", data):
            raise ScanError("InvalidHeader", 0)
        self.at = size
        self.end_paragraph(False)
        self.drop_row()

    def number(self, digits: bytes) -> int:
        """A parameter: its first ten digits, within 32 bits."""
        sign = digits[:1] == b"-"
        digits = digits[1:] if sign else digits
        if len(digits) > 10:
            self.diagnose("control-parameter-overflow", "more than ten digits")
        n = -int(digits[:10]) if sign else int(digits[:10])
        if not LOW <= n <= HIGH:
            self.diagnose("control-parameter-overflow", "beyond 32 bits")
            n = max(LOW, min(HIGH, n))
        return n

    def long_word(self) -> None:
        self.diagnose("control-name-too-long")
        if self.skip:
            self.skip -= 1
            return
        s = self.scope
        if s.starred:
            self.flush_raw()
            s.dest, s.locked, s.starred = "skip", True, False
        s.fresh = False

    def binary(self, pos: int, n: int) -> int:
        """Bytes that follow ``\\bin``; where reading goes on."""
        if n < 0:
            raise ScanError("NegativeBinaryLength", self.at)
        if pos + n > len(self.data):
            raise ScanError("TruncatedBinary", self.at)
        if self.skip:
            self.skip -= 1
            return pos + n
        if self.scope.dest == "pict":
            self.picture_data(self.data[pos : pos + n])
        elif self.scope.dest != "skip":
            self.diagnose("unexpected-binary")
        self.scope.fresh = False
        return pos + n

    def byte(self, data: bytes) -> None:
        self.scope.fresh = False
        if self.skip:
            k = min(self.skip, len(data))
            self.skip -= k
            data = data[k:]
            if not data:
                return
        dest = self.scope.dest
        if dest in VISIBLE:
            self.add_bytes(data)
        elif dest == "pict":
            self.picture_hex(data)
        elif dest == "fonttbl":
            self.font_bytes(data)
        elif dest == "colortbl":
            for _ in range(data.count(b";")):
                c = {k: self.color.get(k) for k in ("red", "green", "blue")}
                self.emit("color", item=self.colors, props=c if None not in c.values() else {})
                self.colors += 1
                self.color = {}

    def hex_byte(self, value: bytes) -> None:
        if self.skip:
            self.skip -= 1
            return
        dest = self.scope.dest
        if dest == "pict":
            self.picture_data(value)
        elif dest == "fonttbl":
            self.the_font()["name"] += value
        elif dest in VISIBLE:
            self.add_bytes(value)
        self.scope.fresh = False

    def symbol(self, c: bytes) -> None:
        if self.skip:
            self.skip -= 1
            return
        s = self.scope
        if c == b"'":
            s.fresh = False
            return self.diagnose("invalid-hex-escape")
        if c == b"*" and s.fresh:
            s.starred = True
            return
        s.fresh = False
        if s.dest == "fonttbl":
            if c in b"\\{}~":
                self.the_font()["name"] += c.replace(b"~", b" ")
        elif s.dest in VISIBLE:
            known = {b"\\": "\\", b"{": "{", b"}": "}", b"~": " ", b"-": "­", b"_": "‑"}
            if c in known:
                self.add_text(known[c])
            elif c in (b"\r", b"\n"):
                self.end_paragraph(True)
            else:
                self.diagnose("unsupported-control-symbol", repr(c))


def scan(data: bytes | None, keep: frozenset[str] | None = None) -> list[dict]:
    """Events of one document, all or those of the types to keep (an error always); a null document is an invalid one."""
    return Scanner(data or b"", keep).events()
