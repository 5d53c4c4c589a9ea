"""One call from parsed events to laid-out documents: pages, lines, fragments, rules, paint and diagnostics.

Three steps. Paragraphs are gathered with their styles resolved (one shuffle of runs; fonts, colours, pictures and the
page are one bounded row for each document). Lines are broken paragraph by paragraph, wherever they are. Only the
heights of lines then go through a fold by document, which places them on pages; what is placed is joined back to the
fragments. Events and broken lines are written to the shared folder, so a lost executor repeats tasks, not the scan.
A document is bounded by the scan's limits and by ``max_pages``; one that breaks a limit gives an error row, no pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.operators import cells as C
from docframe.operators import layout as Y
from docframe.operators import lists as L
from docframe.operators import pictures as P
from docframe.operators.fonts import Face, clean_family, font_style, resolve_fonts
from docframe.runtime import ensure_importable, write_stage
from docframe.sources import rtf as R

#: The longest paper side in points, and scripts that need rules this layout does not have.
MAX_PAPER = 14400.0
COMPLEX = r"[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsThai}]"

MESSAGES = {
    "narrow-column": "The indents leave less than a point of line; a point was used.",
    "oversized-line": "A line is higher than the content of a page; it was placed once and may stick out.",
    "oversized-inline": "A picture or a single cluster is wider than its line.",
    "complex-script-layout": "A script was laid out left to right, without its own rules.",
    "narrow-table-cell": "The padding leaves less than a point of a cell; a point was used.",
    "table-row-overflow": "The content of a row is higher than its exact height; it is not clipped.",
    "unsupported-split-row-alignment": "A row that is cut over pages keeps its content at the top.",
    "oversized-table-row": "A line of a table is higher than the content of a page; it was placed once and may stick out.",
}

ITEM = (
    "struct<text:string,image_id:string,width:double,height:double,family:string,line_box:double,font:string,font_size:double,"
    "shift:double,color:string,highlight:string,underline:boolean,strike:boolean,shown:boolean>"
)
FRAGMENT = (
    "struct<text:string,image_id:string,x:double,y:double,width:double,height:double,baseline:double,font:string,font_size:double,"
    "color:string,highlight:string,underline:boolean,strike:boolean,shown:boolean>"
)
BROKEN = f"struct<codes:array<string>,heights:array<double>,lines:array<struct<x:double,width:double,fragments:array<{FRAGMENT}>>>>"
PLACED = (
    "doc_id string, kind string, page int, idx int, block int, cell_idx int, para_seq int, line int, x double, y double, width double, "
    "height double, opened boolean, closing boolean, code string"
)
_FIELDS = [f.split()[0] for f in PLACED.split(", ")]


@dataclass(frozen=True)
class Layout:
    """Views of one layout. ``errors`` holds documents without pages: (doc_id, error_code)."""

    pages: DataFrame
    lines: DataFrame
    fragments: DataFrame
    rules: DataFrame
    display_list: DataFrame
    diagnostics: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class Parts:
    """What a layout takes of documents, from events or from stored models.

    ``paragraphs`` has (doc_id, block, para_seq, p, r, marker, follow, _own) without hidden runs, ``places`` the island
    of each paragraph in a table, ``breaks`` the blocks that turn the page.
    """

    documents: DataFrame
    fonts: DataFrame
    colors: DataFrame
    images: DataFrame
    rows: DataFrame
    cells: DataFrame
    paragraphs: DataFrame
    places: DataFrame
    breaks: DataFrame
    diagnostics: DataFrame


def parts_of_events(events: DataFrame) -> Parts:
    """Parts of parsed documents; events that were written, as they are read several times."""
    numbered = L.markers(events).select("doc_id", "para_seq", "marker", "follow", F.struct("left_indent", "first_line_indent").alias("_own"))
    return Parts(
        R.documents(events), R.fonts(events), R.colors(events), R.images(events), C.rows(events), C.cells(events).drop("text"),
        R.paragraph_runs(events, keep_hidden=False).join(numbered, ["doc_id", "para_seq"], "left"),
        C.cell_paragraphs(events).select("doc_id", "block", "para_seq", "island"),
        events.where("etype = 'pagebreak'").select("doc_id", "block"), R.diagnostics(events),
    )


class Setter:
    """Breaks one paragraph into lines with the faces of its families."""

    def __init__(self, faces: dict[str, Face], default: Face):
        self.faces, self.default = {k.lower(): f for k, f in faces.items()}, default

    def face(self, item: dict) -> Face:
        return self.faces.get((item["family"] or "").lower(), self.default)

    def tokens(self, items: list[dict]) -> Iterator[tuple[str, list[tuple[str, float, dict]]]]:
        """(kind, clusters): image, break, tab, space or word; a cluster is (text, width, item). A change of style
        does not end a word."""
        run: list[dict] = []
        for item in [*items, None]:
            if item is not None and item["image_id"] is None:
                run.append(item)
                continue
            owners, at = [it for it in run for _ in it["text"]], 0
            for token in Y._tokens("".join(it["text"] for it in run)):
                kind = {"\n": "break", "\t": "tab", " ": "space"}.get(token[0], "word")
                clusters, k = [], at
                for g in Y.clusters(token):
                    clusters.append((g, self.face(owners[k]).width(g, owners[k]["font_size"]), owners[k]))
                    k += len(g)
                at += len(token)
                yield kind, clusters
            run = []
            if item is not None:
                yield "image", [("", item["width"], item)]

    def lines(self, items: list[dict], mark: dict, column: float, page_height: float, p: dict, tab: float) -> dict:
        """Lines from ``x`` in their column, with heights; ``y`` and ``baseline`` of fragments count from the line."""
        left, first = p["left_indent"], p["first_line_indent"]
        body = column - left - p["right_indent"]
        codes: dict[str, None] = {}
        if body - max(0.0, first) < Y.MIN_COLUMN:
            codes["narrow-column"] = None
            body = Y.MIN_COLUMN + max(0.0, first)
        tab = tab if tab > 0 else Y.DEFAULT_TAB
        up, down = self.face(mark).box(mark["font_size"], mark["line_box"])
        heights: list[float] = []
        made: list[dict] = []
        line: list[tuple[str, float, dict]] = []  # (text, width, item); a tab is a blank of its own
        width, kind = 0.0, ""

        def indent() -> float:
            return 0.0 if made else first

        def end(last: bool) -> None:
            nonlocal width
            while line and line[-1][2]["image_id"] is None and not line[-1][0].strip(" "):
                width -= line.pop()[1]
            heights.append(self._place(line, width, last, left + indent(), body - indent(), up, down, p, made))
            if heights[-1] > page_height:
                codes["oversized-line"] = None
            if width > body - indent_used + Y.EPSILON:
                codes["oversized-inline"] = None
            line.clear()
            width = 0.0

        for kind, clusters in self.tokens(items):
            indent_used = indent()
            if kind == "break":
                end(True)
                continue
            if kind == "tab":
                reach = tab - (left + indent() + width) % tab
                if line and width + reach > body - indent():
                    end(False)
                    reach = tab - (left + width) % tab
                line.append((" ", reach, mark))
                width += reach
                continue
            wide = sum(w for _, w, _ in clusters)
            if line and width + wide > body - indent() + Y.EPSILON:
                end(False)
                indent_used = indent()
                if kind == "space":
                    continue
            at = 0
            while kind != "image" and wide > body - indent():
                n, taken = at, 0.0
                while n < len(clusters) and (taken + clusters[n][1] <= body - indent() or n == at):
                    taken += clusters[n][1]
                    n += 1
                if n == len(clusters):
                    break
                width += self._add(line, clusters[at:n])
                end(False)
                indent_used = indent()
                wide, at = wide - taken, n
            width += self._add(line, clusters[at:])
        indent_used = indent()
        if line or not made or kind == "break":
            end(True)
        return {"codes": list(codes), "heights": heights, "lines": made}

    @staticmethod
    def _add(line: list, clusters: list) -> float:
        """Join neighbouring clusters of one style to pieces; their width."""
        start = len(line)
        for text, width, item in clusters:
            if len(line) > start and line[-1][2] is item:
                line[-1] = (line[-1][0] + text, line[-1][1] + width, item)
            else:
                line.append((text, width, item))
        return sum(w for _, w, _ in line[start:])

    def _place(self, line: list, width: float, last: bool, x: float, room: float, up: float, down: float, p: dict, made: list) -> float:
        for _, _, it in line:
            a, d = (it["height"], 0.0) if it["image_id"] is not None else self.face(it).box(it["font_size"], it["line_box"])
            up, down = max(up, a + it["shift"]), max(down, d - it["shift"])
        natural = max(1.0, up + down)
        value = p["spacing_value"]
        height = {
            "exact": lambda: max(0.1, value), "atLeast": lambda: max(natural, value), "multiple": lambda: max(0.1, natural * value),
        }.get(p["spacing_kind"], lambda: natural)()
        slack = max(0.0, room - width)
        x += {"center": slack / 2, "right": slack}.get(p["align"], 0.0)
        blanks = [it["image_id"] is None and not text.strip(" ") for text, _, it in line]
        extra = slack / sum(blanks) if p["align"] == "justify" and not last and any(blanks) else 0.0
        base, start = up + (height - natural) / 2, x
        keep = ("image_id", "font", "font_size", "color", "highlight", "underline", "strike", "shown")
        fragments = []
        for (text, w, it), blank in zip(line, blanks):
            w += extra if blank else 0.0
            image = it["image_id"] is not None
            y, h = (base - it["height"], it["height"]) if image else (0.0, height)
            place = {"text": None if image else text, "x": x, "y": y, "width": w, "height": h, "baseline": None if image else base - it["shift"]}
            fragments.append(place | {k: it[k] for k in keep})
            x += w
        made.append({"x": start, "width": x - start, "fragments": fragments})
        return height


def _dims(parts: Parts, fonts: DataFrame) -> DataFrame:
    """One row for each document: page, maps of fonts, colours and picture sizes (bounded by the scan), its error."""
    as_map = lambda *c: F.map_from_entries(F.collect_list(F.struct(*c)))
    f = fonts.groupBy("doc_id").agg(as_map("id", F.struct("family", "line_box")).alias("fonts"))
    c = parts.colors.groupBy("doc_id").agg(as_map("idx", "rgb").alias("colors"))
    probed = P.with_display_size(P.with_pixels(parts.images))
    probed = probed.withColumn("shown", F.col("format").isin("png", "jpeg") | F.col("raster").isNotNull())
    i = P.admission(probed).drop("data", "raster").groupBy("doc_id").agg(
        as_map("image_id", F.struct("display_width", "display_height", "shown")).alias("images"), F.min_by("refused", F.when(F.col("refused").isNotNull(), F.col("image_seq"))).alias("refused")
    )
    d = parts.documents.join(f, "doc_id", "left").join(c, "doc_id", "left").join(i, "doc_id", "left")
    page = lambda k: F.col(f"page.{k}")
    sides = [page(k) for k in ("marginLeft", "marginRight", "marginTop", "marginBottom")]
    good = (page("width") > 0) & (page("width") <= MAX_PAPER) & (page("height") > 0) & (page("height") <= MAX_PAPER)
    for side in sides:
        good &= side >= 0
    good &= (page("width") > sides[0] + sides[1]) & (page("height") > sides[2] + sides[3])
    error = F.coalesce(F.col("error_code"), F.when(~good, "InvalidPage"), F.col("refused"))
    return d.select("doc_id", "page", "default_tab", "fonts", "colors", "images", error.alias("error"))


def _item(text: Column, style: Column, image: Column, fallback: str | None) -> Column:
    """An inline item from a style and the maps of its document."""
    font = F.col("fonts")[style["font_id"]]
    size = style["half_points"] / 2.0
    family = F.coalesce(font["family"], F.lit(fallback or None), F.lit("serif"))
    picture = F.col("images")[image]
    hue = lambda c: F.when(c.isNotNull(), F.col("colors")[c])
    return F.struct(
        text.alias("text"), image.alias("image_id"), F.coalesce(picture["display_width"], F.lit(P.DEFAULT_WIDTH)).alias("width"),
        F.coalesce(picture["display_height"], F.lit(P.DEFAULT_HEIGHT)).alias("height"), clean_family(family).alias("family"),
        font["line_box"].alias("line_box"), font_style(family, size, style["bold"], style["italic"], fallback).alias("font"), size.alias("font_size"),
        F.when(image.isNull(), F.coalesce(style["shift"], F.lit(0.0))).otherwise(0.0).alias("shift"),
        F.coalesce(hue(style["color"]), F.lit("#000000")).alias("color"), hue(style["highlight"]).alias("highlight"),
        F.coalesce(style["underline"], F.lit(False)).alias("underline"), F.coalesce(style["strike"], F.lit(False)).alias("strike"),
        F.coalesce(picture["shown"], F.lit(False)).alias("shown"),
    )


def _tables(parts: Parts, dims: DataFrame) -> DataFrame:
    """Cells with their place in the page's content, borders with colours, fill, and the row they belong to."""
    r = parts.rows.select("doc_id", "block", F.col("left").alias("row_left"), "height_kind", F.col("height").alias("row_height"), "align")
    cells = parts.cells
    ends = cells.groupBy("doc_id", "block").agg(F.max("right").alias("_far"), F.array_sort(F.collect_list("right")).alias("_rights"))
    got = cells.join(ends, ["doc_id", "block"]).join(r, ["doc_id", "block"]).join(dims.where("error is null").select("doc_id", "page", "colors"), "doc_id")
    content = F.col("page.width") - F.col("page.marginLeft") - F.col("page.marginRight")
    span = F.col("_far") - F.col("row_left")
    shift = F.when(span > 0, F.when(F.col("align") == "center", (content - span) / 2 - F.col("row_left")).when(F.col("align") == "right", content - span - F.col("row_left")))
    x0 = F.col("page.marginLeft") + F.coalesce(shift, F.lit(0.0))
    before = F.when(F.col("cell_idx") == 0, F.col("row_left")).otherwise(F.get("_rights", F.col("cell_idx") - 1))
    hue = lambda c, other: F.coalesce(F.when(c.isNotNull(), F.col("colors")[c.cast("int")]), F.lit(other))
    side = lambda s: F.when(
        F.col(f"borders.{s}.style") != "none", F.struct(F.col(f"borders.{s}.width").alias("width"), hue(F.col(f"borders.{s}.color"), "#000000").alias("color"))
    ).alias(s)
    back = F.when(F.col("shading.background").isNotNull(), hue(F.col("shading.background"), "#ffffff"))
    fill = F.when(F.col("shading").isNotNull(), C.blend(back, hue(F.col("shading.foreground"), "#000000"), F.col("shading.intensity")))
    return got.select(
        "doc_id", "block", "cell_idx", "island", (x0 + before).alias("x"), (F.col("right") - before).alias("width"), "padding",
        F.struct(*[side(s) for s in C.SIDES]).alias("borders"), fill.alias("fill"), "vertical_align", "height_kind", "row_height",
    )


def broken_paragraphs(
    parts: Parts, dims: DataFrame, tables: DataFrame, faces: dict[str, Face], default: Face, fallback: str | None = None
) -> DataFrame:
    """Paragraphs with ``broken`` lines and their place (block, cell_idx, para_seq), without those of documents in error."""
    ensure_importable(dims.sparkSession)
    in_cells = parts.places.join(
        tables.select("doc_id", "block", "island", "cell_idx", "width", "padding"), ["doc_id", "block", "island"]
    )
    whole = (
        parts.paragraphs.join(dims.where("error is null"), "doc_id")
        .join(in_cells.select("doc_id", "para_seq", "cell_idx", "width", "padding"), ["doc_id", "para_seq"], "left")
        .join(tables.select("doc_id", "block").distinct().withColumn("_row", F.lit(True)), ["doc_id", "block"], "left")
        .where("cell_idx is not null or _row is null")  # a row without any accepted boundary is body text
    )
    no_image = F.lit(None).cast("string")
    mark = _item(F.lit(""), F.col("p.mark_style"), no_image, fallback)
    lead = F.coalesce("marker", F.lit(""))
    after = F.when(F.col("marker").isNull(), "").when(F.col("follow") == "tab", "\t").when(F.col("follow") == "space", " ").otherwise("")
    cached = F.when(F.col("marker").isNull(), F.coalesce("p.list_text", F.lit(""))).otherwise("")
    label = _item(F.concat(lead, after, cached), F.col("p.mark_style"), no_image, fallback)
    items = F.transform("r", lambda x: _item(x["text"], x["style"], x["image_id"], fallback))
    items = F.when(F.length(F.concat(lead, cached)) > 0, F.concat(F.array(label), items)).otherwise(items)
    page = F.col("page")
    content = page["width"] - page["marginLeft"] - page["marginRight"]
    inner = F.greatest(F.lit(Y.MIN_COLUMN), F.col("width") - F.col("padding.left") - F.col("padding.right"))
    own = lambda c: F.coalesce(F.col(f"_own.{c}"), F.col(f"p.{c}"), F.lit(0.0)).alias(c)
    frame = F.struct(
        own("left_indent"), own("first_line_indent"), F.coalesce("p.right_indent", F.lit(0.0)).alias("right_indent"), F.col("p.align").alias("align"),
        F.col("p.line_spacing.kind").alias("spacing_kind"), F.col("p.line_spacing.value").alias("spacing_value"),
    )
    rows = whole.select(
        "doc_id", "block", "cell_idx", "para_seq", F.greatest(F.lit(0.0), F.col("p.space_before")).alias("before"),
        F.greatest(F.lit(0.0), F.col("p.space_after")).alias("after"), F.col("p.page_break_before").alias("breaks"),
        F.exists("r", lambda x: x["text"].rlike(COMPLEX)).alias("complex"), items.cast(f"array<{ITEM}>").alias("items"), mark.cast(ITEM).alias("mark"), frame.alias("frame"),
        F.when(F.col("cell_idx").isNull(), content).otherwise(inner).alias("column"), (page["height"] - page["marginTop"] - page["marginBottom"]).alias("room"), "default_tab",
    )
    setter = Setter(faces, default)

    @F.pandas_udf(BROKEN)
    def run(
        batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.DataFrame, pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.DataFrame]:
        for items, mark, frame, column, room, tab in batches:
            made = [
                setter.lines(list(i), m, c, h, f, t)
                for i, m, f, c, h, t in zip(items, mark.to_dict("records"), frame.to_dict("records"), column, room, tab)
            ]
            yield pd.DataFrame(made, columns=["codes", "heights", "lines"])

    done = rows.withColumn("broken", run("items", "mark", "frame", "column", "room", "default_tab"))
    return done.select("doc_id", "block", "cell_idx", "para_seq", "before", "after", "breaks", "complex", "broken")


class _Pager:
    """Places one document's units, in order, on pages; only heights and boxes come in."""

    def __init__(self, doc: str, page: dict, max_pages: int):
        self.doc, self.p, self.max_pages = doc, page, max_pages
        self.top, self.bottom = page["marginTop"], page["height"] - page["marginBottom"]
        self.out: list[tuple] = []
        self.codes: dict[str, None] = {}
        self.page, self.error = -1, None
        self.turn()

    def emit(self, kind: str, **values) -> None:
        self.out.append(tuple({"doc_id": self.doc, "kind": kind, "page": self.page, **values}.get(f) for f in _FIELDS))

    def turn(self) -> None:
        if self.page + 1 >= self.max_pages:
            self.error = "PageLimit"
            return
        self.page += 1
        self.y, self.n, self.boxes = self.top, 0, 0
        self.emit("page", width=self.p["width"], height=self.p["height"])

    def line(self, u: dict, k: int, y: float, height: float, x: float) -> None:
        self.emit("line", idx=self.n, block=u["block"], cell_idx=u["cell_idx"], para_seq=u["para_seq"], line=k, x=x, y=y, height=height)
        self.n += 1

    def warn(self, *codes: str) -> None:
        self.codes.update(dict.fromkeys(codes))

    def paragraph(self, u: dict) -> None:
        if u["complex"]:
            self.warn("complex-script-layout")
        self.warn(*u["codes"])
        if u["breaks"] and (self.n or self.y > self.top):
            self.turn()
        before = u["before"]
        if self.y + before >= self.bottom and self.n:
            self.turn()
            before = 0.0
        self.y += before
        for k, h in enumerate(u["heights"]):
            if self.error:
                return
            if self.y + h > self.bottom + Y.EPSILON and self.n:
                self.turn()
            self.line(u, k, self.y, h, self.p["marginLeft"])
            self.y += h
        self.y += u["after"]

    def row(self, block: int, cells: list[dict], paragraphs: list[dict]) -> None:
        """One table row: ``cells`` in order, ``paragraphs`` by cell and place."""
        plans = []
        for c in cells:
            pad = c["padding"]
            if c["width"] - pad["left"] - pad["right"] < Y.MIN_COLUMN:
                self.warn("narrow-table-cell")
            y, lines = pad["top"], []
            for u in (u for u in paragraphs if u["cell_idx"] == c["cell_idx"]):
                self.warn(*u["codes"])
                y += u["before"]
                for k, h in enumerate(u["heights"]):
                    lines.append([y, h, k, u])
                    y += h
                y += u["after"]
            plans.append({"cell": c, "lines": lines, "height": y + pad["bottom"]})
        natural = max(p["height"] for p in plans)
        kind, value = cells[0]["height_kind"], max(0.0, cells[0]["row_height"] or 0.0)
        tall = {"atLeast": max(natural, value), "exact": value}.get(kind, natural)
        if kind == "exact" and natural > tall + Y.EPSILON:
            self.warn("table-row-overflow")
        if tall <= 0:
            return
        room = self.bottom - self.top
        for p in plans:
            share = {"center": 0.5, "bottom": 1.0}.get(p["cell"]["vertical_align"], 0.0)
            if share and tall > room:
                self.warn("unsupported-split-row-alignment")
            elif share and tall - p["height"] > Y.EPSILON:
                for ln in p["lines"]:
                    ln[0] += (tall - p["height"]) * share
        stops = sorted({ln[0] + ln[1] for p in plans for ln in p["lines"]})
        empty = not (self.n or self.boxes)
        for turn, start, to, closing in Y.cut_row(tall, stops, self.y - self.top, empty, room):
            if turn:
                self.turn()
            if self.error:
                return
            if not closing and to - start > self.bottom - self.y + Y.EPSILON:
                self.warn("oversized-table-row")
            for p in plans:
                c, later = p["cell"], []
                for ln in p["lines"]:
                    if closing or ln[0] + ln[1] <= to + Y.EPSILON:
                        self.line(ln[3], ln[2], self.y + ln[0] - start, ln[1], c["x"] + c["padding"]["left"])
                    else:
                        later.append(ln)
                p["lines"] = later
                self.emit("box", block=block, cell_idx=c["cell_idx"], x=c["x"], y=self.y, width=c["width"], height=to - start, opened=start > Y.EPSILON, closing=closing)
                self.boxes += 1
            self.y += to - start

    def end(self) -> list[tuple]:
        """All rows of the document, or its error alone."""
        if self.error:
            self.out, code, self.page = [], self.error, None
            self.emit("error", code=code)
            return self.out
        self.page = None
        for k, code in enumerate(self.codes):
            self.emit("diag", idx=k, code=code)
        return self.out


def place(units: DataFrame, max_pages: int = 2000) -> DataFrame:
    """Rows of pages, lines, boxes, diagnostics and errors from units sorted by document: a fold, one document held."""
    ensure_importable(units.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pager: _Pager | None = None
        row: tuple[int, list, list] | None = None  # the open table row: block, cells, paragraphs

        def close() -> None:
            nonlocal row
            if row is not None and pager is not None and not pager.error:
                pager.row(*row)
            row = None

        for pdf in batches:
            out: list[tuple] = []
            for u in pdf.to_dict("records"):
                if row is not None and (pager is None or u["doc_id"] != pager.doc or u["block"] != row[0]):
                    close()
                if u["kind"] == "doc":
                    out += pager.end() if pager else []
                    pager = _Pager(u["doc_id"], u["page"], max_pages)
                elif pager.error:
                    continue
                elif u["kind"] == "break":
                    pager.turn()
                elif u["kind"] == "row":
                    row = (u["block"], list(u["cells"]), [])
                else:
                    u |= {k: [] if u[k] is None else list(u[k]) for k in ("codes", "heights")}
                    u["cell_idx"] = None if u["cell_idx"] != u["cell_idx"] else u["cell_idx"]
                    if row is not None and u["cell_idx"] is not None:
                        row[2].append(u)
                    else:
                        pager.paragraph(u)
            if out:
                yield pd.DataFrame(out, columns=_FIELDS)
        close()
        if pager:
            yield pd.DataFrame(pager.end(), columns=_FIELDS)

    dealt = units.repartition("doc_id").sortWithinPartitions("doc_id", "block", "ord", "cell_idx", "para_seq")
    return dealt.mapInPandas(run, PLACED)


def lay_out(
    events: DataFrame, faces: dict[str, Face] | None = None, default: Face = Face(), fonts: dict[str, str] | None = None,
    line_heights: dict[str, float] | None = None, fallback: str | None = None, max_pages: int = 2000,
) -> Layout:
    """Lay out whole documents from all their events.

    ``faces`` gives what families measure (by name, any case) and ``default`` what all others do; ``fonts`` maps names
    of the documents to families, ``line_heights`` declares line boxes in ems by the documents' names.
    """
    parts = parts_of_events(write_stage(events, "events"))
    return lay_out_parts(parts, faces, default, fonts, line_heights, fallback, max_pages)


def lay_out_parts(
    parts: Parts, faces: dict[str, Face] | None = None, default: Face = Face(), fonts: dict[str, str] | None = None,
    line_heights: dict[str, float] | None = None, fallback: str | None = None, max_pages: int = 2000,
) -> Layout:
    """The same from parts, wherever they come from."""
    if not 1 <= max_pages <= 2000:
        raise ValueError("max_pages must be from 1 to 2000")
    dims = write_stage(_dims(parts, resolve_fonts(parts.fonts, fonts, line_heights, fallback)), "dims")
    tables = _tables(parts, dims)
    paras = write_stage(broken_paragraphs(parts, dims, tables, faces or {}, default, fallback), "lines")

    cell = F.struct("cell_idx", "x", "width", "padding", "vertical_align", "height_kind", "row_height")
    rows = tables.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(cell), lambda a, b: a["cell_idx"] - b["cell_idx"]).alias("cells"))
    good = dims.where("error is null")
    units = good.select("doc_id", F.lit("doc").alias("kind"), F.lit(-1).alias("block"), F.lit(0).alias("ord"), "page")
    for df in (
        parts.breaks.join(good, "doc_id", "left_semi").select("doc_id", F.lit("break").alias("kind"), "block", F.lit(0).alias("ord")),
        rows.select("doc_id", F.lit("row").alias("kind"), "block", F.lit(0).alias("ord"), "cells"),
        paras.select(
            "doc_id", F.lit("para").alias("kind"), "block", F.lit(1).alias("ord"), "cell_idx", "para_seq", "before", "after", "breaks", "complex",
            F.col("broken.codes").alias("codes"), F.col("broken.heights").alias("heights"),
        ),
    ):
        units = units.unionByName(df, allowMissingColumns=True)
    placed = write_stage(place(units, max_pages), "placed")

    lines = placed.where("kind = 'line'").select("doc_id", "page", F.col("idx").alias("line"), "block", "cell_idx", "para_seq", F.col("line").alias("para_line"), F.col("x").alias("_x"), "y", "height")
    texts = paras.select("doc_id", "para_seq", F.posexplode("broken.lines").alias("para_line", "l"))
    joined = lines.join(texts, ["doc_id", "para_seq", "para_line"])
    lines = joined.select("doc_id", "page", "line", "block", "cell_idx", "para_seq", (F.col("_x") + F.col("l.x")).alias("x"), "y", F.col("l.width").alias("width"), "height")
    glyphs = F.col("f.image_id").isNull()  # a picture has a place, but no style
    pieces = joined.select("doc_id", "page", "line", "block", F.col("_x"), F.col("y").alias("_y"), F.posexplode("l.fragments").alias("piece", "f")).select(
        "doc_id", "page", "line", "block", "piece", "f.text", "f.image_id", (F.col("_x") + F.col("f.x")).alias("x"), (F.col("_y") + F.col("f.y")).alias("y"),
        "f.width", "f.height", (F.col("_y") + F.col("f.baseline")).alias("baseline"), *[F.when(glyphs, F.col(f"f.{c}")).alias(c) for c in ("font", "font_size", "color", "highlight")],
        *[(glyphs & F.col(f"f.{c}")).alias(c) for c in ("underline", "strike")], "f.shown",
    )
    boxes = placed.where("kind = 'box'").select("doc_id", "page", "block", "cell_idx", "x", "y", "width", "height", "opened", "closing")
    boxes = boxes.join(tables.select("doc_id", "block", "cell_idx", "fill", "borders"), ["doc_id", "block", "cell_idx"])
    rules = Y.rules(boxes, ["doc_id", "page", "block", "cell_idx"])
    pages = placed.where("kind = 'page'").select("doc_id", "page", "width", "height")
    message = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("code"))
    own = placed.where("kind = 'diag'").select("doc_id", F.col("idx").alias("diag_seq"), F.lit("layout").alias("stage"), "code", message.alias("message"), F.lit(0).cast("bigint").alias("offset"))
    diagnostics = parts.diagnostics.unionByName(own)
    errors = dims.where("error is not null").select("doc_id", F.col("error").alias("error_code")).unionByName(placed.where("kind = 'error'").select("doc_id", F.col("code").alias("error_code")))
    return Layout(pages, lines, pieces, rules, Y.display_list(pieces, rules, pages), diagnostics, errors)
