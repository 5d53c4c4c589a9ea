"""Geometry with a declared measurer: line breaking by paragraph, pagination by document, pixel sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.runtime import ensure_importable

EPSILON = 0.001
MAX_AXIS, MAX_PAGES = 32767, 2000


def pixel_size(points: Column, ppi: float = 96.0, scale: float = 1.0, ratio: float = 1.0) -> Column:
    """Pixels of a length: rounded up, but a whole number within four units in the last place stays; null beyond
    the largest axis."""
    v = points * F.lit(ppi) / F.lit(72.0) * F.lit(scale) * F.lit(ratio)
    whole = (F.abs(v - F.rint(v)) <= 4 * 2.220446049250313e-16 * F.abs(v)) & (F.rint(v) > 0)
    pixels = F.when(whole, F.rint(v)).otherwise(F.ceil(v)).cast("long")
    return F.when(pixels.between(1, MAX_AXIS), pixels)


def clusters(text: str) -> list[str]:
    """Graphemes; plain ASCII without line ends has one for each character."""
    if text.isascii() and "\r" not in text:
        return list(text)
    import regex

    return regex.findall(r"\X", text)


def wrap(text: str, width: float, advance: float = 5.0) -> list[str]:
    """Greedy lines of ``width`` with every grapheme ``advance`` wide; longer words are split, newlines break."""
    room = max(1, int((width + EPSILON) // advance))
    lines: list[str] = []
    for part in text.split("\n"):
        if len(part) <= room:  # no more graphemes than characters
            lines.append(part.rstrip())
            continue
        plain = part.isascii() and "\r" not in part
        line: list[str] = []
        used = 0
        for token in re.findall(r"[ \t]+|[^ \t]+", part):
            n = len(token) if plain else len(clusters(token))
            if token[0] in " \t":
                line.append(token)
                used += n
                continue
            if used and used + n > room:
                lines.append("".join(line).rstrip())
                line, used = [], 0
            if used + n > room:
                marks = clusters(token)
                while used + len(marks) > room:
                    lines.append("".join([*line, *marks[: room - used]]))
                    marks, line, used = marks[room - used :], [], 0
                token, n = "".join(marks), len(marks)
            line.append(token)
            used += n
        lines.append("".join(line).rstrip())
    return lines


def break_lines(paragraphs: DataFrame, width: float, text: str = "text", advance: float = 5.0) -> DataFrame:
    """Add ``lines`` (array of strings). Paragraphs are independent, so this runs wherever they are."""
    ensure_importable(paragraphs.sparkSession)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: wrap(t or "", width, advance))

    return paragraphs.withColumn("lines", run(F.col(text)))


def paginate(lines: DataFrame, height: float, order: list[str], line_height: str = "height", before: str = "before") -> DataFrame:
    """(doc_id, page, y, ... ) of lines packed in order: a line that does not fit opens a page, where space before
    it does not count. A fold by document; documents are independent."""
    fields = ",".join(f"{n} {t}" for n, t in lines.dtypes)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, page, y, started = None, 0, 0.0, False
        for pdf in batches:
            pages, ys = [], []
            for d, h, b in zip(pdf["doc_id"], pdf[line_height], pdf[before]):
                if d != doc:
                    doc, page, y, started = d, 0, 0.0, False
                if started and y + b + h > height + EPSILON:
                    page, y, started = page + 1, 0.0, False
                y += b if started or page == 0 else 0.0
                pages.append(page)
                ys.append(y)
                y, started = y + h, True
            yield pdf.assign(page=pages, y=ys)

    dealt = lines.repartition("doc_id").sortWithinPartitions("doc_id", *order)
    return dealt.mapInPandas(pack, f"{fields}, page int, y double")


# Scripts that break between any two characters, and marks that stay with what follows or precedes.
WIDE = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}"
OPENING = "（［｛〈《「『【〔〖〘〚“‘([{"
CLOSING = "、。，．？！：；）］｝〉》」』】〕〗〙〛”’!?,.;:)]}"
MIN_COLUMN, DEFAULT_TAB = 1.0, 36.0

LAID = "array<struct<start:double,room:double,width:double,last:boolean,pieces:array<struct<text:string,width:double>>>>"


def _tokens(text: str) -> list[str]:
    """Newlines, tabs, runs of spaces, and words; a word ends where two wide characters may be parted."""
    import regex

    mark = r"\p{M}‍"
    gap = f"(?:(?<=[{WIDE}][{mark}]*)|(?=[{WIDE}]))(?<![{regex.escape(OPENING)}])(?![{regex.escape(CLOSING)}{mark}])"
    tokens: list[str] = []
    for part in regex.findall(r"\n|\t| +|[^\n\t ]+", text):
        tokens += [part] if part[0] in "\n\t " else [w for w in regex.split(f"(?V1){gap}", part) if w]
    return tokens


def flow(
    text: str, column: float, left: float = 0.0, right: float = 0.0, first: float = 0.0, tab: float = DEFAULT_TAB, advance: float = 5.0
) -> list[dict]:
    """Lines of one paragraph in a column: where each starts, its room, the width of its ink, whether it ends the
    paragraph or a forced line, and its pieces. Every grapheme is ``advance`` wide; tabs go to multiples of ``tab``
    from the column's edge; spaces at a line's end take no room; too narrow a column counts as one point."""
    body = max(column - left - right, MIN_COLUMN + max(0.0, first))
    tab = tab if tab > 0 else DEFAULT_TAB
    lines: list[dict] = []
    pieces: list[tuple[str, float]] = []
    indent = lambda: 0.0 if lines else first
    used = lambda: sum(w for _, w in pieces)

    def end(last: bool) -> None:
        while pieces and not pieces[-1][0].strip(" "):
            pieces.pop()
        made = [{"text": t, "width": w} for t, w in pieces]
        lines.append({"start": left + indent(), "room": body - indent(), "width": used(), "last": last, "pieces": made})
        pieces.clear()

    tokens = _tokens(text)
    for token in tokens:
        if token == "\n":
            end(True)
        elif token == "\t":
            reach = lambda: tab - (left + indent() + used()) % tab
            if pieces and used() + reach() > body - indent():
                end(False)
            pieces.append((" ", reach()))
        else:
            marks = clusters(token)
            if pieces and used() + advance * len(marks) > body - indent() + EPSILON:
                end(False)
                if token[0] == " ":
                    continue
            while advance * len(marks) > (room := body - indent()):
                n = max(1, int(room // advance))
                if n >= len(marks):
                    break
                pieces.append(("".join(marks[:n]), advance * n))
                marks = marks[n:]
                end(False)
            pieces.append(("".join(marks), advance * len(marks)))
    if pieces or not lines or tokens[-1:] == ["\n"]:
        end(True)
    return lines


def lay_lines(paragraphs: DataFrame, column: float, tab: float = DEFAULT_TAB, advance: float = 5.0) -> DataFrame:
    """Add ``laid`` to paragraphs with text, left_indent, right_indent and first_line_indent."""
    ensure_importable(paragraphs.sparkSession)

    @F.pandas_udf(LAID)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, left, right, first in batches:
            yield pd.Series([flow(t or "", column, a, b, c, tab, advance) for t, a, b, c in zip(text, left, right, first)])

    indents = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("left_indent", "right_indent", "first_line_indent")]
    return paragraphs.withColumn("laid", run(F.col("text"), *indents))


def line_height(kind: Column, value: Column, natural: Column) -> Column:
    """Height of a line by its paragraph's spacing."""
    return (
        F.when(kind == "exact", F.greatest(F.lit(0.1), value)).when(kind == "atLeast", F.greatest(natural, value))
        .when(kind == "multiple", F.greatest(F.lit(0.1), natural * value)).otherwise(natural)
    )


def fragments(laid: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each piece: keys, line (from 0), piece, text, x and width, by the paragraph's ``align``.

    Justified lines share their slack among pieces of spaces, but for the last line and forced ones.
    """
    blank = lambda p: p["text"].rlike("^ +$")
    line = laid.select(*keys, "align", F.posexplode("laid").alias("line", "l"))
    slack = F.greatest(F.lit(0.0), F.col("l.room") - F.col("l.width"))
    spaces = F.size(F.filter("l.pieces", blank))
    line = line.withColumns({
        "_x": F.col("l.start") + F.when(F.col("align") == "center", slack / 2).when(F.col("align") == "right", slack).otherwise(0.0),
        "_extra": F.when((F.col("align") == "justify") & ~F.col("l.last") & (spaces > 0), slack / spaces).otherwise(0.0),
    })
    wide = F.transform("l.pieces", lambda p: F.struct(p["text"].alias("text"), (p["width"] + F.when(blank(p), F.col("_extra")).otherwise(0.0)).alias("width")))
    line = line.withColumn("_p", wide)
    before = lambda i: F.aggregate(F.slice("_p", F.lit(1), i), F.col("_x"), lambda x, p: x + p["width"])
    placed = F.transform("_p", lambda p, i: F.struct(i.alias("piece"), p["text"].alias("text"), before(i).alias("x"), p["width"].alias("width")))
    return line.select(*keys, "line", F.inline(placed))


def cut_row(tall: float, stops: list[float], y: float, empty: bool, height: float) -> Iterator[tuple[bool, float, float, bool]]:
    """Parts of a row on pages of ``height``, begun at ``y``: (on a new page, from, to, closing)."""
    done, turn = 0.0, False
    while tall - done > height - y + EPSILON:
        ahead = [s for s in stops if s > done + EPSILON]
        fits = [s for s in ahead if s - done <= height - y + EPSILON]
        if not fits and not empty:
            turn, y, empty = True, 0.0, True
            continue
        to = max(fits) if fits else min(ahead) if ahead else min(tall, max(done, done + height - y))
        yield turn, done, to, False
        done, turn, y, empty = to, True, 0.0, True
    yield turn, done, tall, True


def split_rows(blocks: DataFrame, height: float, order: list[str], stops: str = "stops") -> DataFrame:
    """Pages of blocks that may be cut: adds page, y, cut_from, cut_to and closing, one row for each part.

    ``stops`` holds the bottoms of a row's lines; a row that does not fit is cut at the lowest of them that does, goes
    on a new page if none does, and on an empty page is cut at its next stop however tall. A fold by document.
    """
    fields = ",".join(f"{n} {t}" for n, t in blocks.dtypes)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, page, y, empty = None, 0, 0.0, True
        for pdf in batches:
            at, out = [], []
            for k, (d, tall, bottoms) in enumerate(zip(pdf["doc_id"], pdf["height"], pdf[stops])):
                if d != doc:
                    doc, page, y, empty = d, 0, 0.0, True
                if not tall > 0:  # nothing to place
                    continue
                for turn, start, to, closing in cut_row(tall, sorted(set([] if bottoms is None else bottoms)), y, empty, height):
                    if turn:
                        page, y = page + 1, 0.0
                    at.append(k)
                    out.append((page, y, start, to, closing))
                    y, empty = y + to - start, False
            made = pd.DataFrame(out, columns=["page", "y", "cut_from", "cut_to", "closing"])
            yield pd.concat([pdf.iloc[at].reset_index(drop=True), made], axis=1)

    dealt = blocks.repartition("doc_id").sortWithinPartitions("doc_id", *order)
    return dealt.mapInPandas(pack, f"{fields}, page int, y double, cut_from double, cut_to double, closing boolean")


def row_height(kind: Column, value: Column, natural: Column) -> Column:
    return F.when(kind == "atLeast", F.greatest(natural, value, F.lit(0.0))).when(kind == "exact", F.greatest(value, F.lit(0.0))).otherwise(natural)


def row_shift(align: Column, left: Column, rightmost: Column, content_width: float) -> Column:
    """How far a row moves to the right by its alignment in the page's content."""
    width = rightmost - left
    moved = F.when(align == "center", (F.lit(content_width) - width) / 2 - left).when(align == "right", F.lit(content_width) - width - left)
    return F.when(width > 0, F.coalesce(moved, F.lit(0.0))).otherwise(0.0)


def rules(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Filled rectangles of cell boxes (x, y, width, height, fill, borders, opened, closing): fills first (z 0), then
    borders centred on their edges (z 1). An edge that a page break made takes the opposite border where its own is
    absent."""
    top, bottom = F.col("borders.top"), F.col("borders.bottom")
    upper = F.when(F.col("opened"), F.coalesce(top, bottom)).otherwise(top)
    lower = F.when(F.col("closing"), bottom).otherwise(F.coalesce(bottom, top))
    box = lambda z, x, y, w, h, c: F.struct(F.lit(z).alias("z"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), c.alias("color"))

    def across(side: Column, y: Column) -> Column:
        return F.when(side["width"] > 0, box(1, F.col("x"), y - side["width"] / 2, F.col("width"), side["width"], side["color"]))

    def down(side: Column, x: Column) -> Column:
        return F.when(side["width"] > 0, box(1, x - side["width"] / 2, F.col("y"), side["width"], F.col("height"), side["color"]))

    fill = F.when(F.col("fill").isNotNull(), box(0, F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("fill")))
    all_ = F.array(
        fill, down(F.col("borders.left"), F.col("x")), down(F.col("borders.right"), F.col("x") + F.col("width")),
        across(upper, F.col("y")), across(lower, F.col("y") + F.col("height")),
    )
    return boxes.select(*keys, F.inline(F.array_compact(all_)))


def display_list(texts: DataFrame, rectangles: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, layer, line, piece, step, op, x, y, width, height, color, text, font): what to paint, in that order.

    The page's white, then rectangles, then each piece of text: its highlight, its glyphs, its underline and its strike
    as lines of a sixteenth of the font size, half a point at least. A piece with an ``image_id`` is painted as that
    image alone, named in ``text``; one that ``shown`` says cannot be painted is a pale box with its ``outline`` and its
    ``diagonal`` from the upper left, lines of half a point.
    """
    none = lambda t: F.lit(None).cast(t)
    white = pages.select(
        "doc_id", "page", F.lit(0).alias("layer"), F.lit(0).alias("line"), F.lit(0).alias("piece"), F.lit(0).alias("step"), F.lit("fill").alias("op"),
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "width", "height", F.lit("#ffffff").alias("color"), none("string").alias("text"), none("string").alias("font"),
    )
    ruled = rectangles.select(
        "doc_id", "page", F.lit(1).alias("layer"), F.lit(0).alias("line"), F.lit(0).alias("piece"), F.col("z").alias("step"), F.lit("fill").alias("op"),
        "x", "y", "width", "height", "color", none("string").alias("text"), none("string").alias("font"),
    )
    stroke = F.greatest(F.lit(0.5), F.col("font_size") / 16)
    font = F.col("font") if "font" in texts.columns else none("string")
    step = lambda k, op, y, h, color, text=None: F.struct(
        F.lit(k).alias("step"), F.lit(op).alias("op"), F.col("x").alias("x"), y.alias("y"), F.col("width").alias("width"), h.alias("height"),
        color.alias("color"), (none("string") if text is None else text).alias("text"), (font if op == "text" else none("string")).alias("font"),
    )
    base = F.col("baseline")
    image = F.col("image_id") if "image_id" in texts.columns else none("string")
    glyphs = image.isNull()
    lost = ~glyphs & ~F.coalesce(F.col("shown") if "shown" in texts.columns else F.lit(True), F.lit(False))
    box = lambda k, op, color: F.when(lost, step(k, op, F.col("y"), F.col("height"), F.lit(color), image))
    steps = F.array(
        F.when(glyphs & F.col("highlight").isNotNull(), step(0, "fill", F.col("y"), F.col("height"), F.col("highlight"))),
        F.when(glyphs, step(1, "text", base, F.col("height"), F.col("color"), F.col("text")))
        .when(~lost, step(1, "image", F.col("y"), F.col("height"), none("string"), image)),
        F.when(glyphs & F.col("underline"), step(2, "stroke", base + F.col("font_size") * 0.12, stroke, F.col("color"))),
        F.when(glyphs & F.col("strike"), step(3, "stroke", base - F.col("font_size") * 0.3, stroke, F.col("color"))),
        box(1, "fill", "#f1f3f5"), box(2, "outline", "#9aa3ac"), box(3, "diagonal", "#9aa3ac"),  # fixed values
    )
    inked = texts.select("doc_id", "page", F.lit(2).alias("layer"), "line", "piece", F.inline(F.array_compact(steps)))
    return white.unionByName(ruled).unionByName(inked)
