"""RTF collections as DataFrames: binary files or any (doc_id, content) table to events, events to typed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.runtime import ensure_importable
from docframe.sources.scan import MAX_BYTES, scan

SCHEMA_VERSION = 2
STYLE = (
    "struct<font_id:int,half_points:int,bold:boolean,italic:boolean,underline:boolean,strike:boolean,color:int,"
    "highlight:int,hidden:boolean,shift:double>"
)
EVENTS = (
    "doc_id string, seq int, etype string, block int, cell int, item int, sub int, text string, plain string, shown string, "
    f"message string, image string, data binary, numbers array<int>, style {STYLE}, props map<string,bigint>"
)
_STYLE = pa.struct(
    [("font_id", pa.int32()), ("half_points", pa.int32()), *[(k, pa.bool_()) for k in ("bold", "italic", "underline", "strike")],
     ("color", pa.int32()), ("highlight", pa.int32()), ("hidden", pa.bool_()), ("shift", pa.float64())]
)
_ARROW = pa.schema(
    [("doc_id", pa.string()), ("seq", pa.int32()), ("etype", pa.string()),
     *[(k, pa.int32()) for k in ("block", "cell", "item", "sub")],
     *[(k, pa.string()) for k in ("text", "plain", "shown", "message", "image")], ("data", pa.binary()), ("numbers", pa.list_(pa.int32())), ("style", _STYLE),
     ("props", pa.map_(pa.string(), pa.int64()))]
)
#: What the scan says of a document over the size limit.
TOO_LARGE = [{"etype": "error", "text": "InputTooLarge", "props": {"offset": 0}}]
#: Events, and bytes of documents, sent in one Arrow batch at least.
BATCH, BATCH_BYTES = 4096, 4 << 20


def _within_limit(files: DataFrame) -> DataFrame:
    """(doc_id, content, too_large): the contents of files over the size limit are not read (pushed to the source)."""
    fits = files.where(F.col("length") <= MAX_BYTES).select(F.col("path").alias("doc_id"), "content", F.lit(False).alias("too_large"))
    rest = files.where(F.col("length") > MAX_BYTES)
    return fits.unionByName(rest.select(F.col("path").alias("doc_id"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("too_large")))


def read_files(spark: SparkSession, path: str, glob: str = "*.rtf") -> DataFrame:
    """(doc_id, content, too_large) of a folder; ``parse`` gives an error row to each file over the size limit."""
    return _within_limit(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def read_stream(spark: SparkSession, path: str, glob: str = "*.rtf") -> DataFrame:
    """The same, as a stream of arriving files; parsing is per document, so no state is kept."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _within_limit(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path))


class _Styles(dict):
    """Styles as Arrow scalars by identity: a document has few, and each is one object."""

    def __init__(self):
        super().__init__()
        self.held: list[dict] = []  # keeps the objects alive, so that their identities stay theirs

    def index(self, style: dict | None) -> int | None:
        if style is None:
            return None
        at = self.get(id(style))
        if at is None:
            at = self[id(style)] = len(self.held)
            self.held.append(style)
        return at


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Events as columns; a column that no event of the batch has is null throughout."""
    m, arrays = len(rows), []
    for field in _ARROW:
        values = [e.get(field.name) for e in rows]
        if field.name == "style" and any(values):
            known = _Styles()
            at = pa.array([known.index(v) for v in values], pa.int32())
            arrays.append(pa.array(known.held, _STYLE).take(at))
        elif field.name == "props":
            arrays.append(pa.array([None if v is None else list(v.items()) for v in values], field.type))
        else:
            arrays.append(pa.nulls(m, field.type) if not any(v is not None for v in values) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def parse(docs: DataFrame, doc_id: str = "doc_id", content: str = "content", want: set[str] | None = None) -> DataFrame:
    """Events of all documents. ``want`` names the event types to send from the workers; errors are always sent.

    Rows that a column ``too_large`` marks, as files over the size limit, have no content and give their error.
    Paragraphs come with their text if ``text`` is wanted, too, and documents with theirs for ``doctext``.
    """
    ensure_importable(docs.sparkSession)
    keep = None if want is None else frozenset(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for key, body, large in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                body = b"" if large else body.as_py() or b""
                for seq, e in enumerate(TOO_LARGE if large else scan(body, keep)):
                    rows.append(e | {"doc_id": key, "seq": seq})
                held += len(body)
                if len(rows) >= BATCH or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    large = F.col("too_large") & F.col(content).isNull() if "too_large" in docs.columns else F.lit(False)
    return docs.select(F.col(doc_id).cast("string"), F.col(content), large.alias("_large")).mapInArrow(run, EVENTS)


def prop(name: str) -> Column:
    return F.col("props")[name]


def points(name: str, default: float | None = None) -> Column:
    """A parameter in twips as points."""
    value = prop(name) / 20.0
    return value if default is None else F.coalesce(value, F.lit(default))


def documents(events: DataFrame) -> DataFrame:
    """One row for each document: page geometry, or the error that ended it."""
    rows = events.where(F.col("etype").isin("doc", "error"))
    explicit = prop("paperw").isNotNull() | prop("paperh").isNotNull()
    turned = prop("landscape").isNotNull() & (prop("landscape") != 0) & ~explicit
    w, h = points("paperw", 612.0), points("paperh", 792.0)
    page = F.struct(
        F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"),
        points("margl", 90.0).alias("marginLeft"), points("margr", 90.0).alias("marginRight"),
        points("margt", 72.0).alias("marginTop"), points("margb", 72.0).alias("marginBottom"),
    )
    ok = F.col("etype") == "doc"
    return rows.select(
        "doc_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.when(ok, page).alias("page"),
        F.when(ok, points("deftab", 36.0)).alias("default_tab"), F.when(~ok, F.col("text")).alias("error_code"),
        F.when(~ok, prop("offset")).alias("error_offset"),
    )


def fonts(events: DataFrame) -> DataFrame:
    return events.where("etype = 'font'").select(
        "doc_id", F.col("item").alias("font_seq"), prop("id").cast("int").alias("id"), F.col("text").alias("name"),
        prop("charset").cast("int").alias("charset"), prop("codepage").cast("int").alias("codepage"),
    )


def colors(events: DataFrame) -> DataFrame:
    """Null where a channel is missing: the automatic colour."""
    rgb = F.format_string("#%02x%02x%02x", prop("red"), prop("green"), prop("blue"))
    return events.where("etype = 'color'").select(
        "doc_id", F.col("item").alias("idx"), F.when(prop("red").isNotNull(), rgb).alias("rgb")
    )


def runs(events: DataFrame) -> DataFrame:
    return events.where("etype = 'run'").select(
        "doc_id", "seq", "block", "cell", F.col("item").alias("para_in_cell"), F.col("sub").alias("run_seq"),
        F.when(F.col("image").isNull(), "text").otherwise("image").alias("kind"), "text", "style",
        (F.col("style.half_points") / 2.0).alias("font_size"), F.col("image").alias("image_id"),
    )


def paragraphs(events: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each paragraph; ``texts`` adds its text, for events parsed with it."""
    align = F.when(prop("qc").isNotNull(), "center").when(prop("qr").isNotNull(), "right").when(prop("qj").isNotNull(), "justify")
    sl, mult = F.coalesce(prop("sl"), F.lit(0)), F.coalesce(prop("slmult"), F.lit(0)) != 0
    spacing = (
        F.when(sl == 0, F.struct(F.lit("auto").alias("kind"), F.lit(None).cast("double").alias("value")))
        .when(mult, F.struct(F.lit("multiple").alias("kind"), (sl / 240.0).alias("value")))
        .when(sl < 0, F.struct(F.lit("exact").alias("kind"), (-sl / 20.0).alias("value")))
        .otherwise(F.struct(F.lit("atLeast").alias("kind"), (sl / 20.0).alias("value")))
    )
    return events.where("etype = 'para'").select(
        "doc_id", F.col("seq").alias("para_seq"), "block", "cell", F.col("item").alias("para_in_cell"),
        F.coalesce(align, F.lit("left")).alias("align"), points("li").alias("left_indent"), points("ri", 0.0).alias("right_indent"),
        points("fi").alias("first_line_indent"), points("sb", 0.0).alias("space_before"), points("sa", 0.0).alias("space_after"),
        spacing.alias("line_spacing"), F.coalesce(prop("pagebb") != 0, F.lit(False)).alias("page_break_before"),
        F.col("style").alias("mark_style"), prop("ls").cast("int").alias("ls"),
        F.coalesce(prop("ilvl"), F.lit(0)).cast("int").alias("ilvl"), F.col("text").alias("list_text"),
        *([F.col("plain").alias("text")] if texts else []),
    )


def _text(keep_hidden: bool) -> Column:
    return F.col("plain") if keep_hidden else F.coalesce("shown", "plain")


def paragraph_texts(events: DataFrame, keep_hidden: bool = True) -> DataFrame:
    """(doc_id, block, cell, para_in_cell, para_seq, text): the text of each paragraph, as the scan joined it."""
    return events.where("etype = 'para'").select(
        "doc_id", F.col("seq").alias("para_seq"), "block", "cell", F.col("item").alias("para_in_cell"), _text(keep_hidden).alias("text")
    )


def document_texts(events: DataFrame, keep_hidden: bool = True) -> DataFrame:
    """(doc_id, text): paragraphs in order, one on each line; for events parsed with ``doctext``. No shuffle."""
    return events.where("etype = 'doc'").select("doc_id", _text(keep_hidden).alias("text"))


def paragraph_runs(events: DataFrame, keep_hidden: bool = True) -> DataFrame:
    """(doc_id, block, para_in_cell, para_seq, p, r): each paragraph as a struct with the array of its runs in order.

    Paragraphs and runs meet in one shuffle; the runs of a paragraph are bounded by the scan's limit on text.
    """
    p, r = paragraphs(events), runs(events)
    if not keep_hidden:
        r = r.where("kind = 'image' or not coalesce(style.hidden, false)")
    at = F.coalesce("cell", F.lit(-1)).alias("_cell")
    head = F.struct(*[c for c in p.columns if c not in ("doc_id", "block", "para_in_cell")])
    part = F.struct("run_seq", F.coalesce("text", F.lit("")).alias("text"), "style", "image_id")
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("c")).schema["c"].dataType)
    both = p.select("doc_id", "block", at, "para_in_cell", head.alias("p"), none(r, part).alias("r")).unionByName(
        r.select("doc_id", "block", at, "para_in_cell", none(p, head).alias("p"), part.alias("r"))
    )
    whole = both.groupBy("doc_id", "block", "_cell", "para_in_cell").agg(
        F.max_by("p", F.when(F.col("p").isNotNull(), 1)).alias("p"),
        F.array_sort(F.collect_list("r"), lambda a, b: a["run_seq"] - b["run_seq"]).alias("r"),
    )
    return whole.where("p is not null").select("doc_id", "block", "para_in_cell", F.col("p.para_seq").alias("para_seq"), "p", "r")


#: Codes of what lookups do not find and of boundaries that are dropped.
RESOLVED = ("unresolved-list-reference", "invalid-table-definition", "invalid-table-merge")


def diagnostics(events: DataFrame) -> DataFrame:
    stage = F.when(F.col("text").isin(*RESOLVED), "resolve").otherwise("parse")
    return events.where("etype = 'diag'").select(
        "doc_id", F.col("seq").alias("diag_seq"), stage.alias("stage"), F.col("text").alias("code"), "message",
        prop("offset").alias("offset"),
    )


def images(events: DataFrame) -> DataFrame:
    """Pictures as authored: width and height in points are the goal in twips, else (PNG and JPEG, no goal given) the
    declared pixels at 96 for each inch, scaled in per cent; null where neither is positive."""
    raster = F.col("text").isin("png", "jpeg")
    side = lambda goal, px, scale: (
        F.when(prop(goal).isNotNull(), F.when(prop(goal) > 0, prop(goal) / 20.0))
        .otherwise(F.when(raster & (prop(px) > 0), prop(px) * 72.0 / 96.0))
        * F.greatest(F.coalesce(prop(scale), F.lit(100)), F.lit(0)) / 100.0
    )
    return events.where("etype = 'image'").select(
        "doc_id", F.col("item").alias("image_seq"), F.col("image").alias("image_id"), F.col("text").alias("format"), "data",
        side("picwgoal", "picw", "picscalex").alias("width"), side("pichgoal", "pich", "picscaley").alias("height"),
    )
