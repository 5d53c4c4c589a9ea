"""Queries over the driver's tables: rows are written as RTF, read by the engine, and answered from what it read.

The SQL beside each answers the same question from the tables, without RTF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators import cells as C
from docframe.operators import document as D
from docframe.operators import layout as Y
from docframe.operators import lists as L
from docframe.operators import pictures as P
from docframe.operators.fonts import FIXED, Face
from docframe.plans.model import document_model, model_json, models_of_json, parts_of_model
from docframe.runtime import ensure_importable, table, write_stage
from docframe.sources import rtf as R
from docframe.sources.encode import rtf_document, rtf_escape
from docframe.sources.sinks import page_svg

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(df: DataFrame, key: str, body: Column, want: set[str] | None = None, keep: bool = False) -> DataFrame:
    """Events of documents written with this body; ``keep`` writes them for queries that read them several times."""
    ensure_importable(df.sparkSession)
    events = R.parse(df.select(F.col(key).cast("string").alias("doc_id"), rtf_document(body).alias("content")), want=want)
    return write_stage(events, "query-events") if keep else events


def _text_events(spark: SparkSession, d: str, want: set[str]) -> DataFrame:
    docs = table(spark, d, "documents")
    return _events(docs, "doc_id", F.concat(rtf_escape("text"), F.lit("\\par")), want)


#: What a document's whole text needs, and what those of its paragraphs need.
WHOLE, TEXTS = {"doc", "doctext"}, {"para", "text"}


@query("SELECT doc_id, text FROM documents")
def q01_text_round_trip(spark, d):
    return R.document_texts(_text_events(spark, d, WHOLE)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_paragraphs, CAST(sum(length(text)) OVER (PARTITION BY doc_id) - len(string_split(text, chr(10))) + 1 AS BIGINT) AS n_chars FROM documents")
def q02_paragraph_counts(spark, d):
    p = R.paragraph_texts(_text_events(spark, d, TEXTS))
    return p.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars")
    )


@query("SELECT event_type, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS n_bold, CAST(count(*) FILTER (WHERE event_id % 2 = 0) AS BIGINT) AS n_italic, CAST(count(*) AS BIGINT) AS n_runs FROM events GROUP BY event_type")
def q04_run_styles(spark, d):
    e = table(spark, d, "events")
    body = F.concat(F.lit("{"), F.when(F.col("value") > 50, "\\b").otherwise("\\b0"), F.when(F.col("event_id") % 2 == 0, "\\i ").otherwise("\\i0 "), F.col("event_type"), F.lit("}\\par"))
    r = R.runs(_events(e, "event_id", body, {"run"}))
    return r.groupBy(F.col("text").alias("event_type")).agg(
        F.count(F.when(F.col("style.bold"), 1)).alias("n_bold"), F.count(F.when(F.col("style.italic"), 1)).alias("n_italic"), F.count("*").alias("n_runs")
    )


@query("SELECT p_partkey, printf('#%02x%02x%02x', p_size % 256, (p_partkey * 7) % 256, 128) AS rgb, CAST(p_size % 40 + 1 AS DOUBLE) / 2 AS font_size FROM part")
def q05_colour_lookup(spark, d):
    p = table(spark, d, "part")
    body = F.concat(
        F.lit("{\\colortbl;\\red1\\green1\\blue1;\\red"), (F.col("p_size") % 256).cast("string"), F.lit("\\green"), ((F.col("p_partkey") * 7) % 256).cast("string"),
        F.lit("\\blue128;}\\cf2\\fs"), (F.col("p_size") % 40 + 1).cast("string"), F.lit(" x\\par"),
    )
    e = _events(p, "p_partkey", body, {"run", "color"}, keep=True)
    r = R.runs(e).select("doc_id", F.col("style.color").alias("idx"), "font_size")
    return r.join(R.colors(e), ["doc_id", "idx"]).select(F.col("doc_id").cast("bigint").alias("p_partkey"), "rgb", "font_size")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'Final ' || c_mktsegment AS name, CAST(1251 AS INTEGER) AS codepage, CAST(0 AS INTEGER) AS font_seq FROM customer")
def q06_font_upsert(spark, d):
    c = table(spark, d, "customer")
    body = F.concat(F.lit("{\\fonttbl{\\f3\\fcharset0 First;}{\\f4 Other;}{\\f3\\fcharset204 Final "), F.col("c_mktsegment"), F.lit(";}}x\\par"))
    return R.fonts(_events(c, "c_custkey", body, {"font"})).where("id = 3").select(F.col("doc_id").cast("bigint").alias("c_custkey"), "name", "codepage", "font_seq")


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS text FROM supplier")
def q07_hidden_text(spark, d):
    s = table(spark, d, "supplier")
    body = F.concat(F.when(F.col("s_acctbal") > 0, "\\v0 ").otherwise("\\v "), F.col("s_name"), F.lit("\\par"))
    return R.document_texts(_events(s, "s_suppkey", body, WHOLE), keep_hidden=False).select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "text")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority || o_orderstatus AS text FROM orders")
def q08_ignorable_destinations(spark, d):
    o = table(spark, d, "orders")
    body = F.concat(F.lit("{\\info{\\title nope}}{\\*\\unknownthing x{\\fonttbl y}}"), F.col("o_orderpriority"), F.lit("{\\footnote no}{\\*\\bkmkstart b}{\\stylesheet{\\s1 no;}}"), F.col("o_orderstatus"), F.lit("\\par"))
    return R.document_texts(_events(o, "o_orderkey", body, WHOLE)).select(F.col("doc_id").cast("bigint").alias("o_orderkey"), "text")


@query("SELECT page_id, 'see ' || url AS text FROM pages")
def q09_fields(spark, d):
    p = table(spark, d, "pages").withColumn("u", rtf_escape("url"))
    body = F.concat(F.lit("see {\\field{\\*\\fldinst HYPERLINK \"hidden\"}{\\fldrslt "), F.col("u"), F.lit("}}\\par"))
    return R.document_texts(_events(p, "page_id", body, WHOLE)).select(F.col("doc_id").cast("bigint").alias("page_id"), "text")


@query("SELECT item_id, text FROM benchmark")
def q10_unicode_alternative(spark, d):
    b = table(spark, d, "benchmark").withColumn("u", rtf_escape("text"))
    body = F.concat(F.lit("{\\upr{ansi copy}{\\*\\ud "), F.col("u"), F.lit("}}\\par"))
    return R.document_texts(_events(b, "item_id", body, WHOLE)).select(F.col("doc_id").cast("bigint").alias("item_id"), "text")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q11_table_cells(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit("\\trowd\\cellx1440\\cellx2880\\intbl "), F.col("n_name"), F.lit("\\cell "), F.col("r_name"), F.lit("\\cell\\row"))
    c = C.cells(_events(n, "n_nationkey", body, keep=True))
    return c.groupBy(F.col("doc_id").cast("bigint").alias("n_nationkey")).agg(
        F.max(F.when(F.col("cell_idx") == 0, F.col("text"))).alias("n_name"), F.max(F.when(F.col("cell_idx") == 1, F.col("text"))).alias("r_name")
    )


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 2 AS n_cells, CAST(144 + n_nationkey AS DOUBLE) AS first_right, n_name || chr(10) || 'more' AS first_text FROM nation")
def q12_merged_cells(spark, d):
    n = table(spark, d, "nation")
    body = F.concat(
        F.lit("\\trowd\\clmgf\\cellx1440\\clmrg\\cellx"), (2880 + 20 * F.col("n_nationkey")).cast("string"), F.lit("\\cellx2880\\cellx8640\\intbl "),
        F.col("n_name"), F.lit("\\cell\\cell more\\cell tail\\cell\\row"),
    )
    c = C.cells(_events(n, "n_nationkey", body, keep=True))
    return c.groupBy(F.col("doc_id").cast("bigint").alias("n_nationkey")).agg(
        F.count("*").cast("int").alias("n_cells"), F.max(F.when(F.col("cell_idx") == 0, F.col("right"))).alias("first_right"),
        F.max(F.when(F.col("cell_idx") == 0, F.col("text"))).alias("first_text"),
    )


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 1.0 / 20 ELSE 5.0 END AS pad_left, least(greatest(p_size * 1.0 / 20, 0.25), 12.0) AS border_width, CASE WHEN p_size % 3 = 0 THEN 'exact' ELSE 'atLeast' END AS height_kind, p_size * 1.0 / 20 AS height FROM part")
def q13_cell_fallbacks(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    body = F.concat(
        F.lit("\\trowd\\trgaph100\\trrh"), F.when(F.col("p_size") % 3 == 0, "-").otherwise(""), size, F.lit("\\trbrdrl\\brdrs\\brdrw"), size,
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\\clpadfl3\\clpadl"), size)).otherwise("\\clpadfl2\\clpadl7"), F.lit("\\cellx1440\\intbl x\\cell\\row"),
    )
    e = _events(p, "p_partkey", body, keep=True)
    return C.cells(e).join(C.rows(e), ["doc_id", "block"]).select(
        F.col("doc_id").cast("bigint").alias("p_partkey"), F.col("padding.left").alias("pad_left"), F.col("borders.left.width").alias("border_width"), "height_kind", "height"
    )


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, printf('#%02x%02x%02x', CAST(floor(230 + (p_size % 200 - 230) * (p_partkey * 37 % 10001) / 10000.0 + 0.5) AS INTEGER), CAST(floor(230 + (84 - 230) * (p_partkey * 37 % 10001) / 10000.0 + 0.5) AS INTEGER), CAST(floor(230 + (147 - 230) * (p_partkey * 37 % 10001) / 10000.0 + 0.5) AS INTEGER)) AS fill FROM part")
def q14_shading(spark, d):
    p = table(spark, d, "part")
    body = F.concat(
        F.lit("{\\colortbl;\\red230\\green230\\blue230;\\red"), (F.col("p_size") % 200).cast("string"), F.lit("\\green84\\blue147;}\\trowd\\clcbpat1\\clcfpat2\\clshdng"),
        (F.col("p_partkey") * 37 % 10001).cast("string"), F.lit("\\cellx1440\\intbl x\\cell\\row"),
    )
    e = _events(p, "p_partkey", body, keep=True)
    col = lambda name: R.colors(e).select("doc_id", F.col("idx").alias(name), F.col("rgb").alias(name + "_rgb"))
    c = C.cells(e).select("doc_id", F.col("shading.background").cast("int").alias("back"), F.col("shading.foreground").cast("int").alias("fore"), "shading.intensity")
    c = c.join(col("back"), ["doc_id", "back"], "left").join(col("fore"), ["doc_id", "fore"], "left")
    return c.select(F.col("doc_id").cast("bigint").alias("p_partkey"), C.blend(F.col("back_rgb"), F.col("fore_rgb"), F.col("intensity")).alias("fill"))


_LISTS = (
    "{\\*\\listtable{\\list{\\listlevel\\levelnfc0\\levelstartat1{\\leveltext\\'02\\'00.;}{\\levelnumbers\\'01;}}"
    "{\\listlevel\\levelnfc4\\levelstartat1{\\leveltext\\'04\\'00.\\'01);}{\\levelnumbers\\'01\\'03;}}\\listid7}}"
    "{\\*\\listoverridetable{\\listoverride\\listid7\\listoverridecount0\\ls1}}"
)


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN CAST(tops AS VARCHAR) || '.' || chr(CAST(96 + row_number() OVER (PARTITION BY conv_id, tops0, role = 'assistant' ORDER BY turn) AS INTEGER)) || ')' ELSE CAST(tops0 AS VARCHAR) || '.' END AS marker
FROM (SELECT *, greatest(tops0, 1) AS tops FROM (SELECT conv_id, turn, role, CAST(count(*) FILTER (WHERE role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS tops0 FROM conversations))""")
def q15_list_markers(spark, d):
    c = table(spark, d, "conversations")
    item = F.concat(F.lit("\\pard\\ls1\\ilvl"), F.when(F.col("role") == "assistant", "1 ").otherwise("0 "), F.col("turn").cast("string"), F.lit("\\par"))
    one = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda r: r["x"]), "").alias("body"))
    e = _events(one, "conv_id", F.concat(F.lit(_LISTS), F.col("body")), keep=True)
    return L.markers(e).join(R.paragraph_texts(e), ["doc_id", "para_seq"]).select(
        F.col("doc_id").cast("bigint").alias("conv_id"), F.col("text").cast("bigint").alias("turn"), "marker"
    )


_ROMAN_SQL = "repeat('i', CAST(p_size AS INTEGER))"
for _a, _b in (("i" * 50, "l"), ("i" * 40, "xl"), ("i" * 10, "x"), ("i" * 9, "ix"), ("i" * 5, "v"), ("iiii", "iv")):
    _ROMAN_SQL = f"replace({_ROMAN_SQL}, '{_a}', '{_b}')"


@query(f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {_ROMAN_SQL} AS roman, CASE WHEN p_size > 26 THEN chr(CAST(96 + (p_size - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(97 + (p_size - 1) % 26 AS INTEGER)) AS letters FROM part")
def q16_number_formats(spark, d):
    return table(spark, d, "part").select("p_partkey", L.roman(F.col("p_size")).alias("roman"), L.letters(F.col("p_size")).alias("letters"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_orderstatus")
def q17_order_tables(spark, d):
    o = table(spark, d, "orders")
    body = F.concat(F.lit("\\trowd\\cellx1440\\cellx2880\\intbl "), F.col("o_orderstatus"), F.lit("\\cell "), F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"), F.lit("\\cell\\row"))
    t = R.paragraph_texts(_events(o, "o_orderkey", body, TEXTS)).where("cell is not null")
    row = t.groupBy("doc_id").agg(F.max(F.when(F.col("cell") == 0, F.col("text"))).alias("o_orderstatus"), F.max(F.when(F.col("cell") == 1, F.col("text"))).alias("c"))
    return row.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum(F.col("c").cast("bigint")).alias("cents"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey % 4 + 1 AS BIGINT) AS n_breaks FROM orders")
def q18_page_breaks(spark, d):
    o = table(spark, d, "orders")
    body = F.concat(F.expr("repeat('a\\\\page ', cast(o_custkey % 4 as int))"), F.lit("b\\par\\sectd\\sbknone c\\sect\\sectd d\\sect e\\par"))
    e = _events(o, "o_orderkey", body, {"pagebreak"})
    return e.where("etype = 'pagebreak'").groupBy(F.col("doc_id").cast("bigint").alias("o_orderkey")).agg(F.count("*").alias("n_breaks"))


@query("SELECT l_orderkey, CAST(line AS BIGINT) AS line, CAST(floor(line / 3) AS INTEGER) AS page, CAST((line % 3) * 12 AS DOUBLE) AS y FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))")
def q19_exact_pagination(spark, d):
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").count()
    e = _events(n, "l_orderkey", F.expr("repeat('x\\\\par ', cast(count as int))"), {"para"})
    lines = R.paragraphs(e).select("doc_id", "para_seq", F.lit(12.0).alias("height"), F.lit(0.0).alias("before"))
    got = Y.paginate(lines, 36.0, ["para_seq"])
    from pyspark.sql import Window

    line = (F.row_number().over(Window.partitionBy("doc_id").orderBy("para_seq")) - 1).cast("bigint")
    return got.select(F.col("doc_id").cast("bigint").alias("l_orderkey"), line.alias("line"), "page", "y")


@query(r"""SELECT doc_id, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda line: list_reduce(
  list_prepend({'n': 1, 'used': 0, 'blank': false}, list_transform(regexp_extract_all(line, '[ \t]+|[^ \t]+'),
    lambda t: {'n': 0, 'used': length_grapheme(t), 'blank': t[1] = ' ' OR t[1] = chr(9)})),
  lambda a, t: {'n': a.n + CASE WHEN NOT t.blank AND a.used > 0 AND a.used + t.used > 90 THEN 1 ELSE 0 END
      + CASE WHEN NOT t.blank AND t.used > 90 THEN (t.used - 1) // 90 ELSE 0 END,
    'used': CASE WHEN t.blank THEN a.used + t.used WHEN t.used > 90 THEN t.used - 90 * ((t.used - 1) // 90)
      WHEN a.used > 0 AND a.used + t.used > 90 THEN t.used ELSE a.used + t.used END, 'blank': false}).n)) AS BIGINT) AS n_lines FROM documents""")
def q21_line_wrapping(spark, d):
    p = R.paragraph_texts(_text_events(spark, d, TEXTS))
    return Y.break_lines(p, 450.0).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sum(F.size("lines")).alias("n_lines"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 10.0 / 20 * 50 / 100 WHEN p_size % 3 = 1 THEN p_size * 72.0 / 96 * 50 / 100 ELSE 16 * 72.0 / 96 END AS width, 12 * 72.0 / 96 AS height, 16 AS pixel_width, 12 AS pixel_height FROM part")
def q22_image_size(spark, d):
    p = table(spark, d, "part")
    png = "89504e470d0a1a0a0000000d49484452000000100000000c08020000"
    size = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("\\picwgoal"), (F.col("p_size") * 10).cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("\\picw"), F.col("p_size").cast("string"))).otherwise("")
    body = F.concat(F.lit("{\\pict\\pngblip\\picscalex50"), size, F.lit(" " + png + "}\\par"))
    i = P.with_display_size(P.with_pixels(R.images(_events(p, "p_partkey", body, {"image"}))))
    return i.select(F.col("doc_id").cast("bigint").alias("p_partkey"), F.col("display_width").alias("width"), F.col("display_height").alias("height"), "pixel_width", "pixel_height")


def _bitmap(red: Column, green: Column) -> Column:
    """Hex of a WMF with one blit of two pixels: (red, green, 7) and black."""
    dib = "28000000" + "02000000" + "01000000" + "0100" + "1800" + "00" * 24
    return F.concat(F.lit("00" * 18 + "26000000" + "430f" + "00" * 22 + dib + "07"), F.format_string("%02x%02x", green, red), F.lit("00" * 5))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 2 AS pixel_width, 1 AS pixel_height, printf('%02x%02x07ff000000ff', CAST(p_partkey % 256 AS INTEGER), CAST(p_size AS INTEGER)) AS rgba FROM part")
def q23_metafile_bitmap(spark, d):
    p = table(spark, d, "part")
    body = F.concat(F.lit("{\\pict\\wmetafile8 "), _bitmap((F.col("p_partkey") % 256).cast("int"), F.col("p_size").cast("int")), F.lit("}\\par"))
    i = P.with_pixels(R.images(_events(p, "p_partkey", body, {"image"})))
    return i.select(F.col("doc_id").cast("bigint").alias("p_partkey"), "pixel_width", "pixel_height", F.lower(F.hex("raster")).alias("rgba"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(ceil(CAST(612 + p_size AS DOUBLE) * 150 / 72 - 1e-9) AS BIGINT) AS pixels FROM part")
def q24_pixel_size(spark, d):
    return table(spark, d, "part").select("p_partkey", Y.pixel_size((F.col("p_size") + 612).cast("double"), ppi=150.0).alias("pixels"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n_codes FROM (SELECT event_id, event_type, unnest(['unsupported-control', 'unknown-destination']) FROM events) GROUP BY event_type")
def q25_diagnostics(spark, d):
    e = table(spark, d, "events").withColumn("row", F.monotonically_increasing_id())  # an event_id may be null or repeated
    body = F.concat(F.lit("\\nosuchword\\nosuchword{\\*\\nosuchgroup a}{\\*\\nosuchgroup b}"), F.coalesce(F.concat("event_type", F.lit("\\par")), F.lit("")))
    ev = _events(e, "row", body, {"diag"} | TEXTS, keep=True)
    # Grouped, not joined: the compressed size of a stage is small, so a join would broadcast its millions of rows.
    none = F.lit(None).cast("string")
    codes = R.diagnostics(ev).select("doc_id", "code", none.alias("text"))
    both = codes.unionByName(R.paragraph_texts(ev).select("doc_id", none.alias("code"), "text"))
    one = both.groupBy("doc_id").agg(F.max("text").alias("event_type"), F.count("code").alias("n"))
    return one.where("n > 0").groupBy("event_type").agg(F.sum("n").alias("n_codes"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'UnterminatedGroup' WHEN 1 THEN 'UnexpectedGroupEnd' WHEN 2 THEN 'TruncatedBinary' WHEN 3 THEN 'InvalidHeader' ELSE NULL END AS error_code FROM customer")
def q26_malformed(spark, d):
    k = F.col("c_custkey") % 5
    body = F.when(k == 0, "{\\rtf1 a").when(k == 1, "{\\rtf1 a}}").when(k == 2, "{\\rtf1{\\pict\\bin9 abc}}").when(k == 3, "{\\rtf1 a}b").otherwise("{\\rtf1 a}")
    docs = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), body.cast("binary").alias("content"))
    return R.documents(R.parse(docs, want={"doc"})).select(F.col("doc_id").cast("bigint").alias("c_custkey"), "error_code")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n_unresolved FROM conversations WHERE role <> 'assistant' GROUP BY conv_id")
def q28_unresolved_lists(spark, d):
    c = table(spark, d, "conversations")
    item = F.concat(F.lit("\\pard\\ls"), F.when(F.col("role") == "assistant", "1").otherwise("9"), F.lit(" x\\par"))
    one = c.groupBy("conv_id").agg(F.array_join(F.collect_list(item), "").alias("body"))
    e = _events(one, "conv_id", F.concat(F.lit(_LISTS), F.col("body")), keep=True)
    return L.unresolved(e).groupBy(F.col("doc_id").cast("bigint").alias("conv_id")).agg(F.count("*").alias("n_unresolved"))


@query("SELECT quality, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_paragraphs FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def q30_labels(spark, d):
    p = R.paragraphs(_text_events(spark, d, {"para"})).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))
    return p.join(table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_paragraphs"))


@query("SELECT doc_id, text FROM documents")
def q03_code_page_bytes(spark, d):
    t = table(spark, d, "documents").withColumn("b", rtf_escape("text", "cp1252"))
    return R.document_texts(_events(t, "doc_id", F.concat("b", F.lit("\\par")), WHOLE)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'parse' AS stage, CASE WHEN p_size % 2 = 0 THEN 'approximated-metafile-bitmap' ELSE 'unsupported-vector-image' END AS code FROM part
UNION ALL SELECT CAST(p_partkey AS BIGINT), 'resources', 'unsupported-image-format' FROM part WHERE p_size % 2 <> 0""")
def q27_picture_diagnostics(spark, d):
    p = table(spark, d, "part")
    data = F.when(F.col("p_size") % 2 == 0, _bitmap(F.lit(1), F.col("p_size").cast("int"))).otherwise("00" * 24)
    i = P.with_pixels(R.images(_events(p, "p_partkey", F.concat(F.lit("{\\pict\\wmetafile8 "), data, F.lit("}\\par")), {"image"})))
    return P.picture_diagnostics(i).select(F.col("doc_id").cast("bigint").alias("p_partkey"), "stage", "code")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name AS text, CASE c_custkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN (450 - length(c_name) * 5) / 2.0 ELSE 450 - length(c_name) * 5.0 END AS x FROM customer")
def q31_alignment(spark, d):
    c = table(spark, d, "customer")
    align = F.when(F.col("c_custkey") % 3 == 0, "\\ql ").when(F.col("c_custkey") % 3 == 1, "\\qc ").otherwise("\\qr ")
    e = _events(c, "c_custkey", F.concat(F.lit("\\pard"), align, "c_name", F.lit("\\par")), TEXTS)
    p = R.paragraphs(e, texts=True)
    return Y.fragments(Y.lay_lines(p, 450.0), ["doc_id"]).select(F.col("doc_id").cast("bigint").alias("c_custkey"), "text", "x")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(k AS INTEGER) AS image_seq, CASE WHEN k >= 2 THEN 'pixel-budget' END AS refused FROM part, range(3) t(k) WHERE k <= p_size % 3")
def q32_image_admission(spark, d):
    p = table(spark, d, "part")
    png = "89504e470d0a1a0a0000000d49484452" + f"{5000:08x}{3000:08x}" + "08020000"
    body = F.concat(F.expr(f"repeat('{{\\\\pict\\\\pngblip {png}}}', cast(p_size % 3 + 1 as int))"), F.lit("\\par"))
    i = P.admission(P.with_pixels(R.images(_events(p, "p_partkey", body, {"image"}))))
    return i.select(F.col("doc_id").cast("bigint").alias("p_partkey"), "image_seq", "refused")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(page AS INTEGER) AS page, 36.0 * page AS cut_from, 12.0 * least(3 * page + 3, p_size) AS cut_to, 3 * page + 3 >= p_size AS closing FROM part, range(100) t(page) WHERE 3 * page < p_size")
def q33_split_rows(spark, d):
    p = table(spark, d, "part")
    rows = p.select(
        F.col("p_partkey").alias("doc_id"), F.lit(0).alias("block"), (F.col("p_size") * 12.0).alias("height"),
        F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), lambda k: k * 12.0).alias("stops"),
    )
    return Y.split_rows(rows, 40.0, ["block"]).select(F.col("doc_id").cast("bigint").alias("p_partkey"), "page", "cut_from", "cut_to", "closing")


@query("SELECT op, CAST(layer AS INTEGER) AS layer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'fill' AS op, 0 AS layer, 1 AS n FROM supplier UNION ALL SELECT 'fill', 1, 2 FROM supplier UNION ALL SELECT 'fill', 2, 1 FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'text', 2, 1 FROM supplier UNION ALL SELECT 'stroke', 2, 1 FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1, 2")
def q29_display_list(spark, d):
    s = table(spark, d, "supplier")
    texts = s.select(
        F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("line"), F.lit(0).alias("piece"), F.col("s_name").alias("text"),
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(50.0).alias("width"), F.lit(10.0).alias("height"), F.lit(8.0).alias("baseline"),
        F.lit(12.0).alias("font_size"), F.lit("#000000").alias("color"), F.when(F.col("s_acctbal") > 0, "#ffff00").alias("highlight"),
        (F.col("s_suppkey") % 2 == 0).alias("underline"), F.lit(False).alias("strike"),
    )
    side = F.struct(F.lit(0.5).alias("width"), F.lit("#000000").alias("color"))
    none = F.lit(None).cast("struct<width:double,color:string>")
    boxes = s.select(
        F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(50.0).alias("width"), F.lit(10.0).alias("height"),
        F.lit("#eeeeee").alias("fill"), F.struct(side.alias("top"), none.alias("left"), none.alias("bottom"), none.alias("right")).alias("borders"),
        F.lit(False).alias("opened"), F.lit(True).alias("closing"),
    )
    pages = boxes.select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return Y.display_list(texts, Y.rules(boxes, ["doc_id", "page"]), pages).groupBy("op", "layer").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(ceil((c_custkey % 17 + 1) / 4.0) AS BIGINT) AS n_pages, CAST(c_custkey % 17 + 1 AS BIGINT) AS n_lines, 20.0 + 10.0 * (c_custkey % 17 % 4) AS last_y FROM customer")
def q34_document_pages(spark, d):
    c = table(spark, d, "customer")
    lines = F.expr("repeat('x\\\\par ', cast(c_custkey % 17 + 1 as int))")
    e = _events(c, "c_custkey", F.concat(F.lit("\\paperw4000\\paperh1600\\margl400\\margr400\\margt400\\margb400 "), lines))
    lines = D.lay_out(e, default=FIXED).lines
    return lines.groupBy(F.col("doc_id").cast("bigint").alias("c_custkey")).agg(
        (F.max("page") + 1).cast("bigint").alias("n_pages"), F.count("*").alias("n_lines"), F.max_by("y", F.struct("page", "line")).alias("last_y")
    )


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, 72.0 + (s_suppkey % 20 + 11) * 0.9 AS baseline, 90.0 + 5 * length(s_name) AS x, (length(s_name) + 1) * 0.6 * (s_suppkey % 20 + 11) AS width FROM supplier")
def q35_faces(spark, d):
    s = table(spark, d, "supplier")
    size = ((F.col("s_suppkey") % 20 + 11) * 2).cast("string")
    body = F.concat(F.lit("{\\fonttbl{\\f0 Fixed;}{\\f1 Wide;}}\\paperw20000\\f0\\fs20 "), "s_name", F.lit("\\f1\\fs"), size, F.lit(" "), "s_name", F.lit("x\\par"))
    laid = D.lay_out(_events(s, "s_suppkey", body), faces={"wide": Face(0.6, 0.9, 0.3)}, default=FIXED)
    return laid.fragments.where("piece = 1").select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "baseline", "x", "width")


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name AS text, CAST(2 AS INTEGER) AS n_blocks, s_suppkey % 2 = 0 AS bold FROM supplier")
def q36_document_model(spark, d):
    s = table(spark, d, "supplier")
    body = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "\\b ").otherwise("\\b0 "), "s_name", F.lit("\\par\\page"))
    m = document_model(write_stage(_events(s, "s_suppkey", body), "events"))
    first = F.col("model.blocks")[0]["runs"][0]
    return m.select(F.col("doc_id").cast("bigint").alias("s_suppkey"), first["text"].alias("text"), F.size("model.blocks").alias("n_blocks"), first["style"]["bold"].alias("bold"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, CAST(10 + CAST(max(l_quantity) AS INTEGER) % 30 AS DOUBLE) AS h FROM lineitem GROUP BY l_orderkey, l_linenumber),
p AS (SELECT l_orderkey, k, 0 AS page, CAST(0 AS DOUBLE) AS y, h FROM l WHERE k = 1 UNION ALL
SELECT l.l_orderkey, l.k, CASE WHEN p.y + p.h + l.h > 60.001 THEN p.page + 1 ELSE p.page END, CASE WHEN p.y + p.h + l.h > 60.001 THEN 0.0 ELSE p.y + p.h END, l.h FROM p JOIN l ON l.l_orderkey = p.l_orderkey AND l.k = p.k + 1)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(k - 1 AS BIGINT) AS line, CAST(page AS INTEGER) AS page, y FROM p""")
def q20_variable_pagination(spark, d):
    own = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity").cast("int") % 30 + 10).alias("h"))
    para = F.concat(F.lit("\\pard\\sl-"), (F.col("h") * 20).cast("string"), F.lit(" x\\par "))
    one = own.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", para.alias("x")))), lambda r: r["x"]), "").alias("body"))
    p = R.paragraphs(_events(one, "l_orderkey", F.col("body"), {"para"}))
    lines = p.select("doc_id", "para_seq", F.col("line_spacing.value").alias("height"), F.lit(0.0).alias("before"))
    return Y.paginate(lines, 60.0, ["para_seq"]).select(F.col("doc_id").cast("bigint").alias("l_orderkey"), F.col("para_seq").cast("bigint").alias("line"), "page", "y")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(k AS BIGINT) AS item, CASE WHEN k < 2 THEN '•' ELSE CAST(c_custkey % 7 + k - 1 AS VARCHAR) || ')' END AS marker FROM customer, range(4) t(k)")
def q37_bullets(spark, d):
    c = table(spark, d, "customer")
    body = F.concat(
        F.lit("{\\*\\listtable{\\list{\\listlevel\\levelnfc23{\\leveltext\\'01\\u8226 ?;}{\\levelnumbers;}}\\listid1}{\\list{\\listlevel\\levelnfc0\\levelstartat"), (F.col("c_custkey") % 7 + 1).cast("string"),
        F.lit("{\\leveltext\\'02\\'00);}{\\levelnumbers\\'01;}}\\listid2}}{\\*\\listoverridetable{\\listoverride\\listid1\\ls1}{\\listoverride\\listid2\\ls2}}\\pard\\ls1 0\\par 1\\par\\ls2 2\\par 3\\par"),
    )
    e = _events(c, "c_custkey", body, keep=True)
    return L.markers(e).join(R.paragraph_texts(e), ["doc_id", "para_seq"]).select(
        F.col("doc_id").cast("bigint").alias("c_custkey"), F.col("text").cast("bigint").alias("item"), "marker"
    )


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, t.text AS text, CASE WHEN t.text = 'a' THEN 12.0 ELSE (p_size + 100) / 2.0 END AS font_size, t.text = 'c' AS bold FROM part, (VALUES ('a'), ('b'), ('c')) t(text)")
def q38_default_styles(spark, d):
    p = table(spark, d, "part")
    body = F.concat(F.lit("{\\*\\defchp\\fs"), (F.col("p_size") + 100).cast("string"), F.lit("}{\\*\\defpap\\li40}a\\plain b{\\b c}\\par"))
    r = R.runs(_events(p, "p_partkey", body, {"run"}))
    return r.select(F.col("doc_id").cast("bigint").alias("p_partkey"), "text", "font_size", F.col("style.bold").alias("bold"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey % 3 + 1 AS BIGINT) AS n_breaks FROM orders")
def q39_scoped_sections(spark, d):
    o = table(spark, d, "orders")
    body = F.concat(F.lit("{\\sbknone a\\sect b\\sect}c\\sect"), F.expr("repeat(' d\\\\sect', cast(o_custkey % 3 as int))"), F.lit(" e\\par"))
    e = _events(o, "o_orderkey", body, {"pagebreak"})
    return e.where("etype = 'pagebreak'").groupBy(F.col("doc_id").cast("bigint").alias("o_orderkey")).agg(F.count("*").alias("n_breaks"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(ceil((c_custkey % 17 + 1) / 4.0) AS BIGINT) AS n_pages, CAST(c_custkey % 17 + 1 AS BIGINT) AS n_lines, 20.0 + 10.0 * (c_custkey % 17 % 4) AS last_y FROM customer")
def q40_stored_model_pages(spark, d):
    c = table(spark, d, "customer")
    lines = F.expr("repeat('x\\\\par ', cast(c_custkey % 17 + 1 as int))")
    e = _events(c, "c_custkey", F.concat(F.lit("\\paperw4000\\paperh1600\\margl400\\margr400\\margt400\\margb400 "), lines), keep=True)
    stored = write_stage(models_of_json(model_json(e)), "models")
    lines = D.lay_out_parts(parts_of_model(stored), default=FIXED).lines
    return lines.groupBy(F.col("doc_id").cast("bigint").alias("c_custkey")).agg(
        (F.max("page") + 1).cast("bigint").alias("n_pages"), F.count("*").alias("n_lines"), F.max_by("y", F.struct("page", "line")).alias("last_y")
    )


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, op, CAST(step AS INTEGER) AS step, 20.0 AS x, 20.0 AS y, (s_suppkey % 30 + 1) * 2.0 AS width, 20.0 AS height, color FROM supplier, (VALUES ('fill', 1, '#f1f3f5'), ('outline', 2, '#9aa3ac'), ('diagonal', 3, '#9aa3ac')) t(op, step, color)")
def q41_lost_pictures(spark, d):
    s = table(spark, d, "supplier")
    wide = ((F.col("s_suppkey") % 30 + 1) * 40).cast("string")
    body = F.concat(F.lit("\\paperw4000\\paperh1600\\margl400\\margr400\\margt400\\margb400{\\pict\\emfblip\\pichgoal400\\picwgoal"), wide, F.lit(" 00}\\par"))
    paint = D.lay_out(_events(s, "s_suppkey", body), default=FIXED).display_list.where("layer = 2")
    return paint.select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "op", "step", "x", "y", "width", "height", "color")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(0 AS INTEGER) AS page, '<svg xmlns="http://www.w3.org/2000/svg" width="1000pt" height="80pt" viewBox="0 0 1000 80">' || chr(10)
|| '<rect x="0" y="0" width="1000" height="80" fill="#ffffff"/>' || chr(10) || '<text x="20" y="28" fill="#000000" style="font: 10px serif, serif" xml:space="preserve">' || s_suppkey || '&lt;&amp;&gt;</text>' || chr(10) || '</svg>' AS svg FROM supplier""")
def q42_page_svg(spark, d):
    s = table(spark, d, "supplier")
    body = F.concat(F.lit("\\paperw20000\\paperh1600\\margl400\\margr400\\margt400\\margb400\\fs20 "), F.col("s_suppkey").cast("string"), F.lit("<&>\\par"))
    laid = D.lay_out(_events(s, "s_suppkey", body), default=FIXED)
    return page_svg(laid).select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "page", "svg")
