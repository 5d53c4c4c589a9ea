"""List numbering: counters by override and level as window sums, templates as array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.sources.rtf import paragraphs, prop

LEVELS = 9
#: Roman digits for ones, tens, hundreds and thousands.
ROMAN = (
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm"),
)


def roman(n: Column) -> Column:
    """Lower case for 1 to 3999, decimal digits otherwise."""
    digit = lambda k: F.get(F.array(*[F.lit(x) for x in ROMAN[k]]), (F.floor(n / 10**k) % 10).cast("int"))
    return F.when(n.between(1, 3999), F.concat(digit(3), digit(2), digit(1), digit(0))).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """Bijective base 26: a to z, aa, ab and so on; decimal digits below 1."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(
        acc["n"] > 0,
        F.struct(F.floor((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char((F.lit(97) + (acc["n"] - 1) % 26).cast("long")), acc["s"]).alias("s")),
    ).otherwise(acc)
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["s"])).otherwise(n.cast("string"))


def number(n: Column, nfc: Column) -> Column:
    return (
        F.when(nfc == 1, F.upper(roman(n))).when(nfc == 2, roman(n)).when(nfc == 3, F.upper(letters(n))).when(nfc == 4, letters(n))
        .when(nfc == 22, F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0")))
        .when(nfc.isin(23, 255), F.lit("")).otherwise(n.cast("string"))
    )


def levels(events: DataFrame) -> DataFrame:
    """One row for each list: its levels in order."""
    rows = events.where("etype = 'listlevel'").select(
        "doc_id", prop("list").alias("list"), F.struct(
            prop("level").cast("int").alias("level"), prop("startat").cast("int").alias("start"), prop("nfc").cast("int").alias("nfc"),
            prop("follow").cast("int").alias("follow"), F.col("text").alias("template"), F.col("numbers").alias("places"),
            (prop("li") / 20.0).alias("left_indent"), (prop("fi") / 20.0).alias("first_line_indent"),
        ).alias("lv"),
    )
    return rows.groupBy("doc_id", "list").agg(F.array_sort(F.collect_list("lv")).alias("levels"))


def overrides(events: DataFrame) -> DataFrame:
    return events.where("etype = 'listoverride'").select(
        "doc_id", prop("ls").cast("int").alias("ls"), prop("list").alias("list"), F.col("numbers").alias("starts")
    )


def unresolved(events: DataFrame) -> DataFrame:
    """Paragraphs whose override, or its list, does not exist."""
    known = overrides(events).join(levels(events), ["doc_id", "list"], "left_semi")
    return paragraphs(events).where("ls is not null").join(known, ["doc_id", "ls"], "left_anti").select("doc_id", "para_seq", "ls")


def markers(events: DataFrame) -> DataFrame:
    """(doc_id, para_seq, ls, level, marker, follow, left_indent, first_line_indent) of numbered paragraphs."""
    lists = overrides(events).join(levels(events), ["doc_id", "list"])
    p = paragraphs(events).where("ls is not null").join(lists, ["doc_id", "ls"])
    p = p.withColumn("lv", F.least(F.col("ilvl"), F.size("levels") - 1))
    own = Window.partitionBy("doc_id", "ls").orderBy("para_seq").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(LEVELS):  # how often a higher level has restarted level k, then how often k occurred since
        p = p.withColumn(f"_r{k}", F.sum((F.col("lv") < k).cast("int")).over(own))
    counters = []
    for k in range(LEVELS):
        since = Window.partitionBy("doc_id", "ls", f"_r{k}").orderBy("para_seq").rowsBetween(Window.unboundedPreceding, 0)
        p = p.withColumn(f"_n{k}", F.sum((F.col("lv") == k).cast("int")).over(since))
        start = F.coalesce(F.get("starts", F.lit(k)), F.get("levels", F.lit(k))["start"])
        counters.append(F.when(F.col(f"_n{k}") == 0, start).otherwise(start + F.col(f"_n{k}") - 1))
    p = p.withColumn("_counters", F.array(*counters)).withColumn("_level", F.get("levels", F.col("lv")))
    template, places = F.col("_level.template"), F.col("_level.places")

    def piece(i: Column) -> Column:
        at = F.ascii(F.substring(template, i, F.lit(1)))
        shown = number(F.get(F.col("_counters"), at), F.get(F.col("levels"), at)["nfc"])
        return F.when(F.array_contains(places, i), shown).otherwise(F.substring(template, i, F.lit(1)))

    text = F.when(F.length(template) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), piece), ""))
    follow = F.when(F.col("_level.follow") == 1, "space").when(F.col("_level.follow") == 2, "nothing").otherwise("tab")
    explicit = F.col("left_indent").isNotNull() | F.col("first_line_indent").isNotNull()
    indent = lambda c: F.coalesce(F.when(explicit, F.col(c)).otherwise(F.col(f"_level.{c}")), F.lit(0.0)).alias(c)
    return p.select(
        "doc_id", "para_seq", "ls", F.col("lv").alias("level"), F.when(F.length(text) > 0, text).alias("marker"), follow.alias("follow"),
        indent("left_indent"), indent("first_line_indent"),
    )
