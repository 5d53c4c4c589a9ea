"""A corpus of documents with a manifest: read it, and list what is wrong with it or with the files beside it.

Every rule is a filter; digests of files are computed where the files are read and joined to the manifest, so nothing
is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = """documents array<struct<
  id: string,
  producer: struct<application: string, version: string, generator: string, platform: string, packages: array<string>>,
  features: array<string>,
  artifacts: array<struct<path: string, kind: string, sha256: string, producedBy: string>>,
  fonts: array<struct<family: string, package: string, path: string, sha256: string>>,
  commands: array<string>,
  deltas: array<struct<id: string, classification: string, summary: string, measured: string, status: string, issue: bigint>>
>>"""
#: Fixed values of the manifest's fields.
KINDS = ("source", "document", "pdf", "text", "image")
REFERENCE_KINDS = ("pdf", "text", "image")
CLASSIFICATIONS = ("parse", "font", "layout", "paint")
STATUSES = ("open", "accepted")
ID, SHA256 = r"^[a-z0-9]+(-[a-z0-9.]+)*$", r"^[0-9a-f]{64}$"
FOLDER = "fixtures/"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the manifest, with its position ``pos``."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return whole.select(F.posexplode("documents").alias("pos", "d")).select("pos", "d.*")


def digests(files: DataFrame, root: str) -> DataFrame:
    """(path, sha256) of binary files, paths as seen from ``root``."""
    start = root.rstrip("/") + "/"
    return files.select(F.substring_index("path", start, -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _not_like(c: Column, pattern: str) -> Column:
    return ~F.coalesce(c.rlike(pattern), F.lit(False))


def _not_in(c: Column, known: tuple[str, ...]) -> Column:
    return ~F.coalesce(c.isin(*known), F.lit(False))


def _few(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) < 1


def _listed(df: DataFrame, rules: list[tuple[Column, str]], *keys: str) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))
    return df.select(*keys, F.explode(found).alias("problem"))


def problems(manifest: DataFrame, digests: DataFrame, suffix: str = ".rtf", folder: str = FOLDER + "real/") -> DataFrame:
    """(document, item, problem): an empty table means that manifest and files agree.

    ``item`` is the artifact, font or delta that is meant, or null for the document. An empty manifest is a problem of
    its own. Files ``folder``/*``suffix`` that no document lists are named with a null document.
    """
    none = F.lit(None).cast("string")
    doc = F.col("id").alias("document")
    kinds = F.transform("artifacts", lambda a: a["kind"])
    count = lambda keep: F.coalesce(F.size(F.filter(kinds, keep)), F.lit(0))
    own = _listed(
        manifest,
        [
            (_not_like(F.col("id"), ID), "bad-id"),
            *[(_blank(F.col(f"producer.{f}")), f"producer-{f}-missing") for f in ("application", "version", "generator", "platform")],
            (_few("producer.packages"), "no-packages"), (_few("features"), "no-features"), (_few("commands"), "no-commands"), (_few("fonts"), "no-fonts"),
            (count(lambda k: k == "document") != 1, "not-one-document"), (count(lambda k: k.isin(*REFERENCE_KINDS)) < 1, "no-reference"),
        ],
        doc, none.alias("item"),
    )
    twice = manifest.groupBy("id").count().where("count > 1").select(doc, none.alias("item"), F.lit("id-used-twice").alias("problem"))
    empty = manifest.agg(F.count("*").alias("n")).where("n = 0").select(none.alias("document"), none.alias("item"), F.lit("no-documents").alias("problem"))

    font = manifest.select(doc, F.explode("fonts").alias("x")).select("document", "x.*")
    fonts = _listed(
        font,
        [(_blank(F.col("family")) | _blank(F.col("package")) | _blank(F.col("path")), "font-provenance-missing"), (_not_like(F.col("sha256"), SHA256), "font-digest-missing")],
        "document", F.col("family").alias("item"),
    )

    art = manifest.select(doc, F.explode("artifacts").alias("x")).select("document", "x.*")
    actual = digests.select("path", F.col("sha256").alias("_actual"))
    held = art.join(actual, "path", "left")
    inside = F.coalesce(F.col("path").startswith(FOLDER), F.lit(False))
    artifacts = _listed(
        held,
        [
            (_not_in(F.col("kind"), KINDS), "unknown-kind"), (_blank(F.col("producedBy")), "produced-by-missing"), (~inside, "path-outside"),
            (inside & F.col("_actual").isNull(), "file-missing"), (inside & F.col("_actual").isNotNull() & ~F.col("_actual").eqNullSafe(F.col("sha256")), "digest-differs"),
        ],
        "document", F.col("path").alias("item"),
    )

    delta = manifest.select("pos", doc, F.explode("deltas").alias("x")).select("pos", "document", "x.*")
    deltas = _listed(
        delta,
        [
            (_not_like(F.col("id"), ID), "bad-delta-id"), (_not_in(F.col("classification"), CLASSIFICATIONS), "unknown-classification"),
            (_blank(F.col("summary")), "summary-missing"), (_blank(F.col("measured")), "measurement-missing"), (_not_in(F.col("status"), STATUSES), "unknown-status"),
        ],
        "document", F.col("id").alias("item"),
    )
    again = delta.groupBy("pos", "document", "id").count().where("count > 1").select("document", F.col("id").alias("item"), F.lit("delta-id-used-twice").alias("problem"))

    listed = art.where("kind = 'document'").select("path")
    stray = digests.where(F.col("path").startswith(folder) & F.col("path").endswith(suffix)).join(listed, "path", "left_anti")
    strays = stray.select(none.alias("document"), F.col("path").alias("item"), F.lit("not-in-manifest").alias("problem"))
    out = own
    for more in (twice, empty, fonts, artifacts, deltas, again, strays):
        out = out.unionByName(more)
    return out
