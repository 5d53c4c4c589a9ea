"""Document fingerprints: a canonical exact digest, on SQL functions only.

A text is normalised (Unicode NFKC by the JVM's ICU library through the SQL function ``reflect``), case-folded and
its white space folded; two seeded xxhash64 values of the result make a 128-bit bucket. Inside buckets of two or more
rows the canonical bytes are compared: the least and the greatest string of a bucket must be the same, which a
map-side aggregation answers without gathering a group. A bucket that fails (a hash collision) gives fingerprints
that also carry a SHA-256 of the canonical text.

Only rows in buckets of two or more are read again for the comparison. Their keys are joined by broadcast up to a
checked number, by a shuffle beyond it. ``reflect`` needs the ICU library (``com.ibm.icu``) that Spark ships.

Defined results for odd input
-----------------------------
* null and empty texts, and texts of white space alone, share one fingerprint;
* repeated rows and ties have equal fingerprints; nulls in other columns do not matter;
* whole texts are digested; an empty table gives an empty table; an input column ``fingerprint``, in any case, is
  replaced;
* in the order of documents (:func:`edited_fingerprints`) rows without an id stand last, and rows that repeat an id are
  ordered by their text: every row has one that follows it, a single one itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.text import column_of, restored, unnamed
from docframe.runtime import write_stage

#: Bucket keys (16 bytes each) that may be broadcast.
BROADCAST_KEYS = 500_000
_WHITE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def canonical(text: Column) -> Column:
    """NFKC, case folded (upper, then lower; sharp s as ss), runs of white space as one blank, none at the ends."""
    nfkc = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True)
    )
    folded = F.replace(F.lower(F.upper(nfkc)), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(folded, _WHITE, " "))


def wide_hash(canon: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds."""
    return [F.xxhash64(F.lit(seed), canon) for seed in (0x51ED27, 0xA0761D)]


def _hex(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def collided_buckets(keys: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Buckets (_a, _b) whose rows differ in canonical bytes.

    ``keys`` has a row (_a, _b) for each text; ``fetch`` gives (_a, _b, _canon) of the texts in given buckets.
    """
    shared = keys.groupBy("_a", "_b").count().where("count > 1").select("_a", "_b")
    shared = write_stage(shared, "fingerprint-buckets")
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    extremes = fetch(shared).groupBy("_a", "_b").agg(F.min("_canon").alias("lo"), F.max("_canon").alias("hi"))
    return write_stage(extremes.where("lo <> hi").select("_a", "_b"), "fingerprint-collisions")


def _join_collisions(df: DataFrame, bad: DataFrame, n_bad: int, a: str, b: str, flag: str) -> DataFrame:
    if n_bad == 0:
        return df.withColumn(flag, F.lit(False))
    right = bad.select(F.col("_a").alias(a), F.col("_b").alias(b), F.lit(True).alias(flag))
    right = F.broadcast(right) if n_bad <= BROADCAST_KEYS else right
    return df.join(right, [a, b], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``fingerprint``: 32 hex digits, and a SHA-256 after a colon where a bucket collided."""
    a, b = wide_hash(F.col("_canon"))
    hashed = unnamed(df).withColumn("_canon", canonical(F.col(column_of(df, text)))).withColumns({"_a": a, "_b": b})
    bad = collided_buckets(
        hashed.select("_a", "_b"),
        lambda shared: hashed.select("_a", "_b", "_canon").join(shared, ["_a", "_b"], "left_semi"),
    )
    got = _join_collisions(hashed, bad, bad.count(), "_a", "_b", "_bad")
    exact = F.concat(_hex(F.col("_a"), F.col("_b")), F.lit(":"), F.sha2("_canon", 256))
    found = F.when(F.col("_bad"), exact).otherwise(_hex(F.col("_a"), F.col("_b")))
    return restored(got.withColumn("fingerprint", found), df.columns, ["fingerprint"])


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) in descending order of doc_id, the last followed by the first.

    Ids alone are dealt by range and written with the number of their range; the step between ranges is a join of
    one row for each range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    ids = docs.select("doc_id").repartitionByRange(n, F.desc("doc_id"))
    ids = write_stage(ids.withColumn("_part", F.spark_partition_id()), "fingerprint-order")
    heads = ids.groupBy("_part").agg(F.max("doc_id").alias("_head"))  # one row for each range
    heads = heads.select(
        "_part",
        F.coalesce(
            F.lead("_head").over(Window.partitionBy(F.lit(0)).orderBy("_part")),
            F.first("_head").over(Window.partitionBy(F.lit(0)).orderBy("_part")),
        ).alias("_next_head"),
    )
    inside = F.lead("doc_id").over(Window.partitionBy("_part").orderBy(F.desc("doc_id")))
    return (
        ids.withColumn("_next", inside).join(F.broadcast(heads), "_part")
        .select("doc_id", F.coalesce("_next", "_next_head").alias("next_id"))
    )


def edited_text(text: Column, n_chars: Column, following: Column) -> Column:
    """The last half replaced by as many first code points of the following text."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - half), F.substring(following, F.lit(1), half))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not odd.take(1):
        return _edited(docs)
    # Numbers in the same order for rows whose ids cannot tell them apart.
    ordered = docs.orderBy(F.desc_nulls_last("doc_id"), "text").withColumn("_key", -F.monotonically_increasing_id())
    ordered = write_stage(ordered, "fingerprint-rows")
    got = _edited(ordered.select(F.col("_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_key")
    return ordered.select("_key", "doc_id").join(got, "_key").drop("_key")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, each with its edited text and its neighbour."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents with ids of their own, none null."""
    # lineage of the order: each document also learns whose text it continues, and how much of it is wanted
    sizes = docs.select("doc_id", F.length("text").alias("n_chars"))
    order = next_ids(docs)
    wanted = order.join(sizes, "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_before"), F.floor(F.col("n_chars") / 2).alias("_want")
    )
    # ``reflect`` counts as nondeterministic, so only a column of its own is computed once for both hashes.
    a, b = wide_hash(F.col("_canon"))
    hashed = docs.withColumn("_canon", canonical(F.col("text"))).withColumns({"_a": a, "_b": b}).drop("_canon")
    full = hashed.join(wanted, "doc_id")
    given = full.select(
        F.col("_before").alias("doc_id"), F.substring(F.col("text"), F.lit(1), F.col("_want").cast("int")).alias("_given"),
        F.col("_a").alias("_na"), F.col("_b").alias("_nb"), F.col("doc_id").alias("next_id"),
    )
    both = full.join(given, "doc_id").withColumn("n_chars", F.length("text"))
    both = both.withColumn("_edited", edited_text(F.col("text"), F.col("n_chars"), F.col("_given")))
    digests = write_stage(
        both.withColumn("_canon", canonical(F.col("_edited"))).select(
            "doc_id", "next_id", F.col("n_chars").cast("long").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"), "_a", "_b", "_na", "_nb", a.alias("_ea"), b.alias("_eb"),
        ),
        "fingerprint-digests",
    )
    keys = digests.select("_a", "_b").unionByName(digests.select(F.col("_ea").alias("_a"), F.col("_eb").alias("_b")))

    def fetch(shared: DataFrame) -> DataFrame:
        own = digests.select("doc_id", "_a", "_b").join(shared, ["_a", "_b"], "left_semi")
        other = digests.select("doc_id", "next_id", F.col("_ea").alias("_a"), F.col("_eb").alias("_b")).join(
            shared, ["_a", "_b"], "left_semi"
        )
        own, other = write_stage(own, "fingerprint-own"), write_stage(other, "fingerprint-edited")
        small = lambda d: F.broadcast(d) if d.count() <= BROADCAST_KEYS else d
        plain = docs.join(small(own), "doc_id").select("_a", "_b", canonical(F.col("text")).alias("_canon"))
        nexts = other.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_for"))
        heads = docs.join(small(nexts), "doc_id").select(F.col("_for").alias("doc_id"), F.col("text").alias("_next"))
        edited = docs.join(small(other), "doc_id").join(heads, "doc_id")
        return plain.unionByName(
            edited.select(
                "_a", "_b", canonical(edited_text(F.col("text"), F.length("text"), F.col("_next"))).alias("_canon")
            )
        )

    bad = collided_buckets(keys, fetch)
    n_bad = bad.count()
    got = _join_collisions(digests, bad, n_bad, "_a", "_b", "_bad")
    got = _join_collisions(got, bad, n_bad, "_ea", "_eb", "_edited_bad")
    got = got.withColumns({"_f": _hex(F.col("_a"), F.col("_b")), "_e": _hex(F.col("_ea"), F.col("_eb")), "_n": _hex(F.col("_na"), F.col("_nb"))})
    if n_bad:  # a collided bucket: tell its texts apart by their canonical SHA-256
        exact = exact_digests(docs, got)
        got = got.join(exact, "doc_id", "left").withColumns(
            {"_f": F.coalesce("_xf", "_f"), "_e": F.coalesce("_xe", "_e"), "_n": F.coalesce("_xn", "_n")}
        )
    same = lambda x, y: F.when(F.col(x) == F.col(y), 1.0).otherwise(0.0)
    return got.select(
        "doc_id", "n_chars", "edited_sha256", F.col("_f").alias("fingerprint"), F.col("_e").alias("edited_fingerprint"),
        same("_f", "_e").alias("near_edited"), same("_f", "_n").alias("near_next"),
    )


def exact_digests(docs: DataFrame, got: DataFrame) -> DataFrame:
    """Fingerprints of rows in collided buckets, with SHA-256 (a path that only a 128-bit collision reaches)."""
    rows = got.where(F.col("_bad") | F.col("_edited_bad")).select("doc_id", "next_id", "_f", "_e", "_n", "_bad", "_edited_bad")
    texts = docs.join(rows, "doc_id")
    nexts = docs.join(rows.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_for")), "doc_id")
    texts = texts.join(nexts.select(F.col("_for").alias("doc_id"), F.col("text").alias("_next")), "doc_id")
    sha = lambda c: F.concat(F.lit(":"), F.sha2(canonical(c), 256))
    edited = edited_text(F.col("text"), F.length("text"), F.col("_next"))
    return texts.select(
        "doc_id",
        F.when(F.col("_bad"), F.concat("_f", sha(F.col("text")))).alias("_xf"),
        F.when(F.col("_edited_bad"), F.concat("_e", sha(edited))).alias("_xe"),
        F.when(F.col("_bad") & (F.col("_f") == F.col("_n")), F.concat("_n", sha(F.col("_next")))).alias("_xn"),
    )
