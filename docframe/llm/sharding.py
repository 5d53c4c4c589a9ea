"""Sharding by a two-pass external shuffle, on SQL functions only.

Pass one scatters records by seeded hashes: highest-random-weight hashing of the key picks the shard (one more
shard takes rows only into itself), a second hash picks one of a fixed number of cells of the shard. Cells are
measured (one row for each, combined before the shuffle) and neighbours joined to buckets of about ``bucket_bytes``,
so a hot shard gets more buckets, not larger ones, and a bucket fits in memory. A cell that alone is larger, as one of
many equal rows is, is dealt into buckets of its own by the place of its rows in the input. Pass two shuffles each
bucket as an array with the built-in ``shuffle`` (Fisher-Yates) and unfolds it; buckets of a shard follow each other,
so slots are gapless.

The scatter is the only exchange of texts; each bucket is a partition of its own (dealt by number, not by hash), so the
random numbers of its shuffle follow from the seed and the bucket alone, whatever the session's number of partitions.
A bucket's rows are sorted by hash before they are shuffled, so a task that runs again gives the same order.

Defined results for odd input
-----------------------------
* null text: no bytes, size 16; null key: hashed as null, always the same shard;
* repeated rows and ties: the same shard, each with a slot of its own;
* very long texts: moved whole; a bucket holds at least one row, so one text beyond the bucket size is still one row;
* an empty table gives an empty table; all input columns stay, those named as a result in any case are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.text import column_of, crc32_text, restored, unnamed
from docframe.runtime import write_stage

SHARDS = 40
#: Bytes of a bucket, which one task holds several times over, and cells of a shard that buckets are made of.
BUCKET_BYTES, CELLS = 32 << 20, 1 << 12
ROW_BYTES = 16
#: Cell tables of up to so many rows (40 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_CELLS = 400_000


def _weights(key: Column, n: int, seed: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(seed), key, F.lit(k)) for k in range(n)])


def shard_of(key: Column, n: int, seed: int = 0) -> Column:
    """The shard with the highest weight; the lower number at a tie."""
    w = _weights(key, n, seed)
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")


def _dealt(cells: DataFrame, bucket_bytes: int) -> DataFrame:
    """Cells with the number of their first bucket in the table, and how many buckets they are dealt into."""
    before = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("_bytes") > 2 * bucket_bytes
    # Bytes of the cells before, but of the large ones, which have buckets of their own.
    small = F.coalesce(F.sum(F.when(~large, F.col("_bytes"))).over(before), F.lit(0))
    cells = cells.withColumns({"_group": F.floor(small / bucket_bytes), "_parts": F.when(large, F.ceil(F.col("_bytes") / bucket_bytes)).otherwise(1).cast("int")})
    groups = cells.groupBy("_shard", F.when(F.col("_parts") > 1, F.col("_cell")).otherwise(-1).alias("_own"), "_group").agg(F.max("_parts").alias("_wide"))
    # One row for each bucket or large cell, at most one for each cell: numbered in one task.
    every = Window.partitionBy(F.lit(0)).orderBy("_shard", "_group", "_own").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_pid", F.coalesce(F.sum("_wide").over(every), F.lit(0)).cast("int"))
    own = F.when(F.col("_parts") > 1, F.col("_cell")).otherwise(-1)
    return cells.withColumn("_own", own).join(groups, ["_shard", "_own", "_group"]).select("_shard", "_cell", "_n", "_pid", "_parts")


def shard_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows with shard, bucket (numbered over all shards), slot and size, in shuffled order within each bucket."""
    made = ["shard", "bucket", "slot", "size"]
    rows, key, text = unnamed(df), column_of(df, key), column_of(df, text)
    own = rows.columns
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    placed = rows.withColumns(
        {
            "_shard": shard_of(F.col(key), shards, seed),
            "_cell": F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), F.lit(CELLS)).cast("int"),
        }
    )
    measured = placed.groupBy("_shard", "_cell").agg(F.count("*").alias("_n"), F.sum(size).alias("_bytes"))
    cells = write_stage(_dealt(write_stage(measured, "shard-cells"), bucket_bytes), "shard-buckets")
    n_cells, n_buckets, split = cells.agg(F.count("*"), F.max(F.col("_pid") + F.col("_parts")), F.max("_parts")).first()
    if not n_cells:
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(made, ("int", "int", "long", "long"))]
        return restored(rows.where(F.lit(False)).select("*", *none), df.columns, made)
    if n_cells <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")).cast("int")
    dealt = placed.join(cells.drop("_n"), ["_shard", "_cell"])
    dealt = dealt.withColumn("_pid", F.col("_pid") + part if split > 1 else F.col("_pid"))
    if split > 1:  # how the rows of large cells fell is only known by counting them
        counts = dealt.groupBy("_shard", "_pid").agg(F.count("*").alias("_n"))
    else:
        counts = cells.groupBy("_shard", "_pid").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    offsets = write_stage(offsets, "shard-offsets")  # one row for each bucket
    if n_buckets <= BROADCAST_CELLS:
        offsets = F.broadcast(offsets)
    order = F.xxhash64(F.lit(seed + 2), F.col(key), F.col(text))
    buckets = (
        dealt.repartitionById(n_buckets, F.col("_pid"))
        .withColumn("_order", order).sortWithinPartitions("_pid", "_order")
        .groupBy("_pid").agg(F.first("_shard").alias("_shard"), F.collect_list(F.struct(*own)).alias("_rows"))
    )
    shuffled = buckets.select("_pid", "_shard", F.shuffle("_rows", seed + 3).alias("_rows")).join(offsets, "_pid")
    shuffled = shuffled.select("_pid", "_shard", "_first", F.posexplode("_rows").alias("_at", "_row")).select(
        "_row.*", F.col("_shard").alias("shard"), F.col("_pid").alias("bucket"), (F.col("_first") + F.col("_at")).cast("long").alias("slot")
    )
    return restored(shuffled.withColumn("size", size), df.columns, made)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shard folders: a bucket is a partition, so it becomes a file of its own, with its rows by slot."""
    sharded.write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` into 40 shards by the law ``key``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", "size", crc32_text(F.col("text")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
