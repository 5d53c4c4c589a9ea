"""BPE encoding and decoding with content-defined chunk reuse.

1. *Chunks.* A rolling hash over 16 bytes picks chunk borders from the content alone, before any character, so equal
   passages of different documents fall into equal chunks wherever they stand, in any script.
2. *Table.* One pass counts chunk hashes (8 bytes each, combined before the shuffle). Those that occur twice or more
   are shared; a second pass fetches the text of each once, and it is encoded once, into a table of ids. The table's
   size is checked: beyond ``table_bytes`` of text the least frequent chunks stay out of it (a histogram by frequency
   says where), which costs work, not results. So it can be broadcast at any size of the corpus.
3. *Documents.* Ids of shared chunks are taken from the table; what lies between them is encoded in one call.
4. *Repair.* Joins fall anywhere, within words and runs of blanks. The pre-tokeniser's pattern looks ahead but never
   back, so where a word begins in two readings of a text they agree from there on. At each join the text is read
   again from the last place that is known to begin a word of the whole text, until a word begins where one does in
   the chunk on its own: an exact agreement, not a guess. Before it the text is encoded again, after it the chunk's
   ids hold, up to its last words, which what follows could change. A chunk without such a place is encoded with its
   neighbours.

Texts stay where they are read: no document is shuffled, so hot sources and groups of copies do not matter.

Defined results for odd input
-----------------------------
* null or empty text: no tokens, decoded text empty;
* texts without spaces: chunks as in any text; a word that spans several of them is encoded whole;
* texts that hold an added token's string go to the library whole;
* nulls elsewhere, ties, repeated rows: row by row; an empty table gives an empty table; input columns that have the
  name of a result in any case are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.text import column_of, restored, unnamed
from docframe.llm.tokenizing import BYTE_LEVEL_PATTERN, ByteBPE, byte_bpe, public_path
from docframe.runtime import ensure_importable, write_stage

#: A border for about 2 ** MASK_BITS bytes; chunks are no shorter than MIN_CHUNK and no longer than about MAX_CHUNK.
MASK_BITS, MIN_CHUNK, MAX_CHUNK = 8, 64, 1 << 13
#: Bytes of text that the broadcast table of shared chunks stands for, at most.
TABLE_BYTES = 16 << 20
#: Chunk hashes that a task counts before it hands them on.
HELD_CHUNKS = 1 << 17
#: A word is settled if so many characters stand after it: the longest look ahead of the pattern is two.
SETTLED = 3

_WORD = regex.compile(BYTE_LEVEL_PATTERN)
_SURE = re.compile(r"(?<=[!-~]) (?=[!-~])")  # a blank between two visible characters always begins a word
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def borders(data: bytes) -> list[int]:
    """Byte positions at which a new chunk begins, from the content alone; always at whole characters."""
    n = len(data) - 16
    if n < MIN_CHUNK:
        return []
    at = np.ndarray((n + 9,), dtype="<u8", buffer=data, strides=(1,))
    h = at[:n] * _MIX[0]
    h ^= at[8 : 8 + n] * _MIX[1]
    h *= _MIX[0]
    places = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 16
    b = np.frombuffer(data, dtype=np.uint8)
    places = places[(b[places] & 0xC0) != 0x80]
    cuts, last = [], 0
    for at_ in [*places.tolist(), len(data)]:
        while at_ - last > MAX_CHUNK:
            last += MAX_CHUNK
            while (data[last] & 0xC0) == 0x80:
                last += 1
            cuts.append(last)
        if at_ - last >= MIN_CHUNK and len(data) - at_ >= MIN_CHUNK:
            cuts.append(at_)
            last = at_
    return cuts


def chunks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    cuts = borders(data)
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])] if data else []


class Chunk:
    """A shared chunk: its ids, where its last settled word begins, and how many ids stand from there on."""

    __slots__ = ("ids", "settled", "after")

    def __init__(self, bpe: ByteBPE, text: str, ids: list[int]):
        starts = [m.start() for m in _WORD.finditer(text)]
        self.ids = ids
        self.settled = max((s for s in starts if s <= len(text) - SETTLED), default=0)
        self.after = sum(len(bpe.encode(text[a:b])) for a, b in zip(starts, [*starts[1:], len(text)]) if a >= self.settled)


class Encoder:
    """The library's ids of texts, with a table of chunks. Counts joins that needed repair and chunks that were reused."""

    def __init__(self, bpe: ByteBPE, table: dict[bytes, Chunk]):
        self.bpe, self.table = bpe, table
        self.repaired = self.reused = 0

    def _agree(self, text: str, real: int, start: int, end: int) -> tuple[int, int] | None:
        """The first place from ``start`` on where a word begins both in the text, of which ``real`` begins one, and in
        the chunk by itself; with the number of the chunk's ids before it. Not after a blank: a run of blanks is parted
        by what follows it, so what ends with one cannot be encoded apart."""
        whole = _WORD.finditer(text, real)
        alone = _WORD.finditer(text, start, end)
        a, b = next(whole, None), next(alone, None)
        dropped = 0
        while a is not None and b is not None:
            if a.start() == b.start() and not (a.start() and text[a.start() - 1].isspace()):
                return a.start(), dropped
            if a.start() < b.start():
                a = next(whole, None)
            else:
                dropped += len(self.bpe.encode(b[0]))
                b = next(alone, None)
        return None

    def encode(self, text: str) -> list[int]:
        bpe = self.bpe
        if not self.table or any(s in text for s in bpe.added):
            return bpe.encode(text)
        ids: list[int] = []
        real = start = 0  # all before ``real`` is done, and a word of the whole text begins there
        for part in chunks(text):
            body = self.table.get(part)
            size = len(part) if part.isascii() else len(part.decode("utf-8", "surrogatepass"))
            end = start + size
            if body is not None:
                known = real
                for m in _SURE.finditer(text, max(real, start - 256), start):
                    known = m.start()
                found = self._agree(text, known, start, end)
                if found is not None and found[0] < start + body.settled:
                    at, dropped = found
                    if at > real:
                        ids += bpe.encode(text[real:at])
                    ids += body.ids[dropped : len(body.ids) - body.after]
                    real = start + body.settled
                    self.repaired += at > start or known < start
                    self.reused += 1
            start = end
        if real < len(text):
            ids += bpe.encode(text[real:] if real else text)
        return ids


def shared_chunks(df: DataFrame, text: str, path: str, table_bytes: int = TABLE_BYTES) -> list[tuple[bytes, list[int]]]:
    """The table: (chunk, ids) of chunks that occur twice or more, each encoded once, within ``table_bytes`` of text."""
    spark = df.sparkSession
    texts = df.select(F.col(text).alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = list(seen.values())
            n, size = ([r[k] for r in rows] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["h", "n", "size"])

        for batch in batches:
            for t in batch.column(0):
                for c in chunks(t.as_py()):
                    h = xxhash.xxh3_64_intdigest(c) - (1 << 63)
                    row = seen.get(h)
                    if row is None:
                        seen[h] = [1, len(c)]
                    else:
                        row[0] += 1
            if len(seen) >= HELD_CHUNKS:
                yield out()
                seen.clear()
        if seen:
            yield out()

    counted = texts.mapInArrow(count, "h bigint, n bigint, size bigint").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    shared = write_stage(counted.where("n > 1"), "bpe-shared")
    # How much text the table would stand for, by frequency: 40 rows whatever the corpus.
    grade = F.least(F.floor(F.log2(F.col("n"))), F.lit(39)).cast("int")
    sizes = {r["g"]: r["size"] for r in shared.groupBy(grade.alias("g")).agg(F.sum("size").alias("size")).collect()}
    least, total = 40, 0
    for g in sorted(sizes, reverse=True):
        if total + sizes[g] > table_bytes:
            break
        least, total = g, total + sizes[g]
    if least == 40:
        return []
    wanted = shared.where(grade >= least).select("h").toPandas()["h"].to_numpy()  # table_bytes / MIN_CHUNK at most
    known = spark.sparkContext.broadcast(np.sort(wanted))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(known.value.tolist())
        for batch in batches:
            hs, cs = [], []
            for t in batch.column(0):
                for c in chunks(t.as_py()) if left else ():
                    h = xxhash.xxh3_64_intdigest(c) - (1 << 63)
                    if h in left:
                        left.remove(h)
                        hs.append(h)
                        cs.append(c)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(cs, pa.binary())], names=["h", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            ids = [bpe.encode(c.as_py().decode("utf-8", "surrogatepass")) for c in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "ids"])

    once = texts.mapInArrow(fetch, "h bigint, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk"))
    rows = once.select("chunk").mapInArrow(encode, "chunk binary, ids array<int>").toArrow()
    return list(zip(rows.column("chunk").to_pylist(), rows.column("ids").to_pylist()))


def with_bpe(
    df: DataFrame, text: str = "text", tokenizer: str | None = None, ids: bool = True, table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """Add token_ids (array of int), decoded (string), n_tokens, ids_sha256 and decoded_sha256.

    With ``ids=False`` only the last three are made, and no token leaves the worker.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    path = tokenizer or public_path("byte_bpe_50k.json")
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if ids:
        fields += ", token_ids array<int>, decoded string"
    names = [f.split()[0] for f in fields.split(", ")]
    rows, at = unnamed(df), column_of(df, text)
    table = spark.sparkContext.broadcast(shared_chunks(rows, at, path, table_bytes) if byte_bpe(path).by_words else [])

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path)
        entries = {c: Chunk(bpe, c.decode("utf-8", "surrogatepass"), own) for c, own in table.value}
        encoder, decimal = Encoder(bpe, entries), bpe.decimal
        for s in batches:
            made = []
            for t in s:
                got = encoder.encode(t)
                back = bpe.decode(got)
                row = (
                    len(got),
                    hashlib.sha256(",".join([decimal[i] for i in got]).encode()).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest(),
                )
                made.append(row + (got, back) if ids else row)
            yield pd.DataFrame(made, columns=names)

    got = rows.withColumn("_bpe", run(F.coalesce(F.col(at), F.lit(""))))
    return restored(got.select("*", "_bpe.*"), df.columns, names)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through byte_bpe_50k.json and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_bpe(docs, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
