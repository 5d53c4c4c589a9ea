"""Packing by order-preserving dynamic programming.

Documents of one input partition form a stream in their order. A window is a run of at most ``window`` tokens of
the stream; its cost is its padding (none at a power of two), a penalty for where it ends (document end: none,
sentence end: little, elsewhere: more) and a constant for each window. The cheapest sequence of cuts follows from

    best[j] = end_penalty[j] + each + min(window - pos[j] + min(best[i] + pos[i]), min(best[i] at a power of two))

where i runs over the cuts within one window before j. The inner minimum slides, so a monotone queue gives it in
constant time for each cut. Cuts fall at document ends and sentence ends; only inside a stretch that is longer than the
window and has neither may they fall anywhere. A sentence ends after a line, after a full stop of a script without
blanks, and after other closing marks where a blank or the document's end follows.

A stream is solved in segments that end at a document's end after ``segment`` tokens, so memory is bounded by a
segment plus one document. There is no shuffle: groups and hot sources do not matter.

Defined results for odd input
-----------------------------
* null or empty text: one piece that holds the closing id alone;
* very long texts: cut over as many windows as needed, whole;
* null ids, ties and repeated rows: each row is packed as a document of its own, with its id passed through;
* an empty table gives an empty table; other columns of the input do not appear in the pieces.

Sequence ids hold the partition in their high bits: a task that runs again gives the same ids.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.tokenizing import byte_bpe, public_path
from docframe.runtime import ensure_importable

WINDOW = 1024
SEGMENT = 1 << 18
CLOSING_ID = 0
#: Costs in padding tokens.
SENTENCE_PENALTY, CUT_PENALTY, EACH = 4.0, 16.0, 48.0


def choose_cuts(
    n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW, grid: int | None = None,
    sentence_penalty: float = SENTENCE_PENALTY, cut_penalty: float = CUT_PENALTY, each: float = EACH,
) -> np.ndarray:
    """Ends of the windows over a stream of ``n`` tokens (the last is ``n``). ``grid`` allows more cuts, at its multiples."""
    pos = np.union1d(np.append(sentence_ends, 0), np.append(doc_ends, n)).astype(np.int64)
    if grid:
        pos = np.union1d(pos, np.arange(0, n, min(grid, window)))
    long = np.flatnonzero(np.diff(pos) > window)
    if len(long):
        pos = np.union1d(pos, np.concatenate([np.arange(pos[k], pos[k + 1]) for k in long]))
    penalty = np.full(len(pos), cut_penalty)
    penalty[np.searchsorted(pos, sentence_ends)] = sentence_penalty
    penalty[np.searchsorted(pos, np.append(doc_ends, n))] = 0.0
    penalty += each
    # Which cuts lie a power of two before each cut.
    exact: dict[int, list[int]] = {}
    power = 1
    while power <= window:
        at = np.searchsorted(pos, pos - power)
        for j in np.flatnonzero((pos >= power) & (pos[np.minimum(at, len(pos) - 1)] == pos - power)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    p, fine = pos.tolist(), penalty.tolist()
    best, came = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(p)):
        here = p[j]
        first = here - window
        while queue[0][1] < first:
            queue.popleft()
        least, _, i = queue[0]
        cost = least + window - here
        for k in exact.get(j, ()):
            if best[k] < cost:
                cost, i = best[k], k
        cost += fine[j]
        best[j], came[j] = cost, i
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = came[j]
    return np.array(cuts[::-1], dtype=np.int64)


def _schema(with_ids: bool) -> T.StructType:
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    out = T.StructType([T.StructField(f, T.LongType()) for f in fields])
    return out.add("token_ids", T.ArrayType(T.IntegerType())) if with_ids else out


def sentence_ends(stream: np.ndarray, doc_ends: np.ndarray, marks: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Places in a stream of ids after which a sentence is over, by what its tokens end and begin with."""
    always, closing, blank = marks
    follows = np.append(blank[stream[1:]], True)
    follows[doc_ends - 1] = True
    follows[doc_ends - 2] = True  # before the closing id
    return np.flatnonzero(always[stream] | closing[stream] & follows) + 1


def _solve(docs: list, ids: list[np.ndarray], marks: tuple, first: int, with_ids: bool, options: dict):
    """Pieces of one segment as columns, and the number of sequences."""
    stream = np.concatenate(ids)
    sizes = np.array([len(x) for x in ids])
    doc_ends = np.cumsum(sizes)
    doc_starts = doc_ends - sizes
    sentences = sentence_ends(stream, doc_ends, marks)
    cuts = choose_cuts(len(stream), doc_ends, sentences, **options)
    seq_starts = np.append(0, cuts[:-1])
    begins = np.union1d(doc_starts, seq_starts)
    stops = np.append(begins[1:], len(stream))
    doc = np.searchsorted(doc_ends, begins, side="right")
    seq = np.searchsorted(cuts, begins, side="right")
    view = memoryview(stream.astype("<u4")).cast("B")
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist())]
    columns = {
        "doc": [docs[k] for k in doc.tolist()], "start": begins - doc_starts[doc], "length": stops - begins,
        "ids_crc32": np.array(crc, dtype=np.int64), "doc_tokens": sizes[doc], "sequence_id": first + seq,
        "offset": begins - seq_starts[seq], "sequence_tokens": (cuts - seq_starts)[seq],
    }
    if with_ids:
        columns["token_ids"] = [stream[a:b].astype(np.int32) for a, b in zip(begins, stops)]
    return columns, len(cuts)


def pack_documents(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = True,
    segment: int = SEGMENT, **options,
) -> DataFrame:
    """Pieces of all documents: which tokens of which document stand where in which sequence.

    ``token_ids`` holds the piece's ids unless ``with_ids`` is false. ``options`` go to :func:`choose_cuts`.
    """
    ensure_importable(df.sparkSession)
    path = tokenizer or public_path("byte_bpe_50k.json")
    id_field = df.schema[doc_id]
    schema = T.StructType([T.StructField(doc_id, id_field.dataType), *_schema(with_ids).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        ends = bpe.sentence_marks()
        closing = np.array([CLOSING_ID], dtype=np.uint32)
        next_id = TaskContext.get().partitionId() << 33
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            columns, n = _solve(docs, ids, ends, next_id, with_ids, options)
            next_id += n
            arrays = [pa.array(columns.pop("doc"), type=id_type)]
            arrays += [pa.array(v) if k != "token_ids" else pa.array(v, type=pa.list_(pa.int32())) for k, v in columns.items()]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        names, id_type = schema.names, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(key)
                ids.append(np.concatenate([bpe.encode_array(body.as_py() or ""), closing]))
                held += len(ids[-1])
                if held >= segment:
                    yield flush()
                    docs, ids, held = [], [], 0
        if docs:
            yield flush()

    return df.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` into windows of 1024 tokens of byte_bpe_50k.json."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, with_ids=False)
