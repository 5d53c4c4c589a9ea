"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

1. *Profile.* One pass over the texts hashes the word n-grams of each document (64 bits) and takes the size and a
   128-bit digest of its set; documents with equal sets form a class. Documents are numbered within blocks of bounded
   size, and each block asks, for every n-gram it holds, in how many documents of the whole table it occurs.
2. *Frequencies.* Questions are dealt by ranges of the n-grams' hashes, as many ranges as the measured text needs, so
   that a range fits in memory; a block asks once for each n-gram, so a frequent one is no hot key. What comes back is
   exact, and only n-grams of two documents or more come back: the others cannot link anything.
3. *Prefixes.* Rarest first, each class emits those of its first ``n - ceil(t n) + 1`` n-grams that occur elsewhere;
   two sets of Jaccard >= t share one of them.
4. *Stars.* In the bucket of an n-gram every member is paired with the bucket's first class only: as many pairs as
   members, not their square. Pairs pass length and positional filters and are made distinct, so each is verified once.
   Members of frequent n-grams are salted by the frequency that they carry, so no bucket is gathered in one task.
5. *Verification.* The texts of the pairs' classes meet under the pair's first class (salted where that one has many
   partners); the suffix filter bounds the overlap by halves, then sorted hashes are intersected exactly.
6. *Rest.* Only pairs of one bucket that are in different components so far can still change anything, and a bucket
   that lies in one component is done for good. While many can be expected to pass the filters, by the share that
   passed in the round before, buckets get other centres and steps 4 and 5 are repeated on what is apart; in the end
   all pairs still apart are enumerated (same filters), verified the same way, and the components are built again.
   Nothing is capped.

Reading is in the order of the input's own partitions; texts are shuffled only for classes that occur in a pair.

Defined results for odd input
-----------------------------
* null, empty or blank text: no n-gram, linked with nothing, its own component;
* fewer words than n: the whole word sequence is the only n-gram;
* null ids: the row has its size and a null component; it links with nothing;
* equal texts: one class; rows that repeat an id count as one document, with the least of their texts;
* ids are whole numbers, in any type that casts to ``bigint``; one that does not is an error of the cast;
* ties in frequency go by the n-gram's hash, alike in every document;
* very long texts: read whole, in parts of bounded size; an empty table gives an empty table;
* other columns of the input are ignored here and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.components import connected_components
from docframe.llm.text import column_of, restored, unnamed
from docframe.runtime import ensure_importable, write_stage

N = 5
PERCENT = 75
#: Bits of an n-gram's hash that stand for it in frequencies and buckets; the rest of a 64-bit word numbers documents.
KEY_BITS, PLACE_BITS = 40, 24
#: N-grams of one block of documents, and those that one range of hashes holds on average.
BLOCK_GRAMS, RANGE_GRAMS = 1 << 20, 1 << 20
#: Text bytes for each n-gram, at least: words of one letter with a blank would be 2, prose has 6.
BYTES_PER_GRAM = 5
#: Documents of one frequent n-gram that are handled together.
BUCKET_ROWS = 2048
#: Verification rows (about 40 bytes) and dropped ids that may be broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 400_000
#: Partners of one class that are verified in one group.
GROUP = 128
#: Star rounds go on while more open pairs for each row of the buckets than this are expected to pass the filters.
PAIRS_PER_ROW = 16
#: Centres of a bucket from the second round on. A round that links less than this share of its pairs is the last.
CENTRES, FRUITFUL = 12, 0.02
EARLIER = 8
_PART = 1 << 22  # bytes of text split at a time
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MANY = (1 << PLACE_BITS) - 1  # stands for a document's place where a block holds an n-gram several times
_PLACE = np.uint64(PLACE_BITS)


class _WordHashes(dict):
    """xxhash64 by word, emptied when it holds 150,000 words: tens of MB for each worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _word_hashes(data: bytes) -> np.ndarray:
    parts, start = [], 0
    while start < len(data):
        end = start + _PART
        if end < len(data):  # cut at white space only
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        words = data[start:end].translate(_LOWER).split()
        parts.append(np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words)))
        start = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def ngram_set(data: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of one UTF-8 text."""
    w = _word_hashes(data)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _MULTIPLIERS[j]
    return np.unique(_mix(h))


def _bodies(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def _class_of(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _at_least(percent: int, n: np.ndarray | int):
    """Least overlap that a set of size n has with any set linked to it."""
    return (percent * n + 99) // 100


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers below ``256 ** width`` as ``width`` planes of bytes, which the engine's own compression packs well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    whole = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    whole[:, :width] = planes.T
    return whole.view("<u8").ravel()


def _rises(keys: np.ndarray) -> bytes:
    """Rising n-gram keys as the steps between them."""
    return _planes(np.diff(keys, prepend=np.uint64(0)), KEY_BITS // 8)


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, KEY_BITS // 8), dtype=np.uint64)


_ASKED = "kind int, slot int, block bigint, doc_id bigint, n_shingles bigint, a bigint, b bigint, place int, grams binary, places binary, counts binary"
_ASKED_NAMES = [f.split()[0] for f in _ASKED.split(", ")]
_ASKED_TYPES = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.int32(), *[pa.binary()] * 3]


def _asked(m: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[k], t) if k in columns else pa.nulls(m, t) for k, t in zip(_ASKED_NAMES, _ASKED_TYPES)]
    return pa.RecordBatch.from_arrays(arrays, names=_ASKED_NAMES)


def _questions(entries: np.ndarray, block: int, slots: int) -> pa.RecordBatch:
    """A block's n-grams (key and place in one word) by slot (kind 1), and those in several of its documents (kind 2).

    A question holds each n-gram once: with its document, or with how many of the block's documents hold it.
    """
    entries.sort()
    keys = entries >> _PLACE
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(first, len(keys)))
    places, own = (entries & np.uint64(_MANY)), keys[first]
    asked = np.where(n > 1, np.uint64(_MANY), places[first])
    edges = -(-(np.arange(slots + 1, dtype=object) << KEY_BITS) // slots)
    cuts = np.searchsorted(own, np.array(edges[1:-1], dtype=np.uint64))
    parts = [(k, s, t) for k, (s, t) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)])) if s < t]
    many = np.repeat(n > 1, n)
    rows = [(1, k, _rises(own[s:t]), _planes(asked[s:t], 3), _planes(n[s:t][n[s:t] > 1], 4)) for k, s, t in parts]
    if many.any():
        rows.append((2, block % slots, _rises(own[n > 1]), _planes(places[many], 3), _planes(n[n > 1], 4)))
    kinds, at, grams, held, counts = zip(*rows)
    return _asked(len(rows), kind=kinds, slot=at, block=[block] * len(rows), grams=grams, places=held, counts=counts)


def _profile(docs: DataFrame, n: int, slots: int) -> DataFrame:
    """Rows of documents (kind 0) and questions of their blocks (kinds 1 and 2), from one pass; all are dealt by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        entries, held, place, told = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes, firsts, seconds, blocks, places = [], [], [], [], []
            for key, body in zip(batch.column(0).to_pylist(), _bodies(batch.column(1))):
                g = ngram_set(body, n)
                a, b = _class_of(g)
                known = key is not None and len(g) > 0
                sizes.append(len(g))
                firsts.append(a)
                seconds.append(b)
                blocks.append(block)
                places.append(place if known else None)
                if known:
                    entries.append(((g >> np.uint64(64 - KEY_BITS)) << _PLACE) | np.uint64(place))
                    held, place = held + len(g), place + 1
                if held >= BLOCK_GRAMS or place == _MANY:
                    yield _questions(np.concatenate(entries), block, slots)
                    entries, held, place, block = [], 0, 0, block + 1
            m = len(sizes)
            told += m
            yield _asked(
                m, kind=[0] * m, slot=[x % slots for x in range(told - m, told)], block=blocks, doc_id=batch.column(0), n_shingles=sizes,
                a=firsts, b=seconds, place=places,
            )
        if entries:
            yield _questions(np.concatenate(entries), block, slots)

    return docs.mapInArrow(run, _ASKED)


def _answered(rows: DataFrame) -> DataFrame:
    """Questions of kind 1 replaced by answers: the n-grams that several documents hold, with their number.

    One slot is in memory at a time. All other rows pass through.
    """

    def answers(blocks: list[int], chunks: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, places, counts = (np.concatenate(c) for c in zip(*chunks))
        ends = np.cumsum([len(c[0]) for c in chunks])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(counts[order], first)
        found = np.empty(len(keys), dtype=np.uint64)
        found[order] = np.repeat(np.minimum(total, np.uint64(0x7FFFFFFF)), np.diff(np.append(first, len(keys))))
        rows = []
        for block, s, t in zip(blocks, [0, *ends[:-1].tolist()], ends.tolist()):
            at = s + np.flatnonzero(found[s:t] > 1)
            if len(at):
                rows.append((block, _rises(keys[at]), _planes(places[at], 3), _planes(found[at], 4)))
        for k in range(0, len(rows), 256):
            own, grams, held, n = zip(*rows[k : k + 256])
            yield _asked(len(own), kind=[1] * len(own), block=own, grams=grams, places=held, counts=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, blocks, chunks = None, [], []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if not (kinds == 1).all():
                yield batch.filter(pa.array(kinds != 1))
                batch = batch.filter(pa.array(kinds == 1))
            for s, block, grams, places, counts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 8, 9, 10))):
                if s != slot and chunks:
                    yield from answers(blocks, chunks)
                    blocks, chunks = [], []
                slot = s
                held = _numbers(places, 3)
                n = np.ones(len(held), dtype=np.uint64)
                n[held == _MANY] = _numbers(counts, 4)
                blocks.append(block)
                chunks.append((_risen(grams), held, n))
        if chunks:
            yield from answers(blocks, chunks)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(parts, F.col("slot") % parts).sortWithinPartitions("slot").mapInArrow(run, _ASKED)


def _block_prefixes(reps: dict[int, tuple[int, int]], answers: list[tuple], many: list[tuple], percent: int):
    """(gram, node, size, pos, df) of the prefixes of one block's representatives, without n-grams found nowhere else."""
    if not reps or not answers:
        return None
    keys, places, df = (np.concatenate(c) for c in zip(*answers))
    single = places != _MANY
    if many:
        grams, held, n = many[0]
        at = np.argsort(keys[~single])
        known = keys[~single][at]
        of = df[~single][at][np.searchsorted(known, grams)]
        keys, df = np.concatenate([keys[single], np.repeat(grams, n)]), np.concatenate([df[single], np.repeat(of, n)])
        places = np.concatenate([places[single], held])
    shared = np.bincount(places.astype(np.int64), minlength=1 + max(reps))
    node, size = np.zeros(len(shared), dtype=np.int64), np.zeros(len(shared), dtype=np.int64)
    for place, (rep, m) in reps.items():
        node[place], size[place] = rep, m
    alone = size - shared  # n-grams of this document only: they come first and meet nothing
    want = np.where(size > 0, size - _at_least(percent, size) + 1 - alone, 0)
    take = want[places] > 0
    keys, places, df = keys[take], places[take].astype(np.int64), df[take]
    order = np.lexsort((keys, df, places))
    keys, places, df = keys[order], places[order], df[order]
    if not len(places):
        return None
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    rank = np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))
    take = rank < want[places]
    keys, places, df, rank = keys[take], places[take], df[take], rank[take]
    return keys.astype(np.int64), node[places], size[places].astype(np.int32), (alone[places] + rank).astype(np.int32), df.astype(np.int32)


def _prefixes(answered: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(gram, node, size, pos, df): the rarest n-grams of each class that other documents hold, too."""
    own = ["kind", "block", "place", "node", "size", "grams", "places", "counts"]
    none = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
    reps = classes.select(F.lit(0).alias("kind"), "block", "place", "node", F.col("size").cast("int").alias("size"), *none("binary", "grams", "places", "counts"))
    held = answered.where("kind > 0").select("kind", "block", *none("int", "place"), *none("bigint", "node"), *none("int", "size"), "grams", "places", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reps, answers, many = None, {}, [], []

        def flush() -> list[pa.RecordBatch]:
            got = _block_prefixes(reps, answers, many, percent)
            if got is None:
                return []
            return [pa.RecordBatch.from_arrays([pa.array(c[k : k + 65536]) for c in got], names=["gram", "node", "size", "pos", "df"]) for k in range(0, len(got[0]), 65536)]

        for batch in batches:
            for kind, b, place, node, size, grams, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    yield from flush()
                    block, reps, answers, many = b, {}, [], []
                if kind == 0:
                    reps[place] = (node, size)
                elif kind == 1:
                    answers.append((_risen(grams), _numbers(places, 3), _numbers(counts, 4)))
                else:
                    many.append((_risen(grams), _numbers(places, 3), _numbers(counts, 4).astype(np.int64)))
        yield from flush()

    parts = int(answered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.unionByName(held).repartition(parts, "block").sortWithinPartitions("block", "kind").select(*own)
    return rows.mapInArrow(run, "gram bigint, node bigint, size int, pos int, df int")


def _may_link(percent: int, n1, p1, n2, p2):
    """Length and positional filters as a condition on columns."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    rest = F.least(n1 - p1, n2 - p2)  # of the n-grams from here on, this one included
    return (100 * small >= percent * large) & ((100 + percent) * rest.cast("bigint") >= percent * (n1 + n2).cast("bigint"))


def overlap(x: np.ndarray, y: np.ndarray, need: int, depth: int = 3) -> int:
    """Size of the intersection of sorted sets, or -1 as soon as the suffix filter shows it is below ``need``."""

    def bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or len(x) < 64 or len(y) < 64:
            return min(len(x), len(y))
        i = len(x) // 2
        j = int(np.searchsorted(y, x[i]))
        return bound(x[:i], y[:j], depth - 1) + bound(x[i:], y[j:], depth - 1)

    if bound(x, y, depth) < need:
        return -1
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """(u, v): the pairs (x, y) of classes, named by their representatives' ids, that are linked."""
    keyed = pairs.select(F.col("x").alias("u"), F.col("y").alias("v"))
    partners = keyed.groupBy("u").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / GROUP).cast("int"))
    partners = write_stage(partners, f"{name}-partners")
    firsts = partners.select(
        F.col("u").alias("doc_id"), F.col("u").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("side"),
    )
    # Only classes with more partners than one group holds are joined: one for each GROUP pairs at most.
    heavy = partners.where("salts > 1").select("u", "salts")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
    seconds = keyed.join(heavy, "u", "left").select(
        F.col("v").alias("doc_id"), F.col("u").alias("key"),
        F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("side"),
    )
    tasks = write_stage(firsts.unionByName(seconds), f"{name}-tasks")
    wanted = F.broadcast(tasks) if tasks.count() <= BROADCAST_ROWS else tasks
    rows = docs.join(wanted, "doc_id").select("key", "salt", "side", "doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, None
        for batch in batches:
            us, vs = [], []
            keys, salts, sides, ids = (batch.column(k).to_pylist() for k in range(4))
            for key, salt, side, doc, body in zip(keys, salts, sides, ids, _bodies(batch.column(4))):
                g = ngram_set(body, n)
                if side == 0:
                    group, first = (key, salt), g
                    continue
                if (key, salt) != group:
                    continue
                need = -(-percent * (len(g) + len(first)) // (100 + percent))
                if overlap(first, g, need) >= need:
                    us.append(key)
                    vs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return write_stage(rows.mapInArrow(run, "u bigint, v bigint"), f"{name}-links")


def _salts() -> Column:
    """Parts of the bucket of an n-gram, by the number of documents that hold it."""
    return F.ceil(F.col("df") / BUCKET_ROWS).cast("int")


def _with_bucket(members: DataFrame, stats: DataFrame) -> DataFrame:
    """Members joined with their bucket's statistics; both sides are dealt by n-gram and salt."""
    dealt = stats.select("*", F.explode(F.sequence(F.lit(0), _salts() - 1)).alias("_salt")).drop("df")
    own = F.pmod(F.xxhash64("node"), _salts()).cast("int")
    return members.withColumn("_salt", own).join(dealt, ["gram", "_salt"]).drop("_salt")


def _apart(members: DataFrame, components: DataFrame, round_: int) -> DataFrame:
    """Members (gram, node, size, pos, df, component) of buckets that still hold several components."""
    of_node = components.select("node", F.col("component").alias("_c"))
    members = members.drop("component").join(of_node, "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")
    members = write_stage(members, f"ngram-members-{round_}")
    stats = members.groupBy("gram").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.max("df").alias("df"))
    return write_stage(_with_bucket(members, stats.where("_lo < _hi")).drop("_lo", "_hi"), f"ngram-rest-{round_}")


def _pairs_apart(members: DataFrame, percent: int) -> DataFrame:
    """Every pair of one bucket and two components that passes the filters.

    Near copies meet in most of their buckets. A row knows the node's few n-grams before this one; where two rows have
    one of them in common, the pair was made there or earlier, so it is not made again. Parts of a frequent n-gram's
    bucket meet each part of it in a group of their own.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("node").orderBy("pos").rowsBetween(-EARLIER, -1)
    members = members.withColumn("earlier", F.collect_list("gram").over(before))
    names = ("node", "size", "pos", "component", "earlier")
    part = F.pmod(F.xxhash64("node"), _salts()).cast("int")
    every = F.explode(F.sequence(F.lit(0), _salts() - 1))
    x = members.select("gram", part.alias("x_part"), every.alias("y_part"), *[F.col(c).alias("x_" + c) for c in names])
    y = members.select("gram", every.alias("x_part"), part.alias("y_part"), *[F.col(c).alias("y_" + c) for c in names])
    apart = (
        (F.col("x_node") < F.col("y_node")) & (F.col("x_component") != F.col("y_component"))
        & _may_link(percent, F.col("x_size"), F.col("x_pos"), F.col("y_size"), F.col("y_pos"))
        & ~F.arrays_overlap("x_earlier", "y_earlier")
    )
    met = x.join(y, ["gram", "x_part", "y_part"]).where(apart)
    return met.select(F.col("x_node").alias("x"), F.col("y_node").alias("y")).distinct()


def _stars_apart(members: DataFrame, links: DataFrame, percent: int, round_: int) -> DataFrame:
    """Pairs of each bucket's new centres with its members of other components.

    In the first round the centre is the member with the most links so far, in later ones several members, by hash.
    """
    place = ("node", "size", "pos", "component")
    if round_ == 1:
        ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
        members = members.join(ends.groupBy("node").count(), "node", "left")
        ranks = [-F.coalesce("count", F.lit(0))]
    else:
        ranks = [F.xxhash64("node", F.lit(CENTRES * round_ + k)) for k in range(CENTRES)]
    least = [F.min(F.struct(rank.alias("rank"), *place)).alias(f"c{k}") for k, rank in enumerate(ranks)]
    centres = members.groupBy("gram").agg(F.max("df").alias("df"), *least)
    bare = [F.struct(*[F.col(f"c{k}.{p}").alias(p) for p in place]) for k in range(len(ranks))]
    centres = centres.select("gram", "df", F.explode(F.array_distinct(F.array(*bare))).alias("c"))
    met = _with_bucket(members, centres).where(
        (F.col("c.component") != F.col("component"))
        & _may_link(percent, F.col("c.size"), F.col("c.pos"), F.col("size"), F.col("pos"))
    )
    return met.select(F.least("c.node", "node").alias("x"), F.greatest("c.node", "node").alias("y")).distinct()


def _links(docs: DataFrame, prefixes: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes that are linked with others; None if no bucket holds two classes."""
    stats = prefixes.groupBy("gram").agg(
        F.min(F.struct("node", "size", "pos")).alias("first"), F.max("node").alias("_last"), F.count("*").alias("m"), F.max("df").alias("df")
    )
    buckets = write_stage(_with_bucket(prefixes, stats.where(F.col("first.node") < F.col("_last"))).drop("_last"), "ngram-buckets")
    # Near copies share most of their n-grams: the pairs are far fewer than the rows and combine before the shuffle.
    stars = (
        buckets.where((F.col("first.node") != F.col("node")) & _may_link(percent, F.col("first.size"), F.col("first.pos"), F.col("size"), F.col("pos")))
        .select(F.col("first.node").alias("x"), F.col("node").alias("y")).distinct()
    )
    stars = write_stage(stars, "ngram-stars")
    if not stars.take(1):
        return None
    links = _verify(docs, stars, n, percent, "ngram-star")
    components = connected_components(links, "u", "v")
    members = buckets.where("m > 2").drop("first", "m")  # two classes are settled by their star
    checked, fruitful, passing, round_, last = stars, True, 1.0, 0, False
    while not last:
        round_ += 1
        members = _apart(members, components, round_)
        left = members.groupBy("gram", "component").agg(F.count("*").alias("s"))
        left = left.groupBy("gram").agg(F.sum("s").alias("m"), F.sum(F.col("s") * F.col("s")).alias("inside"))
        rows_left, pairs_left = left.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("inside")) / 2)).first()
        if not rows_left:
            break
        last = not fruitful or pairs_left * passing <= PAIRS_PER_ROW * rows_left
        more = _pairs_apart(members, percent) if last else _stars_apart(members, links, percent, round_)
        more = write_stage(more.join(checked, ["x", "y"], "left_anti"), "ngram-pairs")
        n_more = more.count()
        fruitful, passing = False, n_more / (rows_left * (1 if round_ == 1 else CENTRES))
        if n_more:
            found = _verify(docs, more, n, percent, "ngram-rest")
            checked = checked.unionByName(more)
            n_found = found.count()
            fruitful = n_found >= FRUITFUL * n_more
            if n_found:
                links = links.unionByName(found)
                components = connected_components(links, "u", "v")
    return components


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def jaccard_components(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row; links hold at Jaccard >= percent / 100.

    ``class_id`` is the smallest id with the same n-gram set, so pairs of classes and this column give every link.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    every = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    twice = write_stage(every.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ngram-twice")
    n_twice, docs = twice.count(), every
    if n_twice:
        apart = every.join(_small(twice, n_twice), "doc_id", "left_anti").select("doc_id", "text")
        once = every.join(_small(twice, n_twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = write_stage(apart.unionByName(once), "ngram-once")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BYTES_PER_GRAM / RANGE_GRAMS))
    answered = write_stage(_answered(_profile(docs, n, slots)), "ngram-answers")
    rows = answered.where("kind = 0").select("doc_id", "n_shingles", "a", "b", "block", "place")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "n_shingles", "block", "place")).alias("first")
    classes = some.groupBy("a", "b").agg(first).select(
        "a", "b", F.col("first.doc_id").alias("node"), F.col("first.n_shingles").alias("size"), "first.block", "first.place"
    )
    classes = write_stage(classes, "ngram-classes")
    prefixes = write_stage(_prefixes(answered, classes, percent), "ngram-prefixes")
    components = _links(docs, prefixes, n, percent)
    known = classes.select("a", "b", "node")
    if components is None:
        known = known.withColumn("component", F.col("node"))
    else:
        known = known.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = lambda c: F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col(c))).otherwise(F.col("doc_id"))
    got = rows.join(known, ["a", "b"], "left").select("doc_id", "n_shingles", told("component").alias("component_id"), told("node").alias("class_id"))
    if n_twice:  # each of the rows that repeat an id has the result of that id
        again = every.select("doc_id").join(_small(twice, n_twice), "doc_id", "left_semi")
        got = write_stage(got, "ngram-once-found")
        own = got.join(_small(twice, n_twice), "doc_id", "left_semi")
        got = got.join(_small(twice, n_twice), "doc_id", "left_anti").unionByName(again.join(own, "doc_id").select(*got.columns))
    return got


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the one with the smallest id. Rows without an id stay; of rows that repeat an id,
    one stays."""
    found = write_stage(jaccard_components(df, doc_id, text, n, percent), "ngram-components")
    rows, key = unnamed(df), column_of(df, doc_id)
    ids = F.col("doc_id").alias("_id")
    gone = found.where("doc_id <> component_id").select(ids).distinct()
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(ids)
    n_gone, n_twice = gone.count(), twice.count()
    same = F.col(key).cast("bigint") == F.col("_id")
    kept = rows.join(_small(gone, n_gone), same, "left_anti")
    if n_twice:
        once = kept.join(_small(twice, n_twice), same, "left_semi").dropDuplicates([key])
        kept = kept.join(_small(twice, n_twice), same, "left_anti").unionByName(once)
    return restored(kept, df.columns, [])


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, five words, Jaccard 0.75."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs)
