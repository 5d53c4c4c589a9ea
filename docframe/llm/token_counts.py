"""Token counts, exact for texts of any length, by overlap resynchronisation.

Texts up to ``chunk_chars`` are small: no token of this tokenizer holds white space, so their blank-separated words are
counted one by one, each distinct one by the library once for as long as a bounded memory of words holds it. A longer
text is encoded as overlapping chunks with offsets: two neighbouring chunks are spliced at a boundary that both encodings have and that is proven stable,
which means that no token can reach across it whatever stands further left or right:

* both chunks have tokens that begin at exactly that character, and
* the character before it is white space and the one at it is not, and
* a run of agreeing tokens (same ids, same offsets) surrounds it in both chunks.

If a pair of chunks has no such place in its overlap, the overlap is widened (at once past what holds no white space
at all) and the right chunk is encoded again; when the overlap has grown to the whole left chunk the two are encoded
as one, which is exact by itself, and the next chunk is twice as long, so a text without any boundary costs a constant
number of encodings of its length. The proof rests on a pre-tokeniser that keeps no white space inside a word and a
normaliser that looks at single characters and runs of blanks; with any other tokenizer texts are encoded whole.
Memory is bounded by one text and its widest chunk; there is no shuffle, so skew cannot arise, and a lost executor
costs only its running tasks.

Defined results for odd input
-----------------------------
* null or empty text: 0 bytes, 0 tokens, not over the limit;
* special strings inside texts are read as the library's default has it;
* nulls in other columns, ties, repeated rows: each row is counted on its own;
* an empty table gives an empty table; all input columns stay, those named as a count in any case are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.text import column_of, restored, unnamed
from docframe.llm.tokenizing import library_tokenizer, public_path
from docframe.runtime import ensure_importable

CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 1 << 10
#: Tokens that must agree on either side of a splice.
AGREE = 4
#: Fixed value: the words of a tokenizer whose words hold no white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK = re.compile(r"\s\S")
#: Words that are remembered in a worker (twice as many at most), and bytes of the longest of them.
MEMORY, WORD_BYTES = 150_000, 48
#: Marks that are a word of their own after a letter or a digit, with nothing behind them.
_TAIL = b".,;:!?)]"


def _stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isspace() and not text[at].isspace()


class _Part:
    """One encoded chunk of a text; offsets are asked of the library where they are needed only."""

    def __init__(self, tok, text: str, start: int, end: int):
        self.start, self.tokens = start, tok.encode(text[start:end], add_special_tokens=False)
        self._ids: list[int] | None = None

    @property
    def ids(self) -> list[int]:
        if self._ids is None:
            self._ids = self.tokens.ids
        return self._ids

    def begins(self, at: int) -> int | None:
        """The token that begins at exactly this character of the text."""
        k = self.tokens.char_to_token(at - self.start)
        return k if k is not None and self.tokens.token_to_chars(k)[0] == at - self.start else None

    def around(self, k: int) -> list[tuple[int, int, int]] | None:
        """Offsets and ids of the tokens on either side of the start of token ``k``; None if there are too few."""
        e = self.tokens
        if k < AGREE or k + AGREE > len(e):
            return None
        spans = [e.token_to_chars(j) for j in range(k - AGREE, k + AGREE)]
        if spans[AGREE - 1][1] > spans[AGREE][0]:  # the token before reaches across
            return None
        return [(self.start + a, self.start + b) for a, b in spans]


def _splice(text: str, left: _Part, right: _Part, end: int) -> tuple[int, int, int] | None:
    """A stable boundary that both have: (character, token of the left chunk, token of the right one), or None."""
    for m in reversed(list(_BLANK.finditer(text, right.start, end))):
        at = m.start() + 1
        k, j = left.begins(at), right.begins(at)
        if k is None or j is None or not _stable(text, at):
            continue
        spans = left.around(k)
        if spans is None or spans != right.around(j):
            continue
        if left.ids[k - AGREE : k + AGREE] == right.ids[j - AGREE : j + AGREE]:
            return at, k, j
    return None


@lru_cache(maxsize=4)
def parts_at_blanks(path: str) -> bool:
    """Whether white space always parts words in this tokenizer, so that chunks may be spliced after it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    splits = pre.get("pretokenizers", [pre] if pre else [])
    if spec.get("post_processor") is not None or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
        return False
    local = all(x.get("type") in ("NFC", "Lowercase") or x.get("type") == "Replace" and x["pattern"].get("Regex") == r"\s+" for x in steps)
    first = splits[0] if splits else {}
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return local and apart and first["pattern"].get("Regex") == WORDS


def spliced(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[tuple[_Part, int, int]]:
    """Chunks of a text with the first and one past the last of their tokens that count."""
    start, end, step = 0, min(len(text), chunk), chunk
    if any(t.content in text for t in tok.get_added_tokens_decoder().values()):
        end = len(text)  # may hold white space or match across any cut: no boundary is provably stable
    part, first = _Part(tok, text, start, end), 0
    while end < len(text):
        width = overlap
        while True:
            begin = max(start, end - width)
            stop = min(len(text), end + step)
            if begin == start:  # no stable boundary in the whole left chunk: both become one
                end, part, first, step = stop, _Part(tok, text, start, stop), 0, 2 * (stop - start)
                break
            found = None
            if _BLANK.search(text, begin, end):
                right = _Part(tok, text, begin, stop)
                found = _splice(text, part, right, end)
            if found:
                yield part, first, found[1]
                # What is left of the right chunk before its boundary has been counted with the left one.
                start, first, end, part, step = found[0], found[2], stop, right, chunk
                break
            width *= 4
    yield part, first, len(part.tokens)


def encode_long(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of ``tok.encode(text)``, from chunks."""
    return [i for part, a, b in spliced(tok, text, chunk, overlap) for i in part.ids[a:b]]


class _Memory:
    """Tokens by word; what was not asked for since half of it was filled is forgotten."""

    def __init__(self, tok):
        self.tok, self.young, self.old = tok, {}, {}
        self.marks = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]

    def add(self, words: set[bytes]) -> dict[bytes, int]:
        """Remember the words; those that are too long for that are given back with their counts."""
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for w in words:
            core = w.rstrip(_TAIL)
            if len(core) < len(w) and core[-1:].isalnum():
                parts[w] = (core, w[len(core) :])
        ask = {p for pair in parts.values() for p in pair} | (words - parts.keys())
        ask = [p for p in ask if p not in self.young and p not in self.old]
        found = {}
        for at in range(0, len(ask), 4096):
            some = ask[at : at + 4096]
            made = self.tok.encode_batch_fast([w.decode("utf-8") for w in some], add_special_tokens=False)
            found.update(zip(some, map(len, made)))
        get = lambda p: found[p] if p in found else self.young[p] if p in self.young else self.old[p]
        every = {w: get(parts[w][0]) + get(parts[w][1]) if w in parts else get(w) for w in words}
        self.young.update((w, n) for w, n in (found | every).items() if len(w) <= WORD_BYTES)
        return {w: n for w, n in every.items() if len(w) > WORD_BYTES}

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text as the sum over its words; only words that are not remembered go to the library."""
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        split = []
        for t in texts:
            data = t.encode("utf-8")
            # Bytes are split at ASCII white space alone, and only ASCII letters are made small: as the normaliser does,
            # which leaves the strings of added tokens alone.
            split.append((data if any(m in data.lower() for m in self.marks) else data.lower()).split())
        young, old = self.young, self.old
        new = {w for own in split for w in own if w not in young}
        young.update((w, old[w]) for w in new if w in old)
        long = self.add({w for w in new if w not in young})
        return [sum([young[w] if w in young else long[w] for w in own]) for own in split]


_MEMORIES: dict[str, _Memory] = {}


def count_tokens(texts: list[str], path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Token count of each text; short ones by words, long ones by chunks, or all whole if blanks do not part words."""
    tok = library_tokenizer(path)
    if not parts_at_blanks(path):
        return [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    counts = [0] * len(texts)
    short = [k for k, t in enumerate(texts) if len(t) <= chunk]
    for at in range(0, len(short), 256):
        some = short[at : at + 256]
        if path not in _MEMORIES:
            _MEMORIES[path] = _Memory(tok)
        for k, n in zip(some, _MEMORIES[path].counts([texts[k] for k in some])):
            counts[k] = n
    for k, t in enumerate(texts):
        if len(t) > chunk:
            counts[k] = sum(b - a for _, a, b in spliced(tok, t, chunk, overlap))
    return counts


def with_token_counts(
    df: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = 2048,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to every row."""
    ensure_importable(df.sparkSession)
    path = tokenizer or public_path("word_bpe_49k.json")

    @F.pandas_udf("bigint")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(count_tokens(s.tolist(), path, chunk_chars, overlap_chars), dtype="int64")

    t = F.coalesce(F.col(column_of(df, text)), F.lit(""))
    counted = unnamed(df).withColumn("n_tokens", n_tokens(t))
    made = {"n_bytes": F.octet_length(t).cast("long"), "over_limit": F.col("n_tokens") > limit}
    return restored(counted.withColumns(made), df.columns, ["n_bytes", "n_tokens", "over_limit"])


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` counted with word_bpe_49k.json."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
