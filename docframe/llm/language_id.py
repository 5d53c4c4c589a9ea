"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of letters becomes a word with a blank on either side; n-grams of 1 to
``max_n`` characters are hashed into ``buckets`` counters. Training counts come from a bounded sample of labelled
rows (``max_training_docs``, chosen by a hash of the id, so alike at every size) through a Spark aggregation; the
log-probabilities of every language found there, kept for the buckets that it fills, are bounded by that sample and
broadcast. Scoring lays out one language after the other, gathers by bucket and sums by document in numpy, batch by
batch: no shuffle, no dense document vectors.

Defined results for odd input
-----------------------------
* null text, or a text without any letter: ``und`` with score 0;
* no labelled training row at all (an empty table, too): every row is ``und`` with score 0;
* null languages are never learned, and held-out rows neither; null ids count as learnable;
* ties go to the language that sorts first; repeated rows each get the same answer;
* whole texts are scored, however long; input columns of the added names, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.text import column_of, held_out, restored, unnamed
from docframe.runtime import ensure_importable

BUCKETS = 1 << 15
MAX_N = 3
#: Bound of the training sample, in documents, and the most characters of text one task holds at a time.
MAX_TRAINING_DOCS = 20_000
SLICE_CHARS = 1 << 19
SMOOTHING = 0.5
#: Sums (texts x languages) that are held at a time.
MAX_SUMS = 4_000_000
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def _grams(texts: list[str], buckets: int, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a batch, the text each belongs to, and which texts have a letter.

    N-grams lie inside a word with its blanks: none spans two words, so cutting texts at blanks loses nothing.
    """
    joined = "\n".join(t.lower().replace("\n", " ") for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    line = np.cumsum(cp == 10, dtype=np.int32) if len(cp) else np.empty(0, np.int32)
    letter = _letters()[cp] if len(cp) else np.empty(0, bool)
    c = np.where(letter, cp, np.uint32(32)).astype(np.uint64)
    blank = ~letter
    has = np.zeros(len(texts), dtype=bool)
    has[line[letter]] = True
    keys, owners = [], []
    h = c.copy()
    for n in range(1, max_n + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        m = len(h)
        if m <= 0:
            break
        ok = letter[n - 1 :].copy() if n == 1 else letter[:m] | letter[n - 1 :]
        for k in range(1, n - 1):  # blanks only at the ends
            ok &= letter[k : k + m]
        if n == 2:
            ok &= ~(blank[:m] & blank[1:])
        at = np.flatnonzero(ok)
        x = (h[at] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        keys.append((x >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int32))
        owners.append(line[at + (n - 1 if n == 1 else (1 if n > 2 else 0))] if n != 2 else np.where(letter[at], line[at], line[at + 1]))
    if not keys:
        return np.empty(0, np.int32), np.empty(0, np.int32), has
    return np.concatenate(keys), np.concatenate(owners), has


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of bounded size as (row numbers, texts); long texts come in parts cut before a blank."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for k, t in enumerate(texts):
        start = 0
        while True:
            end = start + SLICE_CHARS
            if end < len(t):
                cut = t.find(" ", end)
                end = len(t) if cut < 0 else cut
            rows.append(k)
            parts.append(t[start:end])
            size += end - start
            start = end
            if size >= SLICE_CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
            if start >= len(t):
                break
    if rows:
        yield rows, parts


class LanguageModel:
    """Log-probabilities by language; ``predict`` gives codes, posterior probabilities and fits.

    The fit does not grow with the text: it is the mean log-probability of its n-grams over that of an even spread,
    as a share of the same mean (``typical``) of the texts that its language was learned from.
    """

    def __init__(self, languages: list[str], filled: list[tuple[np.ndarray, np.ndarray]], empty: np.ndarray, prior: np.ndarray, max_n: int, typical: np.ndarray, buckets: int):
        """``filled``: for each language its buckets and their log-probabilities; ``empty``: that of all its other buckets."""
        self.languages, self.filled, self.empty, self.prior = languages, filled, empty, prior
        self.max_n, self.typical, self.buckets = max_n, typical, buckets

    def logp(self, k: int) -> np.ndarray:
        row = np.full(self.buckets, self.empty[k], dtype=np.float32)
        at, values = self.filled[k]
        row[at] = values
        return row

    @property
    def learned(self) -> bool:
        """Whether any language has an n-gram."""
        return bool((self.typical > 0).any())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        most = max(1, MAX_SUMS // len(self.languages))
        if n > most:
            parts = [self.predict(texts[a : a + most]) for a in range(0, n, most)]
            return [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        sums = np.zeros((n, len(self.languages)))
        letters = np.zeros(n, dtype=bool)
        grams = np.zeros(n)
        for rows, parts in _slices([t or "" for t in texts]):
            keys, owner, has = _grams(parts, self.buckets, self.max_n)
            rows_at = np.array(rows)
            np.logical_or.at(letters, rows_at, has)
            for k in range(len(self.languages)):
                np.add.at(sums[:, k], rows_at, np.bincount(owner, weights=self.logp(k)[keys], minlength=len(parts)))
            np.add.at(grams, rows_at, np.bincount(owner, minlength=len(parts)))
        plain = sums.copy()
        sums += self.prior
        best = sums.argmax(axis=1)
        gain = plain[np.arange(n), best] / np.maximum(grams, 1) + np.log(self.buckets)
        typical = self.typical[best]
        fit = np.where(letters & (typical > 0), gain / np.where(typical > 0, typical, 1.0), 0.0)
        score = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, np.where(letters, score, 0.0), fit


def fit_language_model(
    df: DataFrame, text: str = "text", lang: str = "lang", learnable: Column | None = None, sample_key: str = "doc_id",
    buckets: int = BUCKETS, max_n: int = MAX_N, max_training_docs: int = MAX_TRAINING_DOCS,
) -> LanguageModel:
    """Learn from at most about ``max_training_docs`` rows of those that have text and language."""
    ensure_importable(df.sparkSession)
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(sample_key).alias("key"), (F.lit(True) if learnable is None else learnable).alias("ok"))
    rows = rows.where(F.col("ok") & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    n = rows.count()
    if n > max_training_docs:
        share = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(10)), F.lit(1 << 40))
        rows = rows.where(share < int(max_training_docs / n * (1 << 40)))
    rows = rows.where(F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in batches:
            for name, part in pdf.groupby("lang"):
                total = totals.setdefault(name, np.zeros(buckets, dtype=np.int64))
                docs[name] = docs.get(name, 0) + len(part)
                for _, parts in _slices(part["text"].tolist()):
                    total += np.bincount(_grams(parts, buckets, max_n)[0], minlength=buckets)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "bucket": np.append(at, -1), "n": np.append(total[at], docs[name])})

    counts = (
        rows.select("text", "lang").mapInPandas(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    got = counts.toPandas()
    docs = got[got.bucket < 0].set_index("lang").n
    own = {name: part for name, part in got[got.bucket >= 0].groupby("lang")}
    languages = sorted(docs.index)
    empty, prior, typical = np.zeros(len(languages), dtype=np.float32), np.zeros(len(languages)), np.zeros(len(languages))
    filled = []
    for k, name in enumerate(languages):
        at, c = (own[name].bucket.to_numpy(), own[name].n.to_numpy()) if name in own else (np.empty(0, np.int32), np.empty(0, np.int64))
        total = c.sum() + SMOOTHING * buckets
        values = np.log((c + SMOOTHING) / total).astype(np.float32)
        filled.append((at, values))
        empty[k] = np.log(SMOOTHING / total)
        prior[k] = np.log(docs[name] / docs.sum())
        if len(at):
            typical[k] = np.average(values, weights=c) + np.log(buckets)
    return LanguageModel(languages, filled, empty, prior, max_n, typical, buckets)


def with_language(df: DataFrame, model: LanguageModel, text: str = "text", fit: str | None = None) -> DataFrame:
    """Add lang_pred (string) and score (double) to every row, and the fit under the name given for it."""
    spark = df.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, fit double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            names, score, fits = shared.value.predict(s.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": score, "fit": fits})

    got = unnamed(df).withColumn("_lang", run(F.col(column_of(df, text))))
    made = {"lang_pred": F.col("_lang.lang_pred"), "score": F.col("_lang.score")} | ({fit: F.col("_lang.fit")} if fit else {})
    return restored(got.select("*", *[c.alias(k) for k, c in made.items()]), df.columns, list(made))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``; learned from text and lang of rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = fit_language_model(docs, learnable=~out)
    return with_language(docs.select("doc_id", "text").withColumn("held_out", out), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
