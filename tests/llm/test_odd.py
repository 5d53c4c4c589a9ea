"""Odd input: the results that the operators' docstrings state, value by value, and columns whose names clash."""

import zlib

import pytest
from pyspark.sql import functions as F

from docframe.llm import bpe_chunks, chat_formatting, fingerprints, language_id, ngram_join, packing, quality_classifier
from docframe.llm import quality_rules, sharding, token_counts, tokenizing
from docframe.llm.queries import QUERIES

PROSE = "The quick brown fox jumps over the lazy dog near the old river bank today, and nobody minds it at all. "
TEXT = "".join(f"{PROSE}Number {k} is told of here. " for k in range(8))
LONG = "".join(f"Sentence {k} of a very long text says something new about item {k * 7919 % 10007}. " for k in range(20_000))
ROWS = [
    (1, TEXT, "en"), (1, TEXT, "en"), (2, TEXT, None), (3, None, "en"), (4, "", "de"), (5, " \n\t ", None), (None, TEXT, "en"), (None, None, None),
    (6, LONG, "en"), (7, "1234 5678", "en"), (8, "x", "de"), (9, "Ein kurzer deutscher Satz mit einigen schönen Wörtern darin.", "de"),
]
NAMES = (
    "n_words word_chars n_symbols base_failed clean_text n_lines retention kept score predicted shard bucket slot size fingerprint n_bytes n_tokens "
    "over_limit token_ids decoded ids_sha256 decoded_sha256 lang_pred fit reply_text reply_to thread depth n_quotes max_quote_level position".split()
)
#: Names that results have, in another case, and names that operators use inside.
CLASH = [n.title() for n in NAMES] + [
    "_words", "_windows", "_w", "_l", "_s_words", "_made", "_input", "_row", "_canon", "_a", "_b", "_lang", "_bpe", "_shard", "_cell", "_pid", "_order",
    "_runs", "_lines", "_quotes", "_part", "_id", "x.y", "node", "gram", "a b",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *[F.concat(F.lit(n + "-"), F.col("doc_id").cast("string")).alias(n) for n in CLASH])


def by_text(rows, name):
    return {r["text"]: r[name] for r in rows}


def _no_labels():
    import numpy as np

    return np.empty((0, 12)), np.empty(0), []


ROWWISE = {
    "rules": (quality_rules.apply_quality_rules, quality_rules.MADE),
    "tokens": (token_counts.with_token_counts, ["n_bytes", "n_tokens", "over_limit"]),
    "quality": (lambda df: quality_classifier.with_quality(df, quality_classifier.fit_rules(*_no_labels())), ["score", "predicted"]),
    "shard": (sharding.shard_documents, ["shard", "bucket", "slot", "size"]),
    "fingerprint": (fingerprints.with_fingerprints, ["fingerprint"]),
    "bpe": (bpe_chunks.with_bpe, ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded"]),
    "language": (lambda df: language_id.with_language(df, language_id.fit_language_model(df)), ["lang_pred", "score"]),
    "chat": (lambda df: chat_formatting.format_conversations(df, "lang", "doc_id"), chat_formatting.MADE),
    "built": (lambda df: chat_formatting.build_conversations(df, "lang", "doc_id"), [*chat_formatting.MADE, "position"]),
    "kept": (quality_rules.keep_good, []),
    "cleaned": (lambda df: quality_rules.keep_good(df, cleaned=True), []),
    "deduplicate": (ngram_join.deduplicate, []),
}


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_columns_that_clash_are_kept_or_replaced(clashing, name, tmp_path):
    operator, made = ROWWISE[name]
    got = operator(clashing)
    gone = {m.lower() for m in made}
    assert got.columns == [c for c in clashing.columns if c.lower() not in gone] + made
    got.write.parquet(str(tmp_path / "out"))  # names differ in more than their case
    for r in got.select("doc_id", *[F.col(f"`{c}`") for c in CLASH if c.lower() not in gone]).collect():
        for c in CLASH:
            if c.lower() not in gone:
                assert r[c] == (None if r["doc_id"] is None else f"{c}-{r['doc_id']}")


def test_pack_and_join_ignore_other_columns(clashing):
    assert packing.pack_documents(clashing).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "token_ids"]
    assert ngram_join.jaccard_components(clashing).columns == ["doc_id", "n_shingles", "component_id", "class_id"]


def test_rules_values(odd):
    rows = quality_rules.apply_quality_rules(odd).collect()
    assert len(rows) == len(ROWS)
    for t in (None, "", " \n\t "):
        r = next(r for r in rows if r["text"] == t)
        assert [r[c] for c in quality_rules.BASE] == [0] * 5 and r["base_failed"] and not r["kept"] and not r["clean_text"].strip()
    assert by_text(rows, "n_words")[LONG] == len(LONG.split()) and by_text(rows, "clean_text")[LONG] == LONG
    assert by_text(rows, "base_failed")[LONG] == (by_text(rows, "n_repeat_words")[LONG] * 2 > len(LONG.split()))
    assert sum(r["kept"] for r in rows if r["text"] == TEXT) in (0, 4)


def test_token_values(odd):
    lib = tokenizing.library_tokenizer(tokenizing.public_path("word_bpe_49k.json"))
    rows = token_counts.with_token_counts(odd).collect()
    for r in rows:
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)
    at = {r["text"]: r["n_tokens"] for r in token_counts.with_token_counts(odd, limit=by_text(rows, "n_tokens")[TEXT]).collect() if not r["over_limit"]}
    assert TEXT in at and LONG not in at  # a text of exactly the limit is not over it


def test_bpe_values(odd):
    lib = tokenizing.library_tokenizer(tokenizing.public_path("byte_bpe_50k.json"))
    for r in bpe_chunks.with_bpe(odd).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["token_ids"], r["decoded"], r["n_tokens"]) == (ids, r["text"] or "", len(ids))


def test_quality_values(odd):
    rows = quality_classifier.with_quality(odd, quality_classifier.fit_rules(*_no_labels())).collect()
    assert {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}  # nothing learned, and the tie
    labels = odd.sparkSession.createDataFrame([(1, None), (2, 1)], "doc_id bigint, quality int")
    one = quality_classifier.fit_quality_model(odd.where("doc_id is not null"), labels)
    assert not one.rules  # one class only


def test_language_values(odd):
    model = language_id.fit_language_model(odd)
    rows = language_id.with_language(odd, model).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == letters and (r["score"] > 0) == letters
    nothing = language_id.fit_language_model(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in language_id.with_language(odd, nothing).collect()} == {("und", 0.0)}
    same = odd.sparkSession.createDataFrame([(1, "abc", "zz"), (2, "abc", "aa")], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language_id.with_language(same, language_id.fit_language_model(same)).collect()} == {"aa"}  # a tie


def test_shard_values(odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ROWS)
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_fingerprint_values(odd):
    rows = fingerprints.with_fingerprints(odd).collect()
    got = by_text(rows, "fingerprint")
    assert got[None] == got[""] == got[" \n\t "] and len({r["fingerprint"] for r in rows if r["text"] == TEXT}) == 1
    assert len(set(got.values())) == len(got) - 2
    told = fingerprints.edited_fingerprints(odd).collect()
    assert len(told) == len(ROWS) and sorted(r["n_chars"] for r in told) == sorted(len(t or "") for _, t, _ in ROWS)
    one = fingerprints.edited_fingerprints(odd.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0  # a single row follows itself


def test_pack_values(odd):
    bpe = tokenizing.byte_bpe(tokenizing.public_path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(odd).collect()
    want = sum(len(bpe.encode(t or "")) + 1 for _, t, _ in ROWS)
    assert sum(p["length"] for p in pieces) == want and all(p["length"] == len(p["token_ids"]) for p in pieces)
    assert [p["token_ids"] for p in pieces if p["doc_id"] == 3] == [[0]] and sum(p["doc_id"] == 1 and p["start"] == 0 for p in pieces) == 2
    crc = [zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in p["token_ids"])) for p in pieces]
    assert crc == [p["ids_crc32"] for p in pieces]


def test_join_values(odd):
    rows = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["class_id"]) for r in ngram_join.jaccard_components(odd).collect()), key=str)
    short, long = TEXT.lower().split(), LONG.lower().split()
    n, m = (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for w in (short, long))
    want = [(0, 0, None, None), (0, n, None, None), (1, n, 1, 1), (1, n, 1, 1), (2, n, 1, 1), (3, 0, 3, 3), (4, 0, 4, 4), (5, 0, 5, 5), (6, m, 6, 6), (7, 1, 7, 7), (8, 1, 8, 8)]
    assert rows[: len(want)] == sorted(want, key=str) and len(rows) == len(ROWS)
    differing = odd.sparkSession.createDataFrame([(1, TEXT), (1, "other words " * 9), (2, "other words " * 9), (3, TEXT)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(differing).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}  # of the texts of an id the least counts
    kept = [r["doc_id"] for r in ngram_join.deduplicate(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, 5, None, None, 6, 7, 8, 9], key=str)


def test_chat_values(odd):
    rows = [(1, 0, "a b c d."), (1, 1, "> a b c d.\nyes"), (1, 1, "> a b c d.\nyes"), (1, 2, "> nothing said"), (1, None, "> a b c d."), (None, 0, "> a b c d."), (2, 0, None)]
    df = odd.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = chat_formatting.build_conversations(df).collect()
    assert len(got) == len(rows)
    at = {(r["conv_id"], r["turn"]): (r["reply_text"], r["reply_to"], r["depth"]) for r in got}
    assert at == {(1, 0): ("a b c d.", None, 0), (1, 1): ("yes", 0, 1), (1, 2): ("", None, 0), (1, None): ("", None, 0), (None, 0): ("", None, 0), (2, 0): ("", None, 0)}
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    import corpus_pipeline

    for t in ("documents", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    query = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert query(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    rows = odd.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.keep_good(rows).collect()}
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed <= kept
