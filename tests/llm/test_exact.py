"""The registered queries and the operators' methods, held against plain Python."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import bpe_chunks, chat_formatting, fingerprints, ngram_join, packing, quality_rules, sharding, token_counts, tokenizing

D = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE = tokenizing.public_path("byte_bpe_50k.json"), tokenizing.public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# ---- whole queries against the libraries


def test_op2_query(spark, texts):
    from docframe.llm.token_counts import op2_token_counts

    lib = tokenizing.library_tokenizer(WORD_BPE)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op2_token_counts(spark, D).collect()}
    want = {}
    for d, t in texts.items():
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want[d] = (len(t.encode()), n, n > 2048)
    assert got == want


def test_op9_query(spark, texts):
    lib = tokenizing.library_tokenizer(BYTE_BPE)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_chunks.op9_bpe(spark, D).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_op5_query(spark, texts):
    lib = tokenizing.library_tokenizer(BYTE_BPE)
    pieces = packing.op5_packing(spark, D).toPandas()
    assert set(pieces.doc_id) == set(texts)
    for d, own in pieces.groupby("doc_id"):
        ids = lib.encode(texts[d], add_special_tokens=False).ids + [0]
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        assert set(own.doc_tokens) == {len(ids)}
        crc = [zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()) for a, n in zip(own.start, own.length)]
        assert crc == own.ids_crc32.tolist()
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 1024


def test_op7_query(spark, docs, texts):
    rows = sharding.op7_sharding(spark, D).toPandas()
    assert sorted(rows.doc_id) == sorted(texts)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert rows["shard"].between(0, 39).all() and set(rows.law) == {"key"}
    assert ((rows["shard"] == rows["grown_shard"]) | (rows["grown_shard"] == 40)).all()
    for d, size, crc in zip(rows.doc_id, rows["size"], rows.text_crc32):
        assert (size, crc) == (len(texts[d].encode()) + 16, zlib.crc32(texts[d].encode()))


def test_op8_query(spark, texts):
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t).upper().lower().replace("ß", "ss").split())
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.op8_fingerprints(spark, D).collect()}
    prints = {}
    for k, d in enumerate(order):
        t, n = texts[d], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(fold(t) == fold(edited)), float(fold(t) == fold(n)))
        prints.setdefault(fold(t), set()).add(r["fingerprint"])
        prints.setdefault(fold(edited), set()).add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)


def test_op10_query(spark, docs):
    """The model's answers against naive Bayes in plain Python, over the same n-grams without hashing."""
    from docframe.llm.language_id import op10_language_id

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    out = {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1}

    def grams(t):
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            s = f" {w} "
            yield from (c for c in w)
            yield from (s[k : k + 2] for k in range(len(s) - 1))
            yield from (s[k : k + 3] for k in range(len(s) - 2))

    counts, n = {}, Counter()
    for d, t, lang in rows:
        if d not in out and lang:
            counts.setdefault(lang, Counter()).update(grams(t or ""))
            n[lang] += 1
    total = {k: sum(c.values()) + 0.5 * (1 << 15) for k, c in counts.items()}
    got = {r["doc_id"]: r for r in op10_language_id(spark, D).collect()}
    same = 0
    for d, t, _ in rows:
        score = {k: math.log(n[k] / sum(n.values())) + sum(math.log((c[g] + 0.5) / total[k]) for g in grams(t or "")) for k, c in counts.items()}
        assert got[d]["held_out"] == (d in out) and 0 <= got[d]["score"] <= 1
        same += got[d]["lang_pred"] == max(sorted(score), key=score.get)
    assert same >= 0.99 * len(rows)  # hashing may move a text between two close languages


def test_op3_query(spark, docs):
    """Scores against the compiled rules in plain Python, on statistics counted there."""
    from docframe.llm import quality_classifier as Q

    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = Q.fit_quality_model(docs, labels)
    got = {r["doc_id"]: r for r in Q.op3_quality_classifier(spark, D).collect()}
    per = lambda a, b: a / b if b else 0.0
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        upper = sum(unicodedata.category(c) == "Lu" for c in t)
        of = lambda cls: len(re.findall(cls, t))
        x = {
            "words": len(w), "word_length": per(sum(map(len, w)), len(w)), "symbols": per(of(r"[#*$%&|<>]"), len(w)), "exclaims": per(of("!"), len(w)),
            "stops": per(of("[.]"), len(w)), "commas": per(of(","), len(w)), "capitals": per(upper, len(t)), "digits": per(of("[0-9]"), len(t)),
            "non_ascii": per(len(t.encode()) - len(t), len(t)), "distinct_words": per(len(set(w)), len(w)), "words_per_line": per(len(w), len(lines)),
            "repeated_lines": per(len(lines) - len(set(lines)), len(lines)),
        }
        z = model.intercept
        for rule, weight in zip(model.rules, model.weights):
            z += weight * all((x[name] > at) == above for name, above, at in rule.terms)
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.5)


# ---- methods


@pytest.mark.parametrize("alphabet", ["ab \n'séΣ1.!  日'rvel", "a'srv ", "\n\t a", "é'l l", "... 'd'm't a", "日本語中文。", "абвг д,", "a", " "])
def test_chunk_joins_are_repaired_exactly(alphabet, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "MASK_BITS", 4)
    monkeypatch.setattr(bpe_chunks, "MIN_CHUNK", 20)
    monkeypatch.setattr(bpe_chunks, "MAX_CHUNK", 200)
    bpe, lib, rng = tokenizing.byte_bpe(BYTE_BPE), tokenizing.library_tokenizer(BYTE_BPE), random.Random(5)
    reused = repaired = 0
    for _ in range(25):
        base = "".join(rng.choice(alphabet) for _ in range(1500))
        own = [base, alphabet[:3] + base[rng.randrange(200) :], base[:700] + base[rng.randrange(710, 900) :], "", "x"]
        seen = Counter(c for t in own for c in bpe_chunks.chunks(t))
        table = {c: bpe_chunks.Chunk(bpe, c.decode(), bpe.encode(c.decode())) for c, n in seen.items() if n > 1}
        encoder = bpe_chunks.Encoder(bpe, table)
        for t in own:
            ids = encoder.encode(t)
            assert ids == lib.encode(t, add_special_tokens=False).ids
            assert bpe.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        reused, repaired = reused + encoder.reused, repaired + encoder.repaired
    if len(set(alphabet)) > 5:
        assert reused > 50 and repaired > 20


def test_chunks_are_shared_in_any_script():
    rng = random.Random(1)
    for letters in ("абвгдежз ийклмн опрст, ", "日本語中文字，。漢", "plain letters and, stops. "):
        base = "".join(rng.choice(letters) for _ in range(20_000))
        ours, theirs = set(bpe_chunks.chunks(base)), set(bpe_chunks.chunks("another beginning" + base[100:]))
        assert b"".join(bpe_chunks.chunks(base)).decode() == base
        assert len(ours & theirs) >= 0.9 * len(ours)


def test_joins_of_documents_need_repair(spark, docs, texts):
    table = bpe_chunks.shared_chunks(docs, "text", BYTE_BPE)
    bpe = tokenizing.byte_bpe(BYTE_BPE)
    assert len(table) == len({c for c, _ in table}) > 10
    encoder = bpe_chunks.Encoder(bpe, {c: bpe_chunks.Chunk(bpe, c.decode(), ids) for c, ids in table})
    for t in texts.values():
        encoder.encode(t)
    assert encoder.repaired > 10
    few = bpe_chunks.shared_chunks(docs, "text", BYTE_BPE, table_bytes=2000)
    assert sum(len(c) for c, _ in few) <= 2000  # the bound holds, and less reuse gives the same ids
    got = bpe_chunks.with_bpe(docs, table_bytes=2000, ids=False).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(bpe.encode(t)) for d, t in texts.items()}


def test_unbroken_texts_are_counted_exactly():
    tok, rng = tokenizing.library_tokenizer(WORD_BPE), random.Random(3)
    for letters in ("abcdefgh", "éΣß日'", "ab ", "x"):
        t = "".join(rng.choice(letters) for _ in range(20_000))
        assert token_counts.encode_long(tok, t, 512, 32) == tok.encode(t, add_special_tokens=False).ids
    assert token_counts.parts_at_blanks(WORD_BPE) and not token_counts.parts_at_blanks(BYTE_BPE)


def test_packing_cuts_at_boundaries_only(texts):
    bpe = tokenizing.byte_bpe(BYTE_BPE)
    ids = [np.append(bpe.encode_array(t), np.uint32(0)) for t in texts.values()]
    stream, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
    sentences = packing.sentence_ends(stream, ends, bpe.sentence_marks())
    allowed = np.union1d(np.append(sentences, 0), ends)
    cuts = packing.choose_cuts(len(stream), ends, sentences)
    for c in np.setdiff1d(cuts, allowed):  # only inside a stretch without a boundary that no window holds
        k = np.searchsorted(allowed, c)
        assert allowed[k] - allowed[k - 1] > packing.WINDOW
    assert np.diff(np.append(0, cuts)).max() <= packing.WINDOW and cuts[-1] == len(stream)


def test_packing_is_optimal_on_boundaries():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(20, 90))
        docs_ = np.unique(np.append(rng.integers(1, n, 2), n))
        sents = np.setdiff1d(np.unique(rng.integers(1, n, 6)), docs_)
        cuts = packing.choose_cuts(n, docs_, sents, window=16, each=2.0)
        marks = sorted({0, *docs_.tolist(), *sents.tolist()})
        places = sorted({*marks, *(x for a, b in zip(marks, marks[1:]) if b - a > 16 for x in range(a, b))})
        end = {p: 0.0 if p in docs_ else 4.0 if p in sents else 16.0 for p in places}
        cost = lambda a, b: (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + end[b] + 2.0
        best = {0: 0.0}
        for b in places[1:]:
            best[b] = min(best[a] + cost(a, b) for a in places if a < b <= a + 16)
        assert sum(cost(a, b) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())) == pytest.approx(best[n])


def test_sentence_ends():
    bpe = tokenizing.byte_bpe(BYTE_BPE)
    text = 'One 1.5 two. "Three!" four\nfive'
    ids = np.append(bpe.encode_array(text), np.uint32(0))
    ends = packing.sentence_ends(ids, np.array([len(ids)]), bpe.sentence_marks())
    told = [bpe.decode(ids[:k].tolist()) for k in ends if k < len(ids)]
    assert 'One 1.5 two.' in told and 'One 1.' not in told and told[-1] == 'One 1.5 two. "Three!" four\n'


def test_repeats_do_not_rest_on_the_hash(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "window_hash", lambda w: F.length(w[0]).cast("bigint"))
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("ab cd ef g h ii".split()) for _ in range(rng.randrange(40)))) for k in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.with_base_statistics(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for k, t in rows:
        w, seen = t.split(), {}
        for a in range(len(w) - 2):
            seen.setdefault(tuple(w[a : a + 3]), []).append(a)
        assert got[k] == len({a + j for at in seen.values() if len(at) > 1 for a in at for j in range(3)})


def test_slots_follow_from_seed_and_bucket(spark, docs):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    slots = []
    for parts in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = sharding.shard_documents(docs, bucket_bytes=4096).select("doc_id", "bucket", "slot").collect()
        slots.append(sorted((r["doc_id"], r["bucket"], r["slot"]) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert slots[0] == slots[1] and len({b for _, b, _ in slots[0]}) > 40


def test_buckets_are_shuffled_and_bounded(spark, docs):
    hot = spark.range(2000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("the same text " * 20).alias("text"))
    both = docs.select("doc_id", "text").unionByName(hot)
    rows = sharding.shard_documents(both, shards=4, bucket_bytes=1 << 15).toPandas()
    assert len(rows) == both.count() and all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert rows.groupby("bucket")["size"].sum().max() < (1 << 17)
    one = sharding.shard_documents(docs, shards=1, bucket_bytes=1 << 30, seed=1).toPandas().sort_values("doc_id").slot.tolist()
    assert one != sorted(one) and one != sorted(one, reverse=True)
    assert one != sharding.shard_documents(docs, shards=1, bucket_bytes=1 << 30, seed=2).toPandas().sort_values("doc_id").slot.tolist()


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_documents(docs, shards=3, bucket_bytes=1 << 16), str(tmp_path / "out"))
    import pyarrow.parquet as pq

    files = [pq.read_table(f, partitioning=None).to_pandas() for f in (tmp_path / "out").rglob("*.parquet")]
    assert sum(map(len, files)) == docs.count()
    assert all(f.bucket.nunique() == 1 and f.slot.is_monotonic_increasing for f in files)
    assert len(files) == len({b for f in files for b in f.bucket})


def test_collided_fingerprints_of_the_query(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda canon: [F.lit(1).cast("bigint"), F.lit(2).cast("bigint")])
    rows = [(1, "a b"), (2, "A  B"), (3, "c"), (4, "c"), (5, None), (6, "dd")]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    f = {d: r["fingerprint"] for d, r in got.items()}
    assert f[1] == f[2] and f[3] == f[4] and len(set(f.values())) == 4
    assert {d: r["near_next"] for d, r in got.items()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.0, 6: 0.0}
    assert {d: r["near_edited"] for d, r in got.items()} == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 0.0}


def test_quotes_in_a_hot_conversation(spark):
    """One passage that half of a conversation quotes, among others; positions are a permutation in reply order."""
    rows = [(0, 0, "The first thing said."), (0, 1, "Something else, too.")]
    rows += [(0, k, "> The first thing said.\nAnswer" if k % 2 else f"Remark {k}.") for k in range(2, 300)]
    rows += [(1, 0, "Alone."), (None, 3, "lost"), (2, None, "no turn")]
    got = chat_formatting.build_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")).toPandas()
    hot = got[got.conv_id == 0].sort_values("position")
    assert hot.position.tolist() == list(range(300))
    assert all(r == 0 for r in hot[hot.reply_text == "Answer"].reply_to)
    place = dict(zip(hot.turn, hot.position))
    assert all(place[t] > place[r] for t, r in zip(hot.turn, hot.reply_to) if r == r)
    assert hot.position.tolist() == [place[t] for t in hot.sort_values(["thread", "depth", "turn"]).turn]
    assert got[got.conv_id.isna()].position.isna().all() and len(got) == len(rows)


def test_join_frequencies_are_exact(spark, docs, texts, monkeypatch):
    """Prefixes as the definition has them: rarest first, without n-grams found in no other document."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 3000)
    answered = ngram_join._answered(ngram_join._profile(docs.select("doc_id", "text"), 5, 7)).cache()
    own = {d: set((ngram_join.ngram_set(t.encode()) >> np.uint64(24)).tolist()) for d, t in texts.items()}
    df = Counter(g for s in own.values() for g in s)
    rows = answered.where("kind = 0").collect()
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {d: len(s) for d, s in own.items()}
    classes = answered.where("kind = 0 and n_shingles > 0").selectExpr("a", "b", "doc_id as node", "n_shingles as size", "block", "place")
    got = {}
    for r in ngram_join._prefixes(answered, classes, 75).collect():
        got.setdefault(r["node"], []).append((r["pos"], r["gram"], r["df"]))
    for d, s in own.items():
        order = sorted(s, key=lambda g: (df[g], g))[: len(s) - -(-75 * len(s) // 100) + 1]
        assert sorted(got.get(d, [])) == [(k, g, df[g]) for k, g in enumerate(order) if df[g] > 1]


def test_join_with_a_passage_that_all_share(spark):
    """A long passage in unlike documents, near copies of some, and groups of copies: components as brute force has them."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    own = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))] for _ in range(120)]
    texts_ = [" ".join(w[: len(w) // 2] + passage + w[len(w) // 2 :]) for w in own]
    for k in range(0, 120, 3):
        w = texts_[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts_.append(" ".join(w))
    texts_ += [texts_[0]] * 20
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts_)]
    top = list(range(len(sets)))
    find = lambda a: a if top[a] == a else find(top[a])
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()}
    assert got == {k: find(k) for k in range(len(sets))}
