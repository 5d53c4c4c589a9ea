"""Every operator against brute force, and on odd input."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docframe.llm import bpe_chunks, chat_formatting, fingerprints, language_id, ngram_join, packing, quality_classifier
from docframe.llm import quality_rules, sharding, token_counts, tokenizing

D = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977} and more." for k in range(12_000))
SAME = "The quick brown fox jumps over the lazy dog near the old river bank today. " * 6
ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, SAME, "en"), (4, SAME, "en"), (5, SAME, None), (None, SAME, "de"),
    (6, LONG, "en"), (7, "1234 5678", "de"), (8, "x", "xx"), (9, "Ein kurzer deutscher Satz mit einigen Wörtern darin.", "de"),
    (None, None, None), (10, "<|endoftext|> special <|startoftext|> strings", "en"), (11, "é" * 3000, "fr"),
]
CLASH = {"n_words": "a", "score": "b", "shard": "c", "fingerprint": "d", "n_tokens": "e", "kept": "f", "size": "g", "slot": "h", "lang_pred": "i"}


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def deduplicate(df):
    return ngram_join.deduplicate(df)


OPERATORS = {
    "rules": quality_rules.apply_quality_rules,
    "keep_good": quality_rules.keep_good,
    "tokens": token_counts.with_token_counts,
    "quality": lambda df: quality_classifier.with_quality(df, quality_classifier.fit_rules(*_no_labels())),
    "pack": packing.pack_documents,
    "join": ngram_join.jaccard_components,
    "deduplicate": deduplicate,
    "shard": sharding.shard_documents,
    "fingerprint": fingerprints.with_fingerprints,
    "bpe": bpe_chunks.with_bpe,
    "language": lambda df: language_id.with_language(df, language_id.fit_language_model(df)),
    "chat": lambda df: chat_formatting.format_conversations(df.withColumn("turn", F.col("doc_id")), "lang", "turn"),
}


def _no_labels():
    import numpy as np

    return np.empty((0, 12)), np.empty(0), []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_input(odd, name):
    rows = OPERATORS[name](odd).collect()
    if name not in ("keep_good", "pack", "deduplicate"):
        assert len(rows) == len(ODD)
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_rules_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.with_base_statistics(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        seen, covered = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                covered |= {p + j for p in places for j in range(3)}
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert (g["n_dup_lines"], g["n_symbols"]) == (len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", r["text"])))


def test_line_rules(spark):
    bad = ["Home | About | News | Contact", "BUY NOW OUR GREAT THINGS", "a### b$$$ c%%%", "Please accept cookies to go on.", "so!! much!! noise!!"]
    good = ["A plain sentence, with a comma.", "Short.", "", "NATO met in Paris."]
    df = spark.createDataFrame([(x,) for x in bad + good], "x string")
    assert [r[0] for r in df.select(quality_rules.line_fails(F.col("x"))).collect()] == [True] * len(bad) + [False] * len(good)


def test_long_texts_resynchronise():
    tok = tokenizing.library_tokenizer(tokenizing.public_path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [LONG, "é" * 2000, " \n" * 900, "日本語" * 500, "".join(rng.choice("ab \n'séΣ1.!  ") for _ in range(4000))]
    for t in texts:
        whole = tok.encode(t, add_special_tokens=False).ids
        for chunk, overlap in ((64, 8), (300, 40), (5000, 500)):
            assert token_counts.encode_long(tok, t, chunk, overlap) == whole


def test_packing_is_lossless(spark, odd):
    bpe = tokenizing.byte_bpe(tokenizing.public_path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).toPandas()
    want = {d: bpe.encode(t or "") + [0] for d, t, _ in ODD if d is not None}
    for d, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        assert sum((list(x) for x in own.token_ids), []) == want[d]
        assert [zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in x)) for x in own.token_ids] == own.ids_crc32.tolist()
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 1024


def test_cuts_are_optimal():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(20, 90))
        docs = np.unique(np.append(rng.integers(1, n, 3), n))
        sents = np.unique(rng.integers(1, n, 8))
        sents = sents[~np.isin(sents, docs)]
        cuts = packing.choose_cuts(n, docs, sents, window=16, grid=4, each=2.0)
        places = sorted({*range(0, n, 4), *docs.tolist(), *sents.tolist()})
        end = {p: 0.0 if p in docs else 4.0 if p in sents else 16.0 for p in places}
        cost = lambda a, b: (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + end[b] + 2.0
        best = {0: 0.0}
        for b in places[1:]:
            best[b] = min(best[a] + cost(a, b) for a in places if a < b <= a + 16)
        assert sum(cost(a, b) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())) == pytest.approx(best[n])


def test_join_brute_force(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)] for _ in range(8)]
    texts = []
    for k in range(160):
        w = list(base[k % 8])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(w if k % 5 else w + base[0][:40]))
    texts += [None, "", "one two", "one two", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    top = list(range(len(texts)))
    find = lambda a: a if top[a] == a else find(top[a])
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(df).collect()}
    assert [(got[k]["n_shingles"], got[k]["component_id"]) for k in range(len(texts))] == [(len(sets[k]), find(k)) for k in range(len(texts))]
    kept = {r["doc_id"] for r in ngram_join.deduplicate(df).collect()}
    assert kept == {find(k) for k in range(len(texts))}


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, bucket_bytes=4096).withColumn("grown", sharding.shard_of(F.col("doc_id"), 41)).toPandas()
    assert len(rows) == docs.count()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert ((rows["shard"] == rows["grown"]) | (rows["grown"] == 40)).all()
    again = sharding.shard_documents(docs, bucket_bytes=4096).toPandas()
    assert rows.sort_values("doc_id").slot.tolist() == again.sort_values("doc_id").slot.tolist()


def test_fingerprints(spark):
    texts = ["Café  au lait", "café AU\nlait ", "Cafｅ́ au lait", "cafe au lait", "Straße", "STRASSE", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    f = [r["fingerprint"] for r in fingerprints.with_fingerprints(df).orderBy("doc_id").collect()]
    assert f[0] == f[1] == f[2] != f[3] and f[4] == f[5] and f[6] == f[7] and len(set(f)) == 4


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda canon: [F.lit(1).cast("bigint"), F.lit(2).cast("bigint")])
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id bigint, text string")
    f = [r["fingerprint"] for r in fingerprints.with_fingerprints(df).orderBy("doc_id").collect()]
    assert f[0] == f[2] != f[1]


def test_fingerprint_query(spark, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.op8_fingerprints(spark, D).collect()}
    for k, (d, t) in enumerate(rows):
        n, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["near_next"] == float(" ".join(t.upper().lower().split()) == " ".join(n.upper().lower().split()))


def test_classifiers_on_held_out_rows(spark, docs):
    told = language_id.op10_language_id(spark, D).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.where("lang_pred = lang").count() >= 0.97 * told.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_classifier.op3_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.95 * scored.count()


def test_conversations(spark):
    rows = [
        (1, 0, "Hello there.\nHow are you?"), (1, 1, "> Hello there.\nI am fine"), (1, 2, "> > Hello there.\n> I am fine\nGood to hear."),
        (1, 3, "On Monday, Bob wrote:\n> how ARE  you?\n\nSo so"), (1, 4, "> nothing known\nhm"), (2, 0, "> I am fine"), (1, 6, "> Hello there.\n> How are you?\nboth"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_text"], r["reply_to"], r["thread"], r["depth"]) for r in chat_formatting.format_conversations(df).collect()}
    assert got == {
        (1, 0): ("Hello there.\nHow are you?", None, 0, 0), (1, 1): ("I am fine", 0, 0, 1), (1, 2): ("Good to hear.", 1, 0, 2),
        (1, 3): ("So so", 0, 0, 1), (1, 4): ("hm", None, 4, 0), (2, 0): ("", None, 0, 0), (1, 6): ("both", 0, 0, 1),
    }


def test_partial_quotes(spark):
    note = "First line here.\nSecond line there\nThird line, yes. And a second sentence in it.\n\nNew paragraph one.\n\nLast paragraph two."
    cases = {
        "two of three lines": "> First line here.\n> Second line there\nok",
        "two of three paragraphs": "> New paragraph one.\n>\n> Last paragraph two.\nok",
        "a sentence of a line": "> And a second sentence in it.\nok",
        "wrapped anew": "> Second line there Third\n> line, yes.\nok",
        "first and third line": "> First line here.\n> [...]\n> Third line, yes. And a second sentence in it.\nok",
        "half a sentence": "> second sentence\nok",
        "chain with attribution": "> New paragraph one.\n>\n> On Mon, Ann wrote:\n>> gone\nMe too",
        "deeper level": "> edited by hand\n>> Second line there\nok",
        "not in it": "> First line there.\nok",
        "not one run": "> Second line there\n> New paragraph\nok",
        "part of a word": "> econd line ther\nok",
    }
    rows = [(k, 0, note) for k in range(len(cases))] + [(k, 1, t) for k, t in enumerate(cases.values())]
    rows += [(99, 0, "Q one\nQ two"), (99, 1, "> Q one\nMy first.\nMy second\n> Q two\nMy third"), (99, 2, "> My second\n> My third\nblock of an interleaved reply")]
    rows += [(98, 0, "Fine."), (98, 1, "It is all Fine. Really"), (98, 2, "so Fine. or"), (98, 3, "> fine.\nok"), (98, 3, "> fine.\nok"), (98, 2, "so Fine. or")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat_formatting.format_conversations(df).collect()}
    told = {name: got[k, 1] for k, name in enumerate(cases)}
    assert told == {name: None if name in ("not in it", "part of a word") else 0 for name in cases}
    assert (got[99, 1], got[99, 2], got[98, 3]) == (0, 1, 0)


def test_quotes_brute_force(spark):
    rng, rows = random.Random(7), []
    for conv in range(12):
        said: list[list[str]] = []
        for turn in range(14):
            own = [rng.choice(["a", "b", "c", "d"]) for _ in range(rng.randrange(1, 9))]
            quote: list[str] = []
            if said and rng.random() < 0.7:
                src = rng.choice(said)
                a = rng.randrange(len(src))
                quote = src[a : rng.randrange(a, len(src)) + 1]
            rows.append((conv, turn, quote, own))
            said.append(own)
    text = lambda q, own: (f"> {' '.join(q)}\n" if q else "") + " ".join(own)
    df = spark.createDataFrame([(c, t, text(q, own)) for c, t, q, own in rows], "conv_id bigint, turn bigint, text string")
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat_formatting.format_conversations(df).collect()}
    for c, t, q, own in rows:
        before = [(u, o) for d, u, _, o in rows if d == c and u < t]
        runs = [(o == q, u) for u, o in before if q and any(o[k : k + len(q)] == q for k in range(len(o)))]
        assert got[c, t] == (max(runs)[1] if runs else None)


def test_quality_stage_removes_lines(spark):
    import corpus_pipeline

    prose = [" ".join(f"w{k}x{j}" for j in range(20)) + "." for k in range(4)]
    text = "\n".join([prose[0], "Home | About | News | Contact", prose[1], "Please accept cookies to go on.", prose[2], prose[3]])
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "Home | About | News", "en", "s", 19)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = "\n".join(prose)
    got = corpus_pipeline.quality_rules(spark, df, D)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, want, "en", "s", len(want))]


def test_many_languages_are_learned(spark):
    rows = [(k, f"w{chr(0x4E00 + k)} {chr(0x4E00 + k) * 3} {chr(0x6000 + k)}", f"l{k:03d}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit_language_model(df)
    assert len(model.languages) == 600
    got = {r["lang"]: r["lang_pred"] for r in language_id.with_language(df, model).collect()}
    assert all(k == v for k, v in got.items())


def test_language_stage_rejects_unknown_languages(spark, docs):
    import corpus_pipeline

    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。", noise, "1234 5678",
    ]
    own = docs.select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(foreign)], "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    both = own.unionByName(more)
    stayed = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, D).collect()}
    assert stayed == {r["doc_id"] for r in own.collect()}
    untold = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both.withColumn("lang", F.lit(None).cast("string")), D).collect()}
    assert untold == {r["doc_id"] for r in both.collect()} - {-5}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.op1_quality_rules(spark, D).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, D).collect()} == kept
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, D).select("doc_id").distinct().collect()}
    assert packed and packed <= kept


def test_pipeline_stages_brute_force(spark, docs, tmp_path):
    import corpus_pipeline

    # English documents, copies of some with one new word, one with few words, one in letters never learned.
    rng = random.Random(2)
    base = [r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    texts = base + [base[k].replace(" ", " extra ", 1) for k in range(0, 40, 4)] + ["too short"]
    texts.append(" ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(5)) + "." for _ in range(60)))
    rows = [(k, t, "en" if k < 40 else None, "s", len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")

    def bad(line):
        n = len(line.split())
        symbols, noise, bars = (len(re.findall(c, line)) for c in (r"[#*$%&|<>]", "!", "[|›•]"))
        shout = len(line.strip()) >= 12 and any(c.isupper() for c in line) and not any(c.islower() for c in line)
        phrase = n <= 20 and any(p in line.lower() for p in quality_rules.BOILERPLATE)
        lists = n >= 60 and not re.search("[.!?:;…。]", line)
        return bool(line.strip()) and (symbols > n / 4 or (noise >= 3 and noise > n / 2) or lists or bars >= 3 or shout or phrase)

    good = {}
    for k, t in enumerate(texts):
        w, seen = t.split(), {}
        for a in range(len(w) - 2):
            seen.setdefault(tuple(w[a : a + 3]), []).append(a)
        repeats = {a + j for at in seen.values() if len(at) > 1 for a in at for j in range(3)}
        left = "\n".join(x for x in t.split("\n") if not bad(x))
        size = lambda x: len("".join(x.split()))
        if len(w) >= 50 and 2 * len(repeats) <= len(w) and 2 * size(left) >= size(t):
            good[k] = left
    told = {k: t for k, t in good.items() if not re.search("[а-я]", t)}
    sets = {k: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for k, t in told.items() for w in [t.split()]}
    top = {k: k for k in told}
    find = lambda a: a if top[a] == a else find(top[a])
    for a in told:
        for b in told:
            if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    alone = {k for k in told if find(k) == k}
    d, state, got = str(tmp_path), df, []
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, d).cache()
        got.append({r["doc_id"]: r["text"] if "text" in state.columns else None for r in state.collect()})
    assert got[0] == good and got[1] == told and set(got[2]) == alone and set(got[3]) == alone
    assert len(good) > len(told) > len(alone) > 20
    bpe = tokenizing.byte_bpe(tokenizing.public_path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: r["n"] for r in state.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {k: len(bpe.encode(told[k])) + 1 for k in alone}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").collect()} == alone
