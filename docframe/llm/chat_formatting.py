"""Chat formatting by quotation linking, on SQL functions only.

1. *Parse.* A line's quote level is the number of leading ``>`` marks (blanks between them do not count). Runs of
   lines of one level are passages; attribution lines ("... wrote:") before a deeper level are removed from each. A
   message's own text is what is left of its lines of level 0.
2. *Hash.* Texts are normalised (lower case, white space folded) to words. A quoted passage is known by the hash of
   its words, and so are its paragraphs, lines and sentences, for quotes with something left out or added. A seed, the
   hash of its first 1, 2 or 4 words, finds the places of earlier messages where it may begin.
3. *Link.* Seeds are joined on (conversation, seed) to every word of the messages; for each length asked there, the
   run of that many words is hashed and joined exactly. So any contiguous run of words is found, however its lines
   are wrapped. Of what is found the lowest quote level counts, then the whole passage before its paragraphs and
   those before its lines and sentences, then runs that begin and end with a line or sentence before others (parts of
   a passage must do so); of these the latest message is the one replied to. A message without a quote that is found
   replies to nothing and starts a thread.
4. *Order.* Threads follow from the links by pointer doubling (written each round); a conversation is ordered by the
   thread's first turn, then depth, then turn, so every reply stands after what it answers, without quotes. Its
   messages are sorted and numbered by ranges, so a conversation may span any number of tasks.

Joins are on conversation and hash, so a hot conversation is spread over its hashes; nothing is gathered by
conversation, and equal quotes ask once. Words are kept, by message, only of conversations with a quote.

Defined results for odd input
-----------------------------
* null text: an empty message; a message of quotes alone has an empty ``reply_text``;
* null conversation or turn: the message is kept, links to nothing, and has thread and depth of its own;
* repeated (conversation, turn): each row is kept; links go by turn, so such rows share thread and depth;
* the same passage in several earlier messages: the latest is meant; a quote of a later message does not count;
* ties in the order (rows of one conversation and turn) go by text, and null conversations have no positions;
* an empty table gives an empty table; other columns stay, those named as a result in any case are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.text import column_of, restored, unnamed
from docframe.runtime import write_stage

#: Words of the seeds that find where a quote may begin.
SEED_WORDS = (1, 2, 4)
#: Where a line or a sentence ends.
UNIT_END = "[\\n\\r\\x0B\\x0C]+|(?<=[.!?…][\"')\\]”’»]{0,2})[ \\t]+|(?<=[。！？])"


def quote_level(line: Column) -> Column:
    """Number of quote marks a line begins with."""
    head = F.regexp_extract(line, "^((?:[ \\t]*>)*)", 1)
    return F.length(F.regexp_replace(head, "[ \\t]", ""))


def unquoted(line: Column) -> Column:
    """The line without its marks and the blank after the last."""
    return F.when(quote_level(line) > 0, F.regexp_replace(line, "^(?:[ \\t]*>)+[ ]?", "")).otherwise(line)


def normalised(text: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")))


def with_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_quotes`` (quoted passages as level and text), ``max_quote_level`` and ``reply_text``.

    A text without any ``>`` is its own reply and is not parsed.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    quoted = t.contains(">") & t.rlike("(?m)^[ \\t]*>")
    # Lines as structs of level and text, the lines that begin a run of one level, and the runs: each line is copied once.
    lines = F.transform(
        F.split(F.regexp_replace(t, "\\r\\n?", "\n"), "\n"), lambda x: F.struct(quote_level(x).alias("level"), unquoted(x).alias("text"))
    )
    df = df.withColumn("_lines", F.when(quoted, lines))
    level = lambda i: F.get(F.col("_lines"), i)["level"]
    heads = F.filter(F.transform("_lines", lambda _, i: i), lambda i: (i == 0) | (level(i) != level(i - 1)))
    df = df.withColumn("_heads", heads)
    stop = lambda k: F.coalesce(F.get(F.col("_heads"), k + 1), F.size("_lines"))
    body = lambda i, k: F.array_join(F.transform(F.slice(F.col("_lines"), i + 1, stop(k) - i), lambda x: x["text"]), "\n")
    df = df.withColumn("_runs", F.transform("_heads", lambda i, k: F.struct(level(i).alias("level"), body(i, k).alias("text"))))
    runs = F.col("_runs")
    own = F.filter(runs, lambda r: r["level"] == 0)
    deeper_next = lambda r, i: F.coalesce(F.get(runs, i + 1)["level"] > r["level"], F.lit(False))
    trimmed = F.transform(
        runs, lambda r, i: F.struct(r["level"].alias("level"), F.when(deeper_next(r, i), _without_attribution(r["text"])).otherwise(r["text"]).alias("text"))
    )
    df = df.withColumn("_trimmed", trimmed)
    own_texts = F.transform(F.filter("_trimmed", lambda r: r["level"] == 0), lambda r: r["text"])
    quotes = F.filter("_trimmed", lambda r: (r["level"] > 0) & (F.length(normalised(r["text"])) > 0))
    reply = F.when(quoted, F.btrim(F.array_join(own_texts, "\n"), F.lit(" \t\n\r"))).otherwise(t)
    return df.withColumns(
        {
            "_quotes": F.when(quoted, F.array_distinct(quotes)).otherwise(F.array().cast("array<struct<level:int,text:string>>")),
            "n_quotes": F.when(quoted, F.size(runs) - F.size(own)).otherwise(F.lit(0)).cast("long"),
            "max_quote_level": F.when(quoted, F.array_max(F.transform(runs, lambda r: r["level"]))).otherwise(F.lit(0)).cast("int"),
            "reply_text": reply,
        }
    ).drop("_lines", "_heads", "_runs", "_trimmed")


def _without_attribution(text: Column) -> Column:
    """The text without a last line that says who wrote what follows."""
    return F.regexp_replace(text, "(?i)(?:^|\\n)[^\\n]{0,200}\\b(?:wrote|writes|schrieb|escribió|a écrit)[ ]?:[ \\t]*\\n?\\s*\\z", "")


def word_runs(text: Column) -> Column:
    """array<struct<word string, first boolean>>: normalised words, and whether each begins a line or a sentence."""
    units = F.filter(F.transform(F.split(text, UNIT_END), normalised), lambda u: F.length(u) > 0)
    return F.flatten(
        F.transform(units, lambda u: F.transform(F.split(u, " "), lambda w, i: F.struct(w.alias("word"), (i == 0).alias("first"))))
    )


def _seed(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k)["word"] for k in range(size)])


def _digest(words: Column) -> Column:
    return F.sha2(F.array_join(F.transform(words, lambda w: w["word"]), " "), 256)


def quoted_pieces(quote: Column) -> Column:
    """array<struct<level, grain, text>> of a quoted passage: itself (0), its paragraphs (1), lines and sentences (2)."""
    text = quote["text"]
    paragraphs = F.split(text, "\\n[ \\t]*\\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, "\\n", " "), UNIT_END)))
    graded = lambda parts, g: F.transform(parts, lambda t: F.struct(quote["level"].alias("level"), F.lit(g).alias("grain"), t.alias("text")))
    return F.concat(graded(F.array(text), 0), graded(paragraphs, 1), graded(F.split(text, "\\n"), 2), graded(sentences, 2))


def link_replies(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, reply_to): for each message with a quote that is found, the latest earlier turn it quotes."""
    parts = with_parts(df.select(conv, turn, text), text).where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    quotes = (
        parts.select(conv, turn, F.explode("_quotes").alias("_q")).select(conv, turn, F.explode(quoted_pieces(F.col("_q"))).alias("_q"))
        .select(conv, F.col(turn).alias("_at"), "_q.level", "_q.grain", word_runs(F.col("_q.text")).alias("_words"))
    )
    n, first = F.size("_words"), F.lit(0)
    size = F.when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
    seed = F.when(n >= 4, _seed(F.col("_words"), first, 4)).when(n >= 2, _seed(F.col("_words"), first, 2)).otherwise(_seed(F.col("_words"), first, 1))
    quotes = quotes.where(n > 0).select(
        conv, "_at", "level", "grain", n.alias("_n"), size.alias("_size"), seed.alias("_seed"), _digest(F.col("_words")).alias("_exact")
    )
    quotes = write_stage(quotes, "chat-quotes")  # only messages that quote: small beside the texts
    known = write_stage(
        parts.join(quotes.select(conv).distinct(), conv, "left_semi")
        .select(conv, F.col(turn).alias("_of"), F.sha2("reply_text", 256).alias("_id"), "reply_text").dropDuplicates([conv, "_of", "_id"])
        .select(conv, "_of", "_id", word_runs(F.col("reply_text")).alias("_words")),
        "chat-known",
    )
    words = F.col("_words")
    seeds = F.flatten(
        F.transform(
            words,
            lambda w, i: F.filter(
                F.array(*[F.struct(i.alias("_start"), F.lit(k).alias("_size"), _seed(words, i, k).alias("_seed")) for k in SEED_WORDS]),
                lambda x: x["_start"] + x["_size"] <= F.size(words),
            ),
        )
    )
    begun = known.select(conv, "_of", "_id", F.size(words).alias("_total"), F.explode(seeds).alias("_s")).select(conv, "_of", "_id", "_total", "_s.*")
    asked = quotes.select(conv, "_size", "_seed", "_n").distinct()
    hits = begun.join(asked, [conv, "_size", "_seed"]).where(F.col("_start") + F.col("_n") <= F.col("_total")).select(conv, "_of", "_id", "_start", "_n")
    end = F.col("_start") + F.col("_n")
    marked = hits.join(known, [conv, "_of", "_id"]).select(
        conv, _digest(F.slice(words, F.col("_start") + 1, F.col("_n"))).alias("_exact"), "_of",
        (F.get(words, F.col("_start"))["first"] & F.coalesce(F.get(words, end)["first"], F.lit(True))).alias("_whole"),
    ).distinct()
    # One list of turns for each (conversation, passage) could be as long as the conversation: instead both sides are
    # ordered together, and a quote takes the last turn that stands before it.
    none = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    marked = marked.select(conv, "_exact", F.col("_of").alias("_at"), "_of", F.when(F.col("_whole"), F.col("_of")).alias("_sure"), none("level", quotes), none("grain", quotes), F.lit(1).alias("_kind"))
    asks = quotes.select(conv, "_exact", "_at", none("_of", known), none("_of", known).alias("_sure"), "level", "grain", F.lit(0).alias("_kind"))
    order = Window.partitionBy(conv, "_exact").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    found = marked.unionByName(asks).withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("_of", "_sure")}).where("_kind = 0")
    rank = lambda loose, of: F.struct((-F.col("level")).alias("level"), (-F.col("grain")).alias("grain"), F.lit(-loose).alias("loose"), F.col(of).alias("of"))
    best = F.when(F.col("_sure").isNotNull(), rank(0, "_sure")).when(F.col("_of").isNotNull() & (F.col("grain") == 0), rank(1, "_of"))
    return found.groupBy(conv, F.col("_at").alias(turn)).agg(F.max(best).alias("_best")).where("_best is not null").select(
        conv, turn, F.col("_best.of").alias("reply_to")
    )


def thread_links(links: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, thread, depth) of messages that reply, by pointer doubling."""
    state = links.select(conv, turn, F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"))
    while True:
        state = write_stage(state, "chat-threads")
        up = state.select(conv, F.col(turn).alias("thread"), F.col("thread").alias("_thread"), F.col("depth").alias("_depth"))
        if not state.join(up, [conv, "thread"], "left_semi").take(1):
            return state
        state = state.join(up, [conv, "thread"], "left").select(
            conv, turn, F.coalesce("_thread", "thread").alias("thread"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")
        )


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """All messages with reply_text, reply_to, thread, depth, n_quotes and max_quote_level.

    Ordering a conversation by (thread, depth, turn) puts each reply after what it answers.
    """
    return restored(_formatted(unnamed(df), *[column_of(df, c) for c in (conv, turn, text)]), df.columns, MADE)


MADE = ["reply_text", "reply_to", "thread", "depth", "n_quotes", "max_quote_level"]


def _formatted(df: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    links = write_stage(link_replies(df, conv, turn, text), "chat-links")
    threads = links.join(thread_links(links, conv, turn), [conv, turn])
    small = F.broadcast(threads) if threads.count() <= 200_000 else threads
    got = with_parts(df, text).drop("_quotes").join(small, [conv, turn], "left")
    return got.withColumns({"thread": F.coalesce("thread", F.col(turn)), "depth": F.coalesce("depth", F.lit(0)).cast("long")})


def build_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """All messages as :func:`format_conversations` has them, with their ``position`` (from 0) in their conversation,
    in reply order.

    Messages are sorted by ranges of (conversation, order); only conversations that go over the edge of a range, two
    for each range at most, are looked up to number on.
    """
    conv_, turn_, text_ = (column_of(df, c) for c in (conv, turn, text))
    order = [F.col(c) for c in ("thread", "depth", turn_, text_)]
    got = _formatted(unnamed(df), conv_, turn_, text_)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = write_stage(got.repartitionByRange(parts, F.col(conv_), *order).withColumn("_part", F.spark_partition_id()), "chat-ordered")
    own = got.where(F.col(conv_).isNotNull()).groupBy(conv_, "_part").agg(F.count("*").alias("_n"))
    over = own.groupBy(conv_).agg(F.count("*").alias("_parts")).where("_parts > 1").select(conv_)
    earlier = Window.partitionBy(conv_).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = own.join(F.broadcast(over), conv_, "left_semi").select(conv_, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begun"))
    here = F.row_number().over(Window.partitionBy("_part", conv_).orderBy(*order)) - 1
    got = got.withColumn("_here", here).join(F.broadcast(begun), [conv_, "_part"], "left")
    position = F.when(F.col(conv_).isNotNull(), F.col("_here") + F.coalesce("_begun", F.lit(0))).cast("long")
    return restored(got.withColumn("position", position), df.columns, [*MADE, "position"])


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Whole ``conversations``."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return build_conversations(chats).select("conv_id", "turn", "role", *MADE, "position")
