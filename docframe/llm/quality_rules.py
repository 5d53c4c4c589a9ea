"""Quality rules, line first: lines are judged by punctuation, navigation and boilerplate rules; a document
that loses too much of its text with them is rejected.

Everything is a column expression (no shuffle, no Python): one pass over the text, per row, so neither hot
sources nor groups of copies matter, and memory is bounded by one document.

Defined results for odd input
-----------------------------
* null or blank text: no words, all counts 0, ``base_failed`` true, ``kept`` false, ``clean_text`` empty;
* nulls in other columns, repeated rows and ties: each row is judged on its own text and passed through;
* very long texts: judged whole, no prefix; the bits for positions in the window sort follow the word count;
* an empty table gives an empty table;
* columns of the input keep their values; added columns replace input columns of the same name in any case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.text import SPACE_CLASS, SPACES, column_of, restored, unnamed, words

#: Symbols counted by the base statistics.
SYMBOL_CLASS = "[#*$%&|<>]"
#: Phrases of page furniture, matched case-insensitively inside a line of at most ``boilerplate_words`` words.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "log in", "lorem ipsum", "privacy policy", "read more", "sign up", "subscribe to", "terms of service", "terms of use",
    "aceptar cookies", "iniciar sesión", "política de privacidad", "todos los derechos reservados",
    "accepter les cookies", "lire la suite", "politique de confidentialité", "tous droits réservés",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen",
)


#: The phrases; looking at the first letter spares most positions the trial of all phrases.
_PHRASE = f"(?iu)(?=[{''.join(sorted({p[0] for p in BOILERPLATE}))}])(?:{'|'.join(BOILERPLATE)})"


@dataclass(frozen=True)
class LineRules:
    """Thresholds; all are per line but ``min_retention`` and the base limits."""

    max_symbol_word_ratio: float = 0.25  # symbols for each word
    min_bars: int = 3  # separators that make a line navigation
    max_exclaim_word_ratio: float = 0.5  # exclamation marks for each word
    min_shout_letters: int = 12  # shortest line that counts as shouted when it has no lower case
    unpunctuated_words: int = 60  # a line this long without any sentence end is a list, not prose
    boilerplate_words: int = 20
    min_retention: float = 0.5  # share of the text's word characters that must stay
    min_words: int = 50
    max_repeat_percent: int = 50


def _count(text: Column, one_char_class: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, one_char_class + "+", ""))


def line_parts(line: Column) -> Column:
    """What several rules ask of a line, so that it is found once: the line, without blanks at its ends, its words."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.struct(line.alias("line"), bare.alias("bare"), F.size(F.split(bare, SPACE_CLASS + "+")).alias("n_words"))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True if one line breaks a punctuation, navigation or boilerplate rule. Blank lines do not fail."""
    return _parts_fail(line_parts(line), rules)


def _parts_fail(parts: Column, rules: LineRules) -> Column:
    line, bare, n_words = (parts[name] for name in ("line", "bare", "n_words"))
    symbols = _count(line, SYMBOL_CLASS)
    exclaims = _count(line, "[!]")
    bars = _count(line, "[|›•]")
    punctuation = (
        (symbols > rules.max_symbol_word_ratio * n_words)
        | ((exclaims >= 3) & (exclaims > rules.max_exclaim_word_ratio * n_words))
        | ((n_words >= rules.unpunctuated_words) & ~line.rlike("[.!?:;…。]"))
    )
    navigation = bars >= rules.min_bars
    shouted = (
        (F.length(bare) >= rules.min_shout_letters) & ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}")
    )
    phrase = (n_words <= rules.boilerplate_words) & line.rlike(_PHRASE)
    return (F.length(bare) > 0) & (punctuation | navigation | shouted | phrase)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def window_hash(words: list[Column]) -> Column:
    """64 bits that stand for a window of words while equal ones are looked for."""
    return F.xxhash64(*words)


def _statistics(df: DataFrame, at: str) -> DataFrame:
    """The base statistics of the text in column ``at``.

    A word counts as repeated if some window of three words that holds it occurs twice or more in the text. Windows
    are hashed; only where a text has equal hashes, hash and position are packed into one long, sorted, and neighbours
    compared: n log n in the text's words. The low bits hold the position and take as many bits as the word count
    needs. Neighbours that look alike are compared word by word; where two are not alike after all, the text's windows
    are sorted with their words instead, so the count is exact.
    """
    t = F.coalesce(F.col(at), F.lit(""))
    df = df.withColumn("_words", words(F.col(at)))
    word = lambda i: F.get(F.col("_words"), i.cast("int"))
    window = lambda i: [word(i), word(i + 1), word(i + 2)]
    windows = F.when(
        F.size("_words") >= 3,
        F.transform(F.slice(F.col("_words"), F.lit(1), F.size("_words") - 2), lambda w, i: window_hash([w, word(i + 1), word(i + 2)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_windows", windows).withColumn(
        "_repeats", F.size("_windows") != F.size(F.array_distinct("_windows"))
    )
    df = df.withColumn("_bits", F.length(F.bin(F.size("_windows"))))
    df = df.withColumn("_low", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    high = lambda h: h.bitwiseAND(F.bitwise_not(F.col("_low")))
    packed = F.sort_array(F.transform("_windows", lambda h, i: F.coalesce(high(h).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))))
    df = df.withColumn("_packed", F.when(F.col("_repeats"), packed))
    place = lambda x: F.coalesce(x.bitwiseAND(F.col("_low")), F.lit(0).cast("long"))
    near = lambda a, k: F.get(F.col(a), k)

    def meets(x: Column, y: Column) -> Column:
        """Of two neighbours: 0 if they do not look alike, 1 if they are equal, 2 if they only look so."""
        p, q = place(x), place(y)
        equal = (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))
        alike = F.call_function("shiftright", x.bitwiseXOR(y), F.col("_bits")) == 0
        return F.when(alike, F.when(equal, 1).otherwise(2)).otherwise(0)

    df = df.withColumn("_met", F.transform(F.col("_packed"), lambda x, i: meets(x, near("_packed", i + 1))))
    met = lambda i: F.coalesce(near("_met", i) == 1, F.lit(False))
    twice = F.filter(F.col("_packed"), lambda x, i: met(i) | met(i - 1))
    df = df.withColumn("_unlike", F.coalesce(F.array_contains("_met", 2), F.lit(False)))
    spelled = F.sort_array(F.transform("_windows", lambda _, i: F.struct(*[w.alias(f"w{k}") for k, w in enumerate(window(i))], i.cast("long").alias("i"))))
    df = df.withColumn("_spelled", F.when(F.col("_unlike"), spelled))
    same = lambda x, y: F.coalesce((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))
    spelled_twice = F.filter(F.col("_spelled"), lambda x, i: same(x, near("_spelled", i - 1)) | same(x, near("_spelled", i + 1)))
    positions = F.when(F.col("_unlike"), F.transform(spelled_twice, lambda x: x["i"])).otherwise(F.transform(twice, place))
    df = df.withColumn("_at", F.when(F.col("_repeats"), F.sort_array(positions)))
    covered = F.aggregate(
        F.transform(F.col("_at"), lambda p, i: F.least(F.lit(3).cast("long"), F.get(F.col("_at"), i + 1) - p)),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    lines = F.split(t, "\n")
    df = df.withColumn("_lines", F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count(t, SYMBOL_CLASS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long"),
        }
    ).drop("_words", "_windows", "_repeats", "_bits", "_low", "_packed", "_met", "_unlike", "_spelled", "_at", "_lines")


def with_base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    return restored(_statistics(unnamed(df), column_of(df, text)), df.columns, BASE)


def apply_quality_rules(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Judge every document; all input columns stay.

    Adds the base statistics, ``base_failed``, ``clean_text`` (lines that passed, joined again), ``n_lines``,
    ``n_bad_lines``, ``retention`` (share of word characters left) and ``kept``.
    """
    return restored(_judged(unnamed(df), column_of(df, text), rules), df.columns, MADE)


MADE = [*BASE, "base_failed", "clean_text", "n_lines", "n_bad_lines", "retention", "kept"]


def _judged(df: DataFrame, at: str, rules: LineRules) -> DataFrame:
    columns = df.columns
    df = _statistics(df, at)
    base_failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    lines = F.split(F.coalesce(F.col(at), F.lit("")), "\n")
    df = df.withColumn("base_failed", base_failed)
    df = df.withColumn("_all_lines", lines).withColumn(
        "_good", F.transform(F.filter(F.transform("_all_lines", line_parts), lambda x: ~_parts_fail(x, rules)), lambda x: x["line"])
    )
    df = df.withColumns(
        {
            "clean_text": F.array_join("_good", "\n"),
            "n_lines": F.size("_all_lines").cast("long"),
            "n_bad_lines": (F.size("_all_lines") - F.size("_good")).cast("long"),
        }
    )
    kept_chars = F.length(F.regexp_replace("clean_text", SPACE_CLASS + "+", ""))
    df = df.withColumn(
        "retention",
        F.when(F.col("word_chars") > 0, kept_chars / F.col("word_chars")).otherwise(F.lit(0.0)),
    )
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("retention") >= rules.min_retention))
    # The optimizer moves a filter on a result below the steps it is made of and writes each step out again wherever
    # it is used; it does not move one below the generator that its column comes from.
    return df.select(*columns, F.explode(F.array(F.struct(*MADE))).alias("_made")).select(*columns, "_made.*")


def keep_good(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), cleaned: bool = False) -> DataFrame:
    """The rows that the rules keep, with the input's columns; if ``cleaned``, the text (and ``n_chars``) without failed lines."""
    at = column_of(df, text)
    good = _judged(unnamed(df), at, rules).where("kept")
    new = {at: F.col("clean_text")} if cleaned else {}
    for k, c in enumerate(df.columns):
        if cleaned and c.lower() == "n_chars":
            new[f"_c{k}"] = F.length("clean_text").cast(df.schema[k].dataType)
    return good.select(*[new.get(f"_c{k}", F.col(f"_c{k}")).alias(c) for k, c in enumerate(df.columns)])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Digest of :func:`apply_quality_rules` over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_bad_lines", F.round("retention", 6).alias("retention"),
    )
