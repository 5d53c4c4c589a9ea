"""Quality classifier: a sparse rule ensemble over text statistics, compiled into column expressions.

1. Statistics of a text are column expressions (:func:`statistics`); no Python touches the corpus.
2. Shallow trees are grown on random halves of a bounded, labelled sample; each path from a root to any node is a
   conjunctive rule.
3. A logistic model with an L1 penalty (accelerated proximal steps) keeps a few rules.
4. The kept rules become ``when`` expressions whose weighted sum goes through a logistic function.

The sample's bound is ``max_training_docs`` rows, chosen by a hash of the id. It is the only data that reaches the
driver (one row of numbers for each document). Scoring is a projection: no shuffle, nothing collected.

Defined results for odd input
-----------------------------
* null or empty text: all statistics 0, scored like any other row;
* no labelled row (an empty table, too), or one class only: the score is the smoothed share of label 1;
* null labels are not learned; repeated rows get the same score; a tie at 0.5 predicts 1;
* whole texts are measured; input columns of the added names, in any case, are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.text import SPACES, column_of, held_out, restored, unnamed, words

#: Bound of the training sample in documents.
MAX_TRAINING_DOCS = 20_000
TREES, DEPTH, THRESHOLDS = 24, 3, 24
PENALTY = 2e-3


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "_s_") -> tuple[DataFrame, list[str]]:
    """Add one double column for each statistic; give their names without the prefix."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns(
        {"_w": words(F.col(text)), "_l": F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)}
    )
    n_chars, n_words, n_lines = F.length(t), F.size("_w"), F.size("_l")
    count = lambda cls: F.length(t) - F.length(F.regexp_replace(t, cls + "+", ""))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    made = {
        "words": n_words.cast("double"),
        "word_length": per(F.length(F.array_join("_w", "")), n_words),
        "symbols": per(count("[#*$%&|<>]"), n_words),
        "exclaims": per(count("[!]"), n_words),
        "stops": per(count("[.]"), n_words),
        "commas": per(count("[,]"), n_words),
        "capitals": per(count("\\p{Lu}"), n_chars),
        "digits": per(count("[0-9]"), n_chars),
        "non_ascii": per(F.octet_length(t) - n_chars, n_chars),
        "distinct_words": per(F.size(F.array_distinct("_w")), n_words),
        "words_per_line": per(n_words, n_lines),
        "repeated_lines": per(n_lines - F.size(F.array_distinct("_l")), n_lines),
    }
    df = df.withColumns({prefix + k: v.cast("double") for k, v in made.items()})
    return df.drop("_w", "_l"), list(made)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_above, threshold): value > threshold, or value <= threshold."""

    terms: tuple[tuple[str, bool, float], ...]

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, at in self.terms:
            v = x[:, names.index(name)]
            out &= (v > at) if above else (v <= at)
        return out

    def column(self, prefix: str) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            c = F.col(prefix + name)
            out = out & ((c > F.lit(float(at))) if above else (c <= F.lit(float(at))))
        return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int) -> set[tuple]:
    """Paths of one tree, as sorted tuples of terms."""
    paths: set[tuple] = set()

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            paths.add(path)
        p = y[rows].mean()
        if not left or len(rows) < 10 or p in (0.0, 1.0):
            return
        best = (1e-9, None)
        for f in rng.choice(len(names), size=max(2, len(names) // 2), replace=False):
            v = x[rows, f]
            cuts = np.unique(np.quantile(v, np.linspace(0.02, 0.98, THRESHOLDS)))
            below = v[:, None] <= cuts[None, :]
            n = below.sum(axis=0)
            ok = (n > 0) & (n < len(rows))
            if not ok.any():
                continue
            ones = (below & (y[rows] == 1)[:, None]).sum(axis=0)
            total, all_ones = len(rows), y[rows].sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = ones / n, (all_ones - ones) / (total - n)
                gain = p * (1 - p) - (n * a * (1 - a) + (total - n) * b * (1 - b)) / total
            gain[~ok] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float(cuts[k])))
        if best[1] is None:
            return
        f, at = best[1]
        high = x[rows, f] > at
        split(rows[~high], (*path, (names[f], False, at)), left - 1)
        split(rows[high], (*path, (names[f], True, at)), left - 1)

    split(np.arange(len(y)), (), depth)
    return paths


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression; the intercept is free."""
    n, m = z.shape
    a = np.hstack([z, np.ones((n, 1))])
    rate = 4.0 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(m + 1)
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ ahead, -30, 30)))
        new = ahead - rate * (a.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0.0)
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / nxt * (new - w)
        moved, w, momentum = np.abs(new - w).max(), new, nxt
        if moved < 1e-7:
            break
    return w[:m], float(w[m])


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, prefix: str = "_s_") -> Column:
        """The probability of label 1 as a column over statistics with ``prefix``."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(rule.column(prefix), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 3) -> RuleEnsemble:
    """Learn from plain numbers; deterministic for a seed and an order of rows."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    paths: set[tuple] = set()
    for _ in range(TREES):
        rows = rng.random(len(y)) < 0.5
        if rows.sum() >= 10 and y[rows].min() != y[rows].max():
            paths |= _grow(x[rows], y[rows], names, rng, DEPTH)
    rules, masks, seen = [], [], set()
    for path in sorted(paths, key=lambda p: (len(p), p)):
        rule = Rule(path)
        m = rule.mask(x, names)
        if 0 < m.sum() < len(y) and (key := m.tobytes()) not in seen:
            seen.add(key)
            rules.append(rule)
            masks.append(m)
    if not rules:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    w, b = _lasso_logistic(np.array(masks, dtype=np.float64).T, y.astype(float), PENALTY)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[k] for k in keep], [float(w[k]) for k in keep], b)


def fit_quality_model(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_training_docs: int = MAX_TRAINING_DOCS,
) -> RuleEnsemble:
    """Learn from at most about ``max_training_docs`` labelled rows that are not held out."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    n = known.count()
    if n > max_training_docs:
        share = F.pmod(F.xxhash64(F.col("_id"), F.lit(3)), F.lit(1 << 40))
        known = known.where(share < int(max_training_docs / n * (1 << 40)))
    # Rows of 16 bytes, about max_training_docs of them by the lines above: always small enough to broadcast.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(known), "_id")
    rows, names = with_statistics(rows, "_t")
    got = rows.select("_id", "_y", *["_s_" + k for k in names]).toPandas().sort_values("_id")
    return fit_rules(got[["_s_" + k for k in names]].to_numpy(), got["_y"].to_numpy(), names)


def with_quality(df: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """Add score (double) and predicted (int)."""
    rows, _ = with_statistics(unnamed(df), column_of(df, text))
    rows = rows.withColumn("score", model.score())
    return restored(rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), df.columns, ["score", "predicted"])


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``; learned from ``labels.quality`` of rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).select(
        "doc_id", "held_out", "score", "predicted"
    )
