"""Quality classifier: tree paths as conjunctive rules, lasso logistic weights, Spark column expressions.

Statistics of the whole text are made in Arrow batches; the score itself is a sum of plain column conditions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.quality_rules import SAMPLE_ROWS, training_sample
from timberline.llm.textstats import RATES, with_counts
from timberline.llm.trees import Forest, boost


@dataclass(frozen=True)
class Rule:
    """All conditions ``(feature, above, value)`` hold: the feature is above the value, or it is not."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, j] > v) == above for j, above, v in self.conditions])

    def column(self, features: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [features[RATES[j]] > F.lit(v) if above else features[RATES[j]] <= F.lit(v) for j, above, v in self.conditions])


def rules_of(forest: Forest) -> list[Rule]:
    """Every path from a root to a node as a rule, without repeats. A path keeps the tightest of its limits per feature and side."""
    found: dict[Rule, None] = {}

    def walk(node: int, limits: dict[tuple[int, bool], float]) -> None:
        if limits:
            found[Rule(tuple(sorted((j, above, v) for (j, above), v in limits.items())))] = None
        if forest.left[node] == node:
            return
        j, v = int(forest.feature[node]), float(forest.at[node])
        walk(int(forest.left[node]), limits | {(j, False): min(v, limits.get((j, False), np.inf))})
        walk(int(forest.right[node]), limits | {(j, True): max(v, limits.get((j, True), -np.inf))})

    for root in forest.roots:
        walk(int(root), {})
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic loss with an absolute penalty on the weights, by accelerated proximal steps."""
    n, m = x.shape
    w, b = np.zeros(m), 0.0
    if not n:
        return w, b
    seen, prior, k = np.zeros(m), 0.0, 1.0
    # The largest eigenvalue of x'x / 4n, by a few power steps, bounds the curvature.
    v = np.ones(m + 1) / np.sqrt(m + 1)
    x1 = np.hstack([x, np.ones((n, 1))])
    for _ in range(20):
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (np.linalg.norm(x1 @ v) ** 2 / (4 * n) + 1e-9)
    for _ in range(steps):
        nxt = (1 + np.sqrt(1 + 4 * k * k)) / 2
        z, c = w + (k - 1) / nxt * (w - seen), b + (k - 1) / nxt * (b - prior)
        error = 1 / (1 + np.exp(-(x @ z + c))) - y
        seen, prior, k = w, b, nxt
        w = z - rate * (x.T @ error) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b = c - rate * error.mean()
    return w, float(b)


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: np.ndarray
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            margin += w * rule.holds(x)
        return 1 / (1 + np.exp(-margin))

    def column(self, features: dict[str, Column]) -> Column:
        """The score between 0 and 1 as one column expression."""
        margin = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            margin = margin + F.when(rule.column(features), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, trees: int = 30, seed: int = 1) -> RuleEnsemble:
    """Rules from boosted trees on halves of the sample, and the weights that the lasso leaves standing."""
    rules = rules_of(boost(x, y, trees=trees, depth=3, share=0.5, seed=seed))
    if not rules:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleEnsemble([], np.zeros(0), float(np.log(p / (1 - p))))
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    w, b = lasso_logistic(held, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[k] for k in kept], w[kept], b)


def rate_columns() -> dict[str, Column]:
    """``RATES`` as expressions over the columns ``COUNTS``; the same arithmetic as ``textstats.rates``."""
    c = lambda name: F.col(name).cast("double")
    some = lambda x: F.greatest(x, F.lit(1.0))
    words, chars, lines, letters = some(c("n_words")), some(c("word_chars")), some(c("n_lines")), some(c("n_upper") + c("n_lower"))
    found = [
        F.log1p(c("n_words")), c("word_chars") / words, c("n_symbols") / words, c("n_dup_lines") / lines, c("n_repeat_words") / words,
        c("n_distinct_words") / words, c("n_upper") / letters, c("n_digits") / chars, c("n_marks") / words, c("n_ends") / words, c("n_words") / lines,
    ]
    return dict(zip(RATES, found))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train_ensemble(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fitted to at most ``most`` labelled rows outside ``held_out``; their text statistics are the only inputs."""
    return fit_rules(*training_sample(docs, labels.filter(~held_out(F.col("doc_id"))), most))


def classify(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null or empty text is scored by its zero statistics. Rows that repeat an id are scored one by one; a null id is
    kept and not held out. Other columns are ignored. ``predicted`` is 1 from ``threshold`` on. An empty table gives an empty table.
    """
    counts = with_counts(docs)
    # The rates are made once per row, below the conditions that use them again and again.
    features = counts.select("doc_id", *[c.alias(name) for name, c in rate_columns().items()])
    scored = features.select("doc_id", model.column({name: F.col(name) for name in RATES}).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train_ensemble(docs, table(spark, sf_dir, "labels")))
