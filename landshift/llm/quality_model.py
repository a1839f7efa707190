"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on statistics of labelled texts; every path from a root to a node is a
conjunctive rule.  A logistic model with a lasso penalty weighs the rules, most weights
become zero, and what is left is compiled to one Spark column expression over the
statistics, which scores every document.

The labelled sample is bounded (SAMPLE rows, those with the smallest hash of doc_id), so the
fit runs on the driver over SAMPLE x len(STATISTICS) numbers; statistics and scores are
computed for all documents.

Defined cases: a null or empty text has statistics of zero and the score of those; without
labels, or with labels of one class, the score is the smoothed share of label 1; a document
that is labelled twice counts once, with the larger label; repeated rows are scored each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.llm.common import fresh, map_rows, map_texts, texts, trained_on
from landshift.llm.quality_rules import PUNCTUATION, SEPARATORS, SPACE, repeated_words

#: Labelled rows to fit on, at most.
SAMPLE = 20_000
STATISTICS = (
    "words", "word_length", "symbols_per_word", "exclaims_per_word", "separators_per_word", "upper_share", "digit_share",
    "punctuation_share", "distinct_share", "repeated_share", "same_neighbour_share", "line_length", "duplicate_line_share", "open_line_share",
)
DIGITS, UPPER, LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))


def measure(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    size = sum(map(len, words))
    upper = len(text) - len(text.translate(None, UPPER))
    letters = upper + len(text) - len(text.translate(None, LOWER))
    return (
        math.log1p(n),
        size / n,
        sum(map(text.count, b"#*$%&|<>")) / n,
        text.count(b"!") / n,
        sum(map(SEPARATORS.__contains__, words)) / n,
        upper / max(1, letters),
        (len(text) - len(text.translate(None, DIGITS))) / size,
        (len(text) - len(text.translate(None, PUNCTUATION))) / size,
        len(set(words)) / n,
        repeated_words(words) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(not x.rstrip(SPACE).endswith((b".", b"!", b"?", b'"', b":")) for x in lines) / len(lines),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and a double for each of STATISTICS."""

    def make():
        def run(batch, values):
            return dict(zip(STATISTICS, zip(*(measure(x or b"") for x in values), strict=True), strict=True)) | {"doc_id": batch.column("doc_id")}

        return run

    return map_texts(texts(docs), make, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Condition = tuple[int, bool, float]  # of a statistic: that it is at most (True) or above (False) a value


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple[Condition, ...], rules: set, out: np.ndarray) -> None:
    """One regression tree on the residuals; each path goes to ``rules``, each leaf's step to ``out``."""
    r = residual[rows]
    best = (1e-9, None, None)
    if depth and len(rows) >= 40:
        total, n = r.sum(), len(rows)
        for f in features:
            width = len(edges[f]) + 1
            b = bins[rows, f]
            count, sums = np.bincount(b, minlength=width)[:-1].cumsum(), np.bincount(b, r, minlength=width)[:-1].cumsum()
            fine = (count >= 10) & (count <= n - 10)
            if fine.any():
                gain = np.where(fine, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1), 0) - total**2 / n
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
    if best[1] is None:
        out[rows] += r.mean() if len(rows) else 0.0
        return
    _, f, at = best
    low = bins[rows, f] <= at
    for side, part in ((True, rows[low]), (False, rows[~low])):
        step = (*path, (int(f), side, float(edges[f][at])))
        rules.add(tuple(sorted(step)))
        grow(x, bins, edges, residual, part, features, depth - 1, step, rules, out)


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= v) == low for f, low, v in rule])


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, at: Column | None = None) -> Column:
        """The score as a Spark expression over columns of STATISTICS, or over the fields of the struct ``at``."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for f, low, v in rule:
                value = F.col(STATISTICS[f]) if at is None else at[STATISTICS[f]]
                met = met & ((value <= v) if low else (value > v))
            margin = margin + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, max_rules: int = 400, seed: int = 7) -> RuleModel:
    prior = (y.sum() + 1) / (len(y) + 2)
    intercept = math.log(prior / (1 - prior))
    if len(set(y.tolist())) < 2:
        return RuleModel(intercept, ())
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    margin, rules = np.full(len(y), intercept), set()
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        features = rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False)
        before, step = len(rules), np.zeros(len(y))
        grow(x, bins, edges, residual, rows, features, depth, (), rules, step)
        margin += 1.0 * step
        if len(rules) > max_rules or (len(rules) == before and before):
            break
    named = sorted(rules)  # all of them: the last tree may pass max_rules by its own few
    if not named:
        return RuleModel(intercept, ())
    z = np.stack([holds(r, x) for r in named], axis=1).astype(np.float64)
    shift, scale = z.mean(0), np.maximum(z.std(0), 0.05)
    z = (z - shift) / scale
    w, b, last, t = np.zeros(z.shape[1]), intercept, np.zeros(z.shape[1]), 1.0
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    v = w
    for _ in range(500):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(z @ v + b)))
        b -= rate * (p - y).mean()
        w = v - rate * (z.T @ (p - y)) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        t, momentum = (1 + math.sqrt(1 + 4 * t * t)) / 2, (t - 1) / ((1 + math.sqrt(1 + 4 * t * t)) / 2)
        v, last = w + momentum * (w - last), w
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - (w * shift / scale).sum()), tuple((named[k], float(w[k] / scale[k])) for k in kept))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and the label of at most ``rows`` labelled documents that may be learned from."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & trained_on(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return texts(docs).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` pairs of numbers


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> RuleModel:
    sample = labelled_sample(docs, labels, label, rows)
    measured = map_labelled(sample).toPandas().sort_values(["doc_id", *STATISTICS])
    return fit(measured[list(STATISTICS)].to_numpy(np.float64), measured["label"].to_numpy(np.float64))


def map_labelled(sample: DataFrame) -> DataFrame:
    def make():
        def run(batch, values):
            return dict(zip(STATISTICS, zip(*(measure(x or b"") for x in values), strict=True), strict=True)) | {"doc_id": batch.column("doc_id"), "label": batch.column("label")}

        return run

    return map_texts(sample.select("doc_id", "text", "label"), make, "doc_id long, label double, " + ", ".join(f"{s} double" for s in STATISTICS))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, the statistics and ``score``."""
    return statistics(docs).withColumn("score", model.column())


def keep(docs: DataFrame, model: RuleModel, least: float) -> DataFrame:
    """The rows of docs, all their columns as they are, whose score is at least ``least``."""
    name = fresh(docs, "measured")

    def make():
        def run(batch, values):
            return {name: [dict(zip(STATISTICS, measure(x or b""), strict=True)) for x in values]}

        return run

    kind = f"{name} struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">"
    return map_rows(docs, make, kind).where(model.column(F.col(name)) >= least).select(*docs.columns)
