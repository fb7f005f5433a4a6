"""Document quality by a sparse rule ensemble over text statistics.

Boosted shallow trees over statistics of whole texts propose rules: every path
from a root to a node is a conjunction of threshold tests.  A lasso-penalised
logistic regression weighs the rules and drops most.  What is left is compiled
into one Spark column expression over the statistics' columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc32_fold, table
from .learn import examples, labelled_sample, sigmoid

#: Examples to learn from at most, shared evenly by the two labels.
SAMPLE = 8000
ACCEPT = 0.3
STATISTICS = (
    "n_words", "word_chars", "longest_word", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share",
    "wide_share", "distinct_words", "distinct_pairs", "top_word_share", "echo_share", "repeated_lines", "words_per_line",
)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_ALPHA = np.array([65 <= (b & 0xDF) <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([33 <= b <= 126 and not (48 <= b <= 57 or 65 <= (b & 0xDF) <= 90) and chr(b) not in ".,;:'\"-()?" for b in range(256)])
_WIDE = np.array([b >= 128 for b in range(256)])


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a whole text; an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(kinds[_ALPHA].sum()))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    once = sum(map(len, set(lines)))
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        float(np.log1p(max(map(len, counts)))),
        float(kinds[_UPPER].sum()) / letters,
        float(kinds[_DIGIT].sum()) / size,
        float(kinds[_SYMBOL].sum()) / size,
        float(kinds[33]) / size,
        float(kinds[124]) / size,
        float(kinds[_WIDE].sum()) / size,
        len(counts) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - once / max(1, sum(map(len, lines))),
        n / len(lines),
    ]


def with_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, the ``carried`` columns and the statistics of each row's text."""
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(STATISTICS))
            kept = [batch.column(c) for c in ("doc_id", *carried)]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(np.ascontiguousarray(found[:, j])) for j in range(len(STATISTICS))],
                names=["doc_id", *carried, *STATISTICS],
            )

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text"]
    return narrow.mapInArrow(run, ", ".join(kinds + [f"{s} double" for s in STATISTICS]))


@dataclass(frozen=True)
class Test:
    """One threshold test: above it, or not above it."""

    statistic: int
    threshold: float
    above: bool


@dataclass
class RuleEnsemble:
    rules: list[tuple[frozenset[Test], float]] = field(default_factory=list)
    bias: float = 0.0

    def column(self) -> Column:
        """The score as a Spark expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same score in NumPy, for rows of statistics."""
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total = total + np.where(_mask(rule, x), weight, 0.0)
        return 1 / (1 + np.exp(-total))


def _ordered(rule: frozenset[Test]) -> list[Test]:
    return sorted(rule, key=lambda t: (t.statistic, t.above, t.threshold))


def _holds(rule: frozenset[Test]) -> Column:
    out = None
    for t in _ordered(rule):
        c = F.col(STATISTICS[t.statistic])
        one = c > F.lit(t.threshold) if t.above else c <= F.lit(t.threshold)
        out = one if out is None else out & one
    return out


def _mask(rule: frozenset[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= (x[:, t.statistic] > t.threshold) == t.above
    return out


def _grow(x, binned, edges, g, h, rows, path, depth, rules, out, step) -> None:
    """Split ``rows`` where the gain is largest; paths become rules, leaves add their step to ``out``."""
    if path:
        rules.append(frozenset(path))
    best = (1e-6, None)
    if depth:
        base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j in range(x.shape[1]):
            if not len(edges[j]):
                continue
            b = binned[rows, j]
            left_g = np.cumsum(np.bincount(b, g[rows], len(edges[j]) + 1))
            left_h = np.cumsum(np.bincount(b, h[rows], len(edges[j]) + 1))
            count = np.cumsum(np.bincount(b, minlength=len(edges[j]) + 1))
            fine = (count[:-1] >= 10) & (count[-1] - count[:-1] >= 10)
            gain = left_g[:-1] ** 2 / (left_h[:-1] + 1) + (left_g[-1] - left_g[:-1]) ** 2 / (left_h[-1] - left_h[:-1] + 1) - base
            gain = np.where(fine, gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        out[rows] += step * g[rows].sum() / (h[rows].sum() + 1)
        return
    j, k = best[1]
    over = binned[rows, j] > k
    for above, part in ((True, rows[over]), (False, rows[~over])):
        test = Test(j, float(edges[j][k]), above)
        same = {t for t in path if (t.statistic, t.above) == (j, above)}  # the new test is the narrower one
        _grow(x, binned, edges, g, h, part, (path - same) | {test}, depth - 1, rules, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 48) -> list[frozenset[Test]]:
    """Rules of gradient-boosted trees, without repeats, in the order found."""
    edges, binned = [], np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        edges.append(cuts)
        binned[:, j] = np.searchsorted(cuts, x[:, j], side="left")  # bin k: not above edge k
    rules: list[frozenset[Test]] = []
    score = np.zeros(len(y))
    for _ in range(trees):
        p = sigmoid(score)
        _grow(x, binned, edges, weight * (y - p), weight * p * (1 - p), np.arange(len(y)), frozenset(), depth, rules, score, 0.3)
    return list(dict.fromkeys(rules))


def lasso_logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the last column's weight, the bias, is not penalised."""
    full = np.concatenate((a, np.ones((len(a), 1))), axis=1)
    share = weight / weight.sum()
    scaled = full * np.sqrt(share)[:, None]
    v = np.ones(full.shape[1])
    for _ in range(20):  # largest curvature by power iteration
        v = scaled.T @ (scaled @ v)
        v /= np.linalg.norm(v)
    pace = 1 / (0.25 * np.linalg.norm(scaled.T @ (scaled @ v)) * 1.05)
    w = z = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = full.T @ (share * (sigmoid(full @ z) - y))
        new = z - pace * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - pace * penalty)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> RuleEnsemble:
    """Fit to statistics, labels 0/1 and example weights; the penalty is chosen on every fifth example."""
    if len(np.unique(y)) < 2:
        return RuleEnsemble([], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0)
    weight = weight / weight.mean()
    held = np.arange(len(y)) % 5 == 4
    rules = tree_rules(x[~held], y[~held], weight[~held])
    a = np.stack([_mask(r, x) for r in rules], axis=1).astype(np.float64)
    best = (np.inf, None)
    for penalty in (3e-3, 1e-3, 3e-4, 1e-4):
        w, b = lasso_logistic(a[~held], y[~held], weight[~held], penalty)
        p = np.clip(sigmoid(a[held] @ w + b), 1e-9, 1 - 1e-9)
        loss = -(weight[held] * (y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))).sum()
        if loss < best[0]:
            best = (loss, penalty)
    w, b = lasso_logistic(a, y, weight, best[1])
    return RuleEnsemble([(r, float(v)) for r, v in zip(rules, w, strict=True) if v], b)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Learn from ``labels(doc_id, quality)``, a bounded sample of ``sample`` rows; several labels of one id count as the lowest.

    Null ids and labels other than 0 and 1 are left out; a null text counts as
    empty; rows that repeat a labelled id are one example; equal statistics with
    different labels stay both.  Other columns are ignored.  Without any
    example the model has no rules and scores all alike.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen, rates = labelled_sample(known, sample)
    got = with_statistics(examples(docs, chosen), "label").toPandas()
    got = got.sort_values(["doc_id", *STATISTICS], kind="stable")
    y = got["label"].to_numpy(float)
    return train(got[list(STATISTICS)].to_numpy(float), y, np.array([1 / rates[int(v)] for v in y]))


def score_quality(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted``.

    A null text counts as empty and has a score like any other; a very long one
    is read whole.  Null ids and repeated rows stay; extra columns are ignored;
    an empty table gives an empty result.
    """
    scored = with_statistics(docs).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled ones whose fold is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(crc32_fold(F.col("doc_id")) != 0))
    return score_quality(docs, model).select("doc_id", (crc32_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
