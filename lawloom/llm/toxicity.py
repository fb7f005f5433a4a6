"""Toxicity as ordered severity grades: cumulative-link logistic regression.

One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - t_k)
with t_0 < t_1 < ...  Features are sparse: words and word beginnings (inflected
abuse shares its stem), as rates per hundred words.  The output is the expected
grade.

The labels only tell toxic from not toxic.  Grades above 0 are induced from
them: among toxic examples the rate of marker features (those strongly tied to
the toxic label) is cut at its terciles, giving 1 (some), 2, 3 (dense).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc32_fold, map_arrow, materialise, table
from .learn import examples, labelled_sample, sigmoid

#: Examples to learn from at most, half of them toxic.
SAMPLE = 6000
FEATURES = 3000
GRADES = 4
PREFIXES = (4, 5, 6)
LEAST_DOCS = 4
#: Examples whose features are handed to Spark at a time: a long text has tens of thousands.
PIECE = 32
REJECT = 0.5
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings where something follows them."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def feature_counts(text: str | None) -> tuple[Counter, int]:
    words = Counter(tokens(text))
    out: Counter = Counter()
    for word, n in words.items():
        for f in features_of(word):
            out[f] += n
    return out, words.total()


@dataclass
class SeverityModel:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades

    def severity(self, text: str | None) -> tuple[float, float]:
        """Expected grade, and the probability of a grade above 0."""
        words = tokens(text)
        if not words or not len(self.thresholds):
            return 0.0, 0.0
        whole, counts = self.index.get, Counter()
        a, b, c = PREFIXES
        for w in words:
            if (i := whole(w)) is not None:
                counts[i] += 1
            n = len(w)
            if n > a:
                if (i := whole(w[:a] + "*")) is not None:
                    counts[i] += 1
                if n > b:
                    if (i := whole(w[:b] + "*")) is not None:
                        counts[i] += 1
                    if n > c and (i := whole(w[:c] + "*")) is not None:
                        counts[i] += 1
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        x = scale(np.fromiter(counts.values(), np.float64, len(counts)), len(words))
        above = sigmoid(float(x @ self.weights[at]) - self.thresholds)
        return float(above.sum()), float(above[0])


def scale(counts: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    """Rate per hundred words, damped."""
    return np.log1p(100 * counts / words)


def train(
    rows: list[tuple[dict, int, int]], names: list[str], markers: set[str], rates: dict[int, float], steps: int = 400, l2: float = 1e-3
) -> SeverityModel:
    """Fit to ``(feature counts, words, toxic 0/1)``; ``rates`` undoes the sampling by label."""
    rows = [r for r in rows if r[1]]
    if len({r[2] for r in rows}) < 2:
        return SeverityModel({}, np.zeros(0), np.zeros(0))
    index = {f: i for i, f in enumerate(names)}
    dense = np.array([sum(n for f, n in c.items() if f in markers) / n_words for c, n_words, _ in rows])
    toxic = np.array([y for _, _, y in rows], bool)
    cuts = np.quantile(dense[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (dense > cuts[0]) + (dense > cuts[1]), 0)
    at, col, val = [], [], []
    for i, (c, n_words, _) in enumerate(rows):
        hit = [(index[f], n) for f, n in c.items() if f in index]
        at += [i] * len(hit)
        col += [h[0] for h in hit]
        val += scale(np.array([h[1] for h in hit], float), n_words).tolist()
    at, col, val = np.array(at, np.int64), np.array(col, np.int64), np.array(val)
    weight = np.array([1 / rates[int(y)] for y in toxic])
    weight /= weight.sum()
    w, t0, gaps = np.zeros(len(names)), 0.0, np.zeros(GRADES - 2)
    m = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    v = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    for step in range(1, steps + 1):
        cut = t0 + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        score = np.bincount(at, val * w[col], len(rows))
        p = sigmoid(score[:, None] - cut)
        # grade = k has probability P(>k-1) - P(>k); its log-likelihood's gradient by the score and by each threshold
        upper = np.concatenate((np.ones((len(rows), 1)), p), axis=1)[np.arange(len(rows)), grade]
        lower = np.concatenate((p, np.zeros((len(rows), 1))), axis=1)[np.arange(len(rows)), grade]
        mass = np.maximum(upper - lower, 1e-9)
        d_score = -(upper * (1 - upper) - lower * (1 - lower)) / mass * weight
        d_cut = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            slope = p[:, k] * (1 - p[:, k])
            d_cut[k] = (weight * slope / mass * ((grade == k + 1).astype(float) - (grade == k))).sum()
        grads = [
            np.bincount(col, val * d_score[at], len(w)) + l2 * w / len(rows),
            d_cut.sum(),
            np.array([d_cut[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(gaps),
        ]
        moved = []
        for k, (x, g) in enumerate(zip((w, t0, gaps), grads, strict=True)):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            moved.append(x - 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-10))
        w, t0, gaps = moved
    return SeverityModel(index, w, t0 + np.concatenate(([0], np.cumsum(np.exp(gaps)))))


def fit_severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SeverityModel:
    """Learn from ``labels(doc_id, toxic)``, a bounded sample; several labels of one id count as the highest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen, rates = labelled_sample(known, sample)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = zip(*(c.to_pylist() for c in batch.slice(at, PIECE).columns), strict=True)
                found = [(i, *feature_counts(t), y) for i, t, y in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([list(f[1].keys()) for f in found], pa.list_(pa.string())),
                        pa.array([list(f[1].values()) for f in found], pa.list_(pa.int32())),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[3] for f in found], pa.int32()),
                    ],
                    names=["doc_id", "names", "counts", "words", "label"],
                )

    made = examples(docs, chosen).mapInArrow(run, "doc_id long, names array<string>, counts array<int>, words long, label int")
    made = materialise(made.where("words > 0").withColumn("row", F.xxhash64("doc_id", "names", "counts")), "toxicity-examples")
    totals = {r["label"]: r["n"] for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return SeverityModel({}, np.zeros(0), np.zeros(0))
    each = made.select("doc_id", "row", "words", "label", F.explode(F.arrays_zip("names", "counts")).alias("f")).select(
        "doc_id", "row", "words", "label", F.col("f.names").alias("name"), F.col("f.counts").alias("n")
    )
    tied = materialise(_tied(each, totals), "toxicity-features")
    picked = [(r["name"], r["marker"]) for r in tied.collect()]
    # Every example comes to the driver, with the chosen features it has.
    kept = (
        each.join(F.broadcast(tied.select("name")), "name")
        .groupBy("doc_id", "row", "words", "label")
        .agg(F.collect_list(F.struct("name", "n")).alias("f"))
    )
    bare = made.select("doc_id", "row", "words", "label", F.array().cast("array<struct<name: string, n: int>>").alias("f"))
    rows = [
        (row["doc_id"], row["row"], dict(zip(names, counts, strict=True)), row["words"], row["label"])
        for row, names, counts in _rows(kept.unionByName(bare.join(kept.select("doc_id", "row"), ["doc_id", "row"], "left_anti")).toArrow())
    ]
    rows.sort(key=lambda r: r[:2])
    return train([r[2:] for r in rows], [p[0] for p in picked], {p[0] for p in picked if p[1]}, rates)


def _tied(each: DataFrame, totals: dict[int, int]) -> DataFrame:
    """``(name, marker)``: the features most tied to the toxic label, and which of them mark it clearly.

    Features of clean texts are left out: a text that shares none of them (in
    an unseen language, say) must not count as toxic for that.
    """
    seen = each.groupBy("name").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    rest_a, rest_b = totals[1] - F.col("a") + 0.5, totals[0] - F.col("b") + 0.5
    odds = F.log(a / rest_a) - F.log(b / rest_b)
    z = odds / F.sqrt(1 / a + 1 / rest_a + 1 / b + 1 / rest_b)
    scored = seen.where(F.col("a") + F.col("b") >= LEAST_DOCS).select("name", odds.alias("odds"), F.round(z, 9).alias("z"))
    top = scored.where("z > 0").orderBy(F.col("z").desc(), "name").limit(FEATURES)
    return top.select("name", ((F.col("z") > 4) & (F.col("odds") > 3)).alias("marker"))


def _rows(got: pa.Table) -> Iterator[tuple[dict, list[str], list[int]]]:
    for batch in got.to_batches():
        plain = batch.select(["doc_id", "row", "words", "label"]).to_pylist()
        for row, f in zip(plain, batch.column("f"), strict=True):
            yield row, f.values.field("name").to_pylist(), f.values.field("n").to_pylist()


def score_severity(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, expected_severity, p_toxic, toxic``.

    A null or wordless text has severity 0, as has every text if the labels
    showed less than two classes.  A very long text is read whole, one row at a
    time.  Null ids and repeated rows stay; extra columns are ignored; an empty
    table gives an empty result.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.severity(t.as_py()) for t in batch.column(1)]
            grades, p = np.array([f[0] for f in found], float), np.array([f[1] for f in found], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grades), pa.array(p), pa.array(p >= REJECT)],
                names=["doc_id", "expected_severity", "p_toxic", "toxic"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, toxic boolean")


def reject_toxic(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """``docs`` without the rows that are toxic; all columns stay as they are, whatever their names.

    A row goes if the probability of a grade above 0 is REJECT or more, a tie
    included.  Null and empty texts have no features and are judged as such;
    equal texts go or stay alike; a text of any length is read whole.  An empty
    table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.severity(t.as_py())[1] < REJECT for t in batch.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; fold 0 is held out of learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_severity(docs, labels.where(crc32_fold(F.col("doc_id")) != 0))
    return score_severity(docs, model).withColumn("held_out", crc32_fold(F.col("doc_id")) == 0)
