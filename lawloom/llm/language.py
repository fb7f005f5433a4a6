"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training (on the driver, over a bounded sample): follow-the-regularised-leader
updates with L1 and L2 penalties leave most weights at zero; a temperature
fitted on examples the updates never saw then calibrates the probabilities.
Prediction reads whole texts, one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc32_fold, table
from .learn import labelled_sample

#: Examples to learn from at most, shared evenly by the languages.
SAMPLE = 4000
ORDERS = (1, 2, 3)
BITS = 16
UNKNOWN = "und"
PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of each order."""
    out, mixed = [], None
    for n in ORDERS:
        if len(codes) < n:
            break
        here = codes[n - 1 :]
        mixed = here if mixed is None else mixed[:-1] * np.uint32(0x01000193) ^ here
        out.append(((mixed + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return out


def _codes(text: str) -> np.ndarray:
    joined = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and counts of a whole text."""
    buckets, counts = np.unique(np.concatenate(_grams(_codes(text))), return_counts=True)
    return buckets.astype(np.int32), counts.astype(np.int32)


@dataclass
class LanguageModel:
    names: list[str]
    weights: np.ndarray  # (buckets, languages), already times idf
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        codes = _codes(text)
        total, sums = 0, np.zeros(len(self.names))
        for at in range(0, len(codes), PIECE):  # pieces overlap by what an n-gram needs to the left
            piece = codes[max(0, at - (ORDERS[-1] - 1) if at else 0) : at + PIECE]
            skip = ORDERS[-1] - 1 if at else 0
            for n, grams in zip(ORDERS, _grams(piece), strict=False):
                grams = grams[max(0, skip - n + 1) :]
                total += len(grams)
                sums += self.weights[grams].sum(axis=0, dtype=np.float64)
        return self._best(sums / max(total, 1) * 100 + self.bias)

    def _best(self, logits: np.ndarray) -> tuple[str, float]:
        p = softmax(logits[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.names[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray, str]],
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1.0,
    l2: float = 0.1,
    frequencies: tuple[int, np.ndarray] | None = None,
) -> LanguageModel:
    """Fit to ``(buckets, counts, language)`` rows; every fifth row only calibrates.

    ``frequencies``: how many texts there are, and in how many each bucket is;
    by default those of the rows.
    """
    names = sorted({r[2] for r in rows})
    k, size = len(names), 1 << BITS
    if not names:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0)
    at = {n: i for i, n in enumerate(names)}
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    if frequencies is None:
        frequencies = len(fit), np.bincount(np.concatenate([r[0] for r in fit]), minlength=size)
    idf = np.log((1 + frequencies[0]) / (1 + frequencies[1])) + 1
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    def features(b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(b, size), np.append(c / c.sum() * 100 * idf[b], 1.0)

    shuffle = np.random.default_rng(7)
    for _ in range(epochs):
        for i in shuffle.permutation(len(fit)):
            b, x = features(*fit[i][:2])
            zb, nb = z[b], n[b]
            w = weights(zb, nb)
            p = softmax((x @ w)[None])[0]
            p[at[fit[i][2]]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            z[b], n[b] = zb + g - sigma * w, nb + g * g
    w = weights(z, n)

    def logits(rows) -> np.ndarray:
        out = []
        for b, c, _ in rows:
            i, x = features(b, c)
            out.append(x @ w[i])
        return np.array(out)

    calibrate = held or fit
    scores, truth = logits(calibrate), np.array([at.get(r[2], 0) for r in calibrate])
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    loss = [-np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return LanguageModel(names, (w[:size] * idf[:, None]).astype(np.float32), w[size].copy(), float(grid[int(np.argmin(loss))]))


def bucket_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many of all ``texts(text)`` have a letter, and how many of these have an n-gram in each bucket."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if has_letter(text := text.as_py()):
                    mark = np.zeros(size, bool)
                    for grams in _grams(_codes(text)):
                        mark[grams] = True
                    seen += mark
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["bucket", "n"])

    got = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size + 1, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()  # the total is at -1, the last
    return int(counts[-1]), counts[:-1]


def fit_language_model(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of a bounded, hash-chosen sample of ``docs``.

    Rows of one id, text and language are one example.  The frequencies of
    n-grams are counted over all rows with a language.
    """
    arrow_batches(docs.sparkSession)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label")
    )
    chosen, _ = labelled_sample(own, sample, ["doc_id", "text"])
    chosen = chosen.dropDuplicates(["doc_id", "text", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *gram_counts(t), y) for i, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()))],
                names=["doc_id", "buckets", "counts", "label"],
            )

    got = chosen.mapInArrow(run, "doc_id long, buckets array<int>, counts array<int>, label string").toArrow()
    rows = sorted(
        zip(got["doc_id"].to_pylist(), map(lambda x: x.values.to_numpy(), got["buckets"]), map(lambda x: x.values.to_numpy(), got["counts"]), got["label"].to_pylist(), strict=True),
        key=lambda r: (r[0], r[3], len(r[1]), int(r[2].sum())),
    )
    return train([r[1:] for r in rows], frequencies=bucket_frequencies(own.where("label is not null").select("text")) if rows else None)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score``.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if nothing could be learned.  Of equally likely languages the first
    by name is told.  A very long text is read whole, in pieces.  Null ids and
    repeated rows stay; extra columns are ignored; an empty table gives an
    empty result.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(crc32_fold(F.col("doc_id")) != 0))
    return predict_language(docs, model).select(
        "doc_id", (crc32_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score"
    )
