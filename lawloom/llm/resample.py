"""Target-distribution importance resampling over hashed word n-grams.

A corpus is drawn so that it looks like a target: every n-gram falls into one of
a fixed number of buckets, a bucket's gain is the log ratio of its frequency in
the target to that in the corpus, a document's weight the mean gain of its
n-grams.  Noise of the Gumbel kind makes the best scores a weighted draw without
replacement.

Inside a partition the words of a block of texts become ids, and a suffix array
over them brings equal n-grams together: neighbours whose longest common prefix
has n words are one run.  Each run is hashed once, and its bucket is scattered
back to all its places, which then are counted or scored.

Both passes are narrow: the first gives one row per bucket and partition, the
second one number per document.  Scores are whole numbers of a bounded range, so
ranks come from a count per score and an order inside each score; all rows never
meet in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_batches, columns_of, free, map_arrow, materialise, table

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words of one suffix array; longer sequences are cut, with the overlap that n-grams need.
BLOCK_WORDS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, a-z, and all beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids of all words in order, the words by id, and the number of words of each text (none for a null)."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    raw, at = _LOWER[raw], offsets - offsets[0]
    inside = _IN_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = at[:-1][at[:-1] < len(raw)]
    first[inner] |= inside[inner]  # a text's first word ends what the text before it ended with
    counts = np.diff(np.concatenate(([0], np.cumsum(first)))[at])
    kept = raw[inside]
    starts = np.flatnonzero(first[inside])
    ends = np.append(starts, len(kept)).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), counts


def suffix_array(ids: np.ndarray, room: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the words from there on, and the common prefix of each with the place before it.

    ``room`` has the words from a place to the end of its text; an end sorts
    before any word.  Order and prefixes are exact up to ``longest`` words.
    """
    rank, depth, m = ids.astype(np.int64) + 1, 1, len(ids)
    while depth < longest:  # doubling: ranks of twice the depth from pairs of ranks
        behind = np.zeros(m, np.int64)
        behind[: max(m - depth, 0)] = rank[depth:]
        behind[room <= depth] = 0
        pair = rank * (int(rank.max(initial=0)) + 1) + behind
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        depth *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(m, np.int64)
    here, there = order[1:], order[:-1]
    same = np.ones(max(m - 1, 0), bool)
    for k in range(longest):
        same = same & (room[here] > k) & (room[there] > k)
        same[same] = ids[here[same] + k] == ids[there[same] + k]
        shared[1:] += same
    return order, shared


def buckets_of(ids: np.ndarray, vocabulary: list[bytes], room: np.ndarray, longest: int, buckets: int, own: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest``: the places, among the first ``own``, at which an n-gram starts, and its bucket."""
    order, shared = suffix_array(ids, room, longest)
    sums = np.zeros(len(ids), np.int64)  # the checksum of the n-gram at each place
    for n in range(1, longest + 1):
        held = room[order] >= n
        run = (np.cumsum(shared < n) - 1)[held]
        places = order[held]
        heads = np.flatnonzero(np.diff(run, prepend=-1))
        # A checksum goes on from that of the n-gram that is a word shorter.
        last, before = ids[places[heads] + n - 1].tolist(), sums[places[heads]].tolist()
        own_sums = [zlib.crc32(vocabulary[w] if n == 1 else b" " + vocabulary[w], s) for w, s in zip(last, before, strict=True)]
        length = np.diff(np.append(heads, len(run)))
        sums[places] = np.repeat(np.array(own_sums, np.int64), length)
        places = places[places < own]
        yield places, sums[places] % buckets


def _blocks(ids: np.ndarray, vocabulary: list[bytes], counts: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text numbers, buckets)`` of all n-grams of the texts that ``words_of`` read, block by block."""
    ends = np.cumsum(counts)
    for at in range(0, len(ids), BLOCK_WORDS):
        own = min(BLOCK_WORDS, len(ids) - at)
        upto = min(len(ids), at + own + longest - 1)
        text = np.searchsorted(ends, np.arange(at, upto), "right")
        room = np.minimum(ends[text], upto) - np.arange(at, upto)
        for places, found in buckets_of(ids[at:upto], vocabulary, room, longest, buckets, own):
            yield text[places], found


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all ``docs`` fall into each bucket: ``buckets`` numbers, whatever the size of the corpus."""
    arrow_batches(docs.sparkSession, megabytes=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in _blocks(*words_of(batch.column(0)), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    narrow = docs.select(F.col("text").cast("string").alias("text"))
    got = narrow.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's frequencies, each count raised by one; floors."""
    k, whole, aimed = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (whole + k) / ((s + 1.0) * (aimed + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``docs`` with ``n_words, n_features, weight`` added: the floored mean gain of a text's n-grams, 0 without any.

    A name that is taken gets an underscore.
    """
    arrow_batches(docs.sparkSession, megabytes=4)
    added = free(docs.columns, "n_words", "n_features", "weight")
    result = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    at, names, width = docs.columns.index("text"), [f"c{i}" for i in range(len(result))], len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vocabulary, counts = words_of(batch.column(at))
            features = sum(np.maximum(counts - n + 1, 0) for n in range(1, longest + 1))
            sums = np.zeros(len(batch))
            for text, found in _blocks(ids, vocabulary, counts, longest, len(gain)):
                sums += np.bincount(text, gain[found], len(batch))  # whole numbers, exact in doubles
            weight = sums.astype(np.int64) // np.maximum(features, 1)
            own = [batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in (counts, features, weight))], names=names)

    return map_arrow(docs, run, result)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from the hash of its id; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("long").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _drawn(scored: DataFrame, percent: int, least_words: int) -> tuple[DataFrame, int | None]:
    """``scored`` with ``rank``, and the score at which the draw ends (None: nothing is drawn).

    Counts per score are at most as many rows as there are scores: gains are
    thousandths of logs of ratios of counts and noise is below 23 000, so less
    than 200 000 whole numbers for any corpus.
    """
    able = scored.where(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    got = able.where("score is not null").groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    score, n = got["score"].to_numpy(), got["n"].to_numpy()
    before = np.cumsum(n) - n
    some = before < wanted
    last = int(score[some][-1]) if some.any() else None
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long")), None
    starts = scored.sparkSession.createDataFrame(pa.table({"score": pa.array(score[some]), "before": pa.array(before[some])}))
    near = (F.col("n_words") >= least_words) & F.coalesce(F.col("score") >= last, F.lit(False))
    place = F.row_number().over(W.partitionBy("score").orderBy("doc_id")) + F.col("before")
    ranked = scored.where(near).join(F.broadcast(starts), "score").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.union(scored.where(~near).withColumn("rank", F.lit(None).cast("long"))), last


def _scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = weighed(narrow, gain, longest).drop("text").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return materialise(out, "resample-scores")


def importance_ranks(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_features, weight, score, rank``; rank is null for what is not drawn.

    Both tables need ``text``.  A null or wordless text has no features and
    weight 0.  Of the rows with ``least_words`` words at least, ``percent``
    percent are drawn (floored); equal scores go by the smaller id.  A row
    without an id counts among them but has no score and is never drawn; rows
    that repeat an id each take a rank.  Other columns are ignored, whatever
    their names; an empty corpus gives an empty result, an empty target flat
    gains.  A very long text is cut into blocks of words, all of which count.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return _drawn(_scored(docs, gain, longest, seed), percent, least_words)[0]


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """The rows of ``docs`` that are drawn (see ``importance_ranks``), with ``n_words, n_features, weight, score`` added.

    The draw is a limit on score and, at that score, on the id, so texts are
    scored again in place and never shuffled.  Rows that repeat the last id
    drawn all stay.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    ranked, last = _drawn(_scored(docs, gain, longest, seed), percent, least_words)
    told = weighed(docs, gain, longest)
    words, weight = told.columns[-3], told.columns[-1]
    (score,) = free(told.columns, "score")
    told = told.withColumn(score, F.col(weight) + noise(F.col("doc_id"), seed))
    if last is None:
        return told.where(F.lit(False))
    upto = ranked.where((F.col("score") == last) & F.col("rank").isNotNull()).agg(F.max("doc_id")).first()[0]
    in_draw = (F.col(score) > last) | ((F.col(score) == last) & (F.col("doc_id").cast("long") <= upto))
    return told.where((F.col(words) >= least_words) & in_draw).select(*columns_of(told))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank in the draw of every document, with the benchmark as target."""
    out = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
