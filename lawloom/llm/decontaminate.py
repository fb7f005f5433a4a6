"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item of whose words shared seeds (five words in a
row) cover enough are compared by running Karp-Rabin greedy string tiling: the
longest matches of words not yet covered are marked first, then shorter ones,
down to the seed's length.  The share of the item's words that tiles cover does
not depend on the order of its passages in the document, so reordered leaks
count in full.  Tiles lie under shared seeds, so an item that seeds do not
cover enough is settled without tiling, as are those that share a stock phrase.

The benchmark is read in blocks of bounded size, each sent to all executors and
held against every document in one pass without a shuffle; a larger benchmark
takes more passes, not more memory.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, map_arrow, table

SEED_WORDS = 5
COVERAGE = 0.6
#: Characters and items of the benchmark held against the documents at a time: about 75 MB in each worker.
BLOCK_CHARS = 24 << 20
BLOCK_ITEMS = 200_000
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _matches(a: list[int], b: list[int], free_a: bytearray, free_b: bytearray, length: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of unmarked words of at least ``length``; stops early at one over twice that."""

    def windows(x: list[int], free: bytearray) -> Iterator[tuple[int, int]]:
        """Start and rolling hash of each window without a marked word."""
        top = pow(_BASE, length - 1, _PRIME)
        value, run = 0, 0
        for i, w in enumerate(x):
            if not free[i]:
                value, run = 0, 0
                continue
            if run >= length:
                value = (value - x[i - length] * top) % _PRIME
            value = (value * _BASE + w) % _PRIME
            run += 1
            if run >= length:
                yield i - length + 1, value

    table: dict[int, list[int]] = defaultdict(list)
    for at, value in windows(b, free_b):
        table[value].append(at)
    longest, found = 0, []
    for i, value in windows(a, free_a):
        for j in table.get(value, ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of a match that began one word before
            k = 0
            while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k >= length:
                found.append((k, i, j))
                longest = max(longest, k)
                if k > 2 * length:
                    return longest, found
    return longest, found


def tiles(item: list[int], doc: list[int], least: int = SEED_WORDS, start: int = 20) -> list[tuple[int, int, int]]:
    """Greedy tiling: ``(item start, doc start, length)`` of matches that do not overlap, longest marked first.

    Ties go to the first in the item, then in the document, so the result is
    that of trying all pairs of places.
    Words are numbers above 0; a 0 in ``doc`` matches nothing.
    """
    free_item, free_doc = bytearray(b"\x01") * len(item), bytearray(1 if w else 0 for w in doc)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(start, len(item)))
    while True:
        longest, found = _matches(item, doc, free_item, free_doc, length)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-k, i, j) for k, i, j in found]
        heapq.heapify(queue)
        while queue:
            k, i, j = heapq.heappop(queue)
            free = bytes(a & b for a, b in zip(free_item[i : i - k], free_doc[j : j - k], strict=True))
            if all(free):
                free_item[i : i - k] = bytes(-k)
                free_doc[j : j - k] = bytes(-k)
                out.append((i, j, -k))
            else:  # what is left of it may still be long enough
                for run in re.finditer(b"\x01+", free):
                    if len(run[0]) >= length:
                        heapq.heappush(queue, (-len(run[0]), i + run.start(), j + run.start()))
        if length == least:
            return out
        length = max(least, length // 2)


@dataclass
class BenchmarkBlock:
    """A part of the benchmark, ready to be held against documents: arrays only, about 30 bytes a word."""

    ids: list[int | None]
    words: np.ndarray  # of all items, as hashes, one item after the other
    begins: np.ndarray  # of each item, and the end
    seeds: np.ndarray  # hashes, sorted
    places: np.ndarray  # of each seed in words
    short: dict[tuple[int, ...], list[int | None]]  # items with fewer words than a seed, by their words

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> BenchmarkBlock:
        ids, items, short = [], [], {}
        for item_id, text in rows:
            own = hashes_of(words_of(text))
            if len(own) >= SEED_WORDS:
                ids.append(item_id)
                items.append(own)
            elif len(own):
                short.setdefault(tuple(own.tolist()), []).append(item_id)
        words = np.concatenate([np.zeros(0, np.int64), *items])
        begins = np.concatenate([[0], np.cumsum([len(x) for x in items], dtype=np.int64)]).astype(np.int64)
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - SEED_WORDS + 1) for a, b in zip(begins, begins[1:]))]).astype(np.int64)
        seeds = _seed_hashes(words)[starts] if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        return cls(ids, words, begins, seeds[order], starts[order], short)

    def _candidates(self, hashes: np.ndarray, coverage: float) -> list[int]:
        """Items of whose words the shared seeds ``hashes`` (distinct) cover enough."""
        low, high = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        counts = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        under = np.unique(self.places[at][:, None] + np.arange(SEED_WORDS))
        items, covered = np.unique(np.searchsorted(self.begins, under, "right") - 1, return_counts=True)
        size = self.begins[items + 1] - self.begins[items]
        return items[covered >= coverage * size - 1e-9].tolist()

    def leaks(self, text: str | None, coverage: float) -> list[tuple[int | None, float, int, int]]:
        """``(item_id, coverage, tiles, covered words)`` of the items the text leaks."""
        if not text:
            return []
        out = []
        if self.short:
            lines = {tuple(hashes_of(w).tolist()) for line in text.split("\n") if len(w := words_of(line)) < SEED_WORDS}
            out += [(i, 1.0, 1, len(line)) for line in sorted(lines) for i in self.short.get(line, ())]
        doc = hashes_of(words_of(text))
        if len(doc) < SEED_WORDS or not len(self.seeds):
            return out
        hashes = _seed_hashes(doc)
        spot = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[spot] == hashes)
        if not len(hit):
            return out
        hashes = hashes[hit]
        for item in self._candidates(np.unique(hashes), coverage):
            words = self.words[self.begins[item] : self.begins[item + 1]]
            ats = hit[np.isin(hashes, _seed_hashes(words))]
            # Only words under a seed can be in a tile; a gap between them matches nothing.
            under = np.unique(ats[:, None] + np.arange(SEED_WORDS))
            region = np.insert(doc[under], np.flatnonzero(np.diff(under) > 1) + 1, 0)
            found = tiles(words.tolist(), region.tolist())
            covered = sum(k for _, _, k in found)
            if covered >= coverage * len(words) - 1e-9:
                out.append((self.ids[item], covered / len(words), len(found), covered))
        return out


def hashes_of(words: list[str]) -> np.ndarray:
    """Words as numbers above 0; each different word is hashed once."""
    digest = xxhash.xxh64_intdigest
    known = {w: (digest(w) >> 2) + 1 for w in set(words)}
    return np.array([known[w] for w in words], np.int64)


def _seed_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each window of SEED_WORDS words."""
    n = max(0, len(words) - SEED_WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SEED_WORDS):
        out = (out ^ words[k : k + n].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def benchmark_blocks(benchmark: DataFrame) -> Iterator[BenchmarkBlock]:
    """The whole benchmark in blocks of about BLOCK_CHARS and BLOCK_ITEMS at most, each read on its own."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-(size["chars"] or 0) // BLOCK_CHARS), -(-size["n"] // BLOCK_ITEMS))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield BenchmarkBlock.of(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, n_words`` for each document and item with at least ``coverage``.

    An item of fewer than five words is leaked by a document that has a line of
    just these words; one without words by none.  A null text leaks nothing;
    null ids stay null; repeated rows give repeated results; of matches of one
    length the first in the item, then in the document, is marked first; a very
    long text is held against the items whole; extra columns are ignored; an
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "item_id", "coverage", "n_tiles", "n_words"]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    out = None
    for block in benchmark_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, *leak) for i, t in zip(ids, batch.column(1), strict=True) for leak in sent.value.leaks(t.as_py(), coverage)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(5)], names=names)

        found = narrow.mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles long, n_words long")
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that leak an item; all columns stay as they are, whatever their names.

    Each row is judged by its own text: repeated rows go or stay alike, whatever
    their ids.  A null or empty text leaks nothing and stays; a text of any
    length is searched whole.  An empty table gives an empty result, an empty
    benchmark leaves all rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    schema, at = docs.schema, docs.columns.index("text")
    for block in benchmark_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.leaks(t.as_py(), coverage) for t in batch.column(at)], pa.bool_()))

        docs = map_arrow(docs, run, schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item and how much of it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
