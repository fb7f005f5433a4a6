"""Importance resampling and exact dedup: against brute force, on the supplied tables and on odd ones."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lawloom.llm import exactdedup, registry, resample

SMALL = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = ["rank", "score", "weight", "n_words", "n_features", "row", "hit", "digest", "keep", "kept", "best", "own", "length", "head", "size", "ident", "digest_", "word", "bits"]


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_grams(words, longest):
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_ranks(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """``doc_id: (n_features, weight, score, rank)`` by loops over dictionaries."""
    bucket = lambda g: zlib.crc32(g.encode("utf-8")) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, plain_grams(plain_words(x), longest)))
    for x in target:
        t.update(map(bucket, plain_grams(plain_words(x), longest)))
    whole, aimed = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (aimed + buckets)))) for b in range(buckets)]
    out, able = {}, []
    for i, x in docs:
        words = plain_words(x)
        grams = plain_grams(words, longest)
        weight = sum(gain[bucket(g)] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(grams), weight, score)
        able += [(-score, i)] * (len(words) >= least)
    rank = {i: k + 1 for k, (_, i) in enumerate(sorted(able)[: len(able) * percent // 100])}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_runs_are_all_n_grams(longest, monkeypatch):
    """Every place gets the checksum of its n-gram, over blocks of any length."""
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["a", "b", "Ab", "é9", "zz"]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "a" * 50, "-- //", "x-y,Z"]
    for block in (7, 64, 1 << 20):
        monkeypatch.setattr(resample, "BLOCK_WORDS", block)
        ids, vocabulary, counts = resample.words_of(pa.array(texts))
        assert [vocabulary[i].decode() for i in ids] == [w for x in texts for w in plain_words(x)]
        got = [Counter() for _ in texts]
        for text, found in resample._blocks(ids, vocabulary, counts, longest, 1 << 32):
            for k, b in zip(text.tolist(), found.tolist(), strict=True):
                got[k][b] += 1
        assert got == [Counter(zlib.crc32(g.encode()) for g in plain_grams(plain_words(x), longest)) for x in texts]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    ids, ends = rng.integers(0, 3, 300), np.array([1, 50, 51, 180, 300])
    room = ends[np.searchsorted(ends, np.arange(300), "right")] - np.arange(300)
    for longest in (1, 2, 3, 4, 6):
        order, shared = resample.suffix_array(ids, room, longest)
        cut = [tuple(ids[p : p + min(longest, room[p])]) for p in order]
        assert [c[:longest] for c in cut] == sorted(c[:longest] for c in cut)
        for k in range(1, 300):
            a, b = cut[k - 1], cut[k]
            n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == n


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
def test_query_by_plain_loops(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = registry.QUERIES["op11_importance_resampling"](spark, str(SMALL))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_ranks(docs, target)


@pytest.mark.parametrize("longest,percent", [(2, 30), (3, 100), (1, 1)])
def test_draw_of_longer_n_grams(spark, longest, percent):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["red", "green", "Blue", "x1", "ö"]) for _ in range(rng.randrange(12)))) for i in range(300)]
    df, target = spark.createDataFrame(docs, "doc_id long, text string"), ["green green x1", "blue"]
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    options = {"longest": longest, "buckets": 97, "percent": percent, "least_words": 4, "seed": 7}
    want = plain_ranks(docs, target, longest, 97, percent, 4, 7)
    got = resample.importance_ranks(df, aim, **options).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got} == want
    drawn = resample.resample(df.withColumn("score", F.lit("mine")), aim, **options)
    assert drawn.columns == ["doc_id", "text", "score", "n_words", "n_features", "weight", "score_"]
    rows = drawn.collect()
    assert {r["doc_id"] for r in rows} == {i for i, v in want.items() if v[3]} and {r["score"] for r in rows} <= {"mine"}


def test_equal_scores_go_by_id(spark):
    rows = [(7, 20, 100), (3, 20, 100), (5, 20, 100), (4, 19, 900), (1, 20, 50), (None, 20, None), (9, 30, 700), (2, 20, 10), (6, 20, 10), (8, 20, 10), (10, 20, 10)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long")
    ranked, last = resample._drawn(scored, 30, 20)
    assert last == 100 and {r["doc_id"]: r["rank"] for r in ranked.collect() if r["rank"]} == {9: 1, 3: 2, 5: 3}
    assert ranked.count() == len(rows)


def _odd(spark):
    long = "lorem ipsum dolor\n" * 60_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "Same text of two"), (5, "same Text of two"), (None, "no id"), (None, None), (6, long.upper()), (None, "NO ID"), (8, "É"), (9, "é")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    return odd.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})


def test_resampling_of_odd_tables(spark):
    odd = _odd(spark)
    aim = spark.createDataFrame([("lorem same",)], "text string")
    got = resample.importance_ranks(odd, aim, percent=100).collect()
    assert len(got) == 12
    by_id = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by_id[1]["n_features"] == by_id[2]["n_features"] == by_id[3]["n_features"] == 0 and by_id[1]["weight"] == 0
    assert by_id[4]["n_features"] == 180_000 and {by_id[4]["rank"], by_id[6]["rank"]} == {1, 2}
    assert all(r["score"] is None and r["rank"] is None for r in got if r["doc_id"] is None)
    drawn = resample.resample(odd, aim, percent=100, least_words=2)
    assert drawn.columns == odd.columns + ["n_words_", "n_features_", "weight_", "score_"]
    assert sorted(r["doc_id"] for r in drawn.collect()) == [4, 5, 5, 6]
    none = odd.where("false")
    assert resample.importance_ranks(none, aim).count() == 0 and resample.resample(none, aim).count() == 0
    flat = resample.importance_ranks(odd, aim.where("false")).collect()
    assert len(flat) == 12 and resample.importance_ranks(none, none).count() == 0


def _plain_copies(rows):
    """Group size and kept id of each row."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")
    groups = {}
    for i, x in rows:
        groups.setdefault(key(x), []).append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [(i, best[key(x)], len(groups[key(x)]), hashlib.sha256(key(x).encode()).hexdigest()) for i, x in rows]


def test_copies_of_odd_tables(spark):
    odd = _odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for every in (False, True):
        got = exactdedup.mark_copies(odd, every_digest=every).collect()
        sure = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]
        if every:
            assert sorted(map(repr, sure)) == sorted(map(repr, _plain_copies(rows)))
        assert sorted(repr(x[:3]) for x in sure) == sorted(repr(x[:3]) for x in _plain_copies(rows))
        assert sum(r["kept"] for r in got) == len({r[3] for r in _plain_copies(rows)})
        assert all(r["kept"] <= (r["doc_id"] == r["keep_id"]) for r in got)
    left = exactdedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(map(repr, [2, 3, 6, 5, None, 8, 9]))
    assert exactdedup.mark_copies(odd.where("false")).count() == 0 and exactdedup.drop_copies(odd.where("false")).count() == 0


def test_refinement_hashes_only_survivors(spark):
    """Of texts that share neither length nor prefix with another no full hash is made."""
    head = "p" * exactdedup.PREFIX
    rows = [(1, "alone in its length"), (2, "same length A?"), (3, "another head!!"), (4, head + "one tail"), (5, head + "two tail"), (6, head + "ONE tail")]
    got = {r["doc_id"]: r for r in exactdedup.mark_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text_sha256"] is None for i in range(1, 7)] == [True, True, True, False, False, False]
    assert [(got[i]["keep_id"], got[i]["kept"], got[i]["group_size"]) for i in range(1, 7)] == [(1, True, 1), (2, True, 1), (3, True, 1), (6, False, 2), (5, True, 1), (6, True, 2)]


def test_random_copies(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abAB é") for _ in range(rng.choice([0, 3, 3, 90]))) for _ in range(80)]
    rows = [(rng.randrange(200) if rng.random() < 0.9 else None, rng.choice([str, str.lower])(rng.choice(base))) for _ in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exactdedup.mark_copies(df, every_digest=True)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got.collect()) == sorted(map(repr, _plain_copies(rows)))
    left = [(r["doc_id"], hashlib.sha256(r["t"].encode()).hexdigest()) for r in exactdedup.drop_copies(df).select("doc_id", exactdedup.normal(F.col("text")).alias("t")).collect()]
    assert sorted(map(repr, left)) == sorted({repr((x[1], x[3])) for x in _plain_copies(rows)})
    assert not any("Python" in p or "Arrow" in p for p in [got._jdf.queryExecution().executedPlan().toString()])
