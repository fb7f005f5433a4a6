"""Odd tables for every operator, and queries against brute force on the smallest tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.llm import audio, chat, decontaminate, language, linededup, mixing, nearcopies, quality, registry, secrets, simhash, toxicity

SMALL = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["lang_pred", "score", "predicted", "held_out", "toxic", "p_toxic", "label", "feature", "found", "likely", "fp", "node", "slot", "word", "bits", "at", "i", "t"]


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def models(spark):
    rng = random.Random(2)
    rows = [(i, _words(rng, 30) + (" vilewort drekkum" * 3 if i % 3 == 0 else ""), "ab"[i % 2], "s", 9) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    return language.fit_language_model(docs, 100), toxicity.fit_severity(docs, labels, 100), quality.fit_quality(docs, labels, 100)


def _operators(spark, models):
    """Each operator on documents, as a function to rows."""
    tongue, severity, rules = models
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    turns = lambda df: df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    return {
        "op1": lambda df: decontaminate.drop_leaks(df, bench),
        "op2": lambda df: chat.read_back(chat.format_conversations(turns(df))),
        "op3": lambda df: toxicity.score_severity(df, severity),
        "op4": mixing.mix,
        "op5": secrets.scan,
        "op6": lambda df: language.predict_language(df, tongue),
        "op7": lambda df: quality.score_quality(df, rules),
        "op8": simhash.near_duplicates,
        "op9": lambda df: audio.media_columns(df, stored=False),
        "op10": linededup.drop_lines,
        "near copies": nearcopies.near_copies,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "near copies"])
def test_odd_tables(spark, models, name):
    """Nulls, empty and very long texts, repeated rows, clashing names; and no rows at all."""
    run = _operators(spark, models)[name]
    long = "lorem ipsum dolor\n" * 60_000  # a million characters
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "same text of two"), (5, "same text of two"), (None, "no id"), (None, None), (6, long)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("a"), "source": F.lit(None).cast("string")})
    odd = odd.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    out = run(odd).collect()
    count = len({r[0] for r in rows}) if name == "op2" else len(rows)
    assert len(out) == count
    assert run(odd.where("false")).count() == 0


def test_one_id_with_very_many_rows_is_one_example(spark):
    rows = [(1, f"vilewort number {i}", "a", "s", 9) for i in range(500)] + [(i, "kind words", "a", "s", 9) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, DOCS)
    sample = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, label int")
    from lawloom.llm.learn import examples

    got = {r["doc_id"]: r["text"] for r in examples(docs, sample).collect()}
    assert len(got) == 39 and got[1] == "vilewort number 0"


def test_frequencies_are_those_of_all_texts(spark):
    texts = ["ab ab", "ab", None, "12", "cd"]
    n, counts = language.bucket_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(1 << language.BITS, int)
    for t in ("ab ab", "ab", "cd"):
        want[language.gram_counts(t)[0]] += 1
    assert n == 3 and (counts == want).all()


def test_expected_severity_is_the_plain_sum(models):
    """Of k * P(grade = k), with P(grade > k) = 1 / (1 + exp(t_k - w.x)) and rates of words and beginnings."""
    model = models[1]
    text = "some words vilewort drekkum vilewort and others"
    names = defaultdict(int)
    for w in text.split():
        for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)]:
            names[f] += 1
    x = sum(model.weights[model.index[f]] * np.log(1 + 100 * n / len(text.split())) for f, n in names.items() if f in model.index)
    above = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
    p = [1 - above[0], *(a - b for a, b in zip(above, [*above[1:], 0.0]))]
    assert abs(model.severity(text)[0] - sum(k * q for k, q in enumerate(p))) < 1e-9
    assert abs(model.severity(text)[1] - above[0]) < 1e-9 and len(p) == toxicity.GRADES


def _plain_line_dedup(texts, recurring=5):
    """Lines dropped from each document, by comparing all pairs of a leaf."""
    lines = defaultdict(set)
    for i, t in texts.items():
        for own in linededup.masked_lines((t or "").encode()):
            if linededup.is_template(own):
                lines[tuple(own)].add(i)
    leaves = defaultdict(list)
    for own in lines:
        leaves[len(own), own[:3]].append(own)
    root = {own: own for own in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for members in leaves.values():
        for k, a in enumerate(members):
            for b in members[:k]:
                if 10 * sum(x == y for x, y in zip(a, b)) >= 8 * len(a):
                    root[find(a)] = find(b)
    holders, different = defaultdict(set), defaultdict(set)
    for own, ids in lines.items():
        holders[find(own)] |= ids
        different[find(own)] |= {texts[i] for i in ids}
    dropped = dict.fromkeys(texts, 0)
    for i, t in texts.items():
        for own in linededup.masked_lines((t or "").encode()):
            if tuple(own) in lines:
                r = find(tuple(own))
                dropped[i] += len(different[r]) >= (2 if len(own) >= 50 else recurring) and i != min(holders[r])
    return dropped


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_all_pairs(spark, seed):
    """Few words, few leaves, lines at all distances from each other, frequent ones that are unlike the rest."""
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmnop") * 3 for _ in range(n)] for n in (9, 10, 11, 15, 55) for _ in range(3)]
    for k in range(0, len(bases), 3):  # one leaf for bases of a length, some segments in common
        bases[k + 1][:6] = bases[k][:6]
        bases[k + 2][:3] = bases[k][:3]
        bases[k + 2][-3:] = bases[k][-3:]
    texts = {}
    for i in range(60):
        lines = []
        for _ in range(4):
            own = list(rng.choice(bases))
            for _ in range(rng.randrange(1 + len(own) // 4)):
                own[rng.randrange(3, len(own))] = rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(2, 5)
            lines.append(" ".join(own))
        texts[i] = "\n".join(lines)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    want = _plain_line_dedup(texts)
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.drop_lines(df).collect()} == want and sum(want.values()) > 60


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
def test_line_dedup_query_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_dropped"] for r in registry.QUERIES["op10_line_dedup"](spark, str(SMALL)).collect()}
    assert got == _plain_line_dedup(texts) and sum(got.values()) > 20


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
def test_media_query_payloads(spark):
    import hashlib
    import zlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in registry.QUERIES["op9_audio_features"](spark, str(SMALL)).collect():
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = audio.to_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(media))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["tensor_shape"].endswith("x64x24")


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
def test_mixing_query_reads_each_document_as_often_as_its_weight_asks(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("n", mixing.token_count(F.col("text"))).collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += r["n"]
    rows = registry.QUERIES["op4_source_mixing"](spark, str(SMALL)).collect()
    read = defaultdict(int)
    for r in rows:
        read[r["source"]] += r["n_tokens"]
    most, least = max(sizes.values()), min(sizes.values())
    steps = [k / 20000 for k in range(20001)]

    def entropy(a):
        z = sum(n**a for n in sizes.values())
        return -sum(n**a / z * np.log(n**a / z) for n in sizes.values())

    flat = max(a for a in steps if entropy(a) >= mixing.EVENNESS * np.log(len(sizes)))
    a = max(flat, min(a for a in steps if (most / least) ** (1 - a) <= mixing.REPEAT + 1e-9))
    longest, budget, z = max(r["n"] for r in docs), sum(sizes.values()), sum((n / most) ** a for n in sizes.values())
    assert sum(read.values()) <= budget * 1.001 + 2
    assert max(Counter((r["doc_id"], r["epoch"]) for r in rows).values()) == 1
    for s, n in sizes.items():
        quota = budget / z * (n / most) ** a
        assert quota - longest < read[s] <= quota * 1.001 + 2, s
