"""Near-duplicates, components, leaks and line dedup, against brute force."""

from __future__ import annotations

import os
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lawloom.llm import common, decontaminate, linededup, simhash
from lawloom.llm.components import connected_components, stars

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def _word(k):
    return "w" + "".join("abcdefghij"[int(d)] for d in str(k))


def _words(rng, n, vocabulary=400):
    return " ".join(_word(rng.randrange(vocabulary)) for _ in range(n))


def _plain_fingerprint(text, width=3):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", raw) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "Ä b C d é", "x y z " * 50, "tab\tand\x0bline\x0c breaks\r\nhere"])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == _plain_fingerprint(text)


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = _components({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in wanted.items() if n in got}
    assert set(got) == {n for a, b in edges if a != b for n in (a, b)}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot", [64, 3, 1])
def test_links_lose_no_component(spark, hot):
    """Crowded slots take the other way; both must give the components of all pairs."""
    rng = random.Random(hot)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(60)}
    fps |= {base & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(20)} | {rng.getrandbits(64) for _ in range(30)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    u64 = lambda v: v % (1 << 64)
    true = {(a, b) for a in signed for b in signed if a < b and bin(u64(a) ^ u64(b)).count("1") <= 3}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in simhash.links(df, hot).collect()}
    assert got <= true
    if hot == 64:
        assert got == true
    assert _components(signed, got) == _components(signed, true)


def test_near_duplicates(spark):
    rng = random.Random(1)
    long = [_words(rng, 400) for _ in range(6)]
    near = long[0].replace(long[0].split()[200], "changed", 1)
    texts = [*long, near, long[1], None, "", long[2].upper()]
    df = _docs(spark, texts).withColumn("fp", F.lit("taken"))  # a clashing name
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    prints = [_plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert got == _components(range(len(texts)), pairs)
    assert got[7] == 1 and got[9] == 8 and got[10] == 2
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_repeated_rows_and_missing_ids(spark):
    df = _docs(spark, ["a b c d", "a b c d", "a b c d", "x y z q"], [3, 3, None, None])
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 4
    assert {r["component_id"] for r in got if r["doc_id"] == 3} == {3}
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(df).collect()) == ["3", "None", "None"]
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def _plain_tiles(item, doc, least):
    """Greedy string tiling by trying every pair of places."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_i[i + k] and free_d[j + k]:
                    k += 1
                if k >= least and (not best or k >= best[0][0]):
                    best = [(k, i, j)] if not best or k > best[0][0] else [*best, (k, i, j)]
        if not best:
            return out
        for k, i, j in best:
            if all(free_i[i : i + k]) and all(free_d[j : j + k]):
                free_i[i : i + k] = free_d[j : j + k] = [False] * k
                out.append((i, j, k))


@pytest.mark.parametrize("seed", range(25))
def test_tiling(seed):
    rng = random.Random(seed)
    item = [rng.randrange(1, 9) for _ in range(rng.randrange(5, 60))]
    cut = rng.randrange(len(item))
    doc = [rng.randrange(1, 9) for _ in range(20)] + item[cut:] + [0] + item[:cut] + [rng.randrange(1, 9) for _ in range(10)]
    got = decontaminate.tiles(item, doc)
    for i, j, k in got:
        assert item[i : i + k] == doc[j : j + k] and k >= 5
    for side in (0, 1):
        places = [p for t in got for p in range(t[side], t[side] + t[2])]
        assert len(places) == len(set(places))
    assert got == _plain_tiles(item, doc, 5)


@pytest.mark.parametrize("start", [5, 6, 40])
def test_tiling_of_periodic_texts(start):
    item, doc = [1, 2, 3, 1, 2, 4] * 9, [1, 2, 3, 1, 2, 4] * 5 + [9] + [2, 3, 1, 2, 4, 1] * 6
    assert decontaminate.tiles(item, doc, 5, start) == _plain_tiles(item, doc, 5)


def test_many_items_with_a_common_stem(spark):
    """They share a seed with the document, which covers too little of them to be tiled."""
    rng = random.Random(7)
    rows = [(k, "which of the following statements is true " + _words(rng, 25, 9000)) for k in range(5000)]
    block = decontaminate.BenchmarkBlock.of(rows)
    text = "which of the following statements is true " + _words(rng, 400, 9000) + " " + rows[77][1]
    begin = time.perf_counter()
    for _ in range(10):
        assert [x[:2] for x in block.leaks(text, 0.6)] == [(77, 1.0)]
    assert time.perf_counter() - begin < 2


def test_leaks(spark):
    rng = random.Random(3)
    items = [_words(rng, 40, 5000) for _ in range(4)] + ["too short to tell", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[1].split()
    texts = [
        _words(rng, 300, 5000),
        _words(rng, 50, 5000) + " " + items[0].upper() + ". " + _words(rng, 9, 5000),
        _words(rng, 20, 5000) + " " + " ".join(w[20:]) + " between " + " ".join(w[:20]),
        " ".join(items[2].split()[:10]),
        None, "", "other words\ntoo short, to tell!",
    ]
    df = _docs(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (6, 4)}  # a short item is a whole line of document 6
    assert got[1, 0]["coverage"] == 1.0 and got[2, 1]["coverage"] == 1.0 and got[2, 1]["n_tiles"] == 2
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {0, 3, 4, 5}
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(df, bench.where("false")).count() == len(texts)
    assert decontaminate.find_leaks(df.where("false"), bench).count() == 0
    clashing = df.withColumns({"item_id": F.lit(1), "coverage": F.lit("x"), "n_tiles": F.lit(2)})
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(clashing, bench).collect()} == set(got)


def test_leaks_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = [_words(rng, 30, 5000) for _ in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = _docs(spark, [items[i] + " and more" for i in range(9)])
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == {(i, i) for i in range(9)}
    assert decontaminate.drop_leaks(df, bench).count() == 0


BOILER = "Copyright notice number {} of this most excellent site applies here"


def _lined(rng, extra):
    lines = [_words(rng, 12, 5000) for _ in range(4)]
    return "\n".join(lines[:2] + extra + lines[2:])


@pytest.mark.parametrize("send", [1_000_000, 0])
def test_line_dedup(spark, send):
    rng = random.Random(9)
    passage = _words(rng, 60, 5000)
    texts = [_lined(rng, [BOILER.format(i), "ok"]) for i in range(8)] + [_lined(rng, [passage, f"{rng.random()} 1 2 3 4 5 6"]) for _ in range(6)]
    texts += [_lined(rng, ["seen in two documents only, so it stays here"]) for _ in range(2)]
    texts += [texts[-1]] * 9 + [None, "", "one line"]
    df = _docs(spark, texts)
    out = linededup.drop_lines(df, broadcast_lines=send)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*df.columns, "n_lines", "n_dropped"] and len(got) == len(texts)
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        if 1 <= i < 8:  # the first document keeps the template's line
            lines = [x for x in lines if not x.startswith("Copyright")]
        if 9 <= i < 14:
            lines = [x for x in lines if x != passage]  # rows of numbers are no template
        assert got[i]["text"] == (None if text is None else "\n".join(lines)), i
        assert got[i]["n_dropped"] == (1 if 1 <= i < 8 or 9 <= i < 14 else 0)
    assert linededup.drop_lines(_docs(spark, []), broadcast_lines=send).count() == 0


def test_similar_lines_share_a_template(spark):
    rng = random.Random(2)
    common = "the quick brown fox jumps over the lazy dog near river banks at dawn today".split()
    texts = []
    for _ in range(7):
        line = list(common)
        line[rng.randrange(3, len(line))] = f"name{'abcdefgh'[rng.randrange(8)]}"
        texts.append(_lined(rng, [" ".join(line)]))
    dropped = linededup.drop_lines(_docs(spark, texts)).agg(F.sum("n_dropped")).first()[0]
    assert dropped == 6


def test_clashing_names(spark):
    """Names that operators use inside, or add, may be there already; so may odd ones."""
    import corpus_pipeline

    rng = random.Random(12)
    names = ["N_LINES", "n_dropped", "fp", "component_id", "line", "keeper", "own_id", "own_lost", "by_text", "epoch", "block", "position",
             "src", "key", "read", "toxic", "label", "words", "a.b", "x y"]
    df = _docs(spark, [_words(rng, 30) for _ in range(5)] + [None, ""])
    df = df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    bench = spark.createDataFrame([(1, _words(rng, 30))], "item_id long, text string")
    for send in (9, 0):
        assert linededup.drop_lines(df, broadcast_lines=send).columns == [*df.columns, "n_lines_", "n_dropped_"]
    assert simhash.near_duplicates(df).count() == 7
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 6
    assert decontaminate.drop_leaks(df, bench).columns == df.columns
    mixed = corpus_pipeline.mixing_stage(spark, df, "")
    assert mixed.columns == [*df.columns, "epoch_", "block_", "position_"] and mixed.count() == 7
    assert corpus_pipeline.line_dedup_stage(spark, df, "").columns == df.columns


def test_written_tables_can_be_discarded(spark):
    from lawloom.llm import common

    common.discard(spark)
    df = common.materialise(spark.range(5), "some-table")
    assert df.count() == 5
    assert common.discard(spark) == 1
    with pytest.raises(Exception, match="(?i)does not exist|not exist|not found"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_a_task_contracts_its_links_to_stars_and_no_more_of_them():
    rng = np.random.default_rng(11)
    for n in (0, 1, 5, 60):
        u, v = rng.integers(-20, 60, n), rng.integers(-20, 60, n)
        above, root = stars(u, v)
        groups = {}
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            whole = groups.get(a, {a}) | groups.get(b, {b})
            groups |= dict.fromkeys(whole, whole)
        assert dict(zip(above.tolist(), root.tolist(), strict=True)) == {x: min(g) for x, g in groups.items() if x != min(g)}
        assert len(above) <= n


def test_components_of_many_partitions_leave_one_table_and_no_checkpoint(spark, tmp_path):
    """Round 3, pipeline on check_h: each step of a round was a checkpoint, read and written by a task for each partition, and stayed on the disk."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 400
        links = spark.range(1, n).selectExpr("id as u", "id - 1 as v").union(spark.range(n + 1, 2 * n).selectExpr(f"{n}L as u", "id as v")).repartition(40)
        before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
        found = connected_components(links)
        assert {r["node"]: r["root"] for r in found.collect()} == {i: 0 if i < n else n for i in range(2 * n)}
        left = set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) - before
        assert [x.split("-")[0] for x in left] == ["components"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
