"""Near copies and recurring lines, against all pairs."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lawloom.llm import common, linededup, meeting, nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def _word(k):
    return "w" + "".join("abcdefghij"[int(d)] for d in str(k))


def _sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _least(ids, linked):
    root = {n: n for n in ids}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in ids}


def _planted(rng):
    texts = []
    for size in (40, 90, 250, 600):
        for _ in range(8):
            own = [_word(rng.randrange(3000)) for _ in range(size)]
            texts.append(" ".join(own))
            for share in (0.005, 0.012, 0.02, 0.05):
                near = list(own)
                for _ in range(max(1, round(size * share))):
                    near[rng.randrange(size)] = _word(rng.randrange(3000))
                texts.append(" ".join(near))
    star = [_word(rng.randrange(3000)) for _ in range(120)]
    for i in range(25):  # copies like the original, yet not like each other
        near = list(star)
        near[4 * i + 9] = near[(4 * i + 60) % 120] = f"edit{'abcdefghijklmnopqrstuvwxyz'[i]}"
        texts.append(" ".join(near))
    texts += [" ".join(star), "A few words", "a FEW  words", "a few other", None, "", " \n"]
    rng.shuffle(texts)
    return texts


def test_pipeline_stage_keeps_one_of_all_similar_texts(spark):
    texts = _planted(random.Random(3))
    sets = [_sets(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    roots = _least(range(len(texts)), pairs)
    want = {i for i, r in roots.items() if i == r}
    assert len(pairs) > 60 and len(want) < len(texts) - 40
    kept = corpus_pipeline.near_dedup_stage(spark, _docs(spark, texts), "")
    assert {r["doc_id"] for r in kept.collect()} == want


def test_near_copies_rows_without_ids_and_empty_tables(spark):
    texts = ["one two three four five six"] * 3 + ["", None, "seven"]
    kept = nearcopies.keep_one(_docs(spark, texts, [None, 4, 5, 6, 7, 8]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "6", "8", "None"]
    assert nearcopies.keep_one(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("rounds, most, seed", [(1, 0, 0), (6, 0, 1), (6, 10**9, 2), (2, 0, 3)])
def test_components_inside_are_those_of_all_pairs(spark, rounds, most, seed):
    """Groups of sets around a few centres, at all distances from them, some elements common to all."""
    rng = random.Random(seed)
    sets = []
    for centre in range(5):
        base = [centre * 1000 + k for k in range(rng.randrange(12, 30))] + list(range(9000, 9000 + rng.randrange(8)))
        for _ in range(24):
            gone = rng.randrange(0, len(base) // 3)
            own = set(rng.sample(base, len(base) - gone)) | {centre * 1000 + 500 + rng.randrange(60) for _ in range(rng.randrange(5))}
            sets.append(own)
    like = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like(sets[i], sets[j])]
    roots = _least(range(len(sets)), pairs)
    assert len(pairs) > 20 and len(set(roots.values())) > 20
    entries = spark.createDataFrame([(e, n, n % 5, len(own)) for n, own in enumerate(sets) for e in own], "slot long, node long, weight long, size int")
    table = spark.createDataFrame([(n, sorted(own)) for n, own in enumerate(sets)], "node long, own array<long>")
    got = {r["node"]: r["root"] for r in meeting.components_inside(entries, table, nearcopies.needed, rounds, most).collect()}
    assert got == {n: r for n, r in roots.items() if n in {x for p in pairs for x in p}}


def test_needed_overlaps_are_whole_number_bounds(spark):
    rows = spark.range(1, 200).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(0, 200).select(F.col("id").cast("int").alias("b")))
    for r in rows.select("a", "b", nearcopies.needed(F.col("a"), F.col("b")).alias("jaccard"), linededup.needed(F.col("a"), F.col("b")).alias("places")).collect():
        a, b = r["a"], r["b"]
        most = max(a, b)
        want = min(o for o in range(most + b + 1) if 5 * o >= 4 * (a + b - o) and 5 * o >= 4 * most)
        assert r["jaccard"] == want and r["places"] == -(-4 * most // 5)


def test_one_id_with_unlike_texts_loses_neither(spark):
    rng = random.Random(15)
    long = [" ".join(_word(rng.randrange(3000)) for _ in range(80)) for _ in range(4)]
    near = long[0] + " tail"
    #       two documents of id 1; a near copy of the first; a repeated row; rows without ids
    texts = [long[0], long[1], near, long[2], long[2], long[3], long[3], long[1]]
    ids = [1, 1, 2, 3, 3, None, None, None]
    want = sorted([(1, long[0]), (1, long[1]), (3, long[2])]) + sorted([(None, long[3]), (None, long[1])], key=str)
    for keep in (nearcopies.keep_one, simhash.keep_one):
        got = [(r["doc_id"], r["text"]) for r in keep(_docs(spark, texts, ids)).collect()]
        if keep is simhash.keep_one:  # the tail changes more than three bits, or not: both are texts of ids of their own
            got = [g for g in got if g[0] != 2]
        assert sorted((g for g in got if g[0]), key=str) + sorted((g for g in got if not g[0]), key=str) == want


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_sieve_lets_all_keys_pass(spark, monkeypatch, words):
    """A full sieve lets everything pass; an empty one nothing."""
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    df = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("word"), F.lit(1).alias("bits"))
    keys = df.where("word % 3 = 0 or word is null").select("word")
    inside = {r["word"] for r in common.sifted(df, [F.col("word")], common.sieve(keys)).collect()}
    outside = {r["word"] for r in common.sifted(df, [F.col("word")], common.sieve(keys), inside=False).collect()}
    assert not inside & outside and len(inside | outside) == 3000 and {None, 3, 2997} <= inside
    assert len(inside) < 1100 if words > 1 else not outside
    assert common.sifted(df, [F.col("word")], common.sieve(keys.where("false"))).count() == 0


def _lined(rng, lines):
    own = [" ".join(_word(rng.randrange(10**6)) for _ in range(12)) for _ in range(2)]
    return "\n".join([own[0], *lines, own[1]])


def test_two_templates_that_share_a_leaf_and_a_segment(spark):
    """A frequent line must not hide the lines that are unlike it."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(32)]
    texts = [_lined(rng, ["Please read the full terms of our online shop"]) for _ in range(10)]
    texts += [_lined(rng, [f"Please read the full terms of use by {n}"]) for n in names]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_lines(_docs(spark, texts)).collect()}
    assert got == {i: int(i not in (0, 10)) for i in range(42)}


@pytest.mark.parametrize("send", [9, 0])
def test_long_lines_are_dropped_from_the_second_document_on(spark, send):
    rng = random.Random(6)
    long, longer, short = ([_word(rng.randrange(5000)) for _ in range(n)] for n in (50, 70, 49))
    near = list(longer)
    near[30:44] = [_word(rng.randrange(5000)) for _ in range(14)]  # 56 of 70 places agree
    far = list(long)
    far[20:31] = [_word(rng.randrange(5000)) for _ in range(11)]  # 39 of 50 do
    texts = [_lined(rng, [" ".join(x) for x in lines]) for lines in ((long, short), (long, short), (longer,), (near,), (far, short), (short,))]
    texts.append(texts[4])  # an exact copy adds no support
    out = {r["doc_id"]: r for r in linededup.drop_lines(_docs(spark, texts), broadcast_lines=send).collect()}
    assert [out[i]["n_dropped"] for i in range(7)] == [0, 1, 0, 1, 0, 0, 0]
    assert " ".join(long) not in out[1]["text"] and " ".join(short) in out[1]["text"]


def test_pipeline_stage_finds_copies_by_simhash(spark, monkeypatch):
    """without any band, texts within three bits still meet, and only those that are similar enough are one group."""
    rng = random.Random(11)
    texts = []
    while len(texts) < 12:
        words = [_word(rng.randrange(3000)) for _ in range(300)]
        near = [*words[:-2], "edit", *words[-2:]]
        pair = " ".join(words), " ".join(near)
        one, two = (int.from_bytes(simhash.fingerprint(t), "big") for t in pair)
        if 0 < (one ^ two).bit_count() <= 3:
            texts += pair
    burst = ["aa", "bb", "cc"] * 400  # three shingles that alone make the fingerprint of texts with little in common
    texts += [" ".join(burst + [_word(rng.randrange(3000)) for _ in range(150)]) for _ in range(2)]
    one, two = (int.from_bytes(simhash.fingerprint(t), "big") for t in texts[-2:])
    assert (one ^ two).bit_count() <= 3
    docs, plain, met = _docs(spark, texts), nearcopies.components_inside, []

    def by_simhash_only(entries, sets, needed):
        entries = entries.join(nearcopies.simhash_slots(docs).select("slot").distinct(), "slot", "left_semi")
        met.append(entries.count())
        return plain(entries, sets, needed)

    monkeypatch.setattr(nearcopies, "components_inside", by_simhash_only)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    first = min(r["doc_id"] for r in docs.collect())
    assert met == [14] and kept == {first + k for k in (0, 2, 4, 6, 8, 10, 12, 13)}


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_line_dedup_sends_only_lines_that_can_recur(spark):
    """op10: lines that no other line resembles stay out of the shuffles, and steps go when the last one stands."""
    rng = random.Random(7)
    own = [" ".join(f"{rng.getrandbits(48):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(12)) for _ in range(6000)]
    texts = ["\n".join([*own[20 * i : 20 * i + 20], f"this notice was sent out by office {_word(i)} to all"]) for i in range(300)]
    df, tables = common.materialise(_docs(spark, texts), "given"), set(os.listdir(common.shared_dir(spark)))
    before, limit = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        got = linededup.drop_lines(df).agg(F.sum("n_lines"), F.sum("n_dropped")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert tuple(got) == (6300, 299)
    assert _shuffled(spark) - before < 0.4 * sum(map(len, texts))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(common.shared_dir(spark))) - tables}
    assert {n for n in left if n.startswith("lines-")} == {"lines-occurrences", "lines-dropped"}
