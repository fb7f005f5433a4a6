"""Mixing sources to target weights: temperature mixing realised as block permutations.

A source with n tokens gets a weight in proportion to n ** a.  The exponent a
is bisected: flat enough for the wanted entropy, but not so flat that a small
source is repeated more often than allowed (the limit on repetition wins).
Each source's weight becomes a quota of tokens.  A source is cut into blocks by
a hash of its documents; every epoch reads the blocks in another permutation,
and the last one stops where the quota is used up, inside a block if need be.

Sources are never collected: every bisection step is one aggregation that tries
many exponents at once.  Hot sources have more blocks, not larger ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import columns_of, free, materialise, table

BLOCK_TOKENS = 2_000_000
EVENNESS = 0.97
REPEAT = 4.0
SEED = 20
#: Blocks grow with the corpus, so that there are this many at most, and one more for each source.
MOST_BLOCKS = 20_000
#: Rows of the block plan that are sent to all executors at most; with more (some 30 000 sources) the documents are shuffled.
BROADCAST_BLOCKS = 50_000
STEPS, WIDTH = 5, 24


def token_count(text: Column) -> Column:
    """Words between white space; none for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _bisect(sizes: DataFrame, holds, low: float = 0.0, high: float = 1.0) -> float:
    """The largest exponent for which ``holds(row of sums, exponent)``, if it holds up to some point; else ``low``."""
    for _ in range(STEPS):
        tries = [low + (high - low) * k / WIDTH for k in range(1, WIDTH + 1)]
        ln = F.col("ln")
        sums = sizes.agg(
            *(F.sum(F.exp(ln * a)).alias(f"z{k}") for k, a in enumerate(tries)),
            *(F.sum(F.exp(ln * a) * ln).alias(f"l{k}") for k, a in enumerate(tries)),
        ).first()
        fine = [holds(sums[f"z{k}"], sums[f"l{k}"], a) for k, a in enumerate(tries)]
        last = max((k for k in range(WIDTH) if fine[k]), default=-1)
        if last == WIDTH - 1:
            return high
        low, high = (tries[last] if last >= 0 else low), tries[last + 1]
    return low


def exponent(sizes: DataFrame, evenness: float = EVENNESS, repeat: float = REPEAT) -> float:
    """The temperature exponent in [0, 1] for ``sizes(source, tokens)``, to six decimals.

    The largest one whose weights reach ``evenness`` of the greatest entropy,
    raised if a source would be read more than ``repeat`` times as often as the
    largest.
    """
    sizes = sizes.where("tokens > 0")
    span = sizes.agg(F.count("*").alias("k"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if span["k"] < 2:
        return 1.0
    sized = materialise(sizes.select(F.log(F.col("tokens") / F.lit(span["most"])).alias("ln")), "mixing-sizes")
    target = evenness * math.log(span["k"])
    flat = _bisect(sized, lambda z, l, a: math.log(z) - a * l / z >= target)
    ratio = math.log(span["most"] / span["least"])
    # Repetition falls as the exponent grows, so 1 - a is bisected for the largest that stays within the limit.
    low, high = 0.0, 1.0
    if ratio > math.log(repeat):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if ratio * mid <= math.log(repeat) else (low, mid)
        high = low
    return round(min(1.0, max(flat, 1.0 - high)), 6)


def _name(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def _key(doc_id: Column, text: Column) -> Column:
    """The order of documents in a block; repeated rows have one key."""
    return F.xxhash64(F.lit(SEED), F.coalesce(doc_id.cast("long"), F.xxhash64(text)))


def plan(docs: DataFrame, evenness: float = EVENNESS, repeat: float = REPEAT, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, passes: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``sources(src, tokens, weight, quota, blocks)`` and the block plan.

    ``budget`` is the number of tokens to read, or ``passes`` times the corpus'
    own if that is given.  Without either the quotas are the smallest in proportion to the weights
    that read every source once at least.  The block plan has a row per block
    and epoch: ``src, block, epoch, position, cutoff``; of a block with a
    ``cutoff`` only documents with a key up to it are read.
    """
    narrow = docs.select(
        _name(F.col("source")).alias("src"), _key(F.col("doc_id"), F.col("text")).alias("key"), token_count(F.col("text")).alias("tokens")
    )
    narrow = materialise(narrow, "mixing-documents")
    sizes = materialise(narrow.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mixing-sources")
    a = exponent(sizes, evenness, repeat)
    total = sizes.where("tokens > 0").agg(F.max("tokens").alias("most")).first()["most"] or 1
    share = F.exp(F.log(F.col("tokens") / F.lit(total)) * a)
    weighed = sizes.withColumn("share", F.when(F.col("tokens") > 0, share).otherwise(F.lit(0.0)))
    z = weighed.agg(F.sum("share").alias("z")).first()["z"] or 1.0
    corpus = sizes.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    budget = round(passes * corpus) if passes is not None else budget
    block_tokens = max(block_tokens, -(-corpus // MOST_BLOCKS))
    whole = F.lit(float(total)) if budget is None else F.lit(budget / z)
    # The largest source's share is exactly 1, so without a budget its quota is its size.
    quota = F.when(F.col("tokens") > 0, F.floor(F.col("share") * whole + 1e-6)).otherwise(F.lit(0)).cast("long")
    sources = materialise(
        weighed.select(
            "src",
            "tokens",
            (F.col("share") / F.lit(z)).alias("weight"),
            quota.alias("quota"),
            F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"),
        ),
        "mixing-quotas",
    )
    placed = narrow.join(sources.select("src", "blocks"), "src").withColumn("block", F.pmod("key", "blocks"))
    blocks = materialise(placed.groupBy("src", "block").agg(F.sum("tokens").alias("size")), "mixing-blocks")
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    mixed = blocks.join(sources.select("src", full.alias("full"), (F.col("quota") - full * F.col("tokens")).alias("rest")), "src")
    mixed = mixed.withColumn("turn", F.xxhash64(F.lit(SEED), "src", "block", F.col("full")))
    before = W.partitionBy("src").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    mixed = materialise(mixed.withColumn("end", F.sum("size").over(before)), "mixing-turns")
    # The block in which the quota runs out: documents by key while they fit.
    broken = mixed.where("end > rest and end - size < rest").select("src", "block", (F.col("rest") - F.col("end") + F.col("size")).alias("room"))
    by_key = placed.join(broken, ["src", "block"]).groupBy("src", "block", "room", "key").agg(F.sum("tokens").alias("tokens"))
    upto = W.partitionBy("src", "block").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = by_key.withColumn("end", F.sum("tokens").over(upto)).where("end <= room").groupBy("src", "block").agg(F.max("key").alias("cutoff"))
    whole_epochs = mixed.where("full > 0").select("src", "block", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), F.lit(None).cast("long").alias("cutoff"))
    last = mixed.where("end <= rest and rest > 0").select("src", "block", F.col("full").alias("epoch"), F.lit(None).cast("long"))
    part = cut.join(mixed.select("src", "block", "full"), ["src", "block"]).select("src", "block", F.col("full").alias("epoch"), "cutoff")
    every = whole_epochs.union(last).union(part)
    order = W.partitionBy("src", "epoch").orderBy(F.xxhash64(F.lit(SEED), "src", "block", "epoch"), "block")
    return sources, materialise(every.withColumn("position", F.row_number().over(order).cast("long")), "mixing-plan")


def mix(
    docs: DataFrame, evenness: float = EVENNESS, repeat: float = REPEAT, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, passes: float | None = None
) -> DataFrame:
    """``docs``, each row as often as its source's quota asks, with ``epoch, block, position`` added.

    With a ``budget`` of tokens, or of ``passes`` over the corpus, a source
    whose quota is below its size is read in part, others more than once.
    Reading order is epoch, position, then any order in a block.  A null source
    is a source of its own; documents without tokens (null texts too) are read
    with their block; a source without any token is read once.  Repeated rows
    are read together.  A very long text is one document, read whole or not at
    all.  Other columns stay as they are (a new name that is
    taken gets an underscore); an empty table gives an empty result.
    """
    epoch, block, position, src, key, cuts, reading, read = free(
        docs.columns, "epoch", "block", "position", "src", "key", "cuts", "reading", "read"
    )
    sources, blocks = plan(docs, evenness, repeat, budget, block_tokens, passes)
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_BLOCKS else df
    reads = blocks.groupBy("src", "block").agg(F.collect_list(F.struct("epoch", "position", "cutoff")).alias("reads"))
    keyed = docs.withColumns({src: _name(F.col("source")), key: _key(F.col("doc_id"), F.col("text"))})
    keyed = keyed.join(few(sources.select(F.col("src").alias(src), F.col("blocks").alias(cuts))), src)
    keyed = keyed.withColumn(block, F.pmod(F.col(key), F.col(cuts)))
    reads = few(reads.select(F.col("src").alias(src), F.col("block").alias(block), F.col("reads").alias(reading)))
    own = F.filter(reading, lambda r: r["cutoff"].isNull() | (F.col(key) <= r["cutoff"]))
    told = keyed.join(reads, [src, block]).withColumn(read, F.explode(own))
    return told.select(*columns_of(docs), F.col(read)["epoch"].alias(epoch), block, F.col(read)["position"].alias(position))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a document in a run with as many tokens as the corpus has: its epoch, block, and the block's place in that epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, passes=1.0).select("doc_id", "source", "epoch", "block", "position", token_count(F.col("text")).alias("n_tokens"))
