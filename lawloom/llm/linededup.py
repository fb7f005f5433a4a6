"""Line dedup over a log-template tree.

The tree has a fixed depth: a line's token count, then its leading tokens
(tokens with a digit count as the wildcard).  Lines that reach one leaf and
agree in enough positions share a template, in which the positions where they
differ are variable.  Templates that recur in many different documents (in two
for lines of 50 tokens or more) are dropped from all of them but the first.

Inside a leaf no two lines are compared pair by pair.  A line of n tokens may
differ in k = n/5 positions, so the tokens behind the leading ones are cut into
k + 1 segments, of which two lines of one template share at least one.  Lines
that share a segment meet at its most frequent line, and are linked to it if
similar enough; further heads link what the first leaves apart (see
``meeting``); linked lines form a template.  Lines are counted per distinct
document text, so exact copies of a document do not make its lines recurring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, columns_of, free, map_arrow, materialise, remove, sieve, sifted, stored, table
from .meeting import components_inside

LEAST_TOKENS = 5
LEADING = 3
SIMILAR = 0.8
#: Different document texts a template must be in to be dropped.
RECURRING = 5
#: Lines of so many tokens are passages; two different document texts are enough for them.
LONG, LONG_RECURRING = 50, 2
#: Dropped lines are sent to all executors up to this count (16 bytes each); beyond it the texts are joined.
BROADCAST_LINES = 400_000
WILD = b"<*>"
_DIGITS = b"0123456789"
_hash = xxhash.xxh64_intdigest


def masked_lines(raw: bytes) -> list[list[bytes]]:
    """Tokens of each line, those with a digit masked."""
    lines = raw.split(b"\n")
    if len(raw.translate(None, _DIGITS)) == len(raw):
        return [line.split() for line in lines]
    return [[t if len(t.translate(None, _DIGITS)) == len(t) else WILD for t in line.split()] for line in lines]


def is_template(tokens: list[bytes]) -> bool:
    """Whether a line says enough to be one: LEAST_TOKENS of its tokens are not variable."""
    return len(tokens) >= LEAST_TOKENS and len(tokens) - tokens.count(WILD) >= LEAST_TOKENS


def keys_of(tokens: list[bytes]) -> tuple[int, int]:
    """Leaf and identity of a line, unsigned."""
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:LEADING])), _hash(b" ".join(tokens))


def needed(a: F.Column, b: F.Column) -> F.Column:
    """Places in which lines of ``a`` and ``b`` tokens agree at least if they share a template: SIMILAR of them, in whole numbers."""
    return F.ceil(F.greatest(a, b) * F.lit(round(100 * SIMILAR)) / 100).cast("int")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _narrow(docs: DataFrame) -> DataFrame:
    """Ids, and texts as their UTF-8 bytes; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, leaves, lines, sizes = [], [], [], [], []
        for raw in batch.column(1):
            raw = raw.as_py()
            found = {(*keys_of(t), len(t) >= LONG) for t in masked_lines(raw) if is_template(t)}
            counts.append(len(found))
            keys.append(_hash(raw))
            for leaf, line, long in found:
                leaves.append(leaf)
                lines.append(line)
                sizes.append(long)
        row = np.repeat(np.arange(len(counts)), counts)
        ids = batch.column(0).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([ids, _signed(keys).take(pa.array(row)), _signed(leaves), _signed(lines), pa.array(sizes, pa.bool_())], names=["doc_id", "text_key", "leaf", "line", "long"])


def templates(docs: DataFrame, recurring: int = RECURRING) -> tuple[DataFrame, DataFrame]:
    """The occurrences of all lines, and the dropped ones: ``(line, keeper)``.

    ``keeper`` is the smallest ``doc_id`` that has the line's template.
    """
    spark = docs.sparkSession
    arrow_batches(spark, megabytes=4)
    narrow = _narrow(docs)
    enough = F.col("support") >= F.when(F.col("long"), min(recurring, LONG_RECURRING)).otherwise(recurring)
    seen = materialise(narrow.mapInArrow(_occurrences, "doc_id long, text_key long, leaf long, line long, long boolean"), "lines-occurrences")
    written = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        table, path = stored(df, label)
        written.append(path)
        return table

    # A leaf bounds the support of its templates, and its occurrences bound the leaf: most lines go before texts are counted.
    often = kept(seen.groupBy("leaf", "long").agg(F.count("*").alias("support")).where(enough).select("leaf"), "lines-often")
    lines = sifted(seen, [F.col("leaf")], sieve(often)).groupBy("leaf", "line", "long")
    lines = kept(lines.agg(F.count_distinct("text_key").alias("support"), F.min("doc_id").alias("keeper")), "lines-distinct")
    leaves = lines.groupBy("leaf", "long").agg(F.sum("support").alias("support"), F.count("*").alias("lines"))
    # A leaf with a single line needs no comparison.
    crowded = kept(leaves.where(enough & (F.col("lines") > 1)).select("leaf"), "lines-leaves")
    alone = leaves.where(enough & (F.col("lines") == 1)).select("leaf")
    single = lines.join(alone, "leaf", "left_semi").select("line", "keeper")

    # The words of such lines are read again where they occur first, and only theirs are sent on.
    wanted = kept(lines.join(crowded, "leaf", "left_semi").select("leaf", "line", "support", "keeper"), "lines-wanted")
    again = sifted(narrow, [F.col("doc_id")], sieve(wanted.select("keeper").distinct()))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for tokens in masked_lines(raw.as_py()):
                    if is_template(tokens):
                        found[(doc_id, *keys_of(tokens))] = tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), *(_signed([k[i] for k in found]) for i in (1, 2)), pa.array(list(found.values()), pa.list_(pa.binary()))],
                names=["keeper", "leaf", "line", "tokens"],
            )

    spelled = again.mapInArrow(spell, "keeper long, leaf long, line long, tokens array<binary>")
    spelled = sifted(spelled, [F.col("line"), F.col("keeper")], sieve(wanted.select("line", "keeper"))).drop("keeper")
    spelled = spelled.join(wanted.select("leaf", "line", "support"), ["leaf", "line"])
    members = kept(spelled.groupBy("leaf", "line", "support").agg(F.min("tokens").alias("tokens")), "lines-members")
    n = F.size("tokens")
    cuts = F.floor(n * (1 - SIMILAR) + 1e-9).cast("int") + 1
    rest = n - LEADING

    def segment(s):
        a, b = F.floor(rest * s / cuts).cast("int"), F.floor(rest * (s + 1) / cuts).cast("int")
        return F.struct(s.alias("s"), F.xxhash64(F.slice("tokens", a + LEADING + 1, b - a)).alias("h"))

    cut = members.select("leaf", "line", "support", n.alias("size"), F.explode(F.transform(F.sequence(F.lit(0), cuts - 1), segment)).alias("seg"))
    entries = cut.select(F.xxhash64("leaf", "seg.s", "seg.h").alias("slot"), F.col("line").alias("node"), F.col("support").alias("weight"), "size")
    shared = entries.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot")
    entries = kept(entries.join(kept(shared, "lines-shared"), "slot", "left_semi"), "lines-entries")
    places = F.transform("tokens", lambda token, at: F.xxhash64("leaf", at, token))
    sets = kept(members.select(F.col("line").alias("node"), places.alias("own")), "lines-places")
    roots = components_inside(entries, sets, needed).select(F.col("node").alias("line"), F.col("root").alias("template"))
    named = members.select("line").join(roots, "line", "left").select("line", F.coalesce("template", "line").alias("template"))
    named = kept(named, "lines-templates")
    counted = (
        sifted(seen, [F.col("line")], sieve(named.select("line")))
        .join(named, "line")
        .groupBy("template", "long")
        .agg(F.count_distinct("text_key").alias("support"), F.min("doc_id").alias("keeper"))
        .where(enough)
    )
    grouped = named.join(counted, "template").select("line", "keeper")
    dropped = materialise(single.union(grouped), "lines-dropped")
    for path in written:
        remove(spark, path)
    return seen, dropped


def _without(raw: bytes, dropped) -> tuple[bytes, int, int]:
    """Text without the lines for which ``dropped(line)`` holds; counts of lines, and of dropped ones."""
    own, masked = raw.split(b"\n"), masked_lines(raw)
    kept = [x for x, t in zip(own, masked, strict=True) if not is_template(t) or not dropped(keys_of(t)[1])]
    return b"\n".join(kept), len(own), len(own) - len(kept)


def drop_lines(docs: DataFrame, recurring: int = RECURRING, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with recurring lines removed from ``text``, and ``n_lines, n_dropped`` added.

    Lines with fewer than five tokens that are not variable are never dropped.  The document with the
    smallest id keeps its lines of a template (if no id is known, all keep
    them).  A null text stays null with no lines; an empty text has one line;
    rows of one id are treated alike; other columns stay as they are (a new
    name that is taken gets an underscore); an empty table gives an empty result.
    All lines of a very long text count; its words are held at once.
    """
    spark = docs.sparkSession
    added = free(docs.columns, "n_lines", "n_dropped")
    seen, dropped = templates(docs, recurring)
    arrow_batches(spark, megabytes=4)  # comparing lines has set its own
    columns, at = docs.columns, docs.columns.index("text")
    result = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    names = [f"c{i}" for i in range(len(result))]

    def rebuilt(batch: pa.RecordBatch, decide) -> pa.RecordBatch:
        texts, totals, gone = [], [], []
        for row, text in enumerate(batch.column(at)):
            text = text.as_py()
            rule = decide(row)
            if text is None:
                out, n, d = None, 0, 0
            elif rule is None:
                out, n, d = text, text.count("\n") + 1, 0
            else:
                kept, n, d = _without(text.encode("utf-8", "surrogatepass"), rule)
                out = kept.decode("utf-8", "surrogatepass") if d else text
            texts.append(out)
            totals.append(n)
            gone.append(d)
        own = [batch.column(i) for i in range(len(columns))]
        own[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([*own, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=names)

    id_at = columns.index("doc_id")
    if dropped.count() <= broadcast_lines:
        got = dropped.toArrow()
        keepers = dict(zip(got["line"].to_numpy().view(np.uint64).tolist(), got["keeper"].to_pylist(), strict=True))
        sent = spark.sparkContext.broadcast(keepers)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keepers = sent.value
            for batch in batches:
                ids = batch.column(id_at).to_pylist()

                def decide(row, ids=ids):
                    own = ids[row]
                    return lambda line: line in keepers and keepers[line] is not None and keepers[line] != own

                yield rebuilt(batch, decide)

        return map_arrow(docs, mapped, result)

    # Too many to send: each document gets the list of its own dropped lines.
    own_id, own_lost = free(docs.columns, "own_id", "own_lost")
    lost = (
        seen.join(dropped, "line")
        .where("keeper is not null and not (doc_id <=> keeper)")
        .groupBy(F.col("doc_id").alias(own_id))
        .agg(F.collect_set("line").alias(own_lost))
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(columns)).to_pylist()

            def decide(row, lists=lists):
                return {line % (1 << 64) for line in lists[row]}.__contains__ if lists[row] else None

            yield rebuilt(batch, decide)

    whole = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)), "left")
    return map_arrow(whole.select(*columns_of(docs), own_lost), joined, result)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the remaining text's digest of every document."""
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
