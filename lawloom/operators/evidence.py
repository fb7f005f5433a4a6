"""Evidence on implications between the laws of the catalogue.

A packed matrix has a row per hypothesis: ``hyp, statuses array<tinyint>``, the
status of each conclusion in order.  Its size is fixed by the catalogue: 4694
rows of 4694 bytes, 22 MB, so it may be broadcast.  It is either read from
published outcomes (``lawloom.sources.readers``) or derived here.  What is
derived is sound and incomplete: a counterexample table refutes, a rule proves,
and everything else stays unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..shipping import ship
from .catalogue import CATALOGUE_SIZE, MAX_ORDER, law_number, laws, shape_list
from .magmas import signatures

#: Status codes, their names, and the outcome words they stand for.  Fixed values.
STATUSES = ("proof_false", "proof_true", "conjecture_false", "conjecture_true", "unknown")
PROOF_FALSE, PROOF_TRUE, CONJECTURE_FALSE, CONJECTURE_TRUE, UNKNOWN = range(5)
OUTCOMES = {
    "explicit_proof_false": 0, "implicit_proof_false": 0, "explicit_proof_true": 1, "implicit_proof_true": 1,
    "explicit_conjecture_false": 2, "implicit_conjecture_false": 2, "explicit_conjecture_true": 3,
    "implicit_conjecture_true": 3, "unknown": 4,
}
#: Rows of statuses that a task hands on at once; as Python numbers, on the way to Arrow, they take eight times their bytes and more.
PIECE = 32
_kept: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()

Term = tuple[int, ...]


def _terms_up_to(order: int, names: int) -> list[Term]:
    """All postfix terms of at most ``order`` operations over ``names`` variables."""
    by_order: list[list[Term]] = [[(v,) for v in range(names)]]
    for n in range(1, order + 1):
        by_order.append([a + b + (terms.OP,) for k in range(n) for a in by_order[k] for b in by_order[n - 1 - k]])
    return [t for level in by_order for t in level]


def _put(term: Term, values: list[Term]) -> Term:
    """The term with its variables replaced."""
    out: list[int] = []
    for t in term:
        out.extend((t,) if t == terms.OP else values[t])
    return tuple(out)


def instances(lhs: Term, rhs: Term, max_order: int = MAX_ORDER) -> Iterator[tuple[Term, Term]]:
    """Equations of at most ``max_order`` operations that follow from a law by putting terms for its variables.

    Variables of the instance are numbered by first use, which is all that
    counts up to renaming.
    """
    places = [t for t in lhs + rhs if t != terms.OP]
    uses = [places.count(v) for v in range(max(places) + 1)]
    room = max_order - lhs.count(terms.OP) - rhs.count(terms.OP)

    def choose(v: int, left: int, used: int, values: list[Term]) -> Iterator[list[Term]]:
        if v == len(uses):
            yield values
            return
        for n in range(left // uses[v] + 1):
            for shape in shape_list(n):
                yield from fill(v, left - n * uses[v], used, values, shape, ())

    def fill(v: int, left: int, used: int, values: list[Term], shape: Term, done: Term) -> Iterator[list[Term]]:
        at = len(done)
        while at < len(shape) and shape[at] == terms.OP:
            done += (terms.OP,)
            at += 1
        if at == len(shape):
            yield from choose(v + 1, left, used, [*values, done])
            return
        for x in range(used + 1):
            yield from fill(v, left, max(used, x + 1), values, shape, done + (x,))

    for values in choose(0, room, 0, []):
        yield _put(lhs, values), _put(rhs, values)


def in_context(lhs: Term, rhs: Term, max_order: int = MAX_ORDER) -> Iterator[tuple[Term, Term]]:
    """The equation, and it put into equal surroundings on both sides, as far as ``max_order`` allows."""
    yield lhs, rhs
    room = max_order - lhs.count(terms.OP) - rhs.count(terms.OP) - 2
    if room < 0:
        return
    names = max(t for t in lhs + rhs) + 1
    for other in _terms_up_to(room // 2, names + room // 2 + 1):
        for a, b in ((lhs + other, rhs + other), (other + lhs, other + rhs)):
            yield from in_context(a + (terms.OP,), b + (terms.OP,), max_order)


def _follows(lhs: Term, rhs: Term) -> np.ndarray:
    """Numbers of the laws that a law proves by one step, ascending."""
    if len(lhs) == 1 and lhs[0] not in rhs:
        return np.arange(1, CATALOGUE_SIZE + 1, dtype=np.int32)
    found = {law_number(*e) for i in instances(lhs, rhs) for e in in_context(*i)} - {0}
    return np.array(sorted(found), np.int32)


def _by_rules(spark: SparkSession, out: str, row: Callable[[int, np.ndarray], pd.DataFrame]) -> DataFrame:
    """What ``row`` makes of each law's number and the laws that follow from it."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, lhs, rhs in zip(batch["node"], batch["lhs"], batch["rhs"], strict=True):
                yield row(node, _follows(tuple(map(int, lhs)), tuple(map(int, rhs))))

    parts = max(8, spark.sparkContext.defaultParallelism)
    return laws(spark).select("node", "lhs", "rhs").repartition(parts, "node").mapInPandas(run, out)


def proof_rules(spark: SparkSession) -> DataFrame:
    """``(hyp, concl)``: implications proved by one step.

    A law implies its instances, in equal surroundings; a law ``v = t`` without
    v in t implies every law.
    """
    return _by_rules(spark, "hyp int, concl int", lambda node, found: pd.DataFrame({"hyp": np.int32(node), "concl": found}))


def proof_rows(spark: SparkSession) -> DataFrame:
    """``(hyp, bits binary)``: as ``proof_rules``, a bit per conclusion, 587 bytes a law; the millions of pairs stay in the tasks."""

    def row(node: int, found: np.ndarray) -> pd.DataFrame:
        told = np.zeros(CATALOGUE_SIZE, bool)
        told[found - 1] = True
        return pd.DataFrame({"hyp": np.array([node], np.int32), "bits": [np.packbits(told).tobytes()]})

    return _by_rules(spark, "hyp int, bits binary", row)


def _closed(bits: np.ndarray) -> np.ndarray:
    """Transitive closure of packed rows, in place."""
    for k in range(len(bits)):
        rows = np.flatnonzero(bits[:, k >> 3] & (0x80 >> (k & 7)))
        bits[rows] |= bits[k]
    return bits


def closure(proved: np.ndarray) -> np.ndarray:
    """Transitive closure of a square boolean matrix, over packed rows."""
    return np.unpackbits(_closed(np.packbits(proved, axis=1)), axis=1)[:, : len(proved)].astype(bool)


def derive(spark: SparkSession, sizes: tuple[int, ...] = (2, 3), rules: bool = True) -> DataFrame:
    """The packed matrix from counterexample tables of the ``sizes`` and, if wanted, proof rules.

    Without rules only the plainest facts are proved: a law implies itself and
    the first law, the second implies all.  All that meets on the driver (a
    bit per pair, a signature per law) has the catalogue's fixed size, 5 MB.
    """
    kept = _kept.setdefault(spark, {})
    if (sizes, rules) in kept:
        return kept[sizes, rules]
    got = signatures(laws(spark), sizes).toPandas().sort_values("node")
    marks = np.stack([np.frombuffer(s, np.uint8) for s in got["signature"]])
    proved = np.eye(CATALOGUE_SIZE, dtype=bool)
    proved[:, 0] = True
    proved[1, :] = True
    if rules:
        for hyp, bits in proof_rows(spark).collect():
            proved[hyp - 1] |= np.unpackbits(np.frombuffer(bits, np.uint8))[:CATALOGUE_SIZE].astype(bool)
        turned = laws(spark).select("node", "lhs", "rhs").toPandas().sort_values("node")
        dual = np.array([law_number(_mirror(tuple(a)), _mirror(tuple(b))) for a, b in zip(turned["lhs"], turned["rhs"], strict=True)]) - 1
        proved |= proved[np.ix_(dual, dual)]
    bits = np.packbits(proved, axis=1)
    sent = spark.sparkContext.broadcast((marks, _closed(bits) if rules else bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, bits = sent.value
        for hyps in (batch["hyp"][at : at + PIECE] for batch in batches for at in range(0, len(batch), PIECE)):
            rows = []
            for hyp in hyps:
                status = np.full(CATALOGUE_SIZE, UNKNOWN, np.int8)
                status[(marks[hyp - 1] & ~marks).any(axis=1)] = PROOF_FALSE
                known = np.unpackbits(bits[hyp - 1])[:CATALOGUE_SIZE].astype(bool)
                if (status[known] == PROOF_FALSE).any():
                    raise ValueError(f"law {hyp}: an implication is both proved and refuted")
                status[known] = PROOF_TRUE
                rows.append(status)
            yield pd.DataFrame({"hyp": hyps.to_numpy(), "statuses": rows})

    parts = max(8, spark.sparkContext.defaultParallelism)
    every = spark.range(1, CATALOGUE_SIZE + 1, 1, parts).select(F.col("id").cast("int").alias("hyp"))
    kept[sizes, rules] = every.mapInPandas(run, "hyp int, statuses array<tinyint>").cache()
    return kept[sizes, rules]


def _mirror(term: Term) -> Term:
    stack: list[Term] = []
    for t in term:
        if t == terms.OP:
            b, a = stack.pop(), stack.pop()
            stack.append(b + a + (terms.OP,))
        else:
            stack.append((int(t),))
    return stack[0]


def plain(spark: SparkSession) -> DataFrame:
    """The matrix of size-2 counterexamples and the plainest proofs."""
    return derive(spark, (2,), rules=False)


def edges(matrix: DataFrame) -> DataFrame:
    """``(hyp, concl, status)``: the matrix row by row, 22 million rows for the whole catalogue."""
    return matrix.select("hyp", F.posexplode("statuses").alias("p", "status")).select("hyp", (F.col("p") + 1).alias("concl"), "status")


def packed(edge_rows: DataFrame, size: int = CATALOGUE_SIZE) -> DataFrame:
    """The packed matrix of ``(hyp, concl, status)`` rows; pairs without a row are unknown."""
    found = edge_rows.groupBy("hyp").agg(F.map_from_entries(F.collect_list(F.struct("concl", F.col("status").cast("tinyint")))).alias("m"))
    filled = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(UNKNOWN).cast("tinyint")))
    return found.select("hyp", filled.alias("statuses"))


def status_counts(matrix: DataFrame) -> DataFrame:
    """``(status, name, n_pairs)`` over all ordered pairs."""
    def having(k: int):
        return F.size(F.filter("statuses", lambda s: s == k)).cast("long").alias(f"s{k}")

    per_row = [having(k) for k in range(5)]
    sums = matrix.select(*per_row).agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(5)))
    rows = F.array(*(F.struct(F.lit(k).alias("status"), F.lit(n).alias("name"), F.col(f"s{k}").alias("n_pairs")) for k, n in enumerate(STATUSES)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def checks(matrix: DataFrame) -> DataFrame:
    """``(check, failures)``: rows of full length, law 2 implies all, law 1 follows from all, nothing proved of itself refuted."""
    rows = matrix.select(
        (F.size("statuses") != CATALOGUE_SIZE).cast("long").alias("row_length"),
        F.when(F.col("hyp") == 2, F.size(F.filter("statuses", lambda s: s != PROOF_TRUE))).otherwise(0).alias("law_2_implies_all"),
        (F.get("statuses", F.lit(0)) != PROOF_TRUE).cast("long").alias("all_imply_law_1"),
        (F.get("statuses", F.col("hyp") - 1) == PROOF_FALSE).cast("long").alias("law_refutes_itself"),
    )
    names = ("row_length", "law_2_implies_all", "all_imply_law_1", "law_refutes_itself")
    sums = rows.agg(*(F.sum(n).cast("long").alias(n) for n in names))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in names))).alias("r")).select("r.*")


def with_status(pairs: DataFrame, matrix: DataFrame, hyp: str, concl: str, out: str) -> DataFrame:
    """``pairs`` with the status of ``hyp => concl``; null where a number is null or beyond the catalogue."""
    rows = F.broadcast(matrix.select(F.col("hyp").alias("__hyp"), F.col("statuses").alias("__row")))  # 22 MB at most
    status = F.when(F.col(concl) >= 1, F.get("__row", (F.col(concl) - 1).cast("int")))
    return pairs.join(rows, F.col(hyp) == F.col("__hyp"), "left").withColumn(out, status).drop("__hyp", "__row")
