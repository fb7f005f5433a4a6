"""Finite models: evaluating laws in operation tables, and refuting implications.

An operation on ``n`` elements is a row-major array of n * n results.  The laws
that hold in a table are its evidence: a table in which one law holds and
another fails refutes the implication.  Size 2 is a fold inside the JVM; size 3
and up run as Arrow batches over NumPy arrays, one law at a time over all
tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..shipping import ship

#: Six tables that tell many laws apart: both projections, exclusive or, addition mod 3, minimum, one without symmetry.  Fixed values.
NAMED_TABLES = (
    ("left projection", 2, (0, 0, 1, 1)),
    ("right projection", 2, (0, 1, 0, 1)),
    ("xor", 2, (0, 1, 1, 0)),
    ("addition mod 3", 3, (0, 1, 2, 1, 2, 0, 2, 0, 1)),
    ("minimum", 3, (0, 0, 0, 0, 1, 1, 0, 1, 2)),
    ("arbitrary", 3, (0, 2, 1, 2, 2, 0, 1, 0, 2)),
)


def table_count(n: int) -> int:
    return n ** (n * n)


def tables(spark: SparkSession, n: int) -> DataFrame:
    """``(magma_id, n, tab)``: all operations on n elements, counted like numbers in base n."""
    cells = n * n
    digits = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: (F.floor(F.col("id") / F.pow(F.lit(n), cells - 1 - i)) % n).cast("int"))
    return spark.range(table_count(n)).select(F.col("id").alias("magma_id"), F.lit(n).alias("n"), digits.alias("tab"))


def named_tables(spark: SparkSession) -> DataFrame:
    """``(name, n, tab)`` of the six fixed tables."""
    return spark.createDataFrame([(a, n, list(t)) for a, n, t in NAMED_TABLES], "name string, n int, tab array<int>")


def holds(lhs: Column, rhs: Column, n_vars: Column, tab: Column, n: Column) -> Column:
    """Whether the law holds in the table, for all values of its variables; stops at the first that fails."""

    def value(term: Column, a: Column) -> Column:
        leaf = lambda t: (F.floor(a / F.pow(n, n_vars - 1 - t)) % n).cast("int")
        return terms.fold(term, leaf, lambda x, y: F.get(tab, x * n + y), "int")

    every = F.sequence(F.lit(0), (F.pow(n, n_vars) - 1).cast("int"))
    return F.forall(every, lambda a: value(lhs, a) == value(rhs, a))


def satisfaction(laws_df: DataFrame, tables_df: DataFrame) -> DataFrame:
    """``node`` and all columns of ``tables_df`` but the table, with ``holds``, for every law and table."""
    kept = [c for c in tables_df.columns if c != "tab"]
    met = laws_df.select("node", "lhs", "rhs", "n_vars").join(F.broadcast(tables_df), F.lit(True))
    return met.select("node", *kept, holds(F.col("lhs"), F.col("rhs"), F.col("n_vars"), F.col("tab"), F.col("n")).alias("holds"))


def masks(laws_df: DataFrame, n: int = 2) -> DataFrame:
    """``(node, mask)``: bit i is set if the law holds in table i; for size 2, where 16 tables fit a number."""
    if n != 2:
        raise ValueError("a mask holds the tables of size 2; use signatures")
    sat = satisfaction(laws_df, tables(laws_df.sparkSession, 2))
    return sat.groupBy("node").agg(F.bit_or(F.when(F.col("holds"), F.call_function("shiftleft", F.lit(1), F.col("magma_id").cast("int"))).otherwise(0)).alias("mask"))


@cache
def all_tables(n: int) -> np.ndarray:
    """All tables of size n as rows, in counting order."""
    ids = np.arange(table_count(n), dtype=np.int64)
    powers = n ** np.arange(n * n - 1, -1, -1, dtype=np.int64)
    return (ids[:, None] // powers % n).astype(np.int8)


@cache
def isomorphism_classes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each class's first table in counting order, and how many tables the class has."""
    every = all_tables(n).astype(np.int64)
    powers = n ** np.arange(n * n - 1, -1, -1, dtype=np.int64)
    own = np.arange(len(every))
    least = own.copy()
    for p in permutations(range(n)):
        p = np.array(p)
        back = np.argsort(p)
        grid = every.reshape(-1, n, n)[:, back][:, :, back]
        least = np.minimum(least, (p[grid].reshape(len(every), -1) * powers).sum(axis=1))
    first = own[own == least]
    return first, np.bincount(least)[first]


def distinct_tables(n: int) -> np.ndarray:
    """One table of each isomorphism class, the first in counting order."""
    return all_tables(n)[isomorphism_classes(n)[0]]


def evaluate(postfix: list[int], values: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
    """Values of a term, tables x assignments."""
    rows = np.arange(len(flat))[:, None]
    stack: list[np.ndarray] = []
    for t in postfix:
        if t == terms.OP:
            b, a = stack.pop(), stack.pop()
            stack.append(flat[rows, a.astype(np.intp) * n + b])
        else:
            stack.append(np.broadcast_to(values[t], (len(flat), values.shape[1])))
    return stack[0]


def law_holds(lhs: list[int], rhs: list[int], flat: np.ndarray, n: int, cells: int = 1 << 22) -> np.ndarray:
    """For each table, whether the law holds; in pieces of bounded size."""
    k = max([*lhs, *rhs]) + 1
    ids = np.arange(n**k)
    values = (ids // n ** np.arange(k - 1, -1, -1)[:, None] % n).astype(np.int8)
    out = np.ones(len(flat), bool)
    step = max(1, cells // max(1, len(flat)))
    for at in range(0, len(ids), step):
        alive = np.flatnonzero(out)
        if not len(alive):
            break
        piece, some = values[:, at : at + step], flat[alive]
        out[alive] = (evaluate(lhs, piece, some, n) == evaluate(rhs, piece, some, n)).all(axis=1)
    return out


def signatures(laws_df: DataFrame, sizes: tuple[int, ...] = (2, 3), classes: bool = True, key: str = "node") -> DataFrame:
    """``(key, signature binary)``: a bit per table of the sizes, in order; ``classes``: one table per isomorphism class."""
    spark = laws_df.sparkSession
    ship(spark)
    source = distinct_tables if classes else all_tables

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = [
                np.packbits(np.concatenate([law_holds(list(a), list(b), source(n), n) for n in sizes])).tobytes()
                for a, b in zip(batch["lhs"], batch["rhs"], strict=True)
            ]
            yield pd.DataFrame({key: batch[key], "signature": bits})

    kind = laws_df.schema[key].dataType.simpleString()
    parts = max(8, spark.sparkContext.defaultParallelism)
    return laws_df.select(key, "lhs", "rhs").repartition(parts, key).mapInPandas(run, f"{key} {kind}, signature binary")


def _first_bit(a: bytes, b: bytes) -> int | None:
    """The first table in which the first law holds and the second does not."""
    found = np.flatnonzero(np.unpackbits(np.frombuffer(a, np.uint8) & ~np.frombuffer(b, np.uint8)))
    return int(found[0]) if len(found) else None


def _witness_rows(a: pd.Series, b: pd.Series, sizes: tuple[int, ...]) -> pd.DataFrame:
    starts = np.cumsum([0, *(len(isomorphism_classes(n)[0]) for n in sizes)])
    rows = []
    for x, y in zip(a, b, strict=True):
        at = _first_bit(x, y)
        if at is None:
            rows.append((None, None, None))
        else:
            k = int(np.searchsorted(starts, at, side="right")) - 1
            number = int(isomorphism_classes(sizes[k])[0][at - starts[k]])
            rows.append((sizes[k], number, all_tables(sizes[k])[number].tolist()))
    return pd.DataFrame({"n": pd.array([r[0] for r in rows], "Int32"), "magma_id": pd.array([r[1] for r in rows], "Int64"), "tab": [r[2] for r in rows]})


WITNESS = "n int, magma_id long, tab array<int>"


def brute_force(pairs: DataFrame, laws_df: DataFrame, a: str = "a", b: str = "b", max_size: int = 3, key: str = "node") -> DataFrame:
    """``pairs`` with the first counterexample in each direction up to ``max_size``.

    Adds ``a_implies_b`` and ``b_implies_a`` (false, or null: no counterexample
    is no proof), ``witness_a_not_b`` and ``witness_b_not_a`` (struct of size,
    table number, table).  Signatures are made once per law that occurs.
    """
    sizes = tuple(range(2, max_size + 1))
    used = pairs.select(F.col(a).alias(key)).union(pairs.select(F.col(b).alias(key))).distinct()
    # Isomorphic tables satisfy the same laws, so the first counterexample is the first of its class.
    made = signatures(laws_df.join(used, key, "left_semi"), sizes, key=key)
    one = made.select(F.col(key).alias("__a"), F.col("signature").alias("__sa"))
    two = made.select(F.col(key).alias("__b"), F.col("signature").alias("__sb"))

    def first(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return _witness_rows(x, y, sizes)

    met = pairs.select(a, b).distinct().join(one, F.col(a) == F.col("__a")).join(two, F.col(b) == F.col("__b"))
    udf = F.pandas_udf(first, WITNESS)
    tried = met.select(a, b, udf("__sa", "__sb").alias("w1"), udf("__sb", "__sa").alias("w2"))
    some = lambda w: F.when(F.col(f"{w}.n").isNotNull(), F.col(w))
    return pairs.join(
        tried.select(
            a, b,
            F.when(F.col("w1.n").isNotNull(), False).alias("a_implies_b"), F.when(F.col("w2.n").isNotNull(), False).alias("b_implies_a"),
            some("w1").alias("witness_a_not_b"), some("w2").alias("witness_b_not_a"),
        ),
        [a, b],
    )


def holding_tables(laws_df: DataFrame, n: int, key: str = "node") -> DataFrame:
    """``(node, n_tables)``: in how many of all tables of size n each law holds; a class counts with all its tables."""

    def count(signature: pd.Series) -> pd.Series:
        sizes = isomorphism_classes(n)[1]
        return pd.Series([int(sizes[np.unpackbits(np.frombuffer(s, np.uint8))[: len(sizes)] == 1].sum()) for s in signature], dtype="int64")

    signatures_df = signatures(laws_df, (n,), key=key)
    return signatures_df.select(key, F.pandas_udf(count, "long")("signature").alias("n_tables"))


def refuted_pairs(masks_df: DataFrame) -> DataFrame:
    """``(hyp_mask, concl_mask, n_pairs)``: mask pairs of which the first refutes the second, with how many law pairs have them.

    Laws collapse to their distinct masks first, so the pairs are those of masks, not of laws.
    """
    kinds = masks_df.groupBy("mask").agg(F.count("*").alias("n"))
    left, right = kinds.toDF("hyp_mask", "n_hyp"), kinds.toDF("concl_mask", "n_concl")
    refutes = F.col("hyp_mask").bitwiseAND(F.bitwise_not(F.col("concl_mask"))) != 0
    return left.join(F.broadcast(right), refutes).select("hyp_mask", "concl_mask", (F.col("n_hyp") * F.col("n_concl")).alias("n_pairs"))


def agrees(df: DataFrame, lhs: str, rhs: str, other_lhs: str, other_rhs: str) -> Column:
    """Whether two encodings of a law hold in the same ones of the six fixed tables."""

    def verdicts(a: str, b: str) -> Column:
        n_vars = F.array_max(F.concat(F.col(a), F.col(b))) + 1
        return F.array(*(holds(F.col(a), F.col(b), n_vars, F.array(*map(F.lit, t)), F.lit(n)) for _, n, t in NAMED_TABLES))

    return verdicts(lhs, rhs) == verdicts(other_lhs, other_rhs)
