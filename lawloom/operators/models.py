"""Counterexamples of size 4 and up: models of a law by constraint propagation, and which conclusions fail in them.

All tables of size 4 are too many to enumerate (4 ** 16).  A partial table has
an extra value for cells that are still open.  Partial tables go through the
law in batches: an instance whose two sides are known and differ ends its
table; an instance with one side known whose other side is one open cell fills
that cell.  What stays open is branched on, the batch on top of the stack first,
from starting tables that differ, so that models differ too.

Hypotheses are dealt over the cluster, and all conclusions asked of one are held
against the same models.  A table that is found is a counterexample that anybody
can check (``refuted`` does, in the JVM).  The search ends after a stated number
of batches; a pair without a table stays unknown, never true.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..shipping import ship
from .magmas import holds, law_holds

#: Batches of partial tables per law and size, tables in a batch, and models after which a search may end.
BATCHES, BATCH, ENOUGH = 100, 96, 400
SEED = 11
WITNESS = "n int, tab array<int>"


def _sides(postfix: list[int], k: int, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | bool]:
    """Values of a term under partial tables (``n``: open), its outermost cell, and whether that cell's operands are known.

    Axes are the table and each of ``k`` variables; a variable that a part of the term lacks has length 1 there.
    """
    m, cell, told, stack = n + 1, np.zeros([1] * (k + 1), np.int64), False, []
    rows = (np.arange(len(flat)) * flat.shape[1]).reshape(-1, *[1] * k)
    for t in postfix:
        if t == terms.OP:
            b, a = stack.pop(), stack.pop()
            cell, told = a * m + b, (a < n) & (b < n)
            stack.append(flat.take(rows + cell))
        else:
            stack.append(np.arange(n).reshape(1, *(n if v == t else 1 for v in range(k))))
    return stack[0], cell, told


def propagated(flat: np.ndarray, lhs: list[int], rhs: list[int], n: int) -> np.ndarray:
    """The partial tables that are not refuted, with all cells filled that the law forces."""
    k = max(*lhs, *rhs) + 1
    flat, alive, todo = flat.copy(), np.ones(len(flat), bool), np.arange(len(flat))
    while len(todo):
        some = flat[todo]
        (a, at, a_told), (b, bt, b_told) = _sides(lhs, k, some, n), _sides(rhs, k, some, n)
        shape = (len(some), *[n] * k)
        known, other = a < n, b < n
        fine = ~np.broadcast_to(known & other & (a != b), shape).reshape(len(some), -1).any(axis=1)
        filled = some.copy()
        for value, cell, forced in ((a, bt, known & ~other & b_told), (b, at, other & ~known & a_told)):
            place = np.nonzero(np.broadcast_to(forced, shape))
            filled[place[0], np.broadcast_to(cell, shape)[place]] = np.broadcast_to(value, shape)[place]  # of two that differ one stays; the next turn refutes it
        alive[todo[~fine]] = False
        todo, some, filled = todo[fine], some[fine], filled[fine]
        flat[todo] = filled
        todo = todo[(filled != some).any(axis=1)]  # the others force nothing more
    return flat[alive]


def find_models(lhs: list[int], rhs: list[int], n: int, seed: int = SEED, batches: int = BATCHES, batch: int = BATCH, enough: int = ENOUGH) -> np.ndarray:
    """Different tables of size ``n``, as rows, in which the law holds; as many as the search meets."""
    rng, m = np.random.default_rng(seed), n + 1
    start = np.full((batch, m * m), n, np.int64)
    inner = np.array([i * m + j for i in range(n) for j in range(n)])
    # Starting tables have some cells filled by chance, from none to a quarter of them.
    for k, row in enumerate(start):
        some = rng.permutation(inner)[: k % (n * n // 4 + 1)]
        row[some] = rng.integers(0, n, len(some))
    stack, found, count = [start], [], 0
    for _ in range(batches):
        if not stack or count >= enough:
            break
        flat = propagated(stack.pop(), lhs, rhs, n)
        whole = (flat[:, inner] < n).all(axis=1)
        if whole.any():
            found.append(flat[whole][:, inner])
            count += int(whole.sum())
        flat = flat[~whole]
        if len(flat):
            # Of each table the first open cell takes every value; the children are dealt into batches.
            pick = (flat[:, inner] == n).argmax(axis=1)
            grown = np.repeat(flat, n, axis=0)
            grown[np.arange(len(grown)), np.repeat(inner[pick], n)] = np.tile(np.arange(n), len(flat))
            grown = grown[rng.permutation(len(grown))]
            stack += [grown[i : i + batch] for i in range(0, len(grown), batch)]
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, n * n), np.int64)


def linear_models(n: int) -> np.ndarray:
    """Tables ``a x + b y + c`` modulo ``n``, for all a, b and c."""
    x, y = np.divmod(np.arange(n * n), n)
    a, b, c = (v.ravel()[:, None] for v in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    return (a * x + b * y + c) % n


@lru_cache(maxsize=1 << 14)
def linear_holds(lhs: tuple[int, ...], rhs: tuple[int, ...], n: int) -> np.ndarray:
    """For each of ``linear_models(n)``, whether the law holds: both sides are linear forms of its variables, with the same coefficients then."""
    k = max(*lhs, *rhs) + 1
    a, b, c = (v.ravel()[:, None] for v in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))

    def form(postfix: tuple[int, ...]) -> np.ndarray:
        stack: list[np.ndarray] = []
        for t in postfix:
            if t == terms.OP:
                y, x = stack.pop(), stack.pop()
                stack.append((a * x + b * y + c * (np.arange(k + 1) == k)) % n)
            else:
                stack.append(np.broadcast_to(np.arange(k + 1) == t, (len(a), k + 1)).astype(np.int64))
        return stack[0]

    return (form(lhs) == form(rhs)).all(axis=1)


def counterexamples(
    pairs: DataFrame, laws_df: DataFrame, sizes: tuple[int, ...] = (4,), linear: tuple[int, ...] = (4, 5, 7), hyp: str = "hyp", concl: str = "concl", key: str = "node"
) -> DataFrame:
    """``pairs`` of law numbers with ``witness`` (struct of size and table): the hypothesis holds in it, the conclusion fails; null if none was found.

    Linear tables modulo each of ``linear`` are tried first, then models of each
    of the ``sizes`` are searched.  Distinct pairs are settled once, all of a
    hypothesis together.  Null and unknown numbers get null; an empty table
    gives an empty result.
    """
    spark = pairs.sparkSession
    ship(spark)
    side = lambda n, c: laws_df.select(F.col(key).alias(n), F.col("lhs").alias(f"{c}l"), F.col("rhs").alias(f"{c}r"))
    asked = pairs.select(F.col(hyp).alias("h"), F.col(concl).alias("c")).where("h is not null and c is not null").distinct()
    asked = asked.join(side("h", "h"), "h").join(side("c", "c"), "c")
    parts = max(8, 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, own in batch.groupby("h"):
                law = tuple(tuple(map(int, own[x].iloc[0])) for x in ("hl", "hr"))
                left = {int(c): (tuple(map(int, a)), tuple(map(int, b))) for c, a, b in zip(own["c"], own["cl"], own["cr"], strict=True)}

                def settle(n: int, found: np.ndarray, failing: Callable[[tuple, tuple], np.ndarray], h: int = h, left: dict = left) -> None:
                    for c, sides in list(left.items()):
                        fails = np.flatnonzero(failing(*sides)) if len(found) else []
                        if len(fails):
                            rows.append((h, c, n, found[fails[0]].tolist()))
                            del left[c]

                for n in linear:
                    held = np.flatnonzero(linear_holds(*law, n))
                    settle(n, linear_models(n)[held], lambda cl, cr, n=n, held=held: ~linear_holds(cl, cr, n)[held])
                for n in sizes:
                    if left:
                        found = find_models(*map(list, law), n, seed=SEED + int(h))
                        settle(n, found, lambda cl, cr, n=n, found=found: ~law_holds(cl, cr, found, n))
            yield pd.DataFrame(rows, columns=["h", "c", "n", "tab"]).astype({"h": "int32", "c": "int32", "n": "int32"})

    told = asked.repartition(parts, "h").sortWithinPartitions("h").mapInPandas(run, f"h int, c int, {WITNESS}")
    told = told.select("h", "c", F.struct("n", "tab").alias("witness"))
    return pairs.join(told, (F.col(hyp) == F.col("h")) & (F.col(concl) == F.col("c")), "left").drop("h", "c")


def refuted(witnessed: DataFrame, laws_df: DataFrame, hyp: str = "hyp", concl: str = "concl", key: str = "node") -> DataFrame:
    """``witnessed`` (with ``witness``) and ``valid``: the hypothesis holds in the table and the conclusion does not; null without a table.

    Evaluated by the engine's fold in the JVM, not by the search.
    """
    side = lambda n: F.broadcast(laws_df.select(F.col(key).alias(f"{n}k"), F.col("lhs").alias(f"{n}l"), F.col("rhs").alias(f"{n}r"), F.col("n_vars").alias(f"{n}v")))
    met = witnessed.join(side("__h"), F.col(hyp) == F.col("__hk"), "left").join(side("__c"), F.col(concl) == F.col("__ck"), "left")
    true = lambda n: holds(F.col(f"{n}l"), F.col(f"{n}r"), F.col(f"{n}v"), F.col("witness.tab"), F.col("witness.n"))
    told = F.when(F.col("witness").isNotNull(), true("__h") & ~true("__c"))
    return met.withColumn("valid", told).drop(*(f"{n}{x}" for n in ("__h", "__c") for x in "klrv"))
