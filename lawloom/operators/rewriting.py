"""Proofs of implications by rewriting: congruence closure over a bounded universe of terms.

A law ``h`` proves an equation ``s = t`` if steps that replace an instance of
one side of ``h`` by the other lead from ``s`` to ``t``.  The variables of the
equation are constants then.  Per hypothesis and number of constants there is
one universe, all terms over them of a bounded number of operations, whose
equalities are closed under the instances of ``h`` and under the operation.  All equations that
are asked of a hypothesis are read off the same closure.

Pairs are grouped by hypothesis, and hypotheses are dealt over the cluster; a
task holds one universe and one closure at a time (some 130 000 numbers per
round at most).  A proof is returned as the chain of whole terms, so that ``replayed``
can check it step by step without the closure.  What is not proved stays open:
the bound on terms never makes an implication false.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..shipping import ship

Term = tuple[int, ...]
#: Operations in a term of the universe, by the number of constants: larger terms where there are fewer.
DEPTH = {1: 8, 2: 6, 3: 5, 4: 4, 5: 4, 6: 4}
PROOF = "proved boolean, steps int, chain array<array<int>>"


@cache
class Universe:
    """All terms of up to ``depth`` operations over ``names`` constants, numbered by size; ``-1`` stands for none."""

    def __init__(self, names: int, depth: int):
        self.depth = depth
        count, self.start = [names], [0, names]
        for n in range(1, depth + 1):
            count.append(sum(count[k] * count[n - 1 - k] for k in range(n)))
            self.start.append(self.start[-1] + count[-1])
        self.count, size = np.array(count), self.start[-1]
        self.ops = np.repeat(np.arange(depth + 1), count)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        #: Where the terms of k operations on the left and m on the right begin.
        self.base = np.full((depth + 1, depth + 1), -1)
        for n in range(1, depth + 1):
            at = self.start[n]
            for k in range(n):
                m, a, b = n - 1 - k, count[k], count[n - 1 - k]
                self.base[k, m] = at
                self.left[at : at + a * b] = np.repeat(np.arange(a), b) + self.start[k]
                self.right[at : at + a * b] = np.tile(np.arange(b), a) + self.start[m]
                at += a * b
        # Per term: its place among those of its size, and their number.
        self.place = np.arange(size) - np.array(self.start)[self.ops]
        self.alike = self.count[self.ops]

    def composed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The terms of the operation on terms that are known to be small enough."""
        return self.base[self.ops[a], self.ops[b]] + self.place[a] * self.alike[b] + self.place[b]

    def pair(self, a: int, b: int) -> int:
        """The term of the operation on two terms, if it is small enough."""
        if a < 0 or b < 0 or self.ops[a] + self.ops[b] >= self.depth:
            return -1
        k, m = self.ops[a], self.ops[b]
        return int(self.base[k, m] + (a - self.start[k]) * self.count[m] + b - self.start[m])

    def number(self, term: Term) -> int:
        stack: list[int] = []
        for t in term:
            if t == terms.OP:
                b, a = stack.pop(), stack.pop()
                stack.append(self.pair(a, b))
            else:
                stack.append(t)
        return stack[0]

    def term(self, x: int) -> Term:
        return (int(x),) if self.left[x] < 0 else self.term(self.left[x]) + self.term(self.right[x]) + (terms.OP,)

    def matched(self, pattern: Term) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The terms that are instances of the pattern, and what each variable stands for in them."""
        every = np.arange(len(self.ops))
        ends, stack = {}, []  # the place where the operands of each operation end
        for i, t in enumerate(pattern):
            if t == terms.OP:
                right, left = stack.pop(), stack.pop()
                ends[i] = (left, right)
            stack.append(i)
        bound: dict[int, np.ndarray] = {}
        todo = [(len(pattern) - 1, every)]
        while todo:
            at, values = todo.pop()
            if pattern[at] == terms.OP:
                held = self.left[values] >= 0
                every, values = every[held], values[held]
                bound = {v: x[held] for v, x in bound.items()}
                todo = [(i, x[held]) for i, x in todo]
                todo += [(ends[at][0], self.left[values]), (ends[at][1], self.right[values])]
            elif pattern[at] in bound:
                held = bound[pattern[at]] == values
                every, bound, todo = every[held], {v: x[held] for v, x in bound.items()}, [(i, x[held]) for i, x in todo]
            else:
                bound[pattern[at]] = values
        return every, bound


def _spans(begins: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the groups, one group after the other, and which of the groups each is of."""
    counts = begins[groups + 1] - begins[groups]
    of = np.repeat(np.arange(len(groups)), counts)
    return np.arange(len(of)) + (begins[groups] - np.cumsum(counts) + counts)[of], of


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each value occurs first, ascending."""
    return np.sort(np.unique(values, return_index=True)[1])


class Closure:
    """What a law makes equal in a universe, round by round: ``rounds[k]`` has each term's least equal after k rounds."""

    def __init__(self, universe: Universe, lhs: Term, rhs: Term):
        self.universe, self.lhs, self.rhs = universe, lhs, rhs
        (a, x), (b, y) = universe.matched(lhs), universe.matched(rhs)
        shared = sorted(set(x) & set(y))
        # Both sides' instances with the same values of the shared variables are one group, whatever the other variables are.
        self.members, group = np.concatenate((a, b)), np.zeros(len(a) + len(b), np.int64)
        for v in shared:
            column = np.concatenate((x[v], y[v]))
            group = np.unique(group * (int(column.max(initial=0)) + 1) + column, return_inverse=True)[1]
        self.group, self.groups = group, int(group.max(initial=-1)) + 1
        self.made = np.flatnonzero(universe.left >= 0)
        low = np.full(self.groups, len(universe.ops))
        np.minimum.at(low, group, self.members)
        self.rounds = [np.arange(len(universe.ops))]
        # Instances are told apart by terms, not by classes, so what they merge is merged in the first round.
        label = self._merged(self.rounds[0].copy(), self.members, low[group])
        while (label != self.rounds[-1]).any():
            self.rounds.append(label)
            label = self._merged(label.copy(), self.made, self.congruent(len(self.rounds) - 1))
        self._direct = self._held(self.members, group, self.groups)
        self._of: tuple[np.ndarray, np.ndarray] | None = None
        self._indirect: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._chains: dict[tuple[int, int], list[Term]] = {}

    def congruent(self, k: int) -> np.ndarray:
        """For each composed term the one of its operands' least equals after round k: no larger, so it is in the universe."""
        label = self.rounds[k]
        return self.universe.composed(label[self.universe.left[self.made]], label[self.universe.right[self.made]])

    @staticmethod
    def _merged(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Labels after each of ``one`` is made equal to its place in ``two``; in place."""
        while True:
            a, b = label[one], label[two]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                return label
            one, two, a, b = one[apart], two[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]

    @staticmethod
    def _held(members: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The members group by group, in their order, and where each group begins."""
        return members[np.argsort(group, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))

    def _steps(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups of terms that are one step or equal operands (after round k) apart: their members, where each begins, and each term's last group."""
        if k not in self._indirect:
            size, least = len(self.universe.ops), self.congruent(k)
            (a, at), (b, bt) = self._direct, self._held(self.made, least, size)
            own = np.full(size, -1)
            own[self.made] = least + self.groups
            self._indirect[k] = np.concatenate((a, b)), np.concatenate((at, bt[1:] + len(a))), own
        return self._indirect[k]

    def _groups_of(self, front: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of terms, in the terms' order: those of instances first, then that of equal operands; and the place of each one's term."""
        if self._of is None:
            self._of = self._held(self.group, self.members, len(self.universe.ops))
        held, begins = self._of
        at, place = _spans(begins, front)
        last = np.flatnonzero(own[front] >= 0)
        keys, place = np.concatenate((held[at], own[front[last]])), np.concatenate((place, last))
        order = np.argsort(place, kind="stable")
        return keys[order], place[order]

    def equal(self, s: int, t: int) -> bool:
        return s >= 0 and t >= 0 and self.rounds[-1][s] == self.rounds[-1][t]

    def chain(self, s: int, t: int) -> list[Term]:
        """Terms from s to t, each one replacement by the law from the next; they may outgrow the universe."""
        if s == t:
            return [self.universe.term(s)]
        if (s, t) not in self._chains:
            self._chains[s, t] = self._found(s, t)
        return self._chains[s, t]

    def _found(self, s: int, t: int) -> list[Term]:
        k = next(i for i, label in enumerate(self.rounds) if label[s] == label[t])
        # Inside the class, breadth first over instances and over terms whose operands were equal a round earlier; a level at a time.
        members, begins, own = self._steps(k - 1)
        came, direct, seen = np.full(len(own), -1), np.zeros(len(own), bool), np.zeros(len(begins), bool)
        front, came[s] = np.array([s]), s
        while came[t] < 0:
            keys, place = self._groups_of(front, own)
            some = _firsts(keys)
            some = some[~seen[keys[some]]]
            keys, place = keys[some], place[some]
            seen[keys] = True
            at, key = _spans(begins, keys)
            nodes = members[at]
            hit = np.flatnonzero(nodes == t)[:1]
            if not len(hit):
                new = np.flatnonzero(came[nodes] < 0)
                hit = new[_firsts(nodes[new])]
            nodes, key = nodes[hit], key[hit]
            came[nodes], direct[nodes] = front[place[key]], keys[key] < self.groups
            front = nodes
        steps, at = [], t
        while at != s:
            steps.append((int(came[at]), at, direct[at]))
            at = int(came[at])
        out = [self.universe.term(s)]
        for x, y, instance in reversed(steps):
            if instance:
                out += self._between(x, y)
                continue
            u = self.universe
            first, second = self.chain(int(u.left[x]), int(u.left[y])), self.chain(int(u.right[x]), int(u.right[y]))
            out += [a + second[0] + (terms.OP,) for a in first[1:]] + [first[-1] + b + (terms.OP,) for b in second[1:]]
        return out

    def _between(self, x: int, y: int) -> list[Term]:
        """From one member of a group to another: at once, or over an instance of the other side if both are of one side."""
        a, b = self.universe.term(x), self.universe.term(y)
        if is_step(_tree(self.lhs), _tree(self.rhs), _tree(a), _tree(b)):
            return [b]
        for one, two in ((self.lhs, self.rhs), (self.rhs, self.lhs)):
            values: dict = {}
            if _fits(_tree(one), _tree(a), values):
                middle = tuple(t for v in two for t in ((v,) if v == terms.OP else _postfix(values.get(v, 0))))
                if is_step(_tree(two), _tree(one), _tree(middle), _tree(b)):
                    return [middle, b]
        raise AssertionError("members of one group are two steps apart at most")


def _flat(lhs, rhs) -> tuple[Term, Term]:
    return tuple(map(int, lhs)), tuple(map(int, rhs))


def proofs(pairs: DataFrame, laws_df: DataFrame, hyp: str = "hyp", concl: str = "concl", key: str = "node", most: int = 6) -> DataFrame:
    """``pairs`` of law numbers with ``proved`` (true, or null: not within the bound), ``steps`` and the ``chain`` of terms.

    ``laws_df`` has ``key, lhs, rhs``.  Distinct pairs are proved once, all of a
    hypothesis together.  Conclusions of more than ``most`` variables, and pairs
    with a null or unknown number, stay null.  An empty table gives an empty result.
    """
    spark = pairs.sparkSession
    ship(spark)
    side = lambda n, c: laws_df.select(F.col(key).alias(n), F.col("lhs").alias(f"{c}l"), F.col("rhs").alias(f"{c}r"))
    asked = pairs.select(F.col(hyp).alias("h"), F.col(concl).alias("c")).where("h is not null and c is not null").distinct()
    asked = asked.join(side("h", "h"), "h").join(side("c", "c"), "c")
    names = F.array_max(F.concat("cl", "cr")) + 1
    asked = asked.withColumn("names", names).where(F.col("names") <= most)
    parts = max(8, 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, closure = None, None
        for batch in batches:
            rows = []
            for h, c, names, hl, hr, cl, cr in zip(*(batch[x] for x in ("h", "c", "names", "hl", "hr", "cl", "cr")), strict=True):
                if last != (h, names):  # rows come in this order, so each closure is made once
                    last, closure = (h, names), Closure(Universe(int(names), DEPTH[int(names)]), *_flat(hl, hr))
                s, t = (closure.universe.number(x) for x in _flat(cl, cr))
                chain = [list(x) for x in closure.chain(s, t)] if closure.equal(s, t) else None
                rows.append((h, c, True if chain else None, len(chain) - 1 if chain else None, chain))
            out = pd.DataFrame(rows, columns=["h", "c", "proved", "steps", "chain"])
            yield out.astype({"h": "int32", "c": "int32", "proved": "boolean", "steps": "Int32"})

    told = asked.repartition(parts, "h").sortWithinPartitions("h", "names").mapInPandas(run, f"h int, c int, {PROOF}")
    return pairs.join(told, (F.col(hyp) == F.col("h")) & (F.col(concl) == F.col("c")), "left").drop("h", "c")


def _tree(term: Term):
    stack: list = []
    for t in term:
        stack.append((stack.pop(-2), stack.pop()) if t == terms.OP else int(t))
    return stack[0]


def _postfix(tree) -> Term:
    return (*_postfix(tree[0]), *_postfix(tree[1]), terms.OP) if isinstance(tree, tuple) else (tree,)


def _fits(pattern, tree, values: dict) -> bool:
    if isinstance(pattern, tuple):
        return isinstance(tree, tuple) and _fits(pattern[0], tree[0], values) and _fits(pattern[1], tree[1], values)
    return values.setdefault(pattern, tree) == tree


def is_step(lhs, rhs, a, b) -> bool:
    """Whether tree ``b`` is tree ``a`` with an instance of one side, somewhere in it, replaced by the other side's."""
    for one, two in ((lhs, rhs), (rhs, lhs)):
        values: dict = {}
        if _fits(one, a, values) and _fits(two, b, values):
            return True
    if isinstance(a, tuple) and isinstance(b, tuple):
        return (a[1] == b[1] and is_step(lhs, rhs, a[0], b[0])) or (a[0] == b[0] and is_step(lhs, rhs, a[1], b[1]))
    return False


def replayed(proved: DataFrame, laws_df: DataFrame, hyp: str = "hyp", concl: str = "concl", key: str = "node") -> DataFrame:
    """``proved`` (with ``chain``) and ``valid``: the chain begins and ends with the conclusion's sides, and each step is one by the hypothesis.

    Only the chain is looked at, by plain matching of trees.  Null where there is no chain.
    """
    ship(proved.sparkSession)

    def check(hl: pd.Series, hr: pd.Series, cl: pd.Series, cr: pd.Series, chain: pd.Series) -> pd.Series:
        out = []
        for a, b, s, t, c in zip(hl, hr, cl, cr, chain, strict=True):
            if c is None:
                out.append(None)
                continue
            lhs, rhs, *trees = map(_tree, (a, b, s, t, *c))
            first, last, steps = trees[0], trees[1], trees[2:]
            out.append(steps[0] == first and steps[-1] == last and all(is_step(lhs, rhs, x, y) for x, y in zip(steps, steps[1:], strict=False)))
        return pd.Series(out, dtype="boolean")

    side = lambda n: F.broadcast(laws_df.select(F.col(key).alias(f"{n}k"), F.col("lhs").alias(f"{n}l"), F.col("rhs").alias(f"{n}r")))
    met = proved.join(side("__h"), F.col(hyp) == F.col("__hk"), "left").join(side("__c"), F.col(concl) == F.col("__ck"), "left")
    udf = F.pandas_udf(check, "boolean")
    return met.withColumn("valid", udf("__hl", "__hr", "__cl", "__cr", "chain")).drop("__hk", "__hl", "__hr", "__ck", "__cl", "__cr")
