"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived while
the plan is built (AND over the parts every match must contain, OR over the
spellings of a part, AND over a spelling's trigrams).  One pass over the texts
writes the posting lists of the trigrams that some query names; queries are
answered by intersecting posting lists.  The candidates go to all executors as
a sieve of bounded size, so texts stay where they are and only those in it are
verified with the expression itself.  A rule without a mandatory trigram is
scanned for in every text.
"""

from __future__ import annotations

import re._constants as C
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, materialise, sieve, table

#: Spellings of one part of an expression; a part with more counts as unknown.
SPELLINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to find, which group's length counts, and how long it must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed by the contract of the base kinds.
ASSIGN = (
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (
    Rule("assign", ASSIGN, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE


def _fold(text: str) -> str:
    """ASCII letters lowered: the index ignores case."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Clauses that all hold for a text with a match; a clause holds if one of its trigram sets is all there.

    An empty list means that nothing is mandatory.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def flush(run: set[str]) -> set[str]:
        if run and min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(frozenset(s for s in sets if not any(o < s for o in sets)))
        return {""}

    def spellings(node) -> set[str] | None:
        """All strings the node can match, folded; None if unknown or too many."""
        kind, arg = node
        if kind is C.LITERAL:
            return {_fold(chr(arg))}
        if kind is C.IN:
            out: set[str] = set()
            for k, v in arg:
                if k is C.LITERAL:
                    out.add(_fold(chr(v)))
                elif k is C.RANGE and v[1] - v[0] < SPELLINGS:
                    out |= {_fold(chr(c)) for c in range(v[0], v[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if kind is C.SUBPATTERN:
            return sequence(arg[3])
        if kind is C.BRANCH:
            parts = [sequence(branch) for branch in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if kind is C.MAX_REPEAT and arg[1] <= 4:
            one = sequence(arg[2])
            if one is None:
                return None
            out, now = set(), {""}
            for k in range(arg[1] + 1):
                if k >= arg[0]:
                    out |= now
                now = {a + b for a in now for b in one}
            return out
        return None

    def sequence(nodes) -> set[str] | None:
        run = {""}
        for node in nodes:
            found = spellings(node)
            if found is None:
                return None
            run = {a + b for a in run for b in found}
            if len(run) > SPELLINGS:
                return None
        return run

    run = {""}
    for node in regex_parser.parse(pattern):
        found = spellings(node)
        if found is None or len(run) * len(found) > SPELLINGS:
            run = flush(run)
        if found is None and node[0] is C.MAX_REPEAT and node[1][0] >= 1:
            found = sequence(node[1][2])  # once at least; what follows need not be next to it
            if found is not None:
                flush(found)
                found = None
        if found is not None and len(run) * len(found) <= SPELLINGS:
            run = {a + b for a in run for b in found}
    flush(run)
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Posting lists as rows ``(trigram, doc_id)``: which texts hold which of the ``trigrams``, whatever the case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, rules)``: for each document, the indexed rules whose trigram query it satisfies."""
    spark = index.sparkSession
    terms, needs = [], {}
    for rule in rules:
        for c, clause in enumerate(trigram_query(rule.pattern)):
            needs[rule.kind] = c + 1
            for b, branch in enumerate(sorted(map(sorted, clause))):
                terms += [(t, rule.kind, c, b, 1 << i, (1 << len(branch)) - 1) for i, t in enumerate(branch)]
    names = "trigram string, rule string, clause int, branch int, bit long, full long"
    query = F.broadcast(spark.createDataFrame(terms, names))  # fixed by the rules
    least = F.create_map(*(x for k, n in needs.items() for x in (F.lit(k), F.lit(n))))
    return (
        index.join(query, "trigram")
        .repartition("doc_id")
        .groupBy("doc_id", "rule", "clause", "branch", "full")
        .agg(F.bit_or("bit").alias("held"))
        .where("held = full")
        .groupBy("doc_id", "rule")
        .agg(F.count_distinct("clause").alias("clauses"))
        .where(F.col("clauses") == least[F.col("rule")])
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    )


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, order, end, kind>>`` of a rule's matches, leftmost first and not overlapping, short ones left out.

    Adding to an array copies it, so the n matches are folded in pieces of
    about the square root of n.
    """
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    found = F.filter(found, lambda x: x["all"].isNotNull())
    out_type = "array<struct<start: int, order: int, end: int, kind: string>>"
    long_of = lambda x: F.length(x["gap"]) + F.length(x["all"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        long_enough = F.length(x["part"]) >= rule.least
        out = F.when(long_enough, F.array_append(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(f"struct<at: int, out: {out_type}>")

    def begins(pieces: Column) -> Column:
        """Where each piece begins in the text."""
        kind = "struct<at: int, out: array<int>>"
        sums = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + long_of(x)))
        add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")).cast(kind)
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind), add)["out"]

    def placed(piece: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().alias("out")).cast(f"struct<at: int, out: {out_type}>")
        return F.aggregate(piece, first, step)["out"]

    def cut(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(all_) - 1, width), lambda at: F.slice(all_, at + 1, width))

    def folded(all_: Column) -> Column:
        told = _bound(cut(all_), lambda pieces: F.flatten(F.zip_with(pieces, begins(pieces), placed)))
        return F.when(F.size(all_) > 0, told).otherwise(F.array().cast(out_type))

    return _bound(found, folded)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``, all spans by start, then rule.

    Offsets are code points, end exclusive.  A null text counts as empty; a null
    ``doc_id`` and repeated rows stay as they are; extra columns are ignored; an
    empty table gives an empty result.  A very long text is scanned whole.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r in rules if queries[r.kind])
    none = F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")

    def verified(rule: Rule, where: Column) -> Column:
        return F.when(where & F.rlike("text", F.lit(rule.pattern)), spans(F.col("text"), rule, rules.index(rule))).otherwise(none)

    if indexed:
        vocabulary = sorted({t for r in indexed for clause in queries[r.kind] for branch in clause for t in branch})
        index = materialise(postings(texts, vocabulary), "secrets-postings")
        likely = candidates(index, indexed).select("doc_id")
        texts = marked(texts, [F.col("doc_id")], sieve(likely), "likely")
    each = (verified(r, F.col("likely") if r in indexed else F.lit(True)) for r in rules)
    return texts.select("doc_id", F.array_sort(F.concat(none, *each)).alias("found"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["order"] < len(BASE))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )


def _sql_rows(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT row_no, '{rule.kind}' AS kind, {order} AS ord, unnest(list_transform(range(1, len(alls) + 1), lambda i: {{
      's': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(alls[1:i - 1], lambda m: length(m))), 0),
      'n': length(alls[i]), 'k': length(parts[i])}})) AS x
  FROM (SELECT row_no, string_split_regex(text, '{pattern}') AS gaps,
      regexp_extract_all(text, '{pattern}', 0) AS alls, regexp_extract_all(text, '{pattern}', {rule.group}) AS parts FROM docs)"""


OP5_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({' UNION ALL '.join(_sql_rows(i, r) for i, r in enumerate(RULES))}
), spans AS (
  SELECT row_no, kind, ord, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM raw
  WHERE x.k >= CASE kind {' '.join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END
), agg AS (
  SELECT row_no, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c,
    count(*) FILTER (WHERE kind = 'hex') AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(BASE)}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS every
  FROM spans GROUP BY row_no
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN agg USING (row_no)
"""
