"""SQL for DuckDB that says independently what the queries should return.

Nothing here shares code with the operators: trees are nested tuples, and every
notation is a template per pair of tree shapes into which SQL puts the names.
"""

from __future__ import annotations

from collections.abc import Callable

Tree = object  # None for a leaf, (left, right) for an operation

#: Python template makers take a tree whose leaves are strings.
Maker = Callable[[object, object], str]


def trees(n: int) -> list:
    return [None] if n == 0 else [(a, b) for k in range(n) for a in trees(k) for b in trees(n - 1 - k)]


def _mark(tree, numbers):
    """The tree with placeholders for leaves."""
    return "{" + str(next(numbers)) + "}" if tree is None else (_mark(tree[0], numbers), _mark(tree[1], numbers))


def _size(t) -> int:
    return 0 if isinstance(t, str) else 1 + _size(t[0]) + _size(t[1])


def _spell(pattern: str, nested: str | None = None):
    """A maker for one side: ``pattern`` for the root, ``nested`` for operations inside."""
    inside = nested or pattern

    def go(t, p):
        return t if isinstance(t, str) else p.replace("L", "\0").replace("R", go(t[1], inside)).replace("\0", go(t[0], inside))

    return lambda t: go(t, pattern)


def _both(side, joint: str) -> Maker:
    return lambda l, r: joint.replace("<A>", side(l)).replace("<B>", side(r))  # noqa: E741


_infix = _spell("L ◇ R", "(L ◇ R)")


def _tree_lines(t) -> list[str]:
    if isinstance(t, str):
        return [t]
    return ["◇", *_hang(_tree_lines(t[0]), False), *_hang(_tree_lines(t[1]), True)]


def _hang(lines: list[str], last: bool) -> list[str]:
    return [("└── " if last else "├── ") + lines[0], *(("    " if last else "│   ") + x for x in lines[1:])]


def _ascii(l, r) -> str:  # noqa: E741
    return "\n".join(["=", *_hang(_tree_lines(l), False), *_hang(_tree_lines(r), True)])


def _ssa(l, r) -> str:  # noqa: E741
    lines: list[str] = []

    def go(t):
        if isinstance(t, str):
            return t
        a, b = go(t[0]), go(t[1])
        lines.append(f"t{len(lines) + 1} = {a} ◇ {b}")
        return f"t{len(lines)}"

    a, b = go(l), go(r)
    return "\n".join([*lines, f"assert {a} = {b}"])


def _dot(l, r) -> str:  # noqa: E741
    labels: list[str] = []
    links: dict[int, list[int]] = {}

    def go(t, label):
        labels.append(t if isinstance(t, str) else label)
        me = len(labels)
        if not isinstance(t, str):
            links[me] = []
            for child in t:
                links[me].append(len(labels) + 1)
                go(child, "◇")

    go((l, r), "=")
    body = [f'  n{i} [label="{x}"];' for i, x in enumerate(labels, 1)]
    body += [f"  n{i} -> n{j};" for i in sorted(links) for j in links[i]]
    return "digraph law {\n  ordering=out;\n" + "\n".join(body) + "\n}"


def _slots(l, r) -> str:  # noqa: E741
    return _both(_spell("[L, R]"), "[<A>, <B>]")(l, r)


STORY = (
    "A workshop welder takes two parts, in a definite order, and fuses them into one new part. Feeding the same two "
    "parts in the opposite order, or grouping a sequence of welds differently, may give a different part."
)


def _op(t) -> str:
    return t if isinstance(t, str) else f"op({_op(t[0])},{_op(t[1])})"


def _words(root: str, nested: str):
    def go(t, word):
        return t if isinstance(t, str) else f"{word} {go(t[0], nested)} to {go(t[1], nested)}"

    return lambda t: go(t, root)


def _bracketed(t, top=True) -> str:
    if isinstance(t, str):
        return t
    body = f"{_bracketed(t[0], False)} diamond {_bracketed(t[1], False)}"
    return body if top else f"open bracket {body} close bracket"


def _noun(t) -> str:
    return t if isinstance(t, str) else f"the diamond of {_noun(t[0])} and {_noun(t[1])}"


def _json(t) -> str:
    return f'"{t}"' if isinstance(t, str) else f'{{"◇": [{_json(t[0])}, {_json(t[1])}]}}'


def _table(t) -> str:
    return t if isinstance(t, str) else f"table[{_table(t[0])}][{_table(t[1])}]"


def _post(t) -> str:
    return t if isinstance(t, str) else f"{_post(t[0])} {_post(t[1])} ◇"


def _pre(t) -> str:
    return t if isinstance(t, str) else f"◇ {_pre(t[0])} {_pre(t[1])}"


#: Notation to its template maker, its separator of bound names, and what is put around a bound name.
MAKERS: dict[str, tuple[Maker, str, str]] = {
    "latex": (_both(_spell(r"L \diamond R", r"(L \diamond R)"), "<A> = <B>"), "", ""),
    "lean": (_both(_infix, "example (G : Type u) [Magma G] : Prop := ∀ <N> : G, <A> = <B>"), " ", "v"),
    "py_lambda": (_both(_spell("op(L, R)"), "lambda op, <N>: <A> == <B>"), ", ", "v"),
    "py_cayley_table": (_both(_table, "def law(table):\n    n = len(table)\n    return all(<A> == <B> <N>)\n"), " ", "for v in range(n)"),
    "text": (_both(_bracketed, "<A> equals <B>"), "", ""),
    "text2": (_both(_noun, "<A> equals <B>"), "", ""),
    "ssa": (_ssa, "", ""),
    "slots": (_slots, "", ""),
    "rpn": (_both(_post, "<A> <B> ="), "", ""),
    "polish": (_both(_pre, "= <A> <B>"), "", ""),
    "tptp": (_both(_op, "fof(law, axiom, ![<N>] : <A> = <B>)."), ",", "v"),
    "smtlib": (_both(_spell("(op L R)"), "(declare-sort M 0)\n(declare-fun op (M M) M)\n(assert (forall (<N>)\n  (= <A> <B>)))"), " ", "(v M)"),
    "ascii_tree": (_ascii, "", ""),
    "graphviz": (_dot, "", ""),
    "json_ast": (_both(_json, '{"=": [<A>, <B>]}'), "", ""),
    "confusable_vars": (_both(_infix, "<A> = <B>"), "", ""),
    "word_problem": (_both(_words("welding", "the part made by welding"), STORY + "\n\nClaim: for any <N>, <A> gives the same part as <B>."), "", ""),
}
NAMES = {"confusable_vars": "['l','I','ll','lI','Il','II']", "slots": "['1','2','3','4','5','6']", "tptp": "['X','Y','Z','W','U','V']"}
LETTERS = "['x','y','z','w','u','v']"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pairs():
    for n in range(5):
        for k in range(n // 2 + 1):
            for i, a in enumerate(trees(k)):
                for j, b in enumerate(trees(n - k)):
                    if 2 * k != n or i <= j:
                        yield n, k, i, j, a, b


def _templates(name: str) -> str:
    make = MAKERS[name][0]
    rows = []
    for _, k, i, j, a, b in _pairs():
        numbers = iter(range(6))
        rows.append(f"({k},{i},{j},{_size_of(b)},{_quote(make(_mark(a, numbers), _mark(b, numbers)))})")
    return f"tpl_{name}(lo, lr, rr, ro, tpl) AS (VALUES {', '.join(rows)})"


def _size_of(t) -> int:
    return 0 if t is None else 1 + _size_of(t[0]) + _size_of(t[1])


def _canonical(seq: str) -> str:
    """A list renumbered by first appearance."""
    return (
        f"list_transform({seq}, lambda q: len(list_filter(range(1, list_position({seq}, q)), "
        f"lambda p: list_position({seq}, {seq}[p]) = p)))"
    )


#: The catalogue, from recursive rhymes and shapes: laws(node, ord, lo, lr, ro, rr, rhyme, flip).
LAWS = f"""
rhymes(n, rhyme, used) AS (
  SELECT 1, [0], 1 UNION ALL
  SELECT n + 1, list_append(rhyme, x), greatest(used, x + 1) FROM rhymes, (SELECT CAST(unnest(range(0, 6)) AS INT) AS x) WHERE x <= used AND n < 6
),
shapes(o, r) AS (VALUES (0,0),(1,0),(2,0),(2,1),(3,0),(3,1),(3,2),(3,3),(3,4),(4,0),(4,1),(4,2),(4,3),(4,4),(4,5),(4,6),(4,7),(4,8),(4,9),(4,10),(4,11),(4,12),(4,13)),
paired AS (
  SELECT a.o + b.o AS ord, a.o AS lo, a.r AS lr, b.o AS ro, b.r AS rr, rhyme, rhyme[a.o + 2:] || rhyme[:a.o + 1] AS turned
  FROM shapes a, shapes b, rhymes WHERE a.o + b.o <= 4 AND n = a.o + b.o + 2 AND (a.o < b.o OR (a.o = b.o AND a.r <= b.r))
),
flipped AS (SELECT *, {_canonical('turned')} AS flip FROM paired),
laws AS (
  SELECT row_number() OVER (ORDER BY ord, lo, lr, rr, rhyme) AS node, ord, lo, lr, ro, rr, rhyme, flip FROM flipped
  WHERE NOT (lo = ro AND lr = rr AND (flip < rhyme OR (turned = rhyme AND ord > 0)))
)"""


def _filled(template: str, numbers: str, names: str = LETTERS, places: int = 6) -> str:
    for i in range(places):
        template = f"replace({template}, '{{{i}}}', coalesce({names}[{numbers}[{i + 1}] + 1], ''))"
    return template


def _bound(name: str) -> str:
    """The list of bound names of a law, as SQL text."""
    names = NAMES.get(name, LETTERS)
    used = f"list_transform(range(0, list_max(rhyme) + 1), lambda i: {names}[i + 1])"
    if name == "word_problem":
        return (
            f"CASE WHEN list_max(rhyme) = 0 THEN 'part x' ELSE 'parts ' || array_to_string(({used})[:-2], ', ') || ' and ' || ({used})[-1] END"
        )
    before, _, after = MAKERS[name][2].partition("v")
    if name == "py_cayley_table":
        before, after = "for ", " in range(n)"
    return f"array_to_string(list_transform({used}, lambda v: {_quote(before)} || v || {_quote(after)}), {_quote(MAKERS[name][1])})"


def rendering(name: str) -> str:
    """SQL expression for a law's text; needs ``tpl`` of its shapes."""
    return f"replace({_filled('tpl', 'rhyme', NAMES.get(name, LETTERS))}, '<N>', {_bound(name)})"


def with_laws(body: str, *notations: str) -> str:
    every = ",\n".join([LAWS, *map(_templates, notations)])
    return f"WITH RECURSIVE {every}\n{body}"


def _join(name: str, source: str = "laws") -> str:
    return f"{source} JOIN tpl_{name} USING (lo, lr, ro, rr)"


FORMAL = "confusable_vars"  # the same template with plain letters is the canonical text
FORMAL_TEXT = _filled("tpl", "rhyme")


def _key_rows(source: str = "laws") -> str:
    """node, formal, canonical_key: the template of the turned law has its sides exchanged."""
    turned_pairs = []
    for _, k, i, j, a, b in _pairs():
        numbers = iter(range(6))
        right = _mark(b, numbers)
        left = _mark(a, numbers)
        turned_pairs.append(f"({k},{i},{j},{_size_of(b)},{_quote(_infix(right) + ' = ' + _infix(left))})")
    return (
        f"SELECT node, ord, rhyme, {FORMAL_TEXT} AS formal, least({FORMAL_TEXT}, {_filled('turned_tpl', 'flip')}) AS canonical_key "
        f"FROM {_join(FORMAL, source)} JOIN (VALUES {', '.join(turned_pairs)}) AS x(lo, lr, rr, ro, turned_tpl) USING (lo, lr, ro, rr)"
    )


def _duals() -> str:
    """node, dual_node."""
    mirrored = []
    for _, k, i, j, a, b in _pairs():
        flip = lambda t: None if t is None else (flip(t[1]), flip(t[0]))
        ma, mb = flip(a), flip(b)
        n1, n2 = iter(range(6)), iter(range(6))
        one = _infix(_mark(ma, n1)) + " = " + _infix(_mark(mb, n1))
        two_l = _mark(mb, n2)
        two = _infix(two_l) + " = " + _infix(_mark(ma, n2))
        mirrored.append(f"({k},{i},{j},{_size_of(b)},{_quote(one)},{_quote(two)})")
    return f"""SELECT CAST(d.node AS INT) AS node, CAST(k.node AS INT) AS dual_node FROM (
  SELECT node, least({_filled('one', 'c1')}, {_filled('two', 'c2')}) AS dual_key FROM (
    SELECT node, one, two, {_canonical('b1')} AS c1, {_canonical('b2')} AS c2 FROM (
      SELECT node, one, two, list_reverse(rhyme[:lo + 1]) || list_reverse(rhyme[lo + 2:]) AS b1, list_reverse(rhyme[lo + 2:]) || list_reverse(rhyme[:lo + 1]) AS b2
      FROM laws JOIN (VALUES {', '.join(mirrored)}) AS m(lo, lr, rr, ro, one, two) USING (lo, lr, ro, rr)))
) d JOIN ({_key_rows()}) k ON k.canonical_key = d.dual_key"""


DUALS = _duals()


def _directions() -> str:
    """The direction of a law under the reduction order, by the definition, written out for every pair of shapes."""

    def places(t) -> list[int]:
        return [t] if isinstance(t, int) else places(t[0]) + places(t[1])

    def counted(i: int, among: list[int]) -> str:
        return "(" + " + ".join(f"CAST(rhyme[{j + 1}] = rhyme[{i + 1}] AS INT)" for j in among) + ")"

    def covers(s, t) -> str:
        return " AND ".join(f"{counted(i, places(s))} >= {counted(i, places(t))}" for i in places(t))

    def same(s, t) -> str:
        if isinstance(s, int) and isinstance(t, int):
            return f"rhyme[{s + 1}] = rhyme[{t + 1}]"
        if isinstance(s, int) or isinstance(t, int):
            return "false"
        return f"{same(s[0], t[0])} AND {same(s[1], t[1])}"

    def above(s, t) -> str:
        a, b = len(places(s)), len(places(t))
        if a != b:
            return f"({covers(s, t)})" if a > b else "false"
        if isinstance(s, int):
            return "false"
        return f"({covers(s, t)} AND ({above(s[0], t[0])} OR ({same(s[0], t[0])} AND {above(s[1], t[1])})))"

    def numbered(t, numbers):
        return next(numbers) if t is None else (numbered(t[0], numbers), numbered(t[1], numbers))

    whens = []
    for _, k, i, j, a, b in _pairs():
        numbers = iter(range(6))
        s, t = numbered(a, numbers), numbered(b, numbers)
        where = f"WHEN lo = {k} AND lr = {i} AND rr = {j} AND ro = {_size_of(b)}"
        whens.append(f"{where} THEN CASE WHEN {above(s, t)} THEN 'right' WHEN {above(t, s)} THEN 'left' ELSE 'unorientable' END")
    return f"CASE {' '.join(whens)} END"


def _left_over(forest: tuple, blanks: int, cuts: int) -> set:
    """All forests with just so many leaves blanked and nodes cut; a cut operation leaves its arguments."""
    if not forest:
        return {()} if blanks == cuts == 0 else set()
    first, rest = forest[0], forest[1:]
    out = set()
    for b in range(blanks + 1):
        for c in range(cuts + 1):
            here = set()
            if isinstance(first, str):
                here |= {(first,)} if b == c == 0 else {("_",)} if (b, c) == (1, 0) else {()} if (b, c) == (0, 1) else set()
            else:
                here |= {(inner,) for inner in _left_over(first, b, c)}
                here |= _left_over(first, b, c - 1) if c else set()
            out |= {h + r for h in here for r in _left_over(rest, blanks - b, cuts - c)}
    return out


def _nearby() -> str:
    """CTEs ``near(node, other, distance)``: laws one or two tree edits apart.

    A law's tree is binary, so an odd number of cuts and insertions leads to none, and nothing is gained by
    relabelling an operation: two laws that near have equal trees but for two leaves, or share what is left after a
    cut in each, or after two cuts in one.
    """

    def spell(f) -> str:
        return "".join(x if isinstance(x, str) else f"({spell(x)})" for x in f)

    rows = []
    for _, k, i, j, a, b in _pairs():
        for turned, sides in ((0, (a, b)), (1, (b, a))):
            numbers = iter(range(6))
            forest = tuple(_mark(t, numbers) for t in sides)
            for blanks, cuts in ((1, 0), (2, 0), (0, 0), (0, 1), (0, 2)):
                rows += [f"({k},{i},{j},{_size_of(b)},{turned},{blanks},{cuts},{_quote(spell(f))})" for f in sorted(_left_over(forest, blanks, cuts), key=spell)]
    filled = _filled("tpl", "names")
    return f"""cut_tpl(lo, lr, rr, ro, turned, blanks, cuts, tpl) AS (VALUES {', '.join(rows)}),
cut_laws AS MATERIALIZED (
  SELECT DISTINCT node, blanks, cuts, {filled} AS rest
  FROM (SELECT *, CASE WHEN turned = 1 THEN flip ELSE rhyme END AS names FROM laws JOIN cut_tpl USING (lo, lr, ro, rr))),
near AS (
  SELECT a.node, b.node AS other, min(a.blanks + a.cuts + b.cuts) AS distance
  FROM cut_laws a JOIN cut_laws b ON a.rest = b.rest AND a.blanks = b.blanks AND a.blanks + a.cuts + b.cuts <= 2 AND a.node <> b.node
  WHERE a.node IN (SELECT 1 + c_custkey % 4694 FROM customer) GROUP BY a.node, b.node)"""


def _value(tree, leaf: int, cell: Callable[[str, str], str]) -> tuple[str, int]:
    """SQL for a term's value; leaves are v1, v2, ..."""
    if tree is None:
        return f"v[{leaf}]", leaf + 1
    a, leaf = _value(tree[0], leaf, cell)
    b, leaf = _value(tree[1], leaf, cell)
    return cell(a, b), leaf


def _holds(n: int, id_expr: str, max_order: int) -> str:
    """CTE body ``sat(node, table_id)`` of tables of size n in which laws hold."""
    cells = n * n

    def cell(a, b):
        return f"((t // CAST(pow({n}, {cells - 1} - ({n} * {a} + {b})) AS BIGINT)) % {n})"

    def side(o: str, r: str, skip: str) -> str:
        whens = []
        for order in range(max_order + 1):
            for rank, tree in enumerate(trees(order)):
                whens.append(f"WHEN {o} = {order} AND {r} = {rank} THEN {_shifted(_value(tree, 1, cell)[0], skip, order + 1)}")
        return f"CASE {' '.join(whens)} END"

    left, right = side("lo", "lr", "0"), side("ro", "rr", "lo + 1")
    return f"""
    SELECT node, t AS table_id FROM (
      SELECT node, t, bool_and({left} = {right}) AS ok FROM (
        SELECT node, lo, lr, ro, rr, t, list_transform(rhyme, lambda q: CAST((a // CAST(pow({n}, list_max(rhyme) - q) AS BIGINT)) % {n} AS BIGINT)) AS w
        FROM (SELECT * FROM laws WHERE ord <= {max_order}), range({n ** cells}) AS tt(t), range(CAST(pow({n}, 6) AS BIGINT)) AS aa(a)
        WHERE a < pow({n}, list_max(rhyme) + 1) AND ({id_expr})
      ) GROUP BY node, t
    ) WHERE ok"""


def _shifted(body: str, skip: str, leaves: int) -> str:
    for i in range(leaves, 0, -1):
        body = body.replace(f"v[{i}]", f"w[{i} + {skip}]")
    return body


SAT2 = f"sat2 AS ({_holds(2, 'true', 4)}), masks AS (SELECT node, CAST(coalesce(sum(1 << CAST(table_id AS INT)), 0) AS BIGINT) AS mask FROM laws LEFT JOIN sat2 USING (node) GROUP BY node)"


def _label(i: str, g: str, mi: str, mg: str) -> str:
    f = f"CASE WHEN {i} = {g} OR {g} = 1 OR {i} = 2 THEN 1 WHEN ({mi} & ~{mg}) <> 0 THEN 0 ELSE 4 END"
    b = f"CASE WHEN {i} = {g} OR {i} = 1 OR {g} = 2 THEN 1 WHEN ({mg} & ~{mi}) <> 0 THEN 0 ELSE 4 END"
    return (
        f"CASE WHEN {i} = {g} THEN 'equal' WHEN {f} = 1 AND {b} = 1 THEN 'equivalent' WHEN {f} = 1 AND {b} = 0 THEN 'weaker' "
        f"WHEN {f} = 0 AND {b} = 1 THEN 'stronger' WHEN {f} = 0 AND {b} = 0 THEN 'incomparable' ELSE 'unknown' END"
    )


#: Rows of all laws, with the column that has the law's number.
COUNTED = dict.fromkeys(
    (
        "catalog_all", "catalog_generated", "catalog_dual", "catalogue_text", "catalogue_text2", "magma2_satisfaction", "refutations_per_law",
        "file_law_list", "file_lean_source", "file_catalogue", "file_json_document", "limited_rows", "same_catalogues",
    ),
    "node",
) | {"file_matrix": "hyp"}
#: The number of the law that an order names, those numbers, and the catalogue's rows of them.
ORDERED = "1 + o_orderkey % 4694"
USED = f"(SELECT {ORDERED} FROM orders)"
SOME = f"(SELECT * FROM laws WHERE node IN {USED})"


def _counted(sql: str, key: str) -> str:
    """The rows of ``sql``, and how many orders name each law."""
    return f"SELECT q.*, coalesce(u.n, 0) AS n_orders FROM ({sql}) q LEFT JOIN (SELECT {ORDERED} AS named, count(*) AS n FROM orders GROUP BY 1) u ON u.named = q.{key}"


def _sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["shape_enumeration"] = """
WITH s0 AS (SELECT 0 AS ord, 0 AS rank, '0' AS bits),
s1 AS (SELECT 1 AS ord, 0 AS rank, '1' || a.bits || b.bits AS bits FROM s0 a, s0 b),
u1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
s2 AS (SELECT 2 AS ord, row_number() OVER (ORDER BY a.ord, a.rank, b.rank) - 1 AS rank, '1' || a.bits || b.bits AS bits FROM u1 a, u1 b WHERE a.ord + b.ord = 1),
u2 AS (SELECT * FROM u1 UNION ALL SELECT * FROM s2),
s3 AS (SELECT 3 AS ord, row_number() OVER (ORDER BY a.ord, a.rank, b.rank) - 1 AS rank, '1' || a.bits || b.bits AS bits FROM u2 a, u2 b WHERE a.ord + b.ord = 2),
u3 AS (SELECT * FROM u2 UNION ALL SELECT * FROM s3),
s4 AS (SELECT 4 AS ord, row_number() OVER (ORDER BY a.ord, a.rank, b.rank) - 1 AS rank, '1' || a.bits || b.bits AS bits FROM u3 a, u3 b WHERE a.ord + b.ord = 3)
SELECT CAST(ord AS INT) AS ord, CAST(rank AS INT) AS rank, bits, coalesce(n, 0) AS n_orders FROM (SELECT * FROM u3 UNION ALL SELECT * FROM s4)
LEFT JOIN (""" + with_laws(f"SELECT lo, lr, count(*) AS n FROM laws JOIN orders ON node = {ORDERED} GROUP BY ALL") + """) ON lo = ord AND lr = rank"""
    out["rhyme_enumeration"] = f"WITH RECURSIVE {LAWS} SELECT CAST(r.n AS INT) AS length, array_to_string(r.rhyme, ',') AS rhyme, coalesce(u.n, 0) AS n_orders FROM rhymes r LEFT JOIN (SELECT rhyme, count(*) AS n FROM laws JOIN orders ON node = {ORDERED} GROUP BY rhyme) u ON u.rhyme = r.rhyme"
    out["catalog_all"] = with_laws(
        f"SELECT CAST(node AS INT) AS node, formal, canonical_key, CAST(ord AS INT) AS ord, CAST(list_max(rhyme) + 1 AS INT) AS n_vars FROM ({_key_rows()})", FORMAL
    )
    out["catalog_generated"] = out["catalog_all"]
    out["catalog_by_order"] = with_laws(f"SELECT CAST(ord AS INT) AS \"order\", count(*) AS n_laws FROM laws JOIN orders ON node = {ORDERED} GROUP BY ord")
    out["catalog_by_variables"] = with_laws(f"SELECT CAST(list_max(rhyme) + 1 AS INT) AS n_vars, count(*) AS n_laws FROM laws JOIN orders ON node = {ORDERED} GROUP BY 1")
    out["law_counts"] = with_laws(
        f"SELECT CAST(ord AS INT) AS ord, count(*) AS n_laws, min(node) AS first_node, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_orders "
        f"FROM laws LEFT JOIN (SELECT {ORDERED} AS node, count(*) AS n FROM orders GROUP BY 1) USING (node) GROUP BY ord"
    )
    out["catalog_dual"] = with_laws(DUALS, FORMAL)
    for name in MAKERS:
        out[f"render_{name}"] = with_laws(
            f"SELECT CAST(node AS INT) AS node, {rendering(name)} AS rendering FROM {_join(name)} "
            "WHERE node IN (SELECT 1 + p_partkey % 4694 FROM part)",
            name,
        )
    for name in ("text", "text2"):
        out[f"catalogue_{name}"] = with_laws(
            f"SELECT CAST(node AS INT) AS node, f.t AS formal, {rendering(name)} AS rendering, CAST(ord AS INT) AS \"order\" "
            f"FROM {_join(name)} JOIN (SELECT node AS n, {FORMAL_TEXT} AS t FROM {_join(FORMAL)}) f ON f.n = node", name, FORMAL
        )
    every = " UNION ALL ".join(f"SELECT '{n}' AS notation, node, {rendering(n)} AS r FROM {_join(n, SOME)}" for n in MAKERS)
    out["render_length_stats"] = with_laws(
        f"SELECT notation, CAST(min(length(r)) AS INT) AS least, round(avg(length(r)), 1) AS mean, CAST(max(length(r)) AS INT) AS most FROM ({every}) GROUP BY notation", *MAKERS
    )
    out["distinct_check"] = with_laws(f"SELECT notation, count(*) AS n_laws, count(DISTINCT r) AS n_distinct FROM ({every}) GROUP BY notation", *MAKERS)
    out["round_trips"] = with_laws(f"SELECT notation, (SELECT count(*) FROM {SOME}) AS n_ok FROM (VALUES " + ", ".join(f"('{n}')" for n in MAKERS) + ") AS x(notation)")
    out["words_per_law"] = with_laws(
        "SELECT notation, CAST(min(len(string_split(r, ' '))) AS INT) AS least, round(avg(len(string_split(r, ' '))), 1) AS mean, "
        f"CAST(max(len(string_split(r, ' '))) AS INT) AS most FROM ({every}) WHERE notation IN ('text', 'text2') GROUP BY notation", *MAKERS
    )
    out["canonical_key_lookup"] = "SELECT o_orderkey, CAST(1 + o_orderkey % 4694 AS INT) AS node FROM orders"
    out["resolve_numbers"] = (
        "SELECT s_suppkey, CASE WHEN s_suppkey * 61 BETWEEN 1 AND 4694 THEN 'mapped' ELSE 'parse-failure' END AS status, "
        "CAST(CASE WHEN s_suppkey * 61 BETWEEN 1 AND 4694 THEN s_suppkey * 61 ELSE 0 END AS INT) AS node FROM supplier"
    )
    out["magma2_satisfaction"] = f"WITH RECURSIVE {LAWS}, {SAT2} SELECT CAST(node AS INT) AS node, mask FROM masks"
    out["refutations_per_law"] = (
        f"WITH RECURSIVE {LAWS}, {SAT2} SELECT CAST(a.node AS INT) AS node, count(*) FILTER (WHERE (a.mask & ~b.mask) <> 0) AS n_refuted FROM masks a, masks b GROUP BY a.node"
    )
    out["refuted_pairs"] = f"WITH RECURSIVE {LAWS}, {SAT2}, k AS (SELECT mask, count(*) AS n FROM masks JOIN orders ON node = {ORDERED} GROUP BY mask) SELECT a.mask AS hyp_mask, b.mask AS concl_mask, a.n * b.n AS n_pairs FROM k a, k b WHERE (a.mask & ~b.mask) <> 0"
    out["first_witness_size2"] = f"""
WITH RECURSIVE {LAWS}, {SAT2}, pairs AS (SELECT DISTINCT 1 + o_orderkey % 4694 AS a, 1 + o_custkey % 4694 AS b FROM orders),
found AS (SELECT p.a, p.b, x.mask & ~y.mask AS w FROM pairs p JOIN masks x ON x.node = p.a JOIN masks y ON y.node = p.b)
SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(CASE WHEN w = 0 THEN -1 ELSE 2 END AS INT) AS n,
  CAST(CASE WHEN w = 0 THEN -1 ELSE list_min(list_filter(range(0, 16), lambda t: (w >> CAST(t AS INT)) & 1 = 1)) END AS BIGINT) AS magma_id FROM found"""
    labelled = lambda t, i, g, extra: (
        f"WITH RECURSIVE {LAWS}, {SAT2}, p AS (SELECT {extra}{i} AS i, {g} AS g FROM {t}) "
    )
    out["verdict_histogram"] = (
        labelled("lineitem", "1 + l_orderkey % 4694", "1 + l_partkey % 4694", "")
        + f"SELECT {_label('i', 'g', 'a.mask', 'b.mask')} AS label, count(*) AS n FROM p JOIN masks a ON a.node = i JOIN masks b ON b.node = g GROUP BY 1"
    )
    out["verdict_by_priority"] = (
        labelled("orders", "1 + o_orderkey % 4694", "1 + o_custkey % 4694", "o_orderpriority, ")
        + f"SELECT o_orderpriority, {_label('i', 'g', 'a.mask', 'b.mask')} AS label, count(*) AS n FROM p JOIN masks a ON a.node = i JOIN masks b ON b.node = g GROUP BY ALL"
    )
    out["status_histogram"] = f"""WITH RECURSIVE {LAWS}, {SAT2}, s AS (
  SELECT CASE WHEN a.node = b.node OR b.node = 1 OR a.node = 2 THEN 1 WHEN (a.mask & ~b.mask) <> 0 THEN 0 ELSE 4 END AS status FROM masks a, masks b WHERE a.node IN {USED})
SELECT CAST(k AS INT) AS status, name, count(s.status) AS n_pairs FROM (VALUES (0,'proof_false'),(1,'proof_true'),(2,'conjecture_false'),(3,'conjecture_true'),(4,'unknown')) AS x(k, name) LEFT JOIN s ON s.status = k GROUP BY k, name"""
    blank = r"[\s\x1c-\x1f\x{85}\x{a0}]"
    macros = {"cdot": "·", "circ": "∘", "diamond": "◇", "ast": "*", "times": "×", "oplus": "⊕", "otimes": "⊗", "odot": "⊙", "ominus": "⊖", "oslash": "⊘", "bullet": "•", "star": "★", "dagger": "†", "triangleleft": "◁", "triangleright": "▷", "circledast": "⊛", "circledcirc": "⊚", "Box": "□"}

    def stripped(column: str) -> str:
        trim = lambda s: f"regexp_replace({s}, '^{blank}+|{blank}+$', '', 'g')"
        s = trim(column)
        s = trim(f"regexp_replace({s}, '^```[a-zA-Z]*{blank}*|{blank}*```$', '', 'g')")
        s = trim(f"regexp_replace({s}, '^`+|`+$', '', 'g')")
        s = f"regexp_replace({s}, '\\\\[()\\[\\]]|\\$', '', 'g')"
        s = f"regexp_replace({s}, '\\\\(?:text|mathrm|mathbf|mathit|mathbin)\\{{([^{{}}]*)\\}}', '\\1', 'g')"
        for m, sign in macros.items():
            s = f"regexp_replace({s}, '\\\\{m}([^A-Za-z]|$)', '{sign}\\1', 'g')"
        s = f"replace(replace({s}, '\\left', ''), '\\right', '')"
        return trim(f"regexp_replace({s}, '\\.+$', '')")

    out["strip_noise_documents"] = f"SELECT doc_id, md5({stripped('text')}) AS cleaned_md5 FROM documents"
    out["strip_noise_pages"] = f"SELECT page_id, md5({stripped('html')}) AS cleaned_md5 FROM pages"
    ident = r"[\p{L}\p{Nl}_][\p{L}\p{N}\p{M}\p{Pc}]*"
    out["tokenize_benchmark"] = rf"""
SELECT item_id, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(t, '^[\p{{L}}\p{{Nl}}_]')) AS n_names,
  count(*) FILTER (WHERE t IN ('.', ';')) AS n_stops, count(*) FILTER (WHERE t = ',') AS n_commas
FROM (SELECT item_id, unnest(regexp_extract_all(text, '==|[=≡(),]|{ident}|\p{{Nd}}+|[^\s]')) AS t FROM benchmark) GROUP BY item_id"""
    out["parse_status_counts"] = """
SELECT CAST(o_orderkey % 10 AS INT) AS kind, CASE o_orderkey % 10 WHEN 4 THEN 'parse-failure' WHEN 5 THEN 'outside-fragment'
  WHEN 6 THEN 'outside-fragment' WHEN 7 THEN 'outside-fragment' WHEN 8 THEN 'parse-failure' ELSE 'mapped' END AS status, count(*) AS n
FROM orders GROUP BY ALL"""
    out["metric_pairs"] = with_laws(
        f"""SELECT p_partkey, a.t = b.t AS exact_match, a.node = b.node AS normalized_match, levenshtein(a.t, b.t) AS distance FROM part
JOIN (SELECT node, replace({FORMAL_TEXT}, '◇', '*') AS t FROM {_join(FORMAL)}) a ON a.node = 1 + p_partkey % 4694
JOIN (SELECT node, replace({FORMAL_TEXT}, '◇', '*') AS t FROM {_join(FORMAL)}) b ON b.node = 1 + (p_partkey // 2) % 4694""",
        FORMAL,
    )
    out["embedding_cosine"] = (
        "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine "
        "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
    )
    out["nearest_vectors_exact"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS rank FROM p) WHERE rank <= 5"""
    out["dialect_lookup"] = (
        "SELECT c_custkey, 'in_fragment' AS status, CAST(1 + c_custkey % 4694 AS BIGINT) AS etp_id FROM customer"
    )
    story = f"""
WITH RECURSIVE {LAWS}, {_templates(FORMAL)}, {SAT2}, texts AS (SELECT node, {FORMAL_TEXT} AS formal FROM {_join(FORMAL)}),
rows AS (SELECT p_partkey, 1 + p_partkey % 4694 AS i, 1 + (p_partkey * 7) % 4694 AS g, p_partkey % 3 = 0 AS broken FROM part),
told AS (
  SELECT p_partkey, i, g, broken, a.formal AS fi, b.formal AS fg, p_partkey AS nl,
    CASE WHEN broken THEN 'no law' ELSE replace(b.formal, '◇', '*') END AS raw, {_label('i', 'g', 'ma.mask', 'mb.mask')} AS lab
  FROM rows JOIN texts a ON a.node = i JOIN texts b ON b.node = g JOIN masks ma ON ma.node = i JOIN masks mb ON mb.node = g)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN broken THEN 'invalid' WHEN lab = 'equal' THEN 'equivalent' ELSE lab END AS label,
  concat_ws(' | ', 'Intended theory: E' || i || ' = "' || fi || '"', 'NL description generated: "part ' || nl || '"',
    'LLM''s translation back to a formal equation: "' || raw || '"',
    CASE WHEN broken THEN 'Normalization failed: the LLM''s output could not be parsed as a valid equation. | Semantic drift: UNRESOLVABLE -- no comparison possible, the translation step itself failed.'
    ELSE concat_ws(' | ', 'Normalized form: "' || fg || '" (matches ETP E' || g || ')', 'Comparison method used: implication_graph', 'Semantic drift: ' || CASE lab
      WHEN 'equal' THEN 'NONE -- the LLM''s translation preserved the intended meaning exactly.'
      WHEN 'equivalent' THEN 'NONE -- the LLM''s translation preserved the intended meaning exactly.'
      WHEN 'stronger' THEN 'STRENGTHENING -- the generated equation implies the intended one, but not vice versa. The LLM''s translation added a constraint that was not present in the original.'
      WHEN 'weaker' THEN 'WEAKENING -- the intended equation implies the generated one, but not vice versa. The LLM''s translation dropped a constraint that was present in the original.'
      WHEN 'incomparable' THEN 'INCOMPARABLE -- neither equation implies the other. The LLM''s translation describes a genuinely different, unrelated law, even though it may be syntactically valid.'
      ELSE 'UNKNOWN -- the available oracle could not determine the relationship within its search bounds.' END) END) AS explanation
FROM told"""
    out["drift_explanations"] = story
    out["drift_summary"] = f"""SELECT label, CASE WHEN label = 'equivalent' THEN 'no drift' WHEN label IN ('weaker', 'stronger') THEN 'directional drift'
  WHEN label = 'incomparable' THEN 'mismatch' WHEN label = 'invalid' THEN 'unreadable' ELSE 'inspect' END AS verdict, count(*) AS n FROM ({story}) GROUP BY ALL"""
    small = labelled("orders", "1 + o_orderkey % 4694", "1 + o_custkey % 4694", "o_orderkey, ")
    masked = "FROM p JOIN masks a ON a.node = i JOIN masks b ON b.node = g"
    out["implication_lookup"] = small + (
        f"SELECT o_orderkey, CASE WHEN i = g OR g = 1 OR i = 2 THEN 'true' WHEN (a.mask & ~b.mask) <> 0 THEN 'false' ELSE 'open' END AS implies {masked}"
    )
    says = "CASE WHEN i = g OR g = 1 OR i = 2 THEN 'true' WHEN (a.mask & ~b.mask) <> 0 THEN 'false' END"
    out["edge_index_lookup"] = f"""WITH RECURSIVE {LAWS}, {SAT2}, e AS (SELECT DISTINCT 1 + l_orderkey % 4694 AS i, 1 + l_suppkey % 4694 AS g FROM lineitem),
told AS (SELECT i, g, {says} AS word FROM e JOIN masks a ON a.node = i JOIN masks b ON b.node = g)
SELECT o_orderkey, CAST(1 + o_orderkey % 4694 AS INT) AS hyp, CAST(1 + o_custkey % 10 AS INT) AS concl, coalesce(word, 'open') AS implies
FROM orders LEFT JOIN told ON i = 1 + o_orderkey % 4694 AND g = 1 + o_custkey % 10"""
    out["edge_relations"] = small + (
        f"SELECT CASE WHEN i = g THEN 'equivalent' ELSE {_label('i', 'g', 'a.mask', 'b.mask')} END AS label, count(*) AS n {masked} GROUP BY 1"
    )
    lab = _label("i", "g", "a.mask", "b.mask")
    out["edge_closure"] = """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS u, l_suppkey AS v FROM lineitem), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
nodes AS (SELECT u AS node FROM e UNION SELECT v FROM e),
mutual AS (SELECT a.u AS node, count(*) AS n FROM r a JOIN r b ON a.u = b.v AND a.v = b.u WHERE a.u <> a.v GROUP BY 1)
SELECT node, 1 + coalesce(m.n, 0) AS component_size, (SELECT count(*) FROM r WHERE u = node) AS n_reached FROM nodes LEFT JOIN mutual m USING (node)"""
    out["verdict_evidence"] = small + f"""
SELECT *, CASE label WHEN 'equal' THEN 'both map to Equation ' || intended
  WHEN 'equivalent' THEN 'derived proofs of Eq' || intended || ' => Eq' || generated || ' and Eq' || generated || ' => Eq' || intended
  WHEN 'weaker' THEN 'derived proof of Eq' || intended || ' => Eq' || generated || '; counterexample table refutes Eq' || generated || ' => Eq' || intended
  WHEN 'stronger' THEN 'derived proof of Eq' || generated || ' => Eq' || intended || '; counterexample table refutes Eq' || intended || ' => Eq' || generated
  WHEN 'incomparable' THEN 'counterexample tables refute the implication in both directions'
  ELSE 'not fully resolved: forward=' || forward || ', backward=' || backward END AS evidence
FROM (SELECT DISTINCT CAST(i AS INT) AS intended, CAST(g AS INT) AS generated, {lab} AS label, {_word('i', 'g', 'a', 'b')} AS forward, {_word('g', 'i', 'b', 'a')} AS backward {masked})"""
    out["metric_accuracy"] = small + (
        "SELECT label, count(*) AS n, CAST(sum(CAST(same = (label IN ('equal', 'equivalent')) AS INT)) AS BIGINT) AS agree, "
        "round(avg(CAST(same = (label IN ('equal', 'equivalent')) AS INT)), 6) AS accuracy "
        f"FROM (SELECT i = g AS same, {lab} AS label {masked}) WHERE label <> 'unknown' GROUP BY label"
    )
    flat = f"replace(replace({FORMAL_TEXT}, '(', ''), ')', '')"
    out["ambiguous_readings"] = with_laws(
        f"""SELECT CAST(q.node AS INT) AS node, q.text, count(*) AS n_readings, array_to_string(list_sort(list(DISTINCT x.node) FILTER (WHERE x.node IS NOT NULL)), ',') AS laws FROM (
  SELECT node, {flat} AS text, lo, ro, CASE WHEN lo < ro OR s1.r <= s2.r THEN s1.r ELSE s2.r END AS la, CASE WHEN lo < ro OR s1.r <= s2.r THEN s2.r ELSE s1.r END AS rb,
    CASE WHEN lo < ro OR s1.r < s2.r THEN rhyme WHEN s1.r = s2.r THEN least(rhyme, flip) ELSE flip END AS rh
  FROM {_join(FORMAL)} JOIN shapes s1 ON s1.o = lo JOIN shapes s2 ON s2.o = ro WHERE node IN (SELECT 1 + p_partkey % 4694 FROM part)
) q LEFT JOIN laws x ON x.lo = q.lo AND x.ro = q.ro AND x.lr = q.la AND x.rr = q.rb AND x.rhyme = q.rh GROUP BY q.node, q.text""", FORMAL
    )
    sides = f"string_split({FORMAL_TEXT}, ' = ')"
    out["nearby_laws"] = f"""WITH RECURSIVE {LAWS}, {_nearby()},
named AS (SELECT 1 + c_custkey % 4694 AS node, count(*) AS n_customers FROM customer GROUP BY 1)
SELECT CAST(node AS INT) AS node, CAST(distance AS BIGINT) AS distance, count(*) AS n_laws, CAST(sum(other) AS BIGINT) AS laws_sum, any_value(n_customers) AS n_customers
FROM near JOIN named USING (node) GROUP BY node, distance"""
    out["oriented_rules"] = with_laws(
        f"""SELECT CAST(node AS INT) AS node, direction, CASE direction WHEN 'right' THEN t[1] || ' → ' || t[2] WHEN 'left' THEN t[2] || ' → ' || t[1] ELSE '' END AS rule
FROM (SELECT node, {sides} AS t, {_directions()} AS direction FROM {_join(FORMAL)} WHERE node IN (SELECT 1 + p_partkey % 4694 FROM part))""", FORMAL
    )
    report = (
        labelled("orders", "1 + o_orderkey % 4694", "1 + (o_orderkey % 7 + o_custkey % 97) % 4694", "o_orderpriority, ")[:-1]
        + f", {_templates(FORMAL)}, texts AS (SELECT node, replace({FORMAL_TEXT}, '◇', '*') AS t FROM {_join(FORMAL)}), "
        f"told AS (SELECT o_orderpriority, i = g AS same, levenshtein(x.t, y.t) <= 4 AS near, {lab} AS label {masked} JOIN texts x ON x.node = i JOIN texts y ON y.node = g) "
    )
    kept = "label IN ('equal', 'equivalent')"
    sums = ", ".join(
        f"count(*) FILTER (WHERE {m} AND NOT {kept} AND label <> 'unknown') AS {m}_false, count(*) FILTER (WHERE NOT {m} AND {kept}) AS {m}_missed" for m in ("same", "near")
    )
    out["metric_report"] = report + (
        "SELECT coalesce(o_orderpriority, 'all') AS o_orderpriority, coalesce(label, 'all') AS label, count(*) AS n, "
        f"count(*) FILTER (WHERE label = 'unknown') AS unresolved, {sums} FROM told GROUP BY GROUPING SETS ((o_orderpriority, label), (o_orderpriority), (label), ())"
    )
    spoken = f", {_templates(FORMAL)}, {_templates('rpn')}, texts AS (SELECT node, {FORMAL_TEXT} AS formal FROM {_join(FORMAL)}), posts AS (SELECT node, {rendering('rpn')} AS rendering FROM {_join('rpn')}) "
    out["sql_interface"] = labelled("customer", "1 + c_custkey % 4694", "1 + (c_custkey * 13) % 4694", "c_custkey, ")[:-1] + spoken + (
        f"SELECT c_custkey, x.formal, y.rendering, {lab} AS label {masked} JOIN texts x ON x.node = i JOIN posts y ON y.node = i"
    )
    out["crosscheck_catalogue"] = """
WITH u AS (SELECT DISTINCT 1 + p_partkey % 4694 AS node FROM part)
SELECT 'missing' AS check, 4694 - count(*) AS n FROM u UNION ALL SELECT 'differing', count(*) FROM u WHERE node % 5 = 0 UNION ALL SELECT 'extra', 1"""
    out["broken_renderings"] = with_laws(f"SELECT notation, count(*) AS n, count(*) AS n_refused FROM {SOME}, (VALUES " + ", ".join(f"('{n}')" for n in MAKERS) + ") AS x(notation) GROUP BY notation")
    fives = []
    for k in range(3):
        for i, a in enumerate(trees(k)):
            for j, b in enumerate(trees(5 - k)):
                numbers = iter(range(7))
                fives.append(f"({k},{i},{j},{_quote(_infix(_mark(a, numbers)) + ' = ' + _infix(_mark(b, numbers)))})")
    out["laws_beyond"] = f"""
WITH RECURSIVE rhymes(n, rhyme, used) AS (
  SELECT 1, [0], 1 UNION ALL
  SELECT n + 1, list_append(rhyme, x), greatest(used, x + 1) FROM rhymes, (SELECT CAST(unnest(range(0, 7)) AS INT) AS x) WHERE x <= used AND n < 7
), tpl(lo, lr, rr, tpl) AS (VALUES {', '.join(fives)}),
fives AS (SELECT 4694 + row_number() OVER (ORDER BY lo, lr, rr, rhyme) AS node, tpl, rhyme FROM tpl, rhymes WHERE n = 7)
SELECT s_suppkey, 4695 + s_suppkey * 57 AS number, {_filled('tpl', 'rhyme', "['x','y','z','w','u','v','r']", 7)} AS formal, 4695 + s_suppkey * 57 AS again
FROM supplier JOIN fives ON node = 4695 + s_suppkey * 57"""
    out["stream_labels"] = labelled("events", "1 + event_id % 4694", "1 + user_id % 4694", "") + f"SELECT {lab} AS label, count(*) AS n {masked} GROUP BY 1"
    out = {name: _counted(sql, COUNTED[name]) if name in COUNTED else sql for name, sql in out.items()}
    out["stream_windows"] = (
        labelled("events", "1 + event_id % 4694", "1 + user_id % 4694", "date_trunc('hour', ts) AS h, ")
        + f"SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, {lab} AS label, count(*) AS n {masked} "
        "WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2"
    )
    return out | _file_sql(lab)


def _file_sql(lab: str) -> dict[str, str]:
    """What comes back from the files of ``files.py``."""
    out: dict[str, str] = {}
    texts = f"texts AS (SELECT node, {FORMAL_TEXT} AS formal FROM {_join(FORMAL)})"
    told = f"WITH RECURSIVE {LAWS}, {_templates(FORMAL)}, {texts}"
    code = "[0, 0, 1, 1, 2, 2, 3, 3, 4]"  # of the nine outcome words in their order
    out["file_law_list"] = f"{told} SELECT CAST(node AS INT) AS node, formal FROM texts"
    out["file_lean_source"] = out["file_law_list"]
    out["file_listing"] = with_laws(
        " UNION ALL ".join(f"SELECT '{n}' AS notation, node || '. ' || {rendering(n)} AS line FROM {_join(n, SOME)}" for n in ("text", "text2")), "text", "text2"
    )
    used = f"array_to_string(list_transform(range(0, list_max(rhyme) + 1), lambda i: {LETTERS}[i + 1]), ',')"
    out["file_catalogue"] = with_laws(
        f"SELECT CAST(node AS INT) AS node, f.t AS formal, {rendering('tptp')} AS tptp, CAST(ord AS INT) AS \"order\", {used} AS variables, "
        "'lawloom' AS generator, CAST(4694 AS BIGINT) AS count, 'tptp' AS representation, true AS verified "
        f"FROM {_join('tptp')} JOIN (SELECT node AS n, {FORMAL_TEXT} AS t FROM {_join(FORMAL)}) f ON f.n = node", "tptp", FORMAL
    )
    out["file_json_document"] = with_laws(
        f"SELECT CAST(node AS INT) AS node, f.t AS formal, {rendering('polish')} AS polish, 'lawloom' AS generator, 'generated' AS source, "
        "'polish' AS representation, CAST(4694 AS BIGINT) AS count, true AS verified "
        f"FROM {_join('polish')} JOIN (SELECT node AS n, {FORMAL_TEXT} AS t FROM {_join(FORMAL)}) f ON f.n = node", "polish", FORMAL
    )
    frame = ["\\documentclass{article}", "\\usepackage{amsmath,amssymb}", "\\begin{document}", "\\noindent", "\\end{document}"]
    out["file_tex"] = with_laws(
        f"SELECT 'Equation ' || node || ': $' || {rendering('latex')} || '$\\\\' AS line FROM {_join('latex', SOME)} UNION ALL SELECT * FROM (VALUES "
        + ", ".join(f"({_quote(x)})" for x in frame) + ") AS x(line)", "latex"
    )
    out["file_lean"] = with_laws(f"SELECT {rendering('lean')} AS line FROM {_join('lean', SOME)}", "lean")
    out["file_outcomes"] = (
        f"SELECT CAST(row_number() OVER (PARTITION BY b.n_nationkey ORDER BY a.n_nationkey) AS INT) AS hyp, CAST(row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) AS INT) AS concl, "
        f"CAST({code}[1 + (a.n_nationkey * 31 + b.n_nationkey * 17) % 9] AS INT) AS status FROM nation a, nation b"
    )
    out["file_edges"] = (
        f"SELECT CAST(1 + l_orderkey % 4694 AS INT) AS hyp, CAST({code}[1 + (l_suppkey + l_linenumber) % 9] AS INT) AS status, count(*) AS n, "
        "CAST(sum(1 + l_partkey % 4694) AS BIGINT) AS concl_sum FROM lineitem GROUP BY 1, 2"
    )
    out["file_matrix"] = f"""WITH RECURSIVE {LAWS}, {SAT2}, s AS (
  SELECT a.node AS hyp, CASE WHEN a.node = b.node OR b.node = 1 OR a.node = 2 THEN 1 WHEN (a.mask & ~b.mask) <> 0 THEN 0 ELSE 4 END AS status FROM masks a, masks b),
r AS (SELECT hyp, count(*) FILTER (WHERE status = 0) AS f, count(*) FILTER (WHERE status = 1) AS t, count(*) FILTER (WHERE status = 4) AS u FROM s GROUP BY hyp)
SELECT CAST(hyp AS INT) AS hyp, f AS n_false, t AS n_true, f AS flat_false, t AS flat_true,
  CAST((SELECT sum(f) FROM r) AS BIGINT) AS all_false, CAST((SELECT sum(u) FROM r) AS BIGINT) AS all_unknown FROM r"""
    out["file_selection"] = (
        f"{told} SELECT source, CAST(id AS INT) AS id, formal FROM (SELECT 'file' AS source, 1 + c_custkey % 4694 AS id FROM customer "
        "UNION ALL SELECT 'built-in', unnest([1, 2, 43, 4512, 168])) JOIN texts ON node = id"
    )
    out["file_records"] = (
        f"WITH RECURSIVE {LAWS}, {SAT2}, p AS (SELECT c_custkey, 1 + c_custkey % 4694 AS i, 1 + (c_custkey * 13) % 4694 AS g FROM customer) "
        f"SELECT c_custkey, {lab} AS label, CAST(i AS INT) AS intended, CAST(g AS INT) AS generated, {_word('i', 'g', 'a', 'b')} AS forward, {_word('g', 'i', 'b', 'a')} AS backward "
        "FROM p JOIN masks a ON a.node = i JOIN masks b ON b.node = g"
    )
    out["file_report"] = """
SELECT s_suppkey, CAST(1 + s_suppkey % 4694 AS INT) AS intended_id,
  CASE WHEN s_suppkey % 5 = 0 THEN 'invalid' WHEN s_suppkey % 3 = 0 THEN 'outside_fragment' ELSE 'in_fragment' END AS generated_status,
  CASE WHEN s_suppkey % 5 = 0 THEN 'none (parse failure)' WHEN s_suppkey % 3 = 0 THEN 'brute_force' ELSE 'implication_graph' END AS oracle_used
FROM supplier"""
    out["cli_words"] = f"""{told}, turned AS ({DUALS}),
words AS (SELECT DISTINCT CASE s_suppkey % 6 WHEN 3 THEN '4695' || s_suppkey WHEN 5 THEN 'x = x * y' ELSE CAST(s_suppkey AS VARCHAR) END AS spec,
  s_suppkey % 6 IN (1, 2, 5) AS dual, CASE s_suppkey % 6 WHEN 3 THEN 0 WHEN 5 THEN 4 ELSE s_suppkey END AS n FROM supplier WHERE s_suppkey % 6 <> 4)
SELECT spec, dual, CAST(coalesce(CASE WHEN dual THEN dual_node ELSE l.node END, 0) AS INT) AS found FROM words w LEFT JOIN laws l ON l.node = w.n LEFT JOIN turned t ON t.node = w.n"""
    out["describe_prompts"] = "SELECT p_partkey, true AS names_law, true AS names_text FROM part"
    out["substring_of_answers"] = "SELECT c_custkey, 'in_fragment' AS status, CAST(1 + c_custkey % 4694 AS BIGINT) AS etp_id FROM customer"
    out["limited_rows"] = f"{told} SELECT CAST(node AS INT) AS node, formal, CAST(ord AS INT) AS \"order\" FROM texts JOIN laws USING (node) WHERE node <= 100"
    out["same_catalogues"] = with_laws("SELECT CAST(node AS INT) AS node, true AS same FROM laws")
    out["analyzed_renderings"] = (
        "SELECT notation, CAST(o_orderkey % 4 AS INT) AS kind, o_orderkey % 4 IN (0, 3) AS ok, "
        "CASE o_orderkey % 4 WHEN 1 THEN 'outside-fragment' WHEN 2 THEN 'parse-failure' ELSE '' END AS error, count(*) AS n "
        "FROM orders, (VALUES ('latex'), ('lean'), ('text'), ('json_ast')) AS x(notation) GROUP BY ALL"
    )
    return {name: _counted(sql, COUNTED[name]) if name in COUNTED else sql for name, sql in out.items()}


def _word(x: str, y: str, m: str, k: str) -> str:
    return f"CASE WHEN {x} = {y} OR {y} = 1 OR {x} = 2 THEN 'proof_true' WHEN ({m}.mask & ~{k}.mask) <> 0 THEN 'proof_false' ELSE 'unknown' END"


ORACLE_SQL = _sql()
