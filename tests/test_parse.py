"""Cleaning, parsing and mapping of messy texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lawloom.functions import clean, terms
from lawloom.operators import mapping
from lawloom.operators.catalogue import law_of_number

SEED = 90125
NAMES = ("p q r s t i", "Ä ö ü ß å ø", "left right up down in out", "k1 k2 k3 k4 k5 k6", "ж д л ф ц я", "_a _b _c _d _e _f")
WRAPS = ("{}", "${}$", r"\({}\)", r"\[{}\]", "`{}`", "```\n{}\n```", "  {} ", "{}.", "∀ {names}: {}", "for any {list}, {}")


def _spelled(term, names, sign, rng, call=None, top=True):
    """A tree in one of many ways: bare, in superfluous brackets, or as calls."""
    if not isinstance(term, tuple):
        return names[term] if rng.random() < 0.9 else f"({names[term]})"
    a, b = (_spelled(t, names, sign, rng, call, False) for t in term)
    if call:
        return f"{call}({a},{rng.choice(['', ' '])}{b})"
    body = f"{a}{rng.choice([' ', ''])}{sign}{rng.choice([' ', ''])}{b}"
    return body if top else f"({body})"


def _tree(postfix):
    stack = []
    for t in postfix:
        stack.append((stack.pop(-2), stack.pop()) if t == terms.OP else t)
    return stack[0]


def _operations(t):
    return 1 + _operations(t[0]) + _operations(t[1]) if isinstance(t, tuple) else 0


def _dressed(rng):
    """A law's number, its text in some dress, and what was used to make it."""
    node = rng.randrange(2, 4695)
    sides = [_tree(t) for t in law_of_number(node)]
    rng.shuffle(sides)
    names = rng.choice(NAMES).split()
    rng.shuffle(names)
    sign = rng.choice([c for c in clean.INFIX if c != "`"])
    call = rng.choice([None, None, "f", "mul"])
    said = " = ".join(_spelled(t, names, sign, rng, call) for t in sides)
    return node, said, sides, names, sign, call


def test_laws_in_any_dress(spark):
    """A law is itself under any names, sign, order of sides, brackets, calls and wrapping."""
    rng = random.Random(SEED)
    rows = []
    for k in range(400):
        node, said, _, names, _, _ = _dressed(rng)
        wrap = WRAPS[k % len(WRAPS)]
        rows.append((k, node, wrap.replace("{names}", " ".join(names)).replace("{list}", ", ".join(names)).replace("{}", said)))
    df = spark.createDataFrame(rows, "k int, node int, t string")
    wrong = [(r["t"], r["node"], r["m"]["status"], r["m"]["node"]) for r in mapping.map_texts(df, "t", "m").collect() if r["m"]["node"] != r["node"]]
    assert not wrong


def test_macros_are_signs(spark):
    rng, rows = random.Random(SEED + 1), []
    for macro in clean.MACROS:
        node = rng.randrange(2, 4695)
        said = " = ".join(_spelled(_tree(t), "abcdef", rf"\{macro} ", rng) for t in law_of_number(node))
        rows.append((node, f"${said}$"))
    df = spark.createDataFrame(rows, "node int, t string")
    assert all(r["m"]["node"] == r["node"] for r in mapping.map_texts(df, "t", "m").collect())


def test_broken_laws_are_refused_for_what_is_broken(spark):
    """Each change to a law's text takes it out of the fragment, or makes it no equation; the status follows from the change."""
    rng, rows = random.Random(SEED + 2), []
    while len(rows) < 300:
        node, _, sides, names, sign, _ = _dressed(rng)
        plain = [_spelled(t, names, f" {sign} ", random.Random(1)) for t in sides]
        said, ops = " = ".join(plain), sum(map(_operations, sides))
        other = "+" if sign != "+" else "*"
        rows += [
            (said + f" = {names[0]}", "outside-fragment"), (said.replace(" = ", " ≥ ") + " = " + names[0], "outside-fragment"), (said.replace(" = ", " "), "parse-failure"),
            (said + " )", "parse-failure"), (f"( {said}", "parse-failure"), (f"3 = {plain[0]}", "outside-fragment"), (f"{said} {{", "parse-failure"),
            (f"{plain[0]} = {plain[0]}", "internal-error" if _operations(sides[0]) and _operations(sides[0]) <= 2 else None),
            (f"(({plain[0]}) {sign} {names[1]}) {sign} ({plain[1]} {sign} {names[2]}) = {names[0]}", None),
            (f"{names[0]} {sign} {names[1]} {sign} {names[2]} = {plain[0]}", "parse-failure"),
            (f"({plain[0]}) {sign} ({plain[1]}) = {names[0]} {other} {names[1]}", "outside-fragment"),
        ]
        big = "q0"
        for i in range(1, 5 - ops + 1 if ops < 5 else 1):
            big = f"({big} {sign} q{i})"
        rows.append((f"({plain[0]}) {sign} ({plain[1]}) = {big}", "outside-fragment" if 1 + ops + max(0, 5 - ops) > 4 else None))
    rows = [r for r in rows if r[1]]
    many = " = " + "".join(f"(n{i} * " for i in range(12)) + "n12" + ")" * 12
    rows += [("n12" + many, "outside-fragment"), ("", "parse-failure"), (None, "parse-failure")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, wanted string")
    wrong = [(r["t"], r["wanted"], r["m"]["status"]) for r in mapping.map_texts(df, "t", "m").collect() if r["m"]["status"] != r["wanted"]]
    assert not wrong


def test_rows_are_kept_whatever_they_hold(spark):
    df = spark.createDataFrame([("x = y", 1), ("x = y", 1), (None, 2), (None, 2)], "t string, status int")
    assert mapping.map_texts(df, "t", "m").count() == 4


def test_numbers(spark):
    df = spark.createDataFrame([("43",), (" 43 ",), ("0",), ("4695",), ("043",), ("x = y",), ("²",)], "t string")
    got = {r["t"]: (r["m"]["status"], r["m"]["node"]) for r in mapping.resolve(df, "t", "m").collect()}
    assert got["43"] == got[" 43 "] == got["043"] == ("mapped", 43)
    assert got["0"] == got["4695"] == ("parse-failure", None)
    assert got["x = y"] == ("mapped", 2)
    assert got["²"][0] == "parse-failure"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("for all x, y, x*y = y*x", "x*y = y*x"), ("∀ x y: x = y", "x = y"), ("∀ x, f(x, y) = x", "f(x, y) = x"), ("forall x = y", "forall x = y"),
     ("∀ x. ∀ y. x = y.", "x = y"), ("for any x , y , op(x, y) = x", "op(x, y) = x"), (r"\forall a, b: a = b", "a = b")],
)
def test_quantifiers(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(clean.strip_noise(F.col("t")).alias("c")).first()["c"] == wanted


def test_second_dialect(spark):
    cases = {
        "x . y = y * x": ("in_fragment", "x ◇ y = y ◇ x", 43), "x ◇ x = x ◇ x": ("outside_fragment", "x ◇ x = x ◇ x", 0),
        "0 * 1 = 1 * 0": ("in_fragment", "x ◇ y = y ◇ x", 43), "hello": ("invalid", None, None),
        "(x ◇ y) ◇ z = x ◇ (y ◇ z)": ("in_fragment", "x ◇ (y ◇ z) = (x ◇ y) ◇ z", 4512),
        "The law: x ◇ (x ◇ x) = x, as said": ("in_fragment", "x = x ◇ (x ◇ x)", 8),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r["t"]: tuple(r["m"])[:3] for r in mapping.normalize_dialect(df, "t", "m").collect()}
    assert got == cases


def test_numbers_beyond_the_catalogue_in_the_second_dialect(spark):
    df = spark.createDataFrame([("x = ((y*x)*(x*z))*(y*(y*x))",)], "t string")
    row = mapping.normalize_dialect(df, "t", "m").first()["m"]
    assert row["status"] == "outside_fragment"
    assert row["etp_id"] > 4694


def test_finding_laws_and_duals(spark):
    from lawloom.sources import readers

    got = {(r["spec"], r["dual"]): r["found"] for r in mapping.find(readers.specs(spark, ["*4", "[43,", "x = y]", "* 8", "no law"])).collect()}
    assert got[("43", False)] == 43 and got[("x = y", False)] == 2 and got[("no law", False)] is None
    assert got[("4", True)] == 5 and got[("8", True)] == 23


def test_laws_of_any_number(spark):
    df = spark.createDataFrame([(43,), (4695,), (0,), (None,)], "n long")
    got = {r["n"]: r["law"] and r["law"]["formal"] for r in mapping.laws_by_number(df, "n").collect()}
    assert got[43] == "x ◇ y = y ◇ x" and got[0] is None and got[None] is None
    assert got[4695].count("◇") == 5
