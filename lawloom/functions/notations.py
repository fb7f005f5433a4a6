"""Seventeen notations of an equation: how to write each, and how to read it back.

Writing is a fold over the postfix terms.  Reading takes a text apart only as
far as its order of operations and names goes, builds the equation from that,
writes it again and compares: whatever is not exactly what this module writes
(blanks between tokens aside, where the notation does not use them) is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms
from .terms import SIGN

Writer = Callable[[Column, Column, Column, Column], Column]

# -- Texts and names that the notations are defined by.  Fixed values.
SCENARIO = (
    "A workshop welder takes two parts, in a definite order, and fuses them into "
    "one new part. Feeding the same two parts in the opposite order, or grouping "
    "a sequence of welds differently, may give a different part."
)
CONFUSABLE = ("l", "I", "ll", "lI", "Il", "II", "l1", "I1", "lll", "III", "llI", "lIl")
VERBOSE = (
    "antecedent", "mediator", "consequent", "auxiliary", "parameter", "argument",
    "operand", "subject", "residue", "quotient", "premise", "nucleus",
)
BRANCH, LAST, PIPE, GAP = "├── ", "└── ", "│   ", "    "
BRACKETS = {"bracket": ("open bracket", "close bracket"), "parenthesis": ("open parenthesis", "close parenthesis")}
#: Names that the target languages keep to themselves.  Fixed values.
PYTHON_WORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from "
    "global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()
LEAN_WORDS = (
    "fun let in do if then else match with by at have show from calc where suffices theorem def abbrev lemma example "
    "instance structure class inductive deriving open universe variable section namespace end import forall exists "
    "Prop Type Sort"
).split()

#: An identifier as the parser takes it.
NAME = r"[\p{L}\p{Nl}_][\p{L}\p{N}\p{M}\p{Pc}]*"


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _names(lhs: Column, rhs: Column, names: Column) -> Column:
    """Names of the variables by first appearance."""
    return F.transform(terms.variables(lhs, rhs), lambda t: F.get(names, t))


def _prefixed(template: str) -> Callable[[Column, Column], Column]:
    """An operation written as a template with ``L`` and ``R`` for its arguments."""
    before, between, after = re.fullmatch(r"(.*?)<L>(.*?)<R>(.*)", template, re.S).groups()
    return lambda a, b: _cat(before, a, between, b, after)


def _term(term: Column, names: Column, template: str, leaf: Callable[[Column], Column] | None = None, nest=None) -> Column:
    return terms.render_with(term, names, _prefixed(template), nest, leaf)


def _parens(s: Column) -> Column:
    return _cat("(", s, ")")


# -- Styles: checked when made, so that what they write can be read back.


@dataclass(frozen=True)
class LatexStyle:
    operator: str = r"\diamond"
    delimiters: str = "none"
    label: str | None = None
    auto_size: bool = False
    quantify: bool = False
    mathbin: bool = False

    def __post_init__(self):
        if self.delimiters not in ("none", "inline", "display", "equation"):
            raise ValueError(f"unknown delimiters {self.delimiters!r}")
        if not self.operator.strip():
            raise ValueError("the operator must not be empty")


@dataclass(frozen=True)
class LeanStyle:
    decl: str = "example"
    universe: str = "u"
    prefix: str = "Equation"
    docstring: bool = False

    def __post_init__(self):
        if self.decl not in ("abbrev", "def", "example") or self.universe not in ("u", "star", "zero"):
            raise ValueError("decl is abbrev, def or example; universe is u, star or zero")
        if self.docstring and self.decl == "example":
            raise ValueError("a docstring would tell the number of an anonymous example")

    @property
    def carrier(self) -> str:
        return {"u": "Type u", "star": "Type*", "zero": "Type"}[self.universe]


def _phrases(**phrases: str) -> None:
    for field_name, value in phrases.items():
        if not re.fullmatch(r"[a-z]+(?: [a-z]+)*", value):
            raise ValueError(f"{field_name} must be lower-case words with single blanks, not {value!r}")
        if any(len(word) == 1 for word in value.split()):
            raise ValueError(f"{field_name} must not have a one-letter word: it would read as a variable")


@dataclass(frozen=True)
class TextStyle:
    operator_word: str = "diamond"
    brackets: str = "bracket"
    equals_word: str = "equals"
    quantify: bool = False

    def __post_init__(self):
        if self.brackets not in BRACKETS:
            raise ValueError(f"brackets must be one of {tuple(BRACKETS)}")
        _phrases(operator_word=self.operator_word, equals_word=self.equals_word)
        every = [self.operator_word, self.equals_word, *BRACKETS[self.brackets]]
        if any(i != k and re.search(rf"\b{re.escape(b)}\b", a) for i, a in enumerate(every) for k, b in enumerate(every)):
            raise ValueError("one phrase contains another")


@dataclass(frozen=True)
class PrefixStyle:
    operator_word: str = "diamond"
    connector: str = "and"
    equals_word: str = "equals"
    quantify: bool = False

    def __post_init__(self):
        _phrases(operator_word=self.operator_word, connector=self.connector, equals_word=self.equals_word)
        if " " in self.connector:
            raise ValueError("the connector must be one word")
        if len({"the", self.connector, self.equals_word.split()[0]}) < 3 or self.operator_word in ("the", "of"):
            raise ValueError("a reader could not tell the phrases apart")


# -- Writers.  Each takes lhs, rhs, names and the law's number (which only named Lean declarations use).


def canonical(lhs, rhs, names, node=None) -> Column:
    return terms.render(lhs, rhs, names)


def latex(style: LatexStyle = LatexStyle()) -> Writer:
    op = rf"\mathbin{{{style.operator}}}" if style.mathbin else style.operator

    def name(t: Column) -> Column:
        return F.when(F.length(t) == 1, t).otherwise(_cat(r"\mathit{", t, "}"))

    def nest(s: Column) -> Column:
        return _cat(r"\left( ", s, r" \right)") if style.auto_size else _parens(s)

    def write(lhs, rhs, names, node=None) -> Column:
        sides = [_term(t, names, f"<L> {op} <R>", name, nest) for t in (lhs, rhs)]
        body = _cat(sides[0], " = ", sides[1])
        if style.quantify:
            body = _cat(r"\forall ", F.array_join(F.transform(_names(lhs, rhs, names), name), " "), ": ", body)
        label = rf"\label{{{style.label}}}" if style.label else ""
        ends = {
            "none": ("", ""), "inline": ("$", "$"), "display": (r"\[", r"\]"),
            "equation": (f"\\begin{{equation}}{label}\n  ", "\n\\end{equation}"),
        }[style.delimiters]
        return _cat(ends[0], body, ends[1])

    return write


def lean(style: LeanStyle = LeanStyle()) -> Writer:
    def write(lhs, rhs, names, node=None) -> Column:
        known = F.lit(None).cast("string") if node is None else node.cast("string")
        name = F.coalesce(known, F.lit("Unknown"))
        head = F.lit("example") if style.decl == "example" else _cat(f"{style.decl} {style.prefix}", name)
        body = terms.render(lhs, rhs, names)
        out = _cat(head, f" (G : {style.carrier}) [Magma G] : Prop := ∀ ", F.array_join(_names(lhs, rhs, names), " "), " : G, ", body)
        if style.docstring:
            origin = F.when(known.isNotNull(), _cat("Equation ", known, " of the ETP catalogue")).otherwise("A magma law outside the ETP catalogue")
            out = _cat("/-- ", origin, ": `", body, "`. -/\n", out)
        return out

    return write


def py_lambda(lhs, rhs, names, node=None) -> Column:
    sides = [_term(t, names, "op(<L>, <R>)") for t in (lhs, rhs)]
    return _cat("lambda op, ", F.array_join(_names(lhs, rhs, names), ", "), ": ", sides[0], " == ", sides[1])


def py_cayley_table(lhs, rhs, names, node=None) -> Column:
    sides = [_term(t, names, "table[<L>][<R>]") for t in (lhs, rhs)]
    loops = F.array_join(F.transform(_names(lhs, rhs, names), lambda v: _cat("for ", v, " in range(n)")), " ")
    return _cat("def law(table):\n    n = len(table)\n    return all(", sides[0], " == ", sides[1], " ", loops, ")\n")


def _for_all(lhs, rhs, names) -> Column:
    return _cat("for all ", F.array_join(_names(lhs, rhs, names), " "), ", ")


def text(style: TextStyle = TextStyle()) -> Writer:
    opening, closing = BRACKETS[style.brackets]

    def write(lhs, rhs, names, node=None) -> Column:
        nest = lambda s: _cat(f"{opening} ", s, f" {closing}")
        sides = [_term(t, names, f"<L> {style.operator_word} <R>", None, nest) for t in (lhs, rhs)]
        body = _cat(sides[0], f" {style.equals_word} ", sides[1])
        return _cat(_for_all(lhs, rhs, names), body) if style.quantify else body

    return write


def text2(style: PrefixStyle = PrefixStyle()) -> Writer:
    def write(lhs, rhs, names, node=None) -> Column:
        sides = [_term(t, names, f"the {style.operator_word} of <L> {style.connector} <R>") for t in (lhs, rhs)]
        body = _cat(sides[0], f" {style.equals_word} ", sides[1])
        return _cat(_for_all(lhs, rhs, names), body) if style.quantify else body

    return write


def ssa(lhs, rhs, names, node=None) -> Column:
    """One definition per operation; the two sides share the numbering of temporaries."""
    kind = "struct<st: array<string>, lines: array<string>>"

    def step(acc: Column, t: Column) -> Column:
        st, lines = acc["st"], acc["lines"]
        temp = _cat("t", (F.size(lines) + 1).cast("string"))
        line = _cat(temp, " = ", F.element_at(st, -2), f" {SIGN} ", F.element_at(st, -1))
        joined = F.struct(F.concat(F.slice(st, F.lit(1), F.size(st) - 2), F.array(temp)).alias("st"), F.concat(lines, F.array(line)).alias("lines"))
        pushed = F.struct(F.concat(st, F.array(F.get(names, t))).alias("st"), lines.alias("lines"))
        return F.when(t == terms.OP, joined).otherwise(pushed).cast(kind)

    done = F.aggregate(F.concat(lhs, rhs), F.struct(F.array().alias("st"), F.array().alias("lines")).cast(kind), step)

    def spelled(d: Column) -> Column:
        last = _cat("assert ", F.get(d["st"], F.lit(0)), " = ", F.get(d["st"], F.lit(1)))
        return F.array_join(F.concat(d["lines"], F.array(last)), "\n")

    return terms.let(done, spelled)


def slots(lhs, rhs, names, node=None) -> Column:
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms.variables(lhs, rhs)), F.lit(1))), lambda t: t.cast("string"))
    both = F.struct(terms.renumber(lhs, rhs).alias("t"), numbers.alias("n"))

    def write(b: Column) -> Column:
        return _cat("[", _term(b["t"]["lhs"], b["n"], "[<L>, <R>]"), ", ", _term(b["t"]["rhs"], b["n"], "[<L>, <R>]"), "]")

    return terms.let(both, write)


def _postfix(lhs, rhs, names) -> Column:
    """Tokens in postfix order, ``=`` last."""
    return F.concat(F.transform(F.concat(lhs, rhs), lambda t: F.when(t == terms.OP, SIGN).otherwise(F.get(names, t))), F.array(F.lit("=")))


def rpn(form: str = "tokens") -> Writer:
    if form not in ("tokens", "program"):
        raise ValueError("form is tokens or program")

    def write(lhs, rhs, names, node=None) -> Column:
        tokens = _postfix(lhs, rhs, names)
        if form == "tokens":
            return F.array_join(tokens, " ")
        return F.array_join(F.transform(tokens, lambda t: F.when(t == SIGN, "OP").when(t == "=", "EQ").otherwise(_cat("PUSH ", t))), "; ")

    return write


def polish(lhs, rhs, names, node=None) -> Column:
    return _cat("= ", _term(lhs, names, f"{SIGN} <L> <R>"), " ", _term(rhs, names, f"{SIGN} <L> <R>"))


def tptp(lhs, rhs, names, node=None) -> Column:
    sides = [_term(t, names, "op(<L>,<R>)", F.upper) for t in (lhs, rhs)]
    return _cat("fof(law, axiom, ![", F.upper(F.array_join(_names(lhs, rhs, names), ",")), "] : ", sides[0], " = ", sides[1], ").")


def smtlib(lhs, rhs, names, node=None) -> Column:
    sides = [_term(t, names, "(op <L> <R>)") for t in (lhs, rhs)]
    binders = F.array_join(F.transform(_names(lhs, rhs, names), lambda v: _cat("(", v, " M)")), " ")
    return _cat("(declare-sort M 0)\n(declare-fun op (M M) M)\n(assert (forall (", binders, ")\n  (= ", sides[0], " ", sides[1], ")))")


def _tree(label: str, a: Column, b: Column) -> Column:
    """Two drawn subtrees under a label: every line of a subtree shifts by one column."""
    return _cat(f"{label}\n{BRANCH}", F.replace(a, F.lit("\n"), F.lit(f"\n{PIPE}")), f"\n{LAST}", F.replace(b, F.lit("\n"), F.lit(f"\n{GAP}")))


def ascii_tree(lhs, rhs, names, node=None) -> Column:
    return _tree("=", *(terms.render_with(t, names, lambda a, b: _tree(SIGN, a, b)) for t in (lhs, rhs)))


def graphviz(lhs, rhs, names, node=None) -> Column:
    """Nodes in preorder; an operation's first edge goes to the next node, its second past the first subtree."""
    part = "struct<labels: array<string>, skips: array<int>>"

    def join(label: str, a: Column, b: Column) -> Column:
        return F.struct(
            F.concat(F.array(F.lit(label)), a["labels"], b["labels"]).alias("labels"),
            F.concat(F.array(F.size(a["labels"]) + 1), a["skips"], b["skips"]).alias("skips"),
        )

    def side(term: Column) -> Column:
        return terms.fold(
            term,
            lambda t: F.struct(F.array(F.get(names, t)).alias("labels"), F.array(F.lit(0)).alias("skips")),
            lambda a, b: join(SIGN, a, b),
            part,
        )

    def spelled(whole: Column) -> Column:
        nodes = F.transform(whole["labels"], lambda x, i: _cat("  n", (i + 1).cast("string"), ' [label="', x, '"];'))

        def edges(k: Column, i: Column) -> Column:
            to = lambda j: _cat("  n", (i + 1).cast("string"), " -> n", j.cast("string"), ";")
            return F.when(k > 0, F.array(to(i + 2), to(i + 1 + k))).otherwise(F.array().cast("array<string>"))

        lines = F.concat(nodes, F.flatten(F.transform(whole["skips"], edges)))
        return _cat("digraph law {\n  ordering=out;\n", F.array_join(lines, "\n"), "\n}")

    sides = F.struct(side(lhs).alias("a"), side(rhs).alias("b"))
    return terms.let(terms.let(sides, lambda v: join("=", v["a"], v["b"])), spelled)


def json_ast(lhs, rhs, names, node=None) -> Column:
    quoted = lambda t: _cat('"', t, '"')
    sides = [_term(t, names, f'{{"{SIGN}": [<L>, <R>]}}', quoted) for t in (lhs, rhs)]
    return _cat('{"=": [', sides[0], ", ", sides[1], "]}")


def confusable_vars(scheme: str = "confusable") -> Writer:
    table = {"confusable": CONFUSABLE, "verbose": VERBOSE}[scheme]

    def write(lhs, rhs, names, node=None) -> Column:
        both = F.struct(terms.renumber(lhs, rhs).alias("t"), F.array(*map(F.lit, table)).alias("n"))
        return terms.let(both, lambda b: terms.render(b["t"]["lhs"], b["t"]["rhs"], b["n"]))

    return write


def word_problem(lhs, rhs, names, node=None) -> Column:
    nest = lambda s: _cat("the part made by ", s)
    sides = [_term(t, names, "welding <L> to <R>", None, nest) for t in (lhs, rhs)]

    def quantified(used: Column) -> Column:
        one = _cat("for any part ", F.get(used, F.lit(0)))
        head = F.array_join(F.slice(used, F.lit(1), F.greatest(F.size(used) - 1, F.lit(0))), ", ")
        return F.when(F.size(used) == 1, one).otherwise(_cat("for any parts ", head, " and ", F.element_at(used, -1)))

    return _cat(f"{SCENARIO}\n\nClaim: ", terms.let(_names(lhs, rhs, names), quantified), ", ", sides[0], " gives the same part as ", sides[1], ".")


# -- Readers: the preorder list of names and signs that a text holds.


def _tokens(source: Column, pattern: str) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(0))


def _signs(tokens: Column, **meaning: str) -> Column:
    """Tokens with those of ``op`` as signs, and those of ``drop`` left out."""
    op, drop = meaning.get("op"), meaning.get("drop")
    kept = F.filter(tokens, lambda t: ~F.rlike(t, F.lit(f"^(?:{drop})$"))) if drop else tokens
    return F.transform(kept, lambda t: F.when(F.rlike(t, F.lit(f"^(?:{op})$")), SIGN).otherwise(t))


def _pair(sides: Column) -> Column:
    """``struct<lhs, rhs>`` of exactly two sides, else null."""
    return terms.let(
        sides, lambda s: F.when(F.size(s) == 2, F.struct(F.get(s, F.lit(0)).alias("lhs"), F.get(s, F.lit(1)).alias("rhs")))
    )


def _preorder(tokens: Column) -> Column:
    return _pair(terms.preorder_sides(tokens))


def _infix_side(tokens: Column) -> Column:
    """Postfix tokens of a side in which only the outermost operation may lack parentheses.

    A closing parenthesis joins the two terms before it; what it closes is
    checked by writing the equation again.
    """
    kind = "array<array<string>>"

    def join(st: Column) -> Column:
        return F.concat(
            F.slice(st, F.lit(1), F.greatest(F.size(st) - 2, F.lit(0))),
            F.array(F.concat(F.element_at(st, F.greatest(-F.size(st), F.lit(-2))), F.element_at(st, -1), F.array(F.lit(SIGN)))),
        )

    def step(st: Column, t: Column) -> Column:
        closed = F.when((t == ")") & (F.size(st) >= 2), join(st)).otherwise(st)
        return F.when(t.isin("(", ")", SIGN), closed).otherwise(F.concat(st, F.array(F.array(t)))).cast(kind)

    done = F.aggregate(tokens, F.array().cast(kind), step)
    return terms.let(done, lambda d: F.when(F.size(d) == 2, F.get(join(d), F.lit(0))).when(F.size(d) == 1, F.get(d, F.lit(0))))


def _infix(source: Column) -> Column:
    """Both sides of a text in names, signs, parentheses and ``=``."""
    sides = F.transform(F.split(source, "=", -1), lambda p: _infix_side(_tokens(p, rf"{NAME}|[{SIGN}()]")))
    return _pair(sides)


def _read_latex(style: LatexStyle):
    def read(source: Column) -> Column:
        op = rf"\mathbin{{{style.operator}}}" if style.mathbin else style.operator
        body = F.regexp_replace(source, r"^\\begin\{equation\}(?:\\label\{[^{}]*\})?|\\end\{equation\}$|\\left|\\right|^\$|\$$|^\\\[|\\\]$", "")
        body = F.regexp_replace(body, r"^\s*\\forall [^:]*: ", "")
        body = F.replace(body, F.lit(op), F.lit(SIGN))
        return _infix(F.regexp_replace(body, r"\\mathit\{([^{}]*)\}", "$1"))

    return read


def _read_text(style: TextStyle):
    opening, closing = BRACKETS[style.brackets]

    def read(source: Column) -> Column:
        body = F.regexp_replace(source, "^for all [^,]*, ", "")
        for phrase, sign in ((opening, "("), (closing, ")"), (style.equals_word, "="), (style.operator_word, SIGN)):
            body = F.regexp_replace(body, rf"(?<!\S){re.escape(phrase)}(?!\S)", sign)
        return _infix(body)

    return read


def _read_text2(style: PrefixStyle):
    def read(source: Column) -> Column:
        body = F.regexp_replace(source, "^for all [^,]*, ", "")
        body = F.regexp_replace(body, rf"(?<!\S)the {style.operator_word} of(?!\S)", SIGN)
        body = F.regexp_replace(body, rf"(?<!\S)(?:{style.connector}|{style.equals_word})(?!\S)", "")
        return _preorder(_tokens(body, rf"{NAME}|{SIGN}"))

    return read


def _between(source: Column, pattern: str) -> Column:
    return F.regexp_extract(source, pattern, 1)


def _read_ssa(source: Column) -> Column:
    """Definitions are put in where their temporaries stand."""
    kind = "map<string, array<string>>"

    def value(known: Column, name: Column) -> Column:
        return F.coalesce(F.try_element_at(known, name), F.array(name))

    def step(known: Column, line: Column) -> Column:
        def define(part: Column) -> Column:
            fine = (F.size(part) == 5) & (F.get(part, F.lit(1)) == "=")
            built = F.concat(value(known, F.get(part, F.lit(2))), value(known, F.get(part, F.lit(4))), F.array(F.lit(SIGN)))
            new = fine & ~F.map_contains_key(known, F.get(part, F.lit(0)))
            return F.when(new, F.map_concat(known, F.create_map(F.get(part, F.lit(0)), built))).otherwise(known).cast(kind)

        return terms.let(F.split(line, " ", -1), define)

    def sides(v: Column) -> Column:
        fine = (F.size(v["last"]) == 4) & (F.get(v["last"], F.lit(0)) == "assert") & ~F.array_contains(v["last"], "")
        pair = F.struct(value(v["known"], F.get(v["last"], F.lit(1))).alias("lhs"), value(v["known"], F.get(v["last"], F.lit(3))).alias("rhs"))
        return F.when(fine, pair)

    def whole(lines: Column) -> Column:
        known = F.aggregate(lines, F.create_map().cast(kind), step)
        return terms.let(F.struct(known.alias("known"), F.split(F.element_at(lines, -1), " ", -1).alias("last")), sides)

    return terms.let(F.split(source, "\n", -1), whole)


def _read_rpn(form: str):
    def read(source: Column) -> Column:
        plain = source
        if form == "program":
            plain = F.array_join(F.transform(F.split(source, "; ", -1), lambda s: F.when(s == "OP", SIGN).when(s == "EQ", "=").otherwise(F.regexp_extract(s, r"^PUSH (\S+)$", 1))), " ")
        body = F.filter(F.split(plain, " ", -1), lambda t: (t != "=") & (t != ""))
        kind = "array<array<string>>"

        def step(st: Column, t: Column) -> Column:
            joined = F.concat(F.slice(st, F.lit(1), F.greatest(F.size(st) - 2, F.lit(0))), F.array(F.concat(F.element_at(st, F.greatest(-F.size(st), F.lit(-2))), F.element_at(st, -1), F.array(t))))
            return F.when((t == SIGN) & (F.size(st) >= 2), joined).otherwise(F.concat(st, F.array(F.array(t)))).cast(kind)

        return _pair(F.aggregate(body, F.array().cast(kind), step))

    return read


def _read_call(before: str, word: str, after: str = "$"):
    """Readers of calls ``word(…)`` between two fixed ends."""

    def read(source: Column) -> Column:
        body = _between(source, rf"(?s)^{before}(.*?){after}")
        return _preorder(_signs(_tokens(body, NAME), op=word))

    return read


def _read_labels(source: Column, pattern: str) -> Column:
    labels = F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
    return terms.let(labels, lambda x: _preorder(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))))


def _read_word_problem(source: Column) -> Column:
    body = _between(source, r"(?s)Claim: for any parts? [^.]*?(?<!,), ((?:(?!, ).)*)\.$")
    body = F.replace(body, F.lit("the part made by welding"), F.lit("welding"))
    body = F.replace(body, F.lit("gives the same part as"), F.lit(""))
    return _preorder(_signs(_tokens(body, NAME), op="welding", drop="to"))


def _read_slots(source: Column) -> Column:
    """``[`` opens the pair of sides first, then operations; numbers become letters."""
    inner = _tokens(_between(source, r"(?s)^\s*\[(.*)\]\s*$"), r"\[|[0-9]+")
    name = lambda t: F.coalesce(F.get(terms.letters(), (t.try_cast("int") - 1)), _cat("#", t))
    return _preorder(F.transform(inner, lambda t: F.when(t == "[", SIGN).otherwise(name(t))))


# -- The registry.


@dataclass(frozen=True)
class Notation:
    """A notation: its writer, its reader, and how a text read back must agree.

    ``tight`` texts are compared without blanks; ``names`` is how variables
    come back: as written, renamed, or in lower case.  ``refused`` names cannot
    be written at all.
    """

    name: str
    write: Writer
    read: Callable[[Column], Column]
    tight: bool = False
    match: str = "exact"
    multiline: bool = False
    refused: tuple[str, ...] = ()
    ascii_names: bool = False
    style: dict = field(default_factory=dict)

    def writable(self, names: Column) -> Column:
        """Whether all names can be used in this notation."""
        bad = F.exists(names, lambda v: v.isin(*self.refused)) if self.refused else F.lit(False)
        if self.ascii_names:
            bad = bad | F.exists(names, lambda v: ~F.rlike(v, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")))
        if self.name == "ssa":
            bad = bad | F.exists(names, lambda v: F.rlike(v, F.lit("^t[0-9]+$")))
        return ~bad

    def rendered(self, lhs: Column, rhs: Column, names: Column, node: Column | None = None) -> Column:
        """The text, or null if a name cannot be used."""

        def write(v: Column) -> Column:
            return F.when(self.writable(v["names"]), self.write(v["lhs"], v["rhs"], v["names"], node))

        return terms.let(F.struct(lhs.alias("lhs"), rhs.alias("rhs"), names.alias("names")), write)

    def read_back(self, source: Column, node: Column | None = None) -> Column:
        """``struct<names, lhs, rhs>`` of a text of this notation; null for any other text."""
        squeeze = (lambda s: F.regexp_replace(s, r"\s+", "")) if self.tight else (lambda s: s)

        def checked(v: Column) -> Column:
            again = self.rendered(v["lhs"], v["rhs"], v["names"], node)
            alike = squeeze(again) == squeeze(source)
            if self.name == "confusable_vars":  # any names may come: written again under the same names
                alike = F.regexp_replace(terms.render(v["lhs"], v["rhs"], v["names"]), r"\s+", "") == F.regexp_replace(source, r"\s+", "")
            names = F.transform(v["names"], F.lower) if self.name == "tptp" else v["names"]
            return F.when(alike, F.struct(names.alias("names"), v["lhs"].alias("lhs"), v["rhs"].alias("rhs")))

        def whole(side: Column) -> Column:
            """A term has one name more than operations; a sign without arguments breaks that."""
            return F.coalesce(2 * F.size(F.filter(side, lambda t: t == SIGN)) + 1 == F.size(side), F.lit(False))

        def encoded(p: Column) -> Column:
            return F.when(whole(p["lhs"]) & whole(p["rhs"]), terms.let(terms.encode(p["lhs"], p["rhs"]), checked))

        return terms.let(source, lambda text: terms.let(self.read(text), encoded))

    def round_trip(self, lhs: Column, rhs: Column, names: Column, node: Column | None = None) -> Column:
        """Whether writing and reading gives the same equation (up to names if the notation renames)."""

        def same(v: Column) -> Column:
            alike = (v["back"]["lhs"] == v["own"]["lhs"]) & (v["back"]["rhs"] == v["own"]["rhs"])
            if self.match == "exact":
                alike = alike & (v["back"]["names"] == v["names"])
            return F.coalesce(alike, F.lit(False))

        back = self.read_back(self.rendered(lhs, rhs, names, node), node)
        own = F.struct(back.alias("back"), terms.renumber(lhs, rhs).alias("own"), _names(lhs, rhs, names).alias("names"))
        return terms.let(own, same)


def notation(name: str, **style) -> Notation:
    """The notation of that name, with its style's options."""
    if name == "latex":
        s = LatexStyle(**style)
        return Notation(name, latex(s), _read_latex(s), tight=True, style=style)
    if name == "lean":
        s = LeanStyle(**style)
        pattern = r"(?s)∀ [^:]*: G, (.*)$"
        return Notation(name, lean(s), lambda t: _infix(_between(t, pattern)), refused=(*LEAN_WORDS, "G"), ascii_names=True, style=style)
    if name == "text":
        s = TextStyle(**style)
        return Notation(name, text(s), _read_text(s), style=style)
    if name == "text2":
        s = PrefixStyle(**style)
        return Notation(name, text2(s), _read_text2(s), style=style)
    if name == "rpn":
        form = style.get("form", "tokens")
        return Notation(name, rpn(form), _read_rpn(form), style=style)
    if name == "confusable_vars":
        return Notation(name, confusable_vars(style.get("scheme", "confusable")), _infix, match="up-to-renaming", style=style)
    if style:
        raise ValueError(f"{name} has no options")
    python = (*PYTHON_WORDS, "op")
    return {
        "py_lambda": Notation(name, py_lambda, _read_call("lambda op, [^:]*: ", "op"), True, refused=python, ascii_names=True),
        "py_cayley_table": Notation(
            name, py_cayley_table, _read_call(r"def law\(table\):\n    n = len\(table\)\n    return all\(", "table", r" for .*\)\n$"),
            multiline=True, refused=(*PYTHON_WORDS, "law", "table", "n"), ascii_names=True,
        ),
        "ssa": Notation(name, ssa, _read_ssa, multiline=True),
        "slots": Notation(name, slots, _read_slots, True, match="up-to-renaming"),
        "polish": Notation(name, polish, lambda t: _preorder(F.filter(_tokens(t, r"\S+"), lambda x: x != "="))),
        "tptp": Notation(name, tptp, _read_call(r"fof\(law, axiom, !\[[^\]]*\] : ", "op", r"\)\.$"), True),
        "smtlib": Notation(name, smtlib, _read_call(r".*\(= ", "op", r"\)\)\)$"), True, multiline=True, refused=("op",)),
        "ascii_tree": Notation(name, ascii_tree, lambda t: _read_labels(t, r"(?m)^[│├└─ ]*(\S+)$"), multiline=True),
        "graphviz": Notation(name, graphviz, lambda t: _read_labels(t, r'\[label="([^"]*)"\]'), True, multiline=True),
        "json_ast": Notation(
            name, json_ast, lambda t: _preorder(F.filter(F.regexp_extract_all(t, F.lit('"([^"]*)"'), F.lit(1)), lambda x: x != "=")), True
        ),
        "word_problem": Notation(name, word_problem, _read_word_problem, multiline=True),
    }[name]


NOTATIONS = (
    "latex", "lean", "py_lambda", "py_cayley_table", "text", "text2", "ssa", "slots", "rpn", "polish", "tptp",
    "smtlib", "ascii_tree", "graphviz", "json_ast", "confusable_vars", "word_problem",
)
