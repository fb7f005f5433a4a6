"""Cleaning of equation text as Column expressions: packaging off, meaning untouched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import SIGN

# -- What the cleaner and the scanner know.  Fixed values.
INFIX = "◇⋄⬦◆∘○◦·⋅*∗×+-/&%@#!?^~⊕⊗⊙⊖⊘•★†◁▷⊛⊚□"
RELATIONS = "≠<>≤≥→⇒∧∨¬"
MACROS = {
    "cdot": "·", "circ": "∘", "diamond": "◇", "ast": "*", "times": "×",
    "oplus": "⊕", "otimes": "⊗", "odot": "⊙", "ominus": "⊖", "oslash": "⊘",
    "bullet": "•", "star": "★", "dagger": "†", "triangleleft": "◁", "triangleright": "▷",
    "circledast": "⊛", "circledcirc": "⊚", "Box": "□",
}
#: Macros that the second dialect turns into the one operation, in the order they are replaced.
DIALECT_MACROS = (
    "oplus", "otimes", "diamond", "ast", "cdot", "circ", "bullet", "times", "star",
    "triangleleft", "triangleright", "wedge", "vee", "odot", "ominus", "oslash", "dagger",
)

#: White space as Python's str.isspace takes it.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_START = r"[\p{L}\p{Nl}_]"
IDENT = rf"{_START}[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]*+"
_QUANTIFIER = rf"(?i:∀|\\forall\b|for{SPACE}+(?:all|every|any)\b){SPACE}*"


def strip(text: Column) -> Column:
    """White space off both ends, Unicode's included."""
    return F.btrim(text, F.lit(_BLANKS))


def strip_quantifiers(text: Column) -> Column:
    """Leading quantifiers with their names, as many as there are.

    The list of names ends at a period or colon after a name, or else at its
    last comma; a quantifier without such an end stays.
    """
    gap = rf"(?:{SPACE}*+,{SPACE}*+|{SPACE}++)"
    closed = rf"(?:{IDENT}{gap})*{IDENT}{SPACE}*[.:]"
    listed = rf"(?:{IDENT}{gap})*{IDENT}{SPACE}*,"
    return F.regexp_replace(text, rf"^(?:{SPACE}*{_QUANTIFIER}(?:{closed}|{listed}){SPACE}*)+", "")


def _without_macros(s: Column) -> Column:
    """Math delimiters, wrappers and macros taken off; only texts with a backslash or dollar have any."""
    s = F.regexp_replace(s, r"\\[()\[\]]|\$", "")
    s = F.regexp_replace(s, r"\\(?:text|mathrm|mathbf|mathit|mathbin)\{([^{}]*)\}", "$1")
    for macro, sign in MACROS.items():
        s = F.regexp_replace(s, rf"\\{macro}(?![A-Za-z])", sign)
    s = F.regexp_replace(s, r"\\left", "")
    return F.regexp_replace(s, r"\\right", "")


def strip_noise(text: Column) -> Column:
    """The bare equation: fences, math delimiters, wrappers, macros, quantifiers and a final period taken off."""
    s = strip(text)
    fenced = strip(F.regexp_replace(s, rf"^```[a-zA-Z]*{SPACE}*|{SPACE}*```$", ""))
    s = F.when(F.contains(s, F.lit("```")), fenced).otherwise(s)
    s = strip(F.btrim(s, F.lit("`")))
    s = F.when(F.rlike(s, F.lit(r"[\\$]")), _without_macros(s)).otherwise(s)
    s = strip_quantifiers(s)
    return strip(F.rtrim(s, F.lit(".")))


def clean_dialect(text: Column) -> Column:
    """The second dialect's cleaning: every known macro becomes the operation, other backslashes go, blanks collapse."""
    s = strip(text)
    s = F.regexp_replace(s, r"\\[()\[\]]|\$\$?", "")
    s = F.regexp_replace(s, r"\\(?:text|mathrm|mathbf|mathbin)\{([^}]*)\}", "$1")
    for macro in DIALECT_MACROS:
        s = F.regexp_replace(s, rf"\\{macro}", SIGN)
    s = F.regexp_replace(s, r"\\", "")
    return strip(F.regexp_replace(s, rf"{SPACE}+", " "))


def equation_substring(text: Column) -> Column:
    """The longest part that looks like an equation, the first of equals; the text itself if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:[a-zA-Z0-9◇()]|{SPACE})+=(?:[a-zA-Z0-9◇()=]|{SPACE})+"), F.lit(0))
    best = F.array_max(F.transform(found, lambda m, i: F.struct(F.length(m).alias("n"), (-i).alias("i"), m.alias("m"))))["m"]
    return F.coalesce(strip(best), text)


def tokens(text: Column) -> Column:
    """``array<struct<kind, value>>`` of a cleaned text.

    Kinds: EQ, LP, RP, COMMA, IDENT, OP; NUM and REL tell that the text is
    outside the fragment, BAD that it is no equation.
    """
    found = F.regexp_extract_all(text, F.lit(rf"==|[=≡(),]|{IDENT}|\p{{Nd}}+|[^\s]"), F.lit(0))

    def kind(t: Column) -> Column:
        return (
            F.when(t.isin("==", "=", "≡"), "EQ")
            .when(t == "(", "LP")
            .when(t == ")", "RP")
            .when(t == ",", "COMMA")
            .when(F.rlike(t, F.lit(rf"^{_START}")), "IDENT")
            .when(F.rlike(t, F.lit(r"^\p{Nd}")), "NUM")
            .when(t.isin(*INFIX), "OP")
            .when(t.isin(*RELATIONS), "REL")
            .otherwise("BAD")
        )

    kept = F.filter(found, lambda t: ~F.rlike(t, F.lit(rf"^{SPACE}$")))
    return F.transform(kept, lambda t: F.struct(kind(t).alias("kind"), t.alias("value")))
