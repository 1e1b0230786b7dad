"""Text and number cleaning as Columns: built-in expressions only, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors to micromolar by upper-case unit (fixed values).
UNIT_TO_UM = {"NANOMOLAR": 0.001, "MICROMOLAR": 1.0}
#: Labels of the two binary outcomes (fixed values).
BINARY_OUTCOMES = {"active": "Active", "inactive": "Inactive"}

#: The signs that Unicode counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Text without white space at either end; null becomes empty."""
    return F.btrim(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit(WHITE_SPACE))


def not_blank(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("")) != ""


def compound_id(c: Column | str) -> Column:
    """Canonical text of a positive integer up to 2^63-1; null for anything else.

    ``00123`` and ``123.0`` give ``123``, ``1E3`` gives ``1000``; ``123.4``, ``0``, ``-1`` and words give null.
    """
    t = clean(c)
    plain = F.regexp_extract(t, r"^\+?0*(\d{1,19})(\.0*)?$", 1)
    whole = F.when(plain != "", plain.try_cast("bigint"))
    power = F.when(t.rlike(r"^\+?\d+(\.\d*)?[eE]\+?\d+$"), t.try_cast("decimal(38,10)"))
    power = F.when(power == F.floor(power), power.try_cast("bigint"))
    number = F.coalesce(whole, power)
    return F.when(number > 0, number.cast("string"))


def number(c: Column | str) -> Column:
    """A double from text with optional thousands commas; null if it isn't one. NaN and infinities are numbers."""
    t = F.replace(clean(c), F.lit(","), F.lit(""))
    return F.when(t.rlike(_NUMBER), t.try_cast("double")).when(t.rlike(_NOT_FINITE), t.try_cast("double"))


def is_finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))  # NaN is above all numbers


def micromolar(value: Column, unit: Column | str) -> Column:
    """A positive finite value in micromolar; null for other values and for units without a factor."""
    u = F.upper(clean(unit))
    factor = F.lit(None).cast("double")
    for name, f in UNIT_TO_UM.items():
        factor = F.when(u == name, F.lit(f)).otherwise(factor)
    out = value * factor
    return F.when(is_finite(value) & (value > 0) & is_finite(out) & (out > 0), out)


def id_key(c: Column | str) -> Column:
    """Sort key of identifiers: whole numbers first by value, then text."""
    t = clean(c)
    n = F.when(t.rlike(r"^[+-]?\d{1,38}$"), t.try_cast("decimal(38,0)"))
    return F.struct(n.isNull().alias("text_last"), n.alias("number"), t.alias("text"))


def sorted_ids(c: Column | str) -> Column:
    """Aggregate: the distinct non-blank identifiers of a group, in the order of ``id_key``."""
    t = clean(c)
    keyed = F.array_sort(F.collect_set(F.when(t != "", id_key(t))))
    return F.transform(keyed, lambda k: k["text"])


def integer_prefix(c: Column | str) -> Column:
    """The whole number that text begins with, else 0."""
    return F.coalesce(F.regexp_extract(_col(c).cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def castable(c: Column | str, kind: str) -> Column:
    """Whether a value can become TEXT, INTEGER or REAL; blank values can."""
    t = clean(c)
    if kind == "TEXT":
        return F.lit(True)
    if kind == "INTEGER":
        return (t == "") | t.rlike(r"^[+-]?\d+$")
    if kind == "REAL":
        return (t == "") | (t.rlike(_NUMBER) & is_finite(t.try_cast("double")))
    raise ValueError(f"unknown type: {kind}")


def outcome_label(c: Column | str) -> Column:
    """``Active`` or ``Inactive`` for such an outcome in any case, else null."""
    low = F.lower(clean(c))
    out = F.lit(None).cast("string")
    for key, label in BINARY_OUTCOMES.items():
        out = F.when(low == key, F.lit(label)).otherwise(out)
    return out


def column_name(name: str) -> str:
    """A stripped header with underscores for spaces."""
    return str(name).strip().replace(" ", "_")


def result_column_name(name: str) -> str:
    """The same without colons, as property results are named."""
    return column_name(name).replace(":", "")


def activity_text(aid: Column, column: Column, value: Column, qualifier: Column, unit: Column, outcome: Column, standard_type: Column | None = None) -> Column:
    """``AID 1: IC50 > 5 NANOMOLAR (Active)``; a unit NONE and blank parts are left out."""
    label = column if standard_type is None else F.when(not_blank(standard_type), F.concat(column, F.lit(" ("), standard_type, F.lit(")"))).otherwise(column)
    some = lambda c: F.when(not_blank(c), c)
    known = F.when(not_blank(unit) & (F.upper(unit) != "NONE"), unit)
    return F.concat_ws(" ", F.concat(F.lit("AID "), aid, F.lit(": "), label), some(qualifier), value, known, F.when(not_blank(outcome), F.concat(F.lit("("), outcome, F.lit(")"))))


def packed_bits(bits: Column, n_words: int) -> list[Column]:
    """On-bit positions as 64-bit words, word k for bits 64k to 64k+63."""

    def word(k: int) -> Column:
        own = F.filter(F.array_distinct(bits), lambda b: (b >= 64 * k) & (b < 64 * (k + 1)))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b - 64 * k).cast("int"))))

    return [word(k) for k in range(n_words)]


def tanimoto(both: Column, a: Column, b: Column) -> Column:
    """Shared over joint bits from counts; NaN where neither side has a bit."""
    joint = a + b - both
    return F.when(joint == 0, F.lit(float("nan"))).otherwise(both.cast("double") / joint.cast("double"))
