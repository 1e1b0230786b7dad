import pytest
from pyspark.sql import functions as F

from assayframe.functions import text


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_clean_strips_all_white_space(spark):
    assert values(spark, [None, "", " \t a b\n", " x "], text.clean) == ["", "", "a b", "x"]


def test_compound_ids(spark):
    given = ["1", "00123", "123.0", "123.4", "0", "-1", "bad", None, " 7 ", "1E3", "1.00000000001", "9223372036854775807", "9223372036854775808", "+5", "", "12."]
    assert values(spark, given, text.compound_id) == ["1", "123", "123", None, None, None, None, None, "7", "1000", None, "9223372036854775807", None, "5", None, "12"]


def test_numbers(spark):
    got = values(spark, ["1,234.5", " 12 ", "12d", "1e3", "", None, "abc", "-.5", "nan", "1_000"], text.number)
    assert got[:8] == [1234.5, 12.0, None, 1000.0, None, None, None, -0.5]
    assert got[8] != got[8] and got[9] is None


@pytest.mark.parametrize(("value", "unit", "expected"), [(100.0, "NANOMOLAR", 0.1), (2.0, " micromolar ", 2.0), (0.0, "MICROMOLAR", None), (-1.0, "MICROMOLAR", None), (float("nan"), "MICROMOLAR", None), (float("inf"), "NANOMOLAR", None), (1.0, "PERCENT", None), (None, "MICROMOLAR", None)])
def test_micromolar(spark, value, unit, expected):
    got = spark.createDataFrame([(value, unit)], "v double, u string").select(text.micromolar(F.col("v"), "u")).first()[0]
    assert got == pytest.approx(expected) if expected is not None else got is None


def test_identifiers_sort_numbers_first(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "10", "9", "a", "", None, "9"]], "v string")
    assert df.agg(text.sorted_ids("v").alias("s")).first().s == ["9", "10", "a", "b"]


def test_castability(spark):
    given = ["", " 5 ", "5.5", "x", "1e400", None, "-7"]
    assert values(spark, given, lambda c: text.castable(c, "INTEGER")) == [True, True, False, False, False, True, True]
    assert values(spark, given, lambda c: text.castable(c, "REAL")) == [True, True, True, False, False, True, True]


def test_integer_prefix(spark):
    assert values(spark, ["12abc", "abc", " -4", None, "99999999999999999999"], text.integer_prefix) == [12, 0, -4, 0, 0]


def test_packed_words_and_tanimoto(spark):
    df = spark.createDataFrame([([0, 3, 64, 64, 127],)], "b array<int>")
    words = df.select(*text.packed_bits(F.col("b"), 2)).first()
    assert [w & (1 << 64) - 1 for w in words] == [0b1001, 1 | 1 << 63]
    got = spark.range(1).select(text.tanimoto(F.lit(2), F.lit(3), F.lit(3)), text.tanimoto(F.lit(0), F.lit(0), F.lit(0))).first()
    assert got[0] == 0.5 and got[1] != got[1]
