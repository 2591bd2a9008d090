import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from armlens.functions.numeric import exact_round, half_even, not_nan, ratio


def test_half_even_follows_report_rounding(spark):
    # Means that look like ties; the table shows 34.36 and 46.9.
    df = spark.createDataFrame([(34.365,), (46.895,), (2.5,), (None,)], "x double")
    got = [r[0] for r in df.select(half_even("x", 2)).collect()]
    assert got == [34.36, 46.9, 2.5, None]


def test_exact_round_equals_python(spark):
    values = [2.675, 1.005, 0.125, 1234.565, 1e-9, 0.0, 99999.995, 5.015, 1.115, 2.5, 3.5, 0.285]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 4, 8):
        got = [r[0] for r in df.select(exact_round("x", digits)).collect()]
        assert got == [round(v, digits) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=200, max_size=400))
def test_exact_round_on_apparent_ties(spark, whole):
    # Microseconds to milliseconds: every tenth value ends in a 5.
    values = [n / 1e6 * 1000 for n in whole]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(exact_round("x", 2)).collect()]
    assert got == [round(v, 2) for v in values]


def test_ratio_and_nan(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (math.nan, 1.0)], "a double, b double")
    assert [r[0] for r in df.limit(3).select(ratio("a", "b")).collect()] == [None, None, 0.25]
    assert [r[0] for r in df.select(not_nan("a")).collect()] == [1.0, 0.0, 1.0, None]


def test_mean_skips_nan_after_cleaning(spark):
    df = spark.createDataFrame([(math.nan,), (2.0,), (4.0,), (None,)], "a double")
    assert df.agg(F.avg(not_nan("a"))).first()[0] == 3.0
