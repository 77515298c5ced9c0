import pytest
from pyspark.sql import functions as F

from breathline.functions.numeric import half_up, quadrature, root_sum_of_squares, running_sum, sum_or_null
from breathline.functions.sql import window


@pytest.mark.parametrize(
    ("x", "digits", "expected"),
    [
        (1.005, 2, 1.01),
        (-0.285, 2, -0.29),
        (2.675, 2, 2.68),
        (84.5, 0, 85.0),
        (84.49, 0, 84.0),
        (0.4, 0, 0.0),
        (-2.5, 0, -3.0),
        (None, 2, None),
    ],
)
def test_half_up(spark, x, digits, expected):
    row = spark.createDataFrame([(x,)], "x DOUBLE").select(F.expr(half_up("x", digits))).first()
    assert row[0] == expected


def test_half_even_at_one_digit(spark):
    row = spark.sql("SELECT bround(6.25D, 1) a, bround(6.35D, 1) b").first()
    assert (row.a, row.b) == (6.2, 6.4)


def test_quadrature_needs_all_parts(spark):
    df = spark.createDataFrame([(3.0, 4.0), (3.0, None)], "a DOUBLE, b DOUBLE")
    assert [r[0] for r in df.select(F.expr(quadrature("a", "b"))).collect()] == [5.0, None]


def test_root_sum_of_squares_skips_unknown_and_is_zero_for_nothing(spark):
    df = spark.createDataFrame([(3.0,), (None,), (4.0,)], "e DOUBLE")
    total = F.expr(root_sum_of_squares("e"))
    assert df.agg(total).first()[0] == 5.0
    assert df.where("e IS NULL").agg(total).first()[0] == 0.0


def test_running_sum_stays_unknown_after_a_gap(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 5.0)], "year INT, x DOUBLE")
    over = window([], "year", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    assert [r[0] for r in df.select(F.expr(running_sum("x", over))).collect()] == [1.0, 3.0, None, None]


def test_sum_or_null(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x DOUBLE")
    total = F.expr(sum_or_null("x"))
    assert df.agg(total).first()[0] is None
    assert df.where("x = 1").agg(total).first()[0] == 1.0
    assert df.where("false").agg(total).first()[0] == 0.0
