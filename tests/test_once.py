"""Rules whose arguments are costly work them out once, however often they use them."""

import pytest
from pyspark.sql import functions as F

from rawframe.functions import frames
from rawframe.operators import tables


def _times(spark, rule):
    """How often a plan of the rule works out its argument, a root."""
    rows = spark.range(3).select(rule(F.sqrt(F.col("id") * 7 + 2)).alias("r"))
    assert rows.count() == 3
    return rows._jdf.queryExecution().optimizedPlan().toString().count("SQRT(")


def _array(x, n):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (x.cast("int") + i) % 4)


def test_black_patterns(spark):
    number = lambda x: x.cast("bigint") % 3
    four = F.array(*[F.lit(x) for x in (0, 1, 1, 2)])
    made = lambda x: frames.black_pattern(x, F.array(*[F.lit(3.0)] * 4), four, F.lit(2), F.lit(2), F.array(*[F.lit(float(i)) for i in range(6)]), F.col("id") % 3, F.col("id") % 4)
    assert _times(spark, made) == 1
    assert _times(spark, lambda x: frames.lcm(number(x), F.lit(6))) == _times(spark, lambda x: frames.gcd(number(x), F.lit(6))) == 1


@pytest.mark.parametrize("a, b", [(0, 0), (0, 9), (9, 0), (-12, 18), (7, 7), (1134903170, 1836311903), (4660046610375530309, 7540113804746346429), (2**62, 2**61), (None, 4), (4, None)])
def test_divisors_of_any_numbers(spark, a, b):
    """Neighbours among Fibonacci's numbers take the most steps."""
    import math

    long = lambda v: F.lit(v).cast("bigint")
    want = None if a is None or b is None else math.gcd(a, b)
    assert spark.range(1).select(frames.gcd(long(a), long(b)), frames.gcd(long(b), long(a))).first() == (want, want)


def test_filter_periods(spark):
    assert _times(spark, lambda x: frames.cfa_rows(_array(x, 16))) == 1


def test_filter_patterns(spark):
    assert _times(spark, lambda x: frames.filter_pattern(_array(x, 16), F.lit("RGBG"), F.lit(3), F.lit(False))) == 1


def test_rationals(spark):
    assert _times(spark, tables.signed_rational) == _times(spark, tables.rational) == 1


def test_bytes_in_the_other_order(spark):
    assert _times(spark, lambda x: frames.swapped(x.cast("string").cast("binary"), F.lit(4))) == 1
