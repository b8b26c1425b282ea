"""Sums by whole parts against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from liftgauge.functions.exact import exact_avg, exact_sum, parts, whole


@pytest.mark.parametrize("kind", ["cents", "wide", "cancelling", "integers", "tiny"])
def test_the_sum_is_the_exact_one_rounded_once(spark, kind):
    rng = random.Random(kind)
    values = {
        "cents": [rng.randint(-10**7, 10**7) / 100 for _ in range(3000)],
        "wide": [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 12) for _ in range(3000)],
        "cancelling": [x for _ in range(500) for y in [rng.random() * 1e9] for x in (y, -y, 0.1)],
        "integers": [float(rng.randint(-(2**52), 2**52)) for _ in range(50)],
        "tiny": [rng.random() * 2**-40 for _ in range(100)],
    }[kind]
    exact = sum(map(Fraction, values))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i long, x double")
    found = {frame.repartition(n, "i").agg(F.expr(exact_sum("x"))).first()[0] for n in (1, 3, 8)}
    assert len(found) == 1
    got = found.pop()
    if kind == "tiny":  # what lies below 2**-57 is cut off
        assert abs(Fraction(got) - exact) <= len(values) * Fraction(1, 2**57)
    else:
        assert got == float(exact)
    mean = frame.agg(F.expr(exact_avg("x"))).first()[0]
    assert mean == got / len(values)


def test_parts_add_up_without_error(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 2.0 ** rng.randint(-3, 58) for _ in range(2000)] + [0.0, -0.0, 0.1, -0.1, 2.0**58]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    rows = frame.select("x", *[F.expr(p).alias(f"p{i}") for i, p in enumerate(parts("x"))])
    for r in rows.withColumn("back", F.expr(whole("p0", "p1", "p2"))).collect():
        assert Fraction(r.p0, 2**4) + Fraction(r.p1, 2**30) + Fraction(r.p2, 2**56) == Fraction(r.x)
        assert r.back == r.x


def test_no_rows_filters_and_windows(spark):
    frame = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.3), (2, None)], "k int, x double")
    row = frame.agg(
        F.expr(exact_sum("x", "FILTER (WHERE k = 1)")).alias("one"), F.expr(exact_sum("x", "FILTER (WHERE k = 3)")).alias("none"),
        F.expr(exact_avg("x", "FILTER (WHERE k = 2)")).alias("mean")).first()
    assert row.one == float(Fraction(0.1) + Fraction(0.2)) and row.none is None and row.mean == 0.3
    over = frame.select(F.expr(exact_sum("x", "OVER (PARTITION BY k)")).alias("s")).collect()
    assert sorted(r.s for r in over) == [0.3, 0.3, row.one, row.one]


def test_a_number_out_of_range_fails_instead_of_wrapping(spark):
    for x in (2.0**60, math.inf, math.nan):
        with pytest.raises(Exception, match="OVERFLOW|CAST"):
            spark.createDataFrame([(x,)], "x double").agg(F.expr(exact_sum("x"))).collect()
