import math

import numpy as np
import pytest

from liftgauge.functions.student_t import with_two_sided_p


def by_integration(t, v):
    """Two-sided tail of the t density by Gauss-Legendre over theta, where t = sqrt(v) tan(theta)."""
    nodes, weights = np.polynomial.legendre.leggauss(400)
    start, end = math.atan(abs(t) / math.sqrt(v)), math.pi / 2
    theta = (end - start) / 2 * nodes + (end + start) / 2
    logs = (v - 1) * np.log(np.cos(theta))
    scale = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
    return 2 * scale * (end - start) / 2 * float(np.sum(weights * np.exp(logs)))


CASES = [(t, v) for v in (1, 2, 3, 4, 5, 6, 29, 30, 91, 365, 999, 1000, 1001, 1002, 2500, 100_000, 1_000_000)
         for t in (0.0, 0.01, 0.7, -1.0, 1.96, 2.0, -2.5, 3.3, 6.0)]


def test_against_numeric_integration(spark):
    rows = spark.createDataFrame(CASES, "t double, v long")
    for r in with_two_sided_p(rows, "t", "v").collect():
        # The two lgamma of the integration's scale differ by far less than they are large, which costs it digits.
        assert r.p_value == pytest.approx(by_integration(r.t, r.v), abs=max(2e-10, r.v * 1e-15)), (r.t, r.v)
        assert r.t != 0 or r.p_value == 1


def test_known_value(spark):
    row = with_two_sided_p(spark.createDataFrame([(1.96, 30)], "t double, v long"), "t", "v").first()
    assert row.p_value == pytest.approx(0.0593, abs=1e-4)


def test_undefined_and_certain(spark):
    rows = spark.createDataFrame(
        [(1, None, 5), (2, float("nan"), 5), (3, 1.0, 0), (4, float("inf"), 5), (5, float("-inf"), 5), (6, 1.0, None)],
        "id int, t double, v long",
    )
    found = {r.id: r.p_value for r in with_two_sided_p(rows, "t", "v").collect()}
    assert found == {1: None, 2: None, 3: None, 4: 0.0, 5: 0.0, 6: None}
