"""Two-sided p-values of Student's t in plain SQL arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The quadrature's spacing and its first and last node; see `_tail_area`.
STEP = 0.0625
FIRST_NODE, LAST_NODE = -72, 64


def with_two_sided_p(tests: DataFrame, t: str, df: str, name: str = "p_value") -> DataFrame:
    """Add P(|T| > |t|) for one degree of freedom or more; null where the test is undefined.

    With t = sqrt(v) sinh(y / sqrt(v)) the density in y is a power of the hyperbolic secant, for every v: it falls
    at least as fast as exp(-y) and at most as fast as the normal density. The p-value is the area beyond
    y over the area beyond 0, so no gamma function is needed.
    """
    return (
        tests.withColumn("_size", F.expr(f"abs({t})"))
        .withColumn("_v", F.expr(f"if({df} >= 1, double({df}), null)"))
        .withColumn("_y", F.expr("sqrt(_v) * asinh(_size / sqrt(_v))"))
        .withColumn(name, F.expr(f"""
            CASE WHEN _size IS NULL OR isnan(_size) OR _v IS NULL THEN NULL
                 WHEN _size = double('Infinity') THEN 0D
                 ELSE greatest(0D, least(1D, {_tail_area("_y")} / {_tail_area("0D")}))
            END"""))
        .drop("_size", "_v", "_y")
    )


def _tail_area(start: str) -> str:
    """The integral of sech(y / sqrt(v)) ** v from `start` on.

    The trapezoidal rule after the substitution y = start + exp(z - exp(-z)), which is exact to rounding for
    integrands that fall exponentially. The nodes are the same for all v.
    """
    z, x = f"(k * {STEP}D)", "node.x"
    nodes = f"""transform(sequence({FIRST_NODE}, {LAST_NODE}), k -> named_struct(
        'x', exp({z} - exp(-{z})), 'weight', (1 + exp(-{z})) * exp({z} - exp(-{z}))))"""
    root = f"sinh(({start} + {x}) / sqrt(_v))"
    return f"aggregate({nodes}, 0D, (area, node) -> area + node.weight * exp(-_v / 2 * log1p({root} * {root})))"
