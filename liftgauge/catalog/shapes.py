"""How the columns of a registered query are shown, on Spark and in the checking SQL alike.

A shape maps each column to "i" (whole number), "s" (text), "d" (day) or the number of decimals of a
floating-point column. Both sides add up exactly, so a rounding in one step, half to even, falls alike.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.params import quoted

Shape = Mapping[str, str | int]


def shown(df: DataFrame, shape: Shape) -> DataFrame:
    def column(name, kind):
        text = quoted(name)
        if kind == "i":
            return f"bigint({text})"
        if kind == "s":
            return f"string({text})"
        if kind == "d":
            return f"date_format({text}, 'yyyy-MM-dd')"
        return f"rint(double({text}) * 1e{kind}D) / 1e{kind}D + 0D"

    return df.select(*[F.expr(column(n, k)).alias(n) for n, k in shape.items()])


def shown_sql(sql: str, shape: Shape) -> str:
    """`sql` is a query, with or without a WITH clause."""
    def column(name, kind):
        if kind == "i":
            return f'CAST("{name}" AS BIGINT) AS "{name}"'
        if kind == "s":
            return f'CAST("{name}" AS VARCHAR) AS "{name}"'
        if kind == "d":
            return f"""strftime(CAST("{name}" AS DATE), '%Y-%m-%d') AS "{name}\""""
        return f'round_even(CAST("{name}" AS DOUBLE) * 1e{kind}, 0) / 1e{kind} + 0e0 AS "{name}"'

    columns = ", ".join(column(n, k) for n, k in shape.items())
    return f"SELECT {columns} FROM ({sql}) AS answer"
