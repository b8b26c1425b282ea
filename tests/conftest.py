from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from liftgauge.params import Metrics  # noqa: E402
from liftgauge.session import local_session  # noqa: E402

LINE = (
    "CustomerID long, Transaction_ID string, Transaction_Date date, Product_Category string, "
    "Quantity double, Avg_Price double, Coupon_Status string"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    # Plans are read in full, however long the names in them have grown.
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def metrics():
    return Metrics()


@pytest.fixture
def sales(spark):
    """Build sales lines from (customer, transaction, day, category, quantity, price, coupon) tuples."""
    def build(lines):
        return spark.createDataFrame([(c, t, date.fromisoformat(d), *rest) for c, t, d, *rest in lines], LINE)

    return build


@pytest.fixture
def purchases(sales):
    """One line per (customer, day) or (customer, day, quantity, coupon)."""
    def build(items):
        lines = []
        for i, item in enumerate(items):
            customer, day, quantity, coupon = (*item, 1.0, "Not Used")[:4] if len(item) < 4 else item
            lines.append((customer, f"t{i}", day, "Apparel", float(quantity), 10.0, coupon))
        return sales(lines)

    return build


@pytest.fixture
def initiatives(spark):
    def build(*customers):
        return spark.createDataFrame([(c, "BuyOneGetOne") for c in customers], "CustomerID long, Initiative string")

    return build


def as_dicts(df, *keys):
    """Rows as dicts, by key."""
    rows = [r.asDict() for r in df.collect()]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
