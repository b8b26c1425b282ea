"""What the registered queries measure on the given tables."""

from __future__ import annotations

from liftgauge.params import ALL, CONTROL, NO_INITIATIVE, TEST, Cohort, Metrics, Periods

METRICS = Metrics(("PROMO", "ECONOMY"))

PERIODS = {
    "main": Periods.of("1995-01-01", "1995-12-31", "1996-01-01", "1996-12-31"),
    "equal": Periods.of("1997-01-01", "1997-12-31", "1998-01-01", "1998-12-31"),
    "post_long": Periods.of("1995-01-01", "1995-06-30", "1995-07-01", "1996-06-30"),
    "pre_long": Periods.of("1996-01-01", "1996-12-31", "1997-01-01", "1997-06-30"),
}

ARMS = {TEST: Cohort(ALL, "BuyOneGetOne"), CONTROL: Cohort("NoPromo", NO_INITIATIVE)}

# One arm for each way of using the wildcard.
WILDCARD_ARMS = {
    "everyone": Cohort(),
    "by_promo": Cohort("PromoPre", ALL),
    "by_initiative": Cohort(ALL, "BuyOneGetOne"),
    "by_both": Cohort("Promo", NO_INITIATIVE),
}
