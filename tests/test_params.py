from datetime import date

import pytest

from liftgauge.catalog.setting import PERIODS
from liftgauge.params import Cohort, Metrics, Periods


def test_lengths_count_both_ends():
    assert PERIODS["main"].pre.days == 365
    assert PERIODS["main"].post.days == 366


def test_longer_post_period_is_cut_for_recency():
    pre, post = PERIODS["post_long"].recency
    assert (pre.start, pre.end) == (date(1995, 1, 1), date(1995, 6, 30))
    assert (post.start, post.end) == (date(1995, 7, 1), date(1995, 12, 29))


def test_longer_pre_period_is_cut_for_recency():
    pre, post = PERIODS["pre_long"].recency
    assert (pre.start, pre.end) == (date(1996, 7, 3), date(1996, 12, 31))
    assert (post.start, post.end) == (date(1997, 1, 1), date(1997, 6, 30))


def test_equal_periods_start_the_pre_window_a_day_early():
    pre, _ = PERIODS["equal"].recency
    assert pre.start == date(1996, 12, 31)
    assert PERIODS["equal"].span.start == date(1996, 12, 31)


def test_lookback_is_one_day_longer_than_pre():
    assert PERIODS["main"].lookback.days == 366


def test_around_switch():
    near = PERIODS["main"].around_switch()
    assert (near.pre_ini, near.pre_end) == (date(1995, 11, 27), date(1995, 12, 31))
    assert (near.post_ini, near.post_end) == (date(1996, 1, 1), date(1996, 2, 4))


def test_bad_input_is_refused():
    with pytest.raises(ValueError):
        Periods.of("2020-02-01", "2020-01-01", "2020-03-01", "2020-04-01")
    with pytest.raises(ValueError):
        Cohort("Sometimes")
    with pytest.raises(ValueError):
        Metrics(("Other",))


def test_metric_names():
    m = Metrics()
    assert len(m.all) == 14
    assert len(m.report_order) == 22
    assert "Sales_Nest-USA" in m.all
