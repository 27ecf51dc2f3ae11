"""Student's t against its tables, and the band of a fit by hand."""

from __future__ import annotations

import math

import pytest

from zealmark.functions.student import incomplete_beta, t_quantile, t_share
from zealmark.operators.topics import fit_with_band

# Printed tables of Student's t, (degrees of freedom, share below, value)
TABLED = (
    (1, 0.975, 12.706205),
    (2, 0.975, 4.302653),
    (3, 0.95, 2.353363),
    (5, 0.995, 4.032143),
    (10, 0.975, 2.228139),
    (30, 0.9, 1.310415),
    (100, 0.975, 1.983972),
    (1000, 0.975, 1.962339),
)


@pytest.mark.parametrize("freedom, share, value", TABLED)
def test_tabled_quantiles(freedom, share, value):
    assert t_quantile(share, freedom) == pytest.approx(value, abs=1e-6)
    assert t_quantile(1 - share, freedom) == pytest.approx(-value, abs=1e-6)
    assert t_share(t_quantile(share, freedom), freedom) == pytest.approx(share, abs=1e-12)


def test_one_degree_is_the_cauchy_distribution():
    for share in (0.6, 0.9, 0.999, 0.9999999):
        assert t_quantile(share, 1) == pytest.approx(math.tan(math.pi * (share - 0.5)), rel=1e-9)


def test_many_degrees_come_near_the_normal_distribution():
    assert t_quantile(0.975, 10**7) == pytest.approx(1.959964, abs=1e-5)


def test_incomplete_beta_by_its_mirror():
    for a, b, x in ((0.5, 0.5, 0.3), (5.0, 0.5, 0.99), (50.0, 2.0, 0.9)):
        assert incomplete_beta(a, b, x) + incomplete_beta(b, a, 1 - x) == pytest.approx(1.0, abs=1e-13)
    assert incomplete_beta(2.0, 3.0, 0.0) == 0.0 and incomplete_beta(2.0, 3.0, 1.0) == 1.0


def test_band_by_hand(frame):
    xs, ys = [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 2.5, 4.5]
    df = frame([*zip(xs, ys), (None, 1.0), (9.0, None)], "x double, y double")
    got = fit_with_band(df, "x", "y", points=4).orderBy("point").collect()
    mean_x, mean_y = 1.5, 2.5
    sxx = sum((x - mean_x) ** 2 for x in xs)
    slope = sum((x - mean_x) * (y - mean_y) for x, y in zip(xs, ys)) / sxx
    start = mean_y - slope * mean_x
    residual = math.sqrt(sum((y - start - slope * x) ** 2 for x, y in zip(xs, ys)) / 2)
    for row, x in zip(got, xs):
        error = residual * math.sqrt(1 / 4 + (x - mean_x) ** 2 / sxx)
        assert (row.x, row.fitted, row.fitted_se) == pytest.approx((x, start + slope * x, error))
        assert (row.lower, row.upper) == pytest.approx((row.fitted - 4.302653 * error, row.fitted + 4.302653 * error), abs=1e-5)


def test_no_band_without_range_or_rows(frame):
    for rows in ([(1.0, 2.0), (3.0, 4.0)], [(1.0, 2.0), (1.0, 4.0), (1.0, 5.0)], []):
        assert fit_with_band(frame(rows, "x double, y double"), "x", "y").count() == 0
