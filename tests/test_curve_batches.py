"""Many curves by a shuffle give what few curves give."""

import random

import pytest

from fieldloom.operators import curves


def test_co_grouped_curves_equal_shared_ones(spark, monkeypatch):
    rng = random.Random(1)
    coeff = spark.createDataFrame([(b, k, rng.random() * 9, rng.random() * 9) for b in "abc" for k in range(7)], "b string, k int, p0 double, p1 double")
    points = spark.createDataFrame([(i, rng.choice("abcd"), rng.random() * 9, rng.random() * 9) for i in range(300)], "q int, b string, px double, py double")

    def found():
        seed = curves.dt_spline_table(points, coeff, ("px", "py"), [k / 4 for k in range(25)], batch=("b",))
        done = curves.dt_spline_gaussnewton(seed, coeff, ("px", "py"), batch=("b",))
        return sorted((r.q, r.b, round(r.time, 9), round(r.dist, 9)) for r in done.collect())

    few = found()
    monkeypatch.setattr(curves, "MAX_CONTROL_POINTS", 10)
    assert found() == few
    monkeypatch.setattr(curves, "MAX_OF_A_CURVE", 5)
    with pytest.raises(ValueError):
        curves.dt_spline_table(points, coeff, ("px", "py"), [0.0], batch=("b",))
    with pytest.raises(ValueError):
        curves.dt_spline_table(points, coeff, ("px", "py"), [0.0])
