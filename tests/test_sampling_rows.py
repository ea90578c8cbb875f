"""Signs of the boundary in absolute gradients, and points that can't be told apart."""

import pytest

from fieldloom.meta import Field
from fieldloom.operators import sampling as sp


@pytest.fixture
def field(spark):
    return Field(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "x int, v double"), {"x": 3})


def test_sign_is_kept_where_the_weight_is_zero(spark, field):
    points = sp.Points(spark.createDataFrame([(1, -2.0), (2, 0.5)], "q int, l double"), ["q"], ["l"])
    found = {r.q: r.v_x for r in sp.grad(field, points, 1, "dst2", absolute=True).collect()}
    # at -2 the taps read -2 and -1, which hold -2 and -1 with the boundary's sign
    assert found == {1: -3.0, 2: 3.0}


def test_points_with_the_same_ids(spark, field):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 9.0)], "q int, l double")
    points = sp.Points(df, ["q"], ["l"])
    for ask in (sp.pull, sp.grad, sp.hess):
        with pytest.raises(Exception, match="same ids"):
            ask(field, points, 1, "zero").collect()
    numbered = sp.Points.numbered(df, ["l"])
    assert sorted(r.v for r in sp.pull(field, numbered, 1, "zero").collect()) == [0.0, 2.0, 2.0]
    assert sum(r.n for r in sp.count(points, field.axes, 1, "dft").df.collect()) == 3.0
