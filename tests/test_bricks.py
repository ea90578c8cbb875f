"""Bricks of any size give the same results, shuffle little, and refuse fields that aren't dense."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.meta import Field
from fieldloom.operators import bricks, solvers, stencils as st

BOUNDS = ("zero", "replicate", "dct1", "dct2", "dst1", "dst2", "dft", "nocheck")


def table(spark, axes, batches=("a", None)):
    rng = random.Random(3)
    rows = [(b, *at, float(rng.randint(-9, 9)), float(rng.randint(-9, 9)), float(rng.randint(-9, 9)), float(rng.randint(1, 4)), rng.random()) for b in batches for at in itertools.product(*map(range, axes.values()))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, ", ".join(["b string", *[f"{a} int" for a in axes], "u double", "v double", "t double", "w double", "h double"])).repartition(3)


def rows_of(field):
    return sorted((str(r.b), *[r[a] for a in field.axes], *[round(r[c], 9) for c in field.channels]) for r in field.df.collect())


@pytest.mark.parametrize("bound", BOUNDS)
def test_small_bricks_equal_one_brick(spark, monkeypatch, bound):
    cases = []
    for axes, channels in (({"x": 23}, ["u"]), ({"y": 9, "x": 7}, ["u", "v"]), ({"z": 5, "y": 7, "x": 4}, ["u", "v", "t"])):
        n = len(axes)
        field = Field(table(spark, axes), axes, channels, ("b",))
        cases += [lambda f=field, n=n: st.matvec(f, st.flow_penalties(n, 1.0, 0.5, 2.0, 2.0, 1.0, [1.0, 2.0, 0.5][:n]), bound)]
        cases += [lambda f=field, n=n: st.matvec_rls(f, st.field_penalties(n, n, 1.0, 0.5, 2.0), ["w"], bound)]
    whole = [rows_of(c()) for c in cases]
    monkeypatch.setattr(bricks, "SIZES", {1: 11, 2: 4, 3: 3})
    assert [rows_of(c()) for c in cases] == whole


def test_relaxation_on_small_bricks(spark, monkeypatch):
    axes = {"y": 6, "x": 9}
    field = Field(table(spark, axes, ("a",)), axes, ["u", "v"], ("b",))
    p = st.flow_penalties(2, 1.0, 0.5, 0.0, 1.0, 0.5)
    whole = rows_of(solvers.relax(field, p, ["t", "w"], None, "dft", 1))
    monkeypatch.setattr(bricks, "SIZES", {1: 5, 2: 4, 3: 3})
    assert rows_of(solvers.relax(field, p, ["t", "w"], None, "dft", 1)) == whole


def test_shuffle_is_the_field_and_its_halo(spark):
    axes = {"z": 64, "y": 64, "x": 64}
    voxels = spark.range(64**3).select(F.lit("a").alias("b"), (F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("_yz"), F.col("id").cast("double").alias("u"))
    df = voxels.select("b", (F.col("_yz") / 64).cast("int").alias("z"), (F.col("_yz") % 64).alias("y"), "x", "u")
    sent = df
    for a, n in axes.items():
        sent = sent.withColumn("k", F.explode(bricks._bricks_of(F.col(a), n, 32, 2, bricks.Bound.DCT2))).drop("k")
    assert sent.count() < 1.5 * 64**3
    field = st.matvec(Field(df, axes, ["u"], ("b",)), st.field_penalties(3, 1, 0.0, 0.0, 1.0), "dct2")
    plan = field.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and field.df.count() == 64**3


def test_fields_that_are_not_dense_are_refused(spark):
    axes = {"y": 4, "x": 5}
    df = table(spark, axes)
    for bad in (df.where("not (b = 'a' and x = 2 and y = 3)"), df.unionByName(df.where("x = 0 and y = 0"))):
        with pytest.raises(Exception, match="each voxel"):
            st.matvec(Field(bad, axes, ["u"], ("b",)), st.field_penalties(2, 1, 1.0, 1.0), "dct2").df.collect()
    assert st.matvec(Field(df.limit(0), axes, ["u"], ("b",)), st.field_penalties(2, 1, 1.0, 1.0), "dct2").df.count() == 0
