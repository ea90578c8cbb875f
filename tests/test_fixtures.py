"""Fixtures hold all rows of the tables that they are made of."""

import os

import pytest
from pyspark.sql import functions as F

from fieldloom.plans import fixtures

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables here")


def test_points_2d_are_all_orders_over_all_images(spark):
    points, image = fixtures.table(spark, SF, "p2"), fixtures.table(spark, SF, "f2")
    assert points.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    images = {r.b for r in image.select("b").distinct().collect()}
    assert {r.b for r in points.select("b").distinct().collect()} == images and dict(points.dtypes)["b"] == dict(image.dtypes)["b"]


def test_mask_has_all_users(spark, tmp_path):
    events = spark.range(9600).selectExpr("id as event_id", "id div 64 as user_id", "if(id % 5 = 0, 'error', 'view') as event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    mask = fixtures.table(spark, str(tmp_path), "mask")
    assert mask.groupBy("b").agg(F.count("*").alias("n")).where("n = 64").count() == 150
