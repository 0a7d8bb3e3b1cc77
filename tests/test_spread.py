"""Steps that keep a task's share of the rows when Spark would merge partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelyard.plans import play_queries
from panelyard.plans.registry import Tables

SF = "/root/testdata/sf0.001"
PARTS = 48


@pytest.fixture
def many(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", PARTS)
    yield Tables(spark, SF)
    spark.conf.set("spark.sql.shuffle.partitions", was)


def parts_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_plays_of_a_game_stay_in_one_of_all_partitions(many):
    p = play_queries.plays(many)
    assert parts_with_rows(p) > PARTS * 3 // 4
    assert p.select("game_id", F.spark_partition_id().alias("p")).distinct().groupBy("game_id").count().where("count > 1").isEmpty()
