"""Windows over tracks cut into ranges give the same rows as over whole tracks."""

import random

import pytest
from pyspark.sql import functions as F

from subweave.operators import timing


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_ranges_give_the_same_rows(spark, ranges):
    r = random.Random(ranges)
    rows = []
    for t in ("a", "b", "c"):
        at, k = 0.0, r.choice([0, 2])
        for _ in range({"a": 40, "b": 1, "c": 9}[t]):
            end = at + r.choice([0, 300, 1500, 4000])
            rows.append((t, k, None if r.random() < 0.05 else at, None if r.random() < 0.05 else end, "x"))
            at, k = end + r.choice([-100, 0, 50, 1200, 1300]), k + r.choice([1, 1, 1, 2, 9])
    cues = spark.createDataFrame(rows, "track_id string, cue_index int, start_ms double, end_ms double, text string").repartition(3)
    for step in (timing.truncate_overlap, timing.optimize_timing, timing.clamp_overlap, timing.number_cues, timing.cue_gaps, lambda c, ranges=None: timing.gap_runs(c, 1200, ranges)):
        whole, cut = step(cues), step(cues, ranges=ranges)
        assert sorted(map(str, cut.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
        assert cut.schema[whole.columns[-1]].dataType == whole.schema[whole.columns[-1]].dataType
    assert timing.gap_runs(cues.limit(0), 1200, ranges).count() == 0


def test_a_hot_track_is_worked_on_by_many_tasks(spark):
    hot = spark.range(200_000).select(F.lit("one").alias("track_id"), F.col("id").cast("int").alias("cue_index"), (F.col("id") * 1000.0).alias("start_ms"), (F.col("id") * 1000.0 + F.when(F.col("id") % 5 == 0, 100).otherwise(900)).alias("end_ms"), F.lit("x").alias("text"))
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = lambda d: d.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task"), F.max("run_id")).first()
        assert tuple(tasks(timing.gap_runs(hot, 500, ranges=10_000))) == (4, 40_000)
        assert tuple(tasks(timing.gap_runs(hot, 500))) == (1, 40_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
