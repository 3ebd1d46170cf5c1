"""What queries must not do at size, seen on the smallest tables."""

import bisect
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from panelyard import plans
from panelyard.operators import asof as A
from panelyard.operators import nulls as NU

SF = "/root/testdata/sf0.001"


def ran(df):
    """The plan as adaptive execution ran it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["n4_name_match", "n5_extra_stopwords"])
def test_names_are_not_broadcast(spark, name):
    """Cores and keys of names are far larger than the files that Spark's size check looks at."""
    assert "Broadcast" not in ran(plans.QUERIES[name](spark, SF))


def test_draws_are_equal_to_themselves(spark):
    """Sums of many rows come out a little different each time: here, at each reading. Of 20 draws, one is as far out as one in 20."""
    noise = F.udf(lambda v: v + int.from_bytes(os.urandom(4)) * 1e-18, "double").asNondeterministic()
    obs = spark.range(20).select(F.concat(F.lit("c"), "id").alias("cell"), F.lit(0.5).alias("value"))
    nulls = obs.join(spark.range(1, 21)).select("cell", F.lit("n").alias("null_name"), F.col("id").alias("draw"), noise(F.col("id") / 20).alias("value"))
    r = NU.family_chance(obs, nulls, 0.05).first()
    assert (r.n_cells, r.draws, r.expected, r.observed_clear) == (20, 20, 1.0, 0) and r.p_any == 0.05


def shuffled(spark, df):
    """How many rows go through shuffles until df is there, when no table is small enough to broadcast by itself."""
    stages = spark.sparkContext._jsc.sc().statusStore()
    rows = lambda: sum(s.shuffleWriteRecords() for s in _each(stages.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        before = rows()
        df().collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return rows() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.mark.parametrize("name", ["w10_quiet_band_without_events", "e6_path_between"])
def test_offsets_and_points_are_not_shuffled(spark, name):
    """Order lines go through two shuffles for the events and two as bars; no row per offset or point does."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shuffled(spark, lambda: plans.QUERIES[name](spark, SF)) < 5 * lines


def test_upto_and_beside(spark):
    day = lambda k: dt.date(2021, 3, 1) + dt.timedelta(k)
    dates = [day(k) for k in (0, 1, 4, 5, 9)]
    rows = spark.createDataFrame([(dates, day(k)) for k in range(-2, 12)] + [(dates, None), ([], day(0))], "dates array<date>, d date")
    got = rows.select("d", F.size("dates").alias("n"), A.upto(F.col("dates"), F.col("d")).alias("on"), A.upto(F.col("dates"), F.col("d"), before=True).alias("before")).collect()
    for r in got:
        held = dates if r.n else []
        assert (r.on, r.before) == ((None, None) if r.d is None else (bisect.bisect_right(held, r.d), bisect.bisect_left(held, r.d)))
    bench = spark.createDataFrame([(day(2), 5.0), (day(3), None), (day(6), 7.0), (day(8), 8.0)], "date date, close double")
    beside = A.beside(spark.createDataFrame([(day(k),) for k in range(12)], "date date"), bench).collect()
    assert {r.date: r.bench for r in beside} == {day(k): v for k, v in enumerate([None, None, 5.0, None, None, None, 7.0, 7.0, 8.0, 8.0, 8.0, 8.0])}
