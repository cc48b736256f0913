"""Drift from sketches: within the stated error of the exact figures, through a
stream and through merges."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import mlpipe as P
from quarry.plans import q_streaming
from quarry.sources.tables import table
from quarry.streaming import drift as G
from tests.conftest import SF001


def _exact(ref, cur):
    return P.ks_statistic(ref, cur, "value").first().ks


def test_small_windows_with_ties(spark):
    ref = spark.createDataFrame([(float(i % 7),) for i in range(50)], "value double")
    cur = spark.createDataFrame([(float(i % 5 + 3),) for i in range(30)], "value double")
    got = G.sketch_drift(
        cur.groupBy(F.lit("x").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", 512).alias("sketch")),
        G.reference_sketches(ref.withColumn("feature", F.lit("x")), 512)).first()
    assert got.n == 30 and got.ks == pytest.approx(_exact(ref, cur), abs=1 / G.POINTS)
    assert got.psi == pytest.approx(P.psi(ref, cur, "value").first().psi, abs=0.02)


def test_nulls_missing_references_and_empty_input(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 3.0)], "id int, a double, b double")
    v = G.feature_values(rows, {"a": F.col("a"), "b": F.col("b")}, ["id"])
    assert sorted(tuple(r) for r in v.collect()) == [(1, "b", 2.0), (2, "b", 3.0)]
    cur = v.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", 512).alias("sketch"))
    none = G.reference_sketches(v.filter("false"))
    assert [(r.feature, r.n, r.ks, r.psi) for r in G.sketch_drift(cur, none).collect()] == [("b", 2, None, None)]
    assert G.sketch_drift(cur.filter("false"), G.reference_sketches(v)).collect() == []


def test_large_samples_stay_within_the_stated_error(spark):
    n = 200_000
    ref = spark.range(n).select((F.randn(1) * 2).alias("value"))
    cur = spark.range(n).select((F.randn(2) * 2 + 0.3).alias("value"), F.pmod("id", F.lit(24)).alias("hour"))
    ref, cur = ref.cache(), cur.cache()
    hours = cur.withColumn("feature", F.lit("x")).groupBy("feature", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", G.SKETCH_K).alias("sketch"))
    got = G.sketch_drift(G.merge_sketches(hours, ["feature"]), G.reference_sketches(ref.withColumn("feature", F.lit("x")))).first()
    assert got.n == n and abs(got.ks - _exact(ref, cur)) <= G.ks_error()
    assert abs(got.psi - P.psi(ref, cur, "value").first().psi) < 0.01


def test_stream_equals_batch_by_day(spark):
    got = {(r.day, r.feature): r for r in q_streaming.stream_drift(spark, SF001).collect()}
    ev = table(spark, SF001, "events")
    cut = F.lit("2024-01-08").cast("timestamp_ntz")
    ref = ev.filter(F.col("ts") < cut)
    last = ev.agg(F.max("ts")).first()[0]
    assert {f for _, f in got} == {"value", "k"} and len(got) > 20
    for day in sorted({d for d, _ in got})[:3]:
        cur = ev.filter((F.date_format("ts", "yyyy-MM-dd") == day) & (F.col("ts") >= cut))
        assert got[day, "value"].n == cur.filter("value IS NOT NULL").count()
        assert abs(got[day, "value"].ks - _exact(ref, cur)) <= G.ks_error()
    assert max(d for d, _ in got) <= last.strftime("%Y-%m-%d")
