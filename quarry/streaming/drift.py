"""P10 and P11 on a stream: a mergeable quantile sketch per feature and window is
the state; drift is read off sketches, not off rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.sizing import broadcast_if_bounded

#: Size of a sketch: about three times as many doubles, whatever the rows.
SKETCH_K = 4096
#: Quantiles that a sketch is read at.
POINTS = 1000
#: A share of no rows counts as this much.
EPS = 1e-6


def rank_error(k: int = SKETCH_K) -> float:
    """Error of a sketch's rank at 99% confidence (fixed values of the sketch's
    published error table)."""
    return 2.296 / k ** 0.9723


def ks_error(k: int = SKETCH_K, points: int = POINTS) -> float:
    """How far ``ks`` of two sketches may be from that of all rows: the rank
    errors of both, and one step between quantiles (the steps' own errors have
    one sign, so they don't add up)."""
    return 2 * rank_error(k) + 1 / points


def feature_values(df: DataFrame, features: dict[str, Column], keep: list[str]) -> DataFrame:
    """Long form: ``keep``, feature, value (rows without a value or with NaN left out)."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in features.items()])
    return df.select(*keep, F.inline(rows)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def reference_sketches(values: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(feature, ref): one sketch a feature over a batch table."""
    return values.groupBy("feature").agg(F.kll_sketch_agg_double("value", k).alias("ref"))


def window_sketches(values: DataFrame, size: str = "1 hour", delay: str = "1 hour", ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """(w, feature, n, sketch): streaming or batch. The state of an open window is
    its sketch; tasks sketch their rows before the shuffle, so a hot feature is
    one small row a task."""
    v = values.withColumn(ts, F.col(ts).cast("timestamp"))
    if values.isStreaming:
        v = v.withWatermark(ts, delay)
    return v.groupBy(F.window(ts, size).alias("w"), "feature").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of small windows to those of larger groups: (by, n, sketch)."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_drift(current: DataFrame, reference: DataFrame, bins: int = 10, points: int = POINTS) -> DataFrame:
    """``current`` (..., feature, n, sketch) against ``reference`` (feature, ref):
    its columns but the sketch, with ks and psi. Features without a reference
    get NULL.

    Either sketch is read at ``points`` quantiles; the share of these up to a
    value is its distribution there. ks walks both lists once in value order
    and is within ``ks_error`` of the exact one. psi bins by the reference's
    quantiles; a bin of no points counts as ``EPS``, so in windows of more than
    ``points`` rows a bin of fewer than one in ``points`` may look empty. Row-local
    but for the join."""
    ranks = F.array(*[F.lit(i / points) for i in range(1, points + 1)])
    joined = current.join(broadcast_if_bounded(reference), "feature", "left")
    both = joined.withColumn("__r", F.kll_sketch_get_quantile_double("ref", ranks)) \
        .withColumn("__c", F.kll_sketch_get_quantile_double("sketch", ranks))

    def marked(name: str, ref: int) -> Column:
        return F.transform(name, lambda x: F.struct(x.alias("x"), F.lit(ref).alias("r")))

    def step(s: Column, e: Column) -> Column:
        gap = F.when(e["x"] != s["x"], F.abs(s["gap"])).otherwise(F.lit(0))   # ties are taken together
        return F.struct((s["gap"] + e["r"]).alias("gap"), e["x"].alias("x"), F.greatest(s["most"], gap).alias("most"))

    start = F.struct(F.lit(0).alias("gap"), F.lit(0.0).alias("x"), F.lit(0).alias("most"))
    ks = F.aggregate(F.sort_array(F.concat(marked("__r", 1), marked("__c", -1))), start, step, lambda s: s["most"] / F.lit(float(points)))

    def upto(name: str, edge: int) -> Column:
        if edge in (0, bins):
            return F.lit(edge / bins)
        cut = F.get("__r", max(0, -(-points * edge // bins) - 1))
        return F.size(F.filter(name, lambda x: x <= cut)) / F.lit(float(points))

    psi = F.lit(0.0)
    for i in range(bins):
        r, c = (F.greatest(F.lit(EPS), upto(side, i + 1) - upto(side, i)) for side in ("__r", "__c"))
        psi = psi + (c - r) * F.log(c / r)
    keep = [c for c in current.columns if c != "sketch"]
    known = F.col("ref").isNotNull()
    return both.select(*keep, F.when(known, ks).alias("ks"), F.when(known, psi).alias("psi"))
