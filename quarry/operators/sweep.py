"""Sequential hyperparameter sweep: proposals from the trials already scored, a
metric curve per trial from one pass over the validation rows, and bandit
stopping on these curves.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import mlpipe as P
from quarry.plans.sizing import shared_path

#: Trials drawn at random before proposals begin.
STARTUP_TRIALS = 8
#: Share of the trials that counts as good.
GOOD_SHARE = 0.25
#: Draws from the good trials' density, of which the best ratio is proposed.
CANDIDATES = 32
#: Trees between two points of a trial's curve.
CURVE_STEP = 10

TRIAL_SCHEMA = "trial_id int, n_estimators int, max_depth int, learning_rate double"


def _random_trial(space: dict, rng: random.Random) -> dict:
    return {k: rng.uniform(*v) if isinstance(v, tuple) else rng.choice(v) for k, v in space.items()}


def _log_density(space: dict, seen: list[dict], params: dict) -> float:
    """Log density of ``params`` under trials ``seen``, each parameter for
    itself: smoothed counts of a list's values; for a range, one normal bell
    a trial cut to the range, and the flat prior as one trial more."""
    total = 0.0
    for name, values in space.items():
        x = params[name]
        if isinstance(values, tuple):
            lo, hi = values
            width = (hi - lo) / (len(seen) + 1)
            dens = 1.0 / (hi - lo)
            for s in seen:
                inside = 0.5 * (math.erf((hi - s[name]) / width / math.sqrt(2)) - math.erf((lo - s[name]) / width / math.sqrt(2)))
                dens += math.exp(-0.5 * ((x - s[name]) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
            total += math.log(dens / (len(seen) + 1))
        else:
            hits = sum(1 for s in seen if s[name] == x)
            total += math.log((hits + 1.0 / len(values)) / (len(seen) + 1))
    return total


def _draw(space: dict, seen: list[dict], rng: random.Random) -> dict:
    """One draw from the density of ``seen`` (the prior counts as one trial)."""
    out = {}
    for name, values in space.items():
        k = rng.randrange(len(seen) + 1)
        if k == len(seen):
            out[name] = rng.uniform(*values) if isinstance(values, tuple) else rng.choice(values)
        elif isinstance(values, tuple):
            lo, hi = values
            width = (hi - lo) / (len(seen) + 1)
            x = rng.gauss(seen[k][name], width)
            while not lo <= x <= hi:
                x = rng.gauss(seen[k][name], width)
            out[name] = x
        else:
            out[name] = seen[k][name]
    return out


def propose(space: dict, history: list[tuple[dict, float]], n: int, rng: random.Random) -> list[dict]:
    """``n`` parameter sets by a tree-structured Parzen estimator: of draws from
    the density of the best quarter of ``history`` (params, score; higher is
    better), the one that the others' density explains least. A proposal of
    the same batch counts among the others until its score is known, so a
    batch spreads. Random while the history is short."""
    if len(history) < STARTUP_TRIALS:
        return [_random_trial(space, rng) for _ in range(n)]
    ranked = [p for p, _ in sorted(history, key=lambda h: -h[1])]
    cut = max(1, math.ceil(GOOD_SHARE * len(ranked)))
    good, others, out = ranked[:cut], list(ranked[cut:]), []
    for _ in range(n):
        draws = [_draw(space, good, rng) for _ in range(CANDIDATES)]
        best = max(draws, key=lambda d: _log_density(space, good, d) - _log_density(space, others, d))
        out.append(best)
        others.append(best)
    return out


def sequential_search(score_batch: Callable[[list[dict]], list[float]], space: dict, n_trials: int, batch: int,
                      seed: int) -> list[tuple[dict, float]]:
    """Trials in order, ``batch`` proposed at a time from all scored before."""
    rng, history = random.Random(seed), []
    while len(history) < n_trials:
        todo = propose(space, history, min(batch, n_trials - len(history)), rng)
        history += zip(todo, score_batch(todo))
    return history


def leaf_values(spark, model) -> list[list[float]]:
    """Weighted leaf values of each tree of a fitted gradient-boosted
    classifier, in the order of its leaf column (leaves from left to right).
    Read from the model as it is written: at most 2^depth numbers a tree,
    however many rows it was fitted on."""
    path = shared_path(spark, "trees")
    model.write().overwrite().save(path)
    leaves = (spark.read.parquet(f"{path}/data").filter("nodeData.leftChild < 0")
              .select("treeID", "nodeData.id", "nodeData.prediction").orderBy("treeID", "id").collect())
    out: list[list[float]] = [[] for _ in model.treeWeights]
    for r in leaves:
        out[r["treeID"]].append(r["prediction"] * model.treeWeights[r["treeID"]])
    return out


def staged_accuracy(fitted, rows: DataFrame, step: int = CURVE_STEP, label: str = "label") -> DataFrame:
    """P7's curve of one trial: (interval, n_trees, n, metric), the accuracy of
    the first ``step``, 2 x ``step``, ... trees of a fitted pipeline, the last
    interval being all trees. One pass: a row's leaf in every tree gives the
    sums of all prefixes, and a task sends one row an interval. Rows with a
    NULL label count as wrong; no rows give no intervals."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import vector_to_array

    spark = rows.sparkSession
    trees = leaf_values(spark, fitted.stages[-1])
    ends = sorted({*range(step, len(trees) + 1, step), len(trees)})
    width = max(map(len, trees))
    values = np.array([t + [0.0] * (width - len(t)) for t in trees])
    boosted = fitted.stages[-1].copy()
    boosted.setLeafCol("__leaf")
    prepared = rows
    for stage in fitted.stages[:-1]:
        prepared = stage.transform(prepared)
    leaves = boosted.transform(prepared).select(F.col(label).cast("int").alias("y"), vector_to_array("__leaf").alias("leaf"))

    def count(batches):
        right, n = np.zeros(len(ends), dtype=np.int64), 0
        for pdf in batches:
            if len(pdf):
                leaf = np.stack(pdf["leaf"].to_numpy()).astype(np.int64)
                sums = np.cumsum(values[np.arange(len(trees)), leaf], axis=1)[:, [e - 1 for e in ends]]
                y = pdf["y"].to_numpy(dtype="float64", na_value=np.nan)
                right += ((sums > 0) == (y == 1)[:, None])[~np.isnan(y)].sum(axis=0)
                n += len(pdf)
        if n:
            yield pd.DataFrame({"interval": range(1, len(ends) + 1), "n_trees": ends, "hits": right, "n": n})

    return (leaves.mapInPandas(count, "interval int, n_trees int, hits long, n long").groupBy("interval", "n_trees")
            .agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("metric")))


def run_sequential(split_df: DataFrame, space: dict | None = None, n_trials: int = P.SWEEP_TRIALS,
                   batch: int = P.SWEEP_CONCURRENT, seed: int = 42, step: int = CURVE_STEP) -> tuple[DataFrame, DataFrame]:
    """P6 with P7 inside: (trials, curves). Each batch of trials is proposed
    from the ones before, fitted on the train split (``batch`` fits at a time,
    each a distributed job) and scored in stages on the val split. The bandit
    rule then runs on all curves: a trial stops at the first checked interval
    where it falls too far behind the best so far. Boosted trees are fitted
    whole, so a stop saves no fit: it decides which score counts, the one
    where the trial stopped.

    trials: parameters, val_accuracy (at the stop, else of all trees),
    stopped_at (interval or NULL). curves: trial_id, interval, n_trees, n,
    metric, active (up to the stop). Both are as small as the sweep's plan:
    trials times intervals."""
    spark = split_df.sparkSession
    val = split_df.filter(F.col("split") == "val")
    curves: list[tuple] = []
    done = [0]

    def fit(numbered):
        trial, params = numbered
        points = staged_accuracy(P.train_gbt(split_df, **params), val, step).orderBy("interval").collect()
        return [(trial, r["interval"], r["n_trees"], r["n"], float(r["metric"])) for r in points]

    def score(todo):
        first = done[0]
        done[0] += len(todo)
        with ThreadPoolExecutor(max_workers=batch) as pool:
            found = list(pool.map(fit, enumerate(todo, first)))
        for points in found:
            curves.extend(points)
        return [points[-1][4] if points else 0.0 for points in found]

    history = sequential_search(score, space or P.SWEEP_SPACE, n_trials, batch, seed)
    trials = spark.createDataFrame(
        [(i, p["n_estimators"], p["max_depth"], float(p["learning_rate"])) for i, (p, _) in enumerate(history)], TRIAL_SCHEMA)
    curve = spark.createDataFrame(curves, "trial_id int, interval int, n_trees int, n long, metric double")
    stops = P.bandit_stop(curve).select("trial_id", "stopped_at")
    marked = curve.join(F.broadcast(stops), "trial_id").withColumn(  # trials, not rows
        "active", F.col("stopped_at").isNull() | (F.col("interval") <= F.col("stopped_at")))
    last = marked.filter("active").groupBy("trial_id").agg(F.max_by("metric", "interval").alias("val_accuracy"),
                                                           F.max("stopped_at").alias("stopped_at"))
    return trials.join(F.broadcast(last), "trial_id", "left"), marked.drop("stopped_at")
