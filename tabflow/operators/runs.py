"""Run comparison and search bookkeeping (L1-L7) over a long metrics table
``(run_id, metric_name, metric_value)`` and a trials table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators.models import LOSS_METRICS

# Preference order of shared metrics for choosing the best run; others follow by name.
METRIC_PREFERENCE = ("accuracy", "log_loss", "root_mean_squared_error", "r2", "rmse")


def compare_runs(metrics: DataFrame, run_ids: list[str] | None = None) -> DataFrame:
    """L1/L2: wide table ``run_id, metric…`` (one pivot, metric names from the
    data) restricted to ``run_ids`` with a ``missing`` report of unknown ids
    left to :func:`missing_runs`."""
    m = metrics if run_ids is None else metrics.where(F.col("run_id").isin(run_ids))
    return m.groupBy("run_id").pivot("metric_name").agg(F.first("metric_value"))


def missing_runs(metrics: DataFrame, run_ids: list[str]) -> DataFrame:
    """L2: requested ids that have no metrics (anti join against the run list)."""
    req = metrics.sparkSession.createDataFrame([(r,) for r in run_ids], "run_id string")
    return req.join(metrics.select("run_id").distinct(), "run_id", "left_anti")


def run_states(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """L2: ``run_id, state`` of the requested runs: ``missing``, ``not completed`` or
    ``completed``, from ``runs`` with a ``status`` column."""
    req = runs.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(run_ids)], "run_id string")
    state = F.when(F.col("known").isNull(), "missing").when(F.coalesce("status", F.lit("")) != "completed", "not completed")
    known = runs.select("run_id", "status", F.lit(True).alias("known"))
    return req.join(known, "run_id", "left").select("run_id", state.otherwise("completed").alias("state"))


def comparable_runs(runs: DataFrame, metrics: DataFrame, run_ids: list[str]) -> DataFrame:
    """L2: :func:`compare_runs` of requested runs; raises where one of them is missing
    or not completed, naming all such runs."""
    bad = run_states(runs, run_ids).where(F.col("state") != "completed").orderBy("run_id").collect()   # at most the request
    if bad:
        raise ValueError("; ".join(f"{r['run_id']}: {r['state']}" for r in bad))
    return compare_runs(metrics, run_ids)


def newest_first(runs: DataFrame, created_col: str = "created_at", id_col: str = "run_id", n: int | None = None) -> DataFrame:
    """Runs or experiments, the latest first (equal times by id); a page of them
    where ``n`` is given."""
    out = runs.orderBy(F.col(created_col).desc_nulls_last(), id_col)
    return out if n is None else out.limit(n)


def trials_in_order(trials: DataFrame, experiment, created_col: str = "created_at", id_col: str = "trial_id",
                    experiment_col: str = "experiment_id") -> DataFrame:
    """An experiment's trials in the order in which they were made."""
    return trials.where(F.col(experiment_col) == experiment).orderBy(F.col(created_col).asc_nulls_last(), id_col)


def shared_metric(metrics: DataFrame) -> DataFrame:
    """Metrics present for every run, in preference order: ``(metric_name, rank)``."""
    n = metrics.select("run_id").distinct().count()
    shared = metrics.groupBy("metric_name").agg(F.countDistinct("run_id").alias("k")).where(F.col("k") == n)
    pref = F.create_map(*[x for i, m in enumerate(METRIC_PREFERENCE) for x in (F.lit(m), F.lit(i))])
    return shared.select("metric_name", F.coalesce(pref[F.col("metric_name")], F.lit(len(METRIC_PREFERENCE))).alias("rank"))


def run_summary(metrics: DataFrame, leaderboards: DataFrame, features: DataFrame,
                run_ids: list[str] | None = None) -> DataFrame:
    """L1: ``run_id, n_metrics, best_model, best_score, feature_count`` per run.

    ``leaderboards``: ``(run_id, model, score_val)``, higher is better;
    ``features``: ``(run_id, column)``. A run without a leaderboard has no best
    model, one without a feature list no feature count; the first model by name
    wins a tie."""
    keep = lambda df: df if run_ids is None else df.where(F.col("run_id").isin(run_ids))
    top = keep(leaderboards).where(F.col("score_val").isNotNull()).groupBy("run_id").agg(F.max("score_val").alias("best_score"))
    named = (keep(leaderboards).join(top, "run_id").where(F.col("score_val") == F.col("best_score"))
             .groupBy("run_id").agg(F.min("model").alias("best_model"), F.first("best_score").alias("best_score")))
    runs = keep(metrics).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_metrics"))
    counts = keep(features).groupBy("run_id").agg(F.countDistinct("column").alias("feature_count"))
    return (runs.join(named, "run_id", "left").join(counts, "run_id", "left")
            .select("run_id", "n_metrics", "best_model", "best_score", "feature_count"))


def best_run(metrics: DataFrame, leaderboards: DataFrame | None = None) -> DataFrame:
    """The best run: ``(run_id, metric_name, metric_value)``. With
    ``leaderboards`` that hold any score, the run with the highest ``score_val``;
    else the best by the most preferred shared metric, honouring its direction
    (losses are lower-better). The largest run id wins a tie."""
    if leaderboards is not None:
        scored = leaderboards.where(F.col("score_val").isNotNull())
        if not scored.isEmpty():
            return scored.agg(F.max(F.struct("score_val", "run_id")).alias("b")).select(
                "b.run_id", F.lit("score_val").alias("metric_name"), F.col("b.score_val").alias("metric_value"))
    sm = shared_metric(metrics).orderBy("rank", "metric_name").limit(1)
    m = metrics.join(F.broadcast(sm.select("metric_name")), "metric_name")   # one metric name
    signed = F.when(F.col("metric_name").isin(*LOSS_METRICS), -F.col("metric_value")).otherwise(F.col("metric_value"))
    return m.agg(F.max_by(F.struct("run_id", "metric_name", "metric_value"), F.struct(signed, F.col("run_id"))).alias("b")) \
            .select("b.run_id", "b.metric_name", "b.metric_value")


def trial_progress(trials: DataFrame, order_col: str, score_col: str, higher_better: bool = True,
                   patience: int = 2) -> DataFrame:
    """L3: running best score in trial order, ``improved`` flag, trials since
    the last improvement and ``stop`` once that streak reaches ``patience``.
    The trials table has one row per candidate run (bounded by the search
    budget), so one ordered window over it is cheap."""
    s = F.col(score_col) if higher_better else -F.col(score_col)
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    wc = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    d = trials.withColumn("_s", s).withColumn("_prev", F.max("_s").over(w))
    d = d.withColumn("improved", F.col("_prev").isNull() | (F.col("_s") > F.col("_prev")))
    d = d.withColumn("_pos", F.row_number().over(Window.orderBy(order_col)))
    d = d.withColumn("_last", F.max(F.when(F.col("improved"), F.col("_pos"))).over(wc))
    best = F.max("_s").over(wc)
    d = d.withColumn("best_so_far", best if higher_better else -best)
    d = d.withColumn("since_improvement", (F.col("_pos") - F.col("_last")).cast("int"))
    return d.withColumn("stop", F.col("since_improvement") >= patience).drop("_s", "_prev", "_pos", "_last")
