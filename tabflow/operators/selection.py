"""Model selection around the trainer: validation inside training (H3), stacking (H4)
and the trial loop (L3).

One fold column drives everything. For every fold the preprocessor is refitted on the
other folds' raw rows, so neither fills nor target encodings have seen the rows that
they are judged on; folds and families are one pool of jobs that share the cluster,
and the leaderboard is the metric of the pooled out-of-fold predictions. Prepared
folds and predictions are written to the shared folder, nothing stays cached.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.functions.columns import SEED
from tabflow.operators import folds as FO
from tabflow.operators import models as MD
from tabflow.operators import split as SP
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig
from tabflow.session import cut_lineage

CLASSIFICATION = ("binary_classification", "multiclass_classification")


@dataclass
class ValidationPlan:
    name: str                   # "cv" or "holdout"
    n_folds: int                # 1 for a holdout
    holdout_frac: float | None
    least_class: int | None


def validation_plan(df: DataFrame, target: str, task: str, name: str = "cv", n_folds: int = 5,
                    holdout_frac: float = 0.2) -> ValidationPlan:
    """H3: k folds, but no more than the least class has rows; a holdout where it has a
    single one."""
    least = None
    if task in CLASSIFICATION:
        least = df.where(F.col(target).isNotNull()).groupBy(target).count().agg(F.min("count")).first()[0] or 0
    if name != "cv" or (least is not None and least < 2):
        return ValidationPlan("holdout", 1, holdout_frac, least)
    return ValidationPlan("cv", n_folds if least is None else min(n_folds, least), None, least)


def with_folds(df: DataFrame, plan: ValidationPlan, target: str, task: str, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """``df`` with ``fold``: held-out rows of a holdout are fold 0, the others -1."""
    if plan.name == "holdout":
        if task in CLASSIFICATION:
            d = SP.stratified_split(df, target, plan.holdout_frac, key_cols, seed=seed)
        else:
            d = SP.random_split(df, plan.holdout_frac, key_cols, seed=seed)
        return d.withColumn("fold", F.when(F.col("split") == "test", 0).otherwise(-1)).drop("split")
    if task in CLASSIFICATION:
        return FO.stratified_kfold(df, target, plan.n_folds, key_cols, seed=seed)
    return FO.kfold(df, plan.n_folds, key_cols, seed=seed)


def _families(df: DataFrame, target: str, task: str, families: dict | None) -> dict:
    if families is not None:
        return families
    return MD.regression_families() if task == "regression" else MD.classification_families(df.select(target).distinct().count())


def _predictions(pm, rows: DataFrame, name: str, target: str, task: str, keep: list[str]) -> DataFrame:
    p = pm.transform(rows)
    if task == "regression":
        p = p.withColumn("_y", F.col(target).cast("double"))
    p = MD.with_prob_cols(p, task)
    wanted = ("label", "prediction", "p_true", "p_pos", "probs", "_y")
    return p.select(*keep, target, *[c for c in wanted if c in p.columns], F.lit(name).alias("model"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def train_validated(df: DataFrame, target: str, task: str, key_cols: list[str], families: dict | None = None,
                    config: PreprocessorConfig | None = None, metric: str | None = None, validation: str = "cv", n_folds: int = 5,
                    holdout_frac: float = 0.2, weight_col: str | None = None, refit: bool = True, parallelism: int = 4,
                    seed: int = SEED):
    """H3: ``(leaderboard, fitted, predictions)``. ``leaderboard`` has ``model, metric,
    score_val, validation, n_folds``, best first; ``fitted`` maps names to models fitted
    on all rows and ``"preprocessor"`` to theirs (empty without ``refit``);
    ``predictions`` has every validated row once for each model, by a model and a
    preprocessor that have not seen its fold."""
    families = _families(df, target, task, families)
    metric = metric or ("rmse" if task == "regression" else "accuracy")
    plan = validation_plan(df, target, task, validation, n_folds, holdout_frac)
    rows = cut_lineage(with_folds(df, plan, target, task, key_cols, seed))
    base = config or PreprocessorConfig(target=target)
    cfg = replace(base, target=target, keep_columns=list(dict.fromkeys([*base.keep_columns, *key_cols])),
                  drop_columns=[*base.drop_columns, "fold"])

    def prepare(f: int):
        train = rows.where(F.col("fold") != f)
        pre = Preprocessor(cfg).fit(train)
        return pre, cut_lineage(pre.transform(train)), cut_lineage(pre.transform(rows.where(F.col("fold") == f)))

    def fit(job):
        f, name, est = job
        pre, train, held = prepared[f].result()
        pm = MD.build_pipeline(est, pre.feature_columns, target, task, weight_col).fit(train)
        return _predictions(pm, held, name, target, task, key_cols).withColumn("fold", F.lit(f))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        prepared = {f: pool.submit(prepare, f) for f in range(plan.n_folds)}
        parts = list(pool.map(fit, [(f, name, est) for f in range(plan.n_folds) for name, est in families.items()]))
        preds = cut_lineage(_union(parts))
        fitted: dict = {}
        if refit:
            pre = Preprocessor(replace(cfg, drop_columns=list(base.drop_columns))).fit(df)
            train = cut_lineage(pre.transform(df))
            again = pool.map(lambda e: MD.build_pipeline(e, pre.feature_columns, target, task, weight_col).fit(train), families.values())
            fitted = {"preprocessor": pre, **dict(zip(families, again, strict=True))}
    board = MD.evaluate_models(preds, metric, task).select(
        "*", F.lit(plan.name).alias("validation"), F.lit(plan.n_folds).alias("n_folds"))
    return board.orderBy(F.col("score_val").desc(), "model"), fitted, preds


# ------------------------------------------------------------------ stacking
def _level_one(preds: DataFrame, names: list[str], key_cols: list[str], target: str, task: str) -> tuple[DataFrame, list[str]]:
    """One row a key: every model's outputs side by side (a class's probability is
    implied by the others', so the last one is left out)."""
    if task == "regression":
        out, width = F.array("prediction"), 1
    else:
        width = max(1, (preds.agg(F.max(F.size("probs"))).first()[0] or 2) - 1)
        out = F.slice("probs", 2, width)
    wide = preds.select(*key_cols, target, "model", out.alias("o")).groupBy(*key_cols, target).pivot("model", names).agg(F.first("o"))
    cols = [(n, i) for n in names for i in range(width)]
    return wide.select(*key_cols, target, *[F.coalesce(F.col(n)[i], F.lit(0.0)).alias(f"{n}_{i}") for n, i in cols]), [f"{n}_{i}" for n, i in cols]


def stack(train: DataFrame, holdout: DataFrame, target: str, task: str, key_cols: list[str], families: dict | None = None,
          config: PreprocessorConfig | None = None, metric: str | None = None, n_folds: int = 3, level_two=None,
          parallelism: int = 4, seed: int = SEED):
    """H4: ``(board, predictions)`` on ``holdout``, rows that no level has seen. Level 2
    learns from out-of-fold predictions whose preprocessors were refitted in every
    fold; the base models of the held-out rows are fitted on all of ``train``.
    ``board`` ranks the base models and ``Stacked`` on the held-out rows."""
    families = _families(train, target, task, families)
    metric = metric or ("rmse" if task == "regression" else "accuracy")
    _, fitted, oof = train_validated(train, target, task, key_cols, families, config, metric, "cv", n_folds,
                                     parallelism=parallelism, seed=seed)
    names = list(families)
    wide, cols = _level_one(oof, names, key_cols, target, task)
    est = level_two or (LinearRegression(regParam=0.01) if task == "regression" else LogisticRegression(maxIter=50, regParam=0.01))
    top = MD.build_pipeline(est, cols, target, task).fit(cut_lineage(wide))
    held = cut_lineage(fitted["preprocessor"].transform(holdout))
    parts = [_predictions(fitted[n], held, n, target, task, key_cols) for n in names]
    preds = cut_lineage(_union(parts))
    wide, _ = _level_one(preds, names, key_cols, target, task)
    stacked = _predictions(top, wide, "Stacked", target, task, key_cols)
    every = cut_lineage(preds.unionByName(stacked, allowMissingColumns=True))
    board = MD.evaluate_models(every, metric, task).orderBy(F.col("score_val").desc(), "model")
    return board, every


# ---------------------------------------------------------------- trial loop
TRIALS = ("trial int, iteration int, candidate string, status string, score double, error string, improved boolean, "
          "best_so_far double, since_improvement int")


def search(spark: SparkSession, propose: Callable[[list[dict]], Iterable], evaluate: Callable[[object], float],
           higher_better: bool = True, trials_per_iteration: int = 3, max_iterations: int = 10, parallelism: int = 4) -> DataFrame:
    """L3: rounds of candidates until there are none, the iterations run out, or
    2 x ``trials_per_iteration`` scored trials in a row brought no improvement.

    ``propose(history)`` names the candidates of a round (JSON values), with all
    earlier trials at hand; ``evaluate(candidate)`` runs Spark jobs and returns a
    score. The candidates of a round run at the same time, at most ``parallelism`` of
    them; a failure is recorded as a failed trial and stops nothing. Trials keep the
    order in which they were proposed, whichever ends first. The table has one row a
    trial, so it is as long as the search's budget."""
    history: list[dict] = []
    best, streak = None, 0

    def attempt(candidate):
        try:
            return float(evaluate(candidate)), None
        except Exception as e:  # noqa: BLE001 - a failed trial is a result of the search
            return None, f"{type(e).__name__}: {str(e)[:200]}"

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for iteration in range(max_iterations):
            candidates = list(propose(history))
            if not candidates:
                break
            for candidate, (score, error) in zip(candidates, pool.map(attempt, candidates), strict=True):
                improved = score is not None and (best is None or (score > best if higher_better else score < best))
                if improved:
                    best, streak = score, 0
                elif score is not None:
                    streak += 1
                history.append({"trial": len(history), "iteration": iteration, "candidate": json.dumps(candidate, sort_keys=True),
                                "status": "failed" if error else "completed", "score": score, "error": error,
                                "improved": improved, "best_so_far": best, "since_improvement": streak})
            if streak >= 2 * trials_per_iteration:
                break
    return spark.createDataFrame(history, TRIALS)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of the last improvement."""
    return trials.where("improved").withColumn("_last", F.row_number().over(
        Window.partitionBy("improved").orderBy(F.desc("trial")))).where("_last = 1").drop("_last")
