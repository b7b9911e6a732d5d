"""Training-strategy recommendation from one table (G0 with G1-G8 folded in).

All decisions are Column expressions over a one-row summary aggregate (row
count, class counts, feature count, estimated size, high-cardinality columns),
so the recommendation is an ordinary lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import is_numeric, is_string
from tabflow.operators.infer import high_cardinality_columns

SMALL_ROWS = 1_000
LARGE_ROWS = 100_000
HIGH_CLASS_COUNT = 50
CLASSIFICATION = ("binary_classification", "multiclass_classification")


def summary(df: DataFrame, target: str, task: str) -> DataFrame:
    """One row: ``n_samples, n_features, memory_mb, n_classes, max_class,
    min_class, high_card_columns``."""
    feats = [c for c in df.columns if c != target]
    num = [c for c in df.columns if is_numeric(df.schema[c].dataType, True)]
    strs = [c for c in df.columns if is_string(df.schema[c].dataType)]
    size = F.lit(8.0 * len(num)) * F.count(F.lit(1)) + sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in strs), F.lit(0))
    base = df.agg(F.count(F.lit(1)).cast("bigint").alias("n_samples"), (size / 1048576.0).alias("memory_mb"))
    cc = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n")) \
           .agg(F.count(F.lit(1)).cast("bigint").alias("n_classes"), F.max("n").cast("bigint").alias("max_class"),
                F.min("n").cast("bigint").alias("min_class"))
    hc = high_cardinality_columns(df, target).agg(F.count(F.lit(1)).cast("bigint").alias("high_card_columns"))
    parts = base.unionByName(cc, allowMissingColumns=True).unionByName(hc, allowMissingColumns=True)
    cols = ["n_samples", "memory_mb", "n_classes", "max_class", "min_class", "high_card_columns"]
    return parts.agg(*[F.max(c).alias(c) for c in cols]).withColumn("n_features", F.lit(len(feats)).cast("bigint"))


def time_limit_seconds(budget_minutes: float | None) -> int | None:
    """Training time limit from the user's budget (none without a budget;
    at least 30 s; budgets under half a minute count as half a minute)."""
    if budget_minutes is None:
        return None
    secs = max(budget_minutes, 0.5) * 60
    return max(int(secs), 30)


def recommend(df: DataFrame, target: str, task: str, budget_minutes: float | None = None, preset: str | None = None,
              max_models: int | None = None) -> DataFrame:
    """One row of decisions: ``size_label, preset, max_models, bagging,
    primary_metric, imbalance_ratio, sample_weight, validation, n_folds,
    cv_type, holdout_frac, rare_threshold, enable_pca, model_space``. A caller's
    ``preset`` (other than ``auto``) and ``max_models`` stand."""
    s = summary(df, target, task)
    n, nf, mem = F.col("n_samples"), F.col("n_features"), F.col("memory_mb")
    is_cls = F.lit(task in CLASSIFICATION)
    size = F.when(n < SMALL_ROWS, "small").when(n < LARGE_ROWS, "medium").otherwise("large")
    chosen = F.lit(preset) if preset not in (None, "", "auto") else F.when((size == "large") | (nf > 500) | (mem > 2048), "medium_quality").otherwise("best_quality")
    models = F.lit(max_models) if max_models is not None else F.when(size == "large", 50).otherwise(25)
    ratio = F.when(is_cls & (F.col("n_classes") >= 2), F.col("max_class") / F.col("min_class"))
    if task == "binary_classification":
        metric = F.when(F.col("max_class") / F.greatest(F.col("min_class"), F.lit(1)) > 3, "auc_pr").otherwise("f1")
    elif task == "multiclass_classification":
        metric = F.lit("log_loss")
    elif task == "regression":
        metric = F.lit("rmse")
    else:
        metric = F.lit("accuracy")
    cv = n < 500
    n_folds = F.when(cv, F.when(is_cls, F.greatest(F.lit(2), F.least(F.lit(5), F.coalesce(F.col("min_class"), n))))
                     .otherwise(5))
    is_large = (size == "large") | (n > LARGE_ROWS) | (mem > 1024)
    high_card = F.coalesce(F.col("high_card_columns"), F.lit(0)) > 0
    high_cls = F.lit(task == "multiclass_classification") & (F.col("n_classes") > HIGH_CLASS_COUNT)
    space = (F.when(~(is_large | high_card | high_cls), "full")
             .when(is_large & ~high_card, "GBM,XGB,LR,CAT")
             .when(~is_large & ~high_card, "GBM,XGB,CAT,RF,XT,KNN,LR").otherwise("GBM,XGB,LR"))
    return s.select(
        size.alias("size_label"), chosen.alias("preset"), models.cast("int").alias("max_models"),
        (size == "small").alias("bagging"), metric.alias("primary_metric"), ratio.alias("imbalance_ratio"),
        (F.coalesce(ratio, F.lit(0.0)) > 1.5).alias("sample_weight"),
        F.when(cv, "cv").otherwise("holdout").alias("validation"), n_folds.cast("int").alias("n_folds"),
        F.when(cv, F.when(is_cls, "stratified").otherwise("kfold")).alias("cv_type"),
        F.when(~cv, F.when(size == "small", 0.2).when(size == "medium", 0.15).otherwise(0.1)).alias("holdout_frac"),
        F.greatest(F.lit(5), F.floor(n * 0.001)).cast("bigint").alias("rare_threshold"),
        ((nf > 100) | (mem > 1024)).alias("enable_pca"), space.alias("model_space"),
        *([] if budget_minutes is None else
          [F.lit(time_limit_seconds(budget_minutes)).cast("int").alias("time_limit_seconds")]))
