"""Class imbalance: ratio, method choice, weights, random over/under sampling
(F8-F13). kNN-based synthesis (SMOTE family) lives in ``neighbors``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import SEED, is_string, seeded_hex
from tabflow.functions.ranking import hash_rank
from tabflow.operators.stats import CLASS_SIZE_BROADCAST_ROWS, with_class_size

WEIGHT_COL = "_sample_weight"
LARGE_ROWS = 100_000


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``(target, n_c)`` for non-null classes (partial aggregation: a hot class
    costs one counter per task)."""
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))


def imbalance_summary(df: DataFrame, target: str) -> DataFrame:
    """F8: one row ``n_rows, n_classes, max_class, min_class, imbalance_ratio``
    (ratio 1.0 with fewer than two classes)."""
    c = class_counts(df, target)
    s = c.agg(F.sum("n_c").cast("bigint").alias("n_rows"), F.count(F.lit(1)).cast("bigint").alias("n_classes"),
              F.max("n_c").cast("bigint").alias("max_class"), F.min("n_c").cast("bigint").alias("min_class"))
    return s.withColumn("imbalance_ratio", F.when(F.col("n_classes") < 2, F.lit(1.0))
                        .otherwise(F.col("max_class") / F.col("min_class")))


def sampling_choice(df: DataFrame, target: str, task: str) -> DataFrame:
    """one row ``method, imbalance_ratio, k_neighbors`` following the
    reference's decision list (ratio, size, minority size, missing values and
    categorical features)."""
    feats = [c for c in df.columns if c != target]
    cats = [c for c in feats if is_string(df.schema[c].dataType)]
    s = imbalance_summary(df, target)
    if task not in ("binary_classification", "multiclass_classification"):
        return s.select(F.lit("none").alias("method"), "imbalance_ratio", F.lit(None).cast("int").alias("k_neighbors"))
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in feats]) if feats else F.lit(False)
    miss = df.agg(F.max(any_null.cast("int")).alias("has_missing"))
    j = s.unionByName(miss, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in s.columns + ["has_missing"]])
    r, n, mn = F.col("imbalance_ratio"), F.col("n_rows"), F.col("min_class")
    has_missing = F.coalesce(F.col("has_missing"), F.lit(0)) == 1
    safe_k = F.least(F.lit(5), F.greatest(F.lit(1), mn - 1)).cast("int")
    method = (F.when(r <= 1.5, "none").when(r <= 3.0, "class_weight")
              .when(n > LARGE_ROWS, F.when(mn < 100, "class_weight").otherwise("random_under"))
              .when(~has_missing & F.lit(len(cats) == 0), F.when(r <= 10.0, "smote").otherwise("smote_enn"))
              .when(~has_missing & F.lit(len(cats) > 0), "smotenc")
              .otherwise("random_over"))
    return j.select(method.alias("method"), "imbalance_ratio",
                    F.when(method.isin("smote", "smote_enn", "smotenc"), safe_k).alias("k_neighbors"))


def class_weights(df: DataFrame, target: str, weight_col: str = WEIGHT_COL) -> DataFrame:
    """balanced weights n / (k · n_c) attached as ``_sample_weight`` (null
    for rows without a class)."""
    c = class_counts(df, target)
    total = c.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    w = c.select(target, (F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"])) * F.col("n_c"))).alias(weight_col))
    w = F.broadcast(w) if total["k"] <= CLASS_SIZE_BROADCAST_ROWS else w
    return df.join(w, target, "left")


def _ranked(df: DataFrame, target: str, key_cols: list[str], seed: int):
    d, total = with_class_size(df, target)
    d = d.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed))
    return hash_rank(d, "_tf_h", [target], tiebreak=key_cols, rank_col="_tf_rank",
                     max_group_rows=total["most"], n_groups=total["k"]), total


def random_oversample(df: DataFrame, target: str, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """every class grows to the majority count: ``floor(M/n_c)`` full
    copies (explode) plus the ``M mod n_c`` rows with the smallest seeded
    digests; ``copy`` numbers the replica (0 = original)."""
    d, total = _ranked(df, target, key_cols, seed)
    nc, m = F.col("_tf_nc"), F.lit(total["most"])
    full = F.floor(m / nc).cast("int")
    extra = F.when(F.col("_tf_rank") <= F.pmod(m, nc), 1).otherwise(0)
    return (d.withColumn("copy", F.explode(F.sequence(F.lit(0), full + extra - 1)))
             .drop("_tf_h", "_tf_rank", "_tf_nc"))


def random_undersample(df: DataFrame, target: str, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """every class shrinks to the minority count (smallest seeded digests)."""
    d, total = _ranked(df, target, key_cols, seed)
    return d.where(F.col("_tf_rank") <= total["least"]).drop("_tf_h", "_tf_rank", "_tf_nc")
