"""Reproducible splits (F1-F7): one ``split`` column on one frame.

Every assignment is a function of a seeded md5 digest of the row key, so it
does not depend on partitioning or task order (``randomSplit`` does), and the
per-class ranks come from ``hash_rank`` (hot classes are split into
sub-buckets; no class is sorted whole in one task).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import SEED, seeded_hex, uniform01
from tabflow.functions.ranking import hash_rank
from tabflow.operators.stats import with_class_size

CLASSIFICATION = ("binary_classification", "multiclass_classification")


def _with_class_rank(df: DataFrame, target: str, key_cols: list[str], seed: int):
    """Adds ``_tf_h`` digest, ``_tf_rank`` within class and ``_tf_nc`` class size
    to the rows with a class; also gives the class totals."""
    d, total = with_class_size(df, target)
    d = d.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed))
    return hash_rank(d, "_tf_h", [target], tiebreak=key_cols, rank_col="_tf_rank",
                     max_group_rows=total["most"], n_groups=total["k"]), total


def random_split(df: DataFrame, test_frac: float, key_cols: list[str], seed: int = SEED,
                 exact: bool = True, n_rows: int | None = None) -> DataFrame:
    """``split`` in {train, test}; exactly ceil(n·frac) test rows (the rows
    with the smallest seeded digests) or, with ``exact=False``, each row
    independently with probability ``frac`` (no shuffle at all)."""
    h = seeded_hex(*key_cols, seed=seed)
    if not exact:
        return df.withColumn("split", F.when(uniform01(h) < test_frac, "test").otherwise("train"))
    if n_rows is None:
        n_rows = df.count()
    n_test = int(math.ceil(test_frac * n_rows))
    r = hash_rank(df.withColumn("_tf_h", h), "_tf_h", [], tiebreak=key_cols, rank_col="_tf_rank",
                  max_group_rows=n_rows, n_groups=1)
    return r.withColumn("split", F.when(F.col("_tf_rank") <= n_test, "test").otherwise("train")).drop("_tf_h", "_tf_rank")


def _labels_two(frac: float):
    """Split labels for two sides with presence: singletons are copied to both."""
    nc, rk = F.col("_tf_nc"), F.col("_tf_rank")
    t = F.greatest(F.lit(1), F.least(nc - 1, F.round(nc * frac).cast("bigint")))
    return (F.when(nc == 1, F.array(F.lit("train"), F.lit("test")))
            .when(rk == 1, F.array(F.lit("train")))
            .when(rk <= t + 1, F.array(F.lit("test")))
            .otherwise(F.array(F.lit("train"))))


def stratified_split(df: DataFrame, target: str, test_frac: float, key_cols: list[str], seed: int = SEED,
                     rare_class_strategy: str = "auto") -> DataFrame:
    """A split with every class on both sides and an exact test size.

    Null targets are removed. The first row of each class (by seeded digest) goes
    to train, the second to test; of the remaining rows, those with the smallest
    digests fill the test side up to ``round(frac * rows)``. Classes with one row:
    ``auto``/``oversample`` copy the row to both sides (F3; the copy counts as a
    row), ``drop`` removes them (F4), ``none`` disables stratification. Falls back
    to a random split when the test side cannot hold one row per class (F5)."""
    d, total = _with_class_rank(df, target, key_cols, seed)
    n, k, single = total["n"], total["k"], total["single"]
    valid = k if rare_class_strategy in ("auto", "oversample") else k - single
    if rare_class_strategy == "drop":
        d, n, k, single = d.where(F.col("_tf_nc") >= 2), n - single, k - single, 0
    if valid < 2:
        raise ValueError(f"classification needs at least two classes in {target}: {valid} of {total['k']} can be split")
    if int(n * test_frac) < valid or rare_class_strategy == "none":
        return random_split(d.drop("_tf_h", "_tf_rank", "_tf_nc"), test_frac, key_cols, seed, n_rows=n)
    more = round((n + single) * test_frac) - k      # test rows beyond one for each class
    d = hash_rank(d.withColumn("_tf_rest", F.col("_tf_rank") > 2), "_tf_h", ["_tf_rest"], tiebreak=key_cols,
                  rank_col="_tf_place", max_group_rows=n, n_groups=2)
    rank = F.col("_tf_rank")
    labels = (F.when(F.col("_tf_nc") == 1, F.array(F.lit("train"), F.lit("test")))
              .when((rank == 2) | (F.col("_tf_rest") & (F.col("_tf_place") <= more)), F.array(F.lit("test")))
              .otherwise(F.array(F.lit("train"))))
    return d.withColumn("split", F.explode(labels)).drop("_tf_h", "_tf_rank", "_tf_nc", "_tf_rest", "_tf_place")


def three_way_split(df: DataFrame, target: str, val_frac: float, test_frac: float, key_cols: list[str],
                    seed: int = SEED, stratify: bool = True) -> DataFrame:
    """``split`` in {train, val, test} from one per-class ranking with two
    cut points; every class with ≥1 row appears in all three parts (classes
    with one or two rows are copied, as the two-stage reference split does).
    ``val_frac = 0`` gives an empty validation part."""
    if val_frac < 0 or test_frac < 0 or val_frac + test_frac >= 1:
        raise ValueError("split sizes must be non-negative and sum to less than 1")
    df = df.where(F.col(target).isNotNull())
    if not stratify:
        n = df.count()
        n_test, n_val = math.ceil(test_frac * n), math.ceil(val_frac * n)
        r = hash_rank(df.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed)), "_tf_h", [], tiebreak=key_cols,
                      rank_col="_tf_rank", max_group_rows=n, n_groups=1)
        return r.withColumn("split", F.when(F.col("_tf_rank") <= n_test, "test")
                            .when(F.col("_tf_rank") <= n_test + n_val, "val").otherwise("train")).drop("_tf_h", "_tf_rank")
    d, total = _with_class_rank(df, target, key_cols, seed)
    if total["n"] and int(total["n"] * min(x for x in (val_frac, test_frac, 1) if x > 0)) < total["k"]:
        return three_way_split(df, target, val_frac, test_frac, key_cols, seed, stratify=False)
    nc, rk = F.col("_tf_nc"), F.col("_tf_rank")
    if val_frac == 0:
        labels = _labels_two(test_frac)
    else:
        v = F.greatest(F.lit(1), F.round(nc * val_frac).cast("bigint"))
        t = F.greatest(F.lit(1), F.round(nc * test_frac).cast("bigint"))
        labels = (F.when(nc == 1, F.array(F.lit("train"), F.lit("val"), F.lit("test")))
                  .when(nc == 2, F.when(rk == 1, F.array(F.lit("train"))).otherwise(F.array(F.lit("val"), F.lit("test"))))
                  .when(rk == 1, F.array(F.lit("train")))
                  .when(rk <= v + 1, F.array(F.lit("val")))
                  .when(rk <= v + t + 1, F.array(F.lit("test")))
                  .otherwise(F.array(F.lit("train"))))
    return d.withColumn("split", F.explode(labels)).drop("_tf_h", "_tf_rank", "_tf_nc")


def split_for_task(df: DataFrame, target: str, task: str, test_frac: float, key_cols: list[str],
                   seed: int = SEED, rare_class_strategy: str = "auto") -> DataFrame:
    """Dispatch: stratified with presence for classification, random otherwise."""
    df = df.where(F.col(target).isNotNull())
    if task in CLASSIFICATION:
        return stratified_split(df, target, test_frac, key_cols, seed, rare_class_strategy)
    return random_split(df, test_frac, key_cols, seed)


def sample_rows(df: DataFrame, n: int, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """reproducible sample of exactly ``n`` rows (smallest seeded digests;
    TakeOrderedAndProject keeps only n rows per task, no global sort)."""
    return df.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed)).orderBy("_tf_h", *key_cols).limit(n).drop("_tf_h")
