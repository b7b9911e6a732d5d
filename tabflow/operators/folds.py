"""Cross-validation fold assignment (F19-F23) as a ``fold`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import SEED, seeded_hex, uniform01
from tabflow.functions.ranking import hash_rank, range_rank
from tabflow.session import cut_lineage

GROUPS_BROADCAST = 1_000_000


def kfold(df: DataFrame, k: int, key_cols: list[str], seed: int = SEED, n_rows: int | None = None) -> DataFrame:
    """F20 shuffled K-fold: rows in seeded-digest order dealt round robin, so
    fold sizes differ by at most one (the first n mod k folds get the extra row)."""
    if n_rows is None:
        n_rows = df.count()
    r = hash_rank(df.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed)), "_tf_h", [], tiebreak=key_cols,
                  rank_col="_tf_rank", max_group_rows=n_rows, n_groups=1)
    return r.withColumn("fold", F.pmod(F.col("_tf_rank") - 1, F.lit(k)).cast("int")).drop("_tf_h", "_tf_rank")


def stratified_kfold(df: DataFrame, target: str, k: int, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """within each class rows are dealt round robin over the folds."""
    # the null class is ranked like any other: no row is lost
    d = hash_rank(df.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed)), "_tf_h", [target], tiebreak=key_cols,
                  rank_col="_tf_rank")
    return d.withColumn("fold", F.pmod(F.col("_tf_rank") - 1, F.lit(k)).cast("int")).drop("_tf_h", "_tf_rank")


def time_series_blocks(df: DataFrame, k: int, order_cols: list[str], n_rows: int | None = None) -> DataFrame:
    """F22 expanding-window split: rows in time order; the last k blocks of
    size n // (k+1) are the test folds 0..k-1; ``block`` = −1 for rows before
    the first test block. Fold i trains on ``block < i`` and tests on ``block == i``."""
    if n_rows is None:
        n_rows = df.count()
    size = n_rows // (k + 1)
    start = n_rows - k * size
    r = range_rank(df, order_cols, "_tf_pos", n_rows=n_rows)
    b = F.when(F.col("_tf_pos") <= start, F.lit(-1)).otherwise(F.floor((F.col("_tf_pos") - start - 1) / F.lit(max(size, 1))))
    return r.withColumn("block", b.cast("int")).drop("_tf_pos")


def group_kfold(df: DataFrame, group_col: str, k: int, mode: str = "greedy", seed: int = SEED) -> DataFrame:
    """groups never cross folds. ``greedy`` deals the groups out by size, the
    largest first, back and forth over the folds (0..k-1, k-1..0, ...): two folds differ
    by at most the largest group, as when each group goes to the lightest fold. The rank
    is a distributed one over the table of group sizes, so any number of groups will do;
    equal sizes go by the seeded digest. ``hash`` = seeded hash of the group. Null is a
    group of its own."""
    if mode == "hash":
        return df.withColumn("fold", F.floor(uniform01(seeded_hex(group_col, seed=seed)) * k).cast("int"))
    sizes = df.groupBy(F.col(group_col).alias("_tf_group")).agg((-F.count(F.lit(1))).alias("_tf_neg"))
    sizes = cut_lineage(sizes.withColumn("_tf_u", uniform01(seeded_hex("_tf_group", seed=seed))))
    n = sizes.count()
    place = F.pmod(F.col("_tf_rank") - 1, F.lit(2 * k))
    dealt = range_rank(sizes, ["_tf_neg", "_tf_u", "_tf_group"], "_tf_rank", n_rows=n).select(
        "_tf_group", F.when(place < k, place).otherwise(2 * k - 1 - place).cast("int").alias("fold"))
    dealt = F.broadcast(dealt) if n <= GROUPS_BROADCAST else dealt
    return df.join(dealt, df[group_col].eqNullSafe(dealt["_tf_group"]), "left").drop("_tf_group")


def choose_folds(n_rows: int, task: str, min_class: int | None, requested: int = 5) -> tuple[int, str]:
    """number of folds and splitter kind."""
    n_folds = max(2, min(requested, n_rows // 2))
    if task != "regression" and min_class is not None:
        if min_class < 2:
            return n_folds, "kfold"
        n_folds = max(2, min(n_folds, min_class))
        return n_folds, "stratified"
    return n_folds, "kfold"
