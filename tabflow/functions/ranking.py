"""Distributed exact ranks and running sums.

A ``Window`` over a whole class (or a whole table) sends every row of that group
to one task. When a group may hold a third of all rows that task is the job's
bottleneck, so both helpers below split large groups into sub-buckets whose
sizes are known from a small count table, rank/sum each sub-bucket with an
ordinary window, and shift it by the rows (or sums) of the earlier
sub-buckets. Small inputs use a single bucket, i.e. a plain window.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 2_000_000       # rows ranked by one window task
BROADCAST_ROWS = 2_000_000        # offset tables above this are shuffle-joined
MAX_HASH_BITS = 20
SALT_BUCKETS = 32                 # sub-groups of a group in a two-stage top-k


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], broadcast_ok: bool) -> DataFrame:
    r = F.broadcast(right) if broadcast_ok else right
    cond = [left[k].eqNullSafe(r[k]) for k in keys]
    cond = reduce(lambda a, b: a & b, cond)
    return left.join(r, cond, "inner").drop(*[r[k] for k in keys])


def hash_rank(df: DataFrame, hash_col: str, partition_cols=(), tiebreak=(), rank_col: str = "rank",
              max_group_rows: int | None = None, n_groups: int | None = None,
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact 1-based ``row_number`` inside each partition group, ordered by a
    uniformly distributed hex digest column ``hash_col`` (then ``tiebreak``).

    ``max_group_rows``/``n_groups`` may be passed when the caller already has
    the group-count table; otherwise one small aggregate computes them.
    """
    pcols = list(partition_cols)
    order = [F.col(hash_col)] + [F.col(c) for c in tiebreak]
    if max_group_rows is None or n_groups is None:
        g = df.groupBy(*pcols).count() if pcols else df.select(F.count(F.lit(1)).alias("count"))
        row = g.agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("k")).first()
        max_group_rows, n_groups = int(row["m"] or 0), int(row["k"] or 0)
    bits = 0
    if max_group_rows > rows_per_bucket:
        bits = min(MAX_HASH_BITS, int(math.ceil(math.log2(max_group_rows / rows_per_bucket))))
    if bits == 0:
        w = Window.partitionBy(*pcols).orderBy(*order) if pcols else Window.orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w))
    # leading ``bits`` bits of the digest: order-preserving w.r.t. the digest itself
    bucket = F.shiftrightunsigned(F.conv(F.substring(F.col(hash_col), 1, 6), 16, 10).cast("bigint"), 24 - bits)
    d = df.withColumn("_tf_bkt", bucket)
    counts = d.groupBy(*pcols, "_tf_bkt").agg(F.count(F.lit(1)).alias("_tf_n"))
    wo = (Window.partitionBy(*pcols) if pcols else Window.partitionBy(F.lit(0))).orderBy("_tf_bkt")
    offsets = counts.select(*pcols, "_tf_bkt",
                            F.coalesce(F.sum("_tf_n").over(wo.rowsBetween(Window.unboundedPreceding, -1)),
                                       F.lit(0)).alias("_tf_off"))
    small = n_groups * (1 << bits) <= BROADCAST_ROWS
    j = _null_safe_join(d, offsets, pcols + ["_tf_bkt"], small)
    w = Window.partitionBy(*[F.col(c) for c in pcols], F.col("_tf_bkt")).orderBy(*order)
    return j.withColumn(rank_col, F.row_number().over(w) + F.col("_tf_off")).drop("_tf_bkt", "_tf_off")


def prefix_sums(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                n_rows: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
                suffix: str = "_cum", partition_cols=()) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order_col`` order inside each
    ``partition_cols`` group (order values must be unique within a group, e.g.
    after a ``groupBy(group, order_col)``). Adds ``{c}{suffix}`` columns
    (inclusive of the current row).

    Large inputs are range-bucketed on ``order_col`` (approximate quantiles);
    each (group, bucket) is summed by its own window and shifted by the totals
    of the earlier buckets of its group, so no group is processed whole."""
    pcols = list(partition_cols)
    if n_rows is None:
        n_rows = df.count()
    oc = F.col(order_col).desc() if descending else F.col(order_col).asc()
    n_buckets = max(1, int(math.ceil(n_rows / rows_per_bucket)))
    if n_buckets == 1:
        w = (Window.partitionBy(*pcols) if pcols else Window).orderBy(oc).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c).over(w).alias(c + suffix) for c in sum_cols])
    qs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.select(F.percentile_approx(F.col(order_col).cast("double"), qs, 10000).alias("b")).first()["b"]
    splits = [-float("inf")] + sorted(set(float(b) for b in bounds)) + [float("inf")]
    d = Bucketizer(splits=splits, inputCol="_tf_ord", outputCol="_tf_bkt", handleInvalid="keep").transform(
        df.withColumn("_tf_ord", F.col(order_col).cast("double")))
    # a null order key gets the bucket where the plain window has it: first, or last when descending
    bucket = -F.col("_tf_bkt") if descending else F.col("_tf_bkt")
    d = d.withColumn("_tf_bkt", F.coalesce(bucket, F.lit(1.0 if descending else -1.0)))
    totals = d.groupBy(*pcols, "_tf_bkt").agg(*[F.sum(c).alias("_tf_t_" + c) for c in sum_cols])
    wo = (Window.partitionBy(*pcols) if pcols else Window.partitionBy(F.lit(0))).orderBy("_tf_bkt").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*pcols, "_tf_bkt", *[F.coalesce(F.sum("_tf_t_" + c).over(wo), F.lit(0)).alias("_tf_o_" + c)
                                                 for c in sum_cols])
    # offsets: one row per (group, bucket), null groups among them
    j = _null_safe_join(d, offsets, pcols + ["_tf_bkt"], offsets.count() <= BROADCAST_ROWS)
    w = Window.partitionBy(*pcols, "_tf_bkt").orderBy(oc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(*df.columns, *[(F.sum(c).over(w) + F.col("_tf_o_" + c)).alias(c + suffix) for c in sum_cols])


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, salt_buckets: int | None = None,
                    rank_col: str | None = None) -> DataFrame:
    """The ``k`` first rows of every group in ``order_cols`` order.

    Two stages so that no task ever sorts a whole (possibly hot) group: rows are
    salted into ``salt_buckets`` sub-groups, each keeps its own top ``k``, and
    only the ≤ k·salt survivors per group meet in the final window. The salt
    count defaults to the fixed ``SALT_BUCKETS``."""
    gcols = list(group_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    if salt_buckets is None:
        salt_buckets = SALT_BUCKETS
    d = df
    if salt_buckets > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
        w1 = Window.partitionBy(*gcols, salt).orderBy(*order)
        d = df.withColumn("_tf_r1", F.row_number().over(w1)).where(F.col("_tf_r1") <= k).drop("_tf_r1")
    w2 = Window.partitionBy(*gcols).orderBy(*order) if gcols else Window.orderBy(*order)
    name = rank_col or "_tf_r2"
    out = d.withColumn(name, F.row_number().over(w2)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def range_rank(df: DataFrame, order_cols: list[str], rank_col: str = "rank", n_rows: int | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact global 1-based ``row_number`` in ``order_cols`` order for a
    non-uniform key (e.g. time). Rows are range-bucketed on the first order
    column (approximate quantiles; equal values share a bucket, so bucket order
    agrees with the full order), each bucket is ranked by its own window and
    shifted by the row count of earlier buckets. A value that fills buckets of
    its own (or null) is split by the second order column where that is a number
    or a time."""
    if n_rows is None:
        n_rows = df.count()
    order = [F.col(c) for c in order_cols]
    n_buckets = max(1, int(math.ceil(n_rows / rows_per_bucket)))
    if n_buckets == 1:
        return df.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))

    def number(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        return F.col(c).cast("double")
    d = df.withColumn("_tf_ord", number(order_cols[0]))
    qs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = [float(b) for b in d.select(F.percentile_approx("_tf_ord", qs, 10000).alias("b")).first()["b"] or []]
    # a value that is several bounds at once gets a bucket for itself
    hot = {math.nextafter(b, math.inf) for b in bounds if bounds.count(b) > 1}
    splits = [-float("inf")] + sorted(b for b in hot.union(bounds) if math.isfinite(b)) + [float("inf")]
    d = Bucketizer(splits=splits, inputCol="_tf_ord", outputCol="_tf_bkt", handleInvalid="keep").transform(d)
    d = d.withColumn("_tf_bkt", F.coalesce("_tf_bkt", F.lit(-1.0)))   # nulls first, as in the plain window
    d = _split_ties(d, number(order_cols[1]) if len(order_cols) > 1
                    and isinstance(df.schema[order_cols[1]].dataType, (T.NumericType, T.DatetimeType)) else None, rows_per_bucket)
    place = ["_tf_bkt", "_tf_sub"]
    counts = d.groupBy(*place).agg(F.count(F.lit(1)).alias("_tf_n"))
    wo = Window.partitionBy(F.lit(0)).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("_tf_n").over(wo), F.lit(0)).alias("_tf_off"))
    j = d.join(F.broadcast(offsets), place)   # one row per bucket
    w = Window.partitionBy(*place).orderBy(*order)
    return j.withColumn(rank_col, F.row_number().over(w) + F.col("_tf_off")).drop(*place, "_tf_off", "_tf_ord")


def _split_ties(d: DataFrame, second: Column | None, rows_per_bucket: int) -> DataFrame:
    """Adds ``_tf_sub``, the place inside the bucket: 0, but for large buckets of a
    single ``_tf_ord`` value, which are cut at approximate quantiles of ``second``."""
    plain = d.withColumn("_tf_sub", F.lit(0))
    if second is None:
        return plain
    sizes = d.groupBy("_tf_bkt").agg(F.count(F.lit(1)).alias("n"), F.min("_tf_ord").eqNullSafe(F.max("_tf_ord")).alias("one"))
    large = sizes.where(F.col("one") & (F.col("n") > 2 * rows_per_bucket)).collect()   # at most one row per bucket
    if not large:
        return plain
    m = math.ceil(max(r["n"] for r in large) / rows_per_bucket)
    keyed = d.withColumn("_tf_ord2", second)
    cuts = (keyed.where(F.col("_tf_bkt").isin([r["_tf_bkt"] for r in large])).groupBy("_tf_bkt")
            .agg(F.percentile_approx("_tf_ord2", [i / m for i in range(1, m)], 10000).alias("_tf_cuts")))
    # nulls first, as in the plain window
    sub = F.when(F.col("_tf_cuts").isNull(), 0).when(F.col("_tf_ord2").isNull(), -1) \
        .otherwise(F.size(F.filter("_tf_cuts", lambda b: b <= F.col("_tf_ord2"))))
    return keyed.join(F.broadcast(cuts), "_tf_bkt", "left").withColumn("_tf_sub", sub).drop("_tf_cuts", "_tf_ord2")
