"""Data-quality assessment on six dimensions.

Each dimension is one or two fused aggregates over the table; results are
small long-format DataFrames. Scores are rounded to 4 decimals like the
reference's report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import datetime_columns, is_string, seeded_hex, string_columns
from tabflow.functions.ranking import top_k_per_group
from tabflow.operators.stats import distinct_counts, numeric_cols_for_quality, quantiles, unpivot_row

# Name fragments of columns whose values should never be negative.
NON_NEGATIVE_NAME_HINTS = ("age", "income", "price", "salary", "amount", "count", "quantity")
LARGE_DATASET_ROWS = 100_000
QUALITY_SAMPLE_ROWS = 50_000
IQR_K = 1.5


def _features(df: DataFrame, target: str | None) -> list[str]:
    return [c for c in df.columns if c != target]


def cap_rows(df: DataFrame, max_rows: int | None = None, n_rows: int | None = None,
             key_cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Optional reproducible row cap. ``None`` = full data (Spark default);
    ``"auto"`` = the reference's rule (50,000 rows when the table has more than
    100,000); a positive cap keeps the ``max_rows`` rows with the smallest seeded
    digest (a top-k, executed as TakeOrderedAndProject: no global sort)."""
    if max_rows == "auto":          # the reference's rule: 50,000 rows above 100,000
        if n_rows is None:
            n_rows = df.count()
        max_rows = QUALITY_SAMPLE_ROWS if n_rows > LARGE_DATASET_ROWS else None
    if not max_rows or max_rows <= 0:
        return df
    if n_rows is None:
        n_rows = df.count()
    if n_rows <= max_rows:
        return df
    keys = key_cols or df.columns
    return (df.withColumn("_tf_h", seeded_hex(*keys, seed=seed))
              .orderBy("_tf_h").limit(max_rows).drop("_tf_h"))


# ---------------------------------------------------------------- completeness
def missing_rates(df: DataFrame) -> DataFrame:
    """``(column, missing_rate)``."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return unpivot_row(row, [(c, {"missing_rate": F.col(f"m{i}")}) for i, c in enumerate(df.columns)])


def completeness(df: DataFrame) -> DataFrame:
    """One row ``n_rows, missing_cells, rows_with_missing, columns_with_missing, score``."""
    cols = df.columns
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(any_null.cast("bigint")).alias("rows_with_missing"),
                 *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"z{i}") for i, c in enumerate(cols)])
    cells = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"z{i}"), F.lit(0)) for i in range(len(cols))])
    with_missing = reduce(lambda a, b: a + b, [(F.col(f"z{i}") > 0).cast("bigint") for i in range(len(cols))])
    total = F.greatest(F.col("n") * F.lit(len(cols)), F.lit(1))
    return row.select(F.col("n").cast("bigint").alias("n_rows"),
                      cells.cast("bigint").alias("missing_cells"),
                      F.coalesce(F.col("rows_with_missing"), F.lit(0)).cast("bigint").alias("rows_with_missing"),
                      with_missing.cast("bigint").alias("columns_with_missing"),
                      F.round(F.lit(1.0) - cells / total, 4).alias("score"))


def rows_with_missing(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """C2 row level: ``key_cols + missing_cells`` for every row with at least one
    null (a projection and a filter; no shuffle)."""
    n = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    return df.select(*key_cols, n.alias("missing_cells")).where(F.col("missing_cells") > 0)


# ---------------------------------------------------------------- uniqueness


def _hash_input(df: DataFrame, c: str):
    """Row-hash input: floating values + 0.0 so that -0.0 hashes like 0.0, as
    grouping treats them as equal."""
    t = df.schema[c].dataType
    return (F.col(c) + F.lit(0.0)).cast(t) if isinstance(t, (T.FloatType, T.DoubleType)) else F.col(c)


def duplicates(df: DataFrame) -> DataFrame:
    """``n_rows, distinct_rows, duplicated_rows, score``; nulls compare
    equal (grouping semantics), like pandas ``duplicated``.

    One scan and one shuffle of 16 bytes a row at most: rows are grouped by two
    independent 64-bit hashes of all their columns (unequal rows share both with a
    chance of about rows^2 / 2^129)."""
    cols = [_hash_input(df, c) for c in df.columns]
    groups = df.groupBy(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols[::-1]).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    r = groups.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n"), F.count(F.lit(1)).cast("bigint").alias("k"))
    n, d = F.col("n"), F.col("n") - F.col("k")
    return r.select(n.alias("n_rows"), F.col("k").alias("distinct_rows"), d.alias("duplicated_rows"),
                    F.round(F.lit(1.0) - d / F.greatest(n, F.lit(1)), 4).alias("score"))


def id_like_columns(df: DataFrame, target: str | None = None, threshold: float = 0.9,
                    counts: DataFrame | None = None) -> DataFrame:
    """C4: feature columns whose distinct/non-null-or-not row ratio exceeds 0.9."""
    dc = counts if counts is not None else distinct_counts(df, _features(df, target))
    ratio = F.col("nunique") / F.greatest(F.col("n_rows"), F.lit(1))
    return dc.where(ratio > threshold).select("column", F.round(ratio, 4).alias("unique_ratio"))


# ---------------------------------------------------------------- consistency
def mixed_type_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """String columns where the share of values parseable as a number is
    strictly between 0 and 1 (all non-null values are used)."""
    cols = string_columns(df, exclude=(target,))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, numeric_like_ratio double")

    def numeric_like(c):
        v = F.expr(f"try_cast(`{c}` as double)")
        return (v.isNotNull() & ~F.isnan(v)).cast("double")
    row = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), numeric_like(c))).alias(f"r{i}") for i, c in enumerate(cols)])
    long = unpivot_row(row, [(c, {"numeric_like_ratio": F.col(f"r{i}")}) for i, c in enumerate(cols)])
    r = F.col("numeric_like_ratio")
    return long.where((r > 0) & (r < 1)).select("column", F.round(r, 4).alias("numeric_like_ratio"))


def constant_columns(df: DataFrame, target: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``(column, nunique, is_constant, is_all_null)`` for constant columns
    (at most one distinct value counting null) among the features."""
    dc = counts if counts is not None else distinct_counts(df, _features(df, target))
    return dc.where(F.col("nunique_with_null") <= 1).select(
        "column", "nunique", F.lit(True).alias("is_constant"), (F.col("nunique") == 0).alias("is_all_null"))


def consistency(df: DataFrame, target: str | None = None) -> DataFrame:
    """C5+C6: one row ``n_features, constant_columns, all_null_columns, mixed_type_columns, score``."""
    feats = _features(df, target)
    dc = distinct_counts(df, feats)
    const = dc.agg(F.sum((F.col("nunique_with_null") <= 1).cast("bigint")).alias("constant_columns"),
                   F.sum((F.col("nunique") == 0).cast("bigint")).alias("all_null_columns"))
    mixed = mixed_type_columns(df, target).agg(F.count(F.lit(1)).cast("bigint").alias("mixed_type_columns"))
    # two one-row aggregates side by side: union then max (no join needed)
    s = const.unionByName(mixed, allowMissingColumns=True).agg(
        F.max("constant_columns").alias("c"), F.max("all_null_columns").alias("z"),
        F.max("mixed_type_columns").alias("m"))
    nf = max(len(feats), 1)
    c, z, m = (F.coalesce(F.col(x), F.lit(0)).cast("bigint") for x in ("c", "z", "m"))
    return s.select(F.lit(len(feats)).cast("bigint").alias("n_features"), c.alias("constant_columns"),
                    z.alias("all_null_columns"), m.alias("mixed_type_columns"),
                    F.round(F.lit(1.0) - (c + m) / F.lit(float(nf)), 4).alias("score"))


# ---------------------------------------------------------------- accuracy
def iqr_bounds(df: DataFrame, cols: list[str], exact="auto", k: float = IQR_K) -> dict[str, tuple]:
    """E1/C7 pass 1: ``{col: (q1, q3, lower, upper)}`` from one quantile aggregate."""
    qs = quantiles(df, cols, [0.25, 0.75], exact=exact)
    out = {}
    for c, (q1, q3) in qs.items():
        if q1 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def outlier_summary(df: DataFrame, target: str | None = None, exact="auto",
                    keep_zero: bool = False) -> DataFrame:
    """Per numeric feature ``q1, q3, lower_bound, upper_bound, outlier_count,
    non_null, outlier_ratio`` (strictly outside the 1.5·IQR fences); by default
    only columns with outliers, like the reference report."""
    cols = numeric_cols_for_quality(df, exclude=(target,))
    bounds = iqr_bounds(df, cols, exact=exact)
    cols = [c for c in cols if c in bounds]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, q1 double, q3 double, lower_bound double, upper_bound double, "
                "outlier_count bigint, non_null bigint, outlier_ratio double")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        lo, hi = bounds[c][2], bounds[c][3]
        aggs += [F.sum(((x < lo) | (x > hi)).cast("bigint")).alias(f"o{i}"), F.count(x).alias(f"n{i}")]
    row = df.agg(*aggs)
    long = unpivot_row(row, [(c, {"q1": F.lit(bounds[c][0]), "q3": F.lit(bounds[c][1]),
                                  "lower_bound": F.lit(bounds[c][2]), "upper_bound": F.lit(bounds[c][3]),
                                  "outlier_count": F.coalesce(F.col(f"o{i}"), F.lit(0)).cast("bigint"),
                                  "non_null": F.col(f"n{i}").cast("bigint")})
                             for i, c in enumerate(cols)])
    long = long.withColumn("outlier_ratio", F.round(F.col("outlier_count") / F.greatest(F.col("non_null"), F.lit(1)), 4))
    return long if keep_zero else long.where(F.col("outlier_count") > 0)


def negative_values(df: DataFrame, target: str | None = None) -> DataFrame:
    """``(column, negative_count)`` for numeric columns whose name suggests
    a non-negative quantity and that hold negatives."""
    cols = [c for c in numeric_cols_for_quality(df, exclude=(target,))
            if any(h in c.lower() for h in NON_NEGATIVE_NAME_HINTS)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, negative_count bigint")
    row = df.agg(*[F.sum((F.col(c) < 0).cast("bigint")).alias(f"n{i}") for i, c in enumerate(cols)])
    long = unpivot_row(row, [(c, {"negative_count": F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint")})
                             for i, c in enumerate(cols)])
    return long.where(F.col("negative_count") > 0)


def accuracy(df: DataFrame, target: str | None = None, exact="auto") -> DataFrame:
    """One row ``numeric_columns, outlier_columns, score`` with
    score = 1 − mean over numeric features of the (4dp) outlier ratio."""
    ncols = len(numeric_cols_for_quality(df, exclude=(target,)))
    o = outlier_summary(df, target, exact=exact)
    return o.agg(F.count(F.lit(1)).cast("bigint").alias("outlier_columns"),
                 F.coalesce(F.sum("outlier_ratio"), F.lit(0.0)).alias("s")).select(
        F.lit(ncols).cast("bigint").alias("numeric_columns"), "outlier_columns",
        F.round(F.lit(1.0) - F.col("s") / F.lit(float(max(ncols, 1))), 4).alias("score"))


# ---------------------------------------------------------------- timeliness
def _as_of(as_of) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def future_dates(df: DataFrame, as_of=None, target: str | None = None) -> DataFrame:
    """``(column, future_dates)`` per datetime column (all of them)."""
    cols = datetime_columns(df, exclude=(target,))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, future_dates bigint")
    t = _as_of(as_of)
    row = df.agg(*[F.sum((F.col(c).cast("timestamp") > t).cast("bigint")).alias(f"f{i}") for i, c in enumerate(cols)])
    return unpivot_row(row, [(c, {"future_dates": F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("bigint")})
                             for i, c in enumerate(cols)])


def timeliness(df: DataFrame, as_of=None, target: str | None = None) -> DataFrame:
    """One row ``datetime_columns, future_dates, score``."""
    cols = datetime_columns(df, exclude=(target,))
    n = df.select(F.count(F.lit(1)).alias("n"))
    if not cols:
        return n.select(F.lit(0).cast("bigint").alias("datetime_columns"),
                        F.lit(0).cast("bigint").alias("future_dates"), F.lit(1.0).alias("score"))
    t = _as_of(as_of)
    fut = reduce(lambda a, b: a + b, [F.coalesce(F.sum((F.col(c).cast("timestamp") > t).cast("bigint")), F.lit(0))
                                      for c in cols])
    r = df.agg(F.count(F.lit(1)).alias("n"), fut.alias("fut"))
    return r.select(F.lit(len(cols)).cast("bigint").alias("datetime_columns"), F.col("fut").cast("bigint").alias("future_dates"),
                    F.round(F.lit(1.0) - F.col("fut") / F.greatest(F.col("n") * F.lit(len(cols)), F.lit(1)), 4).alias("score"))


# ---------------------------------------------------------------- validity
def rare_values(df: DataFrame, target: str | None = None, n_examples: int = 5) -> DataFrame:
    """C11: per string feature, values that occur exactly once (null counts as a
    value): ``(column, rare_values_count, examples)`` with the smallest
    ``n_examples`` values as a comma-separated list. One shuffle for all columns."""
    cols = string_columns(df, exclude=(target,))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rare_values_count bigint, examples string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    vc = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    singles = vc.where(F.col("cnt") == 1)
    counts = singles.groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("rare_values_count"))
    # examples: the smallest few singleton values, via a salted two-stage top-k
    ex = (top_k_per_group(singles.where(F.col("value").isNotNull()), ["column"], ["value"], n_examples)
          .groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("examples")))
    return counts.join(ex, "column", "left").select(
        "column", "rare_values_count", F.coalesce(F.col("examples"), F.lit("")).alias("examples"))


def validity(df: DataFrame, target: str | None = None) -> DataFrame:
    """C11: one row ``rare_values, score``."""
    cols = string_columns(df, exclude=(target,))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    if not cols:
        return n.select(F.lit(0).cast("bigint").alias("rare_values"), F.lit(1.0).alias("score"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    vc = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    r = vc.agg(F.sum((F.col("cnt") == 1).cast("bigint")).alias("rare"),
               (F.sum("cnt") / F.lit(len(cols))).alias("n"))
    rare = F.coalesce(F.col("rare"), F.lit(0))
    return r.select(rare.cast("bigint").alias("rare_values"),
                    F.round(F.lit(1.0) - rare / F.greatest(F.col("n"), F.lit(1.0)), 4).alias("score"))


# ---------------------------------------------------------------- target
def target_analysis(df: DataFrame, target: str) -> DataFrame:
    """``(value, count)`` class distribution plus a summary row with
    ``value = null``: type categorical when string or ≤10 distinct values."""
    is_str = is_string(df.schema[target].dataType)
    g = df.groupBy(target).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    summary = g.agg(F.sum(F.when(F.col(target).isNull(), F.col("count"))).alias("missing"),
                    F.count(F.col(target)).alias("nunique"))
    kind = F.when(F.lit(is_str) | (F.col("nunique") <= 10), F.lit("categorical")).otherwise(F.lit("numeric"))
    return summary.select(kind.alias("type"), F.coalesce(F.col("missing"), F.lit(0)).cast("bigint").alias("missing_count"),
                          F.col("nunique").cast("bigint").alias("unique_values"))


# ---------------------------------------------------------------- report
def quality_scores(df: DataFrame, target: str | None = None, as_of=None, exact="auto",
                   max_rows: int | None = None) -> DataFrame:
    """``(dimension, score)`` for the six dimensions plus ``overall``
    (mean of the six, 4dp), from the fused passes of :func:`quality_passes`."""
    df = cap_rows(df, max_rows)
    return fused_scores(quality_passes(df, target, as_of, exact))


def quality_warnings(df: DataFrame, target: str | None = None, as_of=None, exact="auto") -> DataFrame:
    """C14: triggered warning rules ``(rule, columns, count)``; ``columns`` is a
    sorted comma-separated list (empty for count-only rules). Every rule is a
    conditional aggregate over the fused per-column tables of
    :func:`quality_passes`, so each of its three scans is consumed once."""
    p = quality_passes(df, target, as_of, exact)
    c, v = p["cols"], p["values"]
    in_ = lambda names: F.col("column").isin(*names) if names else F.lit(False)

    def listed(name: str, cond):
        return [F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("column")))), ",").alias(f"{name}__cols"),
                F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(f"{name}__n")]

    col_rules = {
        "high_missing": F.col("nulls") / F.greatest(F.col("n_rows"), F.lit(1)) > 0.5,
        "constant_columns": in_(p["feats"]) & F.col("constant"),
        "mixed_type_columns": in_(p["strs"]) & (F.col("numeric_like") > 0) & (F.col("numeric_like") < 1),
        "outlier_columns": in_(p["nums"]) & (F.col("outliers") > 0),
        "negative_value_columns": F.col("negatives") > 0,
        "future_date_columns": in_(p["dts"]) & (F.col("future") > 0),
    }
    val_rules = {"rare_category_columns": F.col("singletons") > 0}
    tgt = F.lit(target or "")
    a1 = c.agg(*[x for k, cond in col_rules.items() for x in listed(k, cond)],
               F.max("any_null_rows").alias("rows_with_missing__n"),
               F.max(F.when(F.col("column") == tgt, F.col("nulls"))).alias("target_missing__n"))
    a2 = v.agg(*[x for k, cond in val_rules.items() for x in listed(k, cond)])
    a3 = p["dups"].select(F.col("duplicated_rows").alias("duplicate_rows__n"))
    j = a1.unionByName(a2, allowMissingColumns=True).unionByName(a3, allowMissingColumns=True)
    names = list(j.columns)
    one = j.agg(*[F.max(x).alias(x) for x in names])
    order = ["high_missing", "rows_with_missing", "constant_columns", "mixed_type_columns", "outlier_columns",
             "negative_value_columns", "future_date_columns", "duplicate_rows", "rare_category_columns"]
    if target is not None and target in df.columns:
        order.append("target_missing")
    rows = F.array(*[F.struct(F.lit(r).alias("rule"),
                              (F.col(f"{r}__cols") if f"{r}__cols" in names else F.lit("")).alias("columns"),
                              F.coalesce(F.col(f"{r}__n"), F.lit(0)).cast("bigint").alias("count")) for r in order])
    return one.select(F.inline(rows)).where(F.col("count") > 0)


# ---------------------------------------------------------------- fused report
def quality_passes(df: DataFrame, target: str | None = None, as_of=None, exact="auto") -> dict:
    """The whole six-dimension assessment in three scans (plus the quantile
    pass whose fences become literals):

    * ``cols``   — ONE aggregate, one row per column: nulls, future dates,
                   outliers and non-null count (numeric), negatives (hinted
                   names), numeric-like share (strings);
    * ``values`` — ONE ``(column, value)`` shuffle over the features: distinct
                   counts with/without null and singleton counts;
    * ``dups``   — ONE group-by over all columns: duplicate rows.
    Returns the three small frames plus metadata used by the score/warning views."""
    feats = _features(df, target)
    nums = numeric_cols_for_quality(df, exclude=(target,))
    dts = datetime_columns(df, exclude=(target,))
    strs = string_columns(df, exclude=(target,))
    # the quantile pass (fences) and the duplicate hash pass are independent: run them concurrently
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=2) as pool:
        fb = pool.submit(iqr_bounds, df, nums, exact)
        fd = pool.submit(duplicates, df)
        bounds, dups = fb.result(), fd.result()
    t = _as_of(as_of)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns]).cast("bigint")).alias("any_null")]
    entries = []
    atomic = {f.name for f in df.schema.fields
              if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))}
    for i, c in enumerate(df.columns):
        x = F.col(c)
        e = {"nulls": F.coalesce(F.col(f"z{i}"), F.lit(0)).cast("bigint")}
        aggs.append(F.sum(x.isNull().cast("bigint")).alias(f"z{i}"))
        if c in atomic:
            # at most one distinct value counting null  ⟺  all null, or min = max with no null
            aggs += [F.count(x).alias(f"c{i}"), (F.min(x) == F.max(x)).alias(f"eq{i}")]
            e["constant"] = ((F.col(f"c{i}") == 0) | (F.coalesce(F.col(f"eq{i}"), F.lit(False))
                                                      & (F.coalesce(F.col(f"z{i}"), F.lit(0)) == 0)))
        if c in dts:
            aggs.append(F.sum((x.cast("timestamp") > t).cast("bigint")).alias(f"f{i}"))
            e["future"] = F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("bigint")
        if c in bounds:
            lo, hi = bounds[c][2], bounds[c][3]
            v = x.cast("double")
            aggs += [F.sum(((v < lo) | (v > hi)).cast("bigint")).alias(f"o{i}"), F.count(v).alias(f"nn{i}")]
            e["outliers"] = F.coalesce(F.col(f"o{i}"), F.lit(0)).cast("bigint")
            e["non_null"] = F.col(f"nn{i}").cast("bigint")
        if c in nums and any(h in c.lower() for h in NON_NEGATIVE_NAME_HINTS):
            aggs.append(F.sum((x < 0).cast("bigint")).alias(f"neg{i}"))
            e["negatives"] = F.coalesce(F.col(f"neg{i}"), F.lit(0)).cast("bigint")
        if c in strs:
            v = F.expr(f"try_cast(`{c}` as double)")
            aggs.append(F.avg(F.when(x.isNotNull(), (v.isNotNull() & ~F.isnan(v)).cast("double"))).alias(f"r{i}"))
            e["numeric_like"] = F.col(f"r{i}")
        entries.append((c, e))
    row = df.agg(*aggs)
    fields = ["nulls", "future", "outliers", "non_null", "negatives"]
    full = []
    for c, e in entries:
        d = {k: e.get(k, F.lit(None).cast("bigint")) for k in fields}
        d["numeric_like"] = e.get("numeric_like", F.lit(None).cast("double"))
        d["constant"] = e.get("constant", F.lit(False))
        d["n_rows"] = F.col("n").cast("bigint")
        d["any_null_rows"] = F.coalesce(F.col("any_null"), F.lit(0)).cast("bigint")
        full.append((c, d))
    cols = unpivot_row(row, full)
    # singleton values only matter for string features: one shuffle over those alone
    if strs:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in strs])
        vc = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        values = vc.groupBy("column").agg(F.sum((F.col("cnt") == 1).cast("bigint")).alias("singletons"))
    else:
        values = df.sparkSession.createDataFrame([], "column string, singletons bigint")
    return {"cols": cols, "values": values, "dups": dups, "feats": feats, "nums": nums, "dts": dts, "strs": strs,
            "target": target, "bounds": bounds, "ncols": len(df.columns)}


def fused_scores(p: dict) -> DataFrame:
    """C13 from :func:`quality_passes`: ``(dimension, score)`` + overall."""
    feats, nums, dts, strs = p["feats"], p["nums"], p["dts"], p["strs"]
    c = p["cols"]
    v = p["values"]
    ncol = p["ncols"]
    nf, nn, nd = max(len(feats), 1), max(len(nums), 1), len(dts)
    ratio = F.round(F.col("outliers") / F.greatest(F.col("non_null"), F.lit(1)), 4)
    per_col = c.agg(
        F.first("n_rows").alias("n"), F.sum("nulls").alias("cells"),
        F.sum(F.when(F.col("column").isin(*feats) & F.col("constant"), 1).otherwise(0)).alias("const"),
        F.sum(F.when(F.col("column").isin(*dts), F.col("future"))).alias("fut"),
        F.sum(F.when(F.col("column").isin(*nums) & (F.col("outliers") > 0), ratio)).alias("oratio"),
        F.sum(F.when(F.col("column").isin(*strs) & (F.col("numeric_like") > 0) & (F.col("numeric_like") < 1), 1)
              .otherwise(0)).alias("mixed"))
    per_val = v.agg(F.sum("singletons").alias("rare"))
    dups = p["dups"].select(F.col("score").alias("uniq"))
    j = per_col.unionByName(per_val, allowMissingColumns=True).unionByName(dups, allowMissingColumns=True)
    s = j.agg(*[F.max(x).alias(x) for x in ("n", "cells", "fut", "oratio", "mixed", "const", "rare", "uniq")])
    n = F.greatest(F.col("n"), F.lit(1))
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    dims = [("completeness", F.round(1 - z("cells") / (n * ncol), 4)),
            ("consistency", F.round(1 - (z("const") + z("mixed")) / F.lit(float(nf)), 4)),
            ("accuracy", F.round(1 - z("oratio") / F.lit(float(nn)), 4)),
            ("timeliness", F.round(1 - z("fut") / F.greatest(F.col("n") * nd, F.lit(1)), 4) if nd else F.lit(1.0)),
            ("uniqueness", F.col("uniq")),
            ("validity", F.round(1 - z("rare") / n, 4))]
    arr = F.array(*[F.struct(F.lit(d).alias("dimension"), e.cast("double").alias("score")) for d, e in dims])
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x["score"])
    overall = F.struct(F.lit("overall").alias("dimension"), F.round(total / F.lit(6.0), 4).alias("score"))
    return s.select(F.inline(F.concat(arr, F.array(overall))))


def chart_data(df: DataFrame, target: str | None = None, top: int = 20) -> dict[str, DataFrame]:
    """The report's chart tables: missing rates above zero (top ``top``,
    descending), outlier counts (descending) and the target distribution."""
    out = {"missing": missing_rates(df).where(F.col("missing_rate") > 0)
                                      .orderBy(F.col("missing_rate").desc(), "column").limit(top),
           "outliers": outlier_summary(df, target).select("column", "outlier_count")
                                                  .orderBy(F.col("outlier_count").desc(), "column")}
    if target and target in df.columns:
        out["target"] = df.groupBy(target).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return out
