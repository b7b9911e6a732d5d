"""Cleaning, filters and imputation.

Fit-style operators learn a few values with one aggregate and return them
(small dicts); transforms are single ``select`` projections over the frame.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import is_datetime, is_numeric, numeric_columns, string_columns
from tabflow.functions.ranking import top_k_per_group
from tabflow.operators.stats import numeric_moments, quantiles

MISSING_DROP_THRESHOLD = 0.5
SKEW_THRESHOLD = 1.0


DUP_HASH_BROADCAST_MAX = 1_000_000


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed.

    Hash first: 64-bit row hashes are counted (8 bytes per row cross the
    shuffle); rows whose hash is unique cannot have a duplicate and pass through
    a broadcast anti-join untouched, and only rows whose hash repeats are
    de-duplicated exactly by ``dropDuplicates``. With more than 1M repeated
    hashes the plain ``dropDuplicates`` is used."""
    cols = df.columns
    from tabflow.operators.quality import _hash_input
    hashed = df.withColumn("_tf_rh", F.xxhash64(*[_hash_input(df, c) for c in cols]))
    rep = hashed.groupBy("_tf_rh").agg(F.count(F.lit(1)).alias("_tf_n")).where(F.col("_tf_n") > 1).select("_tf_rh")
    n_rep = rep.limit(DUP_HASH_BROADCAST_MAX + 1).count()
    if n_rep > DUP_HASH_BROADCAST_MAX:
        return df.dropDuplicates()
    if n_rep == 0:
        return df
    b = F.broadcast(rep)
    unique = hashed.join(b, "_tf_rh", "left_anti").drop("_tf_rh")
    repeated = hashed.join(b, "_tf_rh", "left_semi").drop("_tf_rh").dropDuplicates()
    return unique.unionByName(repeated)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """D2."""
    return df.where(F.col(target).isNotNull())


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """D4."""
    return df.drop(*[c for c in cols if c in df.columns])


def range_constraint(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Values outside ``[min, max]`` (either end optional) become null."""
    out = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            ok = F.lit(True)
            if lo is not None:
                ok = ok & (F.col(c) >= F.lit(lo))
            if hi is not None:
                ok = ok & (F.col(c) <= F.lit(hi))
            out.append(F.when(ok, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fit_high_missing(df: DataFrame, threshold: float = MISSING_DROP_THRESHOLD, target: str | None = None) -> list[str]:
    """D3 fit: columns (target excluded) whose missing rate exceeds the threshold."""
    cols = [c for c in df.columns if c != target]
    if not cols:
        return []
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if (row[f"m{i}"] or 0.0) > threshold]


def drop_high_missing_columns(df: DataFrame, threshold: float = MISSING_DROP_THRESHOLD, target: str | None = None,
                              learned: list[str] | None = None) -> DataFrame:
    """D3 transform (learned on train only when ``learned`` is given)."""
    drop = learned if learned is not None else fit_high_missing(df, threshold, target)
    return df.drop(*drop)


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, mode)``: most frequent non-null value, smallest on ties.
    Values are counted with one partially aggregated shuffle and the top-1 per
    column is taken with the salted two-stage top-k (no group is sorted whole)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    vc = (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))
    return top_k_per_group(vc, ["column"], [F.col("cnt").desc(), F.col("value").asc()], 1).select(
        "column", F.col("value").alias("mode"))


def fit_imputer(df: DataFrame, numeric: str = "median", categorical: str = "mode",
                numeric_fill: float = 0.0, categorical_fill: str = "missing", target: str | None = None,
                exact="auto", numeric_default: float | None = None,
                categorical_default: str | None = "missing") -> dict[str, object]:
    """D6/D7 fit: fill value per column learned on ``df`` (the training rows).

    numeric: median (exact by default) / mean / constant; categorical: mode /
    constant. ``*_default`` is used when a column is entirely null."""
    fills: dict[str, object] = {}
    ncols = numeric_columns(df, exclude=(target,))
    scols = string_columns(df, exclude=(target,))
    if ncols:
        if numeric == "median":
            q = quantiles(df, ncols, [0.5], exact=exact)
            for c in ncols:
                v = q[c][0]
                fills[c] = v if v is not None else numeric_default
        elif numeric == "mean":
            m = numeric_moments(df, ncols)
            for c in ncols:
                fills[c] = m[c]["mean"] if m[c]["mean"] is not None else numeric_default
        elif numeric == "constant":
            for c in ncols:
                fills[c] = numeric_fill
        else:
            raise ValueError(f"unknown numeric strategy {numeric}")
    if scols:
        if categorical == "mode":
            got = {r["column"]: r["mode"] for r in modes(df, scols).collect()}  # one row per column
            for c in scols:
                fills[c] = got.get(c, categorical_default)
        elif categorical == "constant":
            for c in scols:
                fills[c] = categorical_fill
        else:
            raise ValueError(f"unknown categorical strategy {categorical}")
    return {c: v for c, v in fills.items() if v is not None}


def apply_fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """D6/D7 transform: ``coalesce(c, fill)`` keeping each column's type."""
    out = []
    for f in df.schema.fields:
        if f.name in fills:
            out.append(F.coalesce(F.col(f.name), F.lit(fills[f.name]).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def clean_dataframe(df: DataFrame, target: str | None = None) -> DataFrame:
    """Dedupe + drop null target (only when the target is present), median
    fill (0 when all null), mode fill ("unknown" when all null)."""
    if target and target in df.columns:
        df = drop_duplicates(df)
        df = drop_null_target(df, target)
    fills = fit_imputer(df, "median", "mode", target=target, numeric_default=0.0, categorical_default="unknown")
    return apply_fill(df, fills)


def sample_skewness(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Adjusted sample skewness G1 per column from one moments aggregate."""
    m = numeric_moments(df, cols)
    out = {}
    for c in cols:
        n, g1 = m[c]["n"], m[c]["skew_pop"]
        out[c] = g1 * math.sqrt(n * (n - 1)) / (n - 2) if (g1 is not None and n and n > 2 and not math.isnan(g1)) else None
    return out


def fit_log_columns(df: DataFrame, threshold: float = SKEW_THRESHOLD, target: str | None = None) -> list[str]:
    """D9 fit: non-negative numeric columns whose sample skewness exceeds the threshold."""
    cols = numeric_columns(df, exclude=(target,))
    if not cols:
        return []
    m = numeric_moments(df, cols)
    sk = sample_skewness(df, cols)
    return [c for c in cols if m[c]["min"] is not None and m[c]["min"] >= 0 and (sk[c] or 0.0) > threshold]


def add_log_columns(df: DataFrame, cols: list[str], clip_negative: bool = True) -> DataFrame:
    """D9 transform: ``{c}_log = log1p(max(c, 0))`` (null stays null)."""
    def lg(c):
        x = F.col(c).cast("double")
        return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.log1p(F.greatest(x, F.lit(0.0)) if clip_negative else x))
    return df.select("*", *[lg(c).alias(f"{c}_log") for c in cols])


def _type_class(dt) -> str:
    if is_numeric(dt, include_bool=True):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    return "other"


def scoring_schema_problems(have: T.StructType, fitted: T.StructType) -> list[str]:
    """D10 from the two schemas alone (no scan): absent columns, numeric columns
    that arrive as something else, categorical columns that arrive as numbers."""
    kinds = {f.name: _type_class(f.dataType) for f in have.fields}
    out = []
    for f in fitted.fields:
        want, got = _type_class(f.dataType), kinds.get(f.name)
        if got is None:
            out.append(f"missing column {f.name}")
        elif "numeric" in (want, got) and want != got:
            out.append(f"{f.name} should be {want}, is {got}")
    return out


def validate_scoring_input(df: DataFrame, fitted: T.StructType) -> DataFrame:
    """Compare a scoring frame with the raw schema seen at fit time:
    ``(column, problem, expected, actual, rows)``; ``rows`` counts the rows the
    problem affects (all rows for a missing column, rows whose value does not
    parse as a number for a numeric column that arrives as text, rows with a value
    for a categorical column that arrives as numbers). Empty = valid.
    One aggregate over the scoring frame."""
    have = {f.name: f.dataType for f in df.schema.fields}
    entries = []
    for f in fitted.fields:
        if f.name not in have:
            entries.append((f.name, "missing_column", _type_class(f.dataType), "absent", F.count(F.lit(1))))
        elif _type_class(f.dataType) == "numeric" and _type_class(have[f.name]) != "numeric":
            x = F.col(f.name)
            bad = F.sum((x.isNotNull() & F.expr(f"try_cast(`{f.name}` as double)").isNull()).cast("bigint"))
            entries.append((f.name, "type_mismatch", "numeric", _type_class(have[f.name]), bad))
        elif _type_class(f.dataType) == "other" and _type_class(have[f.name]) == "numeric":
            entries.append((f.name, "type_mismatch", "other", "numeric", F.count(f.name)))
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, problem string, expected string, actual string, rows bigint")
    row = df.agg(*[e[4].cast("bigint").alias(f"r{i}") for i, e in enumerate(entries)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(p).alias("problem"),
                                                  F.lit(ex).alias("expected"), F.lit(ac).alias("actual"),
                                                  F.col(f"r{i}").alias("rows"))
                                         for i, (n, p, ex, ac, _) in enumerate(entries)])))
