"""Logical types, target/task inference, cardinality and profiles.

``column_profile`` is the shared core: one aggregate over the table (counts,
date-parse ratios, lengths) plus the value-count shuffle for distinct counts,
joined as two small per-column tables. Every rule afterwards is a Column
expression over that small profile, so the decisions stay lazy Spark work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import (is_boolean, is_datetime, is_integral, is_numeric, is_string,
                                       parse_datetime_string)
from tabflow.operators.stats import distinct_counts, unpivot_row, value_keys

# Name fragments that mark identifier columns.
ID_NAME_PATTERNS = ("id", "idx", "index", "key", "uuid", "serial", "code", "no", "num",
                    "编号", "序号", "编码", "单号", "流水号", "标识", "主键", "键")
# Name fragments that mark a likely prediction target.
TARGET_NAME_KEYWORDS = ("target", "label", "y", "class", "outcome", "prediction", "predict",
                        "is_", "has_", "will_", "flag", "churn", "default", "fraud", "spam",
                        "risk", "score", "grade", "category",
                        "目标", "标签", "是否", "类别", "分类", "结果", "预测", "违约",
                        "流失", "欺诈", "风险", "等级", "评分", "类型", "状态")
DATE_STRING_THRESHOLD = 0.7
SEQUENTIAL_THRESHOLD = 0.95


def looks_like_id(name: str, match: str = "substring") -> bool:
    """Identifier-like column name (substring match, as the reference; or
    whole-token match with ``match="token"``)."""
    low = name.lower()
    if match == "token":
        import re
        toks = set(t for t in re.split(r"[^0-9a-z一-鿿]+", low) if t)
        return any(p in toks for p in ID_NAME_PATTERNS)
    return any(p in low for p in ID_NAME_PATTERNS)


def name_score(name: str) -> float:
    """+1 for a target keyword, −1 for an identifier keyword, else 0."""
    low = name.lower()
    if any(k in low for k in TARGET_NAME_KEYWORDS):
        return 1.0
    if any(k in low for k in ID_NAME_PATTERNS):
        return -1.0
    return 0.0


def _kind(dt) -> str:
    if is_datetime(dt):
        return "datetime"
    if is_boolean(dt):
        return "bool"
    if is_integral(dt):
        return "integer"
    if is_numeric(dt):
        return "float"
    if is_string(dt):
        return "string"
    return "other"


def _sequence_share() -> Column:
    """Distinct values whose successor occurs, over rows - 1, from :func:`value_keys`."""
    hits = F.count_if((F.col("own") > 0) & (F.col("next") > 0) & ~F.col("missing"))
    rows = F.sum(F.when(~F.col("missing"), F.col("own")))
    return F.when(rows > 1, hits / (rows - 1)).otherwise(F.lit(0.0))


def sequential_ratio(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, seq_ratio)`` = share of consecutive sorted non-null values
    that differ by exactly 1, i.e. distinct values v with v+1 present over
    (non-null count − 1). One shuffle, in which every value also marks the one before
    it: no sort, no self-join."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, seq_ratio double")
    return value_keys(df, cols, tuple(cols)).groupBy("column").agg(_sequence_share().alias("seq_ratio"))


def column_profile(df: DataFrame, cols: list[str] | None = None, approx_distinct: bool = False) -> DataFrame:
    """Per column: ``column, idx, kind, n_rows, non_null, nunique, unique_ratio,
    missing_rate, date_ratio, avg_len, min_len, max_len, id_name, seq_ratio``."""
    cols = list(cols if cols is not None else df.columns)
    kinds = {c: _kind(df.schema[c].dataType) for c in cols}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs.append(F.count(x).alias(f"nn{i}"))
        if kinds[c] == "string":
            aggs.append(F.avg(F.when(x.isNotNull(), parse_datetime_string(x).isNotNull().cast("double"))).alias(f"dr{i}"))
            aggs.append(F.avg(F.length(x)).alias(f"al{i}"))
            aggs.append(F.min(F.length(x)).alias(f"mi{i}"))
            aggs.append(F.max(F.length(x)).alias(f"ma{i}"))
    row = df.agg(*aggs)

    def opt(name, i, cast="double"):
        return F.col(f"{name}{i}").cast(cast) if kinds[cols[i]] == "string" else F.lit(None).cast(cast)
    base = unpivot_row(row, [(c, {"idx": F.lit(i), "kind": F.lit(kinds[c]), "n_rows": F.col("n").cast("bigint"),
                                  "non_null": F.col(f"nn{i}").cast("bigint"), "date_ratio": opt("dr", i),
                                  "avg_len": opt("al", i), "min_len": opt("mi", i, "bigint"),
                                  "max_len": opt("ma", i, "bigint"), "id_name": F.lit(looks_like_id(c))})
                             for i, c in enumerate(cols)])
    ints = [c for c in cols if kinds[c] == "integer"]
    if approx_distinct:
        dc = distinct_counts(df, cols, approx=True).select("column", "nunique")
        prof = base.join(dc, "column", "left").join(sequential_ratio(df, ints), "column", "left")
    else:
        # one shuffle of 8-byte keys gives both the distinct counts and the sequential check
        dc = value_keys(df, cols, tuple(ints)).groupBy("column").agg(
            F.count_if((F.col("own") > 0) & ~F.col("missing")).cast("bigint").alias("nunique"), _sequence_share().alias("_seq"))
        prof = base.join(dc.withColumn("seq_ratio", F.when(F.col("column").isin(*ints), F.col("_seq"))).drop("_seq"), "column", "left")
    return prof.select("column", "idx", "kind", "n_rows", "non_null", "nunique",
                       (F.col("nunique") / F.greatest(F.col("n_rows"), F.lit(1))).alias("unique_ratio"),
                       (F.lit(1.0) - F.col("non_null") / F.greatest(F.col("n_rows"), F.lit(1))).alias("missing_rate"),
                       "date_ratio", "avg_len", "min_len", "max_len", "id_name",
                       F.coalesce(F.col("seq_ratio"), F.lit(0.0)).alias("seq_ratio"))


def field_type_expr(use_name: bool = True) -> Column:
    """B1 as a Column over a ``column_profile`` row."""
    k, nu, n, r = F.col("kind"), F.col("nunique"), F.col("n_rows"), F.col("unique_ratio")
    idn = F.col("id_name") if use_name else F.lit(False)
    cutoff = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(n * 0.05).cast("bigint")))
    numeric = (F.when((k == "integer") & (r > 0.9) & (idn | (F.col("seq_ratio") > SEQUENTIAL_THRESHOLD)), "id")
               .when(nu == 2, "binary").when(nu <= cutoff, "categorical").otherwise("numeric"))
    other = (F.when(nu == 2, "binary")
             .when(((nu > 100000) | ((r > 0.95) & (nu > 10000))) & (idn | (r > 0.99)), "id")
             .when((r > 0.5) & (nu > 100), "text").otherwise("categorical"))
    return (F.when(k == "datetime", "datetime")
            .when((k == "string") & (F.coalesce(F.col("date_ratio"), F.lit(0.0)) >= DATE_STRING_THRESHOLD), "datetime")
            .when(k.isin("integer", "float", "bool"), numeric)
            .when(k == "other", F.lit(None).cast("string"))
            .otherwise(other))


def field_types(df: DataFrame, use_name: bool = True, profile: DataFrame | None = None) -> DataFrame:
    """B1: ``(column, field_type)``."""
    p = profile if profile is not None else column_profile(df)
    return p.select("column", field_type_expr(use_name).alias("field_type"))


def high_cardinality_columns(df: DataFrame, target: str | None = None, profile: DataFrame | None = None) -> DataFrame:
    """categorical/id/text columns with unique ratio > .3 or > 50,000 values."""
    p = profile if profile is not None else column_profile(df, [c for c in df.columns if c != target])
    ft = field_type_expr(True)
    return (p.where(F.col("column") != F.lit(target or ""))
             .select("column", "nunique", F.col("unique_ratio"), ft.alias("field_type"))
             .where(F.col("field_type").isin("categorical", "id", "text")
                    & ((F.col("unique_ratio") > 0.3) | (F.col("nunique") > 50000)))
             .select("column", "nunique", "unique_ratio"))


def target_candidates(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """B11 scoring table ``(column, idx, score)`` (identifier names and
    constant columns removed)."""
    p = profile if profile is not None else column_profile(df)
    ns = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(name_score(c)))])
    s = (F.lit(0.5) + ns[F.col("column")] * 0.4
         - F.when(F.col("idx") == 0, 0.15).otherwise(0.0)
         - F.when(F.col("missing_rate") > 0.5, 0.3).when(F.col("missing_rate") > 0.2, 0.1).otherwise(0.0)
         - F.when(F.col("unique_ratio") > 0.95, 0.4).when(F.col("unique_ratio") > 0.8, 0.2).otherwise(0.0)
         + F.when((F.col("nunique") >= 2) & (F.col("nunique") <= 100), 0.1).otherwise(0.0))
    return (p.where((ns[F.col("column")] >= 0) & (F.col("nunique") > 1))
             .select("column", "idx", s.alias("score")))


def infer_target(df: DataFrame, hint: str | None = None, profile: DataFrame | None = None) -> DataFrame:
    """One row ``(target, confidence)``; a valid hint wins with 1.0."""
    spark = df.sparkSession
    if hint and hint in df.columns:
        return spark.range(1).select(F.lit(hint).alias("target"), F.lit(1.0).alias("confidence"))
    c = target_candidates(df, profile)
    return (c.orderBy(F.col("score").desc(), F.col("idx").asc()).limit(1)
             .select(F.col("column").alias("target"),
                     F.round(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)), 4).alias("confidence")))


def task_type_expr() -> Column:
    """B12 as a Column over a profile row with ``field_type``."""
    nu, ft = F.col("nunique"), F.col("field_type")
    return (F.when(nu <= 2, "binary_classification")
            .when(ft == "numeric", F.when(nu > 10, "regression").otherwise("multiclass_classification"))
            .otherwise("multiclass_classification"))


def task_types(df: DataFrame, cols: list[str] | None = None, profile: DataFrame | None = None) -> DataFrame:
    """B12 for every candidate column: ``(target, field_type, nunique, task_type)``."""
    p = profile if profile is not None else column_profile(df, cols)
    return (p.select(F.col("column").alias("target"), field_type_expr(True).alias("field_type"), "nunique")
             .select("target", "field_type", "nunique", task_type_expr().alias("task_type")))


def infer_task_type(df: DataFrame, target: str, profile: DataFrame | None = None) -> DataFrame:
    """One row ``(target, field_type, nunique, task_type)``."""
    return task_types(df, [target], profile).where(F.col("target") == target)


def target_distribution(df: DataFrame, target: str, categorical: bool) -> DataFrame:
    """Class counts, or ``mean, std (sample), min, max``."""
    if categorical:
        return df.groupBy(target).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    x = F.col(target).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def profile_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """The long profile used by the strategy rules:
    ``column, field_type, missing_rate, nunique, unique_ratio, is_target``."""
    p = column_profile(df)
    return p.select("column", field_type_expr(True).alias("field_type"), "missing_rate", "nunique", "unique_ratio",
                    (F.col("column") == F.lit(target or "")).alias("is_target"))


def column_roles(df: DataFrame, target: str | None = None) -> DataFrame:
    """Feature roles numeric / datetime / text (unique ratio > .5 and mean
    length > 15) / categorical, from dtypes and one aggregate."""
    cols = [c for c in df.columns if c != target]
    p = column_profile(df, cols)
    k = F.col("kind")
    role = (F.when(k.isin("integer", "float", "bool"), "numeric").when(k == "datetime", "datetime")
            .when((k == "string") & (F.col("unique_ratio") > 0.5) & (F.col("avg_len") > 15), "text")
            .when(k == "string", "categorical"))
    return p.select("column", role.alias("role")).where(F.col("role").isNotNull())


def id_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Names of identifier columns (field type ``id``); small driver list."""
    ft = field_types(df, use_name=True).where(F.col("field_type") == "id").collect()
    return [r["column"] for r in ft if r["column"] != target]


def drop_id_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.drop(*id_columns(df, target))


def trainability(df: DataFrame, target: str, task: str, min_rows: int = 10, multiclass_min: int = 2) -> DataFrame:
    """``(check, passed, observed)`` rows; ``passed=false`` are errors,
    the ``small_classes`` row is a warning."""
    is_cls = task != "regression"
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("cnt"))
    s = g.agg(F.sum("cnt").cast("bigint").alias("n"), F.count(F.col(target)).cast("bigint").alias("k"),
              F.sum(F.when(F.col(target).isNotNull(), F.col("cnt"))).cast("bigint").alias("nn"),
              F.sum(F.when(F.col(target).isNotNull() & (F.col("cnt") < 2), 1).otherwise(0)).cast("bigint").alias("small"))
    nfeat = len(df.columns) - 1
    numeric_target = is_numeric(df.schema[target].dataType)
    rows = [
        ("min_rows", F.col("n") >= min_rows, F.col("n")),
        ("has_features", F.lit(nfeat >= 1), F.lit(nfeat).cast("bigint")),
        ("target_not_all_null", F.coalesce(F.col("nn"), F.lit(0)) > 0, F.coalesce(F.col("nn"), F.lit(0))),
    ]
    if is_cls:
        rows.append(("more_than_one_class", F.col("k") > 1, F.col("k")))
        if task == "binary_classification":
            rows.append(("binary_two_classes", F.col("k") == 2, F.col("k")))
        else:
            rows.append(("multiclass_classes", F.col("k") >= multiclass_min, F.col("k")))
        rows.append(("small_classes", F.col("small") == 0, F.col("small")))
    else:
        rows.append(("regression_numeric_target", F.lit(numeric_target), F.lit(1 if numeric_target else 0).cast("bigint")))
    return s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), p.alias("passed"), o.cast("bigint").alias("observed"))
                                       for n, p, o in rows])))
