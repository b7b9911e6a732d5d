"""Schema constraints: learn, validate, row violations, align."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import is_datetime, is_numeric, is_string, parse_datetime_string
from tabflow.functions.ranking import top_k_per_group
from tabflow.operators.infer import column_profile, field_type_expr
from tabflow.operators.stats import unpivot_row, value_counts_long
from tabflow.session import cut_lineage

ALLOWED_VALUES_CAP = 1000


def infer_schema(df: DataFrame, target: str | None = None, type_sample: int | None = None) -> DataFrame:
    """Per column ``column, field_type, nullable, min_value, max_value,
    min_length, max_length, n_allowed, allowed_values`` (sorted distinct values,
    first 1000, '|'-joined, for categorical/binary; ``n_allowed`` is the number of all
    of them). Datetime min/max are kept
    as timestamps rendered to ``min_value``/``max_value`` epoch seconds."""
    prof = column_profile(df).select("column", "idx", "nunique", field_type_expr(True).alias("field_type"),
                                     (F.col("non_null") < F.col("n_rows")).alias("nullable"), "min_len", "max_len")
    if type_sample:
        # the reference's cost knob: logical types from a reproducible sample of
        # ``type_sample`` rows, constraints (ranges, lengths, values) from all rows
        from tabflow.operators.quality import cap_rows
        sampled = column_profile(cap_rows(df, type_sample)).select(
            "column", field_type_expr(True).alias("_ft_sample"))
        prof = prof.join(sampled, "column").withColumn("field_type", F.col("_ft_sample")).drop("_ft_sample")
    rng_cols = [f.name for f in df.schema.fields if is_numeric(f.dataType) or is_datetime(f.dataType)]
    if rng_cols:
        def num(c):
            x = F.col(c)
            return F.unix_timestamp(x).cast("double") if is_datetime(df.schema[c].dataType) else x.cast("double")
        row = df.agg(*[F.min(num(c)).alias(f"lo{i}") for i, c in enumerate(rng_cols)],
                     *[F.max(num(c)).alias(f"hi{i}") for i, c in enumerate(rng_cols)])
        rng = unpivot_row(row, [(c, {"lo": F.col(f"lo{i}"), "hi": F.col(f"hi{i}")}) for i, c in enumerate(rng_cols)])
    else:
        rng = df.sparkSession.createDataFrame([], "column string, lo double, hi double")
    # values are only collected for the columns that list them
    prof = cut_lineage(prof)
    listed = [r["column"] for r in prof.where(F.col("field_type").isin("categorical", "binary")).select("column").collect()]
    distinct_vals = (value_counts_long(df, listed).where(F.col("value").isNotNull()).select("column", "value") if listed
                     else df.sparkSession.createDataFrame([], "column string, value string"))
    allowed = (top_k_per_group(distinct_vals, ["column"], ["value"], ALLOWED_VALUES_CAP)
               .groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("av")))
    j = prof.join(rng, "column", "left").join(allowed, "column", "left")
    ft = F.col("field_type")
    is_range = ft.isin("numeric", "datetime")
    is_cat = ft.isin("categorical", "binary")
    return j.select("column", "field_type", "nullable",
                    F.when(is_range, F.col("lo")).alias("min_value"), F.when(is_range, F.col("hi")).alias("max_value"),
                    F.when(ft == "text", F.col("min_len")).alias("min_length"),
                    F.when(ft == "text", F.col("max_len")).alias("max_length"),
                    F.when(is_cat, F.col("nunique")).cast("bigint").alias("n_allowed"),
                    F.when(is_cat, F.col("av")).alias("allowed_values"))


def _schema_rows(schema, df: DataFrame | None = None) -> list[dict]:
    """Accept a learned schema DataFrame (one row per column) or a list of dicts;
    fields come back in ``df``'s column order (unknown ones last, by name)."""
    rows = [r.asDict() for r in schema.collect()] if isinstance(schema, DataFrame) else list(schema)  # ≤ #columns
    pos = {c: i for i, c in enumerate(df.columns)} if df is not None else {}
    return sorted(rows, key=lambda f: (pos.get(f["column"], len(pos)), f["column"]))


def validate_against_schema(df: DataFrame, schema) -> DataFrame:
    """``(field, rule, observed, limit)`` error rows (observed/limit as
    doubles, datetimes in epoch seconds): missing column, null in
    a non-nullable field, non-numeric/non-string type for numeric/binary/
    categorical fields, minimum below / maximum above the learned range.
    One aggregate over ``df``."""
    fields = _schema_rows(schema, df)
    spark = df.sparkSession
    have = {f.name: f.dataType for f in df.schema.fields}
    static, aggs, checks = [], [], []
    for f in fields:
        name = f["column"]
        if name not in have:
            static.append((name, "missing_field", None, None))
            continue
        dt = have[name]
        if f["field_type"] in ("numeric", "binary", "categorical") and not (is_numeric(dt, True) or is_string(dt)):
            static.append((name, "type_mismatch", None, None))
        i = len(checks)
        x = F.col(name)
        aggs.append(F.sum(x.isNull().cast("bigint")).alias(f"n{i}"))
        num = (F.unix_timestamp(x).cast("double") if is_datetime(dt) else F.expr(f"try_cast(`{name}` as double)"))
        aggs.append(F.min(num).alias(f"lo{i}"))
        aggs.append(F.max(num).alias(f"hi{i}"))
        checks.append((i, f))
    base = spark.createDataFrame(static, "field string, rule string, observed double, limit double")
    if not checks:
        return base
    row = df.agg(*aggs)
    entries = []
    for i, f in checks:
        if not f["nullable"]:
            entries.append((f["column"], "not_nullable", F.col(f"n{i}") > 0, F.col(f"n{i}").cast("double"), F.lit(0.0)))
        if f.get("min_value") is not None:
            entries.append((f["column"], "below_min", F.col(f"lo{i}") < F.lit(f["min_value"]),
                            F.col(f"lo{i}"), F.lit(float(f["min_value"]))))
        if f.get("max_value") is not None:
            entries.append((f["column"], "above_max", F.col(f"hi{i}") > F.lit(f["max_value"]),
                            F.col(f"hi{i}"), F.lit(float(f["max_value"]))))
    if not entries:
        return base
    found = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"), bad.alias("bad"),
                                                   o.alias("observed"), lim.alias("limit"))
                                          for n, r, bad, o, lim in entries])))
    return base.unionByName(found.where(F.col("bad")).drop("bad"))


def schema_violations(df: DataFrame, schema, key_cols: list[str]) -> DataFrame:
    """The rows that violate the schema: ``key_cols + violations`` where
    ``violations`` is the array of broken ``field:rule`` tags (non-empty only)."""
    fields = _schema_rows(schema, df)
    have = {f.name: f.dataType for f in df.schema.fields}
    tags = []
    for f in fields:
        name = f["column"]
        if name not in have:
            continue
        x = F.col(name)
        dt = have[name]
        num = F.unix_timestamp(x).cast("double") if is_datetime(dt) else F.expr(f"try_cast(`{name}` as double)")
        if not f["nullable"]:
            tags.append(F.when(x.isNull(), F.lit(f"{name}:not_nullable")))
        if f.get("min_value") is not None:
            tags.append(F.when(num < F.lit(f["min_value"]), F.lit(f"{name}:below_min")))
        if f.get("max_value") is not None:
            tags.append(F.when(num > F.lit(f["max_value"]), F.lit(f"{name}:above_max")))
    if not tags:
        return df.select(*key_cols, F.array().cast("array<string>").alias("violations")).limit(0)
    v = F.array_compact(F.array(*tags))
    return df.select(*key_cols, v.alias("violations")).where(F.size("violations") > 0)


def align_to_schema(df: DataFrame, schema) -> DataFrame:
    """Add missing fields (null, or 0 / '' / null timestamp when not
    nullable), coerce numeric and datetime fields (failures → null), turn the
    strings 'nan'/'None' into null for categorical/binary/text fields. One
    projection."""
    fields = _schema_rows(schema, df)
    have = set(df.columns)
    out = [F.col(c) for c in df.columns if c not in {f["column"] for f in fields}]
    for f in fields:
        name, ft = f["column"], f["field_type"]
        if name not in have:
            if f["nullable"]:
                e = F.lit(None).cast("double" if ft == "numeric" else "timestamp" if ft == "datetime" else "string")
            elif ft == "numeric":
                e = F.lit(0.0)
            elif ft in ("categorical", "binary", "text"):
                e = F.lit("")
            elif ft == "datetime":
                e = F.lit(None).cast("timestamp")
            else:
                e = F.lit(None).cast("string")
            out.append(e.alias(name))
            continue
        x = F.col(name)
        dt = df.schema[name].dataType
        if ft == "numeric":
            e = x.cast("double") if is_numeric(dt, True) else F.expr(f"try_cast(`{name}` as double)")
        elif ft == "datetime":
            e = x.cast("timestamp") if is_datetime(dt) else parse_datetime_string(x)
        elif ft in ("categorical", "binary", "text"):
            s = x.cast("string")
            e = F.when(s.isin("nan", "None"), F.lit(None).cast("string")).otherwise(s)
        else:
            e = x
        out.append(e.alias(name))
    return df.select(*out)


def schema_to_json(schema) -> str:
    """Serialise a learned schema (one row per column) to JSON text."""
    import json
    return json.dumps(_schema_rows(schema), default=str)


def schema_from_json(spark, text: str) -> DataFrame:
    """Parse the JSON text back into a schema DataFrame."""
    import json
    rows = json.loads(text)
    cols = "column string, field_type string, nullable boolean, min_value double, max_value double, " \
           "min_length bigint, max_length bigint, n_allowed bigint, allowed_values string"
    return spark.createDataFrame([tuple(r.get(k) for k in ("column", "field_type", "nullable", "min_value", "max_value",
                                                           "min_length", "max_length", "n_allowed", "allowed_values"))
                                  for r in rows], cols)
