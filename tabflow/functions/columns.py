"""Reusable Column expressions.

Everything here builds JVM-side expressions (no Python UDF) so operators stay
inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "SEED", "seeded_hex", "uniform01", "normalize_missing", "clip_null_safe", "round_half_up",
    "numeric_columns", "string_columns", "datetime_columns", "is_numeric", "is_integral",
    "is_string", "is_datetime", "is_boolean", "DATETIME_FORMATS", "parse_datetime_string",
    "sample_skewness_from_pop", "col_list", "TWO_PI",
]

SEED = 42
TWO_PI = 2.0 * math.pi

# date/time layouts accepted when deciding whether a string
# column holds dates (a value counts as a date when any layout parses it).
DATETIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
]
# Guard: a value must start like a date (digits and a separator) before any
# layout is tried, so that "12:30" or "2024-01" never count as dates.
_DATE_GUARD = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"


def col_list(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def seeded_hex(*cols, seed: int = SEED) -> Column:
    """md5 of ``key1-key2-…-seed``; identical in Spark and DuckDB for integer and
    string keys. Used as a reproducible, partition-independent random order."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def uniform01(hex_col: Column) -> Column:
    """Map an md5 hex digest to a uniform double in [0, 1) using its first 32 bits."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn float/double NaN into null once at the source boundary, so every
    later aggregate sees a single notion of missing."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(F.col(f.name)), F.lit(None).cast(f.dataType))
                       .otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def clip_null_safe(c: Column, lo, hi) -> Column:
    """Clip to [lo, hi] keeping nulls null (least/greatest skip nulls)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNull(), c).otherwise(F.least(F.greatest(c, lo_c), hi_c))


def round_half_up(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def sample_skewness_from_pop(g1: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson G1 (pandas/DuckDB ``skewness``) from Spark's
    population skewness g1."""
    nd = n.cast("double")
    return F.when(nd > 2, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2))


def is_boolean(dt) -> bool:
    return isinstance(dt, T.BooleanType)


def is_integral(dt) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_numeric(dt, include_bool: bool = False) -> bool:
    if include_bool and isinstance(dt, T.BooleanType):
        return True
    return isinstance(dt, T.NumericType)


def is_string(dt) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dt) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude=(), include_bool: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType, include_bool) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in exclude]


def parse_datetime_string(c: Column) -> Column:
    """Timestamp parsed with the first matching layout, else null."""
    s = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATETIME_FORMATS])
    return F.when(s.rlike(_DATE_GUARD), parsed)
