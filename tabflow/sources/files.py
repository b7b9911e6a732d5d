"""File sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.columns import normalize_missing

SUPPORTED = (".csv", ".parquet", ".json", ".jsonl")


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """True when every line of the file(s) is valid UTF-8 (distributed scan that
    stops at the first invalid line)."""
    bad = spark.read.text(path).where(~F.is_valid_utf8(F.col("value"))).limit(1)
    return bad.count() == 0


def read_table(spark: SparkSession, path: str, fmt: str | None = None, infer_schema: bool = True,
               schema=None) -> DataFrame:
    """A1-A4: dispatch on the extension (or ``fmt``). CSV is read as UTF-8,
    or as GBK when it is not valid UTF-8; ``.json`` and ``.jsonl`` are both
    line-delimited. NaN is normalised to null."""
    ext = fmt or os.path.splitext(path.rstrip("/"))[1].lower()
    if not ext.startswith("."):
        ext = "." + ext
    if ext not in SUPPORTED:
        raise ValueError(f"unsupported file format: {ext}")
    if ext == ".csv":
        enc = "UTF-8" if _is_utf8(spark, path) else "GBK"
        if enc == "GBK":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        r = spark.read.option("header", True).option("encoding", enc)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", infer_schema)
        df = r.csv(path)
    elif ext == ".parquet":
        df = spark.read.parquet(path)
    else:
        r = spark.read.schema(schema) if schema is not None else spark.read
        df = r.json(path)
    return normalize_missing(df)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> str:
    """A10: one Parquet table; ``partition_by="split"`` keeps train/val/test in
    one table (partition pruning serves each part)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header (leaderboards, importances, predictions)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Long-format report tables as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows with every value as text and nulls as ''."""
    d = df.orderBy(*order_by) if order_by else df
    return d.limit(n).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def artifact_preview(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows plus ``total_rows`` and ``truncated`` (total > n)."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    d = (df.orderBy(*order_by) if order_by else df).limit(n)
    # the one-row total is attached without a join key: union then max over the window of the head
    from pyspark.sql import Window
    both = d.withColumn("_tf_k", F.lit(0)).unionByName(total.withColumn("_tf_k", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(F.lit(0))
    out = both.withColumn("total_rows", F.max("total_rows").over(w)).where(F.col("_tf_k") == 0)
    return out.withColumn("truncated", F.col("total_rows") > n).drop("_tf_k")


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-insensitive content fingerprint ``(n_rows, digest)``: the sum
    of the first 60 bits of each row's md5 (as an exact decimal), so equal
    multisets of rows give equal digests regardless of partitioning."""
    cols = cols or df.columns
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in cols]))
    v = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum(v).cast("string").alias("digest"))


def metrics_long(df: DataFrame, id_col: str, metric_cols: list[str]) -> DataFrame:
    """Wide per-run metrics → ``(run_id, metric_name, metric_value)``."""
    return df.unpivot([id_col], metric_cols, "metric_name", "metric_value").withColumnRenamed(id_col, "run_id")
