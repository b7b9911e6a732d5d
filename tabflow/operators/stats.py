"""One-pass statistics shared by the profiling, quality and feature operators.

Design: every per-column statistic of a table is computed in ONE aggregate
(partial aggregation on each executor, a single tiny final merge), never one
job per column. Distinct-value questions (nunique, singletons, mode, allowed
values) come from one long ``(column, value, cnt)`` table built by one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import is_integral, is_numeric
from tabflow.session import ship_package


def unpivot_row(agg_row_df: DataFrame, entries: list[tuple[str, dict[str, Column]]],
                key: str = "column") -> DataFrame:
    """Turn a one-row aggregate into a long table: one output row per
    ``(name, {field: expr})`` entry (exprs refer to the aggregate's columns)."""
    structs = [F.struct(F.lit(name).alias(key), *[e.alias(k) for k, e in fields.items()])
               for name, fields in entries]
    return agg_row_df.select(F.inline(F.array(*structs)))


def value_counts_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, value, cnt)``: how often each value (as string, null kept)
    occurs in each column. One explode + one partially aggregated shuffle;
    a hot value collapses map-side, so skew does not reach the reducers."""
    cols = list(cols if cols is not None else df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return (df.select(F.inline(pairs))
              .groupBy("column", "value")
              .agg(F.count(F.lit(1)).alias("cnt")))


def value_keys(df: DataFrame, cols: list[str], successors: tuple[str, ...] = ()) -> DataFrame:
    """``(column, missing, key, own, next)``: each column's distinct values by an 8-byte
    key (whole numbers are their own key, other values their 64-bit hash, so that two
    values of a column share one with a chance of about values^2 / 2^65), the rows that
    hold it, and for ``successors`` (whole-number columns) whether a row holds the value
    after it. One scan and one partially aggregated shuffle; values do not travel."""
    def key(c: str) -> Column:
        t = df.schema[c].dataType
        if is_integral(t):
            return F.col(c).cast("bigint")
        if isinstance(t, (T.FloatType, T.DoubleType)):
            return F.xxhash64(F.col(c) + F.lit(0.0).cast(t))    # -0.0 is 0.0, as in grouping
        return F.xxhash64(F.col(c).cast("string") if isinstance(t, (T.MapType, T.VariantType)) else F.col(c))

    rows = []
    for i, c in enumerate(cols):
        null = F.col(c).isNull()
        rows.append(F.struct(F.lit(i).alias("i"), null.alias("missing"), F.when(~null, key(c)).alias("key"), F.lit(1).alias("own"), F.lit(0).alias("next")))
        if c in successors:
            rows.append(F.struct(F.lit(i).alias("i"), F.lit(False).alias("missing"), F.try_subtract(key(c), F.lit(1).cast("bigint")).alias("key"),
                                 F.lit(0).alias("own"), F.lit(1).alias("next")))
    found = df.select(F.inline(F.array(*rows))).where(F.col("missing") | F.col("key").isNotNull())
    name = F.array(*[F.lit(c) for c in cols])
    return (found.groupBy("i", "missing", "key").agg(F.sum("own").alias("own"), F.max("next").alias("next"))
            .select(name[F.col("i")].alias("column"), "missing", "key", "own", "next"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``(column, nunique, nunique_with_null)`` per column.

    Exact mode counts the groups of :func:`value_keys`; ``approx=True`` uses
    HyperLogLog sketches in a single aggregate (no shuffle of values)."""
    cols = list(cols if cols is not None else df.columns)
    if approx:
        aggs = []
        for i, c in enumerate(cols):
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
            aggs.append(F.max(F.col(c).isNull().cast("int")).alias(f"n{i}"))
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
        return unpivot_row(row, [(c, {"nunique": F.col(f"d{i}").cast("bigint"),
                                      "nunique_with_null": (F.col(f"d{i}") + F.coalesce(F.col(f"n{i}"), F.lit(0))).cast("bigint"),
                                      "n_rows": F.col("n_rows").cast("bigint")})
                                 for i, c in enumerate(cols)])
    return value_keys(df, cols).groupBy("column").agg(
        F.count_if((F.col("own") > 0) & ~F.col("missing")).cast("bigint").alias("nunique"),
        F.count_if(F.col("own") > 0).cast("bigint").alias("nunique_with_null"),
        F.sum("own").cast("bigint").alias("n_rows"))


EXACT_QUANTILE_MAX_ROWS = 10_000_000
APPROX_ACCURACY = 10_000


SELECT_DIGITS = (11, 11, 11, 11, 11, 9)     # bits of a 64-bit key that a selection pass settles


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order (-0.0 is 0.0, NaN above all)."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-2 ** 63)).view(np.uint64)


def _from_ordered_bits(u: int) -> float:
    bits = u ^ (1 << 63) if u >> 63 else ~u & (2 ** 64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def exact_quantiles_large(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles without a value→count map, for all columns
    and ranks together: radix selection on the ordered bits of the values. Each pass
    counts the next digit of the values that share a needed rank's leading bits (in the
    workers, one histogram a task, at most ranks x 2,048 counts) and settles that digit.
    Six passes settle every rank, whatever the number of rows, their range or their
    repetitions."""
    ship_package(df.sparkSession)
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    counts = src.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))]).first()
    plan: dict[str, list[tuple[int, int, float]]] = {}
    state: dict[tuple[int, int], tuple[int, int]] = {}      # (column, rank) -> (leading bits, rows below them)
    for i, c in enumerate(cols):
        n, plan[c] = counts[f"n{i}"], []
        for p in probs:
            r = p * (n - 1)
            k1 = int(math.floor(r)) if n else -1
            plan[c].append((k1, min(k1 + 1, n - 1), r - k1))
            for k in plan[c][-1][:2]:
                if k >= 0:
                    state[i, k] = (0, 0)
    left = 64
    for width in SELECT_DIGITS if state else ():
        left -= width
        wanted = {i: np.array(sorted({lead for (j, _), (lead, _) in state.items() if j == i}), np.uint64) for i in {i for i, _ in state}}
        shared, shift, bins = df.sparkSession.sparkContext.broadcast(wanted), left, 1 << width

        def run(batches: Iterator[pa.RecordBatch], shared=shared, shift=shift, bins=bins, width=width) -> Iterator[pa.RecordBatch]:
            total = {i: np.zeros(len(leads) * bins, np.int64) for i, leads in shared.value.items()}
            for batch in batches:
                for i, leads in shared.value.items():
                    u = _ordered_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                    lead = u >> np.uint64(shift + width) if shift + width < 64 else np.zeros_like(u)
                    at = np.searchsorted(leads, lead)
                    ok = at < len(leads)
                    ok[ok] = leads[at[ok]] == lead[ok]
                    digit = (u[ok] >> np.uint64(shift)) & np.uint64(bins - 1)
                    total[i] += np.bincount(at[ok] * bins + digit.astype(np.int64), minlength=len(leads) * bins)
            for i, c in total.items():
                key = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key), pa.array(c[key])], names=["i", "key", "n"])

        found: dict[int, dict[int, int]] = {}
        for r in src.mapInArrow(run, "i int, key long, n long").groupBy("i", "key").agg(F.sum("n").alias("n")).collect():
            found.setdefault(r["i"], {})[r["key"]] = r["n"]
        for (i, k), (lead, below) in state.items():
            start = int(np.searchsorted(wanted[i], np.uint64(lead))) * bins
            for digit in range(bins):
                n = found[i].get(start + digit, 0)
                if k < below + n:
                    state[i, k] = (lead << width | digit, below)
                    break
                below += n
    value = {key: _from_ordered_bits(lead) for key, (lead, _) in state.items()}
    return {c: [None if k1 < 0 else value[i, k1] + ((value[i, k2] - value[i, k1]) * frac if frac else 0.0) for k1, k2, frac in plan[c]]
            for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact="auto",
              accuracy: int = APPROX_ACCURACY, n_rows: int | None = None) -> dict[str, list[float | None]]:
    """Quantiles (linear interpolation, = pandas/DuckDB ``quantile_cont``) of
    several columns. ``"auto"`` (default): Spark's exact ``percentile`` (a
    value→count map per column) up to ``EXACT_QUANTILE_MAX_ROWS`` rows, the
    radix selection of :func:`exact_quantiles_large` above, with the same results;
    ``exact=False``: the bounded-memory ``percentile_approx`` sketch."""
    if not cols:
        return {}
    if exact == "auto":
        if n_rows is None:
            n_rows = df.count()
        if n_rows > EXACT_QUANTILE_MAX_ROWS:
            return exact_quantiles_large(df, cols, probs)
        exact = True
    if exact:
        aggs = [F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(f"q{i}")
                for i, c in enumerate(cols)]
    else:
        aggs = [F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(f"q{i}")
                for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(cols)}


def numeric_moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """count, mean, population std, min, max, population skewness per column in one pass."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.skewness(x).alias(f"g{i}"),
                 F.var_pop(x).alias(f"v{i}")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {c: {"n": row[f"n{i}"], "mean": row[f"m{i}"], "std": row[f"s{i}"], "min": row[f"lo{i}"],
                "max": row[f"hi{i}"], "skew_pop": row[f"g{i}"], "var_pop": row[f"v{i}"]}
            for i, c in enumerate(cols)}


def numeric_cols_for_quality(df: DataFrame, exclude=()) -> list[str]:
    """pandas ``select_dtypes(np.number)``: numeric, booleans excluded."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


CLASS_SIZE_BROADCAST_ROWS = 200_000


def with_class_size(df: DataFrame, target: str, size_col: str = "_tf_nc"):
    """``df`` (rows with a class) with its class's row count, and one row of
    ``n`` rows, ``k`` classes, ``most`` and ``least`` rows of a class, ``single``
    classes of one row. The counts are joined, so any number of classes will do;
    they are broadcast only up to a checked number of classes."""
    d = df.where(F.col(target).isNotNull())
    sizes = d.groupBy(target).agg(F.count(F.lit(1)).alias(size_col))
    c = F.col(size_col)
    total = sizes.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"),
                      F.coalesce(F.max(c), F.lit(0)).alias("most"), F.coalesce(F.min(c), F.lit(0)).alias("least"),
                      F.count(F.when(c == 1, 1)).alias("single")).first()
    return d.join(F.broadcast(sizes) if total["k"] <= CLASS_SIZE_BROADCAST_ROWS else sizes, target).select(
        *[d[x] for x in df.columns], size_col), total


