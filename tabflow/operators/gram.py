"""Pairwise moments of many columns in one scan.

For every pair of columns the rows where both are known have their own count, means
and co-moments. Workers turn each Arrow batch into a value matrix ``X`` (nulls 0) and
a mask ``M``, so that all pairs come from a few matrix products (``M'M`` counts,
``X'M`` sums, ``(X*X)'M`` squares, ``X'X`` products). A batch is centred on its own
column means before the products and merged with the others by the pairwise update of
means and co-moments, so large offsets do not cancel.

The result of a task is a set of square tiles of the pair matrix, at most
``TILE x TILE`` pairs each; tiles are merged in two levels (by tile and a salt, then
by tile), so neither the number of columns nor that of tasks gathers in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.session import ship_package

TILE = 32
SALTS = 64
#: squared relative rounding of a mean: a smaller variance is that of a constant
NOISE = 1e-26
STATS = ("n", "mx", "my", "cxx", "cyy", "cxy")
_SCHEMA = "ti int, tj int, salt int, " + ", ".join(f"{s} array<double>" for s in STATS)


def _moments(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``(6, p, p)`` moments of a batch: counts, means of either column, co-moments."""
    m = known.astype(np.float64)
    column_n = m.sum(axis=0)
    shift = np.divide(x.sum(axis=0), column_n, out=np.zeros(len(column_n)), where=column_n > 0)
    z = (x - shift) * m
    n = m.T @ m
    safe = np.maximum(n, 1.0)
    sx = z.T @ m                       # sum of the row's column over rows where both are known
    sxx = (z * z).T @ m
    mx, my = sx / safe, sx.T / safe
    out = np.stack([n, mx + shift[:, None], my + shift[None, :],
                    np.maximum(sxx - sx * mx, 0.0), np.maximum(sxx.T - sx.T * my, 0.0), z.T @ z - n * mx * my])
    out[1:, n == 0] = 0.0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows, put together."""
    n = a[0] + b[0]
    part = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * part
    return np.stack([n, a[1] + dx * part, a[2] + dy * part, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w,
                     a[5] + b[5] + dx * dy * w])


def _tiles(m: np.ndarray, salt: int, tile: int) -> pa.RecordBatch:
    p = m.shape[1]
    rows: list[tuple] = []
    for i in range(0, p, tile):
        for j in range(i, p, tile):
            part = m[:, i:i + tile, j:j + tile]
            rows.append((i // tile, j // tile, salt, *[part[k].ravel() for k in range(len(STATS))]))
    ints, lists = pa.int32(), pa.list_(pa.float64())
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, ints if k < 3 else lists) for k, c in enumerate(cols)],
                                      names=["ti", "tj", "salt", *STATS])


def _merge_group(rows: pa.Table) -> pa.Table:
    total = None
    for k in range(rows.num_rows):
        one = np.stack([rows.column(s)[k].values.to_numpy() for s in STATS])
        total = one if total is None else merge(total, one)
    out = {c: rows.column(c).slice(0, 1) for c in ("ti", "tj", "salt")}
    return pa.table({**out, **{s: pa.array([total[i]], pa.list_(pa.float64())) for i, s in enumerate(STATS)}})


def pair_moments(df: DataFrame, cols: list[str], tile: int = TILE) -> DataFrame:
    """``i, j, n, mx, my, cxx, cyy, cxy`` for every pair of column places ``i <= j``:
    rows where both are known, means, and sums of squares and products about them. A
    column with itself has the plain moments. NaN counts as unknown."""
    p = len(cols)
    if not p:
        return df.sparkSession.createDataFrame([], "i int, j int, " + ", ".join(f"{s} double" for s in STATS))
    ship_package(df.sparkSession)
    src = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
                known = ~np.isnan(x)
                one = _moments(np.where(known, x, 0.0), known)
                total = one if total is None else merge(total, one)
        if total is not None:
            yield _tiles(total, TaskContext.get().partitionId() % SALTS, tile)

    parts = src.mapInArrow(run, _SCHEMA)
    parts = parts.groupBy("ti", "tj", "salt").applyInArrow(lambda t: _merge_group(t), _SCHEMA)
    parts = parts.groupBy("ti", "tj").applyInArrow(lambda t: _merge_group(t), _SCHEMA)
    width = F.least(F.lit(tile), F.lit(p) - F.col("tj") * tile)
    pairs = parts.select(F.col("ti"), F.col("tj"), width.alias("w"), F.posexplode(F.arrays_zip(*STATS)).alias("k", "s"))
    return (pairs.select((F.col("ti") * tile + F.floor(F.col("k") / F.col("w"))).cast("int").alias("i"),
                         (F.col("tj") * tile + F.pmod("k", F.col("w"))).cast("int").alias("j"), "s.*")
            .where(F.col("i") <= F.col("j")))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """``i, j, corr`` for ``i < j`` on the rows where both columns are known; null where
    one of them is constant there, or no row has both."""
    own = F.when(F.col("i") == F.col("j"), F.col("mx") * F.col("mx") + F.col("cxx") / F.greatest("n", F.lit(1.0)))
    m = pair_moments(df, cols).select(
        "*", *[F.max(own).over(Window.partitionBy(c)).alias(f"scale_{c}") for c in ("i", "j")])
    varies = lambda c, of: F.col(c) > F.col("n") * F.col(of) * NOISE
    r = F.col("cxy") / F.sqrt(F.col("cxx") * F.col("cyy"))
    return m.where(F.col("i") < F.col("j")).select(
        "i", "j", F.when(varies("cxx", "scale_i") & varies("cyy", "scale_j"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("corr"))


def covariance(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column means and the sample covariance matrix, each pair on the rows where
    both are known. The p x p numbers come to the driver."""
    p = len(cols)
    n, means, cov = 0, np.zeros(p), np.zeros((p, p))
    for r in pair_moments(df, cols).collect():
        i, j = r["i"], r["j"]
        if i == j:
            n, means[i] = max(n, int(r["n"])), r["mx"]
        cov[i, j] = cov[j, i] = r["cxy"] / max(r["n"] - 1, 1)
    return n, means, cov
