"""Pairwise moments against numpy, with nulls that differ by column."""

import numpy as np
from pyspark.sql import functions as F

from tabflow.operators import features as FE
from tabflow.operators import gram


def _frame(spark, p=60, n=500):
    cols = [f"c{i}" for i in range(p)]
    df = spark.range(n).select(*[F.when(F.hash("id", F.lit(i)) % (3 + i % 5) != 0, F.sin(F.col("id") * (i + 1)) * 10 ** (i % 4) + 1e6 * (i % 3)).alias(c)
                                 for i, c in enumerate(cols)]).repartition(7)
    return df, cols


def test_sixty_columns_equal_pairwise_numpy(spark):
    df, cols = _frame(spark)
    got = {(r["i"], r["j"]): r["corr"] for r in gram.correlations(df, cols).collect()}
    x = df.toPandas().to_numpy(float)
    assert len(got) == 60 * 59 // 2
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9


def test_moments_of_pairs(spark):
    df, cols = _frame(spark, 5, 90)
    x = df.toPandas().to_numpy(float)
    for r in gram.pair_moments(df, cols, tile=2).collect():
        both = ~np.isnan(x[:, r["i"]]) & ~np.isnan(x[:, r["j"]])
        a, b = x[both, r["i"]], x[both, r["j"]]
        want = [len(a), a.mean(), b.mean(), ((a - a.mean()) ** 2).sum(), ((b - b.mean()) ** 2).sum(), ((a - a.mean()) * (b - b.mean())).sum()]
        assert np.allclose([r[s] for s in gram.STATS], want, rtol=1e-9, atol=1e-6)


def test_one_scan_whatever_the_number_of_pairs(spark):
    df, cols = _frame(spark)
    plan = gram.correlations(df, cols)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_unknown_and_constant_columns(spark):
    rows = [(0.0, 0.0, 5.1, None, float("nan")), (1.0, 1.0, 5.1, None, 1.0), (2.0, 2.0, 5.1, None, 2.0), (100.0, None, 5.1, None, 3.0),
            (None, 100.0, 5.1, None, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    got = {(r.col_a, r.col_b): r["corr"] for r in FE.correlation_matrix(df, list("abcde"), fill_median=False).collect()}
    assert abs(got["a", "b"] - 1.0) < 1e-12 and got["a", "c"] is None and got["a", "d"] is None and got["c", "e"] is None
    assert abs(got["b", "e"] - np.corrcoef([1, 2, 100], [1, 2, 4])[0, 1]) < 1e-12
    assert gram.covariance(df.where("a > 1000"), ["a", "b"])[0] == 0


def test_pca_of_the_covariance(spark):
    df, cols = _frame(spark, 6, 300)
    full = df.na.fill(0.0)
    components, k, ratios, means = FE.fit_pca(full, cols, variance=0.9)
    x = full.toPandas().to_numpy()
    values = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
    assert np.allclose(ratios, values / values.sum(), atol=1e-9) and np.allclose(means, x.mean(axis=0))
    assert np.allclose(components.T @ np.cov(x, rowvar=False) @ components, np.diag(values), atol=1e-4 * values[0])
    assert np.cumsum(ratios)[k - 1] > 0.9 and (k == 1 or np.cumsum(ratios)[k - 2] <= 0.9)
