"""Feature engineering on the reference's fixtures."""

import math

from pyspark.sql import functions as F

from tabflow.operators import features as FE
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig, PreprocessorModel


def test_target_encoding_exact_values(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("b", 11.0), ("c", 5.0)], "cat string, target double")
    test = spark.createDataFrame([(0, "a", 100.0), (1, "b", 200.0), (2, "c", 300.0), (3, "d", 400.0)],
                                 "i int, cat string, target double")
    tab, g, enc = FE.fit_target_encoding(train, ["cat"], "target", min_values=3)
    got = [r["cat_te"] for r in FE.apply_target_encoding(test, tab, enc, g).orderBy("i").collect()]
    exp = [5.083333333333333, 6.583333333333333, 5.7272727272727275, 5.8]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, exp))


def test_clip_reduces_outlier(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0), (3.0, 7.0), (4.0, 8.0), (100.0, 9.0)], "num_a double, num_b double")
    b = FE.fit_iqr_bounds(df, ["num_a", "num_b"])
    out = FE.clip_to_bounds(df, b)
    assert out.agg(F.max("num_a")).first()[0] < 100
    assert sorted(r.num_b for r in out.collect()) == [5.0, 6.0, 7.0, 8.0, 9.0]


def test_rare_merge(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",), ("c",)], "cat string")
    rare = FE.fit_rare_values(df, ["cat"], threshold=2)
    vals = sorted(r.cat for r in FE.apply_rare_merge(df, rare, ["cat"]).collect())
    assert vals == ["__other__", "__other__", "a", "a", "a", "a"]
    # unseen values stay as they are
    new = spark.createDataFrame([("z",)], "cat string")
    assert FE.apply_rare_merge(new, rare, ["cat"]).first().cat == "z"


def test_date_parts(spark):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' as dt union all select timestamp'2024-06-15 00:00:00'")
    out = FE.add_date_parts(df, ["dt"])
    assert len(out.columns) == 1 + 5 + 4
    r = out.orderBy("dt").first()
    assert (r.dt_year, r.dt_month, r.dt_day, r.dt_dayofweek, r.dt_hour) == (2024, 1, 1, 0, 10)   # Monday = 0


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "cat string")
    maps = FE.fit_one_hot(df, ["cat"])
    out = FE.apply_one_hot(df, maps)
    assert out.columns == ["cat_a", "cat_b", "cat_c"]


def test_correlation_chain_keeps_last(spark):
    rows = [(float(i), 2.0 * i + 1, 3.0 * i - 2, float((i * 7) % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    m = [(r.col_a, r.col_b, r.corr) for r in FE.correlation_matrix(df, ["x", "y", "z", "w"]).collect()]
    dropped = [d for d, _ in FE.correlation_drop(m, ["x", "y", "z", "w"])]
    assert set(dropped) == {"x", "y"}


def test_scaling_learned_on_train_only(spark):
    train = spark.createDataFrame([(float(x), 0) for x in [1, 2, 3, 4, 5]], "num double, target int")
    test = spark.createDataFrame([(float(x), 0) for x in [10, 20, 30]], "num double, target int")
    p = FE.fit_scaler(train, ["num"], "standard")
    assert abs(FE.apply_scaler(train, p).agg(F.avg("num")).first()[0]) < 1e-12
    assert FE.apply_scaler(test, p).agg(F.avg("num")).first()[0] != 0


def test_pipeline_missing_indicator_and_roles(spark, tmp_path):
    rows = [(1.0, "a", "this is a rather long free text number %d" % i, 0) for i in range(4)] + \
           [(None, "b", "another rather long free text value here", 1)]
    df = spark.createDataFrame(rows, "num double, short_cat string, long_text string, target int")
    m = Preprocessor(PreprocessorConfig(target="target")).fit(df)
    assert m.state["roles"]["text"] == ["long_text"]
    assert m.state["roles"]["categorical"] == ["short_cat"]
    out = m.transform(df)
    assert out.agg(F.sum("num_missing")).first()[0] == 1
    path = str(tmp_path / "pre")
    m.save(path)
    again = PreprocessorModel.load(spark, path)
    cols = [c for c in out.columns if c != "long_text"]
    assert out.select(*cols).exceptAll(again.transform(df).select(*cols)).count() == 0


def test_scoring_without_target_keeps_rows(spark):
    train = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1), ("a", 3.0, 0), ("b", 4.0, 1)], "cat string, num double, target int")
    test = spark.createDataFrame([("a", 1.5), ("b", 2.5), ("c", None)], "cat string, num double")
    m = Preprocessor(PreprocessorConfig(target="target")).fit(train)
    assert m.transform(test).count() == 3


def test_pipeline_large_path_learns_same_state(spark, monkeypatch):
    import tabflow.operators.pipeline as PL
    rows = [(i, float((i * 37) % 101) if i % 9 else None, float((i * 13) % 1000) ** 1.5, "abc"[i % 3], i % 2)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c string, target int")
    cfg = PreprocessorConfig(target="target", keep_columns=["k"], scaler="robust")
    small = Preprocessor(cfg).fit(df).state
    monkeypatch.setattr(PL, "EXACT_QUANTILE_MAX_ROWS", 100)     # take the exact-selection path
    large = Preprocessor(cfg).fit(df).state
    def close(x, y):
        if isinstance(x, dict):
            return x.keys() == y.keys() and all(close(x[k], y[k]) for k in x)
        if isinstance(x, (list, tuple)):
            return len(x) == len(y) and all(close(a, b) for a, b in zip(x, y))
        if isinstance(x, float):
            return math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12)
        return x == y
    for key in ("fills", "bounds", "scaler", "log_columns"):
        assert close(small[key], large[key]), key


def test_pipeline_options_pca_minmax_legacy(spark):
    rows = [(i, float(i % 17), float((i * 3) % 23), float((i * 7) % 29), float(i % 5), float((i * 11) % 31),
             float(i % 13), float((i * 5) % 19), float(i % 7), float((i * 2) % 11), float(i % 3),
             None if i % 4 == 0 else float(i), "abcdefghijklmnop"[i % 16], i % 2) for i in range(400)]
    cols = "k int, " + ", ".join(f"x{j} double" for j in range(10)) + ", sparse double, cat string, target int"
    df = spark.createDataFrame(rows, cols)
    cfg = PreprocessorConfig(target="target", keep_columns=["k"], scaler="minmax", enable_pca=True,
                             missing_drop_threshold=0.2, ranges={"x0": [0, 10]}, legacy_order=True)
    m = Preprocessor(cfg).fit(df)
    assert m.state["missing_drop"] == ["sparse"]
    assert m.state["scaler_kind"] == "minmax"
    out = m.transform(df)
    assert any(c.startswith("pca_") for c in out.columns) and "sparse" not in out.columns
    assert out.count() == 400
    # min-max scaled training columns lie in [0, 1] once clipped to the learned fences
    assert "pca" in m.state and 1 <= m.state["pca"]["k"] <= len(m.state["pca"]["columns"])


def test_schema_json_round_trip(spark):
    from tabflow.operators import schema as S
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a")], "num double, cat string")
    learned = S.infer_schema(df)
    text = S.schema_to_json(learned)
    back = S.schema_from_json(spark, text)
    assert sorted(r.column for r in back.collect()) == ["cat", "num"]


def test_pca_explained_variance_matches_numpy(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(7)
    base = rng.normal(size=(200, 3))
    X = np.column_stack([base[:, 0], base[:, 0] * 2 + base[:, 1] * 0.1, base[:, 2], base[:, 1] - base[:, 2]])
    df = spark.createDataFrame([(list(map(float, r)),) for r in X], "a array<double>").select(array_to_vector("a").alias("v"))
    _, k, ratios, means = FE.fit_pca(df, vector_col="v", variance=0.95)
    ev = np.sort(np.linalg.eigvalsh(np.cov(X, rowvar=False)))[::-1]
    assert np.allclose(ratios, ev / ev.sum(), atol=1e-9)
    assert np.allclose(means, X.mean(axis=0))
    assert k == int(np.searchsorted(np.cumsum(ev / ev.sum()), 0.95, side="right") + 1)


def test_tfidf_matches_direct_formula(spark):
    import math as m
    docs = [(1, "a b b"), (2, "b c"), (3, "a a a d")]
    df = spark.createDataFrame(docs, "id int, text string")
    out = {r.id: r.tfidf for r in FE.text_tfidf(df, "text", num_features=1 << 10).collect()}
    n = len(docs)
    dfreq = {}
    for _, t in docs:
        for w in set(t.split()):
            dfreq[w] = dfreq.get(w, 0) + 1
    for i, t in docs:
        want = sorted(round(t.split().count(w) * m.log((n + 1) / (dfreq[w] + 1)), 9) for w in set(t.split()))
        got = sorted(round(v, 9) for v in out[i].values if v != 0.0)
        assert got == [w for w in want if w != 0.0]


def test_wide_tables_use_the_same_statistics(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tabflow.operators import features as FE
    cols = [f"c{i}" for i in range(12)]
    df = spark.range(200).select(*[F.when((F.col("id") + i) % 7 != 0, F.sin(F.col("id") * (i + 1))).alias(c) for i, c in enumerate(cols)],
                                 F.lit(None).cast("double").alias("empty"))
    wide = {(r.col_a, r.col_b): r["corr"] for r in FE.correlation_matrix(df, [*cols, "empty"], fill_median=False).collect()}
    narrow = FE.correlation_matrix(df, ["c2", "c5"], fill_median=False).first()["corr"]
    assert abs(wide[("c2", "c5")] - narrow) < 1e-12 and wide[("c2", "empty")] is None and len(wide) == 78
    var = {r.column: r.var_pop for r in FE.variance_table(df, [*cols, "empty"]).collect()}
    p = df.toPandas()
    assert all(abs(var[c] - np.nanvar(p[c])) < 1e-9 for c in cols) and var["empty"] is None
