"""Quality operators on the reference's literal fixtures."""

from tabflow.operators import quality as Q


def test_quality_mix_has_six_dimensions(spark):
    df = spark.createDataFrame([(1.0, "x", 0), (2.0, "y", 1), (3.0, "x", 0), (None, "z", 1), (100.0, "x", 0)],
                               "num_a double, cat_a string, target int")
    s = {r["dimension"]: r["score"] for r in Q.quality_scores(df, "target").collect()}
    assert set(s) == {"completeness", "consistency", "accuracy", "timeliness", "uniqueness", "validity", "overall"}
    assert s["completeness"] < 1.0
    mr = {r["column"]: r["missing_rate"] for r in Q.missing_rates(df).collect()}
    assert mr["num_a"] > 0


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "a int, target int")
    assert Q.duplicates(df).first()["duplicated_rows"] == 1


def test_negative_values_flagged(spark):
    df = spark.createDataFrame([(1000.0, 0), (-50.0, 1), (2000.0, 0)], "income double, target int")
    rows = Q.negative_values(df, "target").collect()
    assert [(r["column"], r["negative_count"]) for r in rows] == [("income", 1)]


def test_row_cap(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "a int, target int")
    assert Q.cap_rows(df, 3).count() == 3
    assert Q.cap_rows(df, 0).count() == 10
    assert Q.cap_rows(df, None).count() == 10
    # reproducible
    assert sorted(r.a for r in Q.cap_rows(df, 3).collect()) == sorted(r.a for r in Q.cap_rows(df, 3).collect())


def test_outliers_and_accuracy(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "v double")
    o = Q.outlier_summary(df).collect()
    assert o[0]["outlier_count"] == 1
    assert Q.accuracy(df).first()["score"] < 1.0


def test_rare_values_examples_are_bounded(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(20)] + [("same",), ("same",)], "c string")
    r = Q.rare_values(df).first()
    assert r["rare_values_count"] == 20
    assert len(r["examples"].split(",")) == 5


def test_auto_row_cap(spark, monkeypatch):
    monkeypatch.setattr(Q, "LARGE_DATASET_ROWS", 50)
    monkeypatch.setattr(Q, "QUALITY_SAMPLE_ROWS", 20)
    df = spark.range(100).withColumnRenamed("id", "a")
    assert Q.cap_rows(df, "auto").count() == 20
    assert Q.cap_rows(spark.range(30), "auto").count() == 30


def test_chart_data(spark):
    df = spark.createDataFrame([(1.0, None, 0), (None, "a", 1), (3.0, "b", 0), (100.0, "c", 1)] * 3,
                               "x double, c string, target int")
    ch = Q.chart_data(df, "target")
    assert [r.column for r in ch["missing"].collect()] == ["c", "x"] or [r.column for r in ch["missing"].collect()] == ["x", "c"]
    assert ch["target"].count() == 2


def test_drop_duplicates_hash_first(spark):
    from tabflow.operators.clean import drop_duplicates
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "x int, y string")
    assert sorted(map(tuple, drop_duplicates(df).collect()), key=str) == sorted([(1, "a"), (2, None), (3, "c")], key=str)
    uniq = spark.createDataFrame([(i, str(i)) for i in range(10)], "x int, y string")
    assert drop_duplicates(uniq).count() == 10


def test_duplicates_treat_negative_zero_as_zero(spark):
    from tabflow.operators.clean import drop_duplicates
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (1.0, "b")], "x double, y string")
    assert Q.duplicates(df).first()["duplicated_rows"] == df.groupBy("x", "y").count().where("count > 1").count()
    assert drop_duplicates(df).count() == df.dropDuplicates().count()
