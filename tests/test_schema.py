"""Type, target and schema inference (reference schema/auto-inference tests)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tabflow.operators import infer as I
from tabflow.operators import schema as S


def _types(df):
    return {r["column"]: r["field_type"] for r in I.field_types(df).collect()}


def test_field_types(spark):
    n = 200
    rows = [(float(i) * 1.37, f"c{i % 4}", i % 2, f"free text number {i} with words", f"DOC{i:06d}",
             datetime(2024, 1, 1) + timedelta(hours=i), i) for i in range(n)]
    df = spark.createDataFrame(rows, "num double, cat string, flag int, txt string, code string, ts timestamp, seq int")
    t = _types(df)
    assert t["num"] == "numeric" and t["cat"] == "categorical" and t["flag"] == "binary"
    assert t["txt"] == "text" and t["ts"] == "datetime" and t["seq"] == "id"


def test_date_strings(spark):
    df = spark.createDataFrame([("2024-01-%02d" % (i + 1),) for i in range(20)] + [("12:30",)], "d string")
    assert _types(df)["d"] == "datetime"
    bad = spark.createDataFrame([("12:30",), ("2024-01",), ("abc",)], "d string")
    assert _types(bad)["d"] != "datetime"


def test_target_inference(spark):
    rows = [(i, (i * 7) % 13, 1 if i % 5 == 0 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, feature_a int, is_fraud int")
    assert I.infer_target(df).first()["target"] == "is_fraud"
    df2 = spark.createDataFrame([(i, i % 10) for i in range(100)], "customer_id int, score int")
    assert I.infer_target(df2).first()["target"] == "score"
    assert I.infer_target(df2, hint="customer_id").first()["confidence"] == 1.0


def test_task_type(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(100)], "id int, target int, amount double")
    assert I.infer_task_type(df, "target").first()["task_type"] == "multiclass_classification"
    assert I.infer_task_type(df, "amount").first()["task_type"] == "regression"


def test_validate_and_align(spark):
    train = spark.createDataFrame([(1.0, "a", "x"), (2.0, "b", "y"), (3.0, "a", "x")], "num double, cat string, target string")
    learned = S.infer_schema(train)
    new = spark.createDataFrame([("5.5", "a"), ("oops", "b"), (None, "nan")], "num string, cat string")
    errs = {(r.field, r.rule) for r in S.validate_against_schema(new, learned).collect()}
    assert ("target", "missing_field") in errs and ("num", "above_max") in errs
    al = S.align_to_schema(new, learned)
    got = al.orderBy(F.col("num").asc_nulls_last()).collect()
    assert got[0].num == 5.5 and got[1].num is None
    assert {r.cat for r in al.collect()} == {"a", "b", None}
    assert "target" in al.columns


def test_type_sample_knob(spark):
    df = spark.createDataFrame([(float(i) * 1.1, f"c{i % 3}") for i in range(500)], "x double, c string")
    full = {r.column: r.field_type for r in S.infer_schema(df).collect()}
    samp = S.infer_schema(df, type_sample=100).collect()
    assert {r.column: r.field_type for r in samp} == full
    # constraints still come from all rows
    assert {r.column: r.max_value for r in samp}["x"] == max(i * 1.1 for i in range(500))


def test_strategy_time_budget(spark):
    from tabflow.operators import strategy as ST
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(300)], "x int, y string")
    r = ST.recommend(df, "y", "binary_classification", budget_minutes=0.2).first()
    assert r.time_limit_seconds == 30 and r.validation == "cv" and r.size_label == "small"
    assert "time_limit_seconds" not in ST.recommend(df, "y", "binary_classification").columns
