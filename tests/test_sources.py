"""File sources (encoding fallback, dispatch), sinks and JDBC option building."""

import pytest
from pyspark.sql import functions as F

from tabflow.sources import files as FS
from tabflow.sources import jdbc as J


def test_csv_utf8_and_gbk(spark, tmp_path):
    utf = tmp_path / "u.csv"
    utf.write_text("a,b,target\n1,北京,0\n2,上海,1\n3,广州,0\n", encoding="utf-8")
    gbk = tmp_path / "g.csv"
    gbk.write_bytes("a,b,target\n1,北京,0\n2,上海,1\n3,广州,0\n".encode("gbk"))
    for p in (utf, gbk):
        df = FS.read_table(spark, str(p))
        assert df.count() == 3 and df.columns == ["a", "b", "target"]
        assert sorted(r.b for r in df.collect()) == sorted(["北京", "上海", "广州"])


def test_json_lines_and_unsupported(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    assert FS.read_table(spark, str(p)).count() == 2
    with pytest.raises(ValueError):
        FS.read_table(spark, str(tmp_path / "x.xlsx"))


def test_preview_fingerprint_and_metrics(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    rows = FS.preview(df, 10, order_by=["a"]).collect()
    assert rows[0].b == "" and rows[1].b == "b"
    a = FS.fingerprint(df).first()
    b = FS.fingerprint(df.repartition(3).orderBy(F.desc("a"))).first()
    assert a == b
    m = FS.metrics_long(spark.createDataFrame([("r1", 0.9, 0.1)], "run string, acc double, loss double"), "run",
                        ["acc", "loss"])
    assert sorted((r.metric_name, r.metric_value) for r in m.collect()) == [("acc", 0.9), ("loss", 0.1)]
    p = FS.artifact_preview(spark.range(30), 20, order_by=["id"]).collect()
    assert len(p) == 20 and p[0].total_rows == 30 and p[0].truncated


def test_jdbc_options():
    assert J.jdbc_url("postgresql", {"host": "db", "database": "x"}) == "jdbc:postgresql://db:5432/x"
    assert J.jdbc_url("mysql", {"host": "h", "port": 3307, "database": "d"}) == "jdbc:mysql://h:3307/d"
    assert J.jdbc_url("sqlite", {"path": "/data/a.db"}) == "jdbc:sqlite:/data/a.db"
    o = J.jdbc_options("clickhouse", {"host": "c", "database": "d", "user": "u"}, table="t", partition_column="id",
                       lower=0, upper=100, num_partitions=4)
    assert o["partitionColumn"] == "id" and o["numPartitions"] == "4" and o["dbtable"] == "t" and o["user"] == "u"
    assert J.jdbc_options("mysql", {"database": "d"}, query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        J.jdbc_options("mysql", {"database": "d"})
    with pytest.raises(ValueError):
        J.jdbc_url("oracle", {})
