"""Queries for sources and sinks (A1-A4, A10-A15, A17): each writes to a fresh
folder under the shared checkpoint location and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import quality as Q
from tabflow.plans.derived import is_train, train_sql
from tabflow.plans.registry import register, table
from tabflow.session import scratch_path
from tabflow.sources import files as FS


@register("read_csv_roundtrip", sql="""
select o_orderstatus, cast(count(*) as bigint) as n, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total,
  cast(sum(o_custkey) as bigint) as custkeys
from orders group by 1""")
def read_csv_roundtrip(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "orders-csv")
    FS.write_csv(o, path)
    back = FS.read_table(spark, path, fmt="csv")
    # money is summed exactly (2-decimal amounts), independent of summation order
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                             F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
                                             F.sum("o_custkey").cast("bigint").alias("custkeys"))


@register("read_json_roundtrip", sql="select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def read_json_roundtrip(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = scratch_path(spark, "customer-jsonl")
    FS.write_json(c, path)
    back = FS.read_table(spark, path, fmt="jsonl")
    return back.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), "c_mktsegment")


@register("read_parquet_table", sql="""
select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, sum(l_quantity) as qty from lineitem group by 1, 2""")
def read_parquet_table(spark, sf):
    li = FS.read_table(spark, f"{sf}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                                          F.sum("l_quantity").alias("qty"))


@register("write_split_parquet", sql=f"""
select case when {train_sql('o_orderkey')} then 'train' else 'test' end as split, cast(count(*) as bigint) as n,
  cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total from orders group by 1""")
def write_split_parquet(spark, sf):
    o = table(spark, sf, "orders").withColumn("split", F.when(is_train("o_orderkey"), "train").otherwise("test"))
    path = scratch_path(spark, "orders-split")
    FS.write_parquet(o, path, partition_by="split")
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                     F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@register("write_reports", sql="""
select 'overall' as dimension, round(1 - (select count(*) - count(distinct (l_returnflag, l_linestatus, l_quantity, l_discount))
  from lineitem) / (select count(*) from lineitem), 4) as uniqueness_score""")
def write_reports(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    rep = Q.duplicates(li).select(F.lit("overall").alias("dimension"), F.col("score").alias("uniqueness_score"))
    path = scratch_path(spark, "report-json")
    FS.write_json(rep, path)
    return spark.read.schema("dimension string, uniqueness_score double").json(path)


@register("preview_rows", sql="""
select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
  c_mktsegment from customer order by customer.c_custkey limit 10""")
def preview_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return FS.preview(c, 10, order_by=["c_custkey"])


@register("artifact_preview", sql="""
select o_orderkey, o_orderstatus, (select count(*) from orders) as total_rows, (select count(*) from orders) > 20 as truncated
from orders order by o_orderkey limit 20""")
def artifact_preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return FS.artifact_preview(o, 20, order_by=["o_orderkey"])


@register("fingerprint", sql="""
select cast(count(*) as bigint) as n_rows, cast(sum(('0x' || substr(md5(concat_ws('|', cast(c_custkey as varchar), c_name,
  cast(c_nationkey as varchar), c_mktsegment)), 1, 15))::BIGINT::HUGEINT) as varchar) as digest from customer""")
def fingerprint(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return FS.fingerprint(c)


@register("metrics_table", sql="""
select run_id, metric_name, metric_value from (
  select o_orderstatus as run_id, count(*)::double as n_rows, avg(o_totalprice) as mean_price, max(o_totalprice) as max_price
  from orders group by 1) unpivot (metric_value for metric_name in (n_rows, mean_price, max_price))""")
def metrics_table(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n_rows"),
                                          F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    long = FS.metrics_long(runs, "o_orderstatus", ["n_rows", "mean_price", "max_price"])
    path = scratch_path(spark, "run-metrics")
    long.write.mode("append").parquet(path)
    return spark.read.parquet(path)
