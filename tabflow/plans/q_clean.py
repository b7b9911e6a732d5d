"""Queries for cleaning, imputation and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import clean as CL
from tabflow.plans.derived import (CUSTOMER_NULLS_SQL, ORDERS_NULLS_SQL, customer_nulls, is_train, orders_nulls,
                                   train_sql)
from tabflow.plans.registry import register, table

_CN = CUSTOMER_NULLS_SQL
_TR = train_sql("c_custkey")


def _fit_apply(spark, sf, numeric="median", categorical="mode"):
    c = customer_nulls(spark, sf)
    fills = CL.fit_imputer(c.where(is_train("c_custkey")), numeric, categorical)
    return CL.apply_fill(c, fills)


@register("impute_median", sql=f"""
with c as {_CN}
select c_custkey, coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from c where {_TR})) as c_acctbal from c""")
def impute_median(spark, sf):
    return _fit_apply(spark, sf, "median").select("c_custkey", "c_acctbal")


@register("impute_mean", sql=f"""
with c as {_CN}
select c_custkey, coalesce(c_acctbal, (select avg(c_acctbal) from c where {_TR})) as c_acctbal from c""")
def impute_mean(spark, sf):
    return _fit_apply(spark, sf, "mean").select("c_custkey", "c_acctbal")


@register("impute_mode", sql=f"""
with c as {_CN}, m as (select c_mktsegment as v from c where {_TR} and c_mktsegment is not null
  group by 1 order by count(*) desc, v asc limit 1)
select c_custkey, coalesce(c_mktsegment, (select v from m)) as c_mktsegment from c""")
def impute_mode(spark, sf):
    return _fit_apply(spark, sf, "median", "mode").select("c_custkey", "c_mktsegment")


@register("impute_constant", sql=f"""
with c as {_CN}
select c_custkey, coalesce(c_acctbal, 0.0) as c_acctbal, coalesce(c_mktsegment, 'missing') as c_mktsegment from c""")
def impute_constant(spark, sf):
    return _fit_apply(spark, sf, "constant", "constant").select("c_custkey", "c_acctbal", "c_mktsegment")


@register("clean_dataframe", sql=f"""
with c as (select distinct * from {_CN} x where c_mktsegment is not null)
select c_custkey, c_name, c_nationkey, coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from c)) as c_acctbal,
  c_mktsegment from c""")
def clean_dataframe(spark, sf):
    return CL.clean_dataframe(customer_nulls(spark, sf), target="c_mktsegment")


@register("range_constraint", sql="""
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  case when l_quantity between 5 and 45 then l_quantity end as l_quantity,
  case when l_discount between 0.02 and 0.08 then l_discount end as l_discount from lineitem""")
def range_constraint(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    return CL.range_constraint(li, {"l_quantity": (5, 45), "l_discount": (0.02, 0.08)})


@register("drop_high_missing_columns", sql=f"""
select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority from {ORDERS_NULLS_SQL} t""")
def drop_high_missing_columns(spark, sf):
    o = orders_nulls(spark, sf)
    learned = CL.fit_high_missing(o.where(is_train("o_orderkey")), threshold=0.3)
    return CL.drop_high_missing_columns(o, learned=learned)


@register("drop_null_target", sql=f"select * from {ORDERS_NULLS_SQL} t where o_orderstatus is not null")
def drop_null_target(spark, sf):
    return CL.drop_null_target(orders_nulls(spark, sf), "o_orderstatus")


@register("log_skewed", sql="""
select event_id, value, case when (select min(value) >= 0 and skewness(value) > 1.0 from events)
  then ln(1 + greatest(value, 0)) end as value_log from events""")
def log_skewed(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    cols = CL.fit_log_columns(e.drop("event_id", "user_id"))
    return CL.add_log_columns(e, cols).drop("user_id")


@register("score_input_validation", sql="""
select * from (
  select 'l_quantity' as "column", 'type_mismatch' as problem, 'numeric' as expected, 'other' as actual,
    cast(sum(case when q is not null and try_cast(q as double) is null then 1 else 0 end) as bigint) as rows
  from (select case when l_returnflag = 'R' then 'n/a' else cast(l_quantity as varchar) end as q from lineitem)
  union all select 'l_linestatus', 'type_mismatch', 'other', 'numeric', cast(count(l_linestatus) as bigint) from lineitem
  union all select 'l_tax', 'missing_column', 'numeric', 'absent', cast(count(*) as bigint) from lineitem)""")
def score_input_validation(spark, sf):
    li = table(spark, sf, "lineitem")
    fitted = li.schema
    incoming = li.withColumn("l_quantity", F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
                             .otherwise(F.col("l_quantity").cast("string"))).drop("l_tax").withColumn("l_linestatus", F.ascii("l_linestatus"))
    return CL.validate_scoring_input(incoming, fitted)


@register("drop_columns", sql="select o_orderkey, o_orderstatus, o_totalprice from orders")
def drop_columns(spark, sf):
    return CL.drop_columns(table(spark, sf, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority", "not_a_column"])
