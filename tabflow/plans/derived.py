"""Deterministic derivations of the input tables used by the registered
queries (the inputs have no nulls/duplicates/outliers of their own). Each
Spark builder has the equivalent SQL text so the oracle reads the same rows.
All rows of the input are kept: nulls, constants and mixed values are derived
from the values themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.plans.registry import table


# orders with nulls derived from values: status 'P', priority '5-LOW' and the
# most expensive orders (> 450000) are missing.
def orders_nulls(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") <= 450000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"))


ORDERS_NULLS_SQL = """(select o_orderkey, o_custkey,
  case when o_orderstatus <> 'P' then o_orderstatus end as o_orderstatus,
  case when o_totalprice <= 450000 then o_totalprice end as o_totalprice,
  o_orderdate,
  case when o_orderpriority <> '5-LOW' then o_orderpriority end as o_orderpriority
  from orders)"""


# lineitem narrowed to a few low-cardinality columns: natural duplicate rows.
def lineitem_narrow(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")


LINEITEM_NARROW_SQL = "(select l_returnflag, l_linestatus, l_quantity, l_discount from lineitem)"


# orders plus two columns derived from values: a constant one and an all-null one.
def orders_constants(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("*",
                    F.when(F.col("o_orderdate") >= F.lit("1900-01-01").cast("timestamp"), F.lit("current")).alias("era"),
                    F.when(F.col("o_totalprice") < 0, F.lit("refund")).alias("refund_flag"))


ORDERS_CONSTANTS_SQL = """(select *, case when o_orderdate >= timestamp '1900-01-01' then 'current' end as era,
  case when o_totalprice < 0 then 'refund' end as refund_flag from orders)"""


# events with a string column mixing numbers (user ids of clicks) and words.
def events_mixed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumn("mixed", F.when(F.col("event_type") == "click", F.col("user_id").cast("string"))
                        .otherwise(F.col("event_type")))


EVENTS_MIXED_SQL = """(select *, case when event_type = 'click' then cast(user_id as varchar) else event_type end as mixed
  from events)"""


# part with a label column: size-50 parts get a unique label, the rest their name.
def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.withColumn("p_label", F.when(F.col("p_size") == 50,
                                          F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")))
                        .otherwise(F.col("p_name")))


PART_LABELS_SQL = """(select *, case when p_size = 50 then p_name || '#' || cast(p_partkey as varchar) else p_name end
  as p_label from part)"""


# customer with the balance renamed so the non-negative name rule applies.
def customer_amount(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").withColumnRenamed("c_acctbal", "account_amount")


CUSTOMER_AMOUNT_SQL = """(select c_custkey, c_name, c_nationkey, c_acctbal as account_amount, c_mktsegment from customer)"""


# orders plus a date held as text and a boolean flag (type inference inputs).
def orders_typed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("*", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
                    (F.col("o_totalprice") > 250000).alias("big_order"))


ORDERS_TYPED_SQL = """(select *, strftime(o_orderdate, '%Y-%m-%d') as order_day, o_totalprice > 250000 as big_order
  from orders)"""

# orders before 1999 stand for the data a schema was learned on.
HISTORY_CUTOFF = "1999-01-01 00:00:00"


def orders_history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(HISTORY_CUTOFF).cast("timestamp"))


ORDERS_HISTORY_SQL = f"(select * from orders where o_orderdate < timestamp '{HISTORY_CUTOFF}')"


# customer as it might arrive for scoring: balance as text, segment missing.
def customer_drifted(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("string").alias("c_acctbal"))


# ---- train/test assignment by seeded hash (80 % train), identical in DuckDB
def is_train(*keys) -> "F.Column":
    from tabflow.functions.columns import seeded_hex, uniform01
    return uniform01(seeded_hex(*keys)) < 0.8


def train_sql(key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', cast({key} as varchar), '42')), 1, 8))::BIGINT / 4294967296.0 < 0.8)"


# customer with missing balances (> 9000) and segments ('HOUSEHOLD').
def customer_nulls(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.when(F.col("c_acctbal") <= 9000, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("c_mktsegment"))


CUSTOMER_NULLS_SQL = """(select c_custkey, c_name, c_nationkey, case when c_acctbal <= 9000 then c_acctbal end as c_acctbal,
  case when c_mktsegment <> 'HOUSEHOLD' then c_mktsegment end as c_mktsegment from customer)"""


# events whose value is missing for error events.
def events_nulls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


EVENTS_NULLS_SQL = """(select event_id, ts, user_id, event_type, case when event_type <> 'error' then value end as value, props
  from events)"""
