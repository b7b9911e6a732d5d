"""Queries for schema, type, target and task inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import infer as I
from tabflow.operators import schema as S
from tabflow.plans.derived import (ORDERS_HISTORY_SQL, ORDERS_TYPED_SQL, customer_drifted, orders_history,
                                   orders_typed)
from tabflow.plans.registry import register, table
from tabflow.plans.sqlgen import FIELD_TYPE_CASE, date_ratio_sql, profile_sql, union_all

_OT = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
       ("o_orderdate", "datetime"), ("o_orderpriority", "string"), ("order_day", "string"), ("big_order", "bool")]
_OT_PROFILE = profile_sql("ot", _OT)


@register("field_types", sql=f"""
with ot as {ORDERS_TYPED_SQL}, p as ({_OT_PROFILE})
select "column", {FIELD_TYPE_CASE} as field_type from p""")
def field_types(spark, sf):
    return I.field_types(orders_typed(spark, sf))


@register("sequential_check", sql=f"""
with ot as {ORDERS_TYPED_SQL}, p as ({profile_sql("ot", [c for c in _OT if c[1] == "integer"])})
select "column", round(seq_ratio, 6) as seq_ratio, seq_ratio > 0.95 as is_sequential from p""")
def sequential_check(spark, sf):
    s = I.sequential_ratio(orders_typed(spark, sf), ["o_orderkey", "o_custkey"])
    return s.select("column", F.round("seq_ratio", 6).alias("seq_ratio"), (F.col("seq_ratio") > 0.95).alias("is_sequential"))


@register("datetime_string_check", sql=f"""
with ot as {ORDERS_TYPED_SQL}
{union_all([f"select '{c}' as \"column\", round({date_ratio_sql(c)}, 6) as date_ratio, {date_ratio_sql(c)} >= 0.7 as is_datetime from ot"
            for c, k in _OT if k == "string"])}""")
def datetime_string_check(spark, sf):
    p = I.column_profile(orders_typed(spark, sf), [c for c, k in _OT if k == "string"])
    return p.select("column", F.round("date_ratio", 6).alias("date_ratio"), (F.col("date_ratio") >= 0.7).alias("is_datetime"))


_CU = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"),
       ("c_mktsegment", "string")]
_CU_PROFILE = profile_sql("customer", _CU)


@register("high_cardinality_columns", sql=f"""
with p as ({_CU_PROFILE})
select "column", cast(nunique as bigint) as nunique, unique_ratio from p
where ({FIELD_TYPE_CASE}) in ('categorical', 'id', 'text') and (unique_ratio > 0.3 or nunique > 50000)""")
def high_cardinality_columns(spark, sf):
    return I.high_cardinality_columns(table(spark, sf, "customer"))


@register("profile_table", sql=f"""
with p as ({_CU_PROFILE})
select "column", {FIELD_TYPE_CASE} as field_type, 1 - non_null / greatest(n_rows, 1) as missing_rate,
  cast(nunique as bigint) as nunique, unique_ratio, "column" = 'c_mktsegment' as is_target from p""")
def profile_table(spark, sf):
    return I.profile_table(table(spark, sf, "customer"), target="c_mktsegment")


_OR = [(c, k) for c, k in _OT if c not in ("order_day", "big_order")]
_TARGET_KW = ["target", "label", "y", "class", "outcome", "prediction", "predict", "is_", "has_", "will_", "flag",
              "churn", "default", "fraud", "spam", "risk", "score", "grade", "category"]
_ID_KW = ["id", "idx", "index", "key", "code", "no", "num", "serial", "uuid"]


def _name_score_sql(e: str) -> str:
    t = " or ".join(f"contains(lower({e}), '{k}')" for k in _TARGET_KW)
    i = " or ".join(f"contains(lower({e}), '{k}')" for k in _ID_KW)
    return f"(case when {t} then 1.0 when {i} then -1.0 else 0.0 end)"


@register("infer_target", sql=f"""
with p as ({profile_sql("orders", _OR)}),
c as (select "column", idx, {_name_score_sql('"column"')} as ns,
  0.5 + {_name_score_sql('"column"')} * 0.4 - case when idx = 0 then 0.15 else 0 end
  - case when 1 - non_null / greatest(n_rows, 1) > 0.5 then 0.3 when 1 - non_null / greatest(n_rows, 1) > 0.2 then 0.1 else 0 end
  - case when unique_ratio > 0.95 then 0.4 when unique_ratio > 0.8 then 0.2 else 0 end
  + case when nunique between 2 and 100 then 0.1 else 0 end as score
  from p where nunique > 1)
select "column" as target, round(least(greatest(score, 0.0), 1.0), 4) as confidence
from c where ns >= 0 order by score desc, idx asc limit 1""")
def infer_target(spark, sf):
    return I.infer_target(table(spark, sf, "orders"))


@register("infer_task_type", sql=f"""
with p as ({profile_sql("orders", _OR)}), f as (select "column", {FIELD_TYPE_CASE} as field_type, nunique from p)
select "column" as target, field_type, cast(nunique as bigint) as nunique,
  case when nunique <= 2 then 'binary_classification'
       when field_type = 'numeric' then case when nunique > 10 then 'regression' else 'multiclass_classification' end
       else 'multiclass_classification' end as task_type from f""")
def infer_task_type(spark, sf):
    return I.task_types(table(spark, sf, "orders"))


@register("trainability", sql="""
with g as (select o_orderstatus, count(*) as cnt from orders group by 1),
s as (select sum(cnt) as n, count(o_orderstatus) as k, sum(case when o_orderstatus is not null then cnt end) as nn,
  sum(case when o_orderstatus is not null and cnt < 2 then 1 else 0 end) as small from g)
select * from (
  select 'min_rows' as "check", n >= 10 as passed, cast(n as bigint) as observed from s
  union all select 'has_features', true, cast(5 as bigint) from s
  union all select 'target_not_all_null', coalesce(nn, 0) > 0, cast(coalesce(nn, 0) as bigint) from s
  union all select 'more_than_one_class', k > 1, cast(k as bigint) from s
  union all select 'multiclass_classes', k >= 2, cast(k as bigint) from s
  union all select 'small_classes', small = 0, cast(small as bigint) from s)""")
def trainability(spark, sf):
    return I.trainability(table(spark, sf, "orders"), "o_orderstatus", "multiclass_classification")


@register("column_roles", sql="""
select * from (
  select 'doc_id' as "column", 'numeric' as role
  union all select 'text', case when count(distinct text) / count(*) > 0.5 and avg(length(text)) > 15 then 'text' else 'categorical' end from documents
  union all select 'lang', case when count(distinct lang) / count(*) > 0.5 and avg(length(lang)) > 15 then 'text' else 'categorical' end from documents
  union all select 'source', case when count(distinct source) / count(*) > 0.5 and avg(length(source)) > 15 then 'text' else 'categorical' end from documents
  union all select 'n_chars', 'numeric')""")
def column_roles(spark, sf):
    return I.column_roles(table(spark, sf, "documents"))


_CU_KEEP = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("drop_id_columns", sql=f"""
with p as ({_CU_PROFILE}), ids as (select "column" from p where ({FIELD_TYPE_CASE}) = 'id'),
u as (select c_custkey, col as "column", val as value from (
  select c_custkey, cast(c_name as varchar) as c_name, cast(c_nationkey as varchar) as c_nationkey,
         cast(c_acctbal as varchar) as c_acctbal, cast(c_mktsegment as varchar) as c_mktsegment from customer)
  unpivot (val for col in (c_name, c_nationkey, c_acctbal, c_mktsegment)))
select * from u where "column" not in (select "column" from ids)""")
def drop_id_columns(spark, sf):
    """The columns that survive the identifier drop, as ``(c_custkey,
    column, value)`` rows (long form, so the kept set may differ by scale)."""
    c = table(spark, sf, "customer")
    kept = [x for x in I.drop_id_columns(c, target="c_mktsegment").columns if x != "c_custkey"]
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in kept])
    return c.select("c_custkey", F.inline(pairs))


_PA = [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
       ("p_size", "integer"), ("p_retailprice", "float")]


def _allowed_sql(c):
    return f"(select string_agg(v, '|' order by v) from (select distinct cast({c} as varchar) as v from part where {c} is not null order by v limit 1000))"


@register("schema_constraints", sql=f"""
with p as ({profile_sql("part", _PA)}), f as (select "column", {FIELD_TYPE_CASE} as field_type, non_null < n_rows as nullable from p),
r as ({union_all([f"select '{c}' as col, {'min(' + c + ')::double' if k != 'string' else 'cast(null as double)'} as lo, {'max(' + c + ')::double' if k != 'string' else 'cast(null as double)'} as hi, min(length(cast({c} as varchar))) as mi, max(length(cast({c} as varchar))) as ma, count(distinct {c}) as nd, {_allowed_sql(c)} as av from part" for c, k in _PA])})
select "column", field_type, nullable,
  case when field_type in ('numeric', 'datetime') and "column" in ('p_partkey', 'p_size', 'p_retailprice') then lo end as min_value,
  case when field_type in ('numeric', 'datetime') and "column" in ('p_partkey', 'p_size', 'p_retailprice') then hi end as max_value,
  case when field_type = 'text' then cast(mi as bigint) end as min_length,
  case when field_type = 'text' then cast(ma as bigint) end as max_length,
  case when field_type in ('categorical', 'binary') then cast(nd as bigint) end as n_allowed,
  case when field_type in ('categorical', 'binary') then av end as allowed_values
from f join r on f."column" = r.col""")
def schema_constraints(spark, sf):
    return S.infer_schema(table(spark, sf, "part"))


def _drift_sql(kind: str) -> str:
    # learned on history: o_custkey/o_totalprice numeric, o_orderdate datetime (epoch seconds)
    cols = [("o_custkey", "o_custkey::double"), ("o_totalprice", "o_totalprice::double"),
            ("o_orderdate", "epoch(o_orderdate)::double")]
    parts = []
    for c, e in cols:
        parts.append(f"select '{c}' as field, 'below_min' as rule, (select min({e}) from orders) as observed, "
                     f"(select min({e}) from {ORDERS_HISTORY_SQL} h) as \"limit\"")
        parts.append(f"select '{c}', 'above_max', (select max({e}) from orders), (select max({e}) from {ORDERS_HISTORY_SQL} h)")
    return union_all(parts)


@register("schema_validate", sql=f"""
select * from ({_drift_sql('x')}) where (rule = 'below_min' and observed < "limit") or (rule = 'above_max' and observed > "limit")""")
def schema_validate(spark, sf):
    learned = S.infer_schema(orders_history(spark, sf))
    return S.validate_against_schema(table(spark, sf, "orders"), learned)


@register("schema_violations", sql=f"""
with h as (select min(o_custkey) a1, max(o_custkey) b1, min(o_totalprice) a2, max(o_totalprice) b2,
                  min(epoch(o_orderdate)) a3, max(epoch(o_orderdate)) b3 from {ORDERS_HISTORY_SQL} x),
v as (select o_orderkey, array_to_string(list_filter([
   case when o_custkey < a1 then 'o_custkey:below_min' end, case when o_custkey > b1 then 'o_custkey:above_max' end,
   case when o_totalprice < a2 then 'o_totalprice:below_min' end, case when o_totalprice > b2 then 'o_totalprice:above_max' end,
   case when epoch(o_orderdate) < a3 then 'o_orderdate:below_min' end, case when epoch(o_orderdate) > b3 then 'o_orderdate:above_max' end],
   lambda x: x is not null), ',') as violations from orders, h)
select * from v where violations <> ''""")
def schema_violations(spark, sf):
    learned = S.infer_schema(orders_history(spark, sf))
    v = S.schema_violations(table(spark, sf, "orders"), learned, ["o_orderkey"])
    return v.select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@register("align_schema", sql="""
select c_custkey, c_name, cast(c_nationkey as double) as c_nationkey, try_cast(cast(c_acctbal as varchar) as double) as c_acctbal,
  '' as c_mktsegment from customer""")
def align_schema(spark, sf):
    learned = S.infer_schema(table(spark, sf, "customer"))
    return S.align_to_schema(customer_drifted(spark, sf), learned)
