"""Queries for the data-quality operators."""

from __future__ import annotations

from tabflow.operators import clean as CL
from tabflow.operators import quality as Q
from tabflow.plans.derived import (CUSTOMER_AMOUNT_SQL, EVENTS_MIXED_SQL, LINEITEM_NARROW_SQL,
                                   ORDERS_CONSTANTS_SQL, ORDERS_NULLS_SQL, PART_LABELS_SQL, customer_amount,
                                   events_mixed, lineitem_narrow, orders_constants, orders_nulls, part_labels)
from tabflow.plans.registry import register, table
from tabflow.plans.sqlgen import accuracy_sql, iqr_sql, union_all

_ON = ORDERS_NULLS_SQL
_OCOLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_NULLSUM = " + ".join(f"({c} is null)::int" for c in _OCOLS)
_ANYNULL = " or ".join(f"{c} is null" for c in _OCOLS)
_COLSNULL = " + ".join(f"max(({c} is null)::int)" for c in _OCOLS)


@register("quality_completeness", sql=f"""
with t as {_ON}
select cast(count(*) as bigint) as n_rows, cast(sum({_NULLSUM}) as bigint) as missing_cells,
  cast(sum(case when {_ANYNULL} then 1 else 0 end) as bigint) as rows_with_missing,
  cast({_COLSNULL} as bigint) as columns_with_missing,
  round(1 - sum({_NULLSUM}) / (count(*) * 6.0), 4) as score
from t""")
def quality_completeness(spark, sf):
    return Q.completeness(orders_nulls(spark, sf))


@register("missing_rates", sql="with t as " + _ON + "\n" + union_all([
    f"select '{c}' as \"column\", avg(case when {c} is null then 1.0 else 0.0 end) as missing_rate from t"
    for c in _OCOLS]))
def missing_rates(spark, sf):
    return Q.missing_rates(orders_nulls(spark, sf))


@register("duplicate_rows", sql=f"""
select cast(sum(c) as bigint) as n_rows, cast(count(*) as bigint) as distinct_rows,
  cast(sum(c) - count(*) as bigint) as duplicated_rows, round(1 - (sum(c) - count(*)) / greatest(sum(c), 1), 4) as score
from (select count(*) as c from {LINEITEM_NARROW_SQL} t group by l_returnflag, l_linestatus, l_quantity, l_discount)""")
def duplicate_rows(spark, sf):
    return Q.duplicates(lineitem_narrow(spark, sf))


@register("drop_duplicates", sql=f"select distinct * from {LINEITEM_NARROW_SQL} t")
def drop_duplicates(spark, sf):
    return CL.drop_duplicates(lineitem_narrow(spark, sf))


_ID_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("id_like_columns", sql="select \"column\", unique_ratio from (" + union_all([
    f"select '{c}' as \"column\", round(count(distinct {c}) / greatest(count(*), 1), 4) as unique_ratio, "
    f"count(distinct {c}) / greatest(count(*), 1) as r from orders" for c in _ID_COLS]) + ") where r > 0.9")
def id_like_columns(spark, sf):
    return Q.id_like_columns(table(spark, sf, "orders"), target="o_orderstatus")


_CC = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "era", "refund_flag"]
_CC_COUNTS = union_all([
    f"select '{c}' as \"column\", cast(count(distinct {c}) as bigint) as nunique, "
    f"count(distinct {c}) + max(({c} is null)::int) as nunique_with_null from t" for c in _CC])


@register("constant_columns", sql=f"""
with t as {ORDERS_CONSTANTS_SQL}
select "column", nunique, true as is_constant, nunique = 0 as is_all_null
from ({_CC_COUNTS}) where nunique_with_null <= 1""")
def constant_columns(spark, sf):
    return Q.constant_columns(orders_constants(spark, sf))


@register("quality_consistency", sql=f"""
with t as {ORDERS_CONSTANTS_SQL}, c as ({_CC_COUNTS}),
m as (select count(*) as n from (
  select avg(case when try_cast(o_orderstatus as double) is not null then 1.0 else 0.0 end) as r from t where o_orderstatus is not null
  union all select avg(case when try_cast(o_orderpriority as double) is not null then 1.0 else 0.0 end) from t where o_orderpriority is not null
  union all select avg(case when try_cast(era as double) is not null then 1.0 else 0.0 end) from t where era is not null
  union all select avg(case when try_cast(refund_flag as double) is not null then 1.0 else 0.0 end) from t where refund_flag is not null
) where r > 0 and r < 1)
select cast(8 as bigint) as n_features,
  cast((select count(*) from c where nunique_with_null <= 1) as bigint) as constant_columns,
  cast((select count(*) from c where nunique = 0) as bigint) as all_null_columns,
  cast((select n from m) as bigint) as mixed_type_columns,
  round(1 - ((select count(*) from c where nunique_with_null <= 1) + (select n from m)) / 8.0, 4) as score""")
def quality_consistency(spark, sf):
    return Q.consistency(orders_constants(spark, sf))


@register("mixed_type_columns", sql=f"""
with t as {EVENTS_MIXED_SQL}
select "column", round(r, 4) as numeric_like_ratio from (
  select 'event_type' as "column", avg(case when try_cast(event_type as double) is not null and not isnan(try_cast(event_type as double)) then 1.0 else 0.0 end) as r from t where event_type is not null
  union all select 'props', avg(case when try_cast(props as double) is not null and not isnan(try_cast(props as double)) then 1.0 else 0.0 end) from t where props is not null
  union all select 'mixed', avg(case when try_cast(mixed as double) is not null and not isnan(try_cast(mixed as double)) then 1.0 else 0.0 end) from t where mixed is not null
) where r > 0 and r < 1""")
def mixed_type_columns(spark, sf):
    return Q.mixed_type_columns(events_mixed(spark, sf))


_EV_NUM = ["event_id", "user_id", "value"]


@register("iqr_outliers", sql=iqr_sql("events", _EV_NUM, keep_zero=True))
def iqr_outliers(spark, sf):
    return Q.outlier_summary(table(spark, sf, "events"), keep_zero=True)


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("quality_accuracy", sql=accuracy_sql("lineitem", _LI_NUM))
def quality_accuracy(spark, sf):
    return Q.accuracy(table(spark, sf, "lineitem"), target="l_returnflag")


@register("negative_values", sql=f"""
select 'account_amount' as "column", cast(sum((account_amount < 0)::int) as bigint) as negative_count
from {CUSTOMER_AMOUNT_SQL} t having sum((account_amount < 0)::int) > 0""")
def negative_values(spark, sf):
    return Q.negative_values(customer_amount(spark, sf))


_AS_OF = "2024-01-20 00:00:00"


@register("future_dates", sql=f"""
select 'ts' as "column", cast(sum((ts > timestamp '{_AS_OF}')::int) as bigint) as future_dates from events""")
def future_dates(spark, sf):
    return Q.future_dates(table(spark, sf, "events"), as_of=_AS_OF)


@register("quality_timeliness", sql=f"""
select cast(1 as bigint) as datetime_columns, cast(sum((ts > timestamp '{_AS_OF}')::int) as bigint) as future_dates,
  round(1 - sum((ts > timestamp '{_AS_OF}')::int) / greatest(count(*), 1), 4) as score from events""")
def quality_timeliness(spark, sf):
    return Q.timeliness(table(spark, sf, "events"), as_of=_AS_OF)


_PL_STR = ["p_name", "p_brand", "p_type", "p_label"]


@register("rare_values", sql=f"""
with t as {PART_LABELS_SQL}, vc as (
  {union_all([f"select '{c}' as col, {c} as v, count(*) as cnt from t group by {c}" for c in _PL_STR])}
), s as (select col, v from vc where cnt = 1),
ex as (select col, string_agg(v, ',' order by v) as examples from (
  select col, v, row_number() over (partition by col order by v) as rn from s where v is not null) where rn <= 5 group by col)
select s.col as "column", cast(count(*) as bigint) as rare_values_count, coalesce(max(ex.examples), '') as examples
from s left join ex on s.col = ex.col group by s.col""")
def rare_values(spark, sf):
    return Q.rare_values(part_labels(spark, sf))


@register("quality_validity", sql=f"""
with t as {PART_LABELS_SQL}, vc as (
  {union_all([f"select '{c}' as col, {c} as v, count(*) as cnt from t group by {c}" for c in _PL_STR])})
select cast(sum((cnt = 1)::int) as bigint) as rare_values,
  round(1 - sum((cnt = 1)::int) / greatest((select count(*) from part), 1), 4) as score from vc""")
def quality_validity(spark, sf):
    return Q.validity(part_labels(spark, sf))


_LI_ALL = _LI_NUM + ["l_linestatus", "l_shipdate"]
_LI_AS_OF = "2000-01-01 00:00:00"


def _overall_sql() -> str:
    nulls = " + ".join(f"({c} is null)::int" for c in _LI_ALL + ["l_returnflag"])
    return f"""
with comp as (select round(1 - sum({nulls}) / (count(*) * 11.0), 4) as score from lineitem),
cons as (select round(1 - ((select count(*) from (select count(distinct l_linestatus) + max((l_linestatus is null)::int) as k
  from lineitem) where k <= 1)
  + (select count(*) from (select avg(case when try_cast(l_linestatus as double) is not null then 1.0 else 0.0 end) as r
     from lineitem where l_linestatus is not null) where r > 0 and r < 1)) / 10.0, 4) as score),
acc as ({accuracy_sql("lineitem", _LI_NUM)}),
tim as (select round(1 - sum((l_shipdate > timestamp '{_LI_AS_OF}')::int) / greatest(count(*), 1), 4) as score from lineitem),
uni as (select round(1 - (sum(c) - count(*)) / greatest(sum(c), 1), 4) as score from (select count(*) as c from lineitem group by {', '.join(_LI_ALL + ['l_returnflag'])})),
val as (select round(1 - coalesce(sum((cnt = 1)::int), 0) / (select count(*) from lineitem), 4) as score
        from (select l_linestatus, count(*) as cnt from lineitem group by 1)),
six as (select 'completeness' as dimension, score from comp union all select 'consistency', score from cons
  union all select 'accuracy', score from acc union all select 'timeliness', score from tim
  union all select 'uniqueness', score from uni union all select 'validity', score from val)
select dimension, score from six union all select 'overall', round(sum(score) / 6.0, 4) from six"""


@register("quality_overall", sql=_overall_sql())
def quality_overall(spark, sf):
    return Q.quality_scores(table(spark, sf, "lineitem"), target="l_returnflag", as_of=_LI_AS_OF)


@register("quality_warnings", sql=f"""
with t as {_ON}, mr as ({union_all([f"select '{c}' as col, avg(({c} is null)::int) as r from t" for c in _OCOLS])}),
dup as (select sum(c) - count(*) as d from (select count(*) as c from t group by {', '.join(_OCOLS)})),
vc as ({union_all([f"select '{c}' as col, {c} as v, count(*) as cnt from t group by {c}"
                   for c in ["o_orderstatus", "o_orderpriority"]])}),
rare as (select distinct col from vc where cnt = 1),
q as (select quantile_cont(o_orderkey, 0.25) a1, quantile_cont(o_orderkey, 0.75) b1,
             quantile_cont(o_custkey, 0.25) a2, quantile_cont(o_custkey, 0.75) b2,
             quantile_cont(o_totalprice, 0.25) a3, quantile_cont(o_totalprice, 0.75) b3 from t),
o as (select 'o_orderkey' as col, count(*) as n from t, q where o_orderkey < a1 - 1.5*(b1-a1) or o_orderkey > b1 + 1.5*(b1-a1)
      union all select 'o_custkey', count(*) from t, q where o_custkey < a2 - 1.5*(b2-a2) or o_custkey > b2 + 1.5*(b2-a2)
      union all select 'o_totalprice', count(*) from t, q where o_totalprice < a3 - 1.5*(b3-a3) or o_totalprice > b3 + 1.5*(b3-a3))
select * from (
  select 'high_missing' as rule, coalesce(string_agg(col, ',' order by col), '') as columns, cast(count(*) as bigint) as count from mr where r > 0.5
  union all select 'rows_with_missing', '', cast(sum(case when {_ANYNULL} then 1 else 0 end) as bigint) from t
  union all select 'outlier_columns', coalesce(string_agg(col, ',' order by col), ''), cast(count(*) as bigint) from o where n > 0
  union all select 'duplicate_rows', '', cast(d as bigint) from dup
  union all select 'rare_category_columns', coalesce(string_agg(col, ',' order by col), ''), cast(count(*) as bigint) from rare
) where count > 0""")
def quality_warnings(spark, sf):
    return Q.quality_warnings(orders_nulls(spark, sf))


@register("quality_sample", sql="""
select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders
order by md5(concat_ws('-', cast(o_orderkey as varchar), '42')) limit 5000""")
def quality_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return Q.cap_rows(o, max_rows=5000, key_cols=["o_orderkey"])


@register("target_distribution_class", sql="""
select o_orderstatus, cast(count(*) as bigint) as count from orders group by 1""")
def target_distribution_class(spark, sf):
    from tabflow.operators import infer as I
    return I.target_distribution(table(spark, sf, "orders"), "o_orderstatus", categorical=True)


@register("target_distribution_numeric", sql="""
select avg(o_totalprice) as mean, stddev_samp(o_totalprice) as std, min(o_totalprice) as min, max(o_totalprice) as max
from orders""")
def target_distribution_numeric(spark, sf):
    from tabflow.operators import infer as I
    return I.target_distribution(table(spark, sf, "orders"), "o_totalprice", categorical=False)


@register("target_analysis", sql=f"""
with t as {_ON}
select case when true then 'categorical' end as type, cast(sum((o_orderstatus is null)::int) as bigint) as missing_count,
  cast(count(distinct o_orderstatus) as bigint) as unique_values from t""")
def target_analysis(spark, sf):
    return Q.target_analysis(orders_nulls(spark, sf), "o_orderstatus")


@register("rows_with_missing", sql=f"""
with t as {_ON}
select o_orderkey, {_NULLSUM} as missing_cells from t where {_ANYNULL}""")
def rows_with_missing(spark, sf):
    return Q.rows_with_missing(orders_nulls(spark, sf), ["o_orderkey"])
