"""Queries for splits, folds and class imbalance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import folds as FO
from tabflow.operators import imbalance as IM
from tabflow.operators import split as SP
from tabflow.plans.registry import register, table


def _md5(key: str) -> str:
    return f"md5(concat_ws('-', cast({key} as varchar), '42'))"


def _u(key: str) -> str:
    return f"(('0x' || substr({_md5(key)}, 1, 8))::BIGINT / 4294967296.0)"


@register("split_random", sql=f"""
select o_orderkey, case when row_number() over (order by {_md5('o_orderkey')}, o_orderkey)
  <= ceil(0.2 * (select count(*) from orders)) then 'test' else 'train' end as split from orders""")
def split_random(spark, sf):
    return SP.random_split(table(spark, sf, "orders").select("o_orderkey"), 0.2, ["o_orderkey"])


def _strat_sql(src: str, key: str, y: str, frac: float) -> str:
    return f"""
with r as (select {key}, {y}, row_number() over (partition by {y} order by {_md5(key)}, {key}) as rk,
  count(*) over (partition by {y}) as nc from {src} where {y} is not null),
s as (select count(*) as n, count(distinct {y}) as k, count(*) filter (where nc = 1) as single from r),
z as (select *, row_number() over (partition by rk > 2 order by {_md5(key)}, {key}) as place from r),
l as (select {key}, {y}, case when nc = 1 then ['train', 'test'] when rk = 2 then ['test']
  when rk > 2 and place <= round_even(cast(n + single as double) * cast({frac} as double), 0) - k then ['test']
  else ['train'] end as labels from z, s)
select {key}, {y}, unnest(labels) as split from l"""


@register("split_stratified", sql=_strat_sql("orders", "o_orderkey", "o_orderstatus", 0.2))
def split_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_split(o, "o_orderstatus", 0.2, ["o_orderkey"])


@register("split_three_way", sql=f"""
with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {_md5('o_orderkey')}, o_orderkey) as rk,
  count(*) over (partition by o_orderpriority) as nc from orders),
l as (select *, greatest(1, round(nc * 0.15)) as v, greatest(1, round(nc * 0.15)) as t from r)
select o_orderkey, o_orderpriority, unnest(case when nc = 1 then ['train', 'val', 'test']
  when nc = 2 then case when rk = 1 then ['train'] else ['val', 'test'] end
  when rk = 1 then ['train'] when rk <= v + 1 then ['val'] when rk <= v + t + 1 then ['test'] else ['train'] end) as split
from l""")
def split_three_way(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return SP.three_way_split(o, "o_orderpriority", 0.15, 0.15, ["o_orderkey"])


# orders whose class is the priority, except the most expensive ones which
# each form a class of their own (singleton classes).
def _orders_vip(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_totalprice") > 499000,
                                         F.concat(F.lit("vip-"), F.col("o_orderkey").cast("string")))
                    .otherwise(F.col("o_orderpriority")).alias("segment"))


_VIP = "(select o_orderkey, case when o_totalprice > 499000 then 'vip-' || cast(o_orderkey as varchar) else o_orderpriority end as segment from orders)"


@register("split_singletons", sql=_strat_sql(_VIP, "o_orderkey", "segment", 0.2))
def split_singletons(spark, sf):
    return SP.stratified_split(_orders_vip(spark, sf), "segment", 0.2, ["o_orderkey"], rare_class_strategy="auto")


@register("split_drop_rare", sql=_strat_sql(
    f"(select * from {_VIP} v where segment in (select segment from {_VIP} w group by 1 having count(*) >= 2))",
    "o_orderkey", "segment", 0.2))
def split_drop_rare(spark, sf):
    return SP.stratified_split(_orders_vip(spark, sf), "segment", 0.2, ["o_orderkey"], rare_class_strategy="drop")


@register("sample_rows", sql=f"""
select event_id, user_id, value from events order by {_md5('event_id')}, event_id limit 1000""")
def sample_rows(spark, sf):
    return SP.sample_rows(table(spark, sf, "events").select("event_id", "user_id", "value"), 1000, ["event_id"])


@register("imbalance_ratio", sql="""
select cast(sum(n) as bigint) as n_rows, cast(count(*) as bigint) as n_classes, cast(max(n) as bigint) as max_class,
  cast(min(n) as bigint) as min_class, case when count(*) < 2 then 1.0 else max(n) / min(n) end as imbalance_ratio
from (select toxic, count(*) as n from labels where toxic is not null group by 1)""")
def imbalance_ratio(spark, sf):
    return IM.imbalance_summary(table(spark, sf, "labels"), "toxic")


@register("class_weights", sql="""
with c as (select toxic, count(*) as n from labels group by 1)
select doc_id, l.toxic, (select sum(n) from c) / ((select count(*) from c) * c.n) as _sample_weight
from labels l join c on l.toxic = c.toxic""")
def class_weights(spark, sf):
    return IM.class_weights(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic")


@register("oversample_random", sql=f"""
with c as (select toxic, count(*) as n from labels group by 1), m as (select max(n) as m from c),
r as (select doc_id, l.toxic, c.n, row_number() over (partition by l.toxic order by {_md5('doc_id')}, doc_id) as rk
  from labels l join c on l.toxic = c.toxic)
select doc_id, toxic, cast(g.copy as int) as copy from r, m,
  lateral (select unnest(range(0, cast(floor(m / n) + case when rk <= m % n then 1 else 0 end as bigint))) as copy) g""")
def oversample_random(spark, sf):
    return IM.random_oversample(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"])


@register("undersample_random", sql=f"""
with r as (select doc_id, toxic, row_number() over (partition by toxic order by {_md5('doc_id')}, doc_id) as rk from labels)
select doc_id, toxic from r where rk <= (select min(n) from (select count(*) as n from labels group by toxic))""")
def undersample_random(spark, sf):
    return IM.random_undersample(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"])


def _labelled_docs(spark, sf):
    l = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return l.join(d, "doc_id")


@register("sampling_choice", sql="""
with t as (select l.toxic, l.quality, d.lang, d.n_chars from labels l join documents d using (doc_id)),
c as (select toxic, count(*) as n from t group by 1),
s as (select sum(n) as n, max(n) / min(n) as r, min(n) as mn from c),
h as (select max(case when quality is null or lang is null or n_chars is null then 1 else 0 end) as hm from t)
select case when r <= 1.5 then 'none' when r <= 3 then 'class_weight'
  when n > 100000 then case when mn < 100 then 'class_weight' else 'random_under' end
  when hm = 0 then 'smotenc' else 'random_over' end as method, r as imbalance_ratio,
  case when r > 3 and n <= 100000 and hm = 0 then cast(least(5, greatest(1, mn - 1)) as int) end as k_neighbors from s, h""")
def sampling_choice(spark, sf):
    t = _labelled_docs(spark, sf).select("toxic", "quality", "lang", "n_chars")
    return IM.sampling_choice(t, "toxic", "binary_classification")


@register("kfold", sql=f"""
select o_orderkey, cast((row_number() over (order by {_md5('o_orderkey')}, o_orderkey) - 1) % 5 as int) as fold from orders""")
def kfold(spark, sf):
    return FO.kfold(table(spark, sf, "orders").select("o_orderkey"), 5, ["o_orderkey"])


@register("stratified_kfold", sql=f"""
select o_orderkey, o_orderstatus, cast((row_number() over (partition by o_orderstatus order by {_md5('o_orderkey')}, o_orderkey) - 1) % 5 as int) as fold
from orders""")
def stratified_kfold(spark, sf):
    return FO.stratified_kfold(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 5, ["o_orderkey"])


@register("time_series_split", sql="""
with r as (select event_id, row_number() over (order by ts, event_id) as pos, count(*) over () as n from events),
p as (select *, n // 5 as sz, n - 4 * (n // 5) as st from r)
select event_id, cast(case when pos <= st then -1 else floor((pos - st - 1) / sz) end as int) as block from p""")
def time_series_split(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return FO.time_series_blocks(e, 4, ["ts", "event_id"]).select("event_id", "block")


@register("group_kfold", sql=f"""
select event_id, user_id, cast(floor({_u('user_id')} * 5) as int) as fold from events""")
def group_kfold(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return FO.group_kfold(e, "user_id", 5, mode="hash")


@register("group_kfold_balanced", sql=f"""
with g as (select user_id, count(*) as n from events group by 1),
r as (select user_id, (row_number() over (order by n desc, {_u('user_id')}, user_id) - 1) % 10 as p from g)
select event_id, user_id, cast(case when p < 5 then p else 9 - p end as int) as fold from events join r using (user_id)""")
def group_kfold_balanced(spark, sf):
    """groups dealt out by size."""
    return FO.group_kfold(table(spark, sf, "events").select("event_id", "user_id"), "user_id", 5)
