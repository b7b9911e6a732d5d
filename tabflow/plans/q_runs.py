"""Queries for run comparison, search progress and strategy.
Runs are evaluations of a price-band rule per order priority; trials are the
months of the order history in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import runs as R
from tabflow.operators import strategy as ST
from tabflow.plans.registry import ORACLE_SQL, register, table
from tabflow.plans.sqlgen import FIELD_TYPE_CASE, profile_sql


def _run_metrics(spark, sf):
    o = table(spark, sf, "orders")
    pred = F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 300000, "O").otherwise("P")
    ok = (F.col("o_orderstatus") == pred).cast("double")
    wide = o.groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        F.avg(ok).alias("accuracy"), F.count(F.lit(1)).cast("double").alias("n_rows"),
        (-F.avg(F.log(F.when(F.col("o_orderstatus") == pred, 0.9).otherwise(0.05)))).alias("log_loss"))
    return wide.unpivot(["run_id"], ["accuracy", "n_rows", "log_loss"], "metric_name", "metric_value")


_RM = """(select run_id, metric_name, metric_value from (
  select o_orderpriority as run_id,
    avg((o_orderstatus = case when o_totalprice < 150000 then 'F' when o_totalprice < 300000 then 'O' else 'P' end)::int::double) as accuracy,
    count(*)::double as n_rows,
    -avg(ln(case when o_orderstatus = case when o_totalprice < 150000 then 'F' when o_totalprice < 300000 then 'O' else 'P' end
      then 0.9 else 0.05 end)) as log_loss
  from orders group by 1) unpivot (metric_value for metric_name in (accuracy, n_rows, log_loss)))"""


@register("run_compare", sql=f"""
select run_id, max(case when metric_name = 'accuracy' then metric_value end) as accuracy,
  max(case when metric_name = 'log_loss' then metric_value end) as log_loss,
  max(case when metric_name = 'n_rows' then metric_value end) as n_rows from {_RM} m group by run_id""")
def run_compare(spark, sf):
    return R.compare_runs(_run_metrics(spark, sf))


@register("best_run", sql=f"""
select arg_max(run_id, metric_value) as run_id, 'accuracy' as metric_name, max(metric_value) as metric_value
from {_RM} m where metric_name = 'accuracy'""")
def best_run(spark, sf):
    return R.best_run(_run_metrics(spark, sf))


# leaderboards of the runs: three constant rules, scored by accuracy; the features
# of a run are the statuses that occur in it
def _boards(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run_id")).agg(*[
        F.avg((F.col("o_orderstatus") == s).cast("double")).alias(f"always_{s}") for s in "FOP"]).unpivot(
        ["run_id"], [f"always_{s}" for s in "FOP"], "model", "score_val")


_BOARDS = """(select run_id, model, score_val from (select o_orderpriority as run_id,
  avg((o_orderstatus = 'F')::int::double) as "always_F", avg((o_orderstatus = 'O')::int::double) as "always_O",
  avg((o_orderstatus = 'P')::int::double) as "always_P" from orders group by 1)
  unpivot (score_val for model in ("always_F", "always_O", "always_P")))"""


@register("run_summary", sql=f"""
with b as (select run_id, arg_max(model, score_val) as best_model, max(score_val) as best_score from {_BOARDS} x group by 1)
select m.run_id, cast(count(*) as bigint) as n_metrics, any_value(best_model) as best_model, any_value(best_score) as best_score,
  any_value(f.n) as feature_count
from {_RM} m left join b on b.run_id = m.run_id
left join (select o_orderpriority as run_id, count(distinct o_orderstatus) as n from orders group by 1) f on f.run_id = m.run_id
group by m.run_id""")
def run_summary(spark, sf):
    features = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("column"))
    return R.run_summary(_run_metrics(spark, sf), _boards(spark, sf), features)


@register("best_run_by_score", sql=f"""
select arg_max(run_id, score_val) as run_id, 'score_val' as metric_name, max(score_val) as metric_value from {_BOARDS} x""")
def best_run_by_score(spark, sf):
    return R.best_run(_run_metrics(spark, sf), _boards(spark, sf))


def _trials(spark, sf):
    o = table(spark, sf, "orders")
    pred = F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 300000, "O").otherwise("P")
    t = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("trial")).agg(
        F.avg((F.col("o_orderstatus") == pred).cast("double")).alias("val_score"))
    return t


@register("trial_best_so_far", sql="""
with t as (select strftime(o_orderdate, '%Y-%m') as trial,
  avg((o_orderstatus = case when o_totalprice < 150000 then 'F' when o_totalprice < 300000 then 'O' else 'P' end)::int::double) as val_score
  from orders group by 1),
p as (select *, max(val_score) over (order by trial rows between unbounded preceding and 1 preceding) as prev,
  row_number() over (order by trial) as pos from t),
i as (select *, prev is null or val_score > prev as improved from p),
l as (select *, max(case when improved then pos end) over (order by trial rows between unbounded preceding and current row) as last,
  max(val_score) over (order by trial rows between unbounded preceding and current row) as best_so_far from i)
select trial, val_score, improved, best_so_far, cast(pos - last as int) as since_improvement, pos - last >= 2 as stop from l""")
def trial_best_so_far(spark, sf):
    return R.trial_progress(_trials(spark, sf), "trial", "val_score", higher_better=True, patience=2)


_OR = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
       ("o_orderdate", "datetime"), ("o_orderpriority", "string")]


@register("strategy_recommendation", sql=f"""
with p as ({profile_sql("orders", [c for c in _OR if c[0] != "o_orderstatus"])}),
hc as (select count(*) as k from p where ({FIELD_TYPE_CASE}) in ('categorical', 'id', 'text') and (unique_ratio > 0.3 or nunique > 50000)),
c as (select o_orderstatus, count(*) as n from orders group by 1),
s as (select (select count(*) from orders) as n, (8.0 * 4 * (select count(*) from orders)
    + (select sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) from orders)) / 1048576.0 as mem,
  (select count(*) from c) as k, (select max(n) from c) as mx, (select min(n) from c) as mn, 5 as nf)
select case when n < 1000 then 'small' when n < 100000 then 'medium' else 'large' end as size_label,
  case when n >= 100000 or nf > 500 or mem > 2048 then 'medium_quality' else 'best_quality' end as preset,
  cast(case when n >= 100000 then 50 else 25 end as int) as max_models, n < 1000 as bagging,
  'log_loss' as primary_metric, mx / mn as imbalance_ratio, mx / mn > 1.5 as sample_weight,
  case when n < 500 then 'cv' else 'holdout' end as validation,
  cast(case when n < 500 then greatest(2, least(5, mn)) end as int) as n_folds,
  case when n < 500 then 'stratified' end as cv_type,
  case when n >= 500 then case when n < 1000 then 0.2 when n < 100000 then 0.15 else 0.1 end end as holdout_frac,
  cast(greatest(5, floor(n * 0.001)) as bigint) as rare_threshold, nf > 100 or mem > 1024 as enable_pca,
  case when not ((n >= 100000 or mem > 1024) or (select k from hc) > 0 or k > 50) then 'full'
       when (n >= 100000 or mem > 1024) and (select k from hc) = 0 then 'GBM,XGB,LR,CAT'
       when not (n >= 100000 or mem > 1024) and (select k from hc) = 0 then 'GBM,XGB,CAT,RF,XT,KNN,LR' else 'GBM,XGB,LR' end as model_space
from s""")
def strategy_recommendation(spark, sf):
    return ST.recommend(table(spark, sf, "orders"), "o_orderstatus", "multiclass_classification")


@register("strategy_user_choice", sql="select * replace ('medium_quality' as preset, cast(7 as int) as max_models) from (\n"
          + ORACLE_SQL["strategy_recommendation"] + "\n) x")
def strategy_user_choice(spark, sf):
    """G0 where the caller names preset and number of models."""
    return ST.recommend(table(spark, sf, "orders"), "o_orderstatus", "multiclass_classification", preset="medium_quality", max_models=7)


@register("strategy_many_classes", sql=f"""
with o as (select o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m') as month from orders),
p as ({profile_sql("orders", [c for c in _OR if c[0] in ("o_orderkey", "o_custkey", "o_totalprice")])}),
hc as (select count(*) as k from p where ({FIELD_TYPE_CASE}) in ('categorical', 'id', 'text') and (unique_ratio > 0.3 or nunique > 50000)),
c as (select month, count(*) as n from o group by 1),
s as (select (select count(*) from o) as n, (8.0 * 3 + 7) * (select count(*) from o) / 1048576.0 as mem,
  (select count(*) from c) as k, (select max(n) from c) as mx, (select min(n) from c) as mn, 3 as nf)
select case when n < 1000 then 'small' when n < 100000 then 'medium' else 'large' end as size_label,
  case when n >= 100000 or mem > 2048 then 'medium_quality' else 'best_quality' end as preset,
  cast(case when n >= 100000 then 50 else 25 end as int) as max_models, n < 1000 as bagging,
  'log_loss' as primary_metric, mx / mn as imbalance_ratio, mx / mn > 1.5 as sample_weight,
  case when n < 500 then 'cv' else 'holdout' end as validation,
  cast(case when n < 500 then greatest(2, least(5, mn)) end as int) as n_folds,
  case when n < 500 then 'stratified' end as cv_type,
  case when n >= 500 then case when n < 1000 then 0.2 when n < 100000 then 0.15 else 0.1 end end as holdout_frac,
  cast(greatest(5, floor(n * 0.001)) as bigint) as rare_threshold, mem > 1024 as enable_pca,
  case when not ((n >= 100000 or mem > 1024) or (select k from hc) > 0 or k > 50) then 'full'
       when (n >= 100000 or mem > 1024) and (select k from hc) = 0 then 'GBM,XGB,LR,CAT'
       when not (n >= 100000 or mem > 1024) and (select k from hc) = 0 then 'GBM,XGB,CAT,RF,XT,KNN,LR' else 'GBM,XGB,LR' end as model_space
from s""")
def strategy_many_classes(spark, sf):
    """G0 for a target of more than 50 classes (the months of the order history)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return ST.recommend(o, "month", "multiclass_classification")


def _runs(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.max("o_orderdate").alias("created_at")).withColumn(
        "status", F.when(F.col("run_id") == "4-NOT SPECIFIED", "running").otherwise("completed"))


@register("run_states", sql="""
select r.run_id, case when o.run_id is null then 'missing' when r.run_id = '4-NOT SPECIFIED' then 'not completed' else 'completed' end as state
from (values ('1-URGENT'), ('4-NOT SPECIFIED'), ('9-UNKNOWN')) r(run_id) left join (select distinct o_orderpriority as run_id from orders) o using (run_id)""")
def run_states(spark, sf):
    """L2: requested runs that are missing or not completed."""
    return R.run_states(_runs(spark, sf), ["1-URGENT", "4-NOT SPECIFIED", "9-UNKNOWN"])


@register("newest_runs", sql="""
select strftime(o_orderdate, '%Y-%m-%d') as run_id, max(o_orderdate) as created_at from orders group by 1 order by 2 desc, 1 limit 25""")
def newest_runs(spark, sf):
    """A page of the latest runs (one a day)."""
    days = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_id")).agg(
        F.max("o_orderdate").alias("created_at"))
    return R.newest_first(days, n=25)


@register("experiment_trials", sql="""
select o_orderpriority as experiment_id, strftime(o_orderdate, '%Y-%m') as trial_id, min(o_orderdate) as created_at
from orders where o_orderpriority = '2-HIGH' group by 1, 2""")
def experiment_trials(spark, sf):
    """One experiment's trials."""
    trials = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("experiment_id"), F.date_format("o_orderdate", "yyyy-MM").alias("trial_id")).agg(
        F.min("o_orderdate").alias("created_at"))
    return R.trials_in_order(trials, "2-HIGH")


_REQUESTED = ["1-URGENT", "3-MEDIUM", "9-UNKNOWN"]


@register("run_filter", sql=f"""
select r.run_id, coalesce(m.n, 0) as n_metrics, m.n is null as missing from (values {', '.join(f"('{r}')" for r in _REQUESTED)}) r(run_id)
left join (select run_id, cast(count(*) as bigint) as n from {_RM} x group by 1) m on m.run_id = r.run_id""")
def run_filter(spark, sf):
    """L2: requested run ids with their metric count (semi join) or flagged
    missing (anti join)."""
    m = _run_metrics(spark, sf)
    present = R.compare_runs(m, _REQUESTED).select("run_id").join(
        m.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_metrics")), "run_id")
    missing = R.missing_runs(m, _REQUESTED).select("run_id", F.lit(0).cast("bigint").alias("n_metrics"))
    return present.select("run_id", "n_metrics", F.lit(False).alias("missing")).unionByName(
        missing.select("run_id", "n_metrics", F.lit(True).alias("missing")))
