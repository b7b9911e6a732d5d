"""Queries for evaluation metrics (I1-I16). Inputs are predictions derived
from the tables by fixed rules (price bands → status, value → purchase
score, line attributes → return-flag probabilities)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import metrics as M
from tabflow.plans.derived import is_train, train_sql
from tabflow.plans.registry import register, table


def _orders_pred(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("label"),
                    F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 300000, "O")
                    .otherwise("P").alias("prediction"))


_OP = """(select o_orderkey, o_orderstatus as label, case when o_totalprice < 150000 then 'F'
  when o_totalprice < 300000 then 'O' else 'P' end as prediction from orders)"""


def _events_scored(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"),
                    (F.col("value") / 500.0).alias("score"))


_ES = "(select event_id, (event_type = 'purchase')::int as label, value / 500.0 as score from events)"


def _lineitem_probs(spark, sf):
    li = table(spark, sf, "lineitem")
    tot = F.col("l_discount") + F.col("l_tax") + F.col("l_quantity") / 500.0
    return li.select(F.col("l_returnflag").alias("label"), (F.col("l_discount") / tot).alias("p_A"),
                     (F.col("l_tax") / tot).alias("p_N"), ((F.col("l_quantity") / 500.0) / tot).alias("p_R"))


_LP = """(select l_returnflag as label, l_discount / t as p_A, l_tax / t as p_N, (l_quantity / 500.0) / t as p_R
  from (select *, l_discount + l_tax + l_quantity / 500.0 as t from lineitem))"""
_PROBS = {"A": "p_A", "N": "p_N", "R": "p_R"}

_CM_SQL = f"""
with p as {_OP}, l as (select distinct v from (select label as v from p union select prediction from p) where v is not null),
c as (select label, prediction, count(*) as n from p group by 1, 2)
select a.v as actual, b.v as predicted, cast(coalesce(c.n, 0) as bigint) as count
from l a cross join l b left join c on c.label = a.v and c.prediction = b.v"""


@register("confusion_matrix", sql=_CM_SQL)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_orders_pred(spark, sf), "label", "prediction")


_PL_SQL = f"""
with cm as ({_CM_SQL}),
s as (select a.actual as label, (select count from cm x where x.actual = a.actual and x.predicted = a.actual) as tp,
  (select sum(count) from cm x where x.predicted = a.actual) as pred_n, sum(a.count) as support from cm a group by a.actual)
select label, cast(tp as bigint) as tp, cast(pred_n - tp as bigint) as fp, cast(support - tp as bigint) as fn,
  cast(support as bigint) as support, case when pred_n > 0 then tp / pred_n else 0 end as precision,
  case when support > 0 then tp / support else 0 end as recall,
  case when (case when pred_n > 0 then tp / pred_n else 0 end) + (case when support > 0 then tp / support else 0 end) > 0
    then 2 * (tp / pred_n) * (tp / support) / ((tp / pred_n) + (tp / support)) else 0 end as f1 from s"""


@register("prf_by_label", sql=_PL_SQL)
def prf_by_label(spark, sf):
    return M.per_label(M.label_pairs(_orders_pred(spark, sf), "label", "prediction"))


@register("prf_averages", sql=f"""
with pl as ({_PL_SQL}), t as (select sum(tp) tp, sum(fp) fp, sum(fn) fn from pl),
m as (select tp / (tp + fp) as mp, tp / (tp + fn) as mr from t)
select avg(precision) as precision_macro, avg(recall) as recall_macro, avg(f1) as f1_macro,
  sum(precision * support) / sum(support) as precision_weighted, sum(recall * support) / sum(support) as recall_weighted,
  sum(f1 * support) / sum(support) as f1_weighted, (select mp from m) as precision_micro, (select mr from m) as recall_micro,
  (select 2 * mp * mr / (mp + mr) from m) as f1_micro from pl""")
def prf_averages(spark, sf):
    return M.averages(M.label_pairs(_orders_pred(spark, sf), "label", "prediction"))


@register("mcc_kappa_balanced", sql=f"""
with p as {_OP}, t as (select label as l, count(*)::double as tn from p group by 1),
q as (select prediction as l, count(*)::double as pn from p group by 1),
m as (select coalesce(t.l, q.l) as l, coalesce(tn, 0) as tn, coalesce(pn, 0) as pn from t full join q on t.l = q.l),
s as (select (select count(*) from p where label = prediction)::double as c, (select count(*) from p)::double as n,
  sum(tn * pn) as dot, sum(pn * pn) as pp, sum(tn * tn) as tt from m),
b as (select avg(r) as bal from (select sum((label = prediction)::int) / count(*) as r from p group by label))
select c / n as accuracy, (c * n - dot) / sqrt((n * n - tt) * (n * n - pp)) as mcc,
  ((c / n) - dot / (n * n)) / (1 - dot / (n * n)) as cohens_kappa, (select bal from b) as balanced_accuracy from s""")
def mcc_kappa_balanced(spark, sf):
    return M.agreement(M.label_pairs(_orders_pred(spark, sf), "label", "prediction"))


@register("roc_auc", sql=f"""
with e as {_ES}, r as (select score, label, row_number() over (order by score) as rn from e),
a as (select score, (min(rn) + max(rn)) / 2.0 as ar from r group by score),
k as (select sum(case when label = 1 then 1 else 0 end)::double as P, sum(case when label = 0 then 1 else 0 end)::double as N from e)
select (sum(ar) - P * (P + 1) / 2) / (P * N) as auc from r join a using (score), k where label = 1 group by P, N""")
def roc_auc(spark, sf):
    e = _events_scored(spark, sf)
    return M.roc_auc(e, F.col("label") == 1, F.col("score"))


_CUM = f"""
with e as {_ES}, g as (select score, sum(label) as pos, sum(1 - label) as neg from e group by score),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tp,
  sum(neg) over (order by score desc rows between unbounded preceding and current row) as fp,
  sum(pos) over () as P, sum(neg) over () as N from g)"""


@register("average_precision", sql=_CUM + "\nselect sum(pos / P * tp / (tp + fp)) as average_precision from c")
def average_precision(spark, sf):
    e = _events_scored(spark, sf)
    return M.average_precision(e, F.col("label") == 1, F.col("score"))


@register("roc_curve", sql=_CUM + "\nselect score as threshold, fp / N as fpr, tp / P as tpr from c")
def roc_curve(spark, sf):
    e = _events_scored(spark, sf)
    return M.roc_curve(e, F.col("label") == 1, F.col("score"))


@register("pr_curve", sql=_CUM + "\nselect score as threshold, tp / (tp + fp) as precision, tp / P as recall from c")
def pr_curve(spark, sf):
    e = _events_scored(spark, sf)
    return M.pr_curve(e, F.col("label") == 1, F.col("score"))


@register("log_loss", sql=f"""
select -avg(ln(least(greatest(case label when 'A' then p_A when 'N' then p_N else p_R end, 1e-15), 1 - 1e-15))) as log_loss
from {_LP} t""")
def log_loss(spark, sf):
    return M.log_loss(_lineitem_probs(spark, sf), "label", _PROBS)


def _ovr_sql() -> str:
    parts = []
    for k, c in _PROBS.items():
        parts.append(f"""select '{k}' as cls, score, (label = '{k}')::int as y from (select label, {c} as score from {_LP} t)""")
    return f"""
with lg as ({' union all '.join(parts)}), g as (select cls, score, sum(y) as pos, sum(1 - y) as neg from lg group by 1, 2),
c as (select *, sum(pos) over (partition by cls order by score desc rows between unbounded preceding and current row) as tp,
  sum(neg) over (partition by cls order by score desc rows between unbounded preceding and current row) as fp,
  sum(pos) over (partition by cls) as P, sum(neg) over (partition by cls) as N from g)"""


@register("ovr_auc", sql=_ovr_sql() + """
select cls, sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)) as auc, sum(pos / P * tp / (tp + fp)) as average_precision
from c group by cls""")
def ovr_auc(spark, sf):
    return M.ovr_auc(_lineitem_probs(spark, sf), "label", _PROBS)


@register("ovr_auc_macro", sql=_ovr_sql() + """
select avg(auc) as auc_macro, avg(ap) as ap_macro from (select cls, sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)) as auc,
  sum(pos / P * tp / (tp + fp)) as ap from c group by cls)""")
def ovr_auc_macro(spark, sf):
    return M.ovr_macro(_lineitem_probs(spark, sf), "label", _PROBS)


@register("macro_roc_grid", sql=_ovr_sql() + """,
pts as (select cls, fp / N as x, tp / P as y from c union all select distinct cls, 0.0, 0.0 from c),
px as (select cls, x, min(y) as ylo, max(y) as yhi from pts group by 1, 2),
grid as (select cls, g, g / 99.0 as gx from (select distinct cls from c), range(100) t(g)),
lo as (select grid.cls, g, gx, arg_max(px.x, px.x) as x0, arg_max(yhi, px.x) as y0 from grid join px on px.cls = grid.cls and px.x <= gx group by 1, 2, 3),
hi as (select grid.cls, g, gx, arg_min(px.x, px.x) as x1, arg_min(ylo, px.x) as y1 from grid join px on px.cls = grid.cls and px.x >= gx group by 1, 2, 3),
it as (select lo.cls, lo.g, lo.gx, case when x1 is null or x0 = lo.gx or x1 = x0 then y0 else y0 + (y1 - y0) * (lo.gx - x0) / (x1 - x0) end as tpr
  from lo left join hi on lo.cls = hi.cls and lo.g = hi.g)
select cast(g as int) as point, any_value(gx) as fpr, avg(tpr) as tpr from it group by g""")
def macro_roc_grid(spark, sf):
    return M.macro_roc_grid(_lineitem_probs(spark, sf), "label", _PROBS)


@register("macro_pr_grid", sql=_ovr_sql() + """,
pts as (select cls, tp / P as x, tp / (tp + fp) as y from c union all select distinct cls, 0.0, 1.0 from c),
px as (select cls, x, max(y) as y_in, min(y) as y_out from pts group by 1, 2),
grid as (select cls, g, g / 99.0 as gx from (select distinct cls from c), range(100) t(g)),
lo as (select grid.cls, g, gx, arg_max(px.x, px.x) as x0, arg_max(y_out, px.x) as y0 from grid join px on px.cls = grid.cls and px.x <= gx group by 1, 2, 3),
hi as (select grid.cls, g, gx, arg_min(px.x, px.x) as x1, arg_min(y_in, px.x) as y1 from grid join px on px.cls = grid.cls and px.x >= gx group by 1, 2, 3),
it as (select lo.cls, lo.g, lo.gx, case when x1 is null or x0 = lo.gx or x1 = x0 then y0 else y0 + (y1 - y0) * (lo.gx - x0) / (x1 - x0) end as v
  from lo left join hi on lo.cls = hi.cls and lo.g = hi.g)
select cast(g as int) as point, any_value(gx) as recall, avg(v) as precision from it group by g""")
def macro_pr_grid(spark, sf):
    return M.macro_pr_grid(_lineitem_probs(spark, sf), "label", _PROBS)


_LR = "(select l_extendedprice as y, 1000.0 * l_quantity as pred from lineitem)"


def _lineitem_reg(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_extendedprice").alias("y"), (F.lit(1000.0) * F.col("l_quantity")).alias("pred"))


@register("regression_metrics", sql=f"""
select avg(abs(y - pred)) as mae, avg((y - pred) * (y - pred)) as mse, sqrt(avg((y - pred) * (y - pred))) as rmse,
  1 - avg((y - pred) * (y - pred)) / var_pop(y) as r2, avg(abs(y - pred) / greatest(abs(y), 1e-10)) * 100 as mape,
  avg(2 * abs(y - pred) / (abs(y) + abs(pred) + 1e-10)) * 100 as smape, avg(y - pred) as residual_mean,
  stddev_pop(y - pred) as residual_std from {_LR} t""")
def regression_metrics(spark, sf):
    return M.regression_metrics(_lineitem_reg(spark, sf), "y", "pred")


@register("residual_histogram", sql=f"""
with r as (select y - pred as r from {_LR} t), m as (select min(r) lo, max(r) hi, (max(r) - min(r)) / 20.0 as w from r),
b as (select least(cast(floor((r - lo) / w) as int), 19) as bin, count(*) as n from r, m group by 1)
select cast(g as int) as bin, lo + g * w as lower, lo + (g + 1) * w as upper, cast(coalesce(n, 0) as bigint) as count
from range(20) t(g) cross join m left join b on b.bin = g""")
def residual_histogram(spark, sf):
    return M.residual_histogram(_lineitem_reg(spark, sf), "y", "pred")


@register("residual_grid", sql=f"""
with r as (select pred as p, y - pred as r from {_LR} t),
m as (select min(p) p0, (max(p) - min(p)) / 20.0 as pw, min(r) r0, (max(r) - min(r)) / 20.0 as rw from r)
select least(cast(floor((p - p0) / pw) as int), 19) as pred_bin, least(cast(floor((r - r0) / rw) as int), 19) as residual_bin,
  count(*) as count from r, m group by 1, 2""")
def residual_grid(spark, sf):
    return M.residual_grid(_lineitem_reg(spark, sf), "y", "pred")


_TH = ", ".join(f"({i}, {t!r})" for i, t in enumerate(M.THRESHOLDS))


@register("best_threshold", sql=f"""
with e as {_ES}, t(i, t) as (values {_TH}), P as (select sum(label) as P from e),
f as (select i, t, case when sum((score >= t)::int) + max(P.P) > 0 then 2 * sum(case when score >= t then label else 0 end)
  / (sum((score >= t)::int) + max(P.P)) else 0 end as f1 from t cross join e cross join P group by i, t),
b as (select * from f where f1 = (select max(f1) from f) and f1 > 0 order by i limit 1)
select 0.5 as default_threshold, coalesce((select t from b), 0.5) as optimal_threshold, round(coalesce((select f1 from b), 0.0), 6) as best_f1""")
def best_threshold(spark, sf):
    e = _events_scored(spark, sf)
    return M.best_threshold(e, F.col("label") == 1, F.col("score"))


@register("metrics_by_split", sql=f"""
select case when {train_sql('o_orderkey')} then 'train' else 'test' end as split, cast(count(*) as bigint) as n,
  avg((label = prediction)::int::double) as accuracy, 1 - avg((label = prediction)::int::double) as error_rate
from {_OP} p group by 1""")
def metrics_by_split(spark, sf):
    p = _orders_pred(spark, sf).withColumn("split", F.when(is_train("o_orderkey"), "train").otherwise("test"))
    return M.metrics_by_split(p, "label", "prediction")
