"""Queries for the fitted pipeline, model training, scoring, explanation and
cross-validation (E19-E21, H1-H8, J1-J2, K1-K7, F24). Training is not SQL,
so most are rows-only; rule-based scorers give SQL-checkable leaderboards."""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabflow.operators import explain as EX
from tabflow.operators import metrics as M
from tabflow.operators import models as MD
from tabflow.operators import score as SC
from tabflow.operators import selection as SEL
from tabflow.operators import tree_shap as TS
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig, PreprocessorModel
from tabflow.plans.derived import is_train, train_sql
from tabflow.plans.registry import register, table
from tabflow.session import scratch_path


def _docs(spark, sf):
    """labels ⋈ documents: toxic (target), quality, n_chars, lang, source."""
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id").select("doc_id", F.col("toxic").cast("string").alias("toxic"), "quality",
                                          "n_chars", "lang", "source")


def _small_families():
    return {"LogisticRegression": LogisticRegression(maxIter=30, regParam=0.01),
            "RandomForest": RandomForestClassifier(numTrees=20, maxDepth=6, seed=42),
            "DecisionTree": DecisionTreeClassifier(maxDepth=5, seed=42),
            "GBT": GBTClassifier(maxIter=10, maxDepth=3, seed=42)}


def _fitted(spark, sf):
    d = _docs(spark, sf)
    tr, va = d.where(is_train("doc_id")), d.where(~is_train("doc_id"))
    pre = Preprocessor(PreprocessorConfig(target="toxic", keep_columns=["doc_id"])).fit(tr)
    return d, tr, va, pre


def _orders_customers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                          "o_orderpriority")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", "c_nationkey")
    return o.join(c, "o_custkey")


@register("feature_pipeline")
def feature_pipeline(spark, sf):
    oc = _orders_customers(spark, sf)
    pre = Preprocessor(PreprocessorConfig(target="o_orderstatus", keep_columns=["o_orderkey"],
                                          drop_columns=["o_custkey"])).fit(oc.where(is_train("o_orderkey")))
    out = pre.transform(oc)
    return out.select("o_orderkey", "o_orderstatus", *pre.feature_columns)


@register("pipeline_reload", sql="select o_orderkey, true as same from orders join customer on c_custkey = o_custkey")
def pipeline_reload(spark, sf):
    """Every row comes out of the reloaded pipeline as it came out of the fitted one."""
    oc = _orders_customers(spark, sf)
    pre = Preprocessor(PreprocessorConfig(target="o_orderstatus", keep_columns=["o_orderkey"],
                                          drop_columns=["o_custkey"])).fit(oc.where(is_train("o_orderkey")))
    path = scratch_path(spark, "preprocessor")
    pre.save(path)
    again = PreprocessorModel.load(spark, path)
    cols = ["o_orderstatus"] + pre.feature_columns
    a, b = (m.transform(oc).select("o_orderkey", F.struct(*cols).alias(x)) for m, x in ((pre, "a"), (again, "b")))
    return a.join(b, "o_orderkey").select("o_orderkey", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@register("train_leaderboard")
def train_leaderboard(spark, sf):
    d, tr, va, pre = _fitted(spark, sf)
    lb, _, _ = MD.train_family(pre.transform(tr), pre.transform(va), "toxic", "binary_classification",
                               pre.feature_columns, families=_small_families(), metric="accuracy")
    return lb.select("model", "metric", "score_val")


@register("native_importance")
def native_importance(spark, sf):
    d, tr, va, pre = _fitted(spark, sf)
    pm = MD.build_pipeline(RandomForestClassifier(numTrees=20, maxDepth=6, seed=42), pre.feature_columns, "toxic",
                           "binary_classification").fit(pre.transform(tr))
    return MD.native_importance(pm, pre.feature_columns)


@register("holdout_selection")
def holdout_selection(spark, sf):
    d, tr, va, pre = _fitted(spark, sf)
    lb, _, _ = MD.train_family(pre.transform(tr), pre.transform(va), "toxic", "binary_classification",
                               pre.feature_columns, families=_small_families(), metric="log_loss")
    return lb.orderBy(F.col("score_val").desc(), "model").limit(1).select("model", "metric", "score_val")


@register("weighted_training")
def weighted_training(spark, sf):
    from tabflow.operators.imbalance import class_weights
    d, tr, va, pre = _fitted(spark, sf)
    trw = class_weights(pre.transform(tr), "toxic")
    lb, _, _ = MD.train_family(trw, pre.transform(va), "toxic", "binary_classification", pre.feature_columns,
                               families={"LogisticRegression": LogisticRegression(maxIter=30, regParam=0.01)},
                               metric="accuracy", weight_col="_sample_weight")
    return lb.select("model", "metric", "score_val")


@register("stacking")
def stacking(spark, sf):
    """H4: level 2 learns from out-of-fold predictions with refitted preprocessors and is
    scored on rows that neither level has seen."""
    d = _docs(spark, sf)
    fam = {"LogisticRegression": LogisticRegression(maxIter=30), "DecisionTree": DecisionTreeClassifier(maxDepth=5, seed=42)}
    _, preds = SEL.stack(d.where(is_train("doc_id")), d.where(~is_train("doc_id")), "toxic", "binary_classification", ["doc_id"], fam)
    return preds.where("model = 'Stacked'").select("doc_id", "toxic", F.col("p_pos").alias("p_stacked"))


# least squares on one feature has a closed form in every fold
@register("kfold_training", sql="""
with r as (select o_totalprice / 1000 as y, o_custkey as x,
    (row_number() over (order by md5(o_orderkey::varchar || '-42'), o_orderkey) - 1) % 3 as fold from orders),
f as (select k.fold, regr_slope(y, x) as b, regr_intercept(y, x) as a from (values (0), (1), (2)) k(fold) join r on r.fold <> k.fold group by 1)
select 'LeastSquares' as model, 'rmse' as metric, -sqrt(avg((y - a - b * x) * (y - a - b * x))) as score_val,
  'cv' as validation, 3 as n_folds from r join f on f.fold = r.fold""")
def kfold_training(spark, sf):
    """H3: pooled out-of-fold error of a family with a closed form."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("y"))
    cfg = PreprocessorConfig(target="y", dedupe=False, feature_engineering=False, log_skew_threshold=1e9)
    board, _, _ = SEL.train_validated(o, "y", "regression", ["o_orderkey"], {"LeastSquares": LinearRegression(solver="normal")}, cfg,
                                      n_folds=3, refit=False)
    return board


@register("kfold_classification")
def kfold_classification(spark, sf):
    """H3: stratified folds, every family and fold as one pool of jobs."""
    fam = {"LogisticRegression": LogisticRegression(maxIter=30, regParam=0.01), "DecisionTree": DecisionTreeClassifier(maxDepth=5, seed=42)}
    return SEL.train_validated(_docs(spark, sf), "toxic", "binary_classification", ["doc_id"], fam, n_folds=3, refit=False)[0]


@register("weighted_ensemble")
def weighted_ensemble(spark, sf):
    d, tr, va, pre = _fitted(spark, sf)
    lb, models, preds = MD.train_family(pre.transform(tr), pre.transform(va), "toxic", "binary_classification",
                                       pre.feature_columns, families=_small_families(), metric="accuracy",
                                       key_col="doc_id")
    wide = preds.groupBy("doc_id", "label").pivot("model", list(models)).agg(F.first("p_pos"))
    weights, loss = MD.greedy_ensemble(wide, "label", {m: m for m in models})
    w = spark.createDataFrame(sorted(weights.items()), "model string, weight double")
    return w.join(lb.select("model", "score_val"), "model").select("model", "weight", "score_val")


# Rule scorers on events (score = a column scaled to [0, 1]) as "models";
# the WeightedEnsemble is their mean. score_val is the AUC for purchases.
def _rule_models(spark, sf):
    e = table(spark, sf, "events")
    y = (F.col("event_type") == "purchase")
    v, u = F.col("value") / 500.0, F.col("user_id") / 150.0
    ms = {"ValueScore": v, "UserScore": u, "WeightedEnsemble_L2": (v + u) / 2.0}
    parts = [M.roc_auc(e, y, s).select(F.lit(name).alias("model"), F.col("auc").alias("score_val")) for name, s in ms.items()]
    lb = parts[0]
    for p in parts[1:]:
        lb = lb.unionByName(p)
    return lb


def _rule_models_sql() -> str:
    parts = []
    for name, expr in (("ValueScore", "value / 500.0"), ("UserScore", "user_id / 150.0"),
                       ("WeightedEnsemble_L2", "(value / 500.0 + user_id / 150.0) / 2.0")):
        parts.append(f"select '{name}' as model, {expr} as score, (event_type = 'purchase')::int as label from events")
    return f"""
with s as ({' union all '.join(parts)}),
r as (select model, score, label, row_number() over (partition by model order by score) as rn from s),
a as (select model, score, (min(rn) + max(rn)) / 2.0 as ar from r group by 1, 2),
k as (select model, sum(label)::double as P, sum(1 - label)::double as N from s group by 1),
lb as (select r.model, (sum(ar) - max(P) * (max(P) + 1) / 2) / (max(P) * max(N)) as score_val
  from r join a on r.model = a.model and r.score = a.score join k on k.model = r.model where label = 1 group by r.model)"""


@register("leaderboard", sql=_rule_models_sql() + "\nselect model, score_val from lb")
def leaderboard(spark, sf):
    return _rule_models(spark, sf).orderBy(F.col("score_val").desc())


_BOARD_METRICS = ("accuracy", "precision", "recall", "f1", "f1_macro", "balanced_accuracy", "roc_auc", "auc_pr", "log_loss")


@register("leaderboard_metrics", sql="""
with s as (select 'ValueScore' as model, value / 500.0 as p, (event_type = 'purchase')::int as y from events
  union all select 'UserScore', user_id / 150.0, (event_type = 'purchase')::int from events),
c as (select model, sum((y = 1 and p >= 0.5)::int)::double as tp, sum((y = 0 and p >= 0.5)::int)::double as fp,
  sum((y = 1 and p < 0.5)::int)::double as fn, sum((y = 0 and p < 0.5)::int)::double as tn,
  -avg(ln(least(greatest(case when y = 1 then p else 1 - p end, 1e-15), 1 - 1e-15))) as ll from s group by 1),
f as (select *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) as f0 from c),
g as (select model, p as score, sum(y) as pos, sum(1 - y) as neg from s group by 1, 2),
u as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as P, sum(neg) over (partition by model) as N
  from g window w as (partition by model order by score desc rows between unbounded preceding and current row)),
k as (select model, sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)) as auc, sum(pos / P * tp / (tp + fp)) as ap from u group by model)
select model, metric, score_val from (
  select f.model, (tp + tn) / (tp + tn + fp + fn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
    coalesce(tp / nullif(tp + fn, 0), 0) as recall, f1, (f1 + f0) / 2 as f1_macro,
    (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy, auc as roc_auc, ap as auc_pr, -ll as log_loss
  from f join k on f.model = k.model)
unpivot (score_val for metric in (accuracy, precision, recall, f1, f1_macro, balanced_accuracy, roc_auc, auc_pr, log_loss))""")
def leaderboard_metrics(spark, sf):
    """H1: every leaderboard metric of two rule models for purchases."""
    e = table(spark, sf, "events")
    y = (F.col("event_type") == "purchase").cast("double")
    rules = F.array(F.struct(F.lit("ValueScore").alias("model"), (F.col("value") / 500.0).alias("p_pos")),
                    F.struct(F.lit("UserScore").alias("model"), (F.col("user_id") / 150.0).alias("p_pos")))
    preds = e.select(y.alias("label"), F.inline(rules)).select(
        "model", "label", "p_pos", (F.col("p_pos") >= 0.5).cast("double").alias("prediction"),
        F.when(F.col("label") == 1, F.col("p_pos")).otherwise(1 - F.col("p_pos")).alias("p_true"))
    parts = [MD.evaluate_models(preds, m, "binary_classification") for m in _BOARD_METRICS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# a rule model of three classes: the dearer an order, the likelier O and then P
_PF, _PO = "greatest(0.05, 0.9 - o_totalprice / 400000)", "least(0.6, o_totalprice / 600000 + 0.02)"


@register("leaderboard_multiclass", sql=f"""
with s as (select o_orderstatus as y, {_PF} as f, {_PO} as o from orders),
q as (select y, unnest([{{'c': 'F', 'p': f}}, {{'c': 'O', 'p': o}}, {{'c': 'P', 'p': greatest(0.0, 1 - f - o)}}], recursive := true) from s),
d as (select y, case when f >= o and f >= greatest(0.0, 1 - f - o) then 'F' when o >= greatest(0.0, 1 - f - o) then 'O' else 'P' end as said from s),
k as (select c, sum((y = c)::int)::double as real, sum((said = c)::int)::double as named, sum((y = c and said = c)::int)::double as tp
  from d, (values ('F'), ('O'), ('P')) v(c) group by c),
r as (select c, coalesce(tp / nullif(named, 0), 0) as pr, coalesce(tp / nullif(real, 0), 0) as re, coalesce(2 * tp / nullif(named + real, 0), 0) as f1, real from k),
g as (select c, p, sum((y = c)::int) as pos, sum((y <> c)::int) as neg from q group by 1, 2),
u as (select *, sum(neg) over (partition by c order by p desc) as fp, sum(pos) over (partition by c) as n_pos, sum(neg) over (partition by c) as n_neg from g),
a as (select c, sum(pos * ((n_neg - fp) + 0.5 * neg)) / (max(n_pos) * max(n_neg)) as auc, max(n_pos) as n_pos from u group by c)
select 'PriceRule' as model, metric, score_val from (select
  (select sum(pr * real) / sum(real) from r) as precision, (select sum(re * real) / sum(real) from r) as recall,
  (select sum(f1 * real) / sum(real) from r) as f1, (select avg(f1) from r) as f1_macro, (select sum(auc * n_pos) / sum(n_pos) from a) as roc_auc)
unpivot (score_val for metric in (precision, recall, f1, f1_macro, roc_auc))""")
def leaderboard_multiclass(spark, sf):
    """H1: the leaderboard metrics of a target with three classes."""
    o = table(spark, sf, "orders")
    f, s = F.expr(_PF), F.expr(_PO)
    probs = F.array(f, s, F.greatest(F.lit(0.0), 1 - f - s))
    preds = o.select(F.lit("PriceRule").alias("model"), probs.alias("probs"),
                     (F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")) - 1).cast("double").alias("label"))
    preds = preds.withColumn("prediction", (F.array_position("probs", F.array_max("probs")) - 1).cast("double"))
    parts = [MD.evaluate_models(preds, m, "multiclass_classification") for m in ("precision", "recall", "f1", "f1_macro", "roc_auc")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# candidates in a fixed order: thresholds of a purchase rule, two trials a round; a round
# in which four scored trials in a row brought nothing is the last one
_CUTS = (300, 200, 250, 420, 180, 90, 470, 30, 350, 400, 150, 60)


@register("trial_search", sql=f"""
with c(trial, cut) as (values {', '.join(f'({i}, {t})' for i, t in enumerate(_CUTS))}),
s as (select trial, cut, avg(((value >= cut) = (event_type = 'purchase'))::int::double) as score from c, events group by 1, 2),
p as (select *, max(score) over (order by trial rows between unbounded preceding and 1 preceding) as prev from s),
i as (select *, prev is null or score > prev as improved from p),
l as (select *, max(case when improved then trial end) over (order by trial) as last, max(score) over (order by trial) as best_so_far from i),
e as (select coalesce(min(trial // 2), 99) as stop from l where trial % 2 = 1 and trial - last >= 4)
select cast(trial as int) as trial, cast(trial // 2 as int) as iteration, '{{"cut": ' || cut || '}}' as candidate, 'completed' as status, score,
  improved, best_so_far, cast(trial - last as int) as since_improvement from l, e where trial // 2 <= stop""")
def trial_search(spark, sf):
    """L3: the search loop over Spark evaluations."""
    e = table(spark, sf, "events")

    def accuracy(candidate):
        hit = (F.col("value") >= candidate["cut"]) == (F.col("event_type") == "purchase")
        return e.agg(F.avg(hit.cast("double"))).first()[0]
    return SEL.search(spark, lambda history: [{"cut": t} for t in _CUTS[len(history):len(history) + 2]], accuracy,
                      trials_per_iteration=2, max_iterations=6, parallelism=2).drop("error")


@register("ensemble_fallback", sql=_rule_models_sql() + """,
t as (select arg_max(model, score_val) as top_model, max(score_val) as top_score from lb),
b as (select arg_max(model, score_val) as best_single_model, max(score_val) as single_score from lb
  where not starts_with(model, 'WeightedEnsemble'))
select top_model, best_single_model, starts_with(top_model, 'WeightedEnsemble') as ensemble_used,
  round((top_score - single_score) / greatest(abs(single_score), 1e-10), 6) as improvement_ratio,
  starts_with(top_model, 'WeightedEnsemble') and (top_score - single_score) / greatest(abs(single_score), 1e-10) <= 0.02 as fallback_applied,
  case when starts_with(top_model, 'WeightedEnsemble') and (top_score - single_score) / greatest(abs(single_score), 1e-10) <= 0.02
    then best_single_model else top_model end as chosen_model from t, b""")
def ensemble_fallback(spark, sf):
    return MD.ensemble_decision(_rule_models(spark, sf))


@register("cv_scores")
def cv_scores(spark, sf):
    """stratified 3-fold CV of the full pipeline (preprocessor refitted in
    every fold) with the 100-tree random-forest baseline, weighted F1."""
    from tabflow.operators.cv import cross_validate
    return cross_validate(_docs(spark, sf), "toxic", "binary_classification", ["doc_id"], metric="f1", n_folds=3)


@register("batch_score")
def batch_score(spark, sf):
    d, tr, va, pre = _fitted(spark, sf)
    pm = MD.build_pipeline(LogisticRegression(maxIter=30), pre.feature_columns, "toxic", "binary_classification") \
        .fit(pre.transform(tr))
    return SC.batch_predict(d.drop("toxic"), pre, pm, keep=["doc_id"])


_ES = "(select event_id, (event_type = 'purchase')::int as label, value / 500.0 as score from events)"
_TH = ", ".join(f"({i}, {t!r})" for i, t in enumerate(M.THRESHOLDS))


@register("batch_score_threshold", sql=f"""
with e as {_ES}, t(i, t) as (values {_TH}), P as (select sum(label) as P from e),
f as (select i, t, case when sum((score >= t)::int) + max(P.P) > 0 then 2 * sum(case when score >= t then label else 0 end)
  / (sum((score >= t)::int) + max(P.P)) else 0 end as f1 from t cross join e cross join P group by i, t),
b as (select coalesce((select t from f where f1 = (select max(f1) from f) and f1 > 0 order by i limit 1), 0.5) as th)
select event_id, score as prob_1, case when score >= th then 1 else 0 end as prediction from e, b""")
def batch_score_threshold(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"),
                                          (F.col("value") / 500.0).alias("prob_1"))
    th = M.best_threshold(e, F.col("label") == 1, F.col("prob_1")).first()["optimal_threshold"]
    return SC.threshold_predict(e, "prob_1", th, 1, 0).select("event_id", "prob_1", "prediction")


def _score_fn(pre, pm):
    def fn(frame, group_cols):
        p = pm.transform(pre.transform(frame))
        acc = F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score")
        return p.groupBy(*group_cols).agg(acc) if group_cols else p.agg(acc)
    return fn


@register("permutation_importance")
def permutation_importance(spark, sf):
    d, tr, va, pre = _fitted(spark, sf)
    pm = MD.build_pipeline(RandomForestClassifier(numTrees=20, maxDepth=6, seed=42), pre.feature_columns, "toxic",
                           "binary_classification").fit(pre.transform(tr))
    repeats, sample = EX.permutation_plan(va.count(), 2)
    return EX.permutation_importance(va, ["quality", "n_chars", "lang", "source"], _score_fn(pre, pm), ["doc_id"],
                                     repeats=repeats, sample=sample)


# the rule "purchase if value / 500 + user_id / 150 >= 1" under permuted columns: a row
# takes the value of the row a seeded distance further on in the order of digests
_SHIFTS = {(f, r): int(hashlib.md5(f"{f}-{r}-42".encode()).hexdigest()[:12], 16) for f in ("value", "user_id") for r in range(3)}
_RULE = "avg((({v} / 500.0 + {u} / 150.0 >= 1) = (a.event_type = 'purchase'))::int::double)"


@register("permutation_rule", sql=f"""
with e as (select event_type, value, user_id, row_number() over (order by md5(event_id::varchar || '-42'), event_id) - 1 as r from events),
n as (select count(*) as n from e), s(feature, shift) as (values {', '.join(f"('{f}', {x})" for (f, _), x in _SHIFTS.items())}),
p as (select feature, shift, case when feature = 'value' then {_RULE.format(v="b.value", u="a.user_id")}
    else {_RULE.format(v="a.value", u="b.user_id")} end as score
  from s, n, e a join e b on b.r = (a.r + 1 + shift % greatest(n.n - 1, 1)) % n.n group by 1, 2),
t as (select {_RULE.format(v="a.value", u="a.user_id")} as base from e a)
select feature, avg(base - score) as importance_mean, stddev_pop(base - score) as importance_std from p, t group by 1""")
def permutation_rule(spark, sf):
    """K1 with a rule in the model's place."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")

    def accuracy(frame, by):
        hit = (F.col("value") / 500.0 + F.col("user_id") / 150.0 >= 1) == (F.col("event_type") == "purchase")
        a = F.avg(hit.cast("double")).alias("score")
        return frame.groupBy(*by).agg(a) if by else frame.agg(a)
    return EX.permutation_importance(e, ["value", "user_id"], accuracy, ["event_id"], repeats=3)


def _numeric_model(spark, sf):
    d, tr, va, pre = _fitted(spark, sf)
    feats = pre.feature_columns
    pm = MD.build_pipeline(LogisticRegression(maxIter=30), feats, "toxic", "binary_classification").fit(pre.transform(tr))
    return d, tr, va, pre, pm, feats


def _prob_fn(pm, idx=1):
    def fn(frame):
        return pm.transform(frame.withColumn("toxic", F.lit("0"))).withColumn("score", vector_to_array("probability")[idx])
    return fn


@register("shap_global")
def shap_global(spark, sf):
    d, tr, va, pre, pm, feats = _numeric_model(spark, sf)
    x = pre.transform(va)
    bg = EX.numbered(pre.transform(tr), ["doc_id"], 7, 50).select(*feats)
    phi = EX.shapley_values(x.select("doc_id", *feats), bg, feats, _prob_fn(pm), "doc_id", permutations=8)
    return EX.global_importance(phi)


@register("shap_single")
def shap_single(spark, sf):
    """K5: one row's base value, prediction and contributions."""
    d, tr, va, pre, pm, feats = _numeric_model(spark, sf)
    x = EX.numbered(pre.transform(va), ["doc_id"], 42, 1)
    bg = EX.numbered(pre.transform(tr), ["doc_id"], 7, 50).select(*feats)
    phi = EX.shapley_values(x.select("doc_id", *feats), bg, feats, _prob_fn(pm), "doc_id", permutations=16, with_base=True)
    return EX.single_explanation(phi)


# an additive rule against one background row (the means) has its parts as Shapley values
@register("shap_rule", sql="""
with m as (select avg(value) as v, avg(user_id) as u from events)
select event_id, feature, case when feature = 'value' then (value - v) / 500 else -(user_id - u) / 150 end as phi,
  v / 500 - u / 150 as base_value, value / 500 - user_id / 150 as prediction,
  case when feature = 'value' then value else user_id::double end as feature_value
from events, m, (values ('value'), ('user_id')) f(feature)""")
def shap_rule(spark, sf):
    """K3/K5 with a rule in the model's place, for every event."""
    e = table(spark, sf, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    bg = e.agg(F.avg("value").alias("value"), F.avg("user_id").alias("user_id"))
    score = lambda f: f.withColumn("score", F.col("value") / 500 - F.col("user_id") / 150)
    return EX.shapley_values(e, bg, ["value", "user_id"], score, "event_id", permutations=2, with_base=True)


@register("shap_tree")
def shap_tree(spark, sf):
    """K3/K4/K6: exact Shapley values of a forest, for the class that it gives each
    held-out row; mean amount by feature."""
    d, tr, va, pre = _fitted(spark, sf)
    pm = MD.build_pipeline(RandomForestClassifier(numTrees=20, maxDepth=6, seed=42), pre.feature_columns, "toxic",
                           "binary_classification").fit(pre.transform(tr))
    return EX.global_importance(TS.tree_shapley(pre.transform(va), pm, pre.feature_columns, ["doc_id"]))


@register("shap_tree_additive", sql=f"""
select l.doc_id, true as adds_up from labels l join documents d on d.doc_id = l.doc_id where not ({train_sql("l.doc_id")})""")
def shap_tree_additive(spark, sf):
    """Base value and contributions add up to the forest's probability in every held-out row."""
    d, tr, va, pre = _fitted(spark, sf)
    pm = MD.build_pipeline(RandomForestClassifier(numTrees=20, maxDepth=6, seed=42), pre.feature_columns, "toxic",
                           "binary_classification").fit(pre.transform(tr))
    x = pre.transform(va)
    total = TS.tree_shapley(x, pm, pre.feature_columns, ["doc_id"], output=1).groupBy("doc_id").agg(
        (F.sum("phi") + F.first("base_value")).alias("total"))
    said = pm.transform(x).select("doc_id", vector_to_array("probability")[1].alias("p"))
    return said.join(total, "doc_id", "left").select("doc_id", F.coalesce(F.abs(F.col("p") - F.col("total")) < 1e-9, F.lit(False)).alias("adds_up"))


@register("shap_multiclass")
def shap_multiclass(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice",
                                          F.month("o_orderdate").cast("double").alias("month"),
                                          F.year("o_orderdate").cast("double").alias("year"))
    feats = ["o_totalprice", "month", "year"]
    tr = o.where(is_train("o_orderkey"))
    pm = MD.build_pipeline(LogisticRegression(maxIter=30), feats, "o_orderstatus", "multiclass_classification").fit(tr)
    # explain the probability of the class predicted for each held-out row (K6)
    x = pm.transform(o.where(~is_train("o_orderkey"))).select("o_orderkey", *feats, F.col("prediction").cast("int").alias("_cls"))
    bg = EX.numbered(tr, ["o_orderkey"], 7, 50).select(*feats)

    def fn(frame):
        return pm.transform(frame.withColumn("o_orderstatus", F.lit("F"))).withColumn("score", vector_to_array("probability")[F.col("_cls")])
    phi = EX.shapley_values(x, bg, feats, fn, "o_orderkey", permutations=8, carry=("_cls",))
    return EX.global_importance(phi)


@register("label_encode_decode", sql="""
with f as (select c_mktsegment as v, row_number() over (order by count(*) desc, c_mktsegment asc) - 1 as code
  from customer group by 1)
select c_custkey, c_mktsegment, cast(code as double) as c_mktsegment_code, c_mktsegment as c_mktsegment_decoded
from customer join f on f.v = c_mktsegment""")
def label_encode_decode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    idx, enc = EX.label_encode(c, ["c_mktsegment"])
    return EX.label_decode(enc, idx, ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "c_mktsegment_code",
                                                               "c_mktsegment_decoded")


@register("score_records", sql=f"""
select l.doc_id, true as same from labels l join documents d on d.doc_id = l.doc_id where not ({train_sql("l.doc_id")})""")
def score_records(spark, sf):
    """Every held-out row as a JSON record, scored as records and as a batch with the
    same outcome."""
    d, tr, va, pre = _fitted(spark, sf)
    pm = MD.build_pipeline(LogisticRegression(maxIter=30), pre.feature_columns, "toxic", "binary_classification") \
        .fit(pre.transform(tr))
    rows = va.drop("toxic")
    records = rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))
    a = SC.predict_json(records, "record", rows.schema, pre, pm, keep=["doc_id"])
    b = SC.batch_predict(rows, pre, pm, keep=["doc_id"])
    cols = [c for c in a.columns if c != "doc_id"]
    a, b = (x.select("doc_id", F.struct(*cols).alias(n)) for x, n in ((a, "a"), (b, "b")))
    return a.join(b, "doc_id").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))
