"""Queries for feature engineering (E1-E18): statistics learned on the
seeded-hash training rows, applied to every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.functions.columns import TWO_PI
from tabflow.operators import features as FE
from tabflow.operators import text as TX
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig
from tabflow.plans.derived import (EVENTS_NULLS_SQL, ORDERS_NULLS_SQL, PART_LABELS_SQL, events_nulls, is_train,
                                   orders_nulls, part_labels, train_sql)
from tabflow.plans.registry import register, table
from tabflow.plans.sqlgen import union_all

_LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("iqr_bounds", sql=union_all([
    f"select '{c}' as \"column\", q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper "
    f"from (select quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 from lineitem)" for c in _LI4]))
def iqr_bounds(spark, sf):
    li = table(spark, sf, "lineitem")
    b = FE.fit_iqr_bounds(li, _LI4)
    # the bounds are learned parameters; attach them to the per-column count of the table they bound
    from tabflow.operators.stats import unpivot_row
    row = li.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(_LI4)])
    return unpivot_row(row, [(c, {"lower": F.lit(b[c][0]), "upper": F.lit(b[c][1])}) for c in _LI4])


_ET = train_sql("event_id")


@register("clip_iqr", sql=f"""
with b as (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events where {_ET})
select event_id, least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) as value from events, b""")
def clip_iqr(spark, sf):
    e = table(spark, sf, "events")
    b = FE.fit_iqr_bounds(e.where(is_train("event_id")), ["value"])
    return FE.clip_to_bounds(e.select("event_id", "value"), b)


@register("choose_scaler", sql=f"""
with q as (select {', '.join(f"quantile_cont({c}, 0.25) a{i}, quantile_cont({c}, 0.75) b{i}" for i, c in enumerate(_LI4))} from lineitem),
o as (select {' + '.join(f"sum(({c} < a{i} - 1.5*(b{i}-a{i}) or {c} > b{i} + 1.5*(b{i}-a{i}))::int)" for i, c in enumerate(_LI4))} as o,
  {' + '.join(f"count({c})" for c in _LI4)} as t from lineitem, q)
select case when o / greatest(t, 1) > 0.05 then 'robust' else 'standard' end as scaler, o / greatest(t, 1) as outlier_share from o""")
def choose_scaler(spark, sf):
    li = table(spark, sf, "lineitem")
    return FE.choose_scaler(li, _LI4, FE.fit_iqr_bounds(li, _LI4))


_EN = EVENTS_NULLS_SQL


def _scaled(spark, sf, kind):
    e = events_nulls(spark, sf).select("event_id", "user_id", "value")
    params = FE.fit_scaler(e.where(is_train("event_id")), ["user_id", "value"], kind)
    return FE.apply_scaler(e, params)


def _scale_sql(center: str, scale: str) -> str:
    # fill with train median, then (x - center) / scale learned on the filled train rows
    return f"""
with e as {_EN}, m as (select quantile_cont(user_id, 0.5) mu, quantile_cont(value, 0.5) mv from e where {_ET}),
f as (select event_id, coalesce(user_id, mu)::double as user_id, coalesce(value, mv) as value, {_ET} as tr from e, m),
p as (select {center.format(c='user_id')} as cu, {scale.format(c='user_id')} as su,
             {center.format(c='value')} as cv, {scale.format(c='value')} as sv from f where tr)
select event_id, (user_id - cu) / case when su = 0 or su is null then 1 else su end as user_id,
  (value - cv) / case when sv = 0 or sv is null then 1 else sv end as value from f, p"""


@register("scale_standard", sql=_scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@register("scale_robust", sql=_scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@register("scale_minmax", sql=_scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


_PT = train_sql("p_partkey")


@register("rare_merge", sql=f"""
with p as {PART_LABELS_SQL}, r as (select p_label as v from p where {_PT} group by 1 having count(*) < 10)
select p_partkey, case when p_label in (select v from r) then '__other__' else p_label end as p_label from p""")
def rare_merge(spark, sf):
    p = part_labels(spark, sf).select("p_partkey", "p_label")
    rare = FE.fit_rare_values(p.where(is_train("p_partkey")), ["p_label"], threshold=10)
    return FE.apply_rare_merge(p, rare, ["p_label"])


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", sql="select c_custkey, " + ", ".join(
    f"case when c_mktsegment = '{v}' and exists (select 1 from customer t where t.c_mktsegment = '{v}' and "
    f"{train_sql('t.c_custkey')}) then 1 else 0 end as c_mktsegment_{v}" for v in _SEGMENTS) + " from customer")
def one_hot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    maps = FE.fit_one_hot(c.where(is_train("c_custkey")), ["c_mktsegment"])
    return FE.apply_one_hot(c, maps)


@register("target_encode", sql=f"""
with g as (select avg(value) g from events where {_ET}),
s as (select cast(user_id as varchar) || '-' || event_type as v, avg(value) m, count(value) n from events where {_ET} group by 1)
select event_id, coalesce((m * n + g * 10.0) / (n + 10.0), g) as user_cat_te
from events e cross join g left join s on cast(e.user_id as varchar) || '-' || e.event_type = s.v""")
def target_encode(spark, sf):
    # category: user × event type (many values: target-encoded, not one-hot)
    e = table(spark, sf, "events").select(
        "event_id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("user_cat"), "value")
    tab, g, enc = FE.fit_target_encoding(e.where(is_train("event_id")), ["user_cat"], "value")
    return FE.apply_target_encoding(e, tab, enc, g).select("event_id", "user_cat_te")


_HIST = "o_orderdate < timestamp '1996-01-01'"


@register("target_encode_unseen", sql=f"""
with h as (select * from orders where {_HIST}), g as (select avg(o_totalprice) g from h),
s as (select cast(o_custkey as varchar) as v, avg(o_totalprice) m, count(o_totalprice) n from h group by 1)
select o_orderkey, coalesce((m * n + g * 10.0) / (n + 10.0), g) as cust_te, s.v is null as unseen
from orders o cross join g left join s on cast(o.o_custkey as varchar) = s.v""")
def target_encode_unseen(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"),
                                          "o_totalprice", "o_orderdate")
    hist = o.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    tab, g, enc = FE.fit_target_encoding(hist, ["cust"], "o_totalprice")
    seen = tab.select(F.col("value").alias("cust"), F.lit(False).alias("unseen"))
    out = FE.apply_target_encoding(o, tab, enc, g, drop_source=False)
    out = FE.lookup_join(out, seen, ["cust"], "left")
    return out.select("o_orderkey", "cust_te", F.coalesce(F.col("unseen"), F.lit(True)).alias("unseen"))


_OT = train_sql("o_orderkey")


@register("missing_indicator", sql=f"""
with t as {ORDERS_NULLS_SQL}
select o_orderkey, (o_orderstatus is null)::int as o_orderstatus_missing, (o_totalprice is null)::int as o_totalprice_missing,
  (o_orderpriority is null)::int as o_orderpriority_missing from t""")
def missing_indicator(spark, sf):
    o = orders_nulls(spark, sf)
    cols = FE.fit_missing_indicators(o.where(is_train("o_orderkey")), [c for c in o.columns if c != "o_orderkey"])
    return FE.add_missing_indicators(o.select("o_orderkey", *cols), cols).drop(*cols)


@register("date_parts", sql="""
select o_orderkey, cast(year(o_orderdate) as integer) as o_orderdate_year, cast(month(o_orderdate) as integer) as o_orderdate_month,
  cast(day(o_orderdate) as integer) as o_orderdate_day, cast(isodow(o_orderdate) - 1 as integer) as o_orderdate_dayofweek,
  cast(hour(o_orderdate) as integer) as o_orderdate_hour
from orders""")
def date_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return FE.add_date_parts(o, ["o_orderdate"], cyclical=False).drop("o_orderdate")


@register("cyclical_dates", sql=f"""
select o_orderkey, sin({TWO_PI!r} * month(o_orderdate) / 12) as o_orderdate_month_sin,
  cos({TWO_PI!r} * month(o_orderdate) / 12) as o_orderdate_month_cos,
  sin({TWO_PI!r} * (isodow(o_orderdate) - 1) / 7) as o_orderdate_dayofweek_sin,
  cos({TWO_PI!r} * (isodow(o_orderdate) - 1) / 7) as o_orderdate_dayofweek_cos from orders""")
def cyclical_dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = FE.add_date_parts(o, ["o_orderdate"], cyclical=True)
    return d.select("o_orderkey", *[c for c in d.columns if c.endswith(("_sin", "_cos"))])


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross"]
_LI_GROSS = "(select *, l_extendedprice * (1 + l_tax) as gross from lineitem)"


def _lineitem_gross(spark, sf):
    return table(spark, sf, "lineitem").withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))


@register("correlation_matrix", sql=f"with t as {_LI_GROSS}\n" + union_all([
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as corr from t"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]))
def correlation_matrix(spark, sf):
    return FE.correlation_matrix(_lineitem_gross(spark, sf), _CORR)


_HOLES = {"l_quantity": 3, "l_extendedprice": 5, "l_discount": 2, "l_tax": 7, "gross": 4}
_WITH_HOLES = "(select " + ", ".join(f"case when (l_orderkey + l_linenumber) % {k} <> 0 then {c} end as {c}"
                                     for c, k in _HOLES.items()) + f" from {_LI_GROSS})"


@register("correlation_with_nulls", sql=f"with t as {_WITH_HOLES}\n" + union_all([
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as corr from t"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]))
def correlation_with_nulls(spark, sf):
    """Every column misses other rows: each pair counts the rows where both are known."""
    t = _lineitem_gross(spark, sf)
    holes = t.select(*[F.when((F.col("l_orderkey") + F.col("l_linenumber")) % k != 0, F.col(c)).alias(c) for c, k in _HOLES.items()])
    return FE.correlation_matrix(holes, _CORR, fill_median=False)


# Oracle: on this input no correlated chain exists, so the left-to-right rule
# drops the earlier column of every pair above the threshold.
@register("correlation_drop", sql=f"with t as {_LI_GROSS}, c as (" + union_all([
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as r from t"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]) + ") select col_a as dropped, col_b as because_of from c where abs(r) > 0.95")
def correlation_drop(spark, sf):
    m = FE.correlation_matrix(_lineitem_gross(spark, sf), _CORR)
    rows = [(r["col_a"], r["col_b"], r["corr"]) for r in m.collect()]  # p(p-1)/2 numbers
    drops = FE.correlation_drop(rows, _CORR)
    # report the decision together with the pair's correlation from the matrix frame
    pairs = spark.createDataFrame(drops or [], "dropped string, because_of string")
    return pairs.join(m, (pairs.dropped == m.col_a) & (pairs.because_of == m.col_b), "inner").select("dropped", "because_of")


_VAR = ["l_quantity", "l_discount", "l_tax", "zero_floor"]


@register("variance_drop", sql=f"""
with t as (select *, least(l_quantity, 0) as zero_floor from lineitem)
{union_all([f"select '{c}' as \"column\", var_pop({c}) as var_pop, coalesce(var_pop({c}), 0) <= 0 as dropped from t" for c in _VAR])}""")
def variance_drop(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("zero_floor", F.least(F.col("l_quantity"), F.lit(0.0)))
    return FE.variance_table(li, _VAR)


@register("pca_explained")
def pca_explained(spark, sf):
    emb = table(spark, sf, "embeddings")
    from pyspark.ml.functions import array_to_vector
    vec = emb.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    _, k, ratios, _ = FE.fit_pca(vec, vector_col="v")
    # explained-variance table: one row per component, cumulative share and the kept flag
    comp = spark.range(len(ratios)).select(F.col("id").cast("int").alias("component"))
    r = F.array(*[F.lit(float(x)) for x in ratios])
    return comp.select("component", r[F.col("component")].alias("explained_ratio"),
                       F.aggregate(F.slice(r, 1, F.col("component") + 1), F.lit(0.0), lambda a, x: a + x).alias("cumulative"),
                       (F.col("component") < k).alias("kept"))


# closed form for two columns: the eigenvalues of [[a, b], [b, c]]
@register("pca_two_columns", sql="""
with m as (select var_samp(l_quantity) as a, var_samp(l_discount * 100) as c, covar_samp(l_quantity, l_discount * 100) as b from lineitem),
     e as (select *, sqrt((a - c) * (a - c) / 4 + b * b) as d from m)
select 0 as component, ((a + c) / 2 + d) / (a + c) as explained_ratio,
       abs(b) / sqrt(b * b + ((a + c) / 2 + d - a) * ((a + c) / 2 + d - a)) as first_loading from e
union all
select 1, ((a + c) / 2 - d) / (a + c), abs(b) / sqrt(b * b + ((a + c) / 2 - d - a) * ((a + c) / 2 - d - a)) from e""")
def pca_two_columns(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("discount"))
    components, _, ratios, _ = FE.fit_pca(li, ["l_quantity", "discount"])
    rows = [(i, float(r), float(abs(components[0, i]))) for i, r in enumerate(ratios)]
    return spark.createDataFrame(rows, "component int, explained_ratio double, first_loading double")


_TERMS_SQL = r"""d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') as w from documents),
t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) group by 1, 2),
k as (select term, count(*) as df from t group by 1),
x as (select doc_id, term, tf, tf * ln(((select count(*) from d) + 1.0) / (df + 1)) as tfidf from t join k using (term))"""


@register("text_tfidf", sql=f"with {_TERMS_SQL} select doc_id, count(*) as n_terms, sqrt(sum(tfidf * tfidf)) as tfidf_norm from x group by 1")
def text_tfidf(spark, sf):
    """Exact weights over the whole vocabulary."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return TX.term_weights(d, "text", "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("tfidf_norm"))


@register("text_embeddings")
def text_embeddings(spark, sf):
    """E18 as a stage of the fitted pipeline: `text_emb_i` of every document."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars").join(lab, "doc_id", "left")
    pre = Preprocessor(PreprocessorConfig(target="quality", keep_columns=["doc_id"], text_features=True, text_dims=4, text_max_terms=2000,
                                          drop_null_target=False, dedupe=False)).fit(d)
    out = pre.transform(d)
    return out.select("doc_id", *[c for c in out.columns if c.startswith("text_emb_")])
