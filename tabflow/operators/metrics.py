"""Evaluation metrics from one ``(label, prediction, score…)`` table.

Classification metrics derive from the confusion counts (one aggregate over
the rows, then arithmetic over a k×k table). Ranking metrics (AUC, AP,
curves) group rows by score first and run running sums over the distinct
scores (range-bucketed when large) instead of sorting the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions.ranking import prefix_sums

# 99 candidate decision thresholds 0.01 … 0.99 (numpy ``linspace`` values).
THRESHOLDS = [float(x) for x in np.linspace(0.01, 0.99, 99)]
LOG_LOSS_EPS = 1e-15


# ---------------------------------------------------------------- confusion-based
def label_pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(actual, predicted, count)`` of the pairs that occur: one aggregate."""
    d = df.select(F.col(label).cast("string").alias("actual"), F.col(prediction).cast("string").alias("predicted"))
    return d.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Long ``(actual, predicted, count)`` over the complete grid of
    labels seen in either column (zero cells included). The label list is
    one small array (bounded by the number of classes), exploded twice."""
    counts = label_pairs(df, label, prediction)
    labs = counts.select(F.explode(F.array("actual", "predicted")).alias("l")).where(F.col("l").isNotNull()) \
                 .agg(F.array_sort(F.collect_set("l")).alias("labels"))
    grid = labs.select(F.explode("labels").alias("actual"), "labels").select("actual", F.explode("labels").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def per_label(cm: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(label, tp, fp, fn, support, precision, recall, f1)``; zero division → 0.

    ``cm`` may be the grid or only the occurring pairs: each pair counts once for
    its actual and once for its predicted label. Rows with a null on either side
    count for nothing, their other label is still listed. ``by``: columns of
    ``cm`` (e.g. the model) for which this is done separately."""
    n = F.when(F.col("actual").isNotNull() & F.col("predicted").isNotNull(), F.col("count")).otherwise(F.lit(0))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    roles = cm.select(*by, F.inline(F.array(
        F.struct(F.col("actual").alias("label"), n.alias("s"), zero.alias("p"), hit.alias("t")),
        F.struct(F.col("predicted").alias("label"), zero.alias("s"), n.alias("p"), zero.alias("t")))))
    j = roles.where(F.col("label").isNotNull()).groupBy(*by, "label").agg(
        F.sum("t").alias("tp"), F.sum("p").alias("pred_n"), F.sum("s").alias("support"))
    p = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return j.select(*by, "label", F.col("tp").cast("bigint").alias("tp"), (F.col("pred_n") - F.col("tp")).cast("bigint").alias("fp"),
                    (F.col("support") - F.col("tp")).cast("bigint").alias("fn"), F.col("support").cast("bigint").alias("support"),
                    p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def averages(cm: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per ``by`` group) of macro / weighted / micro precision, recall and F1."""
    pl = per_label(cm, by)
    s = pl.groupBy(*by).agg(F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
               F.avg("f1").alias("f1_macro"),
               (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
               (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"),
               (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
               F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    mp = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    mr = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return s.select(*by, "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted",
                    mp.alias("precision_micro"), mr.alias("recall_micro"),
                    F.when(mp + mr > 0, 2 * mp * mr / (mp + mr)).otherwise(0.0).alias("f1_micro"))


def agreement(cm: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per ``by`` group) ``accuracy, mcc, cohens_kappa,
    balanced_accuracy`` (multiclass closed forms on the confusion marginals)."""
    pl = per_label(cm, by).select(*by, "label", "tp", "support", (F.col("tp") + F.col("fp")).alias("pred_n"))
    s = pl.groupBy(*by).agg(F.sum("tp").cast("double").alias("c"), F.sum("support").cast("double").alias("n"),
               F.sum(F.col("support").cast("double") * F.col("pred_n")).alias("tp_dot"),
               F.sum(F.col("pred_n").cast("double") ** 2).alias("pp"), F.sum(F.col("support").cast("double") ** 2).alias("tt"),
               F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("bal"))
    c, n, dot, pp, tt = (F.col(x) for x in ("c", "n", "tp_dot", "pp", "tt"))
    cov_tp = c * n - dot
    den = F.sqrt((n * n - tt) * (n * n - pp))
    pe = dot / (n * n)
    po = c / n
    return s.select(*by, (c / n).alias("accuracy"), F.when(den > 0, cov_tp / den).otherwise(0.0).alias("mcc"),
                    F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(0.0).alias("cohens_kappa"),
                    F.col("bal").alias("balanced_accuracy"))


# ---------------------------------------------------------------- ranking metrics
def score_table(df: DataFrame, is_pos: Column, score: Column, partition: Column | None = None) -> DataFrame:
    """Rows grouped by (class?, score): ``pos, neg`` counts per distinct score."""
    cols = [score.cast("double").alias("score"), is_pos.cast("int").alias("_p")]
    if partition is not None:
        cols.insert(0, partition.alias("cls"))
    d = df.select(*cols).where(F.col("score").isNotNull())
    keys = (["cls"] if partition is not None else []) + ["score"]
    return d.groupBy(*keys).agg(F.sum("_p").cast("bigint").alias("pos"), F.sum(1 - F.col("_p")).cast("bigint").alias("neg"))


def _curve(st: DataFrame, by_class: bool) -> DataFrame:
    """Cumulative counts in descending score order: ``tp, fp`` at each distinct
    threshold (predict positive when score ≥ threshold), totals ``P, N``."""
    n_rows = st.count()
    if by_class:
        c = prefix_sums(st, "score", ["pos", "neg"], descending=True, n_rows=n_rows, partition_cols=["cls"])
        tot = st.groupBy("cls").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        j = c.join(F.broadcast(tot), "cls")   # one row per class
    else:
        c = prefix_sums(st, "score", ["pos", "neg"], descending=True, n_rows=n_rows)
        t = st.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
        j = c.select("*", F.lit(t["P"]).alias("P"), F.lit(t["N"]).alias("N"))
    return j.withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp")


def roc_auc(df: DataFrame, is_pos: Column, score: Column) -> DataFrame:
    """I4: one row ``auc`` = P(score⁺ > score⁻) + ½ P(tie) (rank-sum form)."""
    c = _curve(score_table(df, is_pos, score), False)
    # negatives strictly below a score = N − fp (fp counts negatives with score ≥ s);
    # P · N, the number of pairs, is a double: an int ends at 46,340 rows of each kind;
    # without a pair (no scored row of one of the kinds) there is no auc: null
    return c.agg(F.try_divide(F.sum(F.col("pos") * ((F.col("N") - F.col("fp")) + 0.5 * F.col("neg"))),
                              F.first("P").cast("double") * F.first("N")).alias("auc"))


def average_precision(df: DataFrame, is_pos: Column, score: Column) -> DataFrame:
    """Step-sum AP = Σ (R_k − R_{k−1}) · P_k over distinct thresholds."""
    c = _curve(score_table(df, is_pos, score), False)
    return c.agg(F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P")).otherwise(0.0)
                       * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


def roc_curve(df: DataFrame, is_pos: Column, score: Column) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score (no intermediate
    points dropped)."""
    c = _curve(score_table(df, is_pos, score), False)
    return c.select(F.col("score").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"),
                    (F.col("tp") / F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, is_pos: Column, score: Column) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score."""
    c = _curve(score_table(df, is_pos, score), False)
    return c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("P")).alias("recall"))


def _long_scores(df: DataFrame, label: str, score_cols: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("cls"), F.col(v).cast("double").alias("score")) for k, v in score_cols.items()])
    return df.select(F.col(label).cast("string").alias("_y"), F.inline(pairs)).withColumn("_pos", F.col("_y") == F.col("cls"))


def ovr_auc(df: DataFrame, label: str, score_cols: dict[str, str]) -> DataFrame:
    """I8: per class one-vs-rest AUC and AP: ``(cls, auc, average_precision)``."""
    lg = _long_scores(df, label, score_cols)
    return ranking_by(lg, F.col("cls"), F.col("_pos"), F.col("score"))


def ranking_by(df: DataFrame, key: Column, is_pos: Column, score: Column) -> DataFrame:
    """I4/I5 for every value of ``key`` (class, model): ``(cls, auc, average_precision)``."""
    c = _curve(score_table(df, is_pos, score, partition=key), True)
    return c.groupBy("cls").agg(
        F.try_divide(F.sum(F.col("pos") * ((F.col("N") - F.col("fp")) + 0.5 * F.col("neg"))),
                     F.first("P").cast("double") * F.first("N")).alias("auc"),
        F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P")).otherwise(0.0)
              * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


def ovr_macro(df: DataFrame, label: str, score_cols: dict[str, str]) -> DataFrame:
    """I8: one row ``auc_macro, ap_macro``."""
    return ovr_auc(df, label, score_cols).agg(F.avg("auc").alias("auc_macro"), F.avg("average_precision").alias("ap_macro"))


def macro_roc_grid(df: DataFrame, label: str, score_cols: dict[str, str], points: int = 100) -> DataFrame:
    """Macro-average ROC on a ``points``-point FPR grid: each class's curve
    (with its (0,0) start) is linearly interpolated at the grid, then averaged.
    At an FPR shared by several curve points the highest TPR is used."""
    lg = _long_scores(df, label, score_cols)
    c = _curve(score_table(lg, F.col("_pos"), F.col("score"), partition=F.col("cls")), True)
    pts = c.select("cls", (F.col("fp") / F.col("N")).alias("x"), (F.col("tp") / F.col("P")).alias("y"))
    pts = pts.unionByName(pts.select("cls").distinct().select("cls", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    # a rising curve: it comes to an x at its lowest y and leaves it at its highest
    px = pts.groupBy("cls", "x").agg(F.min("y").alias("y_in"), F.max("y").alias("y_out"))
    return _macro_grid(px, points).select("point", F.col("x").alias("fpr"), F.col("y").alias("tpr"))


def macro_pr_grid(df: DataFrame, label: str, score_cols: dict[str, str], points: int = 100) -> DataFrame:
    """Macro-average precision on a ``points``-point recall grid: each class's
    curve (with its start at recall 0, precision 1) is linearly interpolated, then
    averaged. At a recall shared by several thresholds the curve is left at the
    precision of the lowest one."""
    lg = _long_scores(df, label, score_cols)
    c = _curve(score_table(lg, F.col("_pos"), F.col("score"), partition=F.col("cls")), True)
    pts = c.select("cls", (F.col("tp") / F.col("P")).alias("x"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("y"))
    pts = pts.unionByName(pts.select("cls").distinct().select("cls", F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    # at one recall the precision only falls
    px = pts.groupBy("cls", "x").agg(F.max("y").alias("y_in"), F.min("y").alias("y_out"))
    return _macro_grid(px, points).select("point", F.col("x").alias("recall"), F.col("y").alias("precision"))


def _macro_grid(px: DataFrame, points: int) -> DataFrame:
    """``(point, x, y)``: the classes' curves, one ``(cls, x, y_in, y_out)`` row per
    x, interpolated on the grid 0 … 1 and averaged."""
    classes = px.select("cls").distinct()
    # only the extreme points of every grid cell matter for interpolation at the
    # grid: keep, per (class, cell), the point with the smallest and the largest x
    # (≤ 2·points rows per class, however many distinct scores a class has)
    cell = F.floor(F.col("x") * F.lit(points - 1)).cast("int")
    ext = px.withColumn("_cell", cell).groupBy("cls", "_cell").agg(
        F.min_by(F.struct("x", "y_in", "y_out"), "x").alias("lo"), F.max_by(F.struct("x", "y_in", "y_out"), "x").alias("hi"))
    px = ext.select("cls", F.inline(F.array("lo", "hi"))).dropDuplicates(["cls", "x"])
    grid = classes.select("cls", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")) \
                  .select("cls", "g", (F.col("g") / F.lit(points - 1)).alias("gx"))
    # as-of join on x within each class: the last curve x ≤ gx and the first x ≥ gx
    tagged = grid.select("cls", "g", F.col("gx").alias("x"), F.lit(None).cast("double").alias("y_in"),
                         F.lit(None).cast("double").alias("y_out"), F.lit(1).alias("_is_grid")) \
        .unionByName(px.select("cls", F.lit(None).cast("int").alias("g"), "x", "y_in", "y_out", F.lit(0).alias("_is_grid")))
    from pyspark.sql import Window
    wb = Window.partitionBy("cls").orderBy(F.col("x"), F.col("_is_grid")).rowsBetween(Window.unboundedPreceding, 0)
    wa = Window.partitionBy("cls").orderBy(F.col("x"), F.col("_is_grid").desc()).rowsBetween(0, Window.unboundedFollowing)
    t = tagged.select("*", F.last(F.when(F.col("_is_grid") == 0, F.col("x")), True).over(wb).alias("x0"),
                      F.last("y_out", True).over(wb).alias("y0"),
                      F.first(F.when(F.col("_is_grid") == 0, F.col("x")), True).over(wa).alias("x1"),
                      F.first("y_in", True).over(wa).alias("y1")).where(F.col("_is_grid") == 1)
    interp = (F.when(F.col("x1").isNull() | (F.col("x0") == F.col("x")), F.col("y0"))
              .when(F.col("x1") == F.col("x0"), F.col("y0"))
              .otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))))
    return t.select("g", "x", interp.alias("y")).groupBy("g").agg(F.first("x").alias("x"), F.avg("y").alias("y")) \
            .select(F.col("g").cast("int").alias("point"), "x", "y")


# ---------------------------------------------------------------- thresholds, probabilities
def best_threshold(df: DataFrame, is_pos: Column, score: Column) -> DataFrame:
    """The F1-optimal decision threshold among 0.01 … 0.99 (first best
    wins; 0.5 when no threshold gives F1 > 0).

    Each row gets the exact number k of thresholds ≤ its score (an arithmetic
    guess corrected by two comparisons against the literal thresholds), rows
    are counted per k (≤ 100 groups, partially aggregated), and the positives /
    predicted-positives of threshold i are the running sums over k ≥ i."""
    n_t = len(THRESHOLDS)
    th = F.array(*[F.lit(t) for t in THRESHOLDS])
    s, p = score.cast("double"), is_pos.cast("int")
    step = (THRESHOLDS[-1] - THRESHOLDS[0]) / (n_t - 1)
    g = F.least(F.greatest(F.floor((s - THRESHOLDS[0]) / step).cast("int") + 1, F.lit(0)), F.lit(n_t))
    # correct the guess: k = #{i : t_i ≤ s} exactly
    k = (g + F.when((g < n_t) & (s >= F.element_at(th, g + 1)), 1).otherwise(0)
         - F.when((g > 0) & (s < F.element_at(th, F.greatest(g, F.lit(1)))), 1).otherwise(0))
    hist = df.where(s.isNotNull()).select(k.alias("k"), p.alias("y")).groupBy("k").agg(
        F.sum("y").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    idx = df.sparkSession.range(1, n_t + 1).select(F.col("id").cast("int").alias("i"))
    # rows with k = i, then suffix sums over i (a 99-row table): tp / pp of threshold i
    per = idx.join(F.broadcast(hist), F.col("k") == F.col("i"), "left").select(
        "i", F.coalesce(F.col("pos"), F.lit(0)).alias("pos"), F.coalesce(F.col("cnt"), F.lit(0)).alias("cnt"))
    P = hist.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"))
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = P.first()["P"]
    cum = per.select("i", F.sum("pos").over(w).alias("tp"), F.sum("cnt").over(w).alias("pp"))
    f = cum.select("i", F.element_at(th, F.col("i")).alias("t"),
                   F.when(F.col("pp") + F.lit(tot) > 0, 2 * F.col("tp") / (F.col("pp") + F.lit(tot))).otherwise(0.0).alias("f1"))
    best = f.agg(F.max_by(F.struct("t", "f1"), F.struct(F.col("f1"), -F.col("i"))).alias("b"))
    return best.select(F.lit(0.5).alias("default_threshold"),
                       F.when(F.col("b.f1") > 0, F.col("b.t")).otherwise(F.lit(0.5)).alias("optimal_threshold"),
                       F.round(F.when(F.col("b.f1") > 0, F.col("b.f1")).otherwise(F.lit(0.0)), 6).alias("best_f1"))


def log_loss(df: DataFrame, label: str, prob_cols: dict[str, str]) -> DataFrame:
    """−mean ln(p_true) with p clipped to [1e−15, 1−1e−15]."""
    m = F.create_map(*[x for k, v in prob_cols.items() for x in (F.lit(k), F.col(v).cast("double"))])
    p = F.least(F.greatest(m[F.col(label).cast("string")], F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    return df.agg((-F.avg(F.log(p))).alias("log_loss"))


# ---------------------------------------------------------------- regression
def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """``mae, mse, rmse, r2, mape, smape, residual_mean, residual_std``
    (population std) in one aggregate."""
    yt, yp = F.col(y).cast("double"), F.col(pred).cast("double")
    e = yt - yp
    a = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(yt).alias("vy"),
               F.avg(F.abs(e) / F.greatest(F.abs(yt), F.lit(1e-10))).alias("mape0"),
               F.avg(2 * F.abs(e) / (F.abs(yt) + F.abs(yp) + F.lit(1e-10))).alias("smape0"),
               F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"))
    return a.select("mae", "mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("vy") > 0, 1 - F.col("mse") / F.col("vy")).otherwise(0.0).alias("r2"),
                    (F.col("mape0") * 100).alias("mape"), (F.col("smape0") * 100).alias("smape"),
                    "residual_mean", "residual_std")


def residual_histogram(df: DataFrame, y: str, pred: str, bins: int = 20) -> DataFrame:
    """I16: ``(bin, lower, upper, count)`` for ``bins`` equal-width bins of the
    residuals between their min and max (last bin closed), empty bins included."""
    r = (F.col(y) - F.col(pred)).cast("double")
    mm = df.agg(F.min(r).alias("lo"), F.max(r).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / bins if hi is not None and hi > lo else 1.0
    b = F.least(F.floor((r - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.select(b.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def residual_grid(df: DataFrame, y: str, pred: str, bins: int = 20) -> DataFrame:
    """I16: residual against prediction as counts of a ``bins`` x ``bins`` grid
    between the extremes of either: ``(pred_bin, residual_bin, count)`` of the
    cells that hold rows. Every row counts; rows with a null are in no cell."""
    d = df.select(F.col(pred).cast("double").alias("p"), (F.col(y) - F.col(pred)).cast("double").alias("r")).dropna()
    m = d.agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("r").alias("r0"), F.max("r").alias("r1")).first()

    def cell(c: str, lo, hi):
        if lo is None or hi <= lo:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return d.groupBy(cell("p", m["p0"], m["p1"]).alias("pred_bin"), cell("r", m["r0"], m["r1"]).alias("residual_bin")) \
            .agg(F.count(F.lit(1)).alias("count"))


def metrics_by_split(df: DataFrame, label: str, prediction: str, split_col: str = "split") -> DataFrame:
    """``(split, n, accuracy, error_rate)`` in one grouped aggregate."""
    ok = (F.col(label).cast("string") == F.col(prediction).cast("string")).cast("double")
    return df.groupBy(split_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(ok).alias("accuracy"),
                                     (1 - F.avg(ok)).alias("error_rate"))


def train_eval_rows(train: DataFrame, key_cols: list[str], sample: int | None = None) -> DataFrame:
    """The rows that training-set metrics are computed on: all of them, or a
    reproducible sample of ``sample`` rows where the caller asks for one."""
    if sample is None:
        return train
    from tabflow.operators.split import sample_rows
    return sample_rows(train, sample, key_cols)
