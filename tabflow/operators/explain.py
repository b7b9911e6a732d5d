"""Model explanation (K1-K7): permutation importance and Monte-Carlo Shapley
values, both as ONE ``model.transform`` over an exploded frame of variants.

Variant rows are built with joins/explodes on the executors: for permutation
importance every (feature, repeat) gets the evaluation rows with that
feature's values permuted (a shifted row rank joined to the value table); for Shapley values every (row, permutation, position) gets a
coalition mixing the explained row with a background row.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions.columns import SEED, seeded_hex
from tabflow.functions.ranking import hash_rank
from tabflow.session import cut_lineage

LARGE_ROWS = 100_000
MANY_CLASSES = 50
BACKGROUND_BROADCAST = 10_000   # rows of a background table that may be broadcast


def permutation_plan(n_rows: int, n_classes: int = 0, repeats: int | None = None, sample: int | None = None,
                     quick: bool = False):
    """K2: (repeats, sample rows): 5 × all rows; ``repeats=0`` skips. ``quick``
    asks for the reference's reduced plan, 2 × 500 for >50 classes or >100k rows."""
    reduced = quick and (n_classes > MANY_CLASSES or n_rows > LARGE_ROWS)
    if repeats is None:
        repeats = 2 if reduced else 5
    if sample is None:
        sample = 500 if reduced else n_rows
    return repeats, min(sample, n_rows)


def numbered(df: DataFrame, key_cols: list[str], seed: int = SEED, n: int | None = None) -> DataFrame:
    """``df`` with ``_row`` 1.. in the order of the rows' seeded digests (bucketed ranks:
    no task sorts all rows); the first ``n`` only where a sample is named."""
    d = hash_rank(df.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed)), "_tf_h", tiebreak=key_cols, rank_col="_row").drop("_tf_h")
    return d if n is None else d.where(F.col("_row") <= n)


def permutation_importance(df: DataFrame, features: list[str], score_fn, key_cols: list[str],
                           repeats: int = 5, sample: int | None = None, seed: int = SEED, top: int | None = None) -> DataFrame:
    """K1: ``(feature, importance_mean, importance_std)`` = baseline score −
    score with the feature's values permuted, over ``repeats`` permutations.
    ``score_fn(frame, group_cols)`` returns ``group_cols + [score]`` with a
    higher-is-better score (it applies the model and aggregates)."""
    s = cut_lineage(numbered(df, key_cols, seed, sample))
    n = s.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "feature string, importance_mean double, importance_std double")
    # rows stand in a random order; a repeat gives every row the value of the row that
    # stands a seeded distance further on
    shift = lambda f, r: 1 + int(md5(f"{f}-{r}-{seed}".encode()).hexdigest()[:12], 16) % max(n - 1, 1)
    variants = F.array(*[F.struct(F.lit(f).alias("_feature"), F.lit(r).alias("_repeat"), F.lit(shift(f, r)).cast("long").alias("_shift"))
                         for f in features for r in range(repeats)])
    v = s.select("*", F.inline(variants))  # every sample row × (feature, repeat): n·F·R rows
    v = v.withColumn("_perm", F.pmod(F.col("_row") - 1 + F.col("_shift"), F.lit(n)) + 1).drop("_shift")
    vals = s.select(F.col("_row").alias("_perm"), F.inline(F.array(*[F.struct(F.lit(f).alias("_feature"),
                                                                               F.col(f).cast("string").alias("_pv"))
                                                                      for f in features])))
    v = v.join(vals, ["_perm", "_feature"])
    types = {f.name: f.dataType for f in s.schema.fields}
    v = v.select(*[F.when(F.col("_feature") == f, F.col("_pv").cast(types[f])).otherwise(F.col(f)).alias(f)
                   if f in features else F.col(f) for f in s.columns if f != "_row"], "_feature", "_repeat")
    base = score_fn(s.drop("_row"), []).withColumnRenamed("score", "_base")
    perm = score_fn(v, ["_feature", "_repeat"])
    b = base.first()["_base"]
    imp = perm.select("_feature", "_repeat", (F.lit(b) - F.col("score")).alias("drop"))
    out = (imp.groupBy(F.col("_feature").alias("feature"))
              .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
              .orderBy(F.col("importance_mean").desc(), "feature"))
    return out if top is None else out.limit(top)


def shapley_values(explain: DataFrame, background: DataFrame, features: list[str], predict_fn, row_col: str,
                   permutations: int = 10, seed: int = SEED, carry: tuple[str, ...] = (), with_base: bool = False) -> DataFrame:
    """K3/K5: Monte-Carlo Shapley values ``(row, feature, phi)`` of any model (exact ones
    of trees: :mod:`tree_shap`); ``with_base`` adds ``base_value`` (mean score of the
    background rows used), ``prediction`` and ``feature_value``.

    For each explained row and permutation m (a seeded feature order and a
    background row z_m), coalition k takes the first k features of the order
    from the row and the rest from z_m; ``phi`` of the feature at position k is
    f(coalition k) − f(coalition k−1), averaged over m. Σ_f phi = f(x) −
    mean_m f(z_m) exactly. ``predict_fn(frame)`` adds a ``score`` column; columns of
    the explained row that it needs besides the features are named in ``carry``."""
    bg = background.select(*[F.col(f).cast("double").alias(f"_bg_{f}") for f in features])
    bg = cut_lineage(numbered(bg, bg.columns).withColumn("_bi", F.col("_row") - 1).drop("_row"))
    nb = bg.count()
    x = explain.select(row_col, *carry, *[F.col(f).cast("double").alias(f) for f in features],
                       F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_m"))
    x = x.withColumn("_bi", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col(row_col).cast("string"),
                                                                          F.col("_m").cast("string"), F.lit("bg"))), 1, 8),
                                          16, 10).cast("bigint"), F.lit(nb)))
    x = x.join(F.broadcast(bg) if nb <= BACKGROUND_BROADCAST else bg, "_bi")
    # position of every feature in permutation m: rank of md5(row, m, feature)
    pos = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws("-", F.col(row_col).cast("string"), F.col("_m").cast("string"),
                                                            F.lit(f), F.lit(str(seed)))).alias("h"), F.lit(f).alias("f"))
                                 for f in features]))
    x = x.withColumn("_order", F.transform(pos, lambda s: s["f"]))
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    coal = [F.when(F.array_position(F.slice(F.col("_order"), 1, F.col("_k")), F.lit(f)) > 0, F.col(f))
            .otherwise(F.col(f"_bg_{f}")).alias(f) for f in features]
    c = x.select(row_col, *carry, "_m", "_k", "_order", *coal)
    scored = predict_fn(c)
    w = Window.partitionBy(row_col, "_m").orderBy("_k")
    d = scored.select(row_col, "_m", "_k", "_order", (F.col("score") - F.lag("score").over(w)).alias("_d")) \
        .where(F.col("_k") > 0)
    phi = (d.select(row_col, F.col("_order")[F.col("_k") - 1].alias("feature"), "_d")
            .groupBy(row_col, "feature").agg(F.avg("_d").alias("phi")))
    if not with_base:
        return phi
    ends = scored.groupBy(row_col).agg(F.avg(F.when(F.col("_k") == 0, F.col("score"))).alias("base_value"),
                                       F.avg(F.when(F.col("_k") == len(features), F.col("score"))).alias("prediction"))
    values = explain.select(row_col, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("feature_value"))
                                                        for f in features])))
    return phi.join(values, [row_col, "feature"]).join(ends, row_col)


def single_explanation(values: DataFrame, top: int | None = None) -> DataFrame:
    """K5: base value, prediction and the contributions of explained rows, largest by
    amount first, as :func:`tree_shapley` or :func:`shapley_values` give them."""
    out = values.orderBy(F.abs("phi").desc(), "feature")
    return out if top is None else out.limit(top)


def global_importance(phi: DataFrame, top: int | None = None) -> DataFrame:
    """K4: mean |phi| per feature, largest first; only the first ``top`` where it is given."""
    out = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap")) \
             .orderBy(F.col("mean_abs_shap").desc(), "feature")
    return out if top is None else out.limit(top)


def label_encode(df: DataFrame, cols: list[str]):
    """K7: strings → indices (frequency order, ties alphabetical); returns the
    fitted indexer model and the encoded frame (``{col}_code``)."""
    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}_code" for c in cols], stringOrderType="frequencyDesc",
                        handleInvalid="keep").fit(df)
    return idx, idx.transform(df)


def label_decode(df: DataFrame, indexer, cols: list[str]) -> DataFrame:
    """K7: codes (possibly perturbed doubles) → labels by rounding and clamping
    to the valid index range."""
    out = df
    for i, c in enumerate(cols):
        labels = indexer.labelsArray[i]
        code = F.least(F.greatest(F.round(F.col(f"{c}_code")), F.lit(0.0)), F.lit(float(len(labels) - 1)))
        out = out.withColumn(f"{c}_code_clamped", code)
        out = IndexToString(inputCol=f"{c}_code_clamped", outputCol=f"{c}_decoded", labels=labels).transform(out)
        out = out.drop(f"{c}_code_clamped")
    return out
