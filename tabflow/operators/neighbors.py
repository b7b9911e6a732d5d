"""Nearest-neighbour resamplers SMOTE / SMOTENC / ADASYN / SMOTE-ENN
on the exact search of :mod:`metric_knn`.

Identical vectors are collapsed first (``cnt`` = multiplicity), so a hot repeated point
costs one row, not a quadratic block. A point's id is a digest of its group and vector
and is joined back by the columns themselves, so neither the layout nor a hash decides
who is whose neighbour.

Defined results: a row with a null target is no member of a class: it passes through
and is nobody's neighbour. A row with an unknown feature (null or NaN) counts for its
class's size but neither has nor is a neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import SEED, seeded_hex, uniform01
from tabflow.functions.ranking import hash_rank
from tabflow.operators.metric_knn import BROADCAST_ROWS, knn
from tabflow.session import cut_lineage

__all__ = ["safe_k", "collapse", "knn", "smote", "adasyn", "edited_nearest_neighbours", "smote_enn"]


def safe_k(min_class: int, default: int = 5) -> int:
    """k below the minority size: min(default, max(1, min_class − 1))."""
    return min(default, max(1, int(min_class) - 1))


def collapse(df: DataFrame, vec_col: str, group_cols: list[str]) -> DataFrame:
    """Distinct ``(group…, vec)`` with multiplicity ``cnt`` and id ``uid``."""
    return (df.groupBy(*group_cols, vec_col).agg(F.count(F.lit(1)).alias("cnt"))
              .withColumn("uid", F.md5(F.to_json(F.struct(*group_cols, vec_col)))))


def _with_uid(rows: DataFrame, pts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the id of their point, by the point's own columns."""
    ids = pts.select("uid", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(on)])
    same = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(on)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return rows.join(ids, cond).drop(*[f"_p{i}" for i in range(len(on))])


def _neighbour_arrays(nn: DataFrame, pts: DataFrame, vec_col: str, extra: list[str] = ()) -> DataFrame:
    """``(uid, nbrs)``: each query's ≤ k neighbour records (repeated by
    ``take``) in a fixed order (distance, then id), so seeded picks are stable."""
    p = pts.select(F.col("uid").alias("nuid"), F.col(vec_col).alias("v"), *[F.col(e) for e in extra])
    j = nn.join(p, "nuid")
    item = F.struct(F.col("dist").alias("_d"), F.col("nuid").alias("_id"), F.col("take").alias("_t"),
                    F.struct("v", *extra).alias("_r"))
    srt = F.array_sort(F.collect_list(item))
    return j.groupBy(F.col("quid").alias("uid")).agg(
        F.flatten(F.transform(srt, lambda e: F.array_repeat(e["_r"], e["_t"].cast("int")))).alias("nbrs"))


def _class_sizes(df: DataFrame, target: str) -> tuple[DataFrame, int, int, int]:
    """``(target, _n)`` of the classes, broadcast where they are few, and the largest
    class, the least one and the number of classes."""
    sizes = cut_lineage(df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_n")))
    r = sizes.agg(F.max("_n"), F.min("_n"), F.count(F.lit(1))).first()
    return (F.broadcast(sizes) if r[2] <= BROADCAST_ROWS else sizes), r[0] or 0, r[1] or 0, r[2]


def _prepare(df: DataFrame, target: str, feature_cols: list[str], cat_cols) -> tuple[DataFrame, list[str]]:
    """Rows of a class whose features are all known, with ``_x`` (and ``_cats``)."""
    base = df.where(F.col(target).isNotNull()).withColumn("_x", F.array(*[F.col(c).cast("double") for c in feature_cols]))
    base = base.where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    grp = [target]
    if cat_cols:
        base = base.withColumn("_cats", F.array(*[F.col(c).cast("string") for c in cat_cols]))
        grp = [target, "_cats"]
    return base, grp


def _synthesize(rows: DataFrame, target: str, key_cols: list[str], feature_cols: list[str], quota: Column,
                seed: int, cat_cols=()) -> DataFrame:
    """Each row yields ``quota`` synthetic rows ``x + u·(nbr − x)`` with a
    seeded neighbour choice and a seeded u ∈ [0, 1); categorical features take
    the most frequent value among the neighbours (smallest on ties)."""
    s = rows.where(F.size("nbrs") > 0).withColumn("_j", F.explode(F.sequence(F.lit(1), F.greatest(quota, F.lit(0))))) \
            .where(quota > 0)
    h = seeded_hex(*key_cols, F.col("_j"), seed=seed)
    pick = F.pmod(F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint"), F.size("nbrs"))
    u = uniform01(h)
    x = F.zip_with(F.col("_x"), F.col("nbrs")[pick]["v"], lambda a, b: a + u * (b - a))
    out = [F.col(target)] + [x[i].alias(c) for i, c in enumerate(feature_cols)]
    for i, c in enumerate(cat_cols):
        vals = F.transform(F.col("nbrs"), lambda e: e["_cats"][i])
        counted = F.transform(F.array_distinct(vals),
                              lambda v: F.struct((-F.size(F.filter(vals, lambda z: z == v))).alias("n"), v.alias("v")))
        out.append(F.array_min(counted)["v"].alias(c))
    sid = F.concat_ws("-", *[F.col(c).cast("string") for c in key_cols], F.lit("syn"), F.col("_j").cast("string"))
    return s.select(*out, sid.alias("synthetic_id"))


def _quota_even(rows: DataFrame, target: str, key_cols: list[str], m: int, n_classes: int, seed: int) -> DataFrame:
    """Spread G_c = m − n_c synthetic rows evenly over the class's ``_able`` rows that
    have neighbours (⌊G/n⌋ each, one more for the first G mod n in seeded order)."""
    g = F.lit(m) - F.col("_n")
    r = hash_rank(rows.withColumn("_tf_h", seeded_hex(*key_cols, seed=seed)), "_tf_h", [target], tiebreak=key_cols,
                  rank_col="_rk", max_group_rows=m, n_groups=n_classes)
    return r.withColumn("_quota", (F.floor(g / F.col("_able")) + F.when(F.col("_rk") <= F.pmod(g, F.col("_able")), 1).otherwise(0)).cast("int"))


def _median_minority_std(df: DataFrame, feature_cols: list[str]) -> float:
    sds = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in feature_cols]).first()
    vals = sorted(v for v in (sds[c] for c in feature_cols) if v is not None)
    return vals[len(vals) // 2] if vals else 1.0


def smote(df: DataFrame, target: str, feature_cols: list[str], key_cols: list[str], k: int | None = None,
          seed: int = SEED, cat_cols=()) -> DataFrame:
    """every non-majority class grows to the majority count with
    synthetic rows interpolated toward one of its k nearest same-class
    neighbours. With ``cat_cols`` (SMOTENC) each categorical mismatch adds the
    squared median std of the minority's continuous features to the distance
    and synthetic categories are the neighbours' mode. Returns original rows
    plus synthetic ones (``synthetic_id`` set)."""
    sizes, m, least, n_classes = _class_sizes(df, target)
    k = k or safe_k(least)
    base, grp = _prepare(df, target, feature_cols, cat_cols)
    mino = base.join(sizes.where(F.col("_n") < m), target)
    pts = cut_lineage(collapse(mino, "_x", grp))
    pen = _median_minority_std(mino, feature_cols) if cat_cols else 0.0
    nn = knn(pts, pts, "_x", k, same_group=[target], cat_col="_cats" if cat_cols else None, cat_penalty=pen)
    nbr = _neighbour_arrays(nn, pts, "_x", ["_cats"] if cat_cols else [])
    rows = cut_lineage(_with_uid(mino, pts, [*grp, "_x"]).join(nbr, "uid").drop("uid"))
    able = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_able"))
    rows = _quota_even(rows.join(F.broadcast(able) if n_classes <= BROADCAST_ROWS else able, target), target, key_cols, m, n_classes, seed)
    syn = _synthesize(rows, target, key_cols, feature_cols, F.col("_quota"), seed, cat_cols)
    orig = df.select(target, *feature_cols, *cat_cols, F.lit(None).cast("string").alias("synthetic_id"))
    return orig.unionByName(syn)


def adasyn(df: DataFrame, target: str, feature_cols: list[str], key_cols: list[str], k: int | None = None,
           seed: int = SEED) -> DataFrame:
    """as SMOTE, but each minority row's share of the G = m − n_c new rows
    is proportional to the fraction of other-class rows among its k nearest
    neighbours in the whole table: g_i = round(r_i / Σr · G)."""
    sizes, m, least, n_classes = _class_sizes(df, target)
    k = k or safe_k(least)
    base, grp = _prepare(df, target, feature_cols, ())
    allpts = cut_lineage(collapse(base, "_x", grp))
    mpts = allpts.join(sizes.where(F.col("_n") < m), target)
    # hardness: other-class share among the k nearest rows of the whole table
    nn_all = knn(allpts, mpts, "_x", k)
    lab = allpts.select(F.col("uid").alias("nuid"), F.col(target).alias("_nl"))
    own = mpts.select(F.col("uid").alias("quid"), F.col(target).alias("_ql"))
    r = (nn_all.join(lab, "nuid").join(own, "quid")
               .groupBy(F.col("quid").alias("uid")).agg((F.sum(F.when(F.col("_nl") != F.col("_ql"), F.col("take")).otherwise(0))
                                                         / F.sum("take")).alias("_r")))
    nn = knn(mpts, mpts, "_x", k, same_group=[target])
    nbr = _neighbour_arrays(nn, mpts, "_x")
    rows = cut_lineage(_with_uid(base.join(sizes.where(F.col("_n") < m), target), mpts, [*grp, "_x"])
                       .join(nbr, "uid").join(r, "uid").drop("uid"))
    tot = rows.groupBy(target).agg(F.sum("_r").alias("_rs"))
    rows = rows.join(F.broadcast(tot) if n_classes <= BROADCAST_ROWS else tot, target)
    quota = F.when(F.col("_rs") > 0, F.round(F.col("_r") / F.col("_rs") * (F.lit(m) - F.col("_n")))).otherwise(0).cast("int")
    syn = _synthesize(rows, target, key_cols, feature_cols, quota, seed)
    orig = df.select(target, *feature_cols, F.lit(None).cast("string").alias("synthetic_id"))
    return orig.unionByName(syn)


def edited_nearest_neighbours(df: DataFrame, target: str, feature_cols: list[str], k: int = 3,
                              keep_classes=()) -> DataFrame:
    """ENN: remove rows (of classes not in ``keep_classes``) unless all of their
    k nearest neighbours in the table share their class."""
    base, grp = _prepare(df, target, feature_cols, ())
    pts = cut_lineage(collapse(base, "_x", grp))
    nn = knn(pts, pts, "_x", k)
    lab = pts.select(F.col("uid").alias("nuid"), F.col(target).alias("_nl"))
    own = pts.select("uid", F.col(target).alias("_ql"), "_x")
    disagree = (nn.join(lab, "nuid").join(own.withColumnRenamed("uid", "quid"), "quid").groupBy(F.col("quid").alias("uid"))
                  .agg(F.min((F.col("_nl") == F.col("_ql")).cast("int")).alias("_all")).where(F.col("_all") == 0))
    gone = disagree.join(own, "uid").where(~F.col("_ql").isin(list(keep_classes)) if keep_classes else F.lit(True))
    rows = df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in feature_cols]))
    gone = gone.select(F.col("_ql"), F.col("_x").alias("_gx"))
    return rows.join(gone, (rows[target] == gone["_ql"]) & (rows["_x"] == gone["_gx"]), "left_anti").drop("_x")


def smote_enn(df: DataFrame, target: str, feature_cols: list[str], key_cols: list[str], k: int | None = None,
              seed: int = SEED, enn_k: int = 3) -> DataFrame:
    """F16: SMOTE, then ENN (k=3, all neighbours must agree) on every class
    except the original minority."""
    sizes, _, _, _ = _class_sizes(df, target)
    first = sizes.orderBy("_n", F.col(target).cast("string")).limit(1).collect()
    s = smote(df, target, feature_cols, key_cols, k, seed)
    return edited_nearest_neighbours(s, target, feature_cols, enn_k, keep_classes=[r[target] for r in first])
