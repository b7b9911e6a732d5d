"""Exact Shapley values of tree models (K3-K6).

The value of a coalition is the tree's expectation when only the coalition's features
are known: an unknown split takes both ways, weighted by the training rows behind
them. A leaf is reached by a path of at most depth features; seen as a game, it pays
its value times, for every feature of the path, 1 or 0 (known, and the row goes this
way or not) or the path's share of training rows (unknown). Its Shapley values are
closed sums over coalition sizes, taken from the coefficients of a product of linear
factors, once for every pattern of satisfied features that occurs. Summed over leaves
and trees they add up: base value + contributions = the model's output.

The model's nodes are read from its saved form, so any MLlib decision tree, forest or
boosted model will do; rows are explained by the workers, batch by batch, without a
shuffle, and only the model's nodes are broadcast.

Outputs: class probabilities of trees and forests, the prediction of regressors, and
the margin (half the log-odds) of a boosted classifier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.session import scratch_path, ship_package


@dataclass
class Leaf:
    features: np.ndarray        # the path's features, each once
    low: np.ndarray             # value > low and value <= high
    high: np.ndarray
    groups: list                # allowed categories of a categorical feature, else None
    share: np.ndarray           # share of training rows that go this way at the feature's splits
    value: np.ndarray           # what the leaf pays, by output


def _nodes(model) -> list[list[dict]]:
    """Nodes by tree and id, out of the saved model."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "tree-model")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    trees: dict[int, dict[int, dict]] = {}
    for r in data.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    return [[nodes[i] for i in sorted(nodes)] for _, nodes in sorted(trees.items())]


def tree_leaves(model) -> list[Leaf]:
    """The leaves of all trees, weighted as the model weighs its trees."""
    kind = type(model).__name__
    if not hasattr(model, "toDebugString") or "Model" not in kind:
        raise ValueError(f"{kind} is no tree model")
    trees = _nodes(model)
    weights = list(getattr(model, "treeWeights", [1.0]))
    if "RandomForest" in kind:
        weights = [1.0 / len(trees)] * len(trees)
    classes = kind in ("DecisionTreeClassificationModel", "RandomForestClassificationModel")
    out: list[Leaf] = []
    for nodes, weight in zip(trees, weights, strict=True):
        at = {n["id"]: n for n in nodes}
        cover = {i: float(sum(n["impurityStats"]) if classes else n["impurityStats"][0]) for i, n in at.items()}
        stack: list[tuple[int, dict]] = [(min(at), {})]
        while stack:
            i, path = stack.pop()
            n = at[i]
            if n["leftChild"] < 0:
                stats = np.array(n["impurityStats"])
                value = stats / stats.sum() if classes else np.array([n["prediction"]])
                own = sorted(path)
                out.append(Leaf(np.array(own, np.int64), np.array([path[f][0] for f in own]), np.array([path[f][1] for f in own]),
                                [path[f][2] for f in own], np.array([path[f][3] for f in own]), weight * value))
                continue
            split = n["split"]
            f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"]
            low, high, group, share = path.get(f, (-math.inf, math.inf, None, 1.0))
            for left, child in ((True, n["leftChild"]), (False, n["rightChild"])):
                part = share * (cover[child] / cover[i])
                if split["numCategories"] < 0:
                    mine = (low, min(high, cut[0]), group, part) if left else (max(low, cut[0]), high, group, part)
                else:
                    every = set(range(split["numCategories"])) if group is None else group
                    mine = (low, high, every & set(map(int, cut)) if left else every - set(map(int, cut)), part)
                stack.append((child, {**path, f: mine}))
    return out


def _weights(known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """``(patterns, features)``: by how much a leaf's value counts for each feature."""
    d = len(share)
    size = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    out = np.empty((len(known), d))
    for i in range(d):
        poly = np.zeros((len(known), d))
        poly[:, 0] = 1.0
        for n, j in enumerate(x for x in range(d) if x != i):
            grown = poly[:, :n + 2] * share[j]
            grown[:, 1:] += poly[:, :n + 1] * known[:, j:j + 1]
            poly[:, :n + 2] = grown
        out[:, i] = (poly @ size) * (known[:, i] - share[i])
    return out


def contributions(x: np.ndarray, leaves: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Base values by output, and ``(rows, features, outputs)`` Shapley values."""
    width = len(leaves[0].value)
    base, phi = np.zeros(width), np.zeros((*x.shape, width))
    for leaf in leaves:
        base += leaf.value * leaf.share.prod()
        d = len(leaf.features)
        if not d:
            continue
        v = x[:, leaf.features]
        known = (v > leaf.low) & (v <= leaf.high)
        for k, group in enumerate(leaf.groups):
            if group is not None:
                known[:, k] = np.isin(v[:, k], list(group))
        code = known @ (1 << np.arange(d, dtype=np.int64))
        pattern, place = np.unique(code, return_inverse=True)
        w = _weights(((pattern[:, None] >> np.arange(d)) & 1).astype(np.float64), leaf.share)
        phi[:, leaf.features, :] += w[place][:, :, None] * leaf.value
    return base, phi


def tree_shapley(df: DataFrame, model, feature_cols: list[str], key_cols: list[str], output: int | str = "predicted") -> DataFrame:
    """``key…, output, base_value, prediction, feature, feature_value, phi``: one row per
    row of ``df`` and feature. ``output`` is a class index, or ``predicted`` for the
    class that the model gives the row (K6); regressors and margins have output 0.
    ``model`` is the fitted model or a pipeline that ends in it. An unknown feature
    value goes right at every split, as the model sends it."""
    spark = ship_package(df.sparkSession)
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    leaves = spark.sparkContext.broadcast(tree_leaves(model))
    keys = df.select(*key_cols)
    src = df.select(*key_cols, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feature_cols)])
    schema = ", ".join(f"`{c}` {t}" for c, t in keys.dtypes) + ", output int, base_value double, prediction double, " \
        "feature string, feature_value double, phi double"
    k, p = len(key_cols), len(feature_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = np.stack([batch.column(k + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(p)], axis=1)
                base, phi = contributions(np.where(np.isnan(x), np.inf, x), leaves.value)
                total = base + phi.sum(axis=1)
                out = total.argmax(axis=1) if output == "predicted" else np.full(len(x), int(output))
                row = np.arange(len(x))
                again = pa.array(np.repeat(row, p))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(again) for i in range(k)], pa.array(np.repeat(out, p).astype(np.int32)),
                     pa.array(np.repeat(base[out], p)), pa.array(np.repeat(total[row, out], p)),
                     pa.array(feature_cols * len(x), pa.string()), pa.array(x.ravel(), mask=np.isnan(x.ravel())),
                     pa.array(phi[row, :, out].ravel())],
                    names=[*key_cols, "output", "base_value", "prediction", "feature", "feature_value", "phi"])

    return src.mapInArrow(run, schema)
