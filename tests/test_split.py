"""Splits, folds and imbalance invariants (reference leakage/sampling tests)."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabflow.operators import folds as FO
from tabflow.operators import imbalance as IM
from tabflow.operators import split as SP


def test_null_target_removed(spark):
    rows = [(i, "a" if i % 2 else "b") for i in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "feat int, target string")
    out = SP.stratified_split(df, "target", 0.2, ["feat"])
    assert out.count() == 10
    assert out.where(F.col("target").isNull()).count() == 0


def test_every_class_on_both_sides(spark):
    rows = [(i, c) for i, c in enumerate(["a"] * 20 + ["b"] * 20 + ["c"] + ["d"] + ["e"] * 5)]
    df = spark.createDataFrame(rows, "feat int, target string")
    out = SP.stratified_split(df, "target", 0.2, ["feat"])
    sides = {s: {r.target for r in out.where(F.col("split") == s).collect()} for s in ("train", "test")}
    assert sides["train"] == sides["test"] == {"a", "b", "c", "d", "e"}
    dropped = SP.stratified_split(df, "target", 0.2, ["feat"], rare_class_strategy="drop")
    assert {r.target for r in dropped.collect()} == {"a", "b", "e"}


def test_stratified_total_size(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(21)], "k int, t string")
    c = Counter(r.split for r in SP.stratified_split(df, "t", 0.2, ["k"]).collect())
    assert c == {"test": 4, "train": 17}


def test_many_classes_need_no_class_map(spark):
    df = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") % 20_000).cast("string").alias("t"))
    out = SP.stratified_split(df, "t", 0.4, ["k"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"test": 24_000, "train": 36_000}
    assert IM.random_undersample(df, "t", ["k"]).count() == 60_000


def test_three_way_falls_back_where_classes_do_not_fit(spark):
    df = spark.createDataFrame([(i, str(i % 30)) for i in range(60)], "k int, t string")
    c = Counter(r.split for r in SP.three_way_split(df, "t", 0.1, 0.2, ["k"]).collect())
    assert c == {"test": 12, "val": 6, "train": 42}


def test_binary_singleton(spark):
    df = spark.createDataFrame([(i, 1 if i == 0 else 0) for i in range(10)], "feat int, target int")
    out = SP.stratified_split(df, "target", 0.2, ["feat"])
    for s in ("train", "test"):
        assert {r.target for r in out.where(F.col("split") == s).collect()} == {0, 1}


def test_random_split_exact_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = SP.random_split(df, 0.2, ["k"])
    assert a.where("split = 'test'").count() == 200
    b = SP.random_split(df.repartition(7), 0.2, ["k"])
    assert sorted(r.k for r in a.where("split='test'").collect()) == sorted(r.k for r in b.where("split='test'").collect())


def test_three_way_sizes(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(300)], "k int, t string")
    out = SP.three_way_split(df, "t", 0.15, 0.15, ["k"])
    c = Counter(r.split for r in out.collect())
    assert c["val"] == pytest.approx(45, abs=2) and c["test"] == pytest.approx(45, abs=2)
    with pytest.raises(ValueError):
        SP.three_way_split(df, "t", 0.6, 0.5, ["k"])


def test_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "k").withColumn("y", (F.col("k") % 3).cast("string"))
    sizes = Counter(r.fold for r in FO.kfold(df, 5, ["k"]).collect())
    assert sorted(sizes.values()) == [20, 20, 21, 21, 21]
    sk = FO.stratified_kfold(df, "y", 5, ["k"]).collect()
    per = Counter((r.y, r.fold) for r in sk)
    assert max(per.values()) - min(per.values()) <= 1
    g = FO.group_kfold(df.withColumn("g", F.col("k") % 10), "g", 3, mode="greedy").collect()
    assert all(len({r.fold for r in g if r.g == gg}) == 1 for gg in range(10))
    ts = FO.time_series_blocks(df, 4, ["k"]).collect()
    assert Counter(r.block for r in ts)[0] == 103 // 5


def test_sampling_choice_and_weights(spark):
    bal = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 1.0, 1), (3.0, 3.0, 0), (4.0, 5.0, 1), (5.0, 4.0, 0)],
                                "a double, b double, target int")
    assert IM.sampling_choice(bal, "target", "binary_classification").first()["method"] == "none"
    imb = spark.createDataFrame([(float(i), float(i), 1 if i < 3 else 0) for i in range(10)], "a double, b double, target int")
    assert IM.sampling_choice(imb, "target", "binary_classification").first()["method"] == "class_weight"
    w = IM.class_weights(spark.createDataFrame([(0,), (0,), (0,), (1,), (1,)], "y int"), "y")
    tot = {r.y: r.s for r in w.groupBy("y").agg(F.sum("_sample_weight").alias("s")).collect()}
    assert tot[0] == pytest.approx(tot[1])
    over = IM.random_oversample(imb.withColumn("k", F.monotonically_increasing_id()), "target", ["a"])
    assert Counter(r.target for r in over.collect()) == {0: 7, 1: 7}
    under = IM.random_undersample(imb, "target", ["a"])
    assert Counter(r.target for r in under.collect()) == {0: 3, 1: 3}


def test_split_variants(spark):
    df = spark.range(2000).withColumnRenamed("id", "k").withColumn("t", (F.col("k") % 2).cast("string"))
    approx = SP.random_split(df, 0.25, ["k"], exact=False)
    n_test = approx.where("split = 'test'").count()
    assert 400 < n_test < 600
    flat = SP.three_way_split(df, "t", 0.1, 0.2, ["k"], stratify=False)
    c = Counter(r.split for r in flat.collect())
    assert set(c) == {"train", "val", "test"} and sum(c.values()) == 2000
    g = FO.group_kfold(df.withColumn("g", F.col("k") % 37), "g", 4)   # auto → greedy for few groups
    assert g.select("g", "fold").distinct().count() == 37
