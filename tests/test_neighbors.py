"""Grid kNN equals brute force; resampler invariants."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tabflow.operators import neighbors as NB


def test_knn_matches_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, "a" if i % 2 else "b", [rnd.gauss(0, 1) * (5 if i % 7 == 0 else 1), rnd.random(), rnd.random() * 3])
           for i in range(120)]
    pts += [(200, "a", pts[1][2]), (201, "a", pts[1][2])]   # duplicates of point 1
    df = spark.createDataFrame(pts, "id int, g string, x array<double>")
    c = NB.collapse(df, "x", ["g"])
    nn = NB.knn(c, c, "x", 4, same_group=["g"])
    got = {}
    uid_vec = {r.uid: tuple(r.x) for r in c.collect()}
    for r in nn.collect():
        got.setdefault(uid_vec[r.quid], []).extend([round(r.dist, 9)] * r.take)
    for i, g, x in pts:
        others = [p for p in pts if p[1] == g and p[0] != i]
        ds = sorted(math.dist(x, p[2]) for p in others)[:4]
        assert sorted(got[tuple(x)]) == [round(d, 9) for d in ds] or \
            len([p for p in pts if tuple(p[2]) == tuple(x)]) > 1   # duplicates share one query


def test_smote_balances_and_interpolates(spark):
    rows = [(i, 0 if i < 17 else 1, float(i % 5), float((i * 3) % 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, target int, a double, b double")
    out = NB.smote(df, "target", ["a", "b"], ["k"])
    assert Counter(r.target for r in out.collect()) == {0: 17, 1: 17}
    mino = [r for r in rows if r[1] == 1]
    lo_a, hi_a = min(r[2] for r in mino), max(r[2] for r in mino)
    syn = out.where(F.col("synthetic_id").isNotNull()).collect()
    assert all(lo_a - 1e-9 <= r.a <= hi_a + 1e-9 for r in syn)
    assert set(out.columns) == {"target", "a", "b", "synthetic_id"}


def test_smotenc_categories_come_from_neighbours(spark):
    rows = [(i, 0 if i < 17 else 1, float(i % 5), "x" if i % 2 else "y") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, target int, a double, c string")
    out = NB.smote(df, "target", ["a"], ["k"], cat_cols=["c"])
    assert Counter(r.target for r in out.collect()) == {0: 17, 1: 17}
    assert {r.c for r in out.where("synthetic_id is not null").collect()} <= {"x", "y"}


def test_resampling_is_deterministic(spark):
    rows = [(i, 0 if i < 30 else 1, float((i * 13) % 11), float((i * 7) % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, target int, a double, b double")
    a = NB.smote_enn(df, "target", ["a", "b"], ["k"]).collect()
    b = NB.smote_enn(df.repartition(5), "target", ["a", "b"], ["k"]).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_adasyn_focuses_on_hard_points(spark):
    # minority points: a cluster far from the majority (easy) and points inside it (hard)
    rows = [(i, 0, float(i % 20), 0.0) for i in range(60)]
    rows += [(100 + i, 1, 100.0 + i * 0.1, 0.0) for i in range(5)]          # easy
    rows += [(200 + i, 1, 5.0 + i * 0.37, 0.05) for i in range(5)]          # hard
    df = spark.createDataFrame(rows, "k int, target int, a double, b double")
    out = NB.adasyn(df, "target", ["a", "b"], ["k"])
    syn = out.where("synthetic_id is not null").collect()
    near = sum(1 for r in syn if r.a < 50)
    assert len(syn) >= 40 and near > len(syn) / 2


def _by_hand(pts, k):
    """Distances of the k nearest others, by point id."""
    return {i: sorted(math.dist(x, y) for j, y in pts if j != i)[:k] for i, x in pts}


def _same(a, b):
    return len(a) == len(b) and all(abs(x - y) <= 1e-12 * (1 + y) for x, y in zip(a, b))


def _search(spark, pts, k, **options):
    df = spark.createDataFrame(pts, "uid string, x array<double>").withColumn("cnt", F.lit(1)).repartition(3)
    got = {}
    for r in NB.knn(df, df, "x", k, **options).collect():
        got.setdefault(r.quid, []).extend([r.dist] * r.take)
    return {i: sorted(v) for i, v in got.items()}


def test_knn_in_two_and_twelve_dimensions(spark):
    rnd = random.Random(5)
    for d in (2, 12):
        centres = [[rnd.gauss(0, 30) for _ in range(d)] for _ in range(14)]
        pts = [(f"p{i}", [c + rnd.gauss(0, 1) for c in centres[i % 14]]) for i in range(1400)]
        pts += [("far", [500.0] * d), ("far2", [-400.0] * d)]
        stats = {}
        got, want = _search(spark, pts, 5, block=64, stats=stats), _by_hand(pts, 5)
        assert all(_same(got[i], want[i]) for i in want)
        assert stats["pairs"] < 0.35 * len(pts) ** 2


def test_knn_without_structure_and_with_offsets(spark):
    rnd = random.Random(6)
    pts = [(f"p{i}", [1e6 + rnd.random() for _ in range(8)]) for i in range(300)]
    got, want = _search(spark, pts, 3, block=32), _by_hand(pts, 3)
    assert all(_same(got[i], want[i]) for i in want)


def test_knn_has_fewer_points_than_k(spark):
    assert {i: len(v) for i, v in _search(spark, [("a", [0.0]), ("b", [1.0])], 5).items()} == {"a": 1, "b": 1}
    assert _search(spark, [("a", [0.0])], 5) == {}


def test_knn_copies_and_groups_in_blocks(spark):
    rnd = random.Random(8)
    rows = [(i % 3, [float(rnd.randint(0, 4)), float(rnd.randint(0, 4)), float(rnd.randint(0, 4))]) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, x array<double>")
    pts = NB.collapse(df, "x", ["g"])
    got, vec = {}, {r.uid: (r.g, tuple(r.x)) for r in pts.collect()}
    for r in NB.knn(pts, pts, "x", 4, same_group=["g"], block=16).collect():
        got.setdefault(vec[r.quid], []).extend([r.dist] * r.take)
    for g, x in set((g, tuple(x)) for g, x in rows):
        others = [y for h, y in rows if h == g]
        others.remove(list(x))
        assert _same(sorted(got[g, x]), sorted(math.dist(x, y) for y in others)[:4])


def test_categories_add_to_the_distance(spark):
    rnd = random.Random(9)
    pts = [(f"p{i}", [rnd.random() * 3], [rnd.choice("ab"), rnd.choice(["x", None])]) for i in range(200)]
    df = spark.createDataFrame(pts, "uid string, x array<double>, c array<string>").withColumn("cnt", F.lit(1))
    got = {}
    for r in NB.knn(df, df, "x", 3, cat_col="c", cat_penalty=0.5, block=20).collect():
        got.setdefault(r.quid, []).append(r.dist)
    for i, x, c in pts:
        want = sorted(math.sqrt((x[0] - y[0]) ** 2 + 0.25 * sum(a is None or b is None or a != b for a, b in zip(c, e)))
                      for j, y, e in pts if j != i)[:3]
        assert all(abs(a - b) < 1e-12 for a, b in zip(sorted(got[i]), want, strict=True))


def test_null_targets_and_unknown_features_pass_through(spark):
    rows = [(i, 0 if i < 30 else 1, float((i * 13) % 11), float((i * 7) % 5)) for i in range(40)]
    rows += [(50, None, 1.0, 2.0), (51, None, None, None), (52, 1, None, 3.0), (53, 0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k int, target int, a double, b double")
    for make in (NB.smote, NB.adasyn):
        out = make(df, "target", ["a", "b"], ["k"])
        assert out.where("synthetic_id is null").count() == len(rows)
        assert out.where("synthetic_id is not null and (target is null or a is null or isnan(a))").count() == 0
        n = {r["target"]: r["n"] for r in out.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert n[None] == 2 and n[0] == 31 and abs(n[1] - 31) <= (0 if make is NB.smote else 5)
    kept = NB.smote_enn(df, "target", ["a", "b"], ["k"])
    assert kept.where("target is null").count() == 2
    none = NB.smote(df.where("target is null"), "target", ["a", "b"], ["k"])
    assert none.count() == 2


def test_enn_equals_hand_rule(spark):
    rnd = random.Random(10)
    rows = [(i, rnd.choice([0, 0, 1]), rnd.random() * 2, rnd.random() * 2) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, target int, a double, b double")
    got = {r.k for r in NB.edited_nearest_neighbours(df, "target", ["a", "b"], 3).collect()}
    want = set()
    for i, t, a, b in rows:
        near = sorted((math.dist((a, b), (x, y)), u) for j, u, x, y in rows if j != i)[:3]
        if all(u == t for _, u in near):
            want.add(i)
    assert got == want


def test_a_pair_of_blocks_is_compared_in_strips():
    """The distances of a pair of blocks must not lie in memory at once, each worker holds as many."""
    import tracemalloc

    import numpy as np

    from tabflow.operators import metric_knn as KN
    r = np.random.default_rng(5)
    n = 2048
    x = r.integers(0, 300, (n, 2)).astype(float)
    cats = np.array(r.choice(["a", "b", None], (n, 1)), dtype=object)
    side = {"uids": [f"{i:05d}" for i in range(n)], "cnts": [1] * n, "centre": x.mean(axis=0), "x": x, "cats": cats}
    tracemalloc.start()
    found = list(KN._nearest(side, side, 3, 2.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6   # one 2048 x 2048 matrix is 34 MB, several were held
    for i in (0, 255, 256, 1000, n - 1):
        differ = np.array([c[0] is None or c[0] != cats[i, 0] for c in cats])
        d = np.sqrt(((x[i] - x) ** 2).sum(axis=1) + differ * 2.5 ** 2)
        want = sorted((dist, u) for j, (dist, u) in enumerate(zip(d.tolist(), side["uids"], strict=True)) if j != i)[:3]
        assert [(dist, u) for q, u, dist, _ in found if q == side["uids"][i]] == want
