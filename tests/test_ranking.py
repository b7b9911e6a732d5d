"""The bucketed (large-data) paths of the distributed rank / running-sum
helpers give exactly the plain-window answers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabflow.functions.columns import seeded_hex
from tabflow.functions.ranking import hash_rank, prefix_sums, range_rank, top_k_per_group


def test_hash_rank_buckets_equal_window(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 3).cast("int")).withColumn("h", seeded_hex("id"))
    small = hash_rank(df, "h", ["g"], tiebreak=["id"], rows_per_bucket=50)     # many sub-buckets
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    assert small.select("id", "rank").exceptAll(ref.select("id", "rank")).count() == 0


def test_range_rank_buckets_equal_window(spark):
    df = spark.range(3000).withColumn("t", (F.col("id") * 7919 % 1000).cast("double"))
    got = range_rank(df, ["t", "id"], rows_per_bucket=100)
    ref = df.withColumn("rank", F.row_number().over(Window.orderBy("t", "id")))
    assert got.select("id", "rank").exceptAll(ref.select("id", "rank")).count() == 0


def test_prefix_sums_buckets_equal_window(spark):
    df = spark.range(2000).select((F.col("id") % 4).cast("string").alias("c"), (F.col("id") * 1.5).alias("s"),
                                  (F.col("id") % 7).alias("v"))
    got = prefix_sums(df, "s", ["v"], descending=True, rows_per_bucket=100, partition_cols=["c"])
    w = Window.partitionBy("c").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("v_cum", F.sum("v").over(w))
    assert got.select("c", "s", "v_cum").exceptAll(ref.select("c", "s", "v_cum")).count() == 0


def test_top_k_per_group_salted(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = top_k_per_group(df, ["g"], ["v"], 3, salt_buckets=8)
    assert sorted((r.g, r.v) for r in got.collect()) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_exact_quantile_selection_matches_percentile(spark):
    import tabflow.operators.stats as ST
    df = spark.range(20000).select((F.col("id") * 7919 % 10007 / 3.0).alias("a"),
                                   F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 97).cast("double").alias("b"))
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = ST.exact_quantiles_large(df, ["a", "b"], probs)
    ref = ST.quantiles(df, ["a", "b"], probs, exact=True)
    for c in ("a", "b"):
        assert [round(x, 9) for x in got[c]] == [round(x, 9) for x in ref[c]]


def test_exact_quantile_selection_heavy_duplicates(spark):
    import tabflow.operators.stats as ST
    df = spark.range(6000).select(F.when(F.col("id") < 3000, 1.0).when(F.col("id") < 5990, 2.0)
                                  .otherwise(F.col("id").cast("double")).alias("a"))
    probs = [0.1, 0.4999, 0.5, 0.5001, 0.998, 1.0]
    got = ST.exact_quantiles_large(df, ["a"], probs)["a"]
    ref = ST.quantiles(df, ["a"], probs, exact=True)["a"]
    assert [round(x, 9) for x in got] == [round(x, 9) for x in ref]


def test_hash_rank_null_groups_multi_bucket(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 2).cast("string"))) \
        .withColumn("h", seeded_hex("id"))
    got = hash_rank(df, "h", ["g"], tiebreak=["id"], rows_per_bucket=40)
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    assert got.count() == 3000
    assert got.select("id", "rank").exceptAll(ref.select("id", "rank")).count() == 0


def test_null_keys_and_groups_survive_many_buckets(spark):
    from pyspark.sql import functions as F

    from tabflow.functions.ranking import prefix_sums, range_rank
    df = spark.range(400).select("id", F.when(F.col("id") % 10 != 0, F.col("id") * 7 % 400).alias("t"))
    one = {r.id: r["rank"] for r in range_rank(df, ["t", "id"]).collect()}
    many = {r.id: r["rank"] for r in range_rank(df, ["t", "id"], rows_per_bucket=40).collect()}
    assert one == many and len(many) == 400
    g = spark.range(600).select(F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(1).alias("n"))
    for descending in (False, True):
        one = sorted(map(str, prefix_sums(g, "o", ["n"], descending, partition_cols=["g"]).collect()))
        many = sorted(map(str, prefix_sums(g, "o", ["n"], descending, rows_per_bucket=50, partition_cols=["g"]).collect()))
        assert one == many and len(many) == 600


def test_null_group_is_a_group(spark):
    from pyspark.sql import functions as F

    from tabflow.operators.folds import group_kfold
    df = spark.range(100).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 4).alias("g"))
    for mode in ("greedy", "hash"):
        rows = group_kfold(df, "g", 3, mode=mode).collect()
        assert len(rows) == 100 and all(r.fold is not None for r in rows)
        assert len({r.fold for r in rows if r.g is None}) == 1


def test_range_rank_splits_a_hot_value(spark):
    from pyspark.sql import functions as F

    from tabflow.functions import ranking
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 5 == 0, None)
                                  .otherwise(F.col("id") * 7919 % 1000).cast("double").alias("t"),
                                  F.when(F.col("id") % 11 != 0, (F.col("id") * 31 % 3001).cast("int")).alias("u"))
    got = ranking.range_rank(df, ["t", "u", "id"], rows_per_bucket=50)
    ref = df.withColumn("rank", F.row_number().over(Window.orderBy("t", "u", "id")))
    assert got.columns == ref.columns and got.count() == 3000
    assert got.select("id", "rank").exceptAll(ref.select("id", "rank")).count() == 0
    d = df.withColumn("_tf_ord", F.col("t")).withColumn("_tf_bkt", F.when(F.col("t") == 5, 1).otherwise(0))
    cut = ranking._split_ties(d, F.col("u").cast("double"), 50).where("_tf_bkt = 1").groupBy("_tf_sub").count()
    assert max(r["count"] for r in cut.collect()) <= 150


def test_radix_selection_of_any_values(spark):
    import math

    import numpy as np
    from pyspark.sql import functions as F

    from tabflow.operators import stats as ST
    r = np.random.default_rng(5)
    wide = np.concatenate([r.normal(size=300), r.normal(size=100) * 1e300, -np.exp(r.normal(size=200) * 200), np.zeros(150), [-0.0] * 50,
                           [math.inf, -math.inf, 5e-324, -5e-324]])
    r.shuffle(wide)
    rows = [(float(x), float(i % 3), None if i % 2 else float(x)) for i, x in enumerate(wide)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9]
    got = ST.exact_quantiles_large(df, ["a", "b", "c", "none"], probs)
    for name, values in (("a", wide), ("b", [x[1] for x in rows]), ("c", [x[2] for x in rows if x[2] is not None])):
        s = np.sort(np.array(values))
        for p, g in zip(probs, got[name]):
            k = p * (len(s) - 1)
            lo, hi = s[int(k)], s[min(int(k) + 1, len(s) - 1)]
            want = lo + (hi - lo) * (k - int(k)) if k > int(k) else lo
            assert g == want or math.isclose(g, want, rel_tol=1e-12)
    assert got["none"] == [None] * 6
    assert ST.exact_quantiles_large(df.limit(0), ["a"], [0.5]) == {"a": [None]}
