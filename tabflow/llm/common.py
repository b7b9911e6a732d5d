"""Helpers shared by the training-data operators: scratch tables in the shared
folder, readers, connected components over an edge table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.session import scratch_path, table_path

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where the driver only has it
    on its own ``sys.path`` (a cluster ships it with ``--py-files``)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only."""
    return ready(spark).read.parquet(table_path(sf_dir, name))


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is
    cut, and values such as generated row ids are fixed from here on."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str | Column) -> Column:
    """The text, a null counting as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` long pairs.

    Alternates the two star steps: every node hands its larger neighbours the
    smallest node it knows, then every node and its smaller neighbours hang on
    the smallest of them. The edge count never grows and the graph ends as stars
    around each component's smallest node, in about log(diameter) rounds. Each
    round is one written table; a task only ever sees a slice of one node's
    edges, because minima are combined before the shuffle and the join back has
    plain shuffles on both sides that adaptive execution may split.

    Returns ``(node, component)``, one row for each node that has an edge to
    another node. Raises if the rounds run out (never returns half a result).
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    cur = store(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
                f"{name}-edges")
    if cur.isEmpty():
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(max_rounds):
        # large star: both directions, neighbours above the node move to its minimum
        both = cur.unionByName(cur.select(b.alias("a"), a.alias("b")))
        mins = store(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-min")
        large = (both.where(b > a).join(mins, "a").where(b != F.col("m"))
                 .select(b.alias("a"), F.col("m").alias("b")))
        large = store(large.distinct(), f"{name}-large")
        # small star: edges point from the larger node to the smaller one
        mins = store(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-min")
        joined = large.join(mins, "a")
        small = (joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                 .unionByName(mins.select("a", F.col("m").alias("b"))))
        cur = store(small.distinct(), f"{name}-small")
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            roots = cur.select(b.alias("node"), b.alias("component")).distinct()
            return cur.select(a.alias("node"), b.alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def small_side(df: DataFrame, name: str, max_rows: int = 500_000, row_bytes: Column | None = None,
               max_bytes: int = 64_000_000) -> DataFrame:
    """``df`` as a stored table, marked for broadcast only where its counted rows
    stay under ``max_rows`` (narrow key tables), and the sum of ``row_bytes``, for
    rows without a fixed width, under ``max_bytes``; beyond that it is shuffled."""
    kept = store(df, name)
    width = F.lit(0) if row_bytes is None else row_bytes
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(kept) if rows <= max_rows and size <= max_bytes else kept


def nested(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``df`` inside one column ``doc``, beside ``more``, so that names
    used on the way never clash with the caller's; ``select("doc.*")`` brings them back."""
    return df.select(*more, F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("doc"))
