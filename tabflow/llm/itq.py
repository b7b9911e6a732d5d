"""Embedding near-duplicates by iterative quantisation.

A rotation of the principal directions is learnt on a bounded sample so that the
signs of a vector's coordinates make a balanced binary code. Codes are cut into
substrings, each with its own table; a vector is looked up in every table under
its substring and all substrings at most a radius of bits away (multi-index
Hamming search). Candidates are reranked by the cosine of the original vectors,
in double precision.

The radius is the smallest one whose recall, measured in each run, reaches
``RECALL``: on the links that ``QUERIES`` vectors have by brute force over the
whole table (mean over links and mean over queries) and on pairs made at the
link angle from the sample, with a random direction and with that of another
vector apart. Where no radius up to ``MAX_RADIUS`` reaches it, all pairs of
balls in a label are compared. Groups of near copies are weighed down in the
sample, so that the code is not spent on them.

Angles obey the triangle inequality, which keeps dense groups linear: vectors
with the same code that lie within half the link angle of their smallest vector
are a ball, all of whose pairs are links. Only ball centres are searched; two
balls whose centres and radii prove all their pairs links (or none) are settled
by their centres, and only the rest are compared member by member.

Vectors link only inside equal, non-null labels, and each dimension has an index
of its own. Defined results: a vector that is null, empty, zero, or holds null or
non-finite components, or a null label, links with nothing; repeated vectors
(and repeated ids) link with each other like any pair; a component's id is its
smallest non-null ``vec_id``; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import connected_components, ready, store

COSINE = 0.93
#: bound of the sample that the rotation is fitted on
FIT_ROWS = 20_000
BITS = 64
TABLES = 4
#: codes further apart are no candidates of the narrowest search
MAX_HAMMING = 26
RECALL = 0.9
#: vectors that are compared with all others to measure the recall
QUERIES = 200
MAX_RADIUS = 4
BALL_ROUNDS = 3
_SLACK = 1e-7


def usable(embedding: Column, dim: int | None = None) -> Column:
    """A vector that can link: no null or non-finite component, not zero."""
    v = embedding.cast("array<double>")
    # a huge float would compare as finite, NaN as larger than all
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))


def spread(x: np.ndarray, cosine: float = COSINE, subset: int = 1000) -> np.ndarray:
    """Weights of a sample in random order: a group of near copies, sized by its
    share of the first rows, weighs about as much as one vector."""
    some = x[:subset]
    near = (x @ some.T >= cosine).sum(1) - (np.arange(len(x)) < len(some))
    return 1 / (1 + np.maximum(near, 0) * len(x) / max(len(some), 1))


def fit_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 5,
                 weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (principal directions times the learnt rotation) whose
    signs are the code; alternates nearest binary codes and the best rotation."""
    w = np.ones(len(x)) if weight is None else weight
    w = (w / w.sum())[:, None]
    mean = (w * x).sum(0)
    _, vectors = np.linalg.eigh((w * (x - mean)).T @ (x - mean) if len(x) > 1 else np.eye(x.shape[1]))
    directions = vectors[:, ::-1][:, :min(bits, x.shape[1])]
    z = (x - mean) @ directions
    k = z.shape[1]
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd((w * z).T @ np.where(z @ rotation >= 0, 1.0, -1.0))
        rotation = u @ vt
    return mean, directions @ rotation


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = ((unit - mean) @ projection >= 0).astype(np.uint64)
    return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1).astype(np.uint64).view(np.int64)


def radius_needed(a: np.ndarray, b: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The smallest radius that brings each two codes together in some table."""
    apart = (a ^ b).view(np.uint64)
    width = bits // tables
    mask = np.uint64((1 << width) - 1)
    need = np.min([np.bitwise_count((apart >> np.uint64(t * width)) & mask) for t in range(tables)], axis=0).astype(np.int64)
    return np.where(np.bitwise_count(apart) > MAX_HAMMING, np.maximum(need, 2), need)


def made_pairs(x: np.ndarray, cosine: float, n: int = 5000, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the link angle: vectors of the sample, moved in a random direction
    and in the direction of another one."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(len(x), size=n)]
    out = []
    for to in (rng.normal(size=a.shape), x[rng.integers(len(x), size=n)]):
        to = to - (to * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(to, axis=1)
        fine = size > 1e-6
        out.append((a[fine], cosine * a[fine] + math.sqrt(1 - cosine ** 2) * to[fine] / size[fine, None]))
    return out


def recalls(nodes: DataFrame, x: np.ndarray, mean: np.ndarray, projection: np.ndarray, tables: int, cosine: float) -> list[dict]:
    """Recall of the index for each radius from 1 on, one entry for each measure."""
    bits = projection.shape[1]
    last = min(MAX_RADIUS, bits // tables)
    out = [{} for _ in range(last)]
    for name, (a, b) in zip(("random", "data"), made_pairs(x, cosine), strict=True):
        need = radius_needed(_code(a, mean, projection), _code(b, mean, projection), tables, bits)
        for r in range(last if len(need) else 0):
            out[r][name] = float(np.mean(need <= r + 1))
    q = nodes.select("node", "label", "unit", "code").orderBy(F.xxhash64("same", "label"), "node").limit(QUERIES).collect()
    node, label, code = (np.array([r[k] for r in q], np.int64) for k in ("node", "label", "code"))
    unit = np.array([r["unit"] for r in q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = _matrix(batch.column(2)) @ unit.T
            mine, labels, theirs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            i, j = np.nonzero((cos >= cosine) & (labels[:, None] == label) & (mine[:, None] != node))
            keys, n = np.unique(j * (BITS + 1) + radius_needed(theirs[i], code[j], tables, bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // (BITS + 1)), pa.array(keys % (BITS + 1)), pa.array(n)],
                                             names=["q", "need", "n"])
    got = (nodes.select("node", "label", "unit", "code").mapInArrow(run, "q long, need long, n long")
           .groupBy("q", "need").agg(F.sum("n").alias("n")).collect())
    links = np.zeros((len(q), BITS + 1))
    for r in got:
        links[r["q"], r["need"]] += r["n"]
    links = links[links.sum(1) > 0]
    for r in range(last if len(links) else 0):
        found = links[:, :r + 2].sum(1)
        out[r] |= {"links": float(found.sum() / links.sum()), "queries": float(np.mean(found / links.sum(1)))}
    return out


def choose_radius(measured: list[dict], least: float = RECALL) -> int | None:
    """The smallest radius that is good enough by every measure, if any."""
    return next((r for r, m in enumerate(measured, 1) if min(m.values(), default=1.0) >= least), None)


def codes(rows: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """Adds ``unit`` (the normalised vector) and ``code`` to (_row, label, v) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _normal(_matrix(batch.column(2)))
            code = _code(unit, mean, projection)
            flat = pa.array(unit.ravel())
            offsets = pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat),
                                              pa.array(code)], names=["_row", "label", "unit", "code"])
    return rows.mapInArrow(run, "_row long, label long, unit array<double>, code long")


def with_cosine(pairs: DataFrame) -> DataFrame:
    """Replaces the unit vectors ``u`` and ``v`` by their cosine ``cos``."""
    keep = [c for c in pairs.columns if c not in ("u", "v")]
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", cos double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(keep)
            cos = np.einsum("ij,ij->i", _matrix(batch.column(n)), _matrix(batch.column(n + 1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(np.clip(cos, -1, 1))],
                                             names=[*keep, "cos"])
    return pairs.select(*keep, "u", "v").mapInArrow(run, schema)


def _balls(nodes: DataFrame, cosine: float) -> DataFrame:
    """``(node, leader, copies, unit, label, code, angle)``: every node in a ball.

    Per label and code the smallest node leads; nodes out of its reach elect
    again, and after the last round lead themselves."""
    half = math.acos(cosine) / 2 - _SLACK
    left, done = nodes, None
    for k in range(BALL_ROUNDS):
        lead = store(left.groupBy("label", "code").agg(F.min(F.struct("node", "unit")).alias("m"))
                     .select("label", "code", F.col("m.node").alias("leader"), F.col("m.unit").alias("v")), f"itq-leaders-{k}")
        near = with_cosine(left.select("label", "code", "node", "copies", F.col("unit").alias("u"), F.col("unit").alias("unit"))
                           .join(lead, ["label", "code"])
                           .select("label", "code", "node", "copies", "unit", "leader", "u", "v"))
        angle = F.when(F.col("node") == F.col("leader"), 0.0).otherwise(F.acos("cos"))
        near = store(near.select("label", "code", "node", "copies", "unit", "leader", angle.alias("angle")), f"itq-balls-{k}")
        inside = near.where(F.col("angle") <= half)
        done = inside if done is None else done.unionByName(inside)
        left = near.where(F.col("angle") > half).select("label", "code", "node", "copies", "unit")
    alone = left.select("label", "code", "node", "copies", "unit", F.col("node").alias("leader"), F.lit(0.0).alias("angle"))
    return done.unionByName(alone)


def _candidates(leaders: DataFrame, tables: int, bits: int, radius: int | None) -> DataFrame:
    """Pairs ``a < b`` of leaders that some table brings together, each once; with
    no radius all pairs of a label."""
    if radius is None:
        side = lambda k: leaders.select("label", F.col("leader").alias(k))
        return side("a").join(side("b"), "label").where("a < b").select("a", "b")
    width = bits // tables
    mask = (1 << width) - 1
    part = lambda code, t: F.shiftrightunsigned(code, t * width).bitwiseAND(F.lit(mask))
    near = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)]
    flips = F.from_json(F.lit(str(near)), "array<bigint>")
    index = leaders.select("label", "leader", "code", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), part(F.col("code"), t).alias("key")) for t in range(tables)])).alias("x"))
    index = index.select("label", F.col("leader").alias("b"), F.col("code").alias("code_b"), "x.t", "x.key")
    probe = leaders.select("label", "leader", "code", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), part(F.col("code"), t).alias("own")) for t in range(tables)])).alias("x"))
    # a pair with different substrings is found from the smaller one: half the look-ups
    keys = F.filter(F.transform(flips, lambda f: F.col("x.own").bitwiseXOR(f)), lambda k: k >= F.col("x.own"))
    probe = probe.select("label", F.col("leader").alias("a"), F.col("code").alias("code_a"), "x.t", "x.own", F.explode(keys).alias("key"))
    both = probe.join(index, ["label", "t", "key"]).where((F.col("key") > F.col("own")) | (F.col("a") < F.col("b")))
    apart = F.col("code_a").bitwiseXOR(F.col("code_b"))
    # a pair that several tables find is kept by the first of them
    first = F.coalesce(*[F.when(F.bit_count(part(apart, t)) <= radius, F.lit(t)) for t in range(tables)])
    reach = MAX_HAMMING if radius == 1 else bits
    return (both.where((first == F.col("t")) & (F.bit_count(apart) <= reach))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _linked(fine: DataFrame, cosine: float, tables: int, fit_rows: int) -> DataFrame:
    """``(_row, cls, n_links)`` of usable (_row, vec_id, label, v) rows of one dimension."""
    sample = fine.select("v", F.xxhash64("v", "vec_id").alias("o")).orderBy("o").limit(fit_rows).collect()
    x = _normal(np.array([r["v"] for r in sample]))
    mean, projection = fit_rotation(x, weight=spread(x, cosine))
    bits = projection.shape[1]
    tables = min(tables, bits)
    coded = store(codes(fine.select("_row", "label", "v"), mean, projection), "itq-codes")

    # equal vectors are one node
    digest = F.sha2(F.to_json("unit").cast("binary"), 256)
    coded = coded.withColumn("same", digest)
    nodes = store(coded.groupBy("label", "same").agg(
        F.min(F.struct("_row", "unit", "code")).alias("m"), F.count("*").alias("copies"))
        .select("label", "same", F.col("m._row").alias("node"), "copies", F.col("m.unit").alias("unit"),
                F.col("m.code").alias("code")), "itq-nodes")
    radius = choose_radius(recalls(nodes, x, mean, projection, tables, cosine))
    members = store(_balls(nodes.drop("same"), cosine), "itq-members")
    balls = store(members.groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("copies").alias("weight"),
                                                F.max(F.when(F.col("node") == F.col("leader"), F.struct("unit", "label", "code"))).alias("c"))
                  .select("leader", "radius", "weight", "c.unit", "c.label", "c.code"), "itq-centres")

    link = math.acos(cosine)
    pairs = _candidates(balls.select("leader", "label", "code"), tables, bits, radius)
    side = lambda k, u: balls.select(F.col("leader").alias(k), F.col("unit").alias(u), F.col("radius").alias(f"r_{k}"),
                                     F.col("weight").alias(f"w_{k}"))
    pairs = store(with_cosine(pairs.join(side("a", "u"), "a").join(side("b", "v"), "b")
                              .select("a", "b", "r_a", "r_b", "w_a", "w_b", "u", "v")), "itq-pairs")
    angle, reach = F.acos("cos"), F.col("r_a") + F.col("r_b")
    single = reach == 0
    whole = F.when(single, F.col("cos") >= cosine).otherwise(angle + reach <= link - _SLACK)
    never = F.when(single, F.col("cos") < cosine).otherwise(angle - reach > link + _SLACK)
    settled = pairs.where(whole)
    open_pairs = pairs.where(~whole & ~never).select("a", "b")
    of = lambda k, n, c, u: members.select(F.col("leader").alias(k), F.col("node").alias(n), F.col("copies").alias(c),
                                           F.col("unit").alias(u))
    single_links = store(with_cosine(open_pairs.join(of("a", "x", "c_x", "u"), "a").join(of("b", "y", "c_y", "v"), "b")
                                     .select("a", "b", "x", "y", "c_x", "c_y", "u", "v")).where(F.col("cos") >= cosine), "itq-links")

    ball_links = (settled.select(F.col("a").alias("leader"), F.col("w_b").alias("n"))
                  .unionByName(settled.select(F.col("b").alias("leader"), F.col("w_a").alias("n")))
                  .groupBy("leader").agg(F.sum("n").alias("n_ball")))
    node_links = (single_links.select(F.col("x").alias("node"), F.col("c_y").alias("n"))
                  .unionByName(single_links.select(F.col("y").alias("node"), F.col("c_x").alias("n")))
                  .groupBy("node").agg(F.sum("n").alias("n_node")))
    parts = connected_components(settled.select("a", "b").unionByName(single_links.select("a", "b")), "itq-components")
    centre = (balls.select("leader", "weight").join(ball_links, "leader", "left")
              .join(parts.withColumnRenamed("node", "leader"), "leader", "left")
              .select("leader", (F.col("weight") - 1 + F.coalesce("n_ball", F.lit(0))).alias("n"),
                      F.coalesce("component", "leader").alias("cls")))
    done = (members.select("node", "leader").join(store(centre, "itq-centre-links"), "leader")
            .join(node_links, "node", "left")
            .select("node", "cls", (F.col("n") + F.coalesce("n_node", F.lit(0))).alias("n_links")))
    labelled = store(nodes.select("label", "same", "node").join(done, "node").drop("node"), "itq-node-links")
    return coded.select("_row", "label", "same").join(labelled, ["label", "same"]).select("_row", "cls", "n_links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, fit_rows: int = FIT_ROWS,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``."""
    ready(vectors.sparkSession)
    # labels are compared as they are, carried as a number or its stand-in
    label = vectors[label_col]
    number = label.cast("long") if dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label)
    rows = store(vectors.select(
        F.monotonically_increasing_id().alias("_row"), vectors[id_col].cast("long").alias("vec_id"),
        F.when(label.isNotNull(), number).alias("label"), vectors[vec_col].cast("array<double>").alias("v")), "itq-rows")
    fine = rows.where(usable(F.col("v")) & F.col("label").isNotNull())
    dims = [r["d"] for r in fine.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    linked = reduce(DataFrame.unionByName, [_linked(fine.where(F.size("v") == d), cosine, tables, fit_rows) for d in dims])
    out = store(rows.select("_row", "vec_id").join(linked, "_row", "left")
                .select("vec_id", F.coalesce("cls", "_row").alias("cls"),
                        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "itq-row-links")
    least = out.groupBy("cls").agg(F.min("vec_id").alias("component_id"))
    return (out.join(store(least, "itq-least"), "cls")
            .select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")))
