"""Exact k nearest neighbours in any number of dimensions.

Points are cut into blocks by metric partitioning: in every group (the rows among
which neighbours are sought) that is larger than a block, pivots are chosen
farthest-first on a bounded sample, a point belongs to its nearest pivot's cell, and a
cell larger than a block is dealt out by a hash. Query rows are cut the same way. A
block is one row that holds its vectors and a ball around them.

By the triangle inequality no point of a data block is nearer to a query of a query
block than the distance of the balls. Every query block first meets the data blocks
with the nearest centres, enough of them to have ``k`` points; the largest k-th
distance found bounds its queries, and then it meets only the data blocks whose ball
is not farther. A pair of blocks is one matrix product, whose candidates are measured
again by direct differences, so distances and ties are those of the plain formula.
A pair hands on at most ``k`` neighbours for a query; a block with many partners is
matched in salted groups.

Clustered data meets few blocks; where vectors have no structure, all pairs of blocks
of a group are compared, block by block. Groups that fit a block (most classes of a
many-class target) need no pivots and no second round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.session import cut_lineage, ship_package

BLOCK = 2048
STRIP = 256                # query vectors of a block that are compared at once
SAMPLE = 20_000            # rows that pivots are chosen from
MAX_PIVOTS = 1024          # of a group
PARTNERS = 64              # blocks that one salted group of a block meets, on average
BROADCAST_ROWS = 1_000_000
SLACK = 1e-9               # relative; a bound rounds by less than 1e-14

_BLOCKS = ("g string, block string, n long, avail long, centre array<double>, radius double, uids array<string>, "
           "cnts array<long>, x binary, cats array<string>")
_FOUND = "q_block string, quid string, nuid string, dist double, avail long"


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots."""
    chosen, away = [0], None
    while len(chosen) < min(n, len(x)):
        to = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        away = to if away is None else np.minimum(away, to)
        far = int(away.argmax())
        if away[far] <= 0:
            break
        chosen.append(far)
    return x[chosen]


def _checked(df: DataFrame) -> DataFrame:
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _with_cells(rows: DataFrame, pivots) -> DataFrame:
    """``rows`` with the place of the nearest pivot of their group."""
    if pivots is None:
        return rows.withColumn("cell", F.lit(0))
    at_g, at_x = rows.columns.index("g"), rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            groups = batch.column(at_g).to_pylist()
            cell = np.zeros(batch.num_rows, np.int32)
            for g in set(groups) & known.keys():
                at = np.flatnonzero([x == g for x in groups])
                for part in np.array_split(at, -(-len(at) // 1024)):
                    x = np.array(batch.column(at_x).take(pa.array(part)).to_pylist())
                    p = known[g]
                    cell[part] = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell int"
    return rows.mapInArrow(run, schema)


def _make_block(rows: pa.Table) -> pa.Table:
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(rows.num_rows, -1)
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    cnts = rows.column("cnt").to_pylist()
    cats = [c for row in rows.column("cats").to_pylist() for c in row or ()]
    key = "-".join(str(rows.column(c)[0].as_py()) for c in ("g", "cell", "chunk"))
    return pa.table({
        "g": rows.column("g").slice(0, 1), "block": pa.array([key], pa.string()), "n": pa.array([len(x)], pa.int64()),
        "avail": pa.array([sum(cnts)], pa.int64()), "centre": pa.array([centre], pa.list_(pa.float64())),
        "radius": pa.array([radius]), "uids": pa.array([rows.column("uid").to_pylist()], pa.list_(pa.string())),
        "cnts": pa.array([cnts], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary()),
        "cats": pa.array([cats], pa.list_(pa.string()))})


def _blocks(rows: DataFrame, pivots, block: int, prefix: str) -> DataFrame:
    placed = _with_cells(rows, pivots)
    if pivots is None and prefix == "d":       # every group fits a block
        placed = placed.withColumn("chunk", F.lit(0))
    else:
        parts = placed.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
        placed = placed.join(_checked(parts), ["g", "cell"]) \
            .withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("parts"))).drop("parts")
    made = placed.groupBy("g", "cell", "chunk").applyInArrow(lambda t: _make_block(t), _BLOCKS)
    return cut_lineage(made.select(*[F.col(c).alias(f"{prefix}_{c}") for c in made.columns]))


def _nearest(q: dict, d: dict, k: int, penalty: float) -> Iterator[tuple[str, str, float, int]]:
    """``(quid, nuid, dist, avail)``: per query the nearest points of the block until
    ``k`` copies are found, by distance and then id."""
    b = d["x"] - d["centre"]
    b2 = (b * b).sum(axis=1)
    n_cats = q["cats"].shape[1] if q["cats"] is not None else 0
    codes: list[dict] = [{} for _ in range(n_cats)]

    def coded(values: np.ndarray, j: int) -> np.ndarray:
        return np.array([-1 if v is None else codes[j].setdefault(v, len(codes[j])) for v in values])

    known = [coded(d["cats"][:, j], j) for j in range(n_cats)]
    many = min(k + 1, len(b))
    place = {u: j for j, u in enumerate(d["uids"])}
    for start in range(0, len(q["uids"]), STRIP):   # a strip's matrices, not the block's, are in memory
        part = slice(start, start + STRIP)
        a = q["x"][part] - d["centre"]
        a2 = (a * a).sum(axis=1)
        near = a2[:, None] + b2[None, :] - 2 * (a @ b.T)
        extra = None
        if n_cats:
            extra = np.zeros(near.shape)
            for j in range(n_cats):
                x, y = coded(q["cats"][part, j], j), known[j]
                extra += ((x[:, None] != y[None, :]) | (x[:, None] < 0)) * penalty ** 2  # a null equals nothing
            near += extra
        # the product rounds: every point that may be among the first ones is measured again
        limit = np.partition(near, many - 1, axis=1)[:, many - 1] + 1e-11 * (a2 + b2.max() + 1e-300)
        for i, quid in enumerate(q["uids"][part]):
            some = np.flatnonzero(near[i] <= limit[i])
            d2 = ((q["x"][start + i] - d["x"][some]) ** 2).sum(axis=1)
            if extra is not None:
                d2 = d2 + extra[i, some]
            dist, own, got = np.sqrt(d2), place.get(quid, -1), 0
            for t in sorted(range(len(some)), key=lambda t: (dist[t], d["uids"][some[t]])):
                j = int(some[t])
                avail = d["cnts"][j] - (j == own)
                if avail > 0:
                    yield quid, d["uids"][j], float(dist[t]), avail
                    got += avail
                    if got >= k:
                        break


def _open(row: dict, prefix: str, n_cats: int) -> dict:
    uids = row[f"{prefix}_uids"].as_py()
    cats = row[f"{prefix}_cats"].as_py()
    return {"uids": uids, "cnts": row[f"{prefix}_cnts"].as_py(), "centre": np.array(row[f"{prefix}_centre"].as_py()),
            "x": np.frombuffer(row[f"{prefix}_x"].as_py()).reshape(len(uids), -1),
            "cats": np.array(cats, dtype=object).reshape(len(uids), n_cats) if n_cats else None}


def _meet(pairs: DataFrame, queries: DataFrame, data: DataFrame, counts: tuple[int, int], k: int, n_cats: int,
          penalty: float) -> DataFrame:
    by_data, by_query = (max(1, -(-n // PARTNERS)) for n in counts)
    salt = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    spread = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    held = ("uids", "cnts", "centre", "x", "cats")
    both = (pairs.select("q_block", "d_block", salt("d_block", by_data).alias("q_salt"), salt("q_block", by_query).alias("d_salt"))
            .join(spread(queries, "q_salt", by_data), ["q_block", "q_salt"])
            .join(spread(data, "d_salt", by_query), ["d_block", "d_salt"])
            .select("q_block", *[f"{p}_{c}" for p in "qd" for c in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                found = list(_nearest(_open(row, "q", n_cats), _open(row, "d", n_cats), k, penalty))
                quid, nuid, dist, avail = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"].as_py()] * len(quid), pa.string()), pa.array(quid, pa.string()),
                     pa.array(nuid, pa.string()), pa.array(dist, pa.float64()), pa.array(avail, pa.int64())],
                    names=["q_block", "quid", "nuid", "dist", "avail"])

    return both.mapInArrow(run, _FOUND)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    """The nearest ``k`` copies of each query; ``take`` of every neighbour's copies."""
    before = Window.partitionBy("quid").orderBy("dist", "nuid").rowsBetween(Window.unboundedPreceding, -1)
    c = found.withColumn("before", F.coalesce(F.sum("avail").over(before), F.lit(0))).where(F.col("before") < k)
    return c.withColumn("take", F.least(F.col("avail"), F.lit(k) - F.col("before")))


def knn(points: DataFrame, queries: DataFrame, vec_col: str, k: int, same_group: list[str] | None = None,
        cat_col: str | None = None, cat_penalty: float = 0.0, block: int = BLOCK, stats: dict | None = None) -> DataFrame:
    """``(quid, nuid, dist, take)``: the exact k nearest ``points`` of every query, both
    with columns ``uid`` (text, unique) and ``cnt`` (copies; of a query's own point one
    copy is the query itself). ``take`` copies of neighbour ``nuid`` are among the k
    (they sum to k, or to all there are). With ``cat_col`` (arrays of categories) each
    mismatch adds ``cat_penalty`` squared to the squared distance; a null category
    equals nothing. ``stats`` receives the number of vector pairs compared."""
    spark = ship_package(points.sparkSession)
    grp = list(same_group or [])

    def side(df: DataFrame) -> DataFrame:
        g = F.to_json(F.struct(*[F.col(c) for c in grp])) if grp else F.lit("")
        cats = F.col(cat_col) if cat_col else F.lit(None)
        return df.select(g.alias("g"), "uid", F.col("cnt").cast("long").alias("cnt"), F.col(vec_col).cast("array<double>").alias("x"),
                         cats.cast("array<string>").alias("cats"))

    p, q = side(points), side(queries)
    n_cats = (p.agg(F.max(F.size("cats"))).first()[0] or 0) if cat_col else 0
    large = {r["g"]: r["n"] for r in p.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).collect()}
    pivots = None
    if large:  # at most points / block groups
        names = spark.createDataFrame([(g,) for g in large], "g string")
        sample: dict[str, list] = {}
        for r in p.join(F.broadcast(names), "g", "left_semi").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("g", "x").collect():
            sample.setdefault(r["g"], []).append(r["x"])
        pivots = spark.sparkContext.broadcast({
            g: choose_pivots(np.array(xs), min(MAX_PIVOTS, -(-2 * large[g] // block))) for g, xs in sample.items()})
    data, asked = _blocks(p, pivots, block, "d"), _blocks(q, pivots, block, "q")
    heads = lambda df, x: df.select(*[f"{x}_{c}" for c in ("g", "block", "n", "avail", "centre", "radius")])
    apart = F.sqrt(F.aggregate(F.zip_with("q_centre", "d_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    meets = (heads(asked, "q").join(heads(data, "d"), F.col("q_g") == F.col("d_g"))
             .select("q_block", "d_block", "q_n", "d_n", "d_avail", apart.alias("apart"),
                     (apart * (1 - SLACK) - (F.col("q_radius") + F.col("d_radius")) * (1 + SLACK)).alias("low")))
    if pivots is None:
        first, counts = meets, (1, 1)
    else:
        meets = cut_lineage(meets)
        counts = (data.count(), asked.count())
        so_far = Window.partitionBy("q_block").orderBy("apart", "d_block").rowsBetween(Window.unboundedPreceding, -1)
        first = cut_lineage(meets.withColumn("so_far", F.coalesce(F.sum("d_avail").over(so_far), F.lit(0))).where(F.col("so_far") <= k)
                            .drop("so_far"))
    found = _meet(first, asked, data, counts, k, n_cats, cat_penalty)
    met = [first]
    if pivots is not None:
        found = cut_lineage(found)
        per = _first_k(found, k).groupBy("q_block", "quid").agg(F.sum("take").alias("got"), F.max("dist").alias("kth"))
        reach = (per.where(F.col("got") >= k).groupBy("q_block").agg(F.count(F.lit(1)).alias("sure"), F.max("kth").alias("reach")))
        rest = (meets.join(first.select("q_block", "d_block"), ["q_block", "d_block"], "left_anti").join(_checked(reach), "q_block", "left")
                .where(F.col("reach").isNull() | (F.col("sure") < F.col("q_n")) | (F.col("low") <= F.col("reach") * (1 + SLACK))))
        rest = cut_lineage(rest)
        met.append(rest)
        found = found.unionByName(_meet(rest, asked, data, counts, k, n_cats, cat_penalty))
    if stats is not None:
        stats["pairs"] = sum(m.agg(F.coalesce(F.sum(F.col("q_n") * F.col("d_n")), F.lit(0))).first()[0] for m in met)
    return _first_k(found, k).select("quid", "nuid", "dist", "take")
