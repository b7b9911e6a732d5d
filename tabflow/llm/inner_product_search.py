"""Exact top-k inner-product search by dual cover trees.

Vectors are scaled to integers, ``floor(256 x)``. Queries and data share one net:
centres chosen farthest-first on a bounded sample, so that every prefix is itself a
net at a coarser scale. A row belongs to the cell of its nearest centre; data blocks
are cells of the whole net, query blocks cells of a coarser prefix, and a cell larger
than a block is dealt out by a hash. Each block holds a cover tree of its rows: a
node's children are a net of half its covering radius that contains its own centre
(small neighbours share a leaf), with exact integer centres and squared radii.

For a query node and a data node with centres ``q, p`` and radii ``a, b`` no pair
scores more than ``<q, p> + |q| b + |p| a + a b``. The same bound serves at two
levels. Between blocks: every query block first meets its most promising data block,
which gives each query a floor (its k-th best score so far), then all data blocks
whose bound reaches the worst floor of the query block. Inside a pair of blocks: node
pairs are taken best-first and dropped when the bound is below the worst k-th score
in the query node. Leaves are multiplied in double precision on integers below 2^53,
that is exactly; bounds are raised by more than the rounding of their roots.

Blocks are rows of bounded size. A block that meets many others is matched in salted
groups, so no task gathers all partners of a block; only the net's sample, the
number of blocks and nothing of the rows themselves reach the driver. Where vectors
have no structure that a metric tree can use, all pairs of blocks are compared, which
is the stated query set against all rows, in blocks.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors are compared within their dimension only (empty ones score 0); equal
scores rank by ascending id, nulls last; a null id is a candidate but no query;
repeated rows are rows of their own, and a query leaves out its own row only; an empty
table gives an empty result; other columns are left out. Vectors so large that an
inner product might leave 2^53 raise ``OverflowError``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import ready, small_side, store

TOP = 5
QUERY_STEP = 50
SCALE = 256.0
FIT_ROWS = 20_000        # sample that the net is chosen from
MAX_CELLS = 1024
NET_BYTES = 32_000_000   # of the net's centres, for one dimension
DATA_BLOCK = 2048
QUERY_BLOCK = 1024
LEAF = 64
PARTNERS = 64            # blocks that one salted group of a block meets, on average
SLACK = 1e-9             # relative; the roots and products of a bound round by less than 1e-14

POINTS = "row long, vec_id long, dim int, x binary"
BLOCKS = ("dim int, block string, n int, centre array<double>, norm double, radius double, rows array<long>, "
          "ids array<long>, x binary, first array<int>, last array<int>, middle array<int>, reach array<double>, "
          "child array<int>, children array<int>")
FOUND = "query_row long, query_id long, query_block string, vec_id long, score long"


# ------------------------------------------------------------------- points
def points(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``row, vec_id, dim, x``: the vectors that take part, as integer-valued doubles."""
    src = vectors.select(F.monotonically_increasing_id().alias("row"), vectors[id_col].cast("long").alias("vec_id"),
                         vectors[vec_col].cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, xs = [], [], []
            for k, v in enumerate(batch.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(SCALE * x)
                if len(x) and 4.0 * len(x) * float(np.abs(x).max()) ** 2 >= 2.0 ** 53:
                    raise OverflowError("components too large for exact inner products")
                keep.append(k)
                dims.append(len(x))
                xs.append(x.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())],
                names=["row", "vec_id", "dim", "x"])

    return src.mapInArrow(run, POINTS)


def is_query(vec_id: Column, step: int = QUERY_STEP) -> Column:
    return F.coalesce(vec_id % step == 0, F.lit(False))


def choose_net(sample: list[np.ndarray], cells: int) -> np.ndarray:
    """Farthest-first centres out of equally long vectors, the coarsest first."""
    x = np.stack(sample)
    norm2 = (x * x).sum(axis=1)
    chosen, away = [0], None
    while len(chosen) < min(cells, len(x)):
        c = chosen[-1]
        to = norm2 - 2 * (x @ x[c]) + norm2[c]
        away = to if away is None else np.minimum(away, to)
        far = int(away.argmax())
        if away[far] <= 0:
            break
        chosen.append(far)
    return x[chosen]


def with_cells(pts: DataFrame, sample: int, data_block: int, query_block: int, step: int) -> DataFrame:
    """``pts`` with ``block`` and ``query_block`` (null but for queries)."""
    spark = pts.sparkSession
    sizes = {r["dim"]: (r["n"], r["q"]) for r in pts.groupBy("dim").agg(
        F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"), step)).alias("q")).orderBy(F.desc("n"), "dim").limit(sample).collect()}
    rows = pts.orderBy(F.xxhash64("row"), "row").limit(sample).select("dim", "x").collect()
    nets, coarse = {}, {}
    for dim, (n, q) in sizes.items():
        mine = [np.frombuffer(r["x"]) for r in rows if r["dim"] == dim]
        if dim and mine:
            cells = max(1, min(MAX_CELLS, -(-n // data_block), NET_BYTES // (8 * dim)))
            nets[dim] = choose_net(mine, cells)
            coarse[dim] = max(1, min(len(nets[dim]), -(-q // query_block)))
    net = spark.sparkContext.broadcast((nets, coarse))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, prefix = net.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, query_cell = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim not in centres:
                    continue
                c = centres[dim]
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 1024)):
                    x = np.stack([np.frombuffer(batch.column(3)[i].as_py()) for i in part.tolist()])
                    near = (c * c).sum(axis=1) - 2 * (x @ c.T)
                    cell[part] = near.argmin(axis=1)
                    query_cell[part] = near[:, :prefix[dim]].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(query_cell)],
                                             names=["row", "vec_id", "dim", "x", "cell", "query_cell"])

    placed = store(pts.mapInArrow(run, POINTS + ", cell int, query_cell int"), "topk-cells")
    query = is_query(F.col("vec_id"), step)

    def parts(rows: DataFrame, cell: str, size: int) -> DataFrame:
        return small_side(rows.groupBy("dim", cell).agg(F.ceil(F.count("*") / size).alias(f"{cell}_parts")), f"topk-{cell}")

    name = lambda cell: F.concat_ws("-", "dim", cell, F.pmod(F.xxhash64("row"), F.col(f"{cell}_parts")))
    return (placed.join(parts(placed, "cell", data_block), ["dim", "cell"])
            .join(parts(placed.where(query), "query_cell", query_block), ["dim", "query_cell"], "left")
            .select("row", "vec_id", "dim", "x", name("cell").alias("block"),
                    F.when(query, name("query_cell")).alias("query_block")))


# --------------------------------------------------------------- cover trees
def cover_tree(x: np.ndarray, leaf: int = LEAF):
    """Cover tree of the rows of ``x``: ``(order, first, last, middle, reach, child,
    children)``; a node covers ``order[first:last]``, ``middle`` is its centre's place
    in that order, its children lie side by side from ``child`` on."""
    norm2 = (x * x).sum(axis=1)

    def distance2(rows, c):
        return norm2[rows] - 2 * (x[rows] @ x[c]) + norm2[c]

    order = np.arange(len(x))
    reach2 = lambda rows, c: float(distance2(rows, c).max())
    nodes = [[0, len(x), 0, reach2(order, 0), 0, 0]]
    k = 0
    while k < len(nodes):
        first, last, centre, r2 = nodes[k][:4]
        rows = order[first:last].copy()
        if len(rows) > leaf and r2 > 0:
            groups, rest, c = [], rows, centre
            while len(rest):
                to = distance2(rest, c)
                near = 4 * to <= r2
                groups.append((c, rest[near]))
                rest, to = rest[~near], to[~near]
                c = int(rest[to.argmax()]) if len(rest) else c
            shared: list[tuple[int, list]] = []
            for c, own in groups:
                if shared and sum(map(len, shared[-1][1])) + len(own) <= leaf:
                    shared[-1][1].append(own)
                else:
                    shared.append((c, [own]))
            if len(shared) > 1:
                nodes[k][4:] = [len(nodes), len(shared)]
                for c, parts in shared:
                    own = np.concatenate(parts)
                    order[first:first + len(own)] = own
                    nodes.append([first, first + len(own), c, reach2(own, c), 0, 0])
                    first += len(own)
        k += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    table = np.array([n[:3] + n[4:] for n in nodes], np.int64)
    reach = np.sqrt(np.array([n[3] for n in nodes])) * (1 + SLACK)
    return order, table[:, 0], table[:, 1], place[table[:, 2]], reach, table[:, 3], table[:, 4]


def _block(dim: int, block: str, row: np.ndarray, vec_id: pa.Array, x: np.ndarray, leaf: int) -> pa.Table:
    order, first, last, middle, reach, child, children = cover_tree(x, leaf)
    x = np.ascontiguousarray(x[order])
    centre = x[middle[0]]
    ints = lambda v: pa.array([v], pa.list_(pa.int32()))
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.string()), "n": pa.array([len(order)], pa.int32()),
        "centre": pa.array([centre], pa.list_(pa.float64())), "norm": pa.array([float(np.sqrt(centre @ centre))]),
        "radius": pa.array([float(reach[0])]), "rows": pa.array([row[order]], pa.list_(pa.int64())),
        "ids": pa.array([vec_id.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary()),
        "first": ints(first), "last": ints(last), "middle": ints(middle), "reach": pa.array([reach], pa.list_(pa.float64())),
        "child": ints(child), "children": ints(children)})


def blocks(placed: DataFrame, key: str, leaf: int = LEAF) -> DataFrame:
    """One row a block: its vectors in tree order and their cover tree."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        raw = table.column("x").combine_chunks()
        x = np.frombuffer(b"".join(raw.to_pylist())).reshape(len(raw), dim)
        return _block(dim, table.column("block")[0].as_py(), table.column("row").to_numpy(),
                      table.column("vec_id").combine_chunks(), x, leaf)

    return (placed.where(F.col(key).isNotNull()).select("dim", F.col(key).alias("block"), "row", "vec_id", "x")
            .groupBy("dim", "block").applyInArrow(run, BLOCKS))


class Tree:
    def __init__(self, row: dict, prefix: str):
        arr = lambda c: row[prefix + c].values.to_numpy(zero_copy_only=False)
        self.rows, self.first, self.last, self.middle = arr("rows"), arr("first"), arr("last"), arr("middle")
        self.reach, self.child, self.children = arr("reach"), arr("child"), arr("children")
        ids = row[prefix + "ids"].values
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.x = np.frombuffer(row[prefix + "x"].as_py()).reshape(len(self.rows), -1)
        self.centres = self.x[self.middle]
        self.norms = np.sqrt((self.centres * self.centres).sum(axis=1))


def dual_search(q: Tree, d: Tree, k: int, floor: np.ndarray) -> list[list[tuple[float, int]]]:
    """For each query its ``k`` best ``(score, place)`` that reach its floor."""
    best: list[list[tuple[float, int]]] = [[] for _ in q.rows]
    kth = floor.copy()

    def bound(a, b):
        """Between nodes ``a`` and ``b``; one of the two may be a range."""
        dot = q.centres[a] @ d.centres[b].T
        away = q.norms[a] * d.reach[b] + d.norms[b] * q.reach[a] + q.reach[a] * d.reach[b]
        return dot + away + SLACK * (np.abs(dot) + away)

    def leaves(a: int, b: int) -> None:
        low, high = int(q.first[a]), int(q.last[a])
        start, stop = int(d.first[b]), int(d.last[b])
        score = q.x[low:high] @ d.x[start:stop].T
        own = q.rows[low:high, None] == d.rows[None, start:stop]
        score[own] = -np.inf
        good = (score >= kth[low:high, None]) & ~own
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            some = np.flatnonzero(good[i])
            if len(some) > k:
                cut = np.partition(score[i, some], len(some) - k)[len(some) - k]
                some = some[score[i, some] >= cut]
                at = start + some
                some = some[np.lexsort((d.ids[at], d.null[at], -score[i, some]))[:k]]
            mine = best[low + i]
            mine += [(float(score[i, j]), start + int(j)) for j in some]
            mine.sort(key=lambda s: (-s[0], d.null[s[1]], d.ids[s[1]]))
            del mine[k:]
            if len(mine) == k:
                kth[low + i] = max(kth[low + i], mine[-1][0])

    heap = [(-float(bound(0, 0)), 0, 0)]
    while heap:
        top, a, b = heapq.heappop(heap)
        if -top < kth[q.first[a]:q.last[a]].min():
            continue
        split_q, split_d = q.children[a] > 0, d.children[b] > 0
        if not split_q and not split_d:
            leaves(a, b)
            continue
        if split_q and (not split_d or q.reach[a] >= d.reach[b]):
            kids = np.arange(q.child[a], q.child[a] + q.children[a])
            for c, s in zip(kids.tolist(), bound(kids, b).tolist(), strict=True):
                if s >= kth[q.first[c]:q.last[c]].min():
                    heapq.heappush(heap, (-s, c, b))
        else:
            kids = np.arange(d.child[b], d.child[b] + d.children[b])
            worst = kth[q.first[a]:q.last[a]].min()
            for c, s in zip(kids.tolist(), bound(a, kids).tolist(), strict=True):
                if s >= worst:
                    heapq.heappush(heap, (-s, a, c))
    return best


def _meet(pairs: DataFrame, queries: DataFrame, data: DataFrame, counts: tuple[int, int], k: int, floors: DataFrame | None) -> DataFrame:
    """The best data rows of each query over the given pairs of blocks."""
    by_data, by_query = (max(1, -(-n // PARTNERS)) for n in counts)
    salt = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    spread = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    asked = queries if floors is None else queries.join(floors, "q_block", "left")
    if floors is None:
        asked = asked.withColumn("floors", F.lit(None).cast("map<bigint,double>"))
    both = (pairs.withColumn("q_salt", salt("d_block", by_data)).withColumn("d_salt", salt("q_block", by_query))
            .join(spread(asked, "q_salt", by_data), ["q_block", "q_salt"])
            .join(spread(data, "d_salt", by_query), ["d_block", "d_salt"]))
    tree = ("rows", "ids", "x", "first", "last", "middle", "reach", "child", "children")
    both = both.select("q_block", "floors", *[f"q_{c}" for c in tree], *[f"d_{c}" for c in tree])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                q, d = Tree(row, "q_"), Tree(row, "d_")
                known = dict(row["floors"].as_py() or ())
                floor = np.array([known.get(r, -np.inf) for r in q.rows.tolist()])
                found = [(a, s, b) for a, best in enumerate(dual_search(q, d, k, floor)) for s, b in best]
                at = np.array([a for a, _, _ in found], np.int64)
                to = np.array([b for _, _, b in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.rows[at]), pa.array(q.ids[at]), pa.array([row["q_block"].as_py()] * len(at), pa.string()),
                     pa.array(d.ids[to], mask=d.null[to]), pa.array([int(s) for _, s, _ in found], pa.int64())],
                    names=["query_row", "query_id", "query_block", "vec_id", "score"])

    return both.mapInArrow(run, FOUND)


def search(vectors: DataFrame, k: int = TOP, step: int = QUERY_STEP, id_col: str = "vec_id", vec_col: str = "embedding",
           fit_rows: int = FIT_ROWS, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows."""
    ready(vectors.sparkSession)
    pts = store(points(vectors, id_col, vec_col), "topk-points")
    placed = store(with_cells(pts, fit_rows, data_block, query_block, step), "topk-placed")
    data = store(blocks(placed, "block", leaf), "topk-data")
    queries = store(blocks(placed, "query_block", leaf), "topk-queries")
    data, queries = (df.select(*[F.col(c).alias(p + c) for c in df.columns]) for df, p in ((data, "d_"), (queries, "q_")))
    counts = (data.count(), queries.count())

    dot = F.aggregate(F.zip_with("q_centre", "d_centre", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    away = (F.col("q_norm") * F.col("d_radius") + F.col("d_norm") * F.col("q_radius") + F.col("q_radius") * F.col("d_radius"))
    heads = data.select("d_dim", "d_block", "d_centre", "d_norm", "d_radius")
    meets = store(queries.select("q_dim", "q_block", "q_centre", "q_norm", "q_radius")
                  .join(heads, F.col("q_dim") == F.col("d_dim"))
                  .select("q_block", "d_block", (dot + away + SLACK * (F.abs(dot) + away)).alias("bound")), "topk-pairs")
    first = meets.groupBy("q_block").agg(F.max_by("d_block", F.struct("bound", "d_block")).alias("d_block"))
    seed = store(_meet(first, queries, data, (1, counts[1]), k, None), "topk-seed")

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    floors = seed.groupBy("query_block", "query_row").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n"))
    floors = store(floors.where(F.col("n") == k).groupBy(F.col("query_block").alias("q_block"))
                   .agg(F.map_from_entries(F.collect_list(F.struct("query_row", "floor"))).alias("floors"),
                        F.min("floor").alias("worst"), F.count("*").alias("n")), "topk-floors")
    floors = floors.join(queries.select("q_block", "q_n"), "q_block")
    worst = floors.where(F.col("n") == F.col("q_n")).select("q_block", "worst")
    rest = (meets.join(first.select("q_block", F.col("d_block").alias("met")), "q_block").where(F.col("d_block") != F.col("met"))
            .join(worst, "q_block", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst")))
            .select("q_block", "d_block"))
    more = _meet(rest, queries, data, counts, k, floors.select("q_block", "floors"))
    return (seed.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
