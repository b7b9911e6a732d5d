"""Ranked lexical search: exact top documents of each query by a sparse ball tree.

A document is a sparse vector over the queries' terms (its integer term scores), a
query is the vector of its terms' integer weights, and the score is their inner
product. Documents are indexed in blocks of bounded size, a ball tree for each:
every node has an integer centroid and the exact squared covering radius of its
documents, halves are split by two far-apart pivots. For a query ``q`` no document of
a ball scores more than ``<q, c> + |q| r`` (Cauchy-Schwarz), where only the terms of
``q`` that the ball's documents hold count. Centroids, radii and scores are integers; only the bound's roots and products round, so it is raised by
a relative 1e-9 and by one, more than those roundings can take away. Subtrees are
taken best-first and dropped when the bound is below the query's k-th best score;
leaves are scored in exact 64-bit integers.

The search has two rounds over the stored trees: a descent into each tree's most
promising leaf, whose k best scores over all trees are a proven floor for each query,
and the full search, which prunes against that floor from the start. A block hands on
at most k documents for a query.

Queries are taken in batches of bounded size: their vocabulary goes to the workers,
and only it, the document frequencies of its terms and the queries' floors pass
through the driver. Documents stay in the partitions that the reader gives them; the
only shuffles are those of frequencies and of the blocks' best documents.

Defined results: null and empty texts have no terms, neither match nor are matched;
a document matches with a score above 0 only; equal scores rank by ascending
``doc_id``, nulls last; repeated rows are documents, or queries, of their own (equal
``item_id`` are told apart by the column ``item``); empty tables give an empty result;
other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import ready, store, text_of
from tabflow.llm.words import LETTERS_AND_DIGITS, words

TOP = 10
BATCH_TERMS = 1_000_000     # distinct terms of the queries of a batch, summed over queries
BLOCK_DOCS = 2048           # documents of a tree
BLOCK_POSTINGS = 400_000    # their term scores, but for a single longer document
LEAF = 32
QUERY_CHUNK = 128           # queries whose weights a task holds as dense vectors
COLUMN_CHUNK = 8192

VECTORS = "doc_id long, n long, idx array<int>, tf array<long>"
#: documents in tree order, then nodes in preorder; ``cols`` maps columns to terms
TREES = ("doc_ids array<long>, ptr array<int>, col array<int>, val array<long>, cols array<int>, "
         "first array<int>, last array<int>, left array<int>, right array<int>, "
         "c_ptr array<int>, c_col array<int>, c_val array<long>, r2 array<long>")
FOUND = "item long, doc_id long, score long"


# ------------------------------------------------------------------ vectors
def term_vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, idx, tf`` of every document with a term: its number of terms, and
    the occurrences of those of the vocabulary."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value
        for batch in batches:
            ids, n, idx, tf, keep = batch.column(0), [], [], [], []
            for k, text in enumerate(batch.column(1)):
                found = words(text.as_py(), LETTERS_AND_DIGITS)
                if not found:
                    continue
                own = sorted((at[t], c) for t, c in Counter(found).items() if t in at)
                keep.append(k)
                n.append(len(found))
                idx.append([i for i, _ in own])
                tf.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(idx, pa.list_(pa.int32())),
                 pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "idx", "tf"])

    return src.mapInArrow(run, VECTORS)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def length_factor(n: int, docs: int, total: int) -> int:
    return 100 - 90 + (90 * n * docs) // total


# --------------------------------------------------------------------- tree
def _spans(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of ``rows`` in row order, and where each row starts."""
    size = ptr[rows + 1] - ptr[rows]
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    return np.repeat(ptr[rows] - start, size) + np.arange(int(size.sum())), start


def build_tree(ptr: np.ndarray, col: np.ndarray, val: np.ndarray, width: int, leaf: int = LEAF):
    """Ball tree over sparse rows, none of them empty: ``(order, nodes, centroids)``,
    a node being ``(first, last, left, right, r2)`` with ``left`` -1 at a leaf."""
    order = np.arange(len(ptr) - 1)
    norm2 = np.add.reduceat(val * val, ptr[:-1])
    nodes: list[list[int]] = []
    centroids: list[tuple[np.ndarray, np.ndarray]] = []

    def distance2(rows, at, start, point):
        return norm2[rows] - 2 * np.add.reduceat(point[col[at]] * val[at], start) + int(point @ point)

    def dense(row: int) -> np.ndarray:
        point = np.zeros(width, np.int64)
        point[col[ptr[row]:ptr[row + 1]]] = val[ptr[row]:ptr[row + 1]]
        return point

    stack = [(0, len(order), -1, 2)]
    while stack:
        first, last, parent, side = stack.pop()
        rows = order[first:last]
        at, start = _spans(ptr, rows)
        total = np.zeros(width, np.int64)
        np.add.at(total, col[at], val[at])
        centre = -(-total // len(rows))  # rounded up: not zero wherever a document is not
        away = distance2(rows, at, start, centre)
        r2 = int(away.max())
        me = len(nodes)
        nodes.append([first, last, -1, -1, r2])
        some = np.flatnonzero(centre)
        centroids.append((some, centre[some]))
        if parent >= 0:
            nodes[parent][side] = me
        if len(rows) <= leaf or r2 == 0:
            continue
        to_a = distance2(rows, at, start, dense(rows[int(away.argmax())]))
        to_b = distance2(rows, at, start, dense(rows[int(to_a.argmax())]))
        half = len(rows) // 2
        order[first:last] = rows[np.argsort(to_a - to_b, kind="stable")]
        stack.append((first + half, last, me, 3))
        stack.append((first, first + half, me, 2))
    return order, nodes, centroids


def _tree_row(ids: list, idx: list[np.ndarray], val: list[np.ndarray], leaf: int) -> dict:
    size = np.array([len(i) for i in idx])
    ptr = np.concatenate(([0], np.cumsum(size)))
    cols, col = np.unique(np.concatenate(idx), return_inverse=True)
    value = np.concatenate(val)
    order, nodes, centroids = build_tree(ptr, col, value, len(cols), leaf)
    at, _ = _spans(ptr, order)
    node = np.array(nodes)
    return {"doc_ids": [ids[i] for i in order], "ptr": np.concatenate(([0], np.cumsum(size[order]))), "col": col[at],
            "val": value[at], "cols": cols, "first": node[:, 0], "last": node[:, 1], "left": node[:, 2], "right": node[:, 3],
            "c_ptr": np.concatenate(([0], np.cumsum([len(c) for c, _ in centroids]))),
            "c_col": np.concatenate([c for c, _ in centroids]), "c_val": np.concatenate([v for _, v in centroids]),
            "r2": node[:, 4]}


def trees(vectors: DataFrame, docs: int, total: int, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS,
          leaf: int = LEAF) -> DataFrame:
    """One row a block: its documents' term scores and their ball tree."""
    kinds = [("list64", "doc_ids"), ("list32", "ptr"), ("list32", "col"), ("list64", "val"), ("list32", "cols"),
             ("list32", "first"), ("list32", "last"), ("list32", "left"), ("list32", "right"), ("list32", "c_ptr"),
             ("list32", "c_col"), ("list64", "c_val"), ("list64", "r2")]

    def as_batch(row: dict) -> pa.RecordBatch:
        arrays = [pa.array([row[c]], pa.list_(pa.int64() if k == "list64" else pa.int32())) for k, c in kinds]
        return pa.RecordBatch.from_arrays(arrays, names=[c for _, c in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        idx: list[np.ndarray] = []
        val: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, n, terms, tf in zip(*(batch.column(i) for i in range(4)), strict=True):
                own = np.asarray(terms.values, np.int64)
                if not len(own):
                    continue
                if ids and (len(ids) >= block_docs or held + len(own) > block_postings):
                    yield as_batch(_tree_row(ids, idx, val, leaf))
                    ids, idx, val, held = [], [], [], 0
                count = np.asarray(tf.values, np.int64)
                ids.append(doc_id.as_py())
                idx.append(own)
                val.append(1_000_000_000 * count // (1000 * count + 8 * length_factor(n.as_py(), docs, total)))
                held += len(own)
        if ids:
            yield as_batch(_tree_row(ids, idx, val, leaf))

    return vectors.mapInArrow(run, TREES)


# ------------------------------------------------------------------- search
class Tree:
    """One stored block, opened for searching."""

    def __init__(self, row: dict):
        for name, values in row.items():
            setattr(self, name, values)
        last = np.iinfo(np.int64).max
        self.sort_ids = self.doc_ids.fill_null(last).to_numpy(zero_copy_only=False)
        self.null_ids = self.doc_ids.is_null().to_numpy(zero_copy_only=False)
        self.radius = np.sqrt(self.r2.astype(np.float64))

    def weights(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Dense weights ``(queries, columns)`` of the block's own columns."""
        out = np.zeros((len(queries), len(self.cols)), np.int64)
        for k, (terms, w) in enumerate(queries):
            at = np.searchsorted(self.cols, terms)
            ok = at < len(self.cols)
            ok[ok] = self.cols[at[ok]] == terms[ok]
            out[k, at[ok]] = w[ok]
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds ``(nodes, queries)`` of the scores in each node."""
        node = np.repeat(np.arange(len(self.first)), np.diff(self.c_ptr))
        dot, norm2 = np.zeros((len(self.first), len(q))), np.zeros((len(self.first), len(q)))
        for start in range(0, q.shape[1], COLUMN_CHUNK):
            some = (self.c_col >= start) & (self.c_col < start + COLUMN_CHUNK)
            wide = np.zeros((len(self.first), min(COLUMN_CHUNK, q.shape[1] - start)))
            wide[node[some], self.c_col[some] - start] = self.c_val[some]
            weights = q[:, start:start + COLUMN_CHUNK].T.astype(np.float64)
            dot += wide @ weights
            norm2 += (wide > 0) @ (weights * weights)
        return np.ceil((dot + self.radius[:, None] * np.sqrt(norm2)) * (1 + 1e-9)) + 1

    def leaf_scores(self, node: int, q: np.ndarray) -> tuple[np.ndarray, int]:
        first, last = int(self.first[node]), int(self.last[node])
        a, b = self.ptr[first], self.ptr[last]
        return np.add.reduceat(q[self.col[a:b]] * self.val[a:b], self.ptr[first:last] - a), first

    def promising(self, q: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The best documents of the leaf that the larger bounds lead to."""
        node = 0
        while self.left[node] >= 0:
            node = max(int(self.left[node]), int(self.right[node]), key=bound.__getitem__)
        return self._best(*self.leaf_scores(node, q), k, 1)

    def _best(self, scores: np.ndarray, first: int, k: int, floor: int) -> list[tuple[int, int]]:
        some = np.flatnonzero(scores >= floor)
        if len(some) > k:
            cut = np.partition(scores[some], len(some) - k)[len(some) - k]
            some = some[scores[some] >= cut]
            at = first + some
            some = some[np.lexsort((self.null_ids[at], self.sort_ids[at], -scores[some]))[:k]]
        return [(int(scores[i]), first + int(i)) for i in some]

    def search(self, q: np.ndarray, bound: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The block's ``k`` best documents that score ``floor`` at least, best-first."""
        heap = [(-bound[0], 0)]
        best: list[tuple[int, int]] = []
        while heap and -heap[0][0] >= floor:
            node = heapq.heappop(heap)[1]
            if self.left[node] >= 0:
                for child in (int(self.left[node]), int(self.right[node])):
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            found = self._best(*self.leaf_scores(node, q), k, floor)
            if found:
                best += found
                best.sort(key=lambda x: (-x[0], self.null_ids[x[1]], self.sort_ids[x[1]]))
                del best[k:]
                if len(best) == k:
                    floor = max(floor, best[-1][0])
        return best


def _open(batch: pa.RecordBatch) -> Iterator[Tree]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {c: batch.column(k)[i].values for k, c in enumerate(names)}
        yield Tree({c: v if c == "doc_ids" else v.to_numpy(zero_copy_only=False) for c, v in row.items()})


def _search(forest: DataFrame, queries, k: int, floors=None) -> DataFrame:
    """``item, doc_id, score`` candidates of every tree; without floors only those of
    each tree's most promising leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        floor = floors.value if floors is not None else {}
        for batch in batches:
            for tree in _open(batch):
                items, docs, scores = [], [], []
                for start in range(0, len(asked), QUERY_CHUNK):
                    part = asked[start:start + QUERY_CHUNK]
                    q = tree.weights([(t, w) for _, t, w in part])
                    bound = tree.bounds(q)
                    for j, (item, _, _) in enumerate(part):
                        if not q[j].any():
                            continue
                        found = (tree.promising(q[j], bound[:, j], k) if floors is None
                                 else tree.search(q[j], bound[:, j], k, floor.get(item, 1)))
                        items += [item] * len(found)
                        docs += [x for _, x in found]
                        scores += [s for s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int64()), tree.doc_ids.take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())],
                    names=["item", "doc_id", "score"])

    return forest.mapInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _batch(docs: DataFrame, asked: list, k: int, sizes: dict) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in asked for t in terms})
    vectors = store(term_vectors(docs, vocabulary, **sizes["columns"]), "search-vectors")
    n_docs, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(vectors.select(F.explode("idx").alias("t")).groupBy("t").count().collect())
    at = {t: i for i, t in enumerate(vocabulary)}
    queries = []
    for item, terms in asked:
        own = np.array(sorted(at[t] for t in terms if at[t] in holding), np.int64)
        queries.append((item, own, np.array([weight(holding[i], n_docs) for i in own.tolist()], np.int64)))
    forest = store(trees(vectors, n_docs, total, **sizes["blocks"]), "search-trees")
    shared = spark.sparkContext.broadcast(queries)
    seeds = _top(_search(forest, shared, k), k).groupBy("item").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    floors = {r["item"]: r["floor"] for r in seeds.where(F.col("n") == k).collect()}
    return _search(forest, shared, k, spark.sparkContext.broadcast(floors))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, batch_terms: int = BATCH_TERMS, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS,
           block_postings: int = BLOCK_POSTINGS, leaf: int = LEAF) -> DataFrame:
    """``item, item_id, rank, doc_id, score``: each query's ``k`` best documents."""
    spark = ready(docs.sparkSession)
    sizes = {"columns": {"id_col": id_col, "text_col": text_col},
             "blocks": {"block_docs": block_docs, "block_postings": block_postings, "leaf": leaf}}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(words(t.as_py(), LETTERS_AND_DIGITS))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = store(items.select(F.monotonically_increasing_id().alias("item"), items[item_col].alias("item_id"),
                              text_of(items[item_text_col]).alias("text")), "search-items")
    asked = store(rows.select("item", "text").mapInArrow(distinct, "item long, terms array<binary>"), "search-terms")
    n_terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    batches = max(1, -(-n_terms // batch_terms))
    found = None
    for b in range(batches):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b)
        part = _batch(docs, [(r["item"], [bytes(t) for t in r["terms"]]) for r in mine.collect()], k, sizes)
        found = part if found is None else found.unionByName(part)
    return (_top(found, k).join(rows.select("item", "item_id"), "item")
            .select("item", "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
