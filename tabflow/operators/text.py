"""Text features (E18): exact TF-IDF weights and dense embeddings by truncated SVD.

Terms are maximal runs of letters and digits in lower case. The vocabulary is counted
exactly over all rows; an embedding model keeps the ``max_terms`` terms that most
documents hold (equal counts by term), as its size must be bounded to be shipped.

Embeddings are latent semantic ones: rows are scaled to length 1 and projected on the
first right singular vectors of the weight matrix, found by subspace iteration from a
seeded start. The kept terms are counted once, batch by batch of texts; a step is one pass
over these counts, whose workers multiply their sparse rows with the current basis and
back, and hand on one partial sum a term; the driver only orthogonalises the (terms x
dimensions) basis.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import SEED
from tabflow.session import cut_lineage, ship_package

TERM_GAPS = r"[^\p{L}\p{N}]+"
MAX_TERMS = 50_000
BROADCAST_TERMS = 1_000_000   # frequent terms shipped to every executor
ROWS_PER_TASK = 4_000      # texts whose terms are counted in one task
OVERSAMPLE = 8
STEPS = 4


def terms(col: str | Column) -> Column:
    """The terms of a text, in order; a null or termless text has none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), TERM_GAPS), "")


def term_weights(df: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """``key, term, tf, df, tfidf`` for every term of every row, with the weight
    tf · ln((rows + 1) / (df + 1)); rows are told apart by their unique key (rows of one
    key count as one text).

    Texts are dealt out by key, so that a text's terms are counted, weighed and, by the
    caller, added up where it lies. The most frequent terms, as many as can be shipped,
    are looked up there too; only the rows of the others move."""
    n = df.count()
    spread = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    tf = (df.select(key_col, text_col).repartition(spread, key_col).select(key_col, F.explode(terms(text_col)).alias("term"))
          .groupBy(key_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    common = cut_lineage(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1))
    # terms by the power of two that their frequency reaches (at most 63 rows)
    sizes = {r["p"]: r["n"] for r in common.groupBy(F.floor(F.log2("df")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = next(p for p in range(1, 65) if sum(k for q, k in sizes.items() if q >= p) <= BROADCAST_TERMS)
    frequent = F.floor(F.log2("df")) >= cut
    j = tf.join(F.broadcast(common.where(frequent)), "term", "left")
    if any(q < cut for q in sizes):
        j = j.where(F.col("df").isNotNull()).unionByName(
            j.where(F.col("df").isNull()).drop("df").join(common.where(~frequent), "term", "left"))
    j = j.withColumn("df", F.coalesce("df", F.lit(1).cast("long")))
    return j.select(key_col, "term", "tf", "df", (F.col("tf") * F.log(F.lit(n + 1.0) / (F.col("df") + 1))).alias("tfidf"))


def vocabulary(df: DataFrame, text_col: str, max_terms: int = MAX_TERMS, min_docs: int = 1) -> tuple[list[str], list[float]]:
    """The kept terms and their inverse document frequencies."""
    n = df.count()
    seen = (df.select(F.explode(F.array_distinct(terms(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .where(F.col("df") >= min_docs))
    rows = seen.orderBy(F.desc("df"), "term").limit(max_terms).collect()
    return [r["term"] for r in rows], [math.log((n + 1) / (r["df"] + 1)) for r in rows]


def _counts(found: pa.ListArray, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, term, count)`` of the kept terms of a batch of texts."""
    lengths = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(found.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(found)), lengths)[at >= 0]
    key, n = np.unique(text * len(names) + at[at >= 0], return_counts=True)
    return key // len(names), key % len(names), n


def _scaled(text: np.ndarray, term: np.ndarray, n: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """Weights of the counts, those of a text scaled to length 1 (all zero where no term counts)."""
    w = n * idf[term]
    norm = np.sqrt(np.bincount(text, w * w, rows))
    return w / np.where(norm > 0, norm, 1.0)[text]


def fit_embedding(df: DataFrame, text_col: str, dims: int, max_terms: int = MAX_TERMS, min_docs: int = 1, steps: int = STEPS,
                  seed: int = SEED) -> tuple[DataFrame, list[float]]:
    """The embedding table ``term, idf, vec`` and the singular values. Fewer dimensions
    come out where the texts have a lower rank."""
    spark = ship_package(df.sparkSession)
    names, idf = vocabulary(df, text_col, max_terms, min_docs)
    width = min(dims + OVERSAMPLE, len(names))
    if not width:
        return spark.createDataFrame([], "term string, idf double, vec array<double>"), []
    fixed = spark.sparkContext.broadcast((pa.array(names, pa.string()), np.array(idf)))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(names), width)))[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _counts(batch.column(0), fixed.value[0])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *[pa.array([x.astype(np.int32).tobytes()]) for x in found]],
                                             names=["rows", "text", "term", "n"])

    # one row a batch of texts: numbers of the kept terms instead of the terms of all steps
    counted = cut_lineage(df.select(terms(text_col).alias("t")).where(F.size("t") > 0)
                          .mapInArrow(count, "rows int, text binary, term binary, n binary"))

    def times(basis: np.ndarray) -> np.ndarray:
        """A'A times the basis, A being the weight matrix of all documents."""
        shared = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, w = fixed.value[1], shared.value
            total, seen = np.zeros_like(w), np.zeros(len(w), bool)
            for batch in batches:
                for rows, *held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    text, term, n = (np.frombuffer(x, np.int32) for x in held)
                    v = _scaled(text, term, n, rows, weight)
                    for j in range(w.shape[1]):
                        total[:, j] += np.bincount(term, v * np.bincount(text, v * w[term, j], rows)[text], len(w))
                    seen[term] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, j]) for j in range(w.shape[1])]],
                                             names=["i", *[f"c{j}" for j in range(w.shape[1])]])

        sums = counted.mapInArrow(run, "i int, " + ", ".join(f"c{j} double" for j in range(basis.shape[1])))
        out = np.zeros_like(basis)
        for r in sums.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(basis.shape[1])]).collect():   # one row a kept term
            out[r["i"]] = r[1:]
        return out

    for _ in range(steps):
        basis = np.linalg.qr(times(basis))[0]
    small = basis.T @ times(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = [j for j in np.argsort(-values) if values[j] > 1e-12 * max(values.max(), 1e-300)][:dims]
    vectors = basis @ turn[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    table = spark.createDataFrame([(t, w, v.tolist()) for t, w, v in zip(names, idf, vectors, strict=True)],
                                  "term string, idf double, vec array<double>")
    return cut_lineage(table), np.sqrt(np.maximum(values[order], 0.0)).tolist()


def embedding(table: DataFrame, text_col: str, dims: int) -> Column:
    """The embedding of a text as an array of ``dims`` numbers; zeros for a text that is
    null or has no known term."""
    spark = ship_package(table.sparkSession)
    rows = table.orderBy("term").collect()    # at most max_terms, in one order whatever the files
    idf = np.array([r["idf"] for r in rows])
    vec = np.array([r["vec"] for r in rows]).reshape(len(rows), -1)
    model = spark.sparkContext.broadcast((pa.array([r["term"] for r in rows], pa.string()), idf, vec))

    @F.arrow_udf("array<double>")
    def project(found: pa.Array) -> pa.Array:
        names, idf, vec = model.value
        out = np.zeros((len(found), dims))
        if len(names):
            text, term, n = _counts(found, names)
            v = _scaled(text, term, n, len(found), idf)
            for j in range(vec.shape[1]):
                out[:, j] = np.bincount(text, v * vec[term, j], len(found))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dims, dtype=np.int32)), pa.array(out.ravel()))

    return project(terms(text_col))
