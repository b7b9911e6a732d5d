"""N-gram Jaccard join by MinHash banding.

Documents are sets of word n-grams (five words). The join finds all pairs of
documents whose sets have a Jaccard similarity of at least the threshold (0.8):

1. Signatures: MinHash values in bands. Rows per band and number of bands are
   the sharpest ones that reach the target recall within the hash budget.
2. Copies: documents with the same words are one node from here on.
3. Banding: nodes are shuffled on (band, band hash); all nodes of a bucket hang
   on its smallest node, so a bucket of any size gives as many rows as it has
   members, and never its pairs. Components of these links are candidate groups:
   both ends of every candidate pair are in one group.
4. Verification on the full n-gram sets. A group of up to ``BLOCK`` documents is
   one unit of work; a larger one is split into blocks and every pair of blocks
   is one, so a hot group spreads over many tasks. Where a larger group is a chain
   whose buckets together have fewer pairs than its members, its buckets are
   verified instead, each pair in the first bucket that it shares. A unit intersects its sets at
   once and gives, per document, its number of links and a chain to the smallest
   linked document - again never the pairs.
5. Classes are the components of those chains.

``n_links`` counts the other rows linked to a row, copies included; ``class_id``
is the smallest ``doc_id`` of its class; ``kept`` marks the row of each class
that a de-duplication keeps (smallest ``doc_id``, then the smallest row id).

Defined results: a text without words (null and empty too) links with nothing
and is a class of its own; a text of fewer than five words is one n-gram;
repeated rows are copies of each other; a null ``doc_id`` is larger than any
other and a class of only such rows has a null ``class_id``; an empty table
gives an empty result; other columns are left out of ``join`` and kept by
``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import connected_components, nested, ready, small_side, store, text_of

N = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
MAX_HASHES = 100
#: documents of a verification block
BLOCK = 512
_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_HASHES: dict[str, int] = {}
SIGNATURE = "_row long, doc_id long, n_grams long, words string, bands array<long>"


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, budget: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which a pair at the threshold
    shares a band with the target probability within ``budget`` hash values."""
    best = None
    for rows in range(1, budget + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= budget:
            best = (bands, rows)
    if best is None:
        raise ValueError("the hash budget cannot reach the recall")
    return best


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    known = _HASHES
    if len(known) > 500_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_set(words: list[str], n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = _mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[i:len(h) - n + 1 + i]
    return np.unique(_mix(out))


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, k, dtype=np.uint64))


def band_hashes(grams: np.ndarray, bands: int, rows: int, perms) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature."""
    a, b = perms
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 4096):
        part = grams[i:i + 4096]
        for k in range(0, bands * rows, 20):
            v = part[None, :] * a[k:k + 20, None] + b[k:k + 20, None]
            v ^= v >> np.uint64(32)
            low[k:k + 20] = np.minimum(low[k:k + 20], v.min(axis=1))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = _mix(out + low[r::rows])
    return out.view(np.int64)


def tag(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` inside ``doc``, beside a row id ``_row`` that is fixed by
    writing the table."""
    return store(nested(docs, F.monotonically_increasing_id().alias("_row")), "ngram-rows")


def signatures(tagged: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: row id, n-gram count, digest of the words, band hashes."""
    ready(tagged.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    src = tagged.select("_row", F.col("doc")[id_col].cast("long").alias("doc_id"), text_of(F.col("doc")[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = _permutations(bands * rows)
        for batch in batches:
            counts, digests, hashes = [], [], []
            for value in batch.column(2):
                words = words_of(value.as_py())
                grams = gram_set(words, n)
                counts.append(len(grams))
                digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                hashes.append(band_hashes(grams, bands, rows, perms) if len(grams) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(hashes, pa.list_(pa.int64()))], names=["_row", "doc_id", "n_grams", "words", "bands"])

    return src.mapInArrow(run, SIGNATURE)


def _similar(sets: list[np.ndarray], split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) with Jaccard >= threshold; with a ``split`` only pairs
    across it. The sets' membership matrix is multiplied slice by slice."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    gram = np.cumsum(first) - 1
    shared = np.bincount(gram)[gram] > 1  # a gram of one document is in no intersection
    gram, owner = gram[shared], owner[shared]
    cut = split if split else m
    inter = np.zeros((cut, m - (split or 0)), np.float32)
    if len(gram):
        gram = np.cumsum(np.concatenate([[True], gram[1:] != gram[:-1]])) - 1
        step = 2048
        edges = np.searchsorted(gram, np.arange(0, gram[-1] + step + 1, step))
        for i in range(len(edges) - 1):
            part = slice(edges[i], edges[i + 1])
            x = np.zeros((m, step), np.float32)
            x[owner[part], gram[part] - i * step] = 1
            inter += x[:cut] @ (x[split:].T if split else x.T)
    union = sizes[:cut, None] + sizes[None, (split or 0):] - inter
    # in whole numbers, so a pair at exactly the threshold counts
    hit = np.rint(inter) >= threshold * union - 1e-9
    if not split:
        hit = np.triu(hit, 1)
    a, b = np.nonzero(hit)
    return a, b + (split or 0)


def _verify(group: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """One unit of work: a block (all pairs in it) or two (the pairs across).

    Gives per node the rows linked to it, and the smallest node that a chain of
    this unit's links reaches."""
    group = group.sort_values(["side", "node"], kind="stable")
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    sides = group["side"].to_numpy()
    split = int((sides == sides[0]).sum()) if sides[0] != sides[-1] else 0
    sets = [gram_set(words_of(t), n) for t in group["text"]]
    a, b = _similar(sets, split, threshold)
    band = int(group["band"].iloc[0])
    if band > 0 and len(a):  # a bucket's unit: pairs that share an earlier bucket are found there
        bands = np.stack(group["bands"].to_numpy())[:, :band]
        new = np.array([not (bands[i] == bands[j]).any() for i, j in zip(a, b, strict=True)], bool)
        a, b = a[new], b[new]
    links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
    low = node.copy()
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            break
        low = new
    return pd.DataFrame({"node": node, "links": links.astype("int64"), "low": low})


def classes(tagged: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
            block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_row, doc_id, class_id, n_links, kept)`` for every row of a tagged table."""
    sig = store(signatures(tagged, n, threshold, recall, id_col, text_col), "ngram-signatures")
    # copies: one node per distinct word sequence
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    nodes = store(sig.where("n_grams > 0").groupBy("words").agg(
        F.min(F.struct("_row", "bands")).alias("m"), F.count("*").alias("copies"), first.alias("first"))
        .select("words", F.col("m._row").alias("node"), "copies", F.col("m.bands").alias("bands"), "first"), "ngram-nodes")
    # buckets: every member hangs on the smallest node of its bucket
    member = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    heads = store(member.groupBy("band", "h").agg(F.min("node").alias("head"), F.count("*").alias("k"))
                  .where("k > 1"), "ngram-buckets")
    hang = member.join(heads.drop("k"), ["band", "h"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = connected_components(hang, "ngram-candidates")
    # a group's pairs are those of its members, or of its buckets where that is less:
    # a chain of many small buckets is long, but its buckets have few pairs
    square = lambda c: F.col(c).cast("double") * F.col(c)
    sizes = (groups.groupBy("component").agg(F.count("*").alias("size"))
             .join(heads.join(groups, heads["head"] == groups["node"])
                   .groupBy("component").agg(F.sum(square("k")).alias("bucket_pairs")), "component")
             .select("component", "size", ((F.col("size") > block) & (F.col("bucket_pairs") < square("size"))).alias("chain")))
    placed = store(groups.join(small_side(sizes, "ngram-sizes"), "component"), "ngram-placed")
    whole = placed.where("not chain").select("node", F.lit(-1).alias("band"), F.col("component").alias("unit"), "size")
    chained = member.join(placed.where("chain").select("node"), "node").join(heads.select("band", "h", "k"), ["band", "h"])
    chained = chained.select("node", "band", F.col("h").alias("unit"), F.col("k").alias("size"))
    blocks = F.ceil(F.col("size") / block)
    placed = store(whole.unionByName(chained).select("node", "band", "unit", F.pmod(F.xxhash64("node"), blocks).alias("block"),
                                                     F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")),
                   "ngram-units")
    texts = (tagged.select(F.col("_row").alias("node"), F.col("doc")[text_col].alias("text"))
             .join(nodes.select("node", "copies", "bands"), "node"))
    units = texts.join(placed, "node").select(
        "node", "copies", "bands", "text", "band", "unit", F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"), F.col("block").alias("side"))
    found = store(units.groupBy("band", "unit", "lo", "hi").applyInPandas(
        lambda g: _verify(g, n, threshold), "node long, links long, low long"), "ngram-links")
    per = found.groupBy("node").agg(F.sum("links").alias("links"))
    chains = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), "ngram-classes")
    # from nodes back to rows
    labelled = store(nodes.select("words", "node", "copies", "first").join(per, "node", "left")
                     .join(chains, "node", "left")
                     .select("words", F.coalesce("component", "node").alias("cls"), "first",
                             (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ngram-node-classes")
    # the first row of a class is stored before it is joined back: a class of any size
    # is then a plain join, whose hot key adaptive execution may split
    firsts = store(labelled.groupBy("cls").agg(F.min("first").alias("f")), "ngram-firsts")
    labelled = store(labelled.join(firsts, "cls").select("words", "n_links", "f"), "ngram-nodes-done")
    return (sig.select("_row", "doc_id", F.when(F.col("n_grams") > 0, F.col("words")).alias("words"))
            .join(labelled, "words", "left")
            .select("_row", "doc_id", F.when(F.col("f").isNull(), F.col("doc_id")).otherwise(F.col("f.doc_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    (F.coalesce("f._row", "_row") == F.col("_row")).alias("kept")))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, block: int = BLOCK,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, kept``."""
    ready(docs.sparkSession)
    tagged = tag(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    return classes(tagged, n, threshold, recall, block).drop("_row")


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
                block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class; all columns as they were."""
    ready(docs.sparkSession)
    tagged = tag(docs)
    gone = classes(tagged, n, threshold, recall, block, id_col, text_col).where(~F.col("kept")).select("_row")
    return tagged.join(small_side(gone, "ngram-gone"), "_row", "left_anti").select("doc.*")
