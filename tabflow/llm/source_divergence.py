"""Source divergence audit: how differently the sources of each language use words.

Every (lang, source) group gives each of its language's kept terms a smoothed
share ``p`` in billionths. The audit compares all groups of a language with one
another and every group with its language, by exact integer partial divergences
``floor((p - q)^2 / (p + q))``.

The comparison is a cube of (group block, group block, term block) cells for each
language. A slice of the counts (one group block, one term block) is replicated to
the cells of its row and column; a cell turns its two slices into dense matrices of
bounded size, sums the partial divergences of its pairs of groups over its terms, and
the sums meet along the term axis in one aggregate. Terms that neither group has add
the same amount each, so a cell only counts what departs from that amount, and the
cells of term block 0 add it for all terms at once. The language's totals are a slice
of the diagonal cells, which keep each group's most divergent terms of their block.

Work is bounded by the cells, not by a group or language: counts are added up in the
workers before the first shuffle, so a source or a word that fills a third of the
corpus is a handful of partial counts, and a large language is more cells.

Defined results: null ``text``, ``lang`` or ``source`` count as the empty string; a
group without terms occurs (all its shares are the smoothing); where a language keeps
no term, its pairs have value 0 and there are no term rows; a language of one source
has no pairs; repeated rows count each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import ready, small_side, store, text_of
from tabflow.llm.words import LETTERS, words

MIN_DOCS = 10           # documents of its language that a kept term occurs in, at least
TOP_TERMS = 10
SCALE = 1_000_000_000   # shares are in billionths
GROUP_BLOCK = 64        # groups a block holds, on average
TERM_BLOCK = 4096       # terms a block holds, on average
HELD_COUNTS = 200_000   # partial counts that a worker holds before it hands them on

COUNTS = "lang string, source string, term string, n long, df long"
PARTIAL = "lang string, source string, part string, item string, value long"


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, df``: occurrences of each term in each group, and
    documents of the group that hold it. Every group has a row with a null term."""
    src = docs.select(text_of(docs[text_col]).alias("text"), text_of(docs[lang_col]).alias("lang"),
                      text_of(docs[source_col]).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, Counter] = defaultdict(Counter)
        holding: dict[tuple, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            keys = [(g, t) for g, c in total.items() for t in c]
            keys += [(g, None) for g in total]
            out = pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g, _ in keys], pa.string()), pa.array([g[1] for g, _ in keys], pa.string()),
                 pa.array([t for _, t in keys], pa.binary()).cast(pa.string()),
                 pa.array([total[g][t] if t is not None else 0 for g, t in keys], pa.int64()),
                 pa.array([holding[g][t] if t is not None else 0 for g, t in keys], pa.int64())],
                names=["lang", "source", "term", "n", "df"])
            total.clear()
            holding.clear()
            return out

        held = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = words(text.as_py(), LETTERS)
                group = (lang.as_py(), source.as_py())
                mine = total[group]
                held -= len(mine)
                mine.update(found)
                held += len(mine)
                holding[group].update(set(found))
                if held > HELD_COUNTS:
                    yield flush()
                    held = 0
        if total:
            yield flush()

    return (src.mapInArrow(run, COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


def shares(n: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * kept))`` in 64-bit integers: long
    division by three decimal digits at a time, so that no product leaves 64 bits."""
    rest = n.astype(np.int64) + 2
    whole = np.asarray(total, np.int64) + 2 * kept
    if whole.size and int(whole.max()) >= 2 ** 63 // 1000:
        raise OverflowError("a group holds more terms than 64-bit shares can express")
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def partial(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _cell(rows: pa.Table, top: int) -> pa.Table:
    """One cell of the cube. ``side`` is 0 for the groups of the first block, 1 for
    those of the second one (only off the diagonal) and 2 for the language; a row with
    a null term holds its group's total."""
    lang, left, right, block = (rows.column(c)[0].as_py() for c in ("lang", "left", "right", "block"))
    kept = rows.column("kept")[0].as_py()
    side = rows.column("side").to_numpy()
    n = rows.column("n").to_numpy()
    term = rows.column("term").combine_chunks().dictionary_encode()
    terms = term.dictionary.to_pylist()
    code = term.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    source = rows.column("source").combine_chunks().dictionary_encode()
    name = source.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    names = source.dictionary.to_pylist()

    head = np.flatnonzero((code < 0) & (side < 2))
    head = head[np.lexsort((name[head], side[head]))]
    at = np.full(len(names) + 1, -1)
    at[name[head]] = np.arange(len(head))
    body = np.flatnonzero((code >= 0) & (side < 2))
    count = np.zeros((len(head), len(terms)), np.int64)
    count[at[name[body]], code[body]] = n[body]
    size = n[head][:, None]
    none = shares(np.zeros((len(head), 1), np.int64), size, kept) if kept else np.ones((len(head), 1), np.int64)
    p = shares(count, size, kept) if kept else count
    out: list[tuple] = []

    first = int((side[head] == 0).sum())
    for a in range(first):
        others = np.arange(a + 1, first) if left == right else np.arange(first, len(head))
        if not len(others):
            continue
        base = partial(none[others, 0], none[a, 0])
        value = partial(p[others], p[a]).sum(axis=1) - len(terms) * base
        if block == 0:
            value = value + kept * base if kept else value * 0
        for b, v in zip(others, value.tolist(), strict=True):
            x, y = names[name[head[a]]], names[name[head[b]]]
            out += [(x, "pair", y, v), (y, "pair", x, v)]

    if left == right and kept and (side == 2).any():
        whole = int(n[(side == 2) & (code < 0)][0])
        body = np.flatnonzero((side == 2) & (code >= 0))
        q = np.zeros(len(terms), np.int64)
        q[code[body]] = shares(n[body], whole, kept)
        order = np.empty(len(terms), np.int64)
        order[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        for a in range(first):
            own = np.flatnonzero((count[a] > 0) & (p[a] > q))
            value = partial(p[a, own], q[own])
            best = np.lexsort((order[own], -value))[:top]
            out += [(names[name[head[a]]], "term", terms[own[i]], int(value[i])) for i in best]

    s, k, i, v = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"lang": pa.array([lang] * len(s), pa.string()), "source": pa.array(s, pa.string()),
                     "part": pa.array(k, pa.string()), "item": pa.array(i, pa.string()), "value": pa.array(v, pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, group_block: int = GROUP_BLOCK,
          term_block: int = TERM_BLOCK, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source
    of the language, part ``term`` the group's ``top_terms`` most divergent terms."""
    ready(docs.sparkSession)
    counts = store(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = store(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
                 .where(F.col("df") >= min_docs).drop("df"), "divergence-terms")
    own = store(counts.where("term is not null").drop("df").join(kept.select("lang", "term"), ["lang", "term"]),
                "divergence-slices")
    groups = (counts.where("term is null").select("lang", "source")
              .join(own.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    blocks = lambda n, per: F.greatest(F.ceil(n / F.lit(per)), F.lit(1)).cast("int")
    langs = small_side(
        groups.groupBy("lang").agg(F.count("*").alias("g"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("whole")), "lang", "left")
        .select("lang", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
                F.coalesce("whole", F.lit(0)).cast("long").alias("whole"),
                blocks(F.col("g"), group_block).alias("gb"), blocks(F.coalesce("kept", F.lit(0)), term_block).alias("tb")),
        "divergence-langs")

    null = F.lit(None).cast("string")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.pmod(F.xxhash64("source"), F.col("gb")).cast("int").alias("mine")
    of_term = F.pmod(F.xxhash64("term"), F.col("tb")).cast("int").alias("block")
    # a group's total goes to all its term blocks, its counts to the block of their term
    sides = (groups.join(langs, "lang").select("lang", "source", null.alias("term"), "n", "kept", "gb", mine,
                                               F.explode(all_of("tb")).alias("block"))
             .unionByName(own.join(langs, "lang").select("lang", "source", "term", "n", "kept", "gb", mine, of_term))
             .select("*", F.explode(all_of("gb")).alias("other"))
             .select("lang", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "block",
                     (F.col("mine") > F.col("other")).cast("int").alias("side"), "source", "term", "n", "kept"))
    # the language's totals go to the diagonal
    whole = (langs.select("lang", null.alias("term"), F.col("whole").alias("n"), "kept", "gb", F.explode(all_of("tb")).alias("block"))
             .unionByName(kept.join(langs, "lang").select("lang", "term", "n", "kept", "gb", of_term))
             .select("*", F.explode(all_of("gb")).alias("left"))
             .select("lang", "left", F.col("left").alias("right"), "block", F.lit(2).alias("side"), null.alias("source"),
                     "term", "n", "kept"))

    def run(table: pa.Table) -> pa.Table:
        return _cell(table, top_terms)

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return (sides.unionByName(whole).groupBy("lang", "left", "right", "block").applyInArrow(run, PARTIAL)
            .groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
            .withColumn("rank", rank.cast("int"))
            .where((F.col("part") == "pair") | (F.col("rank") <= top_terms)))
