"""Benchmark decontamination with DataFrame operations only.

Words are maximal runs of digits, letters a-z and characters beyond ASCII, after
lower-casing A-Z. A benchmark window is 13 consecutive words of an item (an item
of fewer words is one window). The windows form a hash set, broadcast behind a
size check. Documents are scanned in two steps that lose no occurrence:

1. Every occurrence of 13 words covers one whole block of 7 words that starts at
   a multiple of 7. Only these blocks are made from the text and looked up (by
   hash) among the windows' 7-word grams; each carries the 6 words on either side.
2. The up to 7 windows that cover a block found are made from its words and
   verified against the set by their full text.

Short items are looked up at every position, all short lengths in one pass. Nothing
but found windows is shuffled; whose windows they are is joined to a document's
distinct windows afterwards. Columns of any name pass through the two removals.

Defined results: a null or wordless text has 0 words and 0 hits; repeated rows
get equal results; items without words (or null) are no windows; windows of an
item with a null id are hit but not listed among the items; an empty benchmark
leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import nested, small_side, store, text_of

# The word pattern, window length and contamination rule.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BLOCK = 7
MIN_SHARE_INVERSE = 20
#: bytes of window text up to which the benchmark's hash set is broadcast
BROADCAST_BYTES = 64_000_000


#: every ASCII character that is no word character
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The words; A-Z in lower case, all else as it is. A null or wordless text has none."""
    spaced = F.trim(F.translate(text_of(text), string.ascii_uppercase + _GAPS,
                                string.ascii_lowercase + " " * len(_GAPS)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def _key(id_col: Column, text: Column) -> Column:
    """Equal for repeated rows only; stands for the row in the table of hits."""
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(text_of(text).cast("binary")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct windows ``(gram_id, length, gram)`` and, apart from them, whose they
    are ``(gram_id, item)``, as stored tables."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), words_of(benchmark[text_col]).alias("w"))
    items = items.where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = items.select("item", n.alias("length"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))
    owned = store(grams.distinct(), "benchmark-owned")
    grams = store(owned.select("length", "gram").distinct().select(F.monotonically_increasing_id().alias("gram_id"), "length", "gram"),
                  "benchmark-windows")
    return grams, store(owned.join(grams, ["length", "gram"]).select("gram_id", "item"), "benchmark-owners")


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def hits(docs: DataFrame, grams: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``(key, start, length, gram_id)``: every occurrence of a window, by word position."""
    sizes = grams.groupBy("length").agg(F.sum(F.octet_length("gram") + 64).alias("b")).collect()
    small = sum(r["b"] for r in sizes) <= BROADCAST_BYTES
    short = sorted(r["length"] for r in sizes if r["length"] < window)
    rows = docs.select(_key(docs[id_col], docs[text_col]).alias("key"), words_of(docs[text_col]).alias("w"))
    long_grams = grams.where(F.col("length") == window).select("gram", "gram_id")

    # step 1: aligned blocks and their surroundings
    side = window - block
    aligned = F.transform(
        F.sequence(F.lit(0), F.size("w") - block, F.lit(block)),
        lambda j: F.struct(j.alias("at"), F.xxhash64(F.slice("w", j + 1, block)).alias("block"),
                           F.greatest(j - side, F.lit(0)).alias("from"),
                           F.slice("w", F.greatest(j - side, F.lit(0)) + 1,
                                   j + block + side - F.greatest(j - side, F.lit(0))).alias("near")))
    blocks = rows.select("key", F.explode(F.when(F.size("w") >= window, aligned)).alias("b"))
    parts = long_grams.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(side + 1)),
        lambda i: F.xxhash64(F.slice(F.split("gram", " "), i, block)))).alias("block")).distinct()
    found = (blocks.select("key", "b.at", "b.from", "b.near", "b.block")
             .join(_hinted(parts, small), "block", "left_semi"))
    # step 2: the windows that cover the block, verified in full
    last = F.col("from") + F.size("near") - window
    windows = found.where(last >= F.col("from")).select("key", F.explode(F.transform(
        F.sequence(F.col("from"), F.least(F.col("at"), last)),
        lambda s: F.struct(s.alias("start"), F.array_join(F.slice("near", s - F.col("from") + 1, window), " ").alias("gram"))
    )).alias("x")).select("key", "x.start", "x.gram")
    out = windows.join(_hinted(long_grams, small), "gram").select("key", "start", F.lit(window).alias("length"), "gram_id")
    if short:  # items of fewer words: all their lengths in one pass
        of_length = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(
            (i - 1).alias("start"), n.alias("length"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
        lengths = F.filter(F.array(*[F.lit(n) for n in short]), lambda n: n <= F.size("w"))
        runs = (rows.where(F.size("w") >= short[0]).select("key", F.explode(F.flatten(F.transform(lengths, of_length))).alias("x"))
                .select("key", "x.start", "x.length", "x.gram"))
        out = out.unionByName(runs.join(_hinted(grams.where(F.col("length") < window), small), ["length", "gram"])
                              .select("key", "start", "length", "gram_id"))
    return out


def _by_row(found: DataFrame) -> DataFrame:
    """One row per key: its hit stretches and the words they cover."""
    spans = F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end"))))
    per = found.groupBy("key").agg(spans.alias("stretches"))
    covered = F.aggregate(
        "stretches", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"),
                                (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n")),
        lambda acc: acc["n"])
    return per.select("key", "stretches", covered.alias("n_hit"))


def _items(found: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per key: the sorted ids of the items whose windows occur. The ids are
    joined to the distinct windows of a document, not carried with every hit."""
    return (found.select("key", "gram_id").distinct().join(owners, "gram_id")
            .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated``."""
    grams, owners = benchmark_windows(benchmark, window)
    found = store(hits(docs, grams, window, id_col=id_col, text_col=text_col), "benchmark-hits")
    per = store(_by_row(found).join(_items(found, owners), "key", "left"), "benchmark-rows")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_words = F.size(words_of(docs[text_col])).cast("long")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), n_words.alias("n_words"),
                       _key(docs[id_col], docs[text_col]).alias("key"))
    return (rows.join(per.select("key", "n_hit", "item_ids"), "key", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * MIN_SHARE_INVERSE >= F.col("n_words"))).alias("contaminated")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; all columns as they were."""
    grams, _ = benchmark_windows(benchmark, window)
    per = _by_row(hits(docs, grams, window, id_col=id_col, text_col=text_col))
    # the rule needs the word count: take it where there are hits only
    hit = store(per.select("key", "n_hit"), "benchmark-hits")
    key = _key(docs[id_col], docs[text_col]).alias("key")
    counted = docs.select(key, docs[text_col].alias("t")).join(small_side(hit, "benchmark-hit-keys"), "key")
    bad = (counted.where(F.col("n_hit") * MIN_SHARE_INVERSE >= F.size(words_of(F.col("t"))))
           .select("key").distinct())
    return nested(docs, key).join(small_side(bad, "benchmark-bad-keys"), "key", "left_anti").select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with every hit word cut out of the text (what stands between words stays)."""
    grams, _ = benchmark_windows(benchmark, window)
    per = small_side(_by_row(hits(docs, grams, window, id_col=id_col, text_col=text_col))
                     .select("key", "stretches"), "benchmark-stretches", row_bytes=80 + 24 * F.size("stretches"))
    anycase = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = F.col("doc")[text_col]
    words = F.regexp_extract_all(text, F.lit(f"({anycase})"), F.lit(1))
    gaps = F.split(text, anycase, -1)
    kept = F.transform(words, lambda w, i: F.when(F.exists("stretches", lambda h: (h["start"] <= i) & (i < h["end"])), "")
                       .otherwise(w))
    rebuilt = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), kept.alias("k")),
                                       lambda x: F.concat(x["g"], F.coalesce(x["k"], F.lit("")))), "")
    out = nested(docs, _key(docs[id_col], docs[text_col]).alias("key")).join(per, "key", "left")
    return out.select(*[F.when(F.col("stretches").isNotNull(), rebuilt).otherwise(text).alias(c) if c == text_col
                        else F.col("doc")[c].alias(c) for c in docs.columns])
