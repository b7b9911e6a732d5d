"""Token counts through a digest cache.

The cache is a table of (tokenizer digest, content digest, n_tokens). A corpus
is normalised and digested, its distinct digests that the cache lacks are
encoded once, their counts are appended, and every row takes its count from the
cache by an equality join on the digests.

Normalisation folds runs of space, tab, CR and LF into one space and trims
them: this tokenizer folds white space before it splits and drops it after, so
the count is the same. With ``fold_space=False`` (a tokenizer that keeps white
space) the content is taken as it is.

Where white space is folded the encoder remembers the count of every white-space
free run it has met: such a tokenizer takes runs independently of each other, so a
text's count is the sum over its runs. Otherwise texts are encoded whole.
A cache that several jobs appended the same texts to has repeated rows; a digest
counts once.

Defined results: a null text is the empty text (0 bytes, 0 tokens); repeated
rows each get their count; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import ready, store, text_of
from tabflow.session import scratch_path

TOKENIZER_FILE = "word_bpe_49k.json"
LIMIT = 2048
#: runs remembered by a worker at once, and the longest that is remembered
KNOWN_RUNS, KNOWN_CHARS = 400_000, 64
CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"
_COUNTERS: dict = {}


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its vocabulary file and of the library."""
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class RunCounter:
    """Counts tokens as the sum over a text's white-space free runs, or of texts as
    they are (``by_runs`` false)."""

    def __init__(self, path: str, by_runs: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.known: dict[str, int] = {}
        self.by_runs = by_runs

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_runs:
            return [len(enc) for enc in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        misses = list({r for runs in split for r in runs if r not in known})
        if len(known) + len(misses) > KNOWN_RUNS:
            known.clear()
            misses = list({r for runs in split for r in runs})
        extra: dict[str, int] = {}
        for i in range(0, len(misses), 4096):
            part = misses[i:i + 4096]
            for run, enc in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (known if len(run) <= KNOWN_CHARS else extra)[run] = len(enc)
        out = []
        for runs in split:
            out.append(sum([known[r] if r in known else extra[r] for r in runs]) if extra
                       else sum(map(known.__getitem__, runs)))
        return out


def _counter(path: str, by_runs: bool) -> RunCounter:
    if (path, by_runs) not in _COUNTERS:
        _COUNTERS[path, by_runs] = RunCounter(path, by_runs)
    return _COUNTERS[path, by_runs]


def normalised(text: Column, fold_space: bool = True) -> Column:
    t = text_of(text)
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " ")) if fold_space else t


def encode_misses(misses: DataFrame, path: str, version: str, by_runs: bool = True) -> DataFrame:
    """``(content, text)`` rows -> cache rows. One Arrow batch in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(path, by_runs)
        for batch in batches:
            texts = batch.column(1)
            counts: list[int] = []
            for i in range(0, len(texts), 256):
                counts += c.count(texts.slice(i, 256).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(texts), pa.string()), batch.column(0), pa.array(counts, pa.int64())],
                names=["tokenizer", "content", "n_tokens"])

    return misses.mapInArrow(run, CACHE_SCHEMA)


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The cached counts of one tokenizer version, one row a digest however many jobs
    appended it; empty where there is no cache yet."""
    from pyspark.errors import AnalysisException
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str | None = None, path: str | None = None, limit: int = LIMIT,
                 fold_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``cache_path`` names the cache table (shared storage; a new one in the
    scratch folder if not given). Texts are shuffled once, only those the cache
    lacks, and copies meet before the shuffle.
    """
    spark = ready(docs.sparkSession)
    path = path or tokenizer_path()
    version = tokenizer_digest(path)
    cache_path = cache_path or scratch_path(spark, "token-cache")
    text = text_of(docs[text_col])
    norm = normalised(docs[text_col], fold_space)
    content = F.sha2(norm, 256)
    texts = docs.select(content.alias("content"), norm.alias("text"))
    had = read_cache(spark, cache_path, version)
    wanted = texts if had.isEmpty() else texts.join(had.select("content"), "content", "left_anti")
    encode_misses(wanted.dropDuplicates(["content"]), path, version, fold_space).write.mode("append").parquet(cache_path)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       content.alias("content"))
    # one row a digest, written before the join: a text with many copies is then a plain
    # join key, which adaptive execution may split
    counts = store(read_cache(spark, cache_path, version), "token-counts")
    return (rows.join(counts, "content", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
