"""Byte-level BPE encoding and decoding with a local rank file.

Texts go through the public BPE library with the rank file's vocabulary. Long
texts are first cut at places where the split pattern has a piece boundary
whatever stands around it, so the ids are those of the whole text. Decoding
joins the raw bytes of the ids, never text, so every cut of the ids decodes.

Defined results: a null text is the empty text (0 tokens, the digests of the
empty string); rows repeat as they come; other columns are left out of the
result; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabflow.llm.common import ready, text_of

RANK_FILE = "byte_bpe_50k.tiktoken"
#: characters of a text above which it is cut before encoding (the ids do not change)
CUT_CHARS = 20_000
#: characters without any boundary above which the pieces are found without the
#: library's backtracking matcher
RUN_CHARS = 1_000_000
_CODECS: dict = {}


def rank_path(name: str = RANK_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the library's \s is Unicode white space; this module's is wider (control characters)
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # a cut before white space that follows another character, or between a letter
        # and a digit, is a piece boundary in any surroundings
        self.boundary = regex.compile(r"(?<=\P{White_Space})(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(size)]

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; long texts are cut where no piece can cross."""
        ids: list[int] = []
        start, n = 0, len(text)
        while n - start > CUT_CHARS:
            m = self.boundary.search(text, start + CUT_CHARS)
            if m is None:
                break
            ids += self._part(text[start:m.start()])
            start = m.start()
        return ids + self._part(text[start:])

    def _part(self, text: str) -> list[int]:
        if len(text) <= RUN_CHARS:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for m in self.pieces.finditer(text):
            ids += self.encoding._encode_single_piece(m.group())
        return ids

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


def codec(path: str, pattern: str | None = None) -> Codec:
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256`` and, on request, the ids themselves (``ids`` array<int>).

    No shuffle: every task encodes its own rows, one Arrow batch in memory.
    """
    ready(docs.sparkSession)
    path = path or rank_path()
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            counts, id_hash, raw_hash, kept = [], [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py())
                counts.append(len(ids))
                table = c.decimal
                id_hash.append(hashlib.sha256(" ".join([table[i] for i in ids]).encode()).hexdigest())
                raw_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, dtype=np.int32))
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
                   "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(raw_hash, pa.string())}
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return src.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the raw bytes of each row's ids; null for null
    ids or an id outside the vocabulary."""
    from pyspark.sql import functions as F
    ready(rows.sparkSession)
    path = path or rank_path()

    @F.pandas_udf("binary")
    def back(col):
        c = codec(path)
        n = len(c.bytes_of)
        return col.map(lambda ids: None if ids is None or any(i is None or not 0 <= i < n for i in ids)
                       else c.decode(ids))
    return rows.withColumn("decoded", back(F.col(ids_col)))
