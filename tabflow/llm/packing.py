"""Token packing: best-fit-decreasing into rows of a fixed number of ids.

Every text is encoded and cut without loss into segments of at most ``length`` ids.
The segments of the whole corpus are packed together by best fit decreasing: longest
first, each into the fullest row that still takes it, found in a segment tree over
the free capacities 0..length. The packing depends on the lengths alone, so it is
made from their histogram: the tree holds classes of equally filled rows, and a
class takes as many equal segments at once as best fit would give it one by one.
The plan is a short list of ranges (the k-th to the m-th segment of a length go to
consecutive rows, at a given place); no row of the plan stands for a single segment.

The workers number the segments of each length, with offsets from the counts of each
task, look up their rows in the plan, and one shuffle brings the segments of a row
together. The rows are written as binary matrices: ids, position ids that restart at
every segment, and cumulative segment lengths. Row lengths, fill and row count do not
depend on the layout of the input; which of the segments of equal length goes where
follows the stored order of the segments.

Defined results: a null or empty text is one segment of length 0 (it takes no
ids but is listed; such segments are dealt out evenly over the rows); repeated rows
are packed each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.byte_bpe import codec, rank_path
from tabflow.llm.common import ready, small_side, store, text_of

LENGTH = 2048
WINDOW_TOKENS = 1_000_000   # ids of finished rows that a task holds before it hands them on
SEGMENT_SCHEMA = "task int, size int, seq long, doc_id long, part int, ids binary"
ROW_SCHEMA = ("pack_id long, n_tokens int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, "
              "input_ids binary, position_ids binary")


class Capacities:
    """Open rows, or classes of them, by free capacity, with the smallest sufficient one
    found in a segment tree that counts the entries below each node."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list] = [[] for _ in range(length + 1)]

    def add(self, free: int, row) -> None:
        self.rows[free].append(row)
        i, count = free + self.size, self.count
        while i:
            count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple | None:
        """Removes and returns (free, row) of the fullest row with free >= need."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                if not count[i]:
                    i += 1
        free = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return free, self.rows[free].pop()


def plan(counts: dict[int, int], length: int) -> tuple[np.ndarray, int]:
    """Best fit decreasing of ``counts`` segments by length (above 0): the number of
    rows, and ranges ``(size, first, row, place, each)`` in the order of size and
    first: from the first-th segment of a size on, ``each`` of them go to every row
    from ``row`` on, at ``place`` and behind."""
    free, rows, out = Capacities(length), 0, []
    for size in sorted(counts, reverse=True):
        done, n = 0, counts[size]
        while done < n:
            got = free.take(size)
            if got is None:
                room, start, many = length, rows, -(-(n - done) // (length // size))
                rows += many
            else:
                room, (start, many) = got
            each = room // size
            now = min(n - done, many * each)
            out.append((size, done, start, length - room, each))
            full, rest = divmod(now, each)
            if full:
                free.add(room - each * size, (start, full))
            if rest:
                free.add(room - rest * size, (start + full, 1))
            if many > full + (rest > 0):
                free.add(room, (start + full + (rest > 0), many - full - (rest > 0)))
            done += now
    return np.array(sorted(out), np.int64).reshape(-1, 5), rows


def id_type(path: str) -> np.dtype:
    """Smallest unsigned type (little endian) that holds every id and the padding id."""
    return np.dtype("<u2") if len(codec(path).bytes_of) < 1 << 16 else np.dtype("<u4")


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of segment indexes by the plan, for lengths at hand."""
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_size.setdefault(n, []).append(i)
    empty = by_size.pop(0, [])
    ranges, n = plan({k: len(v) for k, v in by_size.items()}, length)
    rows: list[list[int]] = [[] for _ in range(max(n, bool(empty)))]
    for at, (size, first, row, _, each) in enumerate(ranges.tolist()):
        more = at + 1 < len(ranges) and ranges[at + 1, 0] == size
        for k, i in enumerate(by_size[size][first:int(ranges[at + 1, 1]) if more else None]):
            rows[row + k // each].append(i)
    for i in empty:
        rows[0].append(i)
    return rows


def segments(docs: DataFrame, path: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """The cut texts; ``seq`` numbers the segments of a size within a task."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text"))
    names = [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, kind = codec(path), id_type(path)
        task, seen = TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cols: list[list] = [[] for _ in names]
                for doc, text in zip(batch.column(0)[at:at + 512].to_pylist(), batch.column(1)[at:at + 512], strict=True):
                    ids = np.array(c.encode(text.as_py()), dtype=kind)
                    for part, a in enumerate(range(0, max(len(ids), 1), length)):
                        own = ids[a:a + length]
                        for col, v in zip(cols, (task, len(own), seen[len(own)], doc, part, own.tobytes()), strict=True):
                            col.append(v)
                        seen[len(own)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=names)

    return src.mapInArrow(run, SEGMENT_SCHEMA)


def _placed(cut: DataFrame, length: int) -> DataFrame:
    """``row, place`` of every segment, by the plan for all of them."""
    per_task = cut.groupBy("size", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(per_task.select("size", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "pack-offsets")
    counts = dict(cut.groupBy("size").count().collect())
    empty = counts.pop(0, 0)
    ranges, rows = plan(counts, length)
    rows = max(rows, -(-empty // length))  # nothing but empty texts: rows that list them
    spread = max(rows, 1)
    shared = cut.sparkSession.sparkContext.broadcast(ranges)
    schema = "row long, place int, size int, doc_id long, part int, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        first_of = {int(s): np.flatnonzero(table[:, 0] == s) for s in np.unique(table[:, 0])}
        for batch in batches:
            size, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, place = number % spread, np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                if s:
                    at, mine = np.flatnonzero(size == s), table[first_of[s]]
                    r = mine[np.searchsorted(mine[:, 1], number[at], side="right") - 1]
                    ahead = number[at] - r[:, 1]
                    row[at] = r[:, 2] + ahead // r[:, 4]
                    place[at] = r[:, 3] + ahead % r[:, 4] * s
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(place.astype(np.int32)), batch.column(0), *batch.columns[2:]],
                                             names=["row", "place", "size", "doc_id", "part", "ids"])

    return (cut.join(offsets, ["size", "task"]).select("size", (F.col("seq") + F.col("offset")).alias("number"), "doc_id", "part", "ids")
            .mapInArrow(run, schema))


def pack_texts(docs: DataFrame, path: str | None = None, length: int = LENGTH, window_tokens: int = WINDOW_TOKENS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows (``ROW_SCHEMA``). ``input_ids`` holds ``length`` ids, padded with
    the first id past the vocabulary; ``position_ids`` restarts at 0 with every
    segment and in the padding; ``doc_ids`` and ``parts`` name each segment's
    document and its place in it; segment k is ids ``cu_seqlens[k]`` up to
    ``cu_seqlens[k + 1]``. ``pack_id`` runs from 0 without gaps."""
    ready(docs.sparkSession)
    path = path or rank_path()
    names = [f.split()[0] for f in ROW_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        pad, steps = len(codec(path).bytes_of), np.arange(length, dtype=kind)
        cols: list[list] = [[] for _ in names]
        number, doc_ids, parts, ends = None, [], [], [0]
        ids, places = np.full(length, pad, dtype=kind), steps.copy()

        def finish() -> None:
            nonlocal doc_ids, parts, ends, ids, places
            places[ends[-1]:] = steps[:length - ends[-1]]
            for col, v in zip(cols, (number, ends[-1], doc_ids, parts, ends, ids.tobytes(), places.tobytes()), strict=True):
                col.append(v)
            doc_ids, parts, ends = [], [], [0]
            ids, places = np.full(length, pad, dtype=kind), steps.copy()

        def hand_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=names)
            for col in cols:
                col.clear()
            return batch

        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True)
            for (row, size, doc, part), own in zip(heads, batch.column(5), strict=True):
                if number is not None and row != number:
                    finish()
                    if len(cols[0]) * length >= window_tokens:
                        yield hand_on()
                number, a = row, ends[-1]
                ids[a:a + size] = np.frombuffer(own.as_py(), kind) if size else 0
                places[a:a + size] = steps[:size]
                doc_ids.append(doc)
                parts.append(part)
                ends.append(a + size)
        if number is not None:
            finish()
            yield hand_on()

    cut = store(segments(docs, path, length, id_col, text_col), "pack-segments")
    return _placed(cut, length).repartition("row").sortWithinPartitions("row", "place", "size").mapInArrow(run, ROW_SCHEMA)


def write_packed(docs: DataFrame, out: str, **options) -> DataFrame:
    """Packs ``docs`` and writes the matrices as a table at ``out``; returns it read back."""
    pack_texts(docs, **options).write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(ROW_SCHEMA).parquet(out)


def describe(packed: DataFrame) -> DataFrame:
    """One row per packed row: sizes, the documents in it and digests of its matrices."""
    return packed.select("pack_id", F.col("n_tokens").cast("long").alias("n_tokens"),
                         F.size("doc_ids").cast("long").alias("n_segments"), "doc_ids", "parts", "cu_seqlens",
                         F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))
