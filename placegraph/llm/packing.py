"""Packing documents into fixed-length token sequences by best-two-fit.

Documents longer than a sequence are cut; all pieces are then packed by length.
Which documents of one length go where does not matter to the fill, so the packing
is planned on the histogram of lengths, at most ``capacity`` numbers at any corpus
size, and each planned sequence carries how often it is repeated. Pieces are ranked
within their length by a distributed numbering and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.llm.common import rank_in_groups, shuffle_width, slices
from placegraph.llm.tokens import encoder, vocabulary
from placegraph.session import materialise

CAPACITY = 2048
END = 0

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token pieces of every document: ids of the text, then ``end``; only longer documents are cut.

    Null and empty texts are one piece holding ``end`` alone. Repeated rows and
    null ids are kept as they come. Columns other than ``doc_id`` and ``text``
    are not read.
    """
    tail = np.array([end], "<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        enc = encoder(path)
        for ids, texts in slices(batches, "doc_id", "text"):
            rows = []
            for doc, raw in zip(ids, enc.encode(texts), strict=True):
                raw += tail
                for piece, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-two-fit over a histogram of lengths: ``(lengths in a sequence, repeats)``.

    A sequence is filled greedily with the longest pieces that fit. While room is
    left, its smallest piece gives way to the two unpacked pieces that fit the gap so
    widened most tightly, if they fill more than it did. The sequence is repeated as
    often as the counts allow. Each step uses up a length, so steps follow the number
    of lengths and not of documents.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    index = np.arange(capacity + 1)
    plan = []
    while count.any():
        left = count.copy()
        below = np.maximum.accumulate(np.where(left > 0, index, 0))
        inside, gap = [], capacity
        while gap and (size := int(below[gap])):
            k = min(int(left[size]), gap // size)
            if k == 0:
                below = np.maximum.accumulate(np.where(left > 0, index, 0))
                continue
            inside += [size] * k
            left[size] -= k
            gap -= k * size
        while gap:
            smallest = inside[-1]
            room = gap + smallest
            below = np.maximum.accumulate(np.where(left > 0, index, 0))
            first = index[1:room][left[1:room] > 0]
            second = below[room - first]
            alone = (second == first) & (left[second] < 2)
            second = np.where(alone, below[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if not len(total) or total.max() <= smallest:
                break
            a, b = int(first[total.argmax()]), int(second[total.argmax()])
            inside[-1:] = [a, b]
            inside.sort(reverse=True)
            left[smallest] += 1
            left[a] -= 1
            left[b] -= 1
            gap = room - a - b
        need = Counter(inside)
        times = min(int(count[s]) // n for s, n in need.items())
        for s, n in need.items():
            count[s] -= n * times
        plan.append((inside, times))
    return plan


@dataclass
class Lookup:
    """The plan by (length, rank): sorted starts and what a piece from each on gets."""

    start: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    #: Bits of a rank in the combined key: 10**12 pieces of one length, sequences of up to 8 million tokens.
    SHIFT = 40

    @classmethod
    def of(cls, plan: list[tuple[list[int], int]]) -> Lookup:
        used: Counter = Counter()
        rows, sequence = [], 0
        for inside, times in plan:
            offset = 0
            for size, n in Counter(inside).items():
                rows.append(((size << cls.SHIFT) + used[size], used[size], sequence, n, offset))
                used[size] += n * times
                offset += n * size
            sequence += times
        rows.sort()
        return cls(*(np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5)))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.start, (length << self.SHIFT) + rank, "right") - 1
        within = rank - self.rank[at]
        return self.sequence[at] + within // self.copies[at], self.offset[at] + within % self.copies[at] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    lookup = Lookup.of(plan_bins(counts, capacity))
    per_chunk = max(256, sum(counts.values()) // (4 * shuffle_width(pieces.sparkSession)))
    chunks = -(-max(counts.values(), default=1) // per_chunk)
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks))
    ranked = rank_in_groups(pieces, ["length"], spread, [F.col("doc_id"), F.col("piece")], "_rank")
    kept = [c for c in ranked.columns if c != "_rank"]
    names = [*kept, "sequence_id", "offset"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*kept).schema], "sequence_id bigint, offset bigint"])

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            placed = lookup.place(length, rank) if len(length) else (length, rank)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *map(pa.array, placed)], names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their place in sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. An
    empty table gives no rows; equal documents are packed each on its own.
    """
    pieces, _ = materialise(cut_pieces(docs, path or vocabulary("word_bpe_49k.json"), capacity))
    return pack(pieces, capacity)
