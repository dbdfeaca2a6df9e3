"""Quality rules: word counts, repeats, and bands of compression ratios.

Text of one kind compresses at a rate that its length largely decides. A ratio
above the band of its length means repetition or a narrow stock of characters,
below it noise. The bands hold for whole documents, for all full chunks pooled, and
for every fixed chunk on its own: a passage of noise or repetition that a long document
would dilute fills chunks of its own. One shorter than a chunk may still be diluted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegraph.llm.common import SLICE

#: Whole documents: up to so many UTF-8 bytes, lowest and highest ratio of a fair text.
#: Set on labelled documents with a margin over every fair one seen.
WHOLE = ((256, 1.05, 2.0), (512, 1.2, 2.0), (768, 1.33, 2.0), (1024, 1.42, 2.06), (2048, 1.53, 2.24), (4096, 1.68, 2.28), (8192, 1.8, 2.40),
         (16384, 1.95, 2.47), (32768, 2.05, 2.55), (65536, 2.1, 2.63), (None, 2.1, 2.70))
#: Full chunks pooled: up to so many chunks, lowest and highest ratio.
POOLED = ((1, 1.48, 2.04), (None, 1.54, 1.99))
#: Every full chunk, and the tail after the last one by its bytes: lowest and highest ratio. A tail of up to 64 bytes says nothing.
CHUNKS = ((64, 0.0, float("inf")), (128, 0.78, 1.55), (192, 0.98, 1.68), (256, 1.13, 1.76), (384, 1.2, 1.85), (512, 1.26, 1.95), (640, 1.34, 2.02),
          (768, 1.4, 2.1), (896, 1.45, 2.15), (1023, 1.48, 2.18), (None, 1.48, 2.2))
CHUNK = 1024
LEVEL = 3
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"

COLUMNS = (("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
           ("n_repeat_words", T.LongType()), ("whole_ratio", T.DoubleType()), ("chunk_ratio", T.DoubleType()), ("n_odd_chunks", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()))


def repeat_words(words: Sequence[bytes], width: int = 3) -> int:
    """Words standing in a run of ``width`` that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base, run = len(number), ids[:n]
    for k in range(1, width):  # numbers of distinct runs stay below the word count, so products stay exact
        if k > 1:
            run = np.unique(run, return_inverse=True)[1]
        run = run * base + ids[k : n + k]
    _, which, times = np.unique(run, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(times[which] > 1)
    edge[twice] += 1
    np.subtract.at(edge, twice + width, 1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines and repeated words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    space = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), len(text) - space, sum(raw.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words))


def _band(bands, size: int) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in bands if most is None or size <= most)


class Compression:
    """Ratios of a text and the verdict of the bands."""

    def __init__(self, whole=WHOLE, pooled=POOLED, chunk: int = CHUNK, level: int = LEVEL, chunks=CHUNKS):
        self.whole, self.pooled, self.chunks, self.chunk = whole, pooled, chunks, chunk
        self.squeeze = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def ratios(self, raw: bytes) -> tuple[float, float | None, int]:
        """Of the whole text, of its full chunks pooled, and how many chunks, the tail among them, are out of their band."""
        if not raw:
            return 0.0, None, 0
        parts = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        small = [len(self.squeeze(x)) for x in parts]
        whole, full = len(raw) / len(self.squeeze(raw)), len(raw) // self.chunk
        if not full:
            return whole, None, 0
        bands = [_band(self.chunks, len(x)) for x in parts]
        odd = sum(not lo <= len(x) / n <= hi for x, n, (lo, hi) in zip(parts, small, bands))
        return whole, full * self.chunk / sum(small[:full]), odd

    def fair(self, size: int, whole: float, pooled: float | None, odd: int) -> bool:
        lo, hi = _band(self.whole, size)
        if odd or not lo <= whole <= hi:
            return False
        if pooled is None:
            return True
        lo, hi = _band(self.pooled, size // self.chunk)
        return lo <= pooled <= hi


def verdict(text: str | None, bands: Compression) -> tuple:
    counts = base_counts(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    whole, pooled, odd = bands.ratios(raw)
    failed = counts[0] < LEAST_WORDS or 100 * counts[4] > 50 * counts[0]
    return (*counts, whole, pooled, odd, failed, not failed and bands.fair(len(raw), whole, pooled, odd))


def rule_columns(docs: DataFrame, keep_only: bool = False, whole=WHOLE, pooled=POOLED, chunks=CHUNKS) -> DataFrame:
    """All columns of ``docs`` and the rules' (earlier columns of those names are replaced).

    A null or empty text has zero counts, ratio 0 and fails the word count.
    With ``keep_only`` just the rows kept, with the columns they came with.
    """
    names = [n for n, _ in COLUMNS]
    given = [f for f in docs.schema.fields if keep_only or f.name not in names]
    schema = T.StructType(given if keep_only else [*given, *[T.StructField(n, t) for n, t in COLUMNS]])
    rows = docs if keep_only else docs.select(*[F.col(f"`{f.name}`") for f in given])
    at = rows.columns.index("text")

    def run(batches):
        bands = Compression(whole, pooled, chunks=chunks)
        types = (pa.int64(),) * 5 + (pa.float64(),) * 2 + (pa.int64(),) + (pa.bool_(),) * 2
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                cols = list(zip(*(verdict(t, bands) for t in part.column(at).to_pylist())))
                if keep_only:
                    yield part.filter(pa.array(cols[-1], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, t) for c, t in zip(cols, types)]], [*part.schema.names, *names])

    return rows.mapInArrow(run, schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, both ratios, the chunks out of their band, ``base_failed`` and ``kept`` of every row."""
    return rule_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")


def keep_fair(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged."""
    return rule_columns(docs, keep_only=True)
