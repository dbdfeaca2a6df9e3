"""License scans by patience alignment.

Text and template are aligned on words that each holds once: the longest increasing
run of their positions anchors the alignment, and the gaps between anchors are
aligned the same way, where more words are unique. A template is found where the
aligned words cover enough of it.

A window of a text can only cover a template if it holds enough of the template's
words in any order. That count is kept along the text and rules out nearly all of it
exactly; alignments run where it does not.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.llm.common import slices
from placegraph.llm.license_texts import TEMPLATES

#: Per cent of a template's words that must be aligned.
COVERAGE = 80
#: A window is so many per cent of the template long, so that a notice may hold other words in between.
STRETCH = 130
#: A-Z lower-cased; ASCII other than letters and digits parts words; bytes beyond ASCII belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def fold(text: str | None) -> bytes:
    """UTF-8 of a text with its words parted by spaces; no byte moves."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, that also rises in the second (patience piles)."""
    tops, at, back = [], [], [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back[k] = at[pile - 1] if pile else -1
        tops[pile : pile + 1], at[pile : pile + 1] = [b], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Aligned positions ``(text, template)``, both rising: patience anchors, then the gaps between."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in place])
        if anchors:
            out += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, must: Sequence[str], text: str, coverage: int = COVERAGE):
        self.name, self.must = name, {w.encode() for w in must}
        self.words = fold(text).split()
        self.least = -(-coverage * len(self.words) // 100)
        self.width = -(-STRETCH * len(self.words) // 100)
        self.count = Counter(self.words)

    @cached_property
    def vocabulary(self) -> frozenset:
        return frozenset(self.count)

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """``(first, last + 1, aligned words)`` of each place in the words of a text, from left to right."""
        inside = np.fromiter((w in self.vocabulary for w in words), np.int64, len(words))
        total = np.concatenate(([0], np.cumsum(inside)))
        ends = np.minimum(np.arange(len(words)) + self.width, len(words))
        starts = np.flatnonzero((total[ends] - total[:-1] >= self.least) & (inside > 0))
        out, free = [], 0
        for at in starts.tolist():
            if at < free:
                continue
            part = words[at : at + self.width]
            if sum(min(n, self.count[w]) for w, n in Counter(part).items() if w in self.count) < self.least:
                continue
            pairs = align(part, self.words)
            if len(pairs) >= self.least and self.must <= {part[i] for i, _ in pairs}:
                free = at + pairs[-1][0] + 1
                out.append((at + pairs[0][0], free, len(pairs)))
        return out


class Scanner:
    """All templates; needs of each are looked up among a text's distinct words first."""

    def __init__(self, templates=TEMPLATES, coverage: int = COVERAGE):
        self.templates = [Template(*t, coverage=coverage) for t in templates]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
        """``(name, coverage, aligned words, first word, start, end)``, offsets in UTF-8 bytes.

        A place inside one with more aligned words of another template is left out.
        """
        raw = fold(text)
        words = raw.split()
        distinct = set(words)
        found = []
        for t in self.templates:
            if t.must <= distinct and sum(n for w, n in t.count.items() if w in distinct) >= t.least:
                found += [(n, -a, b, t) for a, b, n in t.find(words)]
        if not found:
            return []
        found.sort(key=lambda f: (-f[0], -f[1], f[2], f[3].name))
        kept = []
        for n, a, b, t in found:
            if not any(x <= -a and b <= y for x, y, _, _ in kept):
                kept.append((-a, b, n, t))
        spots = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
        return [(t.name, n / len(t.words), n, a, spots[a][0], spots[b - 1][1]) for a, b, n, t in sorted(kept, key=lambda k: (k[0], k[1]))]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, coverage: int = COVERAGE) -> DataFrame:
    """A row for each license found: ``doc_id, license, coverage, n_aligned, first_word, start_byte, end_byte``.

    Whole texts are scanned; null, empty and clean texts give no row. Repeated rows are
    scanned each. Other columns are not read.
    """
    names = ["doc_id", "license", "coverage", "n_aligned", "first_word", "start_byte", "end_byte"]
    types = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]

    def run(batches):
        scanner = Scanner(templates, coverage)
        for ids, texts in slices(batches, "doc_id", "text"):
            rows = [(d, *f) for d, t in zip(ids, texts, strict=True) for f in scanner.scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, coverage double, n_aligned bigint, first_word bigint, start_byte bigint, end_byte bigint")
