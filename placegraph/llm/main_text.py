"""Main text of web pages by differencing each page with the page of nearest URL.

Pages are ordered by host and path segments; of a page's two neighbours in its host the
one that shares more of the path is its partner. The lines of both are aligned by their
longest common subsequence, and lines that the page shares with its partner are frame.

Two cases are decided before: what the markup itself names as frame is no line at all,
and the lines of an element that the markup declares to be the article stay, since
copies and repeated passages are text, not frame. A partner that is a near copy (eight
tenths of the page) proves nothing, so the other neighbour is taken, or else none.

Only hashes of lines travel for the comparison; texts are cut on a second reading.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.llm.common import slices
from placegraph.llm.html_lines import page_lines
from placegraph.operators.common import with_previous
from placegraph.session import discard, materialise

#: A partner that shares this part of a page's characters is a copy of it.
COPY = 0.8
#: Pages looked at in one window when neighbours meet.
CHUNK = 4096
#: Cells of an alignment that are kept for tracing back; larger ones are halved first.
CELLS = 1 << 27


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-case host (empty if there is none) and the path, its segments apart by U+0001."""
    text = (url or "").strip()
    _, found, rest = text.partition("://")
    if not found:
        rest = text[2:] if text.startswith("//") else ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].lower(), "\x01".join(s for s in path.split("/") if s)


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each item of ``a`` a number whose zero bits are the places of ``b`` that lengthen the common subsequence."""
    full = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    v, rows = full, []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    last = _rows_last(a, b)
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _rows_last(a: list[int], b: list[int]) -> int:
    full = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``, ascending."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [*range(head), *range(len(a) - tail, len(a))]
    left, right = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in right]
    x, y = [a[i] for i in at], [v for v in b[head : len(b) - tail] if v in left]
    if not x:
        return ends
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        split = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        inner = common_subsequence(x[:half], y[:split]) + [half + i for i in common_subsequence(x[half:], y[split:])]
    else:
        rows, i, j, inner = _rows(x, y), len(x), len(y), []
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                inner.append(i)
            elif rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return sorted([*ends, *(at[i] for i in inner)])


def nearer_first(path: str, before: str | None, after: str | None) -> list[int]:
    """Neighbours (0 before, 1 after; a null path is none) by shared leading segments, then shared leading characters."""
    def shared(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    told = [(-shared(path.split("\x01"), p.split("\x01")), -shared(path, p), k) for k, p in enumerate((before, after)) if p is not None]
    return [k for _, _, k in sorted(told)]


def shared_lines(lines: list[int], sizes: list[int], path: str, neighbours: list[tuple[str | None, list[int] | None]]) -> list[int]:
    """Places of a page's lines that it shares with its partner; none where every neighbour is a copy."""
    for k in nearer_first(path, *[p for p, _ in neighbours]):
        found = common_subsequence(lines, neighbours[k][1])
        if sum(sizes[i] for i in found) < COPY * sum(sizes):
            return found
    return []


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def read_pages(pages: DataFrame, texts: bool) -> DataFrame:
    """``host, path, content`` of each page with the hashes and sizes of its lines or, if ``texts``, its id, url, lines and levels."""
    columns = {"page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "path": pa.string(), "content": pa.int64()}
    columns |= {"lines": pa.list_(pa.string()), "levels": pa.list_(pa.int8())} if texts else {"lines": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32())}
    if not texts:
        columns = {k: v for k, v in columns.items() if k not in ("page_id", "url")}
    schema = pa.schema(list(columns.items()))

    def run(batches):
        for ids, urls, htmls in slices(batches, "page_id", "url", "html"):
            rows = []
            for i, url, html in zip(ids, urls, htmls):
                host, path = host_and_path(url)
                lines = page_lines(html)
                hashes = [_hash(t.encode("utf-8", "surrogatepass")) for t, _ in lines]
                row = {"page_id": i, "url": url, "host": host, "path": path, "content": _hash(np.array(hashes, np.int64).tobytes())}
                row |= {"lines": [t for t, _ in lines], "levels": [v for _, v in lines]} if texts else {"lines": hashes, "sizes": [len(t) for t, _ in lines]}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    types = {"page_id": "bigint", "url": "string", "host": "string", "path": "string", "content": "bigint", "levels": "array<tinyint>", "sizes": "array<int>",
             "lines": "array<string>" if texts else "array<bigint>"}
    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns))


def numbered_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 in the order of columns: sorted ranges are numbered in their tasks, then shifted by the ranges before."""
    def run(batches):
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            cols = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "_part", "_at"])
            at += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ranges, _ = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, _part int, _at bigint"))
    from pyspark.sql import Window

    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = ranges.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranges.join(bases, F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_base") + F.col("_at")).cast("bigint").alias(name))


def shared_with_neighbours(pages: DataFrame) -> DataFrame:
    """``host, path, content, shared``: places of lines that the pages of one path and content share with their partner, where there are any."""
    classes = read_pages(pages, texts=False).where("host <> ''").dropDuplicates(["host", "path", "content"])
    ordered, _ = materialise(numbered_in_order(classes, ["host", "path", "content"], "n").withColumn("m", -F.col("n")))
    seen = ["host", "path", "lines"]
    both = with_previous(with_previous(ordered, [], "n", seen, "p_", CHUNK), [], "m", seen, "f_", CHUNK)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                near = [(r[f"{s}path"], r[f"{s}lines"]) if r[f"{s}host"] == r["host"] else (None, None) for s in ("p_", "f_")]
                found = shared_lines(r["lines"], r["sizes"], r["path"], near)
                if found:
                    out.append({"host": r["host"], "path": r["path"], "content": r["content"], "shared": found})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("host", pa.string()), ("path", pa.string()), ("content", pa.int64()), ("shared", pa.list_(pa.int32()))]))

    found, _ = materialise(both.mapInArrow(run, "host string, path string, content bigint, shared array<int>"))
    discard(ordered)
    return found


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_lines, n_shared`` of every row of ``page_id, url, html``.

    ``text`` joins the lines of the article, else of the main element, else of the whole
    page by blank lines; outside articles without those shared with the partner.
    ``n_lines`` counts all unframed lines, ``n_shared`` those shared with the partner.
    A null or empty html has the empty text. A null url or one without a host has no
    partner, nor has the only page of a host. Repeated pages are one for pairing and
    each get their row. Other columns are ignored.
    """
    shared = shared_with_neighbours(pages)
    rows = read_pages(pages, texts=True).join(shared, ["host", "path", "content"], "left")
    top: Column = F.coalesce(F.array_max("levels"), F.lit(0).cast("tinyint"))
    places = F.sequence(F.lit(1), F.size("lines"))
    kept = F.when(F.size("lines") == 0, F.array().cast("array<string>")).otherwise(F.transform(
        F.filter(places, lambda k: (F.get("levels", k - 1) == top) & ((top == 2) | ~F.coalesce(F.array_contains("shared", k - 1), F.lit(False)))),
        lambda k: F.get("lines", k - 1)))
    out = rows.select("page_id", "url", F.array_join(kept, "\n\n").alias("text"), F.size("lines").alias("n_lines"), F.coalesce(F.size("shared"), F.lit(0)).alias("n_shared"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_shared")
