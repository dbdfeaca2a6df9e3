"""Near-duplicate documents by one-permutation MinHash.

One hash of each shingle fills ``BANDS * ROWS`` bins at once; empty bins borrow from
full ones by optimal densification, so short texts collide with the right chance
too. Runs of ``ROWS`` bins are bands; documents that agree on a band share a bucket.

Texts with equal shingle sets are one class from the start. In each bucket a star
joins one class with the others; pairs are confirmed on their full sets. As classes
link up, stars are drawn again from classes that their bucket's others do not reach
yet. When stars stop linking, what is left in a bucket unlinked is compared block
against block inside the tasks: by signatures first and, where these leave a chance,
on full sets, in the first bucket that a pair shares. Only links that join classes
not joined in the task before come out. So every pair of a bucket is linked, told
apart on its full sets, or too unlike in all bins together, and a group of copies
never turns into all its pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegraph.llm.common import SLICE, WordHashes, components, mix, shingle_hashes, slices, smallest_reachable, words_of
from placegraph.session import materialise

#: A pair at similarity 0.8 misses all bands with chance (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
SHINGLE, SIMILARITY = 5, 80
#: Share of agreeing bins below which a pair is taken to be under the threshold: seven
#: standard deviations of a count of independent bins under it (5.8 of those measured on short sets).
SLACK = 7.0
#: Shares that the rows of a bucket of several blocks are dealt to before they are copied to their blocks.
SALT = 32
#: Classes, and shingles of their sets, in a block; larger blocks copy the classes of a bucket to fewer tasks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Bytes of each shingle hash in a full set.
PACKED = 6
#: Stars are drawn while at least this share of their pairs links.
WORTH = 0.1


@lru_cache(maxsize=256)
def _probes(step: int) -> np.ndarray:
    """For each bin, the bins it tries to borrow from in attempts ``64 * step`` and on."""
    attempt, bin_ = np.meshgrid(np.arange(64, dtype=np.uint64) + np.uint64(64 * step), np.arange(BINS, dtype=np.uint64), indexing="ij")
    return (mix(attempt * np.uint64(BINS) + bin_ + np.uint64(0x51ED27)) % np.uint64(BINS)).astype(np.int64)


def signature(distinct: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted distinct 64-bit hashes, densified; not for empty sets."""
    bins = ((distinct >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    filled = bins[first].astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    out[filled] = distinct[first]
    if len(filled) == 1:
        out[:] = distinct[0]
    elif len(filled) < BINS:
        full = np.zeros(BINS, bool)
        full[filled] = True
        empty, step = np.flatnonzero(~full), 0
        while len(empty):
            tries = _probes(step)[:, empty]
            hit = full[tries]
            found = hit.any(axis=0)
            source = tries[hit.argmax(axis=0), np.arange(len(empty))]
            out[empty[found]] = out[source[found]]
            empty, step = empty[~found], step + 1
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in sig.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def shingle_set(hashes: WordHashes, text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, its A-Z lower-cased."""
    return np.unique(shingle_hashes(hashes.of([w.lower() for w in words_of(text)]), width))


def pack(distinct: np.ndarray) -> bytes:
    """A full set as its sorted 48-bit hashes; two of a thousand words meet by chance once in 10**8 pairs."""
    return distinct.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def unpack(members: bytes) -> np.ndarray:
    short = np.frombuffer(members, np.uint8).reshape(-1, PACKED)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, 8 - PACKED :] = short
    return wide.view(">u8").ravel().astype(np.uint64)


def alike(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similarity * (len(x) + len(y) - both)


def _class_id(distinct: np.ndarray) -> int:
    both = np.array([np.bitwise_xor.reduce(mix(distinct + np.uint64(7))), distinct.sum(dtype=np.uint64)])
    return int(mix(both[:1] + both[1:]).view(np.int64)[0])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, cid, bands, sketch`` of each document; ``cid`` names its shingle set."""

    def run(batches):
        hashes = WordHashes()
        for ids, texts in slices(batches, "doc_id", "text"):
            n, cid, bands, sketch = [], [], [], []
            for doc, text in zip(ids, texts, strict=True):
                s = shingle_set(hashes, text, width)
                n.append(len(s))
                if doc is None or not len(s):
                    cid.append(None), bands.append(None), sketch.append(None)
                    continue
                sig = signature(s)
                cid.append(_class_id(s)), bands.append(band_keys(sig)), sketch.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "cid", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, cid bigint, bands array<bigint>, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the classes in ``wanted`` (``cid, doc_id``), one row each."""

    def run(batches):
        hashes = WordHashes()
        for cids, texts in slices(batches, "cid", "text"):
            found = [shingle_set(hashes, t, width) for t in texts]
            own = [i for i, (c, s) in enumerate(zip(cids, found)) if c == _class_id(s)]
            yield pa.RecordBatch.from_arrays([pa.array([cids[i] for i in own], pa.int64()), pa.array([pack(found[i]) for i in own], pa.binary())], ["cid", "members"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id")
    return rows.select("cid", "text").mapInArrow(run, "cid bigint, members binary").groupBy("cid").agg(F.min("members").alias("members"))


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``a, b`` with ``100 * |intersection| >= similarity * |union|`` on the full sets."""

    def run(batches):
        for batch in batches:
            sets = zip(batch.column("a_set"), batch.column("b_set"))
            keep = [alike(unpack(x.as_py()), unpack(y.as_py()), similarity) for x, y in sets]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("members").alias("a_set"))
    right = sets.select(F.col("cid").alias("b"), F.col("members").alias("b_set"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a bigint, b bigint")


def _alike_in_size(x: str, y: str, similarity: int):
    return F.expr(f"100 * least({x}, {y}) >= {similarity} * greatest({x}, {y})")


def _stars(active: DataFrame, turn: int, similarity: int) -> DataFrame:
    """Distinct pairs of one class of each bucket with those of the bucket it is not linked to."""
    order = F.struct("root", F.xxhash64("cid", F.lit(turn))) if turn else F.struct(-F.col("cid"))
    centre = active.groupBy("key").agg(F.max_by(F.struct("cid", "root", "n"), order).alias("c"))
    pairs = active.join(centre, "key").where("root <> c.root").where(_alike_in_size("n", "c.n", similarity))
    return pairs.select(F.least("cid", "c.cid").alias("a"), F.greatest("cid", "c.cid").alias("b")).distinct()


def _rest(active: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links ``a, b`` left to find in buckets: of each block pair, those that join classes not joined in it before."""
    j = similarity / 100
    least = (j - SLACK * (j * (1 - j) / BINS) ** 0.5) * BINS
    sizes = active.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    # Only buckets of several blocks are looked up, each share of their rows apart, so that none is in one task.
    large = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = active.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALT)).cast("int")).join(large, ["key", "salt"], "left").drop("salt")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    load = classes.select("cid", "sketch", "bands").join(sets, "cid")
    task = dealt.select("cid", "root", "n", "own", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(load, "cid")

    def compare(pdf):
        import pandas as pd

        n, own, cid = (pdf[c].to_numpy() for c in ("n", "own", "cid"))
        sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, BINS)
        bands, members, full = np.stack(pdf["bands"]), pdf["members"].to_numpy(), {}
        band, apart = int((bands[0] == pdf["key"].iloc[0]).argmax()), pdf["i"].iloc[0] != pdf["j"].iloc[0]
        _, group = np.unique(pdf["root"].to_numpy(), return_inverse=True)

        def whole(k):
            if k not in full:
                full[k] = unpack(members[k])
            return full[k]

        out = []
        for at in range(len(pdf)):
            ok = (group != group[at]) & (100 * np.minimum(n, n[at]) >= similarity * np.maximum(n, n[at]))
            ok[: at + 1] = False
            if apart:
                ok &= own != own[at]
            idx = np.flatnonzero(ok)
            idx = idx[(sk[idx] == sk[at]).sum(axis=1) >= least]
            idx = idx[(bands[idx] == bands[at]).argmax(axis=1) == band]
            for k in idx.tolist():
                if group[k] != group[at] and alike(whole(at), whole(k), similarity):
                    out.append((cid[at], cid[k]))
                    group[group == group[k]] = group[at]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return task.groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def _resolve(docs: DataFrame, width: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, cid`` of each row, and ``cid, rep, component, root`` of each class: its smallest id, the smallest reachable, and what its component is called."""
    sig, _ = materialise(signatures(docs, width))
    lead = F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("l")
    classes, _ = materialise(sig.where("cid IS NOT NULL").groupBy("cid").agg(lead).select(
        "cid", F.col("l.doc_id").alias("rep"), F.col("l.n_shingles").alias("n"), F.col("l.bands").alias("bands"), F.col("l.sketch").alias("sketch")))
    rows = classes.select("cid", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("key")
    members, seen = materialise(rows.join(shared, "key"))
    roots = links = None
    if seen["rows"]:
        wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"))
        sets, _ = materialise(_sets(docs, wanted, width))
        turn, stars = 0, True
        active = members.withColumn("root", F.col("cid"))
        while True:
            if stars:
                pairs, tried = materialise(_stars(active, turn, similarity))
                found, linked = materialise(_confirm(pairs, sets, similarity))
            else:
                found, linked = materialise(_rest(active, classes, sets, similarity))
            if linked["rows"]:
                links = found if links is None else links.unionByName(found)
                roots, _ = materialise(components(links))
            if not stars:
                break
            stars = linked["rows"] >= max(1, WORTH * tried["rows"])
            turn += 1
            if roots is not None:
                now = members.join(roots, members["cid"] == roots["node"], "left").select("key", "cid", "n", F.coalesce("root", "cid").alias("root"))
                open_ = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
                active, left = materialise(now.join(open_, "key"))
                if not left["rows"]:
                    break
    own = smallest_reachable(classes.select("cid", "rep"), roots).join(classes.select("cid", "rep"), "cid")
    if roots is None:
        own = own.withColumn("root", F.col("cid"))
    else:
        own = own.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    own, _ = materialise(own)
    return sig.select("doc_id", "n_shingles", "cid"), own


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Component and kept document of every row: ``doc_id, n_shingles, component_id, kept``.

    A text's set holds its distinct runs of ``width`` words (the whole sequence if it
    has fewer), A-Z lower-cased. Documents link at ``similarity`` per cent of Jaccard
    or more; ``component_id`` is the smallest ``doc_id`` reachable and that document is
    kept. Texts without words link with nothing and are kept. Rows with a null id
    link with nothing, have a null component and are kept. Repeated rows are one
    document and each come back. Columns other than ``doc_id`` and ``text`` are not read.
    """
    sig, own = _resolve(docs, width, similarity)
    out = sig.join(own.select("cid", "component"), "cid", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def with_class(docs: DataFrame, width: int, name: str) -> DataFrame:
    """``docs`` with the name of each text's shingle set in a new last column; null for texts without words."""
    at = docs.columns.index("text")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                found = [shingle_set(hashes, t, width) for t in part.column(at).to_pylist()]
                cid = pa.array([_class_id(s) if len(s) else None for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, cid], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component, columns unchanged.

    It is the one of the smallest id; where several texts of a component have that id,
    the one whose shingle set has the smallest name. An id may stand for several texts: each
    is judged by itself, and only rows equal in id and text are merged. Rows with a
    null id and texts without words stay.
    """
    sig, own = _resolve(docs, width, similarity)
    stay = own.where("rep = component").groupBy("root", F.col("component").alias("doc_id")).agg(F.min("cid").alias("cid")).drop("root")
    gone = sig.where("cid IS NOT NULL").select("doc_id", "cid").join(stay, ["doc_id", "cid"], "left_anti").select("doc_id").distinct()
    twice, n = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if not n["rows"]:
        return left
    name = "_".join(["", *docs.columns])  # no column of the table has it
    rows = with_class(docs.join(twice, "doc_id", "left_semi").select(docs.columns), width, name)
    stay = stay.select(F.col("doc_id").alias(name + "d"), F.col("cid").alias(name + "c"))
    kept = rows.join(stay, (F.col("doc_id") == F.col(name + "d")) & (F.col(name) == F.col(name + "c")), "left")
    kept = kept.where(F.col(name).isNull() | F.col(name + "c").isNotNull()).select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(kept.select(docs.columns))


#: The two-word case in SQL, by counting the shingles that documents share.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r ]+'),
                             lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id, d.doc_id = d.component_id AS kept
FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) d LEFT JOIN n ON n.doc_id = d.doc_id
"""
