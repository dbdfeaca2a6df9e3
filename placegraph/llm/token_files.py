"""Token ids as flat unsigned integer files with 64-bit document offsets.

A data set is a folder of parts in ascending document order. Each part has three
little-endian files: ``.ids`` (unsigned 16- or 32-bit token ids, one document after
the other), ``.off`` (64-bit offsets into it, one more than documents) and ``.key``
(64-bit document ids). A part's base, the tokens of all parts before it, is a
prefix sum over the parts, so parts are written independently of each other.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placegraph.llm.common import shuffle_width, slices
from placegraph.llm.tokens import encoder, vocabulary
from placegraph.session import materialise, run_folder

END = 0
PARTS = "part int, path string, width int, n_docs bigint, n_null bigint, n_tokens bigint"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end: int = END) -> DataFrame:
    """Write all documents' ids and return the table of parts.

    Documents are range-partitioned and sorted by ``doc_id`` (null first; equal ids
    by a hash of the text). Null and empty texts hold ``end`` alone. A part is
    written under a temporary name and renamed, so a task run twice leaves one
    whole file. ``folder`` is by default a new one in the application's run folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{run_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        store = None
        part, files, enc = TaskContext.get().partitionId(), [], encoder(path)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        docs_n = nulls = tokens = 0
        for ids, texts in slices(batches, "doc_id", "text"):
            if store is None:
                store, at = _open(folder)
                store.create_dir(at, recursive=True)
                name, trial = f"{at}/part-{part:06d}", uuid.uuid4().hex
                files = [store.open_output_stream(f"{name}.{x}.{trial}") for x in ("ids", "off", "key")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            raw = [r + tail for r in enc.encode(texts)]
            files[0].write(np.frombuffer(b"".join(raw), "<u4").astype(kind).tobytes())
            files[1].write((tokens + np.cumsum([len(r) // 4 for r in raw])).astype("<i8").tobytes())
            files[2].write(np.array([-1 if i is None else i for i in ids], "<i8").tobytes())
            docs_n, nulls, tokens = docs_n + len(ids), nulls + sum(i is None for i in ids), tokens + sum(map(len, raw)) // 4
        for f, x in zip(files, ("ids", "off", "key")):
            f.close()
            store.move(f"{name}.{x}.{trial}", f"{name}.{x}")
        if files:
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/part-{part:06d}", "width": int(kind[2]), "n_docs": docs_n,
                                               "n_null": nulls, "n_tokens": tokens}],
                                             pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()),
                                                        ("n_null", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialise(dealt.mapInArrow(run, PARTS))[0]


def _mapped(store: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(parts: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of a written data set: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    ``start`` counts the tokens of all documents before; the checksum is over
    unsigned 32-bit ids whatever the width of the files. Files are memory-mapped
    where the folder is a local or mounted one, else read through its file system.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches):
        for batch in batches:
            for p in batch.to_pylist():
                store, path = _open(p["path"])
                ids, off, key = (_mapped(store, f"{path}.{x}", k) for x, k in (("ids", f"<u{p['width']}"), ("off", "<i8"), ("key", "<i8")))
                for at in range(0, p["n_docs"], 1024):
                    to = min(at + 1024, p["n_docs"])
                    docs = [None if i < p["n_null"] else int(key[i]) for i in range(at, to)]
                    spans = [np.asarray(ids[off[i] : off[i + 1]], "<u4") for i in range(at, to)]
                    out = [pa.array(docs, pa.int64()), pa.array(p["base"] + off[at:to], pa.int64()),
                           pa.array(np.diff(off[at : to + 1]), pa.int64()), pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64())]
                    if with_ids:
                        out.append(pa.array([s.astype(np.int64) for s in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return based.repartition(shuffle_width(parts.sparkSession), "part").mapInArrow(run, schema)


def token_file_round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write every document to token files and return what the files hold of each."""
    return read_tokens(write_tokens(docs, path or vocabulary("byte_bpe_50k.json")))
