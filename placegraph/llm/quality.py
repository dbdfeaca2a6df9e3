"""Text quality by supervised subword embeddings.

Words, word pairs and n-grams of characters inside words are hashed to rows of one table of
learned vectors, and so are two marks of repetition (a word said twice running, a run of three
words met before), which an average of n-gram vectors cannot see. A document is the sum of its averages over each of these kinds;
a softmax over two classes reads it. Vectors and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled documents.

To score, each table row is multiplied with the softmax once, so that a document
costs one number per feature. Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegraph.llm.common import SLICE, mix

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
#: Bounds of the training sample: rows, and bytes of a sampled text, 200 MB at the very most. It only bounds fitting.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 50_000
EPOCHS = 8
RATE = 0.25
ACCEPT = 0.7
#: Held-out rows have this remainder of crc32(doc_id) by FOLDS.
FOLDS, HELD_OUT = 4, 2

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Rows kept for marks: a word equal to the one before, and a run of three words met before in the text.
_SAME, _AGAIN = 0, 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and its inverse, grown to the longest text met."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(4096, 2 * n)
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(40)) % np.uint64(BUCKETS - 2) + np.uint64(2)


def features(text: str | None) -> list[tuple[np.ndarray, float]]:
    """Table rows of a text by kind, each with the weight of one occurrence. None for texts without words."""
    raw = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), "<u4")  # one number a character
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return []
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    codes = np.where(space, np.uint32(32), raw).astype(np.uint64) + np.uint64(1)
    up, down = _Powers.of(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * down[:-1], dtype=np.uint64)))
    words = (total[ends] - total[starts]) * up[ends]
    out = [(_bucket(words), 1 / len(words))]
    if len(words) > 1:
        pairs = mix(words[:-1]) * np.uint64(3) + words[1:]
        out.append((_bucket(pairs), 1 / len(pairs)))
        same = int((words[1:] == words[:-1]).sum())
        again = 0
        if len(words) > 2:
            runs = mix(pairs[:-1]) + words[2:]
            again = len(runs) - len(np.unique(runs))
        out.append((np.repeat(np.array([_SAME, _AGAIN], np.uint64), [same, again]), 1 / len(words)))
    inside = np.concatenate((np.zeros(1, np.int64), np.cumsum(space)))
    for n in GRAMS:
        if len(raw) < n:
            continue
        at = np.flatnonzero(inside[n - 1 : len(raw)] - inside[1 : len(raw) - n + 2] == 0)  # white space only at the ends
        grams = (total[at + n] - total[at]) * up[at + n] + np.uint64(n)
        out.append((_bucket(grams), 1 / (len(GRAMS) * max(1, len(at)))))
    return out


def _sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    found = features(text)
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    rows = np.concatenate([r for r, _ in found]).astype(np.int64)
    weights = np.concatenate([np.full(len(r), w) for r, w in found])
    distinct, where = np.unique(rows, return_inverse=True)
    return distinct.astype(np.int32), np.bincount(where, weights).astype(np.float32)


@dataclass
class Model:
    """The difference of the two logits: one number per table row, and what texts without features get."""

    row: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * float(self.row[r.astype(np.int64)].sum()) for r, w in features(text))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on texts labelled 0 or 1. With one class only, every text scores that class; with no text, 1."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -40.0 if 0 in labels else 40.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.1 / DIM, 0.1 / DIM, (BUCKETS, DIM))
    out = rng.normal(0, 0.5, (DIM, 2))
    bias = np.log(np.bincount(labels, minlength=2) / len(labels))
    docs = [_sparse(t) for t in texts]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(docs)):
            rows, w = docs[i]
            if not len(rows):
                continue
            vec = w @ table[rows]
            z = vec @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * 0.2 * np.outer(vec, p)
            bias -= rate * 0.02 * p
            table[rows] -= rate / (w @ w) * w[:, None] * back[None, :]
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def in_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on at most ``rows`` labelled documents outside the held-out fold, of at most ``most_bytes`` bytes each.

    The sample is the labelled ids of lowest hash, so it is the same at every run; it
    and its texts are what reaches the driver. Labels other than 0 and 1 are not used.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~in_held_out(F.col("doc_id")))
    ids = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sample = ids.orderBy(F.xxhash64("doc_id")).limit(rows)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= most_bytes)
    got = found.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("r"))
    data = sorted((r["doc_id"], r["r"]["text"], r["r"]["quality"]) for r in got.collect())
    return train([t for _, t, _ in data], [q for _, _, q in data])


def with_score(docs: DataFrame, model: Model, name: str = "score", accept: float | None = None) -> DataFrame:
    """``docs`` with the score of every row; with ``accept``, only the rows that reach it, columns unchanged."""
    given = [f for f in docs.schema.fields if accept is not None or f.name != name]
    schema = T.StructType(given if accept is not None else [*given, T.StructField(name, T.DoubleType())])
    rows = docs if accept is not None else docs.select(*[F.col(f"`{f.name}`") for f in given])
    at = rows.columns.index("text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                scores = [model.score(t) for t in part.column(at).to_pylist()]
                if accept is not None:
                    yield part.filter(pa.array([s >= accept for s in scores], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, name])

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts score by the bias alone; a null id is never held out.
    Repeated rows score alike. Other columns are not read.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(rows, model)
    return scored.select("doc_id", F.coalesce(in_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, columns unchanged."""
    return with_score(docs, fit(docs, labels), accept=accept)
