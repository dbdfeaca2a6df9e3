"""Vectors, conversations and the pipeline."""

import sys
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from placegraph.llm import chat, embeddings, queries, quality, rules

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle_check import compare, connect  # noqa: E402


def brute_vectors(rows, threshold=0.9):
    good = [(i, np.asarray(v, float)) for i, v in rows
            if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links, n = [], dict.fromkeys((i for i, _ in rows if i is not None), 0)
    for k, (i, x) in enumerate(good):
        for j, y in good[:k]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    root = brute.roots(n, links)
    return {i: (n[i], root[i], root[i] == i) for i in n}


def clusters(rng, dim, groups, each, spread):
    out = []
    for _ in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(each):
            e = rng.normal(size=dim)
            out.append((centre + spread * e / np.linalg.norm(e)).astype("f4").tolist())
    return out


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # many blocks to a cell
    rng = np.random.default_rng(1)
    vecs = clusters(rng, 64, 6, 12, 0.45) + clusters(rng, 64, 2, 30, 0.3) + clusters(rng, 7, 5, 6, 0.4)
    vecs += [vecs[0], vecs[0], [0.0] * 64, None, [], [1.0, None], [float("nan")] * 64, [float("inf")] + [0.0] * 63, [2.0 * x for x in vecs[3]]]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vecs)), vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit("x")).withColumn("label", F.lit(None).cast("int"))
    got = embeddings.near_duplicate_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)


def test_vectors_with_two_axes_to_a_cell(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CROWD", 1)
    rng = np.random.default_rng(2)
    rows = list(enumerate(clusters(rng, 32, 20, 8, 0.4)))
    assert embeddings.layout(len(rows), 64, 0.9)[0] == 2
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)


def test_vectors_without_rows_or_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    got = embeddings.near_duplicate_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[600:] = 0.9 * x[:600] + np.sqrt(1 - 0.81) * x[600:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor = embeddings.codes(x)
    signs = (np.unpackbits(code, axis=1) * 2.0 - 1) / 8
    est = ((embeddings.rotate(x[:600], 0) * signs[600:]).sum(axis=1)) / factor[600:]
    true = (x[:600] * x[600:]).sum(axis=1)
    assert abs((est - true).mean()) < 0.01
    a, b = embeddings.candidates(x.astype("f4"), code, factor, np.arange(600), np.arange(600, 1200), 0.85)
    want = set(zip(*np.nonzero(x[:600] @ x[600:].T >= 0.85)))
    assert want <= set(zip(a.tolist(), (b - 600).tolist())) and len(a) < 0.02 * 600 * 600


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name]) == []


def test_perspectives_of_a_round_table(spark):
    rows = [(1, 0, "system", "Be kind.", "x"), (1, 1, "Ann", "Hi <|end|>", "x"), (1, 2, "Bo", None, "x"), (1, 2, "Bo", None, "x"), (1, 3, "Cy", "Yes", "x"),
            (2, None, None, "alone", "x"), (None, 0, " ", "?", "x"), (3, 0, "system", "nobody", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size string")
    got = {}
    for r in chat.perspectives(df).collect():
        got.setdefault((r.conv_id, r.participant), []).append(r)
    assert set(got) == {(1, "Ann"), (1, "Bo"), (1, "Cy"), (2, "unknown"), (None, "unknown")}
    for (conv, who), parts in got.items():
        parts.sort(key=lambda r: r.start)
        text = "".join(r.segment for r in parts)
        assert [r.start for r in parts] == [0, *[r.end for r in parts[:-1]]] and len(text) == parts[-1].end
        learn = [text[r.learn_start : r.learn_end] for r in parts if r.learn_start >= 0]
        assert len(learn) == sum(r.speaker == who for r in parts) and all(x.endswith("<|end|>") for x in learn)
    text = "".join(r.segment for r in got[1, "Ann"])
    assert text == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi < |end|><|end|>\n<|user|>Bo\n<|end|>\n<|user|>Bo\n<|end|>\n<|user|>Cy\nYes<|end|>\n"
    assert chat.perspectives(df.limit(0)).count() == 0


def test_pipeline_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    bands = rules.Compression()
    left = [(r.doc_id, r.text) for r in docs.collect()]
    left = [(d, t) for d, t in left if model.score(t) >= 0.7]
    left = [(d, t) for d, t in left if rules.verdict(t, bands)[-1]]
    kept = {d for d, (_, _, k) in brute.near_duplicates(left, 5).items() if k}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == kept and 0 < len(kept) < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_on_messy_rows(spark, clashing, sf):
    rows = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == clashing.columns
    assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).columns[:3] == ["doc_id", "piece", "start"]
    empty = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
