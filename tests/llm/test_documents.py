"""Operators on documents against plain versions, and on messy rows."""

import base64
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from placegraph.llm import licenses, minhash, packing, pieces, quality, queries, rules, sharding, token_files
from placegraph.llm.tokens import Encoder, vocabulary


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def encoders():
    return {n: Encoder(vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def library_ids(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


# near-duplicates


def test_near_duplicates_match_brute_force(spark, sf):
    rows = texts_of(spark.read.parquet(f"{sf}/documents.parquet"))
    want = brute.near_duplicates(rows, 2)
    got = queries.QUERIES["op1_minhash_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("block", [minhash.BLOCK, 7])
def test_chains_and_mixed_buckets(spark, monkeypatch, block):
    """Links that do not pass through a bucket's first class: chains of texts and groups that share a passage."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    fresh = lambda n: ["t%d" % rng.randrange(10**6) for _ in range(n)]
    rows, base = [], fresh(200)
    for i in range(40):
        rows.append((i, " ".join(base)))
        base = base[6:] + fresh(6)
    passage = fresh(120)
    rows += [(100 + i, " ".join(passage + fresh(70))) for i in range(60)]
    rows += [(200 + i, " ".join(passage + fresh(20))) for i in range(30)]
    rows += [(300 + i, " ".join(passage + fresh(9 + i % 6))) for i in range(40)]
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(rows, 2)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, same in ((5, 4), (30, 27), (2000, 1778)):
        agree = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[:same], pool[n : 2 * n - same])))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - same / (2 * n - same)) < 0.07


def test_no_text_is_lost_where_an_id_stands_for_several(spark):
    rng = random.Random(8)
    text = lambda: " ".join("t%d" % rng.randrange(10**6) for _ in range(60))
    a, b, c, near = text(), text(), text(), None
    near = " ".join(c.split()[:-1] + ["other"])  # a near copy of c
    drop = lambda rows: sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert drop([(1, a), (2, a), (2, b), (3, b)]) == [(1, a), (2, b)]
    assert drop([(5, a), (5, b)]) == sorted([(5, a), (5, b)])
    assert drop([(5, a), (5, a), (5, b), (4, b), (7, "")]) == sorted([(4, b), (5, a), (7, "")])
    left = drop([(5, c), (5, near), (6, c), (9, near), (9, a)])
    assert len(left) == 2 and left[0][0] == 5 and left[0][1] in (c, near) and left[1] == (9, a)


def test_near_duplicates_on_messy_rows(messy, clashing):
    got = minhash.near_duplicates(clashing, width=2).collect()
    assert len(got) == messy.count()
    want = brute.near_duplicates([r for r in set(texts_of(messy)) if r[0] is not None], 2)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (want[r.doc_id] if r.doc_id is not None else (r.n_shingles, None, True))
    left = minhash.drop_near_duplicates(clashing)
    assert left.columns == clashing.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert ids.count(7) <= 1 and ids.count(None) == 2 and {0, 1, 2, 3, 17} <= set(ids)
    assert minhash.near_duplicates(messy.limit(0)).count() == 0 and minhash.drop_near_duplicates(messy.limit(0)).count() == 0


# tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(encoders, messy, docs, name):
    enc = encoders[name]
    texts = [t for _, t in texts_of(messy)] + [t for _, t in texts_of(docs)][:60] + [
        " a  b\n\n c\tD ", "x y z　", "á ́b 'S it's\n\n", "\x1c a\x1cb <|endoftext|> <|startoftext|>", "J̌ İ İx", "\n", "a.\nb,\n\nc."]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [library_ids(enc, t) for t in texts]


def check_packing(rows, texts, enc, capacity):
    want = Counter()
    for d, t in texts:
        ids = [*library_ids(enc, t), 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want[d, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= capacity
    return by


def test_packing(docs, messy, clashing, encoders):
    enc = encoders["word_bpe_49k.json"]
    rows = packing.pack_documents(docs).collect()
    by = check_packing(rows, texts_of(docs), enc, 2048)
    assert len(by) <= 1 + -(-sum(r.length for r in rows) // 2048)
    check_packing(packing.pack_documents(clashing, capacity=64).collect(), texts_of(messy), enc, 64)
    assert packing.pack_documents(messy.limit(0)).count() == 0


def test_plan_swaps_the_smallest_for_two():
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.randrange(1, 60)
        histogram = {rng.randrange(1, cap + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))}
        used = Counter()
        for inside, times in packing.plan_bins(histogram, cap):
            assert sum(inside) <= cap and times > 0
            for s in inside:
                used[s] += times
        assert used == Counter(histogram)


def test_token_files(spark, docs, messy, clashing, encoders):
    enc = encoders["byte_bpe_50k.json"]
    for df, texts in ((docs, texts_of(docs)), (clashing, texts_of(messy))):
        rows = sorted(token_files.token_file_round_trip(spark, df).collect(), key=lambda r: r.start)
        want = Counter((d, zlib.crc32(np.array([*library_ids(enc, t), 0], "<u4").tobytes())) for d, t in texts)
        assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    parts = token_files.write_tokens(docs, vocabulary("byte_bpe_50k.json"))
    whole = {r.doc_id: r.ids for r in token_files.read_tokens(parts, with_ids=True).collect()}
    assert all(whole[d] == [*library_ids(enc, t), 0] for d, t in texts_of(docs)[:40])
    assert token_files.token_file_round_trip(spark, messy.limit(0)).count() == 0


def test_pieces_equal_the_library_as_unigram_model(docs, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)  # the library adds in single precision
    (tmp_path / "m").write_bytes(m.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m")), pieces.Pieces(str(tmp_path / "m"))
    texts = [t[:300] for _, t in texts_of(docs)] + ["  a  b\nc ", " ", "é中\U0001f600 z\x00q", "a\tb  ", "x▁y", "\x00 \x00a"]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == library.encode(texts)


def test_registered_digests_of_whole_texts(spark, sf, docs, tmp_path):
    """``n_pieces`` and ``ids_crc32`` of every whole text by the library, 40 words at a time, since it adds in single precision."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    (tmp_path / "m").write_bytes(m.SerializeToString())
    library, want = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m")), {}
    for d, t in texts_of(docs):
        words = (t or "").split(" ")
        ids = [i for at in range(0, len(words), 40) for i in library.encode(" ".join(words[at : at + 40]))]
        want[d] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    got = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in queries.QUERIES["op2_sentencepiece_viterbi"](spark, sf).collect()}
    assert got == want


def test_pieces_round_trip(messy, clashing):
    rows = pieces.piece_digests(clashing).collect()
    assert len(rows) == messy.count() and all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(messy)).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in texts_of(messy) if d is not None)
    assert pieces.piece_digests(messy.limit(0)).count() == 0


# quality


def test_rule_counts_and_bands(messy, clashing, docs):
    for df, texts in ((docs, texts_of(docs)), (clashing, texts_of(messy))):
        got = rules.quality_rules(df).collect()
        assert len(got) == len(texts)
        want = {d: brute.rule_counts(t) for d, t in texts if d is not None}
        for r in got:
            if r.doc_id is not None:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = rules.keep_fair(clashing)
    assert kept.columns == clashing.columns and rules.keep_fair(messy.limit(0)).count() == 0


def test_bands_reject_repetition_and_noise():
    rng = random.Random(2)
    letters = "".join(map(chr, range(33, 127)))
    bands = rules.Compression()
    noise = " ".join("".join(rng.choice(letters) for _ in range(8)) for _ in range(400))
    stock = " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(3000))
    assert not rules.verdict(noise, bands)[-1] and not rules.verdict(stock, bands)[-1]


def test_bands_reject_a_bad_passage_in_the_middle(docs):
    rng, bands = random.Random(5), rules.Compression()
    fair = [t for _, t in texts_of(docs) if t and 2000 <= len(t) <= 40_000 and rules.verdict(t, bands)[-1]]
    assert len(fair) >= 20
    for text in fair:
        middle = len(text) // 2
        for share in (0.25, 0.5, 0.7):
            noise = base64.b64encode(rng.randbytes(int(len(text) * share / (1 - share)))).decode()
            assert not rules.verdict(f"{text[:middle]} {noise} {text[middle:]}", bands)[-1]
        again = text[:60] * 40
        got = rules.verdict(f"{text[:middle]} {again} {text[middle:]}", bands)
        assert not got[-1] and got[7] > 0
        assert rules.verdict(text, bands)[7] == 0


def test_bands_reject_a_bad_tail(docs):
    rng, bands = random.Random(6), rules.Compression()
    tried = 0
    for _, text in texts_of(docs):
        if text and text.isascii() and len(text) >= 6144 and rules.verdict(text, bands)[-1]:
            cut = text[:5120]
            if rules.verdict(cut, bands)[-1]:
                tried += 1
                for n in (300, 600, 1000):
                    assert not rules.verdict(cut + base64.b64encode(rng.randbytes(n)).decode()[:n], bands)[-1]
    assert tried


def test_repeat_words_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40)))
        assert rules.base_counts(text) == brute.rule_counts(text)


def test_classifier(docs, labels, messy, clashing, spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out for d in held) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    rows = quality.score_documents(clashing, labels).collect()
    assert len(rows) == messy.count()
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    none = labels.limit(0)
    assert all(r.score == 1.0 for r in quality.score_documents(messy, none).collect())
    assert quality.score_documents(messy.limit(0), labels).count() == 0


def plain_score(text, row, bias):
    """A score from the words and characters of a text, one feature at a time, in whole numbers of 64 bits."""
    low = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & low
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & low
        return x ^ x >> 31

    def hashed(chars):
        h = 0
        for c in chars:
            h = (h + ord(c) + 1) * quality._BASE & low
        return h

    at = lambda h: float(row[(mixed(h) >> 40) % (quality.BUCKETS - 2) + 2])
    words = brute.WORD.findall(text or "")
    if not words:
        return 1 / (1 + np.exp(-bias))
    ids = [hashed(w) for w in words]
    pairs = [(mixed(a) * 3 + b) & low for a, b in zip(ids, ids[1:])]
    runs = [(mixed(p) + c) & low for p, c in zip(pairs, ids[2:])]
    z = bias + sum(map(at, ids)) / len(ids)
    if pairs:
        z += sum(map(at, pairs)) / len(pairs)
        z += (float(row[0]) * sum(a == b for a, b in zip(ids, ids[1:])) + float(row[1]) * (len(runs) - len(set(runs)))) / len(ids)
    spaced = re.sub(r"[\x20\x09-\x0D]", " ", f" {text} ")
    for n in quality.GRAMS:
        grams = [spaced[i : i + n] for i in range(len(spaced) - n + 1)]
        grams = [at((hashed(g) + n) & low) for g in grams if " " not in g[1:-1]]
        z += sum(grams) / (len(quality.GRAMS) * max(1, len(grams)))
    return 1 / (1 + np.exp(-min(max(z, -40), 40)))


def test_scores_of_a_table_by_a_plain_scorer(docs, messy, labels):
    model = quality.fit(docs, labels)
    texts = [t for _, t in texts_of(docs)[:60]] + [t for _, t in texts_of(messy) if len(t or "") < 20_000]
    for t in texts:
        assert model.score(t) == pytest.approx(plain_score(t, model.row, model.bias), abs=1e-4), (t or "")[:50]


def test_classifier_reads_nothing_held_out(spark):
    rows = [(i, "good text here" if zlib.crc32(str(i).encode()) % 4 == 2 else "plain words") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = df.select("doc_id", F.when(F.col("text") == "plain words", 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    assert all(r.score == 1.0 for r in quality.score_documents(df, lab).collect())  # only label 1 is left to learn from


# shards


def test_shards(docs, messy, clashing):
    for df, texts in ((docs, texts_of(docs)), (clashing, texts_of(messy))):
        rows = sharding.shard_documents(df).collect()
        want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(messy.limit(0)).count() == 0


def test_weights_and_growth(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    out = sharding.assign(df, F.col("k"), (1.0, 2.0, 1.0)).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 20_000 for r in out}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    moved = sharding.assign(df, F.col("k"), (1.0,) * 9).where("shard <> grown_shard")
    assert abs(moved.count() / 20_000 - 0.1) < 0.02 and [r.grown_shard for r in moved.select("grown_shard").distinct().collect()] == [9]


# licenses


def test_patience_alignment_against_plain_rules():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    a, b = rng.sample(range(100), 30), rng.sample(range(100), 30)
    table = [[0] * 31 for _ in range(31)]
    for i in range(30):
        for j in range(30):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert len(licenses.align(a, b)) == table[30][30]  # without repeats patience finds the longest common run


def test_license_scan(spark, messy, clashing):
    from placegraph.llm.license_texts import TEMPLATES

    texts = {n: t for n, _, t in TEMPLATES}
    mit, notice = texts["MIT license"], texts["MIT notice"]
    words = mit.split()
    edited = " ".join(w if i % 11 else "changed" for i, w in enumerate(words))
    rows = [(1, "lorem ipsum\n" + mit + "\nmore " * 50 + notice), (2, edited), (3, " ".join(reversed(words))), (4, "Released under the BSD License."), (5, None),
            (6, notice + " x " + notice), (7, "# " + "\n# ".join(texts["Apache-2.0 header"].split("\n")))]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.license)
        assert rows[r.doc_id - 1][1].encode()[r.start_byte : r.end_byte].strip()
    assert {d: sorted(x) for d, x in got.items()} == {1: ["MIT license", "MIT notice"], 2: ["MIT license"], 6: ["MIT notice"] * 2, 7: ["Apache-2.0 header"]}
    assert licenses.scan_licenses(clashing).count() == 0 and licenses.scan_licenses(messy.limit(0)).count() == 0


def test_two_and_three_clauses_are_told_apart(spark):
    texts = {n: t for n, _, t in licenses.TEMPLATES}
    rows = [(2, "Copyright 2020 Us\n" + texts["BSD-2-Clause license"]), (3, "Copyright 2020 Us\n" + texts["BSD-3-Clause license"] + "\nmore " * 40)]
    got = [(r.doc_id, r.license, r.coverage) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(2, "BSD-2-Clause license", 1.0), (3, "BSD-3-Clause license", 1.0)]


def test_license_scan_of_the_table(spark, sf):
    """Every notice the table holds, by plain search."""
    want = Counter()
    for d, t in texts_of(spark.read.parquet(f"{sf}/documents.parquet")):
        flat = b" ".join(licenses.fold(t).split())
        for name in ("MIT notice", "Apache-2.0 notice", "GPL-3.0 notice", "CC-BY-NC-4.0 notice"):
            text = next(x for n, _, x in licenses.TEMPLATES if n == name)
            want[d, name] += flat.count(b" ".join(licenses.fold(text).split()))
    got = Counter((r.doc_id, r.license) for r in queries.QUERIES["op10_license_patience"](spark, sf).collect())
    assert got == +want
