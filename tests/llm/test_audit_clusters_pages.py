"""Filter potentials, centroid clusters and page differencing against plain versions and on messy rows."""

import hashlib
import re
from html import unescape
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from placegraph.llm import centroids, filter_audit, main_text, queries
from placegraph.llm.html_lines import page_lines

# filter interaction audit


def plain_audit(docs, labels):
    """Every filter on every row, in every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = []
    for doc, text, lang in docs:
        text = text or ""
        words = brute.WORD.findall(text)
        earlier = doc is not None and any(t == text and d is not None and d < doc for d, t in ((d, t or "") for d, t, _ in docs))
        tests = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": earlier}
        failed.append((lang or "", doc, {f for f, bad in tests.items() if bad}))
    out = {}
    for part in {p for p, _, _ in failed}:
        rows = [(d, f) for p, d, f in failed if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                                                   sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, step), told in out.items():
            if p == part:
                told.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def told(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_of_messy_rows(spark, messy, clashing):
    labels = [(1, 1, 0), (7, 1, 1), (7, 0, 0), (8, 0, 1), (10, None, None), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, n string")
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in messy.collect()], labels)
    got = filter_audit.audit_filters(clashing, table).collect()
    assert told(got) == want and len(got) == len(want) == 2 * 600
    assert any(x[4] for x in want.values()) and any(x[5] for x in want.values())


def test_audit_without_rows_or_labels(spark, messy):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(messy.limit(0), labels).count() == 0
    one = spark.createDataFrame([(1, "fine", None)], "doc_id long, text string, lang string")
    got = told(filter_audit.audit_filters(one, labels).collect())
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["", "BCDEA", 2] == (1, 0, 0, 0, 0, 0, 0)


def test_potentials_share_the_game():
    rng = np.random.default_rng(0)
    histogram = rng.integers(0, 50, 32).tolist()
    v, p = filter_audit.game(histogram), filter_audit.potential(filter_audit.game(histogram))
    shares = [p[31] - p[31 ^ 1 << i] for i in range(5)]
    assert sum(shares) == 120 * v[31]
    for i, share in enumerate(shares):  # a document is shared equally by the filters that fail it
        assert share == sum(n * 120 // bin(m).count("1") for m, n in enumerate(histogram) if m >> i & 1)


# centroid clustering


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for k in set(at):
            own = [v for (_, v), a in zip(kept, at) if a == k]
            cents[k] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, *nearest(v)) for i, v in kept]
    per = {k: sum(d for _, d, c in out if c == k) for k in range(len(cents))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((repr(i), k, d, per[k], sum(per.values()), names[k]) for i, d, k in out)


def of(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<double>, label string, cluster string, v string, name string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "l", "c", "v", "n") for i, v in rows], SCHEMA)


def test_clusters_match_a_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64) * (0.1 if i % 3 else 3)) for i in range(300)]
    rows += [(300 + i, np.full(64, (i % 5) / 64)) for i in range(60)]  # equal vectors, many ties
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, np.ones(64)), (400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65),
             (404, [None] + [0.0] * 63), (405, [float("nan")] * 64), (406, [float("-inf")] + [0.0] * 63)]
    assert of(centroids.cluster_vectors(frame(spark, rows))) == plain_clusters(rows)


def test_clusters_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(rng.integers(-3e7, 3e7)), *rng.normal(size=63)]) for i in range(60)]
    assert of(centroids.cluster_vectors(frame(spark, rows))) == plain_clusters(rows)
    got = centroids.cluster_vectors(frame(spark, [(1, [1e15] * 64), (2, [-1e15] * 64), (3, [1e300] * 64), *[(i, [0.0] * 64) for i in range(10, 40)]])).collect()
    assert {r.vec_id for r in got} == {1, 2, *range(10, 40)}


def test_fewer_vectors_than_clusters(spark):
    assert centroids.cluster_vectors(frame(spark, [])).count() == 0
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64), (2, [-0.5] * 64)]
    assert of(centroids.cluster_vectors(frame(spark, rows))) == plain_clusters(rows)


def test_the_tree_is_exact_and_prunes():
    rng = np.random.default_rng(6)
    cents = [rng.integers(-500, 500, 64).tolist() for _ in range(40)]
    cents += [cents[3], cents[0], [0] * 64, [1] + [0] * 63]  # equal centroids: the smaller number wins
    x = np.concatenate((np.array(cents)[rng.integers(0, 44, 400)] + rng.integers(-9, 9, (400, 64)), rng.integers(-500, 500, (100, 64)), np.array(cents)))
    best, dist, opened = centroids.search(centroids.build(cents), x)
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents)) for v in x]
    assert [(int(d), int(k)) for d, k in zip(dist, best)] == want
    assert opened[:400].mean() < 35 and opened.min() >= 1


# page differencing


def plain_common(a, b):
    """Length of the longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cells", [main_text.CELLS, 8])
def test_alignment_is_longest(monkeypatch, cells):
    monkeypatch.setattr(main_text, "CELLS", cells)
    rng = np.random.default_rng(7)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(1, 9), rng.integers(0, 30)).tolist() for _ in "ab")
        at = main_text.common_subsequence(a, b)
        assert at == sorted(set(at)) and len(at) == plain_common(a, b)
        left = iter(b)
        assert all(any(a[i] == y for y in left) for i in at)


def plain_article(html):
    inner = html[html.find("<article>") + 9 : html.rfind("</article>")].replace("<br>", " ")
    blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_articles_of_a_table(spark, sf):
    want = {r.page_id: plain_article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op13_page_differencing"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def site(host, path, body):
    return f"https://{host}{path}", f"<html><body><div>Home News <i>About</i></div><div>Good morning</div>{body}<div>All rights kept</div><p>Call us</p></body></html>"


def test_pages_without_articles_lose_what_neighbours_share(spark):
    rows = [site("a.org", f"/news/{i}", f"<h2>Story {i}</h2><p>Only in {i} &amp; here.</p><p>Even so {i // 2}</p>") for i in range(12)]
    rows += [site("b.org", "/x/1", "<p>Alone on its host</p>")]
    rows += [site("c.org", f"/copy/{i}", "<p>" + "The same long story told again and again. " * 9 + "</p>") for i in range(3)]
    rows += [(u.replace("a.org", "d.org"), h.replace("<h2>", "<article><h2>").replace("<div>All", "</article><div>All")) for u, h in rows[:2]]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, lines string")
    got = {r.page_id: r for r in main_text.extract_pages(df).collect()}
    partner = {0: 1, 1: 10, 2: 11, 10: 1, 11: 10}  # in text order; else the page before
    for i in range(12):
        want = [f"Story {i}", f"Only in {i} & here."] + ([] if partner.get(i, i - 1) // 2 == i // 2 else [f"Even so {i // 2}"])
        assert got[i].text == "\n\n".join(want), i
    frame = ["Home News About", "Good morning", "All rights kept", "Call us"]
    assert got[12].text.split("\n\n") == frame[:2] + ["Alone on its host"] + frame[2:] and got[12].n_shared == 0
    assert all(got[i].n_shared == 0 and got[i].text.count("told again") == 9 for i in (13, 14, 15))  # copies prove nothing
    assert got[16].text == "Story 0\n\nOnly in 0 & here.\n\nEven so 0" and got[16].n_shared == 5  # a declared article stays whole


def test_markup_that_names_its_frame():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="no-sidebar menu-open">
<div class="site-header"><p>Top</p></div><nav>Menu<ul><li>One<li>Two</ul></nav><div id="cookieNotice">We bake</div><div class="ad"><p>Buy</div>
<article class="post has-comments"><header class="entry-header"><h1>Title &lt;1&gt;</h1><p>by Ann</p></header><p>First <b>bold</b>word<br>next<!-- <p>gone --><p>Second &nbsp; line
<aside>Aside</aside><form><input><label>Mail</label></form><div class="share-buttons">Share</div><table><tr><td>a<td>b</table><pre>x
 y</pre><p hidden>Hid</p><footer>Foot</footer><div class="comments"><article><p>First!</p></article></div></article>
<section id="comments"><article class="comment">Nice</article></section><div class="related"><article>More</article></div><footer>End</footer>"""
    assert [t for t, level in page_lines(html) if level == 2] == ["Title <1>", "First boldword next", "Second line", "a", "b", "x y"]
    assert [t for t, level in page_lines(html) if level < 2] == []
    assert page_lines(None) == page_lines("") == page_lines("<p> <br></p><script>x") == []
    assert page_lines("a &am<b>p;</b> < 3 <p>open <div class='x") == [("a &amp; < 3", 0), ("open <div class='x", 0)]
    assert page_lines('<div class="ad">left open<article><p>kept</p></article>') == [("kept", 2)]
    assert page_lines("<form><main><p>wrapped</p></main></form>") == [("wrapped", 1)]
    deep = page_lines("<div>" * 30_000 + "x" + '<a ="' * 20_000)
    assert deep and deep[0][0].startswith("x")


def test_pages_with_messy_rows(spark):
    rows = [(1, None, None), (None, "https://h.org/a", "<p>x"), (2, "https://h.org/a", "<p>x"), (2, "https://h.org/a", "<p>x"), (3, "", "<p>same"), (4, "not a url", "<p>same"),
            (5, "https://h.org/b", ""), (6, "https://h.org/b/c", "<p>x</p><p>" + "long words " * 200_000), (7, "//U@H.org:80/?q", "<p>y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit("z")).withColumn("shared", F.lit("z")).withColumn("levels", F.lit(1))
    got = main_text.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in got) == sorted(
        (i or 0, u or "", n, n) for (i, u, _), n in zip(rows, [0, 1, 1, 1, 4, 4, 0, 2_200_002, 1]))
    assert main_text.extract_pages(df.limit(0)).count() == 0
    assert main_text.host_and_path("HTTPS://u@A.org:8080/x//y/?q#f") == ("a.org:8080", "x\x01y") and main_text.host_and_path(None) == ("", "")


def test_many_pages_of_one_host_over_many_windows(spark, monkeypatch):
    monkeypatch.setattr(main_text, "CHUNK", 8)
    rows = [(i, *site("a.org", f"/n/{i:04d}", f"<p>Told in {i} only</p>")) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert {r.page_id: r.text for r in main_text.extract_pages(df).collect()} == {i: f"Told in {i} only" for i in range(200)}
