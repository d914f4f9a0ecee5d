"""Operators 11 to 13 against plain Python, and their defined cases."""

import collections
import hashlib
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlens.llm import alignment, hosts, negatives, vectors

needs_vocabularies = pytest.mark.skipif(not Path(alignment.A_VOCABULARY).exists(), reason="needs the vocabulary files")


# hard negatives


def mined(rows, every, scale=256):
    """Rows (vec_id, vector, label) to the results, pair by pair."""
    fine = [(i, tuple(int(np.floor(scale * float(x))) for x in v), c) for i, v, c in rows
            if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, x, label) in enumerate(fine):
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), i, c) for m, (i, y, c) in enumerate(fine) if m != n and len(y) == len(x)]
        for s, p, _ in sorted(t for t in scores if t[2] == label)[:5]:
            range_ = sorted(t for t in scores if t[2] != label and -50 * s <= -100 * t[0] <= -95 * s)[:3]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(range_, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors_of_all_kinds():
    g = np.random.default_rng(5)
    rows = [(i, g.normal(0.3, 0.4, 6).tolist(), int(g.integers(0, 3))) for i in range(300)]
    rows += [(i, rows[7][1], rows[7][2]) for i in range(300, 420)]  # a vector that many rows share, and that asks
    rows += [(420, None, 1), (421, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (422, [float("nan")] * 6, 1), (423, [float("inf")] * 6, 1), (425, rows[0][1], None)]
    rows += [(430, [1.0, 2.0], 1), (440, [2.0, 1.0], 1), (441, [1.5, 0.25], 2), (450, [], 1), (451, [], 1), (452, [], 2), (460, [0.5], 9), (None, rows[0][1], 1)]
    return [(i, v, c) for i, v, c in rows]


@pytest.mark.parametrize("cells", [48, 1 << 18])
def test_hard_negatives_equal_brute_force(spark, vectors_of_all_kinds, cells):
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors_of_all_kinds], "vec_id long, embedding array<float>, label int, v string, dim int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = negatives.mine(df, every=10, block_cells=cells)
    assert sorted(map(tuple, got.collect())) == mined(rows, 10)
    assert negatives.mine(df.limit(0), every=10).collect() == []


def test_brackets_hold_every_score_and_prune(monkeypatch):
    g = np.random.default_rng(2)
    centres = g.normal(0, 1, (6, 8))
    centres = (centres * 900 / np.linalg.norm(centres, axis=1)[:, None]).astype(np.int64)  # of one length, as embeddings are
    x = (centres[g.integers(0, 6, 600)] + g.integers(-9, 10, (600, 8))).astype(np.int64)
    norm2 = (x * x).sum(axis=1)
    most = int(norm2.max())

    def block(rows, pivots, asks):
        b = negatives.Block.__new__(negatives.Block)
        b.n, b.most, b.labels, b.norm2, b.x = len(rows), most, rows[:, 0] % 3, (rows * rows).sum(axis=1), rows
        b.far = negatives._distances(negatives._augmented(rows, np.full(len(rows), most) if asks else b.norm2, most), pivots)
        b.ids, b.ends, b.most_x = np.arange(len(rows)), np.arange(1, len(rows) + 1), float(np.abs(rows).max())
        return b

    a = negatives._augmented(x, norm2, most)
    kinds = [bytes([8]) + r.astype(np.int64).tobytes() for r in x]
    chosen = negatives._choose(pd.DataFrame({"dim": 8, "most": most, "v": kinds, "norm2": norm2}))
    pivots = np.frombuffer(chosen.pivots[0], np.float64).reshape(-1, 9)
    assert len(pivots) == negatives.PIVOTS
    q, data = block(x[:40], pivots, True), block(x, pivots, False)
    lower, upper = negatives.brackets(q, np.arange(40), data, np.arange(600))
    score = x[:40] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    monkeypatch.setattr(negatives, "SPARSE", 1)  # count pairs that brackets leave
    _, read = negatives.seek(q, [data], np.full((40, 1), negatives.LEAST), np.full((40, 1), negatives.MOST), 6, True)
    assert read < 40 * 200 // 3  # most rows of clustered vectors are never multiplied


def test_shares_are_whole_divisions_without_overflow():
    for score in (0, 1, -1, 99, -101, 7 * 10**18, -7 * 10**18):
        assert int(negatives._share(np.array([score]), 95)[0]) == 95 * score // 100


@pytest.mark.parametrize("huge", [1e19, 1e300, 1e307, 1e15])
def test_scores_beyond_a_long_are_a_named_error(spark, huge):
    df = spark.createDataFrame([(i, [huge if i == 3 else 0.5] * 4, 1) for i in range(6)], "vec_id long, embedding array<double>, label int")
    for run in (lambda: vectors.top_k(df, 2, 1).collect(), lambda: negatives.mine(df, 2).collect()):
        with pytest.raises(Exception, match="vec_id 3"):
            run()


def test_large_scores_keep_their_order(spark):
    rows = [(i, [3.0e6 + i, -2.0e6 + i % 5, 1.0e5 * i], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows}
    want = [(a, r, i, s) for a in q for r, (s, i) in enumerate(sorted(((sum(x * y for x, y in zip(q[a], q[i])), i) for i in q if i != a), key=lambda t: (-t[0], t[1]))[:3], 1)]
    assert sorted(map(tuple, vectors.top_k(df, 3, 1).collect())) == sorted(want)
    assert sorted(map(tuple, negatives.mine(df, 4).collect())) == mined(rows, 4)


# token alignment


def aligned(rows):
    """Rows (key, text) to (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), whole texts, token by token."""
    t = alignment.Tokenizers(alignment.A_VOCABULARY, alignment.B_VOCABULARY)

    def groups(text):
        if not text:
            return []
        a, b = t.a.encode(f" {text}", add_special_tokens=False).ids, t.b.encode(text)
        if not b"".join(t.a_raw[i] for i in a) == b"".join(t.b_raw[i] for i in b) == f" {text}".encode():
            return []
        a_ends, b_ends = np.cumsum([len(t.a_raw[i]) for i in a]).tolist(), np.cumsum([len(t.b_raw[i]) for i in b]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            m, n = a_ends.index(end) + 1, b_ends.index(end) + 1
            out.append((a[i:m], b[j:n]))
            i, j = m, n
        return out

    found = [(k, groups(text)) for k, text in rows]
    pairs = [[(x, y) for xs, ys in g for x in xs for y in ys] for _, g in found]
    counts = collections.Counter(p for links in pairs for p in set(links))
    top = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    return [(k, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(p), sum(counts[x] == top[x[0]] for x in p), sum(counts[x] for x in p),
             ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for (k, g), p in zip(found, pairs)]


@needs_vocabularies
def test_alignment_equals_whole_texts(spark):
    g = random.Random(3)
    signs = [*" \n\t\r \x1c\x85 aAbé中文😀'.,!?0123456789́​", "  ", "\n\n", "the", " of", "'s", "<|endoftext|>", "<s>", "▁", ";\r", "tokenizers "]
    rows = [(i, "".join(g.choices(signs, k=g.randint(0, 50)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " "), (403, "\n"), (404, "a "), (405, " " * 900 + "x" + "\n" * 700), (None, "no key"), (406, "a▁b"), (407, "word " * 3000), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, n int").repartition(3)
    got = alignment.align(df, ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(aligned(rows), key=repr)
    assert alignment.align(df.limit(0), ["doc_id"]).collect() == []
    kept = alignment.align(df, ["text", "chunk", "n"])
    assert kept.columns[:3] == ["text", "chunk", "n"] and kept.count() == len(rows)
    counts = {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(alignment.encoded(df, ["doc_id"])).collect()}
    assert sum(counts.values()) > 0 and max(counts.values()) <= len(rows)


@needs_vocabularies
def test_units_of_slices_are_units_of_the_text(monkeypatch):
    g = random.Random(8)
    text = " " + "".join(g.choices(["ab", " ", "  ", "\n", "\t", "x", "\r\n", " "], k=4000))
    whole = alignment._UNIT.findall(text)
    assert "".join(whole) == text
    monkeypatch.setattr(alignment, "SLICE", 50)
    parts = list(alignment.slices(text))
    assert len(parts) > 20 and "".join(parts) == text
    assert [u for p in parts for u in alignment._UNIT.findall(p)] == whole


def test_groups_end_where_tokens_of_both_end():
    g = random.Random(1)
    for _ in range(200):
        n = g.randint(1, 40)
        cuts = [sorted({n, *g.sample(range(1, n + 1), g.randint(0, n // 2))}) for _ in range(2)]
        a, b = (np.diff([0, *c]) for c in cuts)
        common = sorted(set(cuts[0]) & set(cuts[1]))
        of_a, of_b = alignment.groups_of(a, b)
        assert of_a.tolist() == np.searchsorted(common, cuts[0]).tolist() and of_b.tolist() == np.searchsorted(common, cuts[1]).tolist()


# URL filters


def urls(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, bad boolean, host string, suffix string")


def test_urls_are_split_and_rules_judge(spark):
    rows = [
        (1, "http://Example.COM/en/1?x=/fr/", None), (2, "https://www.example.com/en/", None), (3, "https://a.www.example.com/en/2#/x", None),
        (4, "http://notexample.com/en/", None), (5, "http://example.com", None), (6, "http://x.net/es/", None), (7, "http://x.net/en/", None),
        (8, "x://net/fr/é", None), (9, None, None), (10, "no scheme", None), (11, "", None), (12, "a://b://com/", None), (13, "http://x.com:80/", None),
        (14, "http://a..com/?q", None), (15, "://com#", None), (None, "http://com/", None), (1, "http://Example.COM/en/1?x=/fr/", None), (16, "http://x.NET/ES/", None),
    ]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in hosts.judge(urls(spark, rows), hosts.RULES).collect()}
    assert got == {
        (1, "example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "a.www.example.com", "/en/2", "www.example.com/en/", "allow"), (4, "notexample.com", "/en/", "com/", "allow"), (5, "example.com", "", None, "allow"),
        (6, "x.net", "/es/", "net/es/", "block"), (7, "x.net", "/en/", None, "allow"), (8, "net", "/fr/é", "net/fr/", "block"), (9, "", "", None, "allow"),
        (10, "", "", None, "allow"), (11, "", "", None, "allow"), (12, "b:", "//com/", None, "allow"), (13, "x.com:80", "/", None, "allow"),
        (14, "a..com", "/", "com/", "allow"), (15, "com", "", None, "allow"), (None, "com", "/", "com/", "allow"), (16, "x.net", "/ES/", None, "allow"),
    }
    assert hosts.judge(urls(spark, rows), hosts.RULES).count() == len(rows)
    assert hosts.judge(urls(spark, []), hosts.RULES).collect() == []
    twice = hosts.judge(urls(spark, rows[:1]), [("com/", "block"), ("com/", "allow")]).collect()
    assert [(r.rule, r.verdict) for r in twice] == [("com/", "block")]
    assert {r.verdict for r in hosts.judge(urls(spark, rows), []).collect()} == {"allow"}


def test_reputation_shrinks_to_the_domain_and_blocks_by_the_bound(spark):
    g = random.Random(6)
    rows = []
    for d in range(40):  # domains of very different shares of bad pages
        share = 0.97 if d < 4 else 0.02
        for h in range(5):
            n = 60 if h else 1  # the first host has a single page with a label
            rows += [(len(rows) + i, f"http://h{h}.d{d}.org/x", g.random() < share) for i in range(n)]
    rows += [(10**6, "http://h9.d0.org/", None), (10**6 + 1, "http://lonely.dev/", True), (10**6 + 2, "http://10.0.0.1/", None)]
    out = {r.host: r for r in hosts.judge(urls(spark, rows), []).select("host", "verdict", "bound", "n_labelled", "n_bad").distinct().collect()}
    for d in range(40):
        assert {out[f"h{h}.d{d}.org"].verdict for h in range(1, 5)} == {"block" if d < 4 else "allow"}
    assert out["h9.d0.org"].n_labelled == 0 and out["h9.d0.org"].bound > out["h1.d20.org"].bound
    assert out["lonely.dev"].verdict == "allow"  # one bad page blocks no host by itself
    assert all(0 <= r.bound < 1 for r in out.values())
    large = [r for r in out.values() if r.n_labelled == 60]
    assert max(abs(r.bound - r.n_bad / 60) for r in large) < 0.35


def test_domains_and_suffixes(spark):
    names = ["a.b.co.uk", "b.co.uk", "co.uk", "www.example.com", "com", "", "10.0.0.1", "10.0.0.1:80", "a..com"]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    suffix = hosts.suffix_of(F.col("host"))
    got = [tuple(r) for r in df.select("host", suffix, hosts.domain_of(F.col("host"), suffix)).collect()]
    assert got == [("a.b.co.uk", "co.uk", "b.co.uk"), ("b.co.uk", "co.uk", "b.co.uk"), ("co.uk", "co.uk", "co.uk"), ("www.example.com", "com", "example.com"),
                   ("com", "com", "com"), ("", "", ""), ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("10.0.0.1:80", "10.0.0.1:80", "10.0.0.1:80"), ("a..com", "com", ".com")]


def test_digest_of_groups_is_taken_of_texts_with_tokens_only(spark, tmp_path):
    if not Path(alignment.A_VOCABULARY).exists():
        pytest.skip("needs the vocabulary files")
    spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.groups_sha256 for r in alignment.op12_token_alignment(spark, str(tmp_path)).collect()}
    assert got[2] == got[3] == "" and got[1] == hashlib.sha256(aligned([(1, "a b")])[0][-1].encode()).hexdigest()
