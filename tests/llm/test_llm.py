"""The training-data operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeated rows."""

import collections
import hashlib
import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.llm import chat, fingerprint, langid, licenses, lines, mixing, neardup, pieces, tokencount, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"
VOCABULARY = Path(tokencount.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="needs the vocabulary file")


def docs_of(spark, rows):
    """Documents from (doc_id, text, lang, source), with two columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, la, so, len(t or ""), "x", "y") for i, t, la, so in rows], DOCS)


@pytest.fixture(scope="module")
def words():
    g = random.Random(4)
    return ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="module")
def corpus(spark, words):
    """Random texts with exact copies, near copies, tiny, empty and null texts, and one very long."""
    g, rows = random.Random(7), []
    for i in range(60):
        rows.append((i, " ".join(g.choices(words, k=g.randint(8, 60))), "en", f"s{i % 4}"))
    for i in range(60, 90):
        base = rows[g.randrange(60)][1].split()
        for _ in range(g.randint(0, 3)):
            base[g.randrange(len(base))] = g.choice(words)
        rows.append((i, "  ".join(base).upper() if i % 3 else " ".join(base), None, "s1"))
    rows += [(90, None, None, None), (91, "", None, None), (92, " \n\t ", "en", "s1"), (93, "one two", "en", "s2"), (94, "ONE\ttwo ", "en", "s2"),
             (95, " ".join(g.choices(words, k=30_000)), "en", "s3"), (0, rows[0][1], "en", "s0"), (None, "no id here at all today", "en", "s1")]
    return docs_of(spark, rows).persist()


def test_apportionment_equals_highest_quotients():
    g = random.Random(1)
    for _ in range(50):
        votes = [g.choice([0.0, g.uniform(0, 9), float(g.randint(0, 5))]) for _ in range(g.randint(1, 7))]
        most = [float(g.randint(0, 9)) for _ in votes]
        seats, want = g.randint(0, 30), [0] * len(votes)
        for _ in range(seats):
            q, i = max(((v / (2 * w + 1), -i) for i, (v, w, m) in enumerate(zip(votes, want, most)) if v > 0 and w < m), default=(0, None))
            if i is not None:
                want[-i] += 1
        assert mixing.apportion(votes, seats, most) == want


def test_targets_stop_at_the_limit_and_share_again():
    got = mixing.targets([100, 1000, 0, 500], [5.0, 2.0, 1.0, 5.0], 1.5, 2.0)
    assert got[0] == 200 and got[2] == 0 and got[3] == 1000 and sum(got) == pytest.approx(2400)


def test_mix(spark, corpus):
    got = mixing.mix(corpus).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(corpus).collect()))
    assert len(got) == corpus.count()
    by = collections.defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
    for r in got:
        assert abs(by[r["source"]] - r["target"]) <= max(mixing.BLOCK_WORDS * 2, 0.02 * r["target"])
    size = {(r["doc_id"], r["size"]) for r in got}
    assert {(r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in corpus.collect()} == size
    assert mixing.mix(corpus.limit(0)).count() == 0


@needs_vocabulary
def test_segmentations_are_distinct_exact_and_unbiased():
    lat = pieces.lattices(pieces.VOCABULARY, 1.0)
    odd = [None, "", " ", "▁ a▁▁", "  two  spaces \n\n end ", "日本語 \U0001f642 x\ty", "A" * 3000, " a"]
    for text, found in zip(odd, pieces.sample(odd, list(range(len(odd))), lat, 3), strict=True):
        ids = [s.ids.tolist() for s in found]
        assert len({tuple(x) for x in ids}) == len(ids) >= 1
        assert all(lat.v.decode(x) == (text or "") for x in ids)
        assert all(a.perturbed >= b.perturbed for a, b in zip(found, found[1:]))
    n, total, first = 4000, 0.0, collections.Counter()
    for a in range(0, n, 500):
        for found in pieces.sample(["the cat"] * 500, [pieces.row_key(a + i, 3) for i in range(500)], lat, 3):
            total += sum(math.exp(s.log_prob) / s.inclusion for s in found)
            first[tuple(found[0].ids.tolist())] += math.exp(found[0].log_prob) * 0 + 1
    assert total / n == pytest.approx(1.0, abs=0.02)  # inverse inclusion weights add up to all of the mass
    probs = {tuple(s.ids.tolist()): math.exp(s.log_prob) for s in pieces.sample(["the cat"], [1], lat, 6)[0]}
    for ids, p in probs.items():
        assert first[ids] / n == pytest.approx(p, abs=0.02)


@needs_vocabulary
def test_encode_and_decode_tables(spark, corpus):
    got = pieces.encode(corpus, "doc_id", ["doc_id", "row"]).persist()
    assert got.count() == corpus.count() and pieces.encode(corpus.limit(0), "doc_id", ["doc_id"]).count() == 0
    back = pieces.decode(got.select("doc_id", F.col("samples")[0]["ids"].alias("ids")), "ids", ["doc_id"])
    want = {(r["doc_id"], r["text"] or "") for r in corpus.collect()}
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == want


def test_consistent_weighted_sampling_estimates_generalised_jaccard(spark):
    rows = [(1, w, a, b) for w, a, b in [(11, 4, 1), (12, 1, 1), (13, 0, 3), (14, 2, 2), (15, 5, 0), (16, 1, 2)]]
    df = spark.createDataFrame(rows, "k int, word long, a long, b long").withColumn("word", F.xxhash64("word"))
    fp = fingerprint.fingerprints(df, "k", ["a", "b"], lanes=600).select(fingerprint.likeness(F.col("fp_a"), F.col("fp_b"))).first()[0]
    want = sum(min(a, b) for *_, a, b in rows) / sum(max(a, b) for *_, a, b in rows)
    assert fp == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / 600))


def test_fingerprints_of_edited_texts(spark, corpus):
    rows = corpus.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(rows).collect()}
    texts = sorted((r["doc_id"], r["text"] or "") for r in rows.collect())
    assert len(got) == len(texts)
    for i, (d, t) in enumerate(texts):
        k, nxt = len(t) // 4, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - k] + nxt[1][:k]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        alike = sum(a == b for a, b in zip(re.findall("......", got[d]["fingerprint"]), re.findall("......", got[nxt[0]]["fingerprint"])))
        assert got[d]["near_next"] == pytest.approx(alike / fingerprint.LANES)
        if edited.split() == t.split():
            assert got[d]["near_edited"] == 1
    assert got[91]["fingerprint"] == "0" * 6 * fingerprint.LANES and got[90]["near_next"] == 1.0
    twice = fingerprint.edited_fingerprints(corpus).collect()
    assert len(twice) == corpus.count() and fingerprint.edited_fingerprints(corpus.limit(0)).count() == 0


def brute_components(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = [x.decode() for x in (text or "").encode().lower().split()]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(k)
    out = []
    for ks in groups.values():
        least = min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
        out += [(rows[k][0], len(sets[k]), least) for k in ks]
    return sorted(out, key=repr)


def test_near_duplicates_equal_brute_force(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = neardup.near_duplicates(corpus).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(corpus.limit(0)).count() == 0


def test_edited_copies_of_one_text(spark, words):
    g, rows = random.Random(3), []
    base = g.choices(words, k=120)
    for i in range(120):
        w = list(base)
        for _ in range(g.randint(0, 8)):
            w[g.randrange(len(w))] = f"new{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(rows)


def test_superminhash_estimates_jaccard():
    a, b = np.arange(1, 301, dtype=np.uint64), np.arange(101, 401, dtype=np.uint64)
    off, h = np.array([0, 300, 600]), neardup.mix64(np.concatenate([a, b]))
    sig = neardup.superminhash(off, h, 1000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.5, abs=0.07)
    one = neardup.superminhash(np.array([0, 1]), h[:1], 64)
    assert sorted(np.floor(one[0])) == list(range(64))  # a single element fills every place, one a step


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(139, 100)]
    got = neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 140)}


@needs_vocabulary
def test_token_counts_equal_greedy_matching(spark, corpus):
    auto = tokencount.Automaton(["a", "abc", "b"], ["d", "bc", "bcd", "e", "c"])
    assert [auto.count(w) for w in ("abcd", "abce", "abd", "x", "abx", "a")] == [2, 2, 0, 0, 0, 1]
    counts = tokencount.counts_of(tokencount.VOCABULARY)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.VOCABULARY)
    known = [sp.id_to_piece(i) for i in range(259, sp.get_piece_size())]
    first, inner = {p[1:] for p in known if p[0] == "▁" and p.strip("▁") and p[1] != "▁"}, {p for p in known if "▁" not in p}

    def greedy(w):
        n = at = 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (inner if at else first)), None)
            if end is None:
                return 0
            n, at = n + 1, end
        return n

    rows = corpus.collect()
    got = {(r["doc_id"], r["n_words"]): r for r in tokencount.count_tokens(corpus, ["doc_id"]).collect()}
    for r in rows:
        each = [greedy(w) for w in (r["text"] or "").split()]
        x = got[r["doc_id"], len(each)]
        assert (x["n_tokens"], x["n_unknown"]) == (sum(n or 1 for n in each), each.count(0))
    assert counts.automaton.count("") == 0


def test_language_id(spark):
    g = random.Random(2)
    vocab = {"en": ["the", "house", "which", "with", "they"], "de": ["das", "haus", "welche", "nicht", "über"], "ru": ["это", "дом", "который", "они"]}
    make = lambda la, n: " ".join(g.choices(vocab[la], k=n))
    train = docs_of(spark, [(i, make(la, 30), la, "s") for i, la in enumerate(["en", "de", "ru"] * 30)])
    model = langid.fit(train)
    assert model.langs == ["de", "en", "ru"]
    rows = [(1, make("en", 9), None, None), (2, make("de", 9), None, None), (3, make("ru", 5) + " " + make("en", 15), None, None), (4, None, None, None),
            (5, "123 !? 7", None, None), (6, "", None, None), (7, make("de", 3000), None, None)]
    got = {r["doc_id"]: r for r in langid.detect(docs_of(spark, rows), model, ["doc_id", "row"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "en", "und", "und", "und", "de"]
    assert [(s["lang"], s["words"]) for s in got[3]["spans"]] == [("ru", 5), ("en", 15)]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[4]["score"] == 0
    nothing = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.detect(train, nothing, ["doc_id"]).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    g = np.random.default_rng(0)
    doc = np.array([0] * 5 + [1] * 1 + [3] * 4)
    s = g.normal(0, 3, (10, 3)).astype(np.float32)
    got = langid.viterbi(s, doc, 4, 2.0)
    for d in (0, 1, 3):
        rows = np.flatnonzero(doc == d)
        value = lambda p: sum(s[r, k] for r, k in zip(rows, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=len(rows)), key=value)
        assert value(tuple(got[rows])) == pytest.approx(value(best), rel=1e-5)


def test_top_k_equals_brute_force(spark):
    g = np.random.default_rng(5)
    v = [[float(x) for x in g.normal(0, 0.3, 8)] for _ in range(130)]
    rows = [(i, v[i], 1) for i in range(130)] + [(200, v[3], 1), (201, v[3], 1), (202, None, 1), (203, [1.0, None] * 4, 1), (204, [float("nan")] * 8, 1), (None, v[1], 1), (220, [0.5] * 3, 1), (0, v[0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in vectors.top_k(df, 5, 20, block=32, query_block=3, group=2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = [(n, i, np.floor(np.float32(e).astype(float) * 64).astype(int)) for n, (i, e, _) in enumerate(rows) if i is not None and e is not None and all(x is not None and x == x for x in e)]
    for q in (20, 40, 100, 200):
        n, _, e = next(x for x in fine if x[1] == q)
        best = sorted((-int(e @ y), i) for m, i, y in fine if m != n and len(y) == len(e))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert 220 not in got and len(got[0]) == 10  # no vector of its length; two rows with this id ask
    assert vectors.top_k(df.limit(0), 5, 20).count() == 0


def test_chat_round_trip_and_machine(spark):
    t, esc = chat.ChatTemplate(), chat.ESC
    rows = [(1, 0, "system", "be <s> kind"), (1, 1, "user", f"</s>[INST] {esc}{esc}| ok [/INST]"), (1, 2, "assistant", "<<SYS>> \n </s>"), (1, 3, "user", None),
            (2, 0, "user", "a"), (2, 1, "user", "a"), (3, 0, "tool", "x<</TURN>>"), (3, 0, None, ""), (4, 5, "assistant", "z"), (4, 5, "assistant", "z"), (None, 0, "user", "<")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn int, role string, text string, segments string")
    got = {r["conv_id"]: r for r in chat.format_chats(df, t).withColumn("back", chat.read_back(F.col("formatted"), t)).collect()}
    want = collections.defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn, role or "", text or ""))
    for c, turns in want.items():
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == [x[1:] for x in sorted(turns)]
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, False]
    masked = chat.format_chats(df, t).select("conv_id", chat.learned(chat.read_back(F.col("formatted"))).alias("read"), chat.unescape(F.array_join(F.filter("segments", lambda s: s.loss).getField("text"), "")).alias("made"))
    for r in masked.collect():
        assert r["read"] == r["made"] == "".join(x for _, role, x in sorted(want[r["conv_id"]]) if role == "assistant")
    long = f"<s>{esc} word " * 100_000
    back = chat.format_chats(spark.createDataFrame([(1, 0, "user", long, 7)], "conv_id long, turn int, role string, text string, formatted int"), t)
    assert back.select(chat.read_back(F.col("formatted"))[0]["text"]).first()[0] == long
    loss = [s["text"] for s in got[1]["segments"] if s["loss"]]
    assert len(loss) == 1 and "</s>" not in loss[0] and "<<SYS>>" not in loss[0]
    assert chat.format_chats(df.limit(0), t).count() == 0


def test_line_dedup(spark):
    pages = [(i, "h", f"menu\n text {i}\n\n footer ", "n") for i in range(10)] + [(20, "h", None, "n"), (21, "h", "menu", "n"), (22, None, "menu\nmenu", "n"), (23, "other", "menu", "n"), (23, "other", "menu", "n")]
    df = spark.createDataFrame(pages, "page_id long, host string, text string, n_lines string").drop("n_lines")
    got = lines.drop_boilerplate(df, 0.5, 3).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["text"], r["n_lines"], r["n_dropped"]))
    assert by[3] == [(" text 3\n", 4, 2)] and by[20] == [(None, 0, 0)] and by[21] == [("", 1, 1)]
    assert by[22] == [("menu\nmenu", 2, 0)] and by[23] == [("menu", 1, 0)] * 2
    assert lines.drop_boilerplate(df.limit(0)).count() == 0
    host = spark.range(1).select(lines.host_of(F.lit("HTTPS://u@A.example.org:80/x?y")).alias("h"), lines.lines_of(F.lit("<p>a <b>b</b></p><script>x</script><br>c")).alias("t")).first()
    assert (host["h"], host["t"]) == ("a.example.org", "a b\nc")


def test_license_join_equals_brute_force(spark, words):
    g, vocab = random.Random(6), sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    texts = [" ".join(g.choices(vocab + words[:20], k=g.randint(0, 25))) for _ in range(300)]
    texts += [" ".join(x for x in t.split() if g.random() > 0.05) for t in licenses.TEMPLATES.values() for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "Under the MIT license,\nunder the mit LICENSE. CC-BY-NC 4.0"), (902, "é Apache License, Version 2.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(df, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        own, want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower), set()
        for name, t in licenses.TEMPLATES.items():
            t = t.split()
            span = len(t) + max(1, len(t) // 4)
            if max((len({*own[i : i + span]} & {*t}) for i in range(len(own))), default=0) >= licenses.THRESHOLD * len({*t}) - 1e-9:
                want.add(licenses.SAME_LABEL.get(name, name))
        assert {b["label"] for b in r["blocks"]} == want
    last = {r["text"]: r for r in got if r["doc_id"] == 902}
    a = last[rows[-2][1]]
    assert (a["n_words"], a["n_base"], a["first_word"], a["last_word"], a["base_labels"]) == (13, 3, 0, 8, "cc-by-nc,mit") and a["score"] == 1
    assert last[rows[-1][1]]["first_word"] == 1 and licenses.scan(df.limit(0), ["doc_id"]).count() == 0


@needs_vocabulary
def test_pipeline_stages(spark, words, tmp_path):
    import corpus_pipeline as P

    g = random.Random(8)
    rows = [(i, "\n".join(" ".join(g.choices(words, k=12)) + "." for _ in range(4)) + ("\nshared line here" if i % 2 else ""), "en" if i % 5 else "de", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(5)] + [(200, None, None, None), (201, "12 34", "en", "s1"), (202, "", "en", "s2")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = P.language(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {r[0] for r in rows[:65]}
    two = P.line_dedup(spark, one, str(tmp_path)).persist()
    assert two.columns == docs.columns and two.filter("contains(text, 'shared line here')").count() == 0
    assert two.filter("n_chars <> char_length(text)").count() == 0
    three = P.near_duplicates(spark, two, str(tmp_path)).persist()
    kept = {least for _, _, least in brute_components([(r["doc_id"], r["text"]) for r in two.collect()])}
    assert three.columns == docs.columns and sorted(r["doc_id"] for r in three.collect()) == sorted(kept)
    four = P.mix(spark, three, str(tmp_path)).persist()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(three).collect()}
    got = collections.Counter()
    whole = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"] in whole[r["doc_id"]]
    assert four.columns == docs.columns and got == {d: n for d, n in taken.items() if n}
    runs = collections.Counter()
    for r in mixing.mix(three.withColumn("_th", F.xxhash64("text")), keep=["doc_id", "source", "_th"]).collect():
        text = whole[r["doc_id"]]
        spans = [m.span() for m in WORD.finditer(text)]
        times = [next(t for lo, hi, t in zip(r["edges"], r["edges"][1:], r["times"]) if lo <= w < hi) for w in range(r["from"], r["to"])]
        for level in range(1, max(times, default=0) + 1):
            for on, group in itertools.groupby(range(len(times)), lambda w: times[w] >= level):
                at = list(group)
                if on:
                    runs[r["doc_id"], text if len(at) == len(times) else text[spans[at[0]][0] : spans[at[-1]][1]]] += 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in four.collect()) == runs
    last = P.run(spark, str(tmp_path))
    back = pieces.decode(last, "ids", ["doc_id"])
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((r["doc_id"], r["text"]) for r in four.collect())


def test_copies_of_a_document_are_no_boilerplate(spark, words):
    import corpus_pipeline as P

    g = random.Random(9)
    text = lambda: "\n".join(" ".join(g.choices(words, k=12)) for _ in range(4))
    same, pair = text(), text()
    rows = [(i, text() + "\nshared line here", "en", "big") for i in range(40)] + [(100 + i, same, "en", "big") for i in range(20)]
    rows += [(200 + i, text(), "en", "small") for i in range(9)] + [(300 + i, pair, "en", "small") for i in range(3)]
    left = P.line_dedup(spark, docs_of(spark, rows), "").persist()
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {i: t.removesuffix("\nshared line here") for i, t, *_ in rows}
    kept = {r["doc_id"] for r in P.near_duplicates(spark, left, "").collect()}
    assert kept == {*range(40), 100, *range(200, 209), 300}


def test_lines_on_a_few_percent_of_a_source_are_dropped(spark, words):
    import corpus_pipeline as P

    g = random.Random(10)
    text = lambda: "\n".join(" ".join(g.choices(words, k=12)) for _ in range(3))
    planted = {"planted at four percent": range(0, 8), "planted at three percent": range(50, 56), "planted at one percent": range(100, 102)}
    rows = []
    for i in range(200):
        bare, extra = text(), [x for x, at in planted.items() if i in at]
        rows.append((i, "\n".join([bare, *extra]), "en", "s", bare if extra != ["planted at one percent"] else "\n".join([bare, *extra])))
    rows += [(300 + i, rows[150][1], "en", "s", rows[150][4]) for i in range(100)]  # copies neither add nor hide lines
    left = P.line_dedup(spark, docs_of(spark, [r[:4] for r in rows]), "").collect()
    assert {r["doc_id"]: r["text"] for r in left} == {r[0]: r[4] for r in rows}


@needs_vocabulary
def test_pipeline_encodes_all_samples(spark, words):
    import corpus_pipeline as P

    g = random.Random(11)
    texts = [" ".join(g.choices(words, k=20)) for _ in range(8)] + ["two  spaces\n\n ▁ end", "日本語 x", "", None]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).persist()
    keyed = docs.withColumn("k", F.concat_ws("/", "doc_id", F.xxhash64("text")))
    want = {r["doc_id"]: [(x["ids"], x["log_prob"], x["inclusion"]) for x in r["samples"]] for r in pieces.encode(keyed, "k", ["doc_id"]).collect()}
    got = P.encode(spark, docs, "").collect()
    lat = pieces.lattices(pieces.VOCABULARY, 1.0)
    assert len(got) == len(texts) and all(r["round_trip"] for r in got)
    for r in got:
        samples = [(r["ids"], r["log_prob"], r["inclusion"]), *((x["ids"], x["log_prob"], x["inclusion"]) for x in r["further"])]
        assert samples == want[r["doc_id"]] and r["n_pieces"] == len(r["ids"])
        assert len({tuple(x[0]) for x in samples}) == len(samples) == (pieces.K if texts[r["doc_id"]] else 1)
        assert all(lat.v.decode(x[0]) == (texts[r["doc_id"]] or "") for x in samples)
    sample = pieces.sample(["some words"], [3], lat, 1)[0]
    assert not P._encoded("other words", sample, lat.v)[-1]


def test_wrapped_and_second_best_licenses(spark, words):
    g = random.Random(12)
    full = licenses.TEMPLATES
    noise = lambda: " ".join(g.choices(words, k=12))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated"
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided"
    rows = [(1, mit, "mit"), (2, bsd, "bsd"), (3, f"{noise()}\n{bsd}\n{noise()}\n{mit}", "bsd,mit"),
            (4, f"{full['gpl-3']} {noise()} {full['mit'].replace('hereby ', '')}", "gpl-3,mit"), (5, full["gpl-3"], "gpl-3"), (6, full["gpl-3"].replace("is licensed", "is\nlicensed"), "gpl-3"),
            (7, full["gpl-3"].replace("gnu", "gnu\n"), "gpl-3"), (8, full["agpl-3"].replace("gnu", "gnu\n"), "agpl-3"), (9, "\n".join(["all", noise(), noise(), "rights reserved"]), ""),
            (10, "all rights\nreserved", "all-rights-reserved"), (11, "\n".join(full["bsd"].split()), "bsd"), (12, f"{full['gpl-3']}\n{noise()}\n{full['agpl-3']}", "agpl-3,gpl-3")]
    rows += [(100 + 2 * i + (k > 1), f"{noise()} {' '.join(t.split()[:k])}\n{' '.join(t.split()[k:])} {noise()}", licenses.SAME_LABEL.get(name, name)) for i, (name, t) in enumerate(full.items()) for k in (1, len(t.split()) // 2)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), ["doc_id"]).collect()}
    for i, _, want in rows:
        assert got[i]["labels"] == want, i
    assert [(b["line"], b["last_line"], b["label"]) for b in got[3]["blocks"]] == [(1, 2, "bsd"), (4, 5, "mit")] and got[1]["score"] == 1


def test_license_scan_of_scattered_words_copies_and_long_texts(spark, words):
    g, notice = random.Random(22), "Released under the MIT License."
    long = " ".join(g.choices(words, k=50_000)) + "\n" + notice + "\n" + " ".join(g.choices(words, k=50_000))
    rows = [(1, "reserved seats for all members of the human rights board", ""), (2, notice, "mit"), (2, notice, "mit"), (3, long, "mit"), (4, "under the mit license " * 40_000, "mit")]
    got = licenses.scan(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, labels string, blocks string, line string"), ["doc_id", "line"]).collect()
    assert sorted((r["doc_id"], r["labels"]) for r in got) == sorted((i, x) for i, _, x in rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[3]["n_base"], by[3]["first_word"]) == (1, 50_001) and (by[4]["n_base"], by[4]["last_word"]) == (40_000, 4 * 39_999)


def test_license_windows_equal_brute_force(words):
    g, vocab = random.Random(13), sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    matcher = licenses.Matcher(*licenses.build(licenses.TEMPLATES, {}, licenses.THRESHOLD))
    hits = 0
    for _ in range(400):
        parts = [x for t in g.choices(list(licenses.TEMPLATES.values()), k=3) for x in (*t.split(), *g.choices(vocab + words[:50], k=g.randint(0, 9)))]
        text = [x.encode() for x in parts if g.random() > 0.04]
        for t, template in enumerate(matcher.templates):
            want = max(len(matcher.sets[t].intersection(text[i : i + template.span])) for i in range(len(text)))
            got = max((len(x[2]) for x in matcher.windows(text, t)), default=0)
            assert got == (want if want >= template.needed else 0)
            hits += got > 0
    assert hits > 400


def test_rare_languages_and_copies_in_the_sample(spark):
    g = random.Random(14)
    vocab = {"en": ["the", "house", "which", "with", "they"], "de": ["das", "haus", "welche", "nicht", "über"], "ru": ["это", "дом", "который", "они"]}
    make = lambda la: " ".join(g.choices(vocab[la], k=20))
    rows = [(make("en"), "en") for _ in range(2000)] + [(make("de"), "de") for _ in range(300)] + [(make("ru"), "ru") for _ in range(5)]
    rows += [(" ".join(vocab["en"] * 4), "en")] * 1000  # a third of all rows
    df = spark.createDataFrame(rows, "text string, lang string").persist()
    got = collections.Counter(r["lang"] for r in langid.drawn(df, 200, 20).collect())
    assert got["ru"] == 5 and 5 <= got["de"] <= 60 and 120 <= got["en"] <= 230
    assert collections.Counter(r["lang"] for r in langid.drawn(df, 5000, 20).collect()) == collections.Counter(la for _, la in set(rows))
    model = langid.fit(df, rows=20, least=5)
    assert model.langs == ["de", "en", "ru"]
    assert langid.label([make("ru"), make("de")], model)[0] == ["ru", "de"]


def test_words_split_at_scripts_and_keep_marks():
    w = langid.words_of(["hello中文world हिन्दी में", "́ x", None, "12"])
    assert (w.doc.tolist(), w.length.tolist(), w.script.tolist()) == ([0, 0, 0, 0, 0, 1], [5, 2, 5, 6, 3, 1], [1, 11, 1, 7, 7, 1])


def test_many_languages_ties_and_texts_in_parts():
    g, r, k = np.random.default_rng(0), random.Random(1), 200
    model = langid.Model([f"l{i:03}" for i in range(k)], g.normal(0, 1, (langid.BUCKETS, k)).astype(np.float32), np.zeros((langid.N_SCRIPTS, k), np.float32))
    scores = np.full((4, k), -8, np.float32)
    scores[:, 170] = 0
    assert langid.viterbi(scores, np.zeros(4, int), 1).tolist() == [170] * 4
    texts = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 8))) for _ in range(n)) for n in (50, 3, 400)] + [None, "", "a" * 300]
    whole, parts = langid.label(texts[:5], model), langid.label(texts[:5], model, part=60)
    assert whole[0] == parts[0] and whole[2] == parts[2] and whole[1] == pytest.approx(parts[1])
    assert langid.label(texts[5:], model, part=60)[2][0][0]["words"] == 5  # a word without an end is cut
    even = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros((langid.N_SCRIPTS, 2), np.float32))
    assert langid.label(["some words"], even)[0] == ["a"]


def test_language_scores_equal_plain_sums(spark):
    """Counts, probabilities, word scores and the score column by hand, for two languages."""
    train = spark.createDataFrame([("aab ab", "x"), ("ba bb", "y"), ("ba bb", "y")], "text string, lang string")
    model = langid.fit(train)
    counts = {la: collections.Counter() for la in "xy"}

    def grams(word):
        out, padded = [], f" {word} "
        for order in langid.ORDERS:
            for end in range(2, len(padded) + 1):
                out.append((order, padded[max(0, end - order) : end]))
        return out

    bucket = {}
    for word in {"aab", "ab", "ba", "bb"}:
        w = langid.words_of([word])
        for k, order in enumerate(langid.ORDERS):
            for at, gram in enumerate(x for o, x in grams(word) if o == order):
                bucket[order, gram] = int(w.grams[k][at])
    assert len(set(bucket.values())) == len(bucket)
    for text, la in (("aab ab", "x"), ("ba bb", "y")):
        for word in text.split():
            counts[la].update(grams(word))
    total = {la: sum(c.values()) + langid.SMOOTH * langid.BUCKETS for la, c in counts.items()}
    for word in ("aab", "bb"):
        raw = np.array([sum(math.log((counts[la][x] + langid.SMOOTH) / total[la]) for x in grams(word)) for la in "xy"])
        raw = np.maximum(raw - raw.max(), -langid.CAP)
        assert model.scores(langid.words_of([word]))[0] == pytest.approx(raw, abs=1e-3)
        names, score, _ = langid.label([word], model)
        assert names == ["xy"[int(raw.argmax())]] and score[0] == pytest.approx(math.exp(0) / np.exp(raw).sum(), abs=1e-3)


def test_lines_at_the_ratio_spaces_and_long_pages(spark):
    long = "\n".join(f"line {i} of a long page" for i in range(20_000))
    pages = [(i, "h", f"\tmenu \nonce {i}") for i in range(5)] + [(i, "h", f"x {i}\nmenu") for i in range(5, 6)] + [(i, "h", f"y {i}") for i in range(6, 12)]
    pages += [(20, "g", long)] * 2 + [(21, "g", "other")]
    df = spark.createDataFrame([(*p, "a") for p in pages], "page_id long, host string, text string, n_lines string")
    at, above = lines.drop_boilerplate(df, 0.5, 3), lines.drop_boilerplate(df, 0.49, 3)
    assert at.filter("n_dropped > 0").count() == 0  # 6 of 12 pages are not more than half of them
    got = {r["page_id"]: (r["text"], r["n_dropped"]) for r in above.filter("host = 'h'").collect()}
    assert got[2] == ("once 2", 1) and got[5] == ("x 5", 1) and got[8] == ("y 8", 0)
    assert at.filter("page_id = 20").select("text", "n_lines").distinct().collect() == [(long, 20_000)]


@needs_vocabulary
def test_all_segmentations_of_a_word_by_enumeration():
    """Log probabilities, inclusion scores and draws against a list of every segmentation."""
    lat = pieces.lattices(pieces.VOCABULARY, 1.0)
    v, word = lat.v, " " + "hats"
    text = word.replace(" ", pieces.SPACE)

    def cuts(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in v.ids or n == 1:
                for tail in cuts(rest[n:]):
                    yield (rest[:n], *tail)

    weight = {c: -sum(v.weight[v.ids[p]] if p in v.ids else 3 * v.weight[-1] for p in c) for c in cuts(text)}
    norm = math.log(sum(math.exp(w) for w in weight.values()))
    want = {tuple(v.ids[p] for p in c): w - norm for c, w in weight.items()}
    n, first, pairs = 6000, collections.Counter(), collections.Counter()
    for start in range(0, n, 1000):
        for found in pieces.sample(["hats"] * 1000, [pieces.row_key(start + i, 5) for i in range(1000)], lat, 2):
            a, b = (tuple(s.ids.tolist()) for s in found)
            assert found[0].log_prob == pytest.approx(want[a], abs=1e-9) and found[1].log_prob == pytest.approx(want[b], abs=1e-9)
            first[a] += 1
            pairs[a, b] += 1
    p = {c: math.exp(x) for c, x in want.items()}
    for a in p:
        assert first[a] / n == pytest.approx(p[a], abs=0.03)
        for b in p:  # the second is drawn among the others
            if a != b:
                assert pairs[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.03)
    everything = pieces.sample(["hats"], [9], lat, len(want) + 3)[0]
    assert {tuple(s.ids.tolist()) for s in everything} == set(want) and all(s.inclusion == 1 for s in everything)


def test_mix_equals_a_replayed_plan(spark, corpus):
    """Every document's words are laid out block by block in plain Python."""
    spec = mixing.MixSpec(block_words=8, shard_blocks=16)
    got = mixing.mix(corpus, spec, ["doc_id", "source"]).collect()
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["sid"], r["shard"]].append(r)
    source = collections.defaultdict(lambda: [0, 0, 0.0])
    for rows in shards.values():
        rows.sort(key=lambda r: (r["to"], r["from"]))
        tokens = sum(r["size"] for r in rows)
        n = max(1, round(tokens / 8)) if tokens else 0
        edges, times = [i * tokens // n for i in range(n + 1)] if n else [0], {}
        for r in rows:
            for i, t in enumerate(r["times"]):
                at = edges.index(r["edges"][i])
                assert r["edges"][i + 1] == edges[at + 1] and times.setdefault(at, t) == t
        block = [i for i in range(n) for _ in range(edges[i + 1] - edges[i])]
        assert [r["to"] - r["from"] for r in rows] == [r["size"] for r in rows] and (not rows or rows[-1]["to"] == tokens)
        for r in rows:
            assert r["taken"] == sum(times[block[w]] for w in range(r["from"], r["to"]))
        source[rows[0]["sid"]][0] += sum(times.values())
        source[rows[0]["sid"]][1] += n
        source[rows[0]["sid"]][2] = rows[0]["target"]
        assert not times or max(times.values()) - min(times.values()) <= 1
    names = sorted({(r["source"] is None, r["source"] or "", r["sid"], r["source_size"]) for r in got})
    assert [x[2] for x in names] == list(range(len(names)))
    want = mixing.targets([x[3] for x in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5, 2.0)
    units = [max(1, round(x[3] / 8)) if x[3] else 0 for x in names]
    seats = mixing.apportion(want, round(sum(want) / 8), [2.0 * u for u in units])
    for i, q in enumerate(seats):
        assert source[i][2] == want[i] and abs(source[i][0] - min(q, 2 * source[i][1])) <= 0


def test_rows_that_share_an_id_are_kept_apart(spark, words):
    import corpus_pipeline as P

    g = random.Random(15)
    a, b, c = (" ".join(g.choices(words, k=30)) for _ in range(3))
    rows = [(1, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (5, b, "en", "s"), (None, c, "en", "s"), (None, c, "en", "t"), (None, c.upper(), "en", "s")]
    kept = P.near_duplicates(spark, docs_of(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"].lower()) for r in kept), key=repr) == sorted([(1, a), (5, b), (None, c)], key=repr)
    assert P.near_duplicates(spark, docs_of(spark, []), "").count() == 0


def test_top_k_of_copies_reads_few_exact_vectors(spark):
    """A third of all rows share one vector; the rest lie in clusters."""
    g = np.random.default_rng(8)
    centres = g.normal(0, 1, (40, 16))
    v = [list(map(float, centres[i % 40] / 4 + g.normal(0, 0.02, 16))) for i in range(2000)]
    rows = [(i, v[i], "x") for i in range(2000)] + [(2000 + i, v[7], "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(7)
    e = np.floor(np.array([r[1] for r in rows]) * 64).astype(int)
    got = collections.defaultdict(list)
    for r in vectors.top_k(df, 9, 30, block=200, query_block=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 3000, 30):
        order = np.lexsort((np.arange(3000), -(e @ e[q])))
        best = [i for i in order.tolist() if i != q][:9]
        assert sorted(got[q]) == [(n + 1, i, int(e[i] @ e[q])) for n, i in enumerate(best)]
    asks, found = vectors.search(df, 9, 30, block=200, query_block=20)
    reads = found.agg(F.sum("reads")).first()[0]
    assert reads < 0.1 * found.count() * 2000


def test_top_k_with_split_keys_random_vectors_and_odd_lengths(spark):
    """Joins that AQE splits, vectors without structure, empty ones and large components."""
    g = np.random.default_rng(18)
    rows = [(i, list(map(float, g.normal(0, 0.125, 64)))) for i in range(1500)] + [(2000, []), (2010, []), (3000, [1e9, 2.0]), (3020, [-1e9, 3.0]), (3040, [5.5, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    aqe = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0"}
    before = {k: spark.conf.get(k, None) for k in aqe}
    for k, v in aqe.items():
        spark.conf.set(k, v)
    got = collections.defaultdict(list)
    for r in vectors.top_k(df, 7, 10, block=100, query_block=50, group=2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)
    e = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(np.int64)) for i, v in rows]
    for q, x in e:
        if q % 10 == 0:
            best = sorted((-int(x @ y), i) for i, y in e if i != q and len(y) == len(x))[:7]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], q


def test_fingerprints_equal_a_plain_reimplementation(spark, words):
    """Words, draws, samples and the packed minimum of each lane in plain Python, with the same hashes."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    g = random.Random(21)
    texts = {i: " ".join(g.choices(words, k=n)) for i, n in enumerate((1, 5, 40, 400))}
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, text in texts.items():
        counts = collections.Counter(xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split())
        lanes = []
        for lane in range(fingerprint.LANES):
            best = None
            for word, n in counts.items():
                x = xxhash.xxh64_intdigest(struct.pack("<i", lane), xxhash.xxh64_intdigest(struct.pack("<Q", word), 42))
                y = xxhash.xxh64_intdigest(struct.pack("<i", 1), x)
                u = lambda bits, at: ((bits >> at & (1 << 21) - 1) + 0.5) / (1 << 21)
                r, ln_c, beta = -math.log(u(x, 0) * u(x, 21)), math.log(-math.log(u(y, 0) * u(y, 21))), u(x, 42)
                step = math.floor(math.log(n) / r + beta)
                order = int((ln_c - r * (step - beta + 1.0) + 128.0) * (1 << 31))
                mark = (signed(word) ^ step * 10368889) & (1 << 24) - 1
                best = min(x for x in (best, order << 24 | mark) if x is not None)
            lanes.append(f"{best & (1 << 24) - 1:06x}")
        assert got[i] == "".join(lanes)


def test_pipeline_on_an_empty_table_and_very_long_texts(spark, words, tmp_path):
    import corpus_pipeline as P

    docs_of(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    g = random.Random(23)
    long = "\n".join(" ".join(g.choices(words, k=12)) for _ in range(20_000))
    docs_of(spark, [(1, long, "en", "s"), (2, "some few words of one kind here", "en", None), (2, "quite another text with this id", "en", None)]).write.parquet(f"{tmp_path}/long/documents.parquet")
    out = P.run(spark, f"{tmp_path}/long").collect()
    assert {r["doc_id"] for r in out} == {1, 2} and all(r["round_trip"] for r in out) and len({r["row_hash"] for r in out if r["doc_id"] == 2}) == 2


def test_line_dedup_stage_equals_counted_lines(spark, words):
    import corpus_pipeline as P

    g = random.Random(24)
    pool = [" ".join(g.choices(words, k=6)) for _ in range(60)]
    rows = [(i, "\n".join([*g.choices(pool, k=3), *(" ".join(g.choices(words, k=6)) for _ in range(3))]), "en", f"s{i % 2}") for i in range(150)]
    rows += [(500 + i, rows[i][1], "en", rows[i][3]) for i in range(20)]
    at, pages = collections.Counter(), collections.Counter()
    for source, text in {(r[3], r[1]) for r in rows}:
        pages[source] += 1
        at.update((source, x) for x in {*text.split("\n")})
    gone = {k for k, n in at.items() if n >= lines.LEAST and n > P.SOURCE_RATIO * pages[k[0]]}
    want = {r[0]: "\n".join(x for x in r[1].split("\n") if (r[3], x) not in gone) for r in rows}
    got = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, docs_of(spark, rows), "").collect()}
    assert got == {i: x for i, x in want.items() if x} and gone
