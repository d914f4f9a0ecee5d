r"""Operator 6: language ID of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters of one script with the marks on them (`हिन्दी` is one word, `hello中文` two). A word's script
comes from code point ranges; only languages that use this script in training compete for it. A word's score for a
language is the sum of log probabilities of its character n-grams (2 to 4, with word edges), hashed to BUCKETS counters.
The best label path over a text's words pays SWITCH for each change of language; runs of equal labels are the spans. A
document's language is that of most of its letters, and its score the share of letters so labelled times the mean
certainty of the words' scores there.

Fitting uses distinct labelled texts: of each language at most its share of FIT_ROWS or FIT_LEAST, whichever is more,
those with the smallest hashes. Only counters come to the driver: at most MAX_LANGS x (BUCKETS + scripts) numbers and
one row for each language, whatever the size of the corpus; more languages raise an error. Prediction reads every whole
text once and shuffles nothing. A text of more than PART characters is read in parts between words, and the state of the
path is carried from part to part, so arrays are bounded by CHUNK bytes of text, or one part, plus two numbers for each word and
language of one text.

Cases: null text or a text without letters is `und` with score 0; with nothing to learn from, everything is; ties go
to the language that sorts first; repeated rows are predicted each; a word of more than PART letters is cut; an empty
table gives no rows; columns besides text and `keep` are ignored, whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.llm.common import chunks, release, schema_of, table

BUCKETS, FIT_ROWS, SWITCH, ORDERS, SMOOTH, SCRIPT_SHARE, CAP = 1 << 16, 20_000, 6.0, (2, 3, 4), 0.5, 0.005, 8.0
FIT_LEAST, MAX_LANGS, PART, CHUNK = 2_000, 256, 1 << 20, 1 << 19
#: Script ranges as (first code point, script); a range ends where the next one starts. Script 0 is "other".
SCRIPTS = [
    (0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0xE00, 8), (0xE80, 0),
    (0x10A0, 9), (0x1100, 10), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 1), (0x2E80, 11), (0x3040, 12), (0x3100, 11),
    (0xAC00, 10), (0xD7B0, 0), (0xF900, 11), (0xFB00, 1), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 12), (0xFFA0, 10), (0x10000, 0), (0x20000, 11),
]
N_SCRIPTS = 13
_RANGE = 1 << 60


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter (str.isalpha), is it a mark on a letter, and its script."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    mark = np.fromiter((unicodedata.category(chr(c)) in ("Mn", "Mc") for c in range(0x110000)), np.bool_, 0x110000)
    starts, kinds = zip(*SCRIPTS, strict=True)
    script = np.array(kinds, np.int8)[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
    return alpha, mark, script


@dataclass
class Words:
    """The words of some texts: doc, first letter, length and script of each, and the n-gram features of all letters."""

    doc: np.ndarray
    length: np.ndarray
    script: np.ndarray
    first: np.ndarray  # of the word's features in `grams`
    grams: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    alpha, mark, script = letters()
    lower = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) for t in lower), np.int64, len(lower))
    # a space between texts, and some around all
    codes = np.frombuffer((" " * 4 + " ".join(lower) + " " * 4).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter, kind = alpha[codes], script[codes]
    if (marks := mark[codes]).any():  # a mark belongs to the letter before it
        base = np.maximum.accumulate(np.where(marks, 0, np.arange(len(codes))))
        is_letter, kind = is_letter[base], kind[base]
    edge = np.flatnonzero((is_letter[1:] != is_letter[:-1]) | is_letter[1:] & (kind[1:] != kind[:-1])) + 1
    begin = edge[is_letter[edge]]
    end = np.append(edge, len(codes))[np.searchsorted(edge, begin, side="right")]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 4
    doc = np.searchsorted(starts, begin, side="right") - 1
    n = end - begin
    # n-grams that end at each letter or at the space behind a word; an n-gram never reaches over the word's edges
    span = n + 1
    first = np.concatenate([[0], np.cumsum(span)])
    at = np.repeat(begin - first[:-1], span) + np.arange(first[-1])
    room = at - np.repeat(begin, span) + 2  # code points from the space before the word up to here
    masked = np.where(is_letter, codes, 32)
    grams = np.empty((len(ORDERS), first[-1]), np.int64)
    for k, order in enumerate(ORDERS):
        h = np.full(first[-1], order, np.uint64)
        for back in range(order):
            c = masked[at - np.minimum(back, room - 1)]
            h = (h ^ np.where(back < room, c, 0).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        grams[k] = (h % np.uint64(BUCKETS)).astype(np.int64)
    return Words(doc, n, kind[begin].astype(np.int64), first, grams)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages, the mean over languages is 0 in each row
    allowed: np.ndarray  # scripts x languages, 0 or a large negative number

    def scores(self, w: Words) -> np.ndarray:
        if not len(w.doc):
            return np.zeros((0, len(self.langs)), np.float32)
        per_letter = self.logp[w.grams[0]]
        for g in w.grams[1:]:
            per_letter = per_letter + self.logp[g]
        s = np.add.reduceat(per_letter, w.first[:-1], axis=0)
        s -= s.max(axis=1, keepdims=True)
        np.maximum(s, -CAP, out=s)  # one odd word must not outweigh a sentence
        return s + self.allowed[w.script]


def drawn(labelled: DataFrame, rows: int, least: int) -> DataFrame:
    """Distinct (text, lang): of each language its share of `rows` at most, or `least` if that is more, or all."""
    keyed = labelled.withColumn("_h", F.xxhash64("text"))
    # counted by hash, so that no text is shuffled before the draw
    sizes = keyed.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    total = sum(r["n"] for r in sizes)
    if not total:
        return labelled
    quota = {r["lang"]: math.ceil(max(rows * r["n"] / total, least)) for r in sizes}
    # somewhat more than the quota by a threshold, so that few texts are ranked, then exactly
    cuts = {r["lang"]: min(_RANGE, math.ceil((1.1 * quota[r["lang"]] + 100) / r["n"] * _RANGE)) for r in sizes}

    def of_lang(values: dict[str, int]) -> Column:
        return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("lang")]

    place = F.col("_h").bitwiseAND(F.lit(_RANGE - 1))
    some = keyed.filter(place < of_lang(cuts)).dropDuplicates(["_h", "lang"])
    ranked = some.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy(place, "_h")))
    return ranked.filter(F.col("_n") <= of_lang(quota)).drop("_h", "_n")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS, least: int = FIT_LEAST) -> Model:
    """Learn from docs' distinct labelled texts, at most a language's share of `rows` or `least` of it."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = drawn(labelled, rows, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in chunks(batch, "text", CHUNK):
                langs = b.column("lang").to_pylist()
                w = words_of(b.column("text").to_pylist())
                of = np.repeat(w.doc, w.length + 1)
                for name in set(langs):
                    mine = np.fromiter((x == name for x in langs), np.bool_, len(langs))
                    t = total.setdefault(name, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    for g in w.grams:
                        t[:BUCKETS] += np.bincount(g[mine[of]], minlength=BUCKETS)
                    t[BUCKETS:] += np.bincount(w.script[mine[w.doc]], minlength=N_SCRIPTS)
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": at.astype(np.int32), "n": t[at]})
        release()

    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    langs = sorted(set(got["lang"]))
    n = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    if len(got):
        n[got["bucket"].to_numpy(), [langs.index(x) for x in got["lang"]]] = got["n"]
    grams, scripts = n[:BUCKETS] + SMOOTH, n[BUCKETS:]
    logp = np.log(grams / grams.sum(axis=0, keepdims=True)) if langs else grams
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    fits = share >= SCRIPT_SHARE
    fits[~fits.any(axis=1)] = True  # a script that no language uses says nothing
    logp = logp - logp.mean(axis=1, keepdims=True) if langs else logp
    return Model(langs, logp.astype(np.float32), np.where(fits, 0.0, -50.0).astype(np.float32))


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. Documents advance together, word by word, the longest first."""
    labels = np.zeros(len(doc), np.int64)
    sizes = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
    sizes = sizes[order]
    if not len(doc):
        return labels
    longest = sizes[0]
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # documents with a word t
    best = scores[starts[: active[0]]].copy()
    back = np.zeros(scores.shape, np.int16)
    came = np.arange(scores.shape[1])
    for t in range(1, longest):
        a = active[t]
        best_a = best[:a]
        top = best_a.argmax(axis=1)
        jump = best_a[np.arange(a), top] - switch
        stay = best_a >= jump[:, None]
        at = starts[:a] + t
        back[at] = np.where(stay, came, top[:, None])
        best[:a] = np.where(stay, best_a, jump[:, None]) + scores[at]
    now = best.argmax(axis=1)
    full = active[0]
    state = np.zeros(len(sizes), np.int64)
    state[:full] = now
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return labels


def _parts(text: str, size: int) -> Iterator[str]:
    """A text in parts of at most `size` characters, cut between words where there is such a place."""
    alpha, mark, _ = letters()
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            codes = np.frombuffer(text[at : end + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            outside = np.flatnonzero(~(alpha[codes] | mark[codes]))
            end = at + int(outside[-1]) if len(outside) and outside[-1] else end
        yield text[at:end]
        at = end


def long_path(text: str, model: Model, switch: float = SWITCH, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, length, certainty of each label) of the words of one text that is read in parts."""
    k = len(model.langs)
    best, came, backs, sizes = np.zeros(k, np.float32), np.arange(k, dtype=np.int16), [], []
    for x in _parts(text, part):
        w = words_of([x])
        s = model.scores(w)
        back = np.empty((len(s), k), np.int16)
        for t in range(len(s)):
            jump, top = best.max() - switch, best.argmax()
            stay = best >= jump
            back[t] = np.where(stay, came, top)
            best = np.where(stay, best, jump) + s[t]
        best = best - best.max(initial=-np.inf)
        backs.append(back)
        sizes.append((w.length.astype(np.int64), np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)))
    path, state = [], int(best.argmax())
    for back in reversed(backs):
        own = np.empty(len(back), np.int64)
        for t in range(len(back) - 1, -1, -1):
            own[t] = state
            state = int(back[t, state])
        path.append(own)
    return np.concatenate(path[::-1]), np.concatenate([n for n, _ in sizes]), np.concatenate([p for _, p in sizes])


def label(texts: list[str | None], model: Model, switch: float = SWITCH, part: int = PART) -> tuple[list[str], list[float], list[list[dict]]]:
    """(language, score, spans) of each text; a span is (lang, words) in order."""
    n, k = len(texts), len(model.langs)
    if not k:
        return ["und"] * n, [0.0] * n, [[] for _ in range(n)]
    long = [i for i, t in enumerate(texts) if t and len(t) > part]
    w = words_of([None if t and len(t) > part else t for t in texts])
    s = model.scores(w)
    doc, length, path = w.doc, w.length, viterbi(s, w.doc, n, switch)
    p = np.exp(s - s.max(axis=1, keepdims=True, initial=-np.inf))
    p /= p.sum(axis=1, keepdims=True)
    for i in long:
        own, size, certainty = long_path(texts[i], model, switch, part)
        at = np.searchsorted(doc, i)
        doc, length, path = (np.insert(x, at, y) for x, y in ((doc, np.full(len(own), i)), (length, size), (path, own)))
        p = np.concatenate([p[:at], certainty, p[at:]])
    votes = np.zeros((n, k))
    np.add.at(votes, (doc, path), length)
    total = votes.sum(axis=1)
    pick = votes.argmax(axis=1)
    mine = path == pick[doc]
    sure = p[np.arange(len(path)), pick[doc]]
    certain = np.bincount(doc, sure * length * mine, n) / np.maximum(np.bincount(doc, length * mine, n), 1)
    score = np.where(total > 0, votes.max(axis=1) / np.maximum(total, 1) * certain, 0.0)
    cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])[: len(path)])
    spans: list[list[dict]] = [[] for _ in range(n)]
    for i, c in zip(cut.tolist(), np.diff(np.append(cut, len(path))).tolist(), strict=True):
        spans[doc[i]].append({"lang": model.langs[path[i]], "words": c})
    return [model.langs[pick[i]] if total[i] else "und" for i in range(n)], np.clip(score, 0, 1).tolist(), spans


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))


def detect(docs: DataFrame, model: Model, keep: list[str], switch: float = SWITCH, inside: str | None = None, spans: bool = True) -> DataFrame:
    """`keep` columns with lang_pred, score and, if wanted, spans (lang, words); only `text` is an input.

    inside: a struct among `keep` that has the text, which then isn't sent twice.
    """
    names = ["lang_pred", "score", *(["spans"] if spans else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(inside).field("text") if inside else batch.column("_text")
            whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text], [*keep, "_text"])
            for b in chunks(whole, "_text", CHUNK):
                found = label(b.column("_text").to_pylist(), model, switch)
                new = [pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), SPANS), strict=True)][: len(names)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], [*keep, *names])
        release()

    schema = schema_of(docs, keep, "lang_pred string, score double" + (", spans array<struct<lang: string, words: int>>" if spans else ""))
    return docs.select(*keep, *([] if inside else [F.col("text").alias("_text")])).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = detect(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
