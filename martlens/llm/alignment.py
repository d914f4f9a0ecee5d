r"""Operator 12: alignment of the tokens of two tokenizers through a static interval index.

Both tokenizers cut the same bytes: space + text by A, a byte-level BPE, and text by B, a piece BPE that puts the space
before it itself. B's tokens are intervals of bytes, kept as sorted starts and ends. Each A token stabs that index by
bisection: the first B token that ends after its start and the last that starts before its end are the list that it
overlaps. A gap between two B tokens is spanned if any list reaches over it; the gaps never spanned are the ends of
groups, which are exactly the offsets where tokens of both end. All A-B pairs of a group are links.

Neither tokenizer's tokens reach from a character that is no white space into a space or line end behind it (A's
pre-tokenizer cuts there, and no piece of B holds such a place: looked up when the vocabulary is read; other vocabularies
are given whole texts). So a text is a sequence of units that start with a space or a line end, and each unit is encoded
and aligned once for each chunk of texts, or found in a cache of UNITS units.

1. Chunks of about CHUNK bytes of text, or one text, become records: a dictionary of units with their tokens and groups,
   each text as a sequence of units, and for each id pair that is linked in the chunk the number of its texts.
2. Counts of the chunks add up to the corpus' counts, and the highest of each A id is found.
3. Each chunk asks for the counts of its pairs, once for each pair whatever the number of its texts, and adds them up for
   its texts.

Scale: texts are read and encoded once. What is shuffled are distinct pairs of chunks, two longs each, and the records
once, packed to about the bytes of compressed texts; a pair that every text links is a row for each chunk only. The highest counts,
one row for each id of A, are at most A's vocabulary and broadcast. The driver gets no rows. A task holds one chunk.

Cases: null and empty texts, and texts whose tokens' bytes aren't space + text (B knows U+2581 as space only, and leaves out
what it normalises away), have no tokens: zeros and empty groups. Strings of special tokens in texts are plain text. Repeated
rows count as documents each; ties for the highest count are all best; a null key is a key; very long texts are whole,
encoded unit by unit, at some 20 bytes for each word; long groups of few ids, such as runs of spaces, cost their distinct
ids, not their pairs; an empty table gives no rows; columns besides text and `keep` are ignored,
whatever their names; `keep` names one column at least, none called like a result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import chunks, release, schema_of, ship, stash, table

A_VOCABULARY, B_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, UNITS, TOKENS, SLICE, RUN = 1 << 22, 1 << 18, 1 << 21, 1 << 20, 4096
SPACE = "▁"
#: A unit: a space or line end, white space, and what follows up to a space or line end that doesn't follow white space.
_UNIT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_EDGE = re.compile(r"\S(?=[ \n])")
_WHOLE = re.compile(r"(?s).+")
_CROSSING = re.compile(rf"[^{SPACE}]{SPACE}|[ \n]")


def slices(text: str) -> Iterator[str]:
    """A long text in parts of about SLICE characters, cut where units end."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + SLICE)
        end = edge.end() if edge else len(text)
        yield text[at:end]
        at = end


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of `counts` places, one run after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def groups_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, from the tokens' numbers of bytes; both have the same sum."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    first = np.searchsorted(b_ends, a_ends - a_sizes, "right")
    last = np.searchsorted(b_ends - b_sizes, a_ends, "left") - 1
    spanned = np.zeros(len(b_sizes) + 1, np.int64)
    np.add.at(spanned, first, 1)
    np.add.at(spanned, last, -1)
    b_group = np.zeros(len(b_sizes), np.int64)
    b_group[1:] = np.cumsum(np.cumsum(spanned)[: len(b_sizes) - 1] == 0)
    return b_group[first], b_group


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the units that a worker has met, their tokens and groups in flat arrays."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_raw[i] = bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, raw), np.int64, len(raw)) for raw in (self.a_raw, self.b_raw))
        self.space = self.b.piece_to_id(SPACE)
        before = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        apart = before.get("type") == "ByteLevel" and before.get("use_regex") and not any(map(_CROSSING.search, pieces))
        self.unit = _UNIT if apart else _WHOLE
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.fresh: list[str] = []
        self.fine = np.zeros(0, bool)
        # ids of tokens, and for each group its numbers of A and of B tokens; with the place of each unit in these
        self.flat = {c: np.zeros(0, np.int32) for c in ("a", "b", "ga", "gb")}
        self.starts = {c: np.zeros(0, np.int64) for c in self.flat}
        self.ends = {c: np.zeros(0, np.int64) for c in self.flat}

    def number(self, text: str) -> np.ndarray:
        """The units of space + text, by number; new ones are encoded by `learn`."""
        known, parts = self.known, []
        for part in slices(f" {text}") if self.unit is _UNIT else [f" {text}"]:
            units = self.unit.findall(part)
            for u in set(units).difference(known):
                known[u] = len(known)
                self.fresh.append(u)
            parts.append(np.fromiter(map(known.__getitem__, units), np.uint32, len(units)))
        return np.concatenate(parts)

    def _encode(self, units: list[str]) -> tuple[list[int], list[int]]:
        """Both tokenizers' ids of some units, one after the other as one text."""
        text = "".join(units)
        b = self.b.encode(text.removeprefix(" "), num_threads=1) if text != " " else [self.space]
        if text[0] == "\n":  # the space that B puts before it is not there
            b = b[1:] if b[:1] == [self.space] else []
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, b

    def _exact(self, units: list[str]) -> tuple[list[int], list[int]] | None:
        """The ids, if the bytes of both are those of the units."""
        a, b = self._encode(units)
        raw = "".join(units).encode()
        return (a, b) if b"".join(map(self.a_raw.__getitem__, a)) == raw == b"".join(map(self.b_raw.__getitem__, b)) else None

    def learn(self) -> None:
        """Encode and align the new units: RUN of them as one text, as tokens don't reach over their ends."""
        if not self.fresh:
            return
        fresh, self.fresh = self.fresh, []
        # white space at a unit's end belongs to what follows it, so such a unit is a text of its own
        joint = [i for i, u in enumerate(fresh) if self.unit is _UNIT and not u[-1].isspace()]
        alone = sorted(set(range(len(fresh))).difference(joint))
        fine, order, ids = np.ones(len(fresh), bool), [], {"a": [], "b": []}
        runs = [joint[i : i + RUN] for i in range(0, len(joint), RUN)] + [[i] for i in alone]
        for run in runs:
            found = self._exact([fresh[i] for i in run])
            for some in [run] if found or len(run) == 1 else [[i] for i in run]:
                found = found if some is run else self._exact([fresh[some[0]]])
                if found is None:
                    fine[some] = False
                    continue
                order += some
                for c, x in zip("ab", found, strict=True):
                    ids[c].append(x)
        sizes = np.zeros(len(fresh), np.int64)  # bytes of a unit in the order of the ids; one without ids has none
        sizes[: len(order)] = np.fromiter((len(fresh[i].encode()) for i in order), np.int64, len(order))
        new = {c: np.fromiter(chain.from_iterable(x), np.int32) for c, x in ids.items()}
        of_a, of_b = groups_of(self.a_size[new["a"]], self.b_size[new["b"]]) if order else (np.zeros(0, np.int64),) * 2
        new |= {"ga": np.bincount(of_a).astype(np.int32), "gb": np.bincount(of_b).astype(np.int32)}
        ends = np.cumsum(sizes)
        upto = {c: np.searchsorted(np.cumsum(size[new[c]]), ends, "right") for c, size in (("a", self.a_size), ("b", self.b_size))}
        # groups end where units end; a unit has those up to its last token's
        upto["ga"] = upto["gb"] = np.append(-1, of_a)[upto["a"]] + 1
        rank = np.append(np.asarray(order, np.int64), np.flatnonzero(~fine))
        for c in self.flat:
            base = len(self.flat[c])
            starts = np.empty(len(fresh), np.int64)
            stops = np.empty(len(fresh), np.int64)
            stops[rank], starts[rank] = upto[c], np.append(0, upto[c][:-1])
            self.flat[c] = np.append(self.flat[c], new[c])
            self.starts[c], self.ends[c] = np.append(self.starts[c], base + starts), np.append(self.ends[c], base + stops)
        self.fine = np.append(self.fine, fine)

    def take(self, units: np.ndarray) -> dict[str, np.ndarray]:
        """The flat arrays and ends of some units."""
        out = {}
        for c, flat in self.flat.items():
            starts = self.starts[c][units]
            n = self.ends[c][units] - starts
            out[c], out[f"{c}_ends"] = flat[spread(starts, n)], np.cumsum(n)
        return out

    def trim(self) -> None:
        if len(self.known) > UNITS or len(self.flat["a"]) > TOKENS:
            self.clear()


@lru_cache(1)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def links_of(units: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pair, times) for each id pair of each unit, sorted by unit, and the number of links of each unit.

    A pair is a << 32 | b.
    """
    group = {c: np.repeat(np.arange(len(units[f"g{c}"]), dtype=np.int64), units[f"g{c}"]) for c in "ab"}
    kinds = {c: np.unique(group[c] << 32 | units[c], return_counts=True) for c in "ab"}
    (a, a_times), (b, b_times) = kinds["a"], kinds["b"]
    groups = np.arange(len(units["ga"]), dtype=np.int64)
    starts, ends = np.searchsorted(b >> 32, groups), np.searchsorted(b >> 32, groups, "right")
    n = (ends - starts)[a >> 32]
    at = spread(starts[a >> 32], n)
    pair = np.repeat((a & 0xFFFFFFFF) << 32, n) | (b[at] & 0xFFFFFFFF)
    times = np.repeat(a_times, n) * b_times[at]
    unit_of = np.repeat(np.arange(len(units["ga_ends"])), np.diff(units["ga_ends"], prepend=0))
    unit = unit_of[np.repeat(a >> 32, n)]
    # a pair may stand in several groups of a unit
    order = np.lexsort((pair, unit))
    unit, pair, times = unit[order], pair[order], times[order]
    first = np.flatnonzero(np.append(True, (np.diff(unit) != 0) | (np.diff(pair) != 0))[: len(unit)])
    times = np.add.reduceat(times, first) if len(first) else times
    total = _sums(times, np.searchsorted(unit[first], np.arange(len(units["ga_ends"])), "right"))
    return unit[first], pair[first], times, total


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(x))[ends], prepend=0)


@lru_cache(1)
def _numerals(n: int) -> dict[str, np.ndarray]:
    """The ids below n as text, with what may follow one."""
    return {c: np.array([f"{i}{c}" for i in range(n)], object) for c in ",|;"}


def texts_of_groups(units: dict[str, np.ndarray]) -> list[str]:
    """The groups of each unit as `a1,a2|b1;a3|b2,b3;`."""
    text = _numerals(1 << int(max(units["a"].max(initial=0), units["b"].max(initial=0))).bit_length())
    size = {c: units[f"g{c}"].astype(np.int64) for c in "ab"}
    ends = np.cumsum(size["a"] + size["b"])
    out = np.empty(int(ends[-1]) if len(ends) else 0, object)
    for c, mark in (("a", "|"), ("b", ";")):
        stop = ends - size["b"] if c == "a" else ends  # a group's A ids stand before its B ids
        out[spread(stop - size[c], size[c])] = text[","][units[c]]
        out[stop - 1] = text[mark][units[c][np.cumsum(size[c]) - 1]]
    stops = np.append(0, ends)[units["ga_ends"]].tolist()
    parts = out.tolist()
    return ["".join(parts[s:e]) for s, e in zip([0, *stops][:-1], stops, strict=True)]


_PARTS = ("a", "b", "ga", "gb")


def packed(x: np.ndarray) -> bytes:
    """Numbers that aren't negative: their width and number, and their planes of bytes, compressed."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64)


def encoded(docs: DataFrame, keep: list[str], a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """The records of chunks of texts: kept array of the rows' `keep`, sequences, units, pairs array<long> and docs array<long>."""
    a_path, b_path = ship(docs.sparkSession, a_vocabulary), ship(docs.sparkSession, b_vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(a_path(), b_path())
        for batch in batches:
            for b in chunks(batch, "text", CHUNK):
                seqs = [t.number(x) if x else np.zeros(0, np.uint32) for x in b.column("text").to_pylist()]
                t.learn()
                seqs = [s if t.fine[s].all() else s[:0] for s in seqs]
                ends = np.cumsum([len(s) for s in seqs])
                used, seq = np.unique(np.concatenate(seqs), return_inverse=True)
                units = t.take(used)
                unit, pair, _, _ = links_of(units)
                pairs, of = np.unique(pair, return_inverse=True)
                # (text, unit) once each, then (text, pair) once each
                text = np.repeat(np.arange(len(seqs), dtype=np.int64), np.diff(ends, prepend=0))
                held = np.unique(text * max(1, len(used)) + seq)
                text, held = held // max(1, len(used)), held % max(1, len(used))
                starts, stops = np.searchsorted(unit, np.arange(len(used))), np.searchsorted(unit, np.arange(len(used)), "right")
                n = (stops - starts)[held]
                both = np.unique(np.repeat(text, n) * max(1, len(pairs)) + of[spread(starts[held], n)])
                count = np.bincount(both % max(1, len(pairs)), minlength=len(pairs))
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if kind else x)
                data = {"seq": seq, "ends": np.diff(ends, prepend=0)}
                data |= {c: units[c] for c in _PARTS} | {f"n_{c}": np.diff(units[f"{c}_ends"], prepend=0) for c in _PARTS[:3]}
                cols = {"kept": one(b.column("kept"), None)} | {c: pa.array([packed(x)], pa.binary()) for c, x in data.items()}
                cols |= {"pairs": one(pairs, pa.int64()), "docs": one(count, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
                t.trim()
        release()

    docs = docs.select(F.struct(*keep).alias("kept"), "text")
    rows = docs.schema["kept"].dataType.simpleString()
    parts = ", ".join(f"{c} binary" for c in ("seq", "ends", *_PARTS, "n_a", "n_b", "n_ga"))
    schema = f"kept array<{rows}>, {parts}, pairs array<bigint>, docs array<bigint>"
    return stash(docs.mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id()))


def pair_counts(records: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): how many documents hold each linked id pair, and whether none of its A id's pairs has more."""
    each = records.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = stash(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n")))
    counts = counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "n")
    top = counts.groupBy("a_id").agg(F.max("n").alias("_top"))
    return counts.join(F.broadcast(top), "a_id").select("a_id", "b_id", "n", (F.col("n") == F.col("_top")).alias("best"))  # top: at most A's vocabulary


def align(docs: DataFrame, keep: list[str], a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """`keep` columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups, `a1,a2|b1;a3|b2,b3` in ids."""
    records = encoded(docs, keep, a_vocabulary, b_vocabulary)
    counts = pair_counts(records).select(F.shiftleft(F.col("a_id").cast("long"), 32).bitwiseOR(F.col("b_id").cast("long")).alias("pair"), "n", "best")
    asked = records.select("chunk", F.explode("pairs").alias("pair")).join(counts, "pair")
    told = asked.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("_t"))
    told = told.select("chunk", F.col("_t.n").alias("n"), F.col("_t.best").alias("best"))
    met = records.drop("pairs", "docs").join(told, "chunk", "left").drop("chunk")  # a chunk without tokens asks for nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = {c: batch.column(c).slice(i, 1) for c in batch.schema.names}
                data = {c: unpacked(flat[c][0].as_py()) for c in ("seq", "ends", *_PARTS, "n_a", "n_b", "n_ga")}
                seq, ends = data["seq"], np.cumsum(data["ends"])
                units = {c: data[c] for c in _PARTS} | {f"{c}_ends": np.cumsum(data[f"n_{c}"]) for c in _PARTS[:3]}
                unit, pair, times, n_links = links_of(units)
                _, of = np.unique(pair, return_inverse=True)
                n, best = (flat[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64)[of] * times for c in ("n", "best"))
                stops = np.searchsorted(unit, np.arange(len(n_links)), "right")
                by_unit = {"n_a": data["n_a"], "n_b": data["n_b"], "n_groups": data["n_ga"], "n_links": n_links, "n_best": _sums(best, stops),
                           "count_sum": _sums(n, stops)}
                texts = texts_of_groups(units)
                starts = np.append(0, ends[:-1]).astype(np.int64)
                rows = flat["kept"].flatten()
                for at in range(0, len(ends), 256):  # a few texts at a time, as groups are longer than these
                    own = slice(at, at + 256)
                    lo, hi = int(starts[at]), int(ends[own][-1])
                    cols = [pa.array(_sums(x[seq[lo:hi]], ends[own] - lo), pa.int64()) for x in by_unit.values()]
                    groups = ["".join(map(texts.__getitem__, seq[s:e].tolist()))[:-1] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                    kept = [pc.struct_field(rows.slice(at, 256), c) for c in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept, *cols, pa.array(groups, pa.string())], [*keep, *by_unit, "groups"])
        release()

    return met.mapInArrow(run, schema_of(docs, keep, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(*(c for c in out.columns if c != "groups"), F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
