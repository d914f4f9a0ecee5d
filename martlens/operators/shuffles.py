"""What boosted trees lose when a feature's values change places among the rows: the rows' vectors never move.

A tree only asks on which side of its thresholds a value lies, so a value is the number of thresholds below it, a byte as
a rule. Rows are numbered and stand in blocks. A block sends each other block one packet with the codes of all features
and repeats in the order of their row numbers; the receiver knows whose they are, as it can walk the permutations back.
It scores its rows with tables of the trees' leaves and passes on sorted scores, which are ranked in bins.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.functions.lineage import cut, shared_folder
from martlens.functions.ordered import row_numbers
from martlens.sources import files

WALK = 256
#: Rows of a block, fewer where there would be less than four blocks a core; rows that are scored at once; scores of a bin.
LEAST_BLOCK, MOST_BLOCK, AT_ONCE, PER_BIN = 1_000, 50_000, 512, 400_000
#: Leaves of a tree at most: a bit of a word each. Powers of two times HASH differ in the five bits above SHIFT.
LEAVES, HASH, SHIFT = 32, np.uint32(0x077CB531), np.uint32(27)


def walked(i: np.ndarray, key: np.ndarray | int, n: int, back: bool = False) -> np.ndarray:
    """A bijection of 0 .. n - 1 that the key draws, or its inverse: four Feistel rounds over the numbers of an even number of bits, until below n.

    More than a quarter of those numbers are below n, so a walk of WALK steps falls short with a probability of 0.75^WALK; that is an error.
    """
    half = ((n - 1).bit_length() + 1) // 2 or 1
    mask = (1 << half) - 1

    def rounds(x: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in (4, 3, 2, 1) if back else (1, 2, 3, 4):
            if back:
                left, right = right, left
            mixed = (right * 1103515245 + k + r * 12345) & ((1 << 31) - 1)
            left = left ^ (mixed >> 5 & mask)
            if not back:
                left, right = right, left
        return left << half | right

    y = rounds(i, key)
    for _ in range(WALK):
        out = np.flatnonzero(y >= n)
        if not len(out):
            return y
        y[out] = rounds(y[out], key[out] if isinstance(key, np.ndarray) else key)
    if (y >= n).any():
        raise ArithmeticError("a permutation walked too long")
    return y


def draw_number(feature: int, repeat: int, seed: int) -> int:
    """What tells the permutation of a feature and repeat from others, with the sign that SQL's remainder has."""
    return int(math.fmod(feature * 7919 + repeat * 104_729 + seed * 15_485_863, 1 << 31))


@dataclass
class Leaves:
    """Boosted trees of at most LEAVES leaves, numbered from left to right, as tables.

    bounds: for each place in x that a tree asks for, its sorted thresholds; masks: for each of their codes and each tree,
    a word of the leaves that a row with this code can still reach. The leaf of a row is the lowest bit that is left of
    all its places. values: the leaves' weighted predictions by tree and hash of the bit, as whole numbers on a scale that
    their sums fit in 61 bits; so sums are exact in any order, and finer than a double's.
    """

    bounds: dict[int, np.ndarray]
    masks: dict[int, np.ndarray]
    values: np.ndarray

    @classmethod
    def of(cls, model) -> Leaves | None:
        """The tables of a fitted GBTClassifier; None for other models and for trees with more leaves."""
        if not hasattr(model, "treeWeights"):
            return None
        spark, weights = SparkSession.active(), model.treeWeights
        path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
        model.save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # a model's nodes
        files.delete(spark, path)
        nodes = {(r["treeID"], r["id"]): r for r in rows}
        asked: dict[int, set[float]] = {}
        for r in rows:
            if r["leftChild"] >= 0:
                s = r["split"]
                cuts = s["leftCategoriesOrThreshold"] if s["numCategories"] < 0 else [c - 0.5 for c in range(1, s["numCategories"])]
                asked.setdefault(s["featureIndex"], set()).update(cuts)
        bounds = {j: np.array(sorted(cuts)) for j, cuts in sorted(asked.items())}
        masks = {j: np.full((len(b) + 1, len(weights)), 0xFFFFFFFF, np.uint32) for j, b in bounds.items()}
        leaves: list[list[float]] = [[] for _ in weights]

        def number(tree: int, node: int) -> bool:
            r = nodes[tree, node]
            if r["leftChild"] < 0:
                leaves[tree].append(r["prediction"] * weights[tree])
                return len(leaves[tree]) <= LEAVES
            first = len(leaves[tree])
            if not number(tree, r["leftChild"]):
                return False
            s, b = r["split"], bounds[r["split"]["featureIndex"]]
            codes = np.arange(len(b) + 1)
            left = codes <= np.searchsorted(b, s["leftCategoriesOrThreshold"][0]) if s["numCategories"] < 0 else np.isin(codes, s["leftCategoriesOrThreshold"])
            masks[s["featureIndex"]][~left, tree] &= np.uint32(0xFFFFFFFF ^ ((1 << len(leaves[tree])) - (1 << first)))
            return number(tree, r["rightChild"])

        if not all(number(t, 0) for t in range(len(weights))):
            return None
        scale = 60 - math.frexp(sum(max(map(abs, each)) for each in leaves))[1]
        values = np.zeros((len(weights), LEAVES), np.int64)
        for t, each in enumerate(leaves):
            bits = np.uint32(1) << np.arange(len(each), dtype=np.uint32)
            values[t, bits * HASH >> SHIFT] = [round(math.ldexp(v, scale)) for v in each]
        return cls(bounds, masks, values)

    @cached_property
    def code(self) -> np.dtype:
        return np.min_scalar_type(max(map(len, self.bounds.values()), default=0))

    def coded(self, x: np.ndarray) -> np.ndarray:
        """Rows of vectors as codes of the places that are asked for."""
        return np.stack([np.searchsorted(b, x[:, j]) for j, b in self.bounds.items()], axis=1).astype(self.code)

    def reached(self, words: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """The values of the lowest bits of words of rows x trees."""
        at = ((words & -words) * HASH >> SHIFT).astype(np.intp)
        at += (np.arange(len(self.values)) if trees is None else trees) * LEAVES
        return self.values.ravel().take(at)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """The sums of rows of codes."""
        out = np.empty(len(codes), np.int64)
        for c in range(0, len(codes), AT_ONCE):
            part = codes[c : c + AT_ONCE]
            words = np.full((len(part), len(self.values)), 0xFFFFFFFF, np.uint32)
            for p, masks in enumerate(self.masks.values()):
                words &= masks[part[:, p]]
            out[c : c + AT_ONCE] = self.reached(words).sum(axis=1)
        return out



def _sorted(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted numbers; where most of them are equal to others, distinct ones and how many of each."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    if 2 * len(first) > len(keys):
        return keys.tobytes(), b""
    return keys[first].tobytes(), np.diff(np.r_[first, len(keys)]).tobytes()


def _rank(table: pa.Table) -> pa.Table:
    """Of all scores of a bin: the sum of twice the mean ranks of the positives, positives, rows. A score's lowest bit is its label."""
    keys = [np.frombuffer(b, np.int64) for b in table.column("keys").to_pylist()]
    times = [np.frombuffer(b, np.int64) if b else np.ones(len(k), np.int64) for k, b in zip(keys, table.column("times").to_pylist())]
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] >> 1 != keys[:-1] >> 1])
    size, pos = np.add.reduceat(times, first), np.add.reduceat(times * (keys & 1), first)
    twice = pos * (2 * np.cumsum(size) - size + 1)
    return pa.table({"g": table.column("g")[:1], "bin": table.column("bin")[:1], "twice": [int(twice.sum())], "pos": [int(pos.sum())], "c": [int(size.sum())]},
                    pa.schema([("g", pa.int32()), ("bin", pa.int32()), ("twice", pa.int64()), ("pos", pa.int64()), ("c", pa.int64())]))


def losses(rows: DataFrame, slots: dict[str, tuple[int, int]], leaves: Leaves, repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, repeat, auc: the ROC-AUC of the trees after each feature's slots have changed places among the rows; before, feature and repeat are null.

    rows: customer_id, churned, x array<double>. slots: a feature's place in x and number of values; the trees ask for a
    place in each. The permutations are those of `churn.shuffled_losses`. Written once; a row a feature and repeat.
    """
    width, code = len(leaves.bounds), leaves.code
    places = {f: [p for p, j in enumerate(leaves.bounds) if a <= j < a + k] for f, (a, k) in enumerate(slots.values())}
    draws = [(f, draw_number(f, r, seed)) for f in places for r in range(repeats)]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False)
            codes = leaves.coded(x.reshape(b.num_rows, -1))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.nbytes // b.num_rows), b.num_rows, [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("customer_id"), b.column("y"), packed.cast(pa.binary()), pa.array(leaves.scores(codes))], ["customer_id", "y", "codes", "score"])

    key = rows.schema["customer_id"].dataType.simpleString()
    known = rows.select("customer_id", (F.col("churned") == 1).cast("int").alias("y"), "x")
    known = cut(known.mapInArrow(encoded, f"customer_id {key}, y int, codes binary, score long"))
    numbered = cut(row_numbers(known, ["customer_id"], "_i").select((F.col("_i") - 1).alias("i"), "y", "codes", "score"))
    n, cores = numbered.count(), rows.sparkSession.sparkContext.defaultParallelism
    size = min(max(-(-n // (4 * cores)), LEAST_BLOCK), MOST_BLOCK)
    blocks, bins = -(-n // size) or 1, -(-n // PER_BIN) or 1
    #: they only share out the work: any bounds give the same ranks
    cuts = numbered.approxQuantile("score", [b / bins for b in range(1, bins)], 0.001) if bins > 1 else []
    bounds = 2 * np.unique(np.array(cuts, np.float64).astype(np.int64))

    def send(table: pa.Table) -> pa.Table:
        i = table.column("i").to_numpy()
        order = np.argsort(i)
        i, at = i[order], int(i[0]) // size if len(i) else 0
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), code).reshape(-1, width)[order].T
        packets: list[list[bytes]] = [[] for _ in range(blocks)]
        for f, draw in draws:
            to = walked(i, draw, n) // size
            by = np.argsort(to, kind="stable")
            ends, moved = np.cumsum(np.bincount(to, minlength=blocks)), codes[places[f]][:, by]
            for d, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
                packets[d].append(moved[:, lo:hi].tobytes())
        own = codes.tobytes() + table.column("y").to_numpy()[order].astype(np.uint8).tobytes()
        return pa.table({"block": pa.array([*range(blocks), at], pa.int32()), "source": pa.array([*[at] * blocks, -1], pa.int32()), "data": pa.array([*map(b"".join, packets), own], pa.binary())})

    def receive(table: pa.Table) -> pa.Table:
        at = table.column("block")[0].as_py()
        came = dict(zip(table.column("source").to_pylist(), table.column("data").to_pylist()))
        i = np.arange(at * size, min((at + 1) * size, n))
        own = came.pop(-1)
        codes = np.frombuffer(own, code, width * len(i)).reshape(width, len(i))
        y = np.frombuffer(own, np.uint8, offset=codes.nbytes).astype(np.int64)
        sources = [np.frombuffer(came[b], code) for b in range(blocks)]
        read, moved = np.zeros(blocks, np.int64), {f: np.empty((len(own), repeats, len(i)), code) for f, own in places.items()}
        for g, (f, draw) in enumerate(draws):
            source = walked(i, draw, n, back=True)
            counts = np.bincount(source // size, minlength=blocks)
            k, to = len(places[f]), np.argsort(source)
            upto = read + k * counts
            moved[f][:, g % repeats, to] = np.concatenate([s[a:b].reshape(k, -1) for s, a, b in zip(sources, read, upto)], axis=1)
            read = upto
        keys = _scored(leaves, places, codes, moved) * 2 + y
        keys.sort(axis=1)
        out: list[tuple] = []
        for g, each in enumerate(keys):
            ends = [0, *np.searchsorted(each, bounds), len(each)]
            out += [(g, b, *_sorted(each[lo:hi])) for b, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo]
        return pa.table(dict(zip(["g", "bin", "keys", "times"], map(list, zip(*out)))), pa.schema([("g", pa.int32()), ("bin", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())]))

    # numbers of partitions are given, as AQE would make one task of what is little to read and much to do
    block = F.floor(F.col("i") / size).cast("int")
    sent = numbered.select(block.alias("block"), "i", "y", "codes").repartition(3 * blocks, "block").groupBy("block").applyInArrow(send, "block int, source int, data binary")
    scored = sent.repartition(3 * blocks, "block").groupBy("block").applyInArrow(receive, "g int, bin int, keys binary, times binary")
    parts = max(min(bins * (len(draws) + 1), 4 * cores), n * (len(draws) + 1) // 4_000_000)
    ranks = scored.repartition(parts, "g", "bin").groupBy("g", "bin").applyInArrow(_rank, "g int, bin int, twice long, pos long, c long")
    before = W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # a row a bin
    ranks = ranks.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    pos, c = F.sum("pos").cast("double"), F.sum("c").cast("double")
    total = F.sum(F.col("twice") / 2 + F.col("pos").cast("double") * F.col("before"))
    found = ranks.groupBy("g").agg(F.try_divide(total - pos * (pos + 1) / 2, pos * (c - pos)).alias("auc"))
    f, names = F.floor((F.col("g") - 1) / repeats), F.array(*map(F.lit, slots))
    return cut(found.select(F.when(F.col("g") > 0, F.get(names, f.cast("int"))).alias("feature"), F.when(F.col("g") > 0, (F.col("g") - 1) % repeats).cast("int").alias("repeat"), "auc"))


def _scored(leaves: Leaves, places: dict[int, list[int]], codes: np.ndarray, moved: dict[int, np.ndarray]) -> np.ndarray:
    """The scores of a block's rows as they are, then with each feature's and repeat's codes in place of their own.

    A tree that doesn't ask for the feature keeps its leaf; of the others, the words of all other features are kept, so a
    changed code is one lookup a tree. Rows whose code is the same keep their score.
    """
    masks = list(leaves.masks.values())
    trees = {f: np.flatnonzero(np.any([(masks[p] != 0xFFFFFFFF).any(axis=0) for p in own], axis=0)) for f, own in places.items()}
    asked = {f: [np.ascontiguousarray(masks[p][:, trees[f]]) for p in own] for f, own in places.items()}
    repeats = next(iter(moved.values())).shape[1]
    out = np.empty((1 + len(places) * repeats, codes.shape[1]), np.int64)
    for lo in range(0, codes.shape[1], AT_ONCE):
        part = codes[:, lo : lo + AT_ONCE]
        words, before = {}, np.full((part.shape[1], len(leaves.values)), 0xFFFFFFFF, np.uint32)
        for f, own in places.items():
            words[f] = masks[own[0]][part[own[0]]]
            for p in own[1:]:
                words[f] &= masks[p][part[p]]
        after, upto = {}, before.copy()
        for f in reversed(places):
            after[f] = upto
            upto = upto & words[f]
        whole = leaves.reached(upto)
        base = whole.sum(axis=1)
        here = slice(lo, lo + part.shape[1])
        out[0, here] = base
        for f, own in places.items():
            rest = (before & after[f])[:, trees[f]]
            keep = base - whole[:, trees[f]].sum(axis=1)
            new = moved[f][:, :, here]
            scores = np.repeat(base[None], repeats, axis=0)
            r, i = np.nonzero((new != part[own][:, None]).any(axis=0))
            for c in range(0, len(r), AT_ONCE):
                rc, ic = r[c : c + AT_ONCE], i[c : c + AT_ONCE]
                found = rest[ic]
                for p, each in enumerate(asked[f]):
                    found &= each[new[p, rc, ic]]
                scores[rc, ic] = keep[ic] + leaves.reached(found, trees[f]).sum(axis=1)
            out[1 + f * repeats : 1 + (f + 1) * repeats, here] = scores
            before &= words[f]
    return out
