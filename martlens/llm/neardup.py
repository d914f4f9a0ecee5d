r"""Operator 4: near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct 5-word shingles (lower-cased A-Z, words cut at ASCII white space) as 64-bit
hashes; a text of fewer words has its whole sequence as one. Two documents are linked when their sets' Jaccard
similarity is at least LIKE percent.

1. Sets that are equal form a class (128-bit digest of the sorted set); from here on only classes are compared, so a
   group of copies, however large, costs one.
2. SuperMinHash: each element walks a random permutation of the BANDS * ROWS places; at its j-th step it offers j + u
   at the place it reaches. A document stops once every place holds less than j + 1, for long ones after the first
   step. Steps are taken for all documents of a chunk at once.
3. Bands of ROWS places are bucket keys; buckets with one class go. A pair with similarity 0.75 misses all BANDS
   buckets with probability (1 - 0.75^ROWS)^BANDS = 2e-5, one with 0.8 with 1e-7.
4. Each bucket has a pivot, its class that shares most with all others: mostly the text that the others are copies of.
   Every class meets the pivots of its buckets on full sets, so a group of copies costs classes x pivots. Of such a
   meeting stay the overlap and two bitmaps of BITS bits: of the pivot's shingles that the class lacks, and of its own
   that the pivot lacks. Union-find over the links so far gives components.
5. Two other classes of a bucket that are in different components yet are compared unless an exact bound on their
   overlap, from what each shares with their common pivot, rules a link out: inside the pivot they share at most the
   smaller overlap, and at most what neither lacks; outside at most what both bitmaps of own shingles have in common,
   and the smaller number of shingles that fell on a bit already set. The bound never rules out a link.
6. All links, verified on full sets, go through union-find again: forests within tasks, then large-star/small-star
   rounds across them, each written to the shared checkpoint folder.

Scale: signatures and buckets are narrow; texts are shuffled once, to get the sets of the classes that share a
bucket. No group is collected: bucket minima are pre-aggregated, and pairs come from sort-merge joins, which AQE
splits where a key is hot. Step 5 looks at all pairs of a bucket that are in different components, so its CPU time (two
dozen bit operations a pair) still grows with the square of the classes of one bucket that no pivot links; what it
puts out does not.

Cases: null and empty texts and texts without words have the empty set, are linked with nothing and are components of
their own; repeated rows are one class and each gets its row; ties go to the smallest doc_id; a row without doc_id
takes the component of its class; rows with one doc_id and different texts are rows of their own, told apart by
row_hash; very long texts are taken whole, a chunk being one text at least; an empty table gives no rows; columns
besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import chunks, mix64, release, schema_of, stash, table, texts_of, unit

SHINGLE, LIKE, BANDS, ROWS = 5, 75, 40, 5
CHUNK, BITS = 1 << 19, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF97)  # 3 modulo 4


def _odd(n: int) -> np.uint64:
    return np.uint64(n * int(_ODD) % (1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every word of the texts, in order: differences of a running polynomial hash."""
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])[:-1]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begin, end = edge[::2], edge[1::2]
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), out=run[1:], dtype=np.uint64)
    h = (run[end] - run[begin]) * _powers(_BACK, len(raw))[begin]
    return np.searchsorted(starts, begin, side="right") - 1, mix64(h + (end - begin).astype(np.uint64))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingle hashes of text i are hashes[offsets[i]:offsets[i + 1]]."""
    doc, w = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(len(doc)) - first[doc] if len(doc) else doc
    left = n[doc] - place
    begins = (left >= k) | (place == 0)
    h = np.zeros(len(w), np.uint64)
    for j in range(k):  # absent words of a short text count as 0, and the number of words is part of the hash
        h = h * _ODD + np.where(left > j, np.roll(w, -j), np.uint64(0))
    h = mix64(h + np.minimum(left, k).astype(np.uint64))[begins]
    doc = doc[begins]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]), h


def superminhash(offsets: np.ndarray, hashes: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m) of the sets; empty sets stay infinite."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sig = np.full(len(sizes) * m, np.inf)
    left, of, perm = hashes, doc, None
    for j in range(m):
        if not len(left):
            break
        r = unit(mix64(left + _odd(2 * j + 1))) + j
        k = j + ((mix64(left + _odd(2 * j + 2)) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(left))
        if perm is None:
            place = k
        else:
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, of * m + place, r)
        open_ = sig.reshape(-1, m).max(axis=1) >= j + 1
        keep = open_[of]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.int16), (int(keep.sum()), 1))
            perm[np.arange(len(perm)), k[keep]] = 0
        elif not keep.all():
            perm = perm[keep]
        left, of = left[keep], of[keep]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = mix64(np.ascontiguousarray(sig).view(np.uint64)).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, v.shape[:2]).copy()
    for j in range(rows):
        h = mix64(h * _ODD + v[:, :, j])
    return h.view(np.int64)


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row_hash (of text), n (set size), key (digest of the set, null if empty) and bands (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text", CHUNK):
                off, h = shingle_sets(texts_of(b.column("text")))
                n = np.diff(off)
                keys = [hashlib.blake2b(h[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(off[:-1], off[1:], strict=True)]
                of_bands = band_keys(superminhash(off, h, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(of_bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("row_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists],
                    ["doc_id", "row_hash", "n", "key", "bands"],
                )
        release()

    rows_of = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")
    return rows_of.mapInArrow(run, "doc_id long, row_hash long, n long, key binary, bands array<long>")


def sets_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and set (sorted 64-bit hashes) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text", CHUNK):
                off, h = shingle_sets(texts_of(b.column("text")))
                sets = pa.array([h[s:e].tobytes() for s, e in zip(off[:-1], off[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), sets], [*keep, "set"])
        release()

    return docs.select(*keep, "text").mapInArrow(run, schema_of(docs, keep, "set binary"))


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes >> np.uint64(32)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).view(np.int64)


def overlaps(pairs: DataFrame, sets: DataFrame, bitmaps: bool = False) -> DataFrame:
    """a, b, shared (shingles in both sets) and the sizes n_a, n_b of pairs (a, b) of class ids. sets: cid, set.

    With bitmaps also lacks and own (arrays of long) of the shingles that only b and only a has, and over: how many of
    a's own fell on a bit already set.
    """
    a = pairs.join(sets.withColumnsRenamed({"cid": "a", "set": "set_a"}), "a")
    both = a.join(sets.withColumnsRenamed({"cid": "b", "set": "set_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in chunks(whole, "set_a")):
            cols: dict[str, list] = {c: [] for c in ("shared", "n_a", "n_b", "lacks", "own", "over")}
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                p, q = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                hit = q[at] == p
                for c, v in (("shared", int(hit.sum())), ("n_a", len(x)), ("n_b", len(y))):
                    cols[c].append(v)
                if bitmaps:
                    rest = np.ones(len(q), bool)
                    rest[at[hit]] = False
                    own, lacks = (p[~hit], q[rest]) if len(x) <= len(y) else (q[rest], p[~hit])
                    bits = _bitmap(own)
                    cols["own"].append(bits)
                    cols["lacks"].append(_bitmap(lacks))
                    cols["over"].append(len(own) - int(np.unpackbits(bits.view(np.uint8)).sum()))
            new = {c: pa.array(v, pa.list_(pa.int64()) if c in ("lacks", "own") else pa.int64()) for c, v in cols.items() if bitmaps or c in ("shared", "n_a", "n_b")}
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *new.values()], ["a", "b", *new])
        release()

    schema = "a long, b long, shared long, n_a long, n_b long" + (", lacks array<long>, own array<long>, over long" if bitmaps else "")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, schema)


def similar(met: DataFrame, like: int) -> DataFrame:
    """The links (a, b) among pairs with their overlap."""
    return met.filter(100 * F.col("shared") >= like * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch of links: every node with its root, the smallest of its tree."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root: dict[int, int] = root) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
        pairs = [(x, find(x)) for x in root if find(x) != x]
        cols = list(zip(*pairs, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node of its component. links: a, b (long)."""
    e = stash(links.mapInArrow(_forest, "a long, b long").distinct())
    seen = None
    while True:
        sign = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if sign == seen or sign[0] == 0:
            break
        seen = sign
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = low.select("a", F.col("m").alias("b")).union(tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = stash(small.distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def unsettled(met: DataFrame, placed: DataFrame, like: int) -> DataFrame:
    """Pairs (a, b) of classes of one bucket and different components that may be linked, by what each shares with the pivot.

    met: what classes `a` share with pivots `b`, with bitmaps. placed: bucket, pivot, cid, comp.
    """
    n_words = BITS // 64
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    facts = met.select(
        F.col("a").alias("cid"), F.col("b").alias("pivot"), "shared", F.col("n_a").alias("n"), F.col("n_b").alias("n_pivot"), "over",
        *(F.get(c, F.lit(i)).alias(f"{c}{i}") for c in ("lacks", "own") for i in range(n_words)),
    )
    open_ = stash(placed.join(mixed, "bucket", "left_semi").filter("cid <> pivot").join(facts, ["cid", "pivot"]).drop("pivot"))
    x, y = (open_.select("bucket", *(F.col(c).alias(f"{c}_{side}") for c in open_.columns if c != "bucket")) for side in "xy")
    lacking = sum((F.bit_count(F.col(f"lacks{i}_x").bitwiseOR(F.col(f"lacks{i}_y"))) for i in range(n_words)), F.lit(0))
    common = sum((F.bit_count(F.col(f"own{i}_x").bitwiseAND(F.col(f"own{i}_y"))) for i in range(n_words)), F.lit(0))
    inside = F.least("shared_x", "shared_y", F.col("n_pivot_x") - lacking)
    outside = F.least(F.col("n_x") - F.col("shared_x"), F.col("n_y") - F.col("shared_y"), common + F.least("over_x", "over_y"))
    most = inside + outside
    fits = (F.col("comp_x") < F.col("comp_y")) & (100 * F.least("n_x", "n_y") >= like * F.greatest("n_x", "n_y"))
    fits = fits & (100 * most >= like * (F.col("n_x") + F.col("n_y") - most))
    return x.join(y.hint("merge"), "bucket").filter(fits).select(F.col("cid_x").alias("a"), F.col("cid_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, like: int = LIKE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text), with row_hash and leads.

    leads holds for one (doc_id, row_hash) of each component, the one that an exact deduplication keeps, and for every
    row with an empty set.
    """
    marked = stash(features(docs, bands, rows))
    me = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_hash")
    classes = marked.filter("n > 0").groupBy("key").agg(F.min(me).alias("rep"), F.first("bands").alias("bands"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()))
    entries = classes.select(F.explode("bands").alias("bucket"), "cid")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    members = stash(entries.join(shared, "bucket"))
    # a bucket's pivot is its most central class, the one whose buckets hold the most: the text that others are copies of
    central = members.groupBy("cid").agg(F.sum("c").alias("s"))
    ranked = members.select("bucket", "cid").join(central, "cid")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("s", "cid")).alias("top")).select("bucket", F.col("top.cid").alias("pivot"))
    members = stash(members.select("bucket", "cid").join(pivots, "bucket"))

    # the sets of all classes that share a bucket, from the row that represents each
    wanted = members.select("cid").distinct().join(classes.select("cid", "rep"), "cid").select("cid", "rep")
    texts = docs.select(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash")).alias("rep"), "text")
    sets = stash(sets_of(texts.join(wanted, "rep"), ["cid"]).dropDuplicates(["cid"]))

    met = stash(overlaps(members.filter("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct(), sets, bitmaps=True))
    links = similar(met, like)
    known = components(links)
    placed = members.join(known, members.cid == known.node, "left").select("bucket", "pivot", "cid", F.coalesce("root", "cid").alias("comp"))
    pairs = unsettled(met, placed, like)
    groups = components(links.union(similar(overlaps(pairs, sets), like)))

    grouped = groups.union(groups.select("root", "root").distinct())
    least = grouped.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("leader"))
    least = stash(least)  # so that the join below, in which one component may be hot, is between two plain exchanges
    ids = classes.join(grouped, classes.cid == grouped.node, "left").select("key", "rep", "root")
    ids = ids.join(least, "root", "left").select("key", F.coalesce("leader", "rep").alias("leader"))
    out = marked.drop("bands").join(ids, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("leader.doc_id")).otherwise(F.col("doc_id")))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "row_hash", F.coalesce(me == F.col("leader"), F.lit(True)).alias("leads"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_hash", "leads")


ORACLE = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    t AS (SELECT doc_id, unnest(s) AS t FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t AS a JOIN t AS b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b
          WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)),
    r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
    c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
