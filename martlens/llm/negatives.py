r"""Operator 11: hard-negative mining with a pivot table over augmented vectors.

Scores are integer inner products. With one more component, sqrt(M - |x|^2), M the largest squared length, all rows x
have one length, and an anchor q with 0 there has |q' - x'|^2 = |q|^2 + M - 2 q.x: the best score is the nearest row. A
table holds each row's distances to a few pivots. By the triangle inequality |d(q', p) - d(x', p)| <= d(q', x') <=
d(q', p) + d(x', p) for every pivot p, which brackets the score without the vector; rows whose bracket leaves what is
asked for are out, the vectors of the others are multiplied. Pivots are PIVOTS rows far from each other, out of a
sample of SAMPLE rows for each vector length; a poor choice costs time, not results.

1. Positives: each anchor's POSITIVES + 1 best rows of its own label. A bracket is out below the best lower ends so far.
2. Negatives: for each of these, the best NEGATIVES rows of other labels whose scores are within LOW to HIGH per cent of
   the positive's. A bracket is out below the lowest or above the highest of these, or below the best found so far.
3. An anchor's own row is dropped from its positives.

Equal vectors of one label are one row of the table with their POSITIVES + 1 smallest ids (no other can be a result), and
equal anchors of one label ask once, so a vector that a third of all rows share costs one row and one question.

Scale: the anchors are a stated share of the rows, so the work is anchors x rows by the contract. It is cut into keys
(block of anchors, group of blocks of rows), each a task's worth of a fixed size in memory: BLOCK_CELLS components for
each block. Each key's best rows are merged by rank, so no task gathers what grows. Rows move once for each block of
anchors. Nothing is broadcast but by AQE's own measure; the driver sees one count for each vector length.

Cases: a row with a null vec_id, label or vector, or with a null or non-finite component takes no part; vectors of
different lengths never meet; equal rows are different candidates; ties go to the smaller vec_id; an anchor with fewer
rows of its label than POSITIVES has fewer positives; a positive with fewer rows in its range has fewer negatives, or
none; negative scores follow the same inequality, which a positive's score below 0 never meets; an empty vector's scores
are 0; an empty table gives no rows; other columns are ignored, whatever their names. A vector whose product with itself
doesn't fit a long is an error that names its vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.llm.common import release, stash, table
from martlens.llm.vectors import MAX_DIMS, _matrix, _of_dim, _smallest, quantised

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
PIVOTS, SAMPLE, BLOCK_CELLS, GROUP = 8, 1024, 1 << 18, 2
#: Cells of the arrays of pairs that a task works on at a time.
TILE = 1 << 19
#: Below one in so many, pairs that brackets leave are multiplied one by one, else all pairs of the rows that any of these has.
SPARSE = 8
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without leaving 64 bits."""
    return score // 100 * percent + score % 100 * percent // 100


def _augmented(x: np.ndarray, norm2: np.ndarray, most: int) -> np.ndarray:
    return np.column_stack([x.astype(np.float64), np.sqrt(np.maximum(float(most) - norm2.astype(np.float64), 0.0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(np.square(x - p).sum(axis=1)) for p in pivots], axis=1)


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """Pivots of one vector length: the row farthest from the mean, then always the row farthest from those chosen."""
    dim, most = int(group.dim.iloc[0]), int(group.most.iloc[0])
    group = group.sort_values("v")
    x = _augmented(_matrix(list(group.v), dim), group.norm2.to_numpy(), most)
    far = np.square(x - x.mean(axis=0)).sum(axis=1)
    chosen = [int(far.argmax())]
    far = np.square(x - x[chosen[0]]).sum(axis=1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.square(x - x[chosen[-1]]).sum(axis=1))
    return pd.DataFrame({"dim": [dim], "most": [most], "pivots": [x[chosen].tobytes()]})


def pivots_of(kinds: DataFrame) -> DataFrame:
    """(dim, most, pivots): for each vector length the largest squared length and the augmented pivots."""
    w = W.partitionBy("dim").orderBy(F.xxhash64("v"), "v", "label")
    sample = kinds.select("dim", "v", "norm2", F.row_number().over(w).alias("_n")).filter(F.col("_n") <= SAMPLE).drop("_n")
    most = kinds.groupBy("dim").agg(F.max("norm2").alias("most"))
    return sample.join(most, "dim").groupBy("dim").applyInPandas(_choose, "dim int, most long, pivots binary")


def blocks_of(rows: DataFrame, pivots: DataFrame, per_dim: Column, query: bool) -> DataFrame:
    """The pivot table: rows (dim, v, label, norm2, ids) as blocks, with their distances to the pivots.

    vs, labels, norm2, exact (the vectors), far (distances) and ids hold a block's rows in one order. Rows that ask have
    0 as their further component.
    """
    schema = "dim int, block int, n int, labels array<long>, norm2 binary, width int, exact binary, ids array<long>, ends binary, vs array<binary>"

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["label", "v"])
        x = _smallest(_matrix(list(group.v), dim := int(group.dim.iloc[0])))
        return pd.DataFrame({
            "dim": [dim], "block": [int(group.block.iloc[0])], "n": [len(x)], "labels": [group.label.to_numpy(np.int64)],
            "norm2": [group.norm2.to_numpy(np.int64).tobytes()], "width": [x.itemsize], "exact": [x.tobytes()], "ids": [np.concatenate(group.ids.to_list())],
            "ends": [np.cumsum([len(i) for i in group.ids]).astype(np.int64).tobytes()], "vs": [list(group.v) if query else []],
        })

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = []
            for i in range(b.num_rows):
                n, dim, width, most = (b.column(c)[i].as_py() for c in ("n", "dim", "width", "most"))
                x = np.frombuffer(b.column("exact")[i].as_py(), f"<i{width}").reshape(n, dim)
                norm2 = np.full(n, most) if query else np.frombuffer(b.column("norm2")[i].as_py(), np.int64)
                p = np.frombuffer(b.column("pivots")[i].as_py(), np.float64).reshape(-1, dim + 1)
                far.append(_distances(_augmented(x, norm2, most), p).tobytes())
            kept = [c for c in b.schema.names if c != "pivots"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(far, pa.binary())], [*kept, "far"])
        release()

    rows = rows.withColumn("block", F.pmod(F.xxhash64("v", "label"), per_dim).cast("int"))
    blocks = rows.groupBy("dim", "block").applyInPandas(gather, schema)
    return blocks.join(pivots, "dim").select(*(c.split()[0] for c in schema.split(", ")), "most", "pivots").mapInArrow(
        measure, f"{schema}, most long, far binary"
    )


class Best:
    """The k best (score, id) of each slot so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.limit = np.full(slots, LEAST)  # a slot's k-th best score; the least while there are fewer

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = np.flatnonzero(place == self.k - 1)
        ok = order[place < self.k]
        self.limit[slot[last]] = score[order[last]]
        self.slot, self.score, self.id = slot[place < self.k], score[ok], ids[ok]


class Block:
    def __init__(self, row):
        self.n, self.most = int(row.n), int(row.most)
        self.labels = np.asarray(row.labels, np.int64)
        self.norm2 = np.frombuffer(row.norm2, np.int64)
        self.x = np.frombuffer(row.exact, f"<i{row.width}").reshape(self.n, int(row.dim))
        self.far = np.frombuffer(row.far, np.float64).reshape(self.n, -1)
        self.ids, self.ends = np.asarray(row.ids, np.int64), np.frombuffer(row.ends, np.int64)
        self.most_x = float(np.abs(self.x.astype(np.float64)).max(initial=0))


def brackets(q: Block, at: np.ndarray, x: Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the scores of some anchors with some rows, from distances to the pivots alone."""
    near, wide = np.zeros((len(at), len(rows))), np.full((len(at), len(rows)), np.inf)
    for a, b in zip(q.far[at].T, x.far[rows].T, strict=True):
        np.maximum(near, np.abs(a[:, None] - b), out=near)
        np.minimum(wide, a[:, None] + b, out=wide)
    both = (q.norm2[at].astype(np.float64) + float(x.most))[:, None]
    slack = 1e-9 * both + 1e-6  # what floating point may have lost
    return (both - wide * wide) / 2 - slack, (both - near * near) / 2 + slack


def seek(q: Block, blocks: list[Block], low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[Best, int]:
    """The k best rows of each (anchor, range) among blocks, and how many vectors were multiplied for it.

    low, high: (anchors, ranges) of scores, both included. same: rows of the anchor's label, or of all others.
    """
    ranges, read = low.shape[1], 0
    best = Best(q.n * ranges, k)
    for x in blocks:
        exact = np.float64 if q.most_x * x.most_x * max(1, x.x.shape[1]) < 1 << 53 else np.int64
        shared = [(np.flatnonzero(q.labels == v), np.flatnonzero(x.labels == v)) for v in np.intersect1d(q.labels, x.labels)]
        for anchors, rows in shared if same else [(np.arange(q.n), np.arange(x.n))]:
            step = max(1, TILE // max(1, len(rows)))
            for at in (anchors[i : i + step] for i in range(0, len(anchors), step)):
                lower, upper = brackets(q, at, x, rows)
                floor = np.maximum(low[at], best.limit.reshape(q.n, ranges)[at])
                least = floor.min(axis=1).astype(np.float64)
                if same and len(rows) >= k:
                    least = np.maximum(least, np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k])
                want = (upper >= least[:, None]) & (lower <= high[at].max(axis=1).astype(np.float64)[:, None])
                if not same:
                    want &= q.labels[at][:, None] != x.labels[rows]
                cols = np.flatnonzero(want.any(axis=0))
                if not len(cols):
                    continue
                want = want[:, cols]
                if (few := int(want.sum())) * SPARSE < want.size:  # product by product
                    read += few
                    score = np.full(want.shape, LEAST)
                    pairs = np.nonzero(want)
                    per = max(1, TILE // max(1, x.x.shape[1]))
                    for i in range(0, few, per):
                        a, c = (p[i : i + per] for p in pairs)
                        score[a, c] = np.einsum("ij,ij->i", q.x[at[a]].astype(exact), x.x[rows[cols[c]]].astype(exact)).astype(np.int64)
                else:
                    read += want.size
                    score = (q.x[at].astype(exact) @ x.x[rows[cols]].astype(exact).T).astype(np.int64)
                slots, scores, ids = [], [], []
                for j in range(ranges):
                    ok = want & (score >= floor[:, j, None]) & (score <= high[at, j, None])
                    if len(cols) > k:
                        ok &= score >= np.partition(np.where(ok, score, LEAST), len(cols) - k, axis=1)[:, len(cols) - k, None]
                    a, c = np.nonzero(ok)
                    if not len(a):
                        continue
                    row = rows[cols[c]]
                    start = np.append(0, x.ends[:-1])[row]
                    n = np.minimum(x.ends[row] - start, k)
                    of = np.repeat(np.arange(len(a)), n)
                    slots.append((at[a] * ranges + j)[of])
                    scores.append(score[a, c][of])
                    ids.append(x.ids[start[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]])
                if slots:
                    best.add(*map(np.concatenate, (slots, scores, ids)))
    return best, read


def _scan(queries: DataFrame, data: DataFrame, query_blocks: dict[int, int], groups: dict[int, int], k: int, low: int, high: int, same: bool) -> DataFrame:
    """(dim, block, slot, at, score, vec_id, reads): the k best rows of each slot, at from 1.

    A slot is an anchor of its block, or with other labels an anchor and one of its positives, found: (slots, scores).
    """
    most = POSITIVES + 1

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("dim", "block", "slot", "score", "vec_id", "reads")})
        q = Block(left.iloc[0])
        if same:
            lows, highs = np.full((q.n, 1), LEAST), np.full((q.n, 1), MOST)
        else:
            lows, highs = np.full(q.n * most, MOST), np.full(q.n * most, LEAST)
            at, score = (np.asarray(left.iloc[0][c], np.int64) for c in ("slots", "scores"))
            lows[at], highs[at] = -_share(-score, low), _share(score, high)
            lows, highs = lows.reshape(q.n, most), highs.reshape(q.n, most)
        best, read = seek(q, [Block(r) for r in right.sort_values("data_block").itertuples(index=False)], lows, highs, k, same)
        reads = np.zeros(len(best.slot), np.int64)
        reads[:1] = read
        return pd.DataFrame({"dim": np.int32(key[0]), "block": np.int32(key[1]), "slot": best.slot, "score": best.score, "vec_id": best.id, "reads": reads})

    left = queries.withColumn("g", F.explode(F.sequence(F.lit(0), _of_dim(groups) - 1)))
    right = data.drop("vs").withColumnRenamed("block", "data_block").withColumn("g", F.pmod("data_block", _of_dim(groups)))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), _of_dim(query_blocks) - 1)))
    keys = ["dim", "block", "g"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "dim int, block int, slot long, score long, vec_id long, reads long")
    w = W.partitionBy("dim", "block", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)


def mine(vectors: DataFrame, every: int, low: int = LOW, high: int = HIGH, negatives: int = NEGATIVES, scale: int = SCALE,
         block_cells: int = BLOCK_CELLS, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, embedding, label.

    Anchors are the rows whose vec_id is divisible by `every`.
    """
    most = POSITIVES + 1
    rows = stash(quantised(vectors.select("vec_id", "embedding", F.col("label").cast("long")), scale, "label"))
    anchors = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "dim", "v", "label")
    w = W.partitionBy("dim", "v", "label").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    kinds = stash(few.groupBy("dim", "v", "label", "norm2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asking = stash(anchors.select("dim", "v", "label").distinct().join(kinds, ["dim", "v", "label"]))
    counts = kinds.groupBy("dim").agg(F.count("*").alias("n")).join(asking.groupBy("dim").agg(F.count("*").alias("n_q")), "dim").limit(MAX_DIMS + 1).collect()
    if len(counts) > MAX_DIMS:
        raise ValueError(f"vectors of more than {MAX_DIMS} lengths")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not counts:
        return vectors.sparkSession.createDataFrame([], schema)
    a_block = {r["dim"]: max(16, block_cells // max(1, r["dim"])) for r in counts}
    blocks, query_blocks = ({r["dim"]: -(-r[c] // a_block[r["dim"]]) for r in counts} for c in ("n", "n_q"))
    groups = {d: -(-n // group) for d, n in blocks.items()}
    kinds = kinds.filter(_of_dim(blocks).isNotNull())  # lengths that no anchor has
    pivots = stash(pivots_of(kinds))
    data = stash(blocks_of(kinds, pivots, _of_dim(blocks), query=False))
    queries = stash(blocks_of(asking, pivots, _of_dim(query_blocks), query=True))

    first = stash(_scan(queries.drop("vs"), data, query_blocks, groups, most, low, high, same=True))
    key = ["dim", "block"]
    slots = first.withColumn("_s", F.struct((F.col("slot") * most + F.col("at") - 1).alias("slot"), "score"))
    asked = slots.groupBy(*key).agg(F.collect_list("_s").alias("_s"))
    asked = queries.drop("vs").join(asked, key).withColumns({"slots": F.col("_s.slot"), "scores": F.col("_s.score")}).drop("_s")
    second = _scan(asked, data, query_blocks, groups, negatives, low, high, same=False)

    # one row for each vector and label that asks, then one for each anchor that has these
    key = ["dim", "block", "slot"]
    positive = F.transform(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))), lambda x: F.struct(x.vec_id.alias("id"), x.score.alias("score")))
    positives = first.groupBy(*key).agg(positive.alias("positives"))
    found = second.select("dim", "block", F.floor(F.col("slot") / most).alias("slot"), F.struct(
        F.pmod("slot", F.lit(most)).cast("int").alias("of"), F.col("at").alias("rank"), "vec_id", "score").alias("x"))
    found = found.groupBy(*key).agg(F.collect_list("x").alias("negatives"))
    members = queries.select("dim", "block", F.posexplode(F.arrays_zip("vs", "labels")).alias("slot", "x"))
    members = members.select("dim", "block", F.col("slot").cast("long").alias("slot"), F.col("x.vs").alias("v"), F.col("x.labels").alias("label"))
    met = anchors.join(members.join(positives, key).join(found, key).select("dim", "v", "label", "positives", "negatives"), ["dim", "v", "label"])
    own = F.array_position(F.col("positives.id"), F.col("vec_id")) - 1
    met = met.withColumn("_own", own).withColumn("x", F.explode("negatives"))
    met = met.filter(F.when(F.col("_own") >= 0, F.col("x.of") != F.col("_own")).otherwise(F.col("x.of") < POSITIVES))
    p = F.element_at("positives", F.col("x.of") + 1)
    return met.select(F.col("vec_id").alias("anchor_id"), p.id.alias("positive_id"), F.col("x.rank").cast("int").alias("rank"),
                      F.col("x.vec_id").alias("negative_id"), p.score.alias("positive_score"), F.col("x.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `embeddings`; rows whose vec_id is divisible by 7 take the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), every=50)


ORACLE = f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
                 CAST(coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i])), 0) AS BIGINT) AS score
          FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
    n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
