r"""Operator 7: exact top-k by integer inner product with a vector-approximation file.

Equal vectors are one row of the file, with the k + 1 smallest ids that have it (no other can be a result), so a vector
that a third of all rows share costs one. A block of about BLOCK vectors is two records: the approximation, a cell of
CELL_BITS bits for each component and the length of what the cells leave out, and the exact vectors, in as few bytes as
they need. A block's cells are its own: the best steps for the values that its components have.

1. Scan: every query block meets the approximations of every group of blocks. A vector's product with a query is that
   of its cells' centres, give or take the query's length times the rest's length (Cauchy-Schwarz). Vectors whose upper
   bound is below the (k + 1)-th best lower bound so far are out; of the others only places and bounds are put out.
2. The best of these limits over all groups rules out more, for each query.
3. Exact vectors of what is left are cut out of their blocks and sent to the query blocks that want them, those with the
   highest bounds first. Each query reads them in the order of their upper bounds until the k-th result is certain.

Scale: the query set is a stated share of the rows, so the scan is inherently queries x rows; it is cut into (query
block, group) keys, each a task's worth, and moves CELL_BITS bits for each component and query block. Exact vectors move
only where a bound asks for them. A key that AQE splits over tasks gives partial results, which are merged. Nothing is broadcast; the driver sees one count for each vector length. A task holds
one block and one query block. Larger tables want larger blocks: they are parameters.

Cases: a vector that is null, or has a null or non-finite component, and a row without vec_id take no part; vectors of
different length never meet; equal rows are different candidates, only the query's own row is none; ties go to the
smaller vec_id; fewer candidates than k give fewer rows; a very long vector is a row like others; an empty table gives
no rows; columns besides vec_id and embedding are ignored, whatever their names. Scores must fit a long: a vector whose
product with itself does not is an error that names its vec_id, and no product of two others is larger. Blocks whose
products might not be exact in floating point are multiplied as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.llm.common import release, stash, table

BLOCK, QUERY_BLOCK, GROUP, CELL_BITS, SCALE, MAX_DIMS = 4096, 512, 4, 5, 64, 10_000
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def quantised(vectors: DataFrame, scale: int = SCALE, keep: str | None = None) -> DataFrame:
    """(vec_id, dim, v, norm2) of the rows that take part, and the column `keep`, which mustn't be null in these.

    v: floor(scale * x) in the smallest integer type, its width first; norm2: its product with itself.
    """
    kept = [keep] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("embedding")
            flat, off = x.values, x.offsets.to_numpy()
            raw = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad_before = np.concatenate([[0], np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False) | ~np.isfinite(raw))])
            fine = (bad_before[off[1:]] == bad_before[off[:-1]]) & x.is_valid().to_numpy(zero_copy_only=False)
            for c in ("vec_id", *kept):
                fine &= b.column(c).is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(fine)
            rows, norms = [], []
            for i in at.tolist():
                with np.errstate(over="ignore"):
                    v = np.floor(raw[off[i] : off[i + 1]] * scale)
                    if not (v * v).sum() < 2.0**62.999:
                        raise ValueError(f"vec_id {b.column('vec_id')[i].as_py()}: the vector's product with itself does not fit a long")
                own = _smallest(v.astype(np.int64))
                rows.append(bytes([own.itemsize]) + own.tobytes())
                norms.append(int(np.square(own.astype(np.int64)).sum()))
            more = [b.column(c).take(pa.array(at)) for c in kept]
            dims = pa.array((off[at + 1] - off[at]).astype(np.int32))
            cols = [b.column("vec_id").take(pa.array(at)), dims, pa.array(rows, pa.binary()), pa.array(norms, pa.int64()), *more]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "v", "norm2", *kept])

    more = f", {keep} {vectors.schema[keep].dataType.simpleString()}" if keep else ""
    return vectors.select("vec_id", "embedding", *kept).mapInArrow(run, f"vec_id long, dim int, v binary, norm2 long{more}")


FOUND = "v binary, own long, found array<struct<score: long, vec_id: long>>, reads long"


def _smallest(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type."""
    return x.astype(next(k for k in _KINDS if np.iinfo(k).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(k).max))


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    for size in {r[0] for r in rows}:
        at = [i for i, r in enumerate(rows) if r[0] == size]
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{size}").reshape(len(at), dim)
    return out


def _packed(cells: np.ndarray) -> bytes:
    """Cells as planes of bits."""
    flat = cells.astype(np.uint8).reshape(-1)
    return b"".join(np.packbits(flat >> bit & 1).tobytes() for bit in range(CELL_BITS))


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(CELL_BITS, -1)
    return sum(np.unpackbits(x, count=n * dim) << bit for bit, x in enumerate(planes)).reshape(n, dim)


def _steps(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many values, sorted, that stand for the components with a small squared error (Lloyd's iteration)."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) <= most:
        return values.astype(float)
    steps = np.interp((np.arange(most) + 0.5) / most, (np.cumsum(counts) - counts / 2) / counts.sum(), values)
    for _ in range(12):
        of = np.searchsorted((steps[1:] + steps[:-1]) / 2, values)
        n = np.bincount(of, counts, most)
        steps = np.where(n > 0, np.bincount(of, counts * values.astype(float), most) / np.maximum(n, 1), steps)
    return steps


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """The two records of a block."""
    group = group.sort_values("v")
    x = _matrix(list(group.v), dim := int(group.dim.iloc[0]))
    steps = _steps(x, 1 << CELL_BITS)
    cells = np.searchsorted((steps[1:] + steps[:-1]) / 2, x)
    rest = x - steps[cells] if len(steps) else x
    length = np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-6)
    own, exact = [i for ids in group.ids for i in ids], _smallest(x)
    return pd.DataFrame({
        "dim": [dim], "block": [int(group.block.iloc[0])], "n": [len(x)], "steps": [steps.tobytes()], "cells": [_packed(cells)],
        "rest": [length.astype(np.float64).tobytes()], "size": [exact.itemsize], "exact": [exact.tobytes()], "ids": [np.array(own, np.int64).tobytes()],
        "ends": [np.cumsum([len(ids) for ids in group.ids]).astype(np.int64).tobytes()],
    })


def _queries(group: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(group.v)
    dim = int(group.dim.iloc[0])
    return pd.DataFrame({"dim": [dim], "q": [int(group.q.iloc[0])], "n_q": [len(rows)], "queries": [_matrix(rows, dim).tobytes()], "vs": [rows]})


def _kth(best: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row of both."""
    both = np.concatenate([best, new], axis=1)
    return np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if both.shape[1] > k else both


def scan(pairs: DataFrame, k: int) -> DataFrame:
    """(dim, q, block, at, rows, upper): for each query block and block, the pairs of query and row that bounds leave.

    pairs: one row for each query block and block, sorted by (dim, q, g). limits: the (k + 1)-th best lower bounds.
    """
    schema = "dim int, q int, block int, at binary, rows binary, upper binary, limits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, held = None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            limit = best.min(axis=1) if best.shape[1] > k else np.full(len(best), -np.inf)
            for block, at, rows, upper in held:
                ok = upper >= limit[at]
                cols = {"dim": pa.array([now[0]], pa.int32()), "q": pa.array([now[1]], pa.int32()), "block": pa.array([block], pa.int32())}
                data = {"at": at[ok], "rows": rows[ok], "upper": upper[ok], "limits": limit}
                yield pa.RecordBatch.from_pydict(cols | {c: pa.array([x.tobytes()], pa.binary()) for c, x in data.items()})

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                key = (row["dim"], row["q"], row["g"])
                if key != now:
                    if now is not None:
                        yield from out()
                    now, held = key, []
                    queries = np.frombuffer(row["queries"], np.int64).reshape(row["n_q"], row["dim"]).astype(np.float64)
                    length = np.sqrt((queries * queries).sum(axis=1))
                    best = np.empty((row["n_q"], 0))
                centres = np.frombuffer(row["steps"], np.float64)[_unpacked(row["cells"], row["n"], row["dim"])]
                base = queries @ centres.T
                # and what floating point may have lost
                slack = length[:, None] * (np.frombuffer(row["rest"], np.float64) + 1e-11 * (1 + np.sqrt((centres * centres).sum(axis=1))))
                best = _kth(best, base - slack, k + 1)
                upper = base + slack
                limit = best.min(axis=1) if best.shape[1] > k else np.full(len(best), -np.inf)
                at, rows = np.nonzero(upper >= limit[:, None])
                # rounded up, so that it stays a bound
                held.append((row["block"], at.astype(np.int32), rows.astype(np.int32), np.nextafter(upper[at, rows].astype(np.float32), np.float32(np.inf))))
        if now is not None:
            yield from out()
        release()

    return pairs.mapInArrow(run, schema)


def wanted(found: DataFrame) -> DataFrame:
    """What `scan` found, cut down to the pairs that the best limit over all groups leaves."""

    def highest(group: pd.DataFrame) -> pd.DataFrame:
        limits = np.maximum.reduce([np.frombuffer(x, np.float64) for x in group.limits])
        return pd.DataFrame({"dim": [group.dim.iloc[0]], "q": [group.q.iloc[0]], "limits": [limits.tobytes()]})

    limits = found.select("dim", "q", "limits").groupBy("dim", "q").applyInPandas(highest, "dim int, q int, limits binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at, rows, upper = (np.frombuffer(row[c], t) for c, t in (("at", np.int32), ("rows", np.int32), ("upper", np.float32)))
                ok = upper >= np.frombuffer(row["limits"], np.float64)[at]
                if ok.any():
                    cols = {"dim": pa.array([row["dim"]], pa.int32()), "q": pa.array([row["q"]], pa.int32()), "block": pa.array([row["block"]], pa.int32())}
                    data = {c: pa.array([x[ok].tobytes()], pa.binary()) for c, x in (("at", at), ("rows", rows), ("upper", upper))}
                    yield pa.RecordBatch.from_pydict(cols | data | {"top": pa.array([float(upper[ok].max())])})

    met = found.drop("limits").join(limits, ["dim", "q"])
    return met.mapInArrow(cut, "dim int, q int, block int, at binary, rows binary, upper binary, top double")


def fetch(wants: DataFrame, exact: DataFrame) -> DataFrame:
    """wants with the exact vectors, ids and ends of the rows that any query of the block asks for; rows count among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                need, place = np.unique(np.frombuffer(row["rows"], np.int32), return_inverse=True)
                x = np.frombuffer(row["exact"], f"<i{row['size']}").reshape(row["n"], row["dim"])[need]
                ends = np.frombuffer(row["ends"], np.int64)
                starts, ids = np.append(0, ends[:-1])[need], np.frombuffer(row["ids"], np.int64)
                own = [ids[s:e] for s, e in zip(starts.tolist(), ends[need].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([row["dim"]], pa.int32()), "q": pa.array([row["q"]], pa.int32()), "top": pa.array([row["top"]]),
                    "at": [row["at"]], "rows": [place.astype(np.int32).tobytes()], "upper": [row["upper"]],
                    "size": pa.array([row["size"]], pa.int32()), "exact": [x.tobytes()],
                    "ids": [np.concatenate(own).tobytes()], "ends": [np.cumsum([len(o) for o in own]).astype(np.int64).tobytes()],
                })

    schema = "dim int, q int, top double, at binary, rows binary, upper binary, size int, exact binary, ids binary, ends binary"
    return wants.join(exact, ["dim", "block"]).mapInArrow(run, schema)


class Best:
    """The best `most` candidates of each query of a block so far, by score, then id; `read` counts exact products."""

    def __init__(self, queries: np.ndarray, most: int):
        self.q, self.most, self.read = queries, most, 0
        self.size = float(np.abs(queries).max(initial=0))
        self.rows: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), sorted

    def meet(self, at: np.ndarray, rows: np.ndarray, upper: np.ndarray, exact: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        bound = self.size * float(np.abs(exact).max(initial=0)) * max(1, exact.shape[1])
        kind = np.float64 if bound < 1 << 53 else np.int64
        full, q = exact.astype(kind), self.q.astype(kind)
        order = np.lexsort((-upper, at))
        at, rows, upper = at[order], rows[order], upper[order]
        starts = np.append(0, ends[:-1])
        cuts = np.flatnonzero(np.diff(at, prepend=-1, append=len(self.rows)))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i, step = int(at[lo]), 2 * self.most
            while lo < hi:
                best = self.rows[i]
                if len(best) == self.most and upper[lo] < -best[-1][0]:
                    break  # no later vector can beat the k-th result
                some = rows[lo : min(lo + step, hi)]
                score = (full[some] @ q[i]).astype(np.int64)
                self.read += len(some)
                new = [(-s, int(x)) for s, r in zip(score.tolist(), some.tolist(), strict=True) for x in ids[starts[r] : ends[r]]]
                self.rows[i] = sorted(best + new)[: self.most]
                lo += step


def refine(sent: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(v, own, found): a vector that asks, its product with itself and its k + 1 best (score, vec_id), its own rows among these.

    reads: how many exact products the query block took, in its first row.
    """
    pairs = sent.join(queries, ["dim", "q"]).sortWithinPartitions("dim", "q", F.desc("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, vs = None, None, None

        def out() -> pa.RecordBatch:
            found = [[{"below": s, "vec_id": i} for s, i in rows] for rows in best.rows]
            kind = pa.list_(pa.struct([("below", pa.int64()), ("vec_id", pa.int64())]))
            reads = pa.array([best.read] + [0] * (len(vs) - 1), pa.int64())
            own = pa.array((best.q * best.q).sum(axis=1), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(vs, pa.binary()), own, pa.array(found, kind), reads], ["v", "own", "found", "reads"])

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if (row["dim"], row["q"]) != now:
                    if now is not None:
                        yield out()
                    now, vs = (row["dim"], row["q"]), row["vs"]
                    best = Best(np.frombuffer(row["queries"], np.int64).reshape(row["n_q"], row["dim"]), k + 1)
                x = np.frombuffer(row["exact"], f"<i{row['size']}").reshape(len(row["ends"]) // 8, row["dim"]).astype(np.int64)
                of = (np.frombuffer(row[c], t) for c, t in (("at", np.int32), ("rows", np.int32), ("upper", np.float32)))
                best.meet(*of, x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64))
        if now is not None:
            yield out()
        release()

    parts = pairs.mapInArrow(run, "v binary, own long, found array<struct<below: long, vec_id: long>>, reads long")
    whole = parts.groupBy("v").agg(F.first("own").alias("own"), F.flatten(F.collect_list("found")).alias("found"), F.sum("reads").alias("reads"))
    best = F.transform(F.slice(F.sort_array("found"), 1, k + 1), lambda x: F.struct((-x.below).alias("score"), x.vec_id.alias("vec_id")))
    return whole.select("v", "own", best.alias("found"), "reads")


def _of_dim(counts: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))[F.col("dim")]


def search(vectors: DataFrame, k: int, every: int, block: int = BLOCK, query_block: int = QUERY_BLOCK, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(asking rows (vec_id, v), what `refine` found for each v)."""
    rows = stash(quantised(vectors).drop("norm2"))
    asks = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "dim")
    # no more than k + 1 rows of a vector are kept, before and after the shuffle
    few = rows.withColumn("_n", F.row_number().over(W.partitionBy("dim", "v").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    kinds = stash(few.groupBy("dim", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asking = stash(asks.select("dim", "v").distinct())
    sizes = kinds.groupBy("dim").agg(F.count("*").alias("n")).join(asking.groupBy("dim").agg(F.count("*").alias("n_q")), "dim").limit(MAX_DIMS + 1).collect()
    if len(sizes) > MAX_DIMS:
        raise ValueError(f"vectors of more than {MAX_DIMS} lengths")
    spark = vectors.sparkSession
    if not sizes:
        return asks, spark.createDataFrame([], FOUND)
    blocks = {r["dim"]: -(-r["n"] // block) for r in sizes}
    groups = {d: -(-n // group) for d, n in blocks.items()}
    query_blocks = {r["dim"]: -(-r["n_q"] // query_block) for r in sizes}
    data = kinds.withColumn("block", F.pmod(F.xxhash64("v"), _of_dim(blocks)).cast("int")).filter("block IS NOT NULL").groupBy("dim", "block").applyInPandas(
        _block, "dim int, block int, n int, steps binary, cells binary, rest binary, size int, exact binary, ids binary, ends binary"
    )
    data = stash(data)
    queries = asking.withColumn("q", F.pmod(F.xxhash64("v", F.lit(1)), _of_dim(query_blocks)).cast("int"))
    queries = stash(queries.groupBy("dim", "q").applyInPandas(_queries, "dim int, q int, n_q int, queries binary, vs array<binary>"))
    left = queries.select("dim", "q", "n_q", "queries", F.explode(F.sequence(F.lit(0), _of_dim(groups) - 1)).alias("g"))
    cells = data.select("dim", "block", F.pmod("block", _of_dim(groups)).alias("g"), "n", "steps", "cells", "rest")
    right = cells.withColumn("q", F.explode(F.sequence(F.lit(0), _of_dim(query_blocks) - 1)))
    pairs = right.join(left.hint("merge"), ["dim", "q", "g"]).sortWithinPartitions("dim", "q", "g")
    found = stash(scan(pairs.select("dim", "q", "g", "block", "n", "steps", "cells", "rest", "n_q", "queries"), k))
    sent = fetch(wanted(found), data.select("dim", "block", "n", "size", "exact", "ids", "ends").hint("merge"))
    return asks, refine(sent, queries.hint("merge"), k)


def top_k(vectors: DataFrame, k: int, every: int, block: int = BLOCK, query_block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all other rows for each row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding.
    """
    asks, found = search(vectors, k, every, block, query_block, group)
    met = asks.select(F.col("vec_id").alias("query_id"), "v").join(found, "v")
    # the query itself stands there with its id and its product with itself, unless k + 1 others are better
    at = F.array_position("found", F.struct(F.col("own").alias("score"), F.col("query_id").alias("vec_id"))).cast("int")
    left = F.when(at > 0, F.concat(F.slice("found", F.lit(1), at - 1), F.slice("found", at + 1, F.lit(k + 1)))).otherwise(F.col("found"))
    ranked = met.select("query_id", F.posexplode(F.slice(left, 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings WHERE embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id,
                 CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
          FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
