"""Operator 1: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source are dealt to shards by a seeded hash; the stream of each shard is cut into blocks of equal
length, BLOCK_WORDS or nearly, whatever the size of the source. Seats are blocks: they go to the sources by highest
quotient of target / (2k + 1), and a source's seats go to its shards in the same way, which gives every shard an integer
quota. A shard with n blocks and quota q takes every block q // n times and q % n seeded ones once more. A source that
is wanted at most c times over never has a block taken more than c times.

Scale: words are counted in one pass over the texts; everything after that moves (doc_id, source, size). A shard
holds about SHARD_BLOCKS blocks, and a source has as many shards as that asks for, so a source with a third of all
rows is spread over as many tasks as its size asks for. A document carries only the blocks that it lies in. The driver
sees one row for each source, and raises an error beyond MAX_SOURCES of them; the seats of the shards of one source
(16 bytes for each 30,000 words) meet in one task.

Cases: null text has size 0; a document of size 0 is taken 0 times; a null source is a source of its own, after all
others; repeated rows count each, and rows with one doc_id and different texts are ordered by a hash of the text; very
long texts are counted whole; an empty table gives an empty result; columns besides those that are kept are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.llm.common import chunks, release, schema_of, stash, table, texts_of

BLOCK_WORDS, SHARD_BLOCKS, MAX_SOURCES, SEED = 32, 1024, 1_000_000, 17


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    block_words: int = BLOCK_WORDS
    shard_blocks: int = SHARD_BLOCKS
    seed: int = SEED


def apportion(votes: list[float], seats: int, most: list[float] | None = None) -> list[int]:
    """Sainte-Lague: seats one by one to the highest votes / (2 * seats so far + 1); ties to the earlier party.

    Most seats are settled at once by a divisor that surely leaves some over; the rest is dealt one at a time.
    """
    most = [float("inf")] * len(votes) if most is None else most
    total, got = sum(votes), [0] * len(votes)
    if total <= 0 or seats <= 0:
        return got
    spare = max(0, seats - len(votes))
    got = [int(min(m, max(0, np.floor(v * spare / total - 0.5)))) for v, m in zip(votes, most, strict=True)]
    queue = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0 and g < most[i]]
    heapq.heapify(queue)
    left = seats - sum(got)
    while left > 0 and queue:
        _, i = heapq.heappop(queue)
        got[i], left = got[i] + 1, left - 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words wanted of each source: `share` of all words by weight, at most `most` times a source's own.

    What a full source can't take is shared again by weight among the others, until none is above its limit.
    """
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
            open_.discard(i)
        left -= sum(out[i] for i in full)
    return out


def with_sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, _hash of the text and size, its number of words. Counted on whole UTF-8 buffers, as bytes.split() cuts."""
    schema = schema_of(docs, keep, "_hash long, size long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                size = pa.array([len(x.split()) for x in texts_of(b.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("_hash"), size], [*keep, "_hash", "size"])
        release()

    hashed = docs.select(*keep, F.xxhash64("text").alias("_hash"), "text")
    return hashed.mapInArrow(count, schema)


def _times(blocks: int, quota: int, key: tuple, seed: int) -> list[int]:
    """How often each block of a shard is taken: the seeded choice."""
    times = np.full(blocks, quota // blocks, np.int8)
    rng = np.random.Generator(np.random.PCG64([seed, *(b for x in key for b in str(x).encode())]))
    times[rng.permutation(blocks)[: quota % blocks]] += 1
    return times.tolist()


def plan(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """sid, source_size, target, shards and quota (blocks to take) of each source of rows with source, size."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to apportion")
    rows = sorted(rows, key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    own = [int(r["size"] or 0) for r in rows]
    want = targets(own, [spec.weights[i % len(spec.weights)] for i in range(len(rows))], spec.share, spec.most)
    units = [max(1, round(n / spec.block_words)) if n else 0 for n in own]
    seats = apportion(want, round(sum(want) / spec.block_words), [np.floor(spec.most * u) for u in units])
    of = [
        (r["source"], i, n, t, max(1, round(n / (spec.block_words * spec.shard_blocks))), q)
        for i, (r, n, t, q) in enumerate(zip(rows, own, want, seats, strict=True))
    ]
    return sizes.sparkSession.createDataFrame(of, "source string, sid int, source_size long, target double, shards int, quota long")


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (doc_id and source among them) with size, source_size, target, taken and the words' place.

    [from, to) is the range of the words of its shard that a document fills, edges are those of the blocks that it lies
    in, and times says how often each of these blocks is taken.
    """
    keep = keep or ["doc_id", "source"]
    sizes = stash(with_sizes(docs, keep))
    sources = plan(sizes, spec)
    dealt = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).drop(sources.source)
    dealt = dealt.withColumn("draw", F.xxhash64(F.lit(spec.seed), "doc_id", "_hash"))
    dealt = dealt.withColumn("shard", F.pmod(F.col("draw"), F.col("shards").cast("long")).cast("int"))
    shards = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("tokens"), F.first("quota").alias("quota"))
    most, block = spec.most, spec.block_words

    def deal(group: pd.DataFrame) -> pd.DataFrame:  # the shards of one source
        group = group.sort_values("shard")
        blocks = [max(1, round(t / block)) if t else 0 for t in group.tokens]
        quota = apportion([float(n) for n in blocks], int(group.quota.iloc[0]), [np.floor(most * n) for n in blocks])
        return pd.DataFrame({"sid": group.sid, "shard": group.shard, "tokens": group.tokens, "blocks": blocks, "quota": quota})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["all_times"] = [_times(int(n), int(q), (s, h), spec.seed) if n else [] for s, h, n, q in zip(b.sid, b.shard, b.blocks, b.quota, strict=True)]
            yield b.drop(columns="quota")

    quotas = shards.groupBy("sid").applyInPandas(deal, "sid int, shard int, tokens long, blocks long, quota long")
    quotas = quotas.mapInPandas(choose, "sid int, shard int, tokens long, blocks long, all_times array<tinyint>")
    stream = W.partitionBy("sid", "shard").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("to", F.sum("size").over(stream)).withColumn("from", F.col("to") - F.col("size"))
    placed = placed.drop("quota").join(quotas.hint("merge"), ["sid", "shard"])
    # block i holds the words [i * tokens div blocks, (i + 1) * tokens div blocks) of its shard
    placed = placed.withColumn("first", F.expr("CASE WHEN size > 0 THEN ((`from` + 1) * blocks - 1) div tokens ELSE 0 END"))
    placed = placed.withColumn("n", F.expr("CASE WHEN size > 0 THEN (`to` * blocks - 1) div tokens - first + 1 ELSE 0 END"))
    edge = "(first + {}) * tokens div greatest(blocks, 1)".format
    times = "slice(all_times, int(first) + 1, int(n))"
    placed = placed.withColumn("times", F.expr(times)).withColumn("edges", F.expr(f"transform(sequence(0, int(n)), i -> {edge('i')})"))
    parts = f"transform({times}, (t, i) -> t * (least({edge('i + 1')}, `to`) - greatest({edge('i')}, `from`)))"
    placed = placed.withColumn("taken", F.expr(f"CASE WHEN size > 0 THEN aggregate({parts}, 0L, (s, x) -> s + x) ELSE 0L END"))
    return placed.select(*keep, "size", "source_size", "target", "taken", "sid", "shard", "from", "to", "edges", "times")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
