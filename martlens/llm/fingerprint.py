r"""Operator 3: document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is a multiset of words. For each of LANES lanes every distinct word w with count S draws, from hashes of
(word, lane), r and c ~ Gamma(2, 1) and beta ~ U(0, 1); t = floor(ln S / r + beta) and ln a = ln c - r (t - beta + 1).
The lane's sample is (w, t) of the smallest a. Two texts agree in a lane with a probability equal to their generalised
Jaccard similarity, sum of min / sum of max of the counts. A sample is kept as a long: ln a in the upper bits, which
orders it, and 24 bits of the sample's identity below; a fingerprint is the identities of all lanes in hex.

A text and its edited form are sampled together: one row for each word of either, whose draws serve both.

Scale: the order of documents comes from a range partitioning of narrow keys (doc_id, hash of text); partition heads
tie the partitions together. Texts are shuffled once by key, a fourth of them once more as the head of the next
document; words are counted and sampled where the text is, without another shuffle. A partition's word counts spill.

Cases: null text is empty; a text without words has the fingerprint of zeros, and two such texts are alike (1.0), a
text with words and one without are not (0.0); rows with one doc_id are ordered by a hash of their text; equal rows
share one place in the order, and each gets the same row; null doc_id comes first; a table of one document is its own
successor; ties of two words in a lane go to the smaller identity; very long texts are taken whole, their words one row
each; an empty table gives no rows; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.llm.common import stash, table

LANES = 32
_BLANK = r"[\x20\x09-\x0D]+"
_U = 1 << 21


def _draws(lane: int) -> tuple[Column, Column, Column]:
    """(r, ln c, beta) of column `word` (a hash) in a lane: five uniform numbers of 21 bits from two hashes."""
    x = F.xxhash64("word", F.lit(lane))
    y = F.xxhash64("word", F.lit(lane), F.lit(1))

    def u(bits: Column, at: int) -> Column:
        return (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(_U - 1)).cast("double") + 0.5) * F.lit(1.0 / _U)

    return -F.ln(u(x, 0) * u(x, 21)), F.ln(-F.ln(u(y, 0) * u(y, 21))), u(x, 42)


def _sample(log_count: Column, r: Column, ln_c: Column, beta: Column) -> Column:
    """ln a and the sample's identity in one long; null where the word is absent (log_count is null)."""
    t = F.floor(log_count / r + beta)  # null stays null; r is at least 2e-7
    order = ((ln_c - r * (t - beta + 1.0)) + 128.0) * F.lit(float(1 << 31))  # ln a is above -80
    mark = F.col("word").bitwiseXOR(t * F.lit(10368889)).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(order.cast("long"), 24).bitwiseOR(mark)


def fingerprints(words: DataFrame, key: str, counts: list[str], lanes: int = LANES) -> DataFrame:
    """key and, for each count column c, fp_c (array<long> of samples, null where the key has no such word).

    words: key, word (a 64-bit hash), and count columns, 0 where a word is absent; one row for each key and word.
    """
    logs = words.select(key, "word", *(F.when(F.col(c) > 0, F.ln(F.col(c).cast("double"))).alias(c) for c in counts))
    mins = []
    for lane in range(lanes):
        draws = _draws(lane)
        mins += [F.min(_sample(F.col(c), *draws)).alias(f"{c}_{lane}") for c in counts]
    got = logs.groupBy(key).agg(*mins)
    low = F.lit((1 << 24) - 1)
    return got.select(
        key,
        *(F.array(*(F.coalesce(F.col(f"{c}_{i}").bitwiseAND(low), F.lit(0)) for i in range(lanes))).alias(f"fp_{c}") for c in counts),
    )


def fingerprint_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of lanes in which two fingerprints agree."""
    hits = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return hits / F.size(a)


def successors(docs: DataFrame) -> DataFrame:
    """(k, n, copies, next, prev, prev_n): the distinct keys k = (doc_id, hash of text) in a ring by ascending order."""
    keys = docs.groupBy("k").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    keys = keys.repartitionByRange("k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id())
    keys = stash(keys)
    inside = W.partitionBy("part").orderBy("k")
    heads = keys.groupBy("part").agg(F.min("k").alias("head"))
    all_heads = W.orderBy("part")  # one row for each partition
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(all_heads), F.first("head").over(all_heads)))
    ring = keys.withColumn("next", F.lead("k").over(inside)).join(heads.select("part", "after"), "part")
    ring = stash(ring.select("k", "n", "copies", F.coalesce("next", "after").alias("next")))
    back = ring.select(F.col("next").alias("k"), F.col("k").alias("prev"), F.col("n").alias("prev_n"))
    return ring.join(back, "k")


def edited_fingerprints(docs: DataFrame, lanes: int = LANES) -> DataFrame:
    """Fingerprints of each text and of its edited form, see op3_fingerprint. docs: doc_id, text."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th")).alias("k"), text.alias("text"))
    ring = successors(keyed.select("k", F.char_length("text").cast("long").alias("n")))
    # both uses below read one exchange
    dealt = keyed.repartition("k").join(ring.hint("merge"), "k")
    heads = dealt.select(F.col("prev").alias("k"), F.left("text", F.floor(F.col("prev_n") / 4).cast("int")).alias("head"))
    heads = heads.groupBy("k").agg(F.first("head").alias("head"))
    kept = F.left("text", (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    both = dealt.dropDuplicates(["k"]).join(heads.hint("merge"), "k").withColumn("edited", F.concat(kept, "head"))
    facts = both.select("k", "n", "copies", "prev", F.sha2("edited", 256).alias("edited_sha256"))
    split = both.select("k", F.explode(F.array(F.struct(F.lit(1).alias("own"), F.lit(0).alias("edit"), "text"),
                                               F.struct(F.lit(0).alias("own"), F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("x"))
    words = split.select("k", "x.own", "x.edit", F.explode(F.split("x.text", _BLANK)).alias("w")).filter("w <> ''")
    words = words.select("k", "own", "edit", F.xxhash64("w").alias("word"))
    counted = words.groupBy("k", "word").agg(F.sum("own").alias("own"), F.sum("edit").alias("edit"))
    prints = fingerprints(counted, "k", ["own", "edit"], lanes)
    none = F.array(*[F.lit(0).cast("long")] * lanes)
    full = facts.join(prints.hint("merge"), "k", "left").select(
        "k", "n", "copies", "prev", "edited_sha256",
        F.coalesce("fp_own", none).alias("fp"), F.coalesce("fp_edit", none).alias("fp_edit"),
    )
    # each fingerprint goes to its own key and to the document before
    own = F.struct("n", "copies", "edited_sha256", "fp", "fp_edit")
    sent = full.select(F.explode(F.array(
        F.struct("k", own.alias("own"), F.lit(None).cast("array<long>").alias("next")),
        F.struct(F.col("prev").alias("k"), F.lit(None).cast(full.select(own.alias("o")).schema["o"].dataType).alias("own"), F.col("fp").alias("next")),
    )).alias("s")).select("s.*")
    met = sent.groupBy("k").agg(F.first("own", True).alias("own"), F.first("next", True).alias("next"))
    met = met.select("k.doc_id", "own.*", "next").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return met.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprint_text(F.col("fp_edit")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp_edit")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next")).alias("near_next"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text and its edited text: the last fourth replaced by as much of the next document's beginning."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
