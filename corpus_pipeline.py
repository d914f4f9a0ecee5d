"""The corpus pipeline: documents to sampled training segmentations, in five stages that each write and reread Parquet.

1. language ID: documents without letters, or in no language for the most part, go;
2. line dedup: lines that a source repeats on too many of its distinct texts go, and documents that had no other;
3. near-duplicates: the document with the smallest id of each group stays; rows that share an id but not a group are
   documents of their own, and of rows that are equal in id and text one stays;
4. mixing: sources are mixed to their target weights by blocks of words; a document of which only some blocks are
   taken is cut to the taken runs of words, one that is taken twice comes twice;
5. SentencePiece: each row of the mix is encoded as the K segmentations that op2 samples without replacement, with
   their inclusion scores, and all of them are decoded again and compared with the text. A row's draws are keyed by its
   doc_id and a hash of its text, which the result carries, so the runs of one document have draws of their own.

All stages but the last return the columns of documents, whatever these are besides doc_id, text, lang, source and
n_chars. Null texts and texts without a letter go in stage 1; a null source is a source; very long texts are taken whole
(see each operator's bound); an empty table passes through all stages. Intermediate tables are written to the shared
folder that spark.checkpoint.dir names; one goes as soon as the next is written, and the last stays for its reader.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlens.llm import langid, lines, mixing, neardup, pieces
from martlens.llm.common import chunks, release, schema_of, shared_folder

LEAST_SCORE = 0.3
#: Of a source's distinct texts; a source has far more documents than a site has pages (lines.RATIO), with less in common.
SOURCE_RATIO = 0.02
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _with_text(rest: Column, columns: list[str]) -> list[Column]:
    """The columns of documents again: text as it is now, n_chars counted anew, the others out of `rest`."""
    now = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return [now.get(c, rest.getField(c)).alias(c) for c in columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language; the model is learnt from the stage's own labelled rows."""
    model = langid.fit(docs)
    found = langid.detect(docs.select(F.struct("*").alias("row")), model, ["row"], inside="row", spans=False)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that more than SOURCE_RATIO of a source's distinct texts contain; a source is a site."""
    rest = [c for c in docs.columns if c != "text"]
    pages = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("source").alias("host"), "text")
    left = lines.drop_boilerplate(pages, SOURCE_RATIO, distinct=True).filter((F.col("n_dropped") == 0) | F.col("text").rlike(_WORD.pattern))
    return left.select(*_with_text(F.col("rest"), docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of equal rows, one."""
    leads = neardup.near_duplicates(docs.select("doc_id", "text")).filter("leads").select(F.struct("doc_id", "row_hash").alias("k")).distinct()
    some = docs.select(F.struct("doc_id", F.xxhash64("text").alias("row_hash")).alias("k"), F.struct("*").alias("row")).join(leads, "k", "left_semi")
    first = W.partitionBy("k").orderBy("row.source", "row.lang")
    return some.withColumn("n", F.row_number().over(first)).filter("n = 1").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken runs of words of each document, a whole text where all of it is taken."""
    rest = [c for c in docs.columns if c != "text"]
    key = F.struct("doc_id", "source", F.xxhash64("text").alias("th")).alias("k")
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("th"))
    plan = mixing.mix(keyed, keep=["doc_id", "source", "th"]).filter("taken > 0").dropDuplicates(["doc_id", "source", "th"])
    plan = plan.select(F.struct("doc_id", "source", "th").alias("k"), F.struct("from", "to", "edges", "times").alias("plan"))
    texts = docs.select(key, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                at, out = [], []
                for i, (text, p) in enumerate(zip(b.column("text").to_pylist(), b.column("plan").to_pylist(), strict=True)):
                    for x in taken_texts(text, p["from"], p["to"], p["edges"], p["times"]):
                        at.append(i)
                        out.append(x)
                yield pa.RecordBatch.from_arrays([b.column("rest").take(pa.array(at, pa.int32())), pa.array(out, pa.string())], ["rest", "text"])
        release()

    met = texts.join(plan.hint("merge"), "k").select("rest", "text", "plan")
    return met.mapInArrow(cut, schema_of(met, ["rest"], "text string")).select(*_with_text(F.col("rest"), docs.columns))


def taken_texts(text: str, start: int, end: int, edges: list[int], times: list[int]) -> list[str]:
    """Runs of a document's words [start, end) of its shard that the mix takes once, then those it takes twice, ...

    edges, times: the edges of the shard's blocks that the document lies in, and how often each of them is taken.
    """
    taken, out, spans = np.array(times), [], None
    for level in range(1, int(taken.max(initial=0)) + 1):
        on = np.concatenate([[False], taken >= level, [False]])
        for a, b in np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2).tolist():
            lo, hi = max(start, edges[a]) - start, min(end, edges[b]) - start
            if (lo, hi) == (0, end - start):
                out.append(text)
                continue
            spans = spans or [m.span() for m in _WORD.finditer(text)]
            out.append(text[spans[lo][0] : spans[hi - 1][1]])
    return out


ENCODED = (
    "n_pieces long\nids array<int>\nlog_prob double\ninclusion double\n"
    "further array<struct<ids: array<int>, log_prob: double, inclusion: double>>\nround_trip boolean"
)


def _encoded(text: str | None, found: list[pieces.Sample], vocabulary: pieces.Vocabulary) -> tuple:
    same = all(vocabulary.decode(s.ids.tolist()) == (text or "") for s in found)
    first, *rest = found
    further = [{"ids": s.ids, "log_prob": s.log_prob, "inclusion": s.inclusion} for s in rest]
    return len(first.ids), first.ids, first.log_prob, first.inclusion, further, same


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, row_hash, lang, source and K sampled segmentations of each row: the best in columns, the others in `further`.

    A text with fewer segmentations has them all. round_trip: each of them decodes to the text.
    """
    runs = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "lang", "source", "text")
    runs = runs.withColumn("_run", F.concat_ws("/", "doc_id", "row_hash"))
    return pieces.encode(runs, "_run", ["doc_id", "row_hash", "lang", "source"], emit=_encoded, emitted=ENCODED)


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pieces", encode),
]

#: The language model and the sampled segmentations are beyond SQL. tests/llm compares stages 2, 3 and 4 with plain Python
#: (all pairs, counted lines, replayed runs), and stages 1 and 5 with the operators, which have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; what each returns is written and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
