"""Columns of documents that are called like names that the pipeline's stages use, or used, themselves."""

import random

from pyspark.sql import functions as F

NAMES = ["_k", "_n", "_th", "k", "n", "th", "row", "rest", "plan", "host", "row_hash", "leads", "size", "taken", "from", "to", "edges", "times", "kept", "chunk", "score", "lines"]


def test_no_stage_overwrites_a_column(spark, words=None):
    import corpus_pipeline as P

    g = random.Random(9)
    words = ["".join(g.choice("aeiounrst") for _ in range(g.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(g.choices(words, k=g.randint(30, 80))), "en", f"s{i % 3}") for i in range(40)]
    rows.append((40, rows[3][1], "en", "s0"))
    docs = spark.createDataFrame([(i, t, la, so, len(t)) for i, t, la, so in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *((F.col("doc_id") * 100 + j).alias(n) for j, n in enumerate(NAMES))).persist()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) >= 30, name
        for r in got:
            assert [r[n] for n in NAMES] == [r.doc_id * 100 + j for j in range(len(NAMES))], name
    runs = P.STAGES[-1][1](spark, docs, "").collect()
    assert len(runs) == 41 and all(r.round_trip for r in runs)
