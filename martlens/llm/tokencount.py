r"""Operator 5: token counts by a linear longest-match automaton.

Greedy longest-match word pieces, counted without building them: a trie over the vocabulary with failure links. A
node's link leads to where matching goes on after the pieces that its text surely starts with are popped; how many
those are is precomputed. Reading a word moves along the trie or pops and follows links, so a word of n characters
costs O(n), whatever its pieces. Pieces that start a word and pieces that continue one have roots of their own. A word
that can't be cut into pieces is one unknown token.

Words are counted once for each worker process in a cache of CACHE words at most, which is emptied when full. The
corpus is read once and never shuffled. The vocabulary file is a parameter and is sent to the executors.

Cases: null text has no words; an empty table gives no rows; very long texts and words are counted whole; repeated rows
count each; there are no ties, the longest piece is one; columns besides text and `keep` are ignored, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import chunks, release, schema_of, ship, table, texts_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 1 << 18  # some 40 MB, without words of more than KEPT bytes
KEPT = 64
NONE, START, GO_ON = -1, 0, 1


class Automaton:
    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.next: dict[tuple[int, str], int] = {}
        final, edges = [False, False], [[], []]
        for root, pieces in ((START, initial), (GO_ON, inner)):
            for p in pieces:
                at = root
                for c in p:
                    to = self.next.get((at, c))
                    if to is None:
                        to = self.next[at, c] = len(final)
                        final.append(False)
                        edges.append([])
                        edges[at].append((c, to))
                    at = to
                final[at] = at > GO_ON
        self.link, self.popped = [NONE] * len(final), [0] * len(final)
        queue = deque((START, GO_ON))
        while queue:
            at = queue.popleft()
            for c, to in edges[at]:
                queue.append(to)
                if final[to]:
                    self.link[to], self.popped[to] = GO_ON, 1
                    continue
                z, pops = self.link[at], self.popped[at]
                while z != NONE and (z, c) not in self.next:
                    pops, z = pops + self.popped[z], self.link[z]
                if z != NONE:
                    self.link[to], self.popped[to] = self.next[z, c], pops

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if it has no such cut."""
        at, n, step, link, popped = START, 0, self.next, self.link, self.popped
        for c in word:
            to = step.get((at, c))
            while to is None:
                n += popped[at]
                at = link[at]
                if at == NONE:
                    return 0
                to = step.get((at, c))
            at = to
        while at != GO_ON:
            n += popped[at]
            at = link[at]
            if at == NONE:
                return 0
        return n


class Counts(dict):
    """word -> (tokens, unknown as 0 or 1) packed as tokens * 2 + unknown."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.automaton.count(word.decode("utf-8", "replace"))
        out = n * 2 if n else 3
        if len(word) <= KEPT:
            self[word] = out
        return out


@lru_cache(2)
def counts_of(path: str) -> Counts:
    """The cache of a vocabulary, one for each worker process. Byte pieces and special tokens are no text pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    initial = [p[1:] for p in text if p[0] == "▁" and p.strip("▁") and p[1] != "▁"]
    return Counts(Automaton(initial, [p for p in text if "▁" not in p]))


def count_tokens(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` columns with n_words, n_tokens and n_unknown (words without a cut, one token each)."""

    path = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(path())
        for batch in batches:
            for b in chunks(batch, "_text"):
                words, tokens, unknown = [], [], []
                for text in texts_of(b.column("_text")):
                    packed = list(map(counts.__getitem__, text.split()))
                    odd = sum(x & 1 for x in packed) if 3 in packed else 0
                    words.append(len(packed))
                    unknown.append(odd)
                    tokens.append((sum(packed) - odd) >> 1)
                new = [pa.array(x, pa.int64()) for x in (words, tokens, unknown)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], [*keep, "n_words", "n_tokens", "n_unknown"])
        release()

    schema = schema_of(docs, keep, "n_words long, n_tokens long, n_unknown long")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
