r"""Operator 2: SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text is a lattice: nodes are positions, edges the vocabulary's pieces (bytes where a character has none), an edge's
weight is -ALPHA * ln(2 + rank of the piece), and a segmentation's probability is proportional to the product of its
weights. Sampling K segmentations without replacement is a perturbed A-star search: a partial segmentation is a search
node whose priority is the largest Gumbel-perturbed log probability among its completions. That maximum is drawn top
down: it is known for the root, one child inherits it (the child is drawn by its share of the mass) and each group of
the other children gets a Gumbel of its own mass, truncated at the parent's. Popping nodes in order of priority emits
distinct segmentations, best first; the next priority after the K-th is the threshold kappa, and a segmentation with
log probability phi is in the sample with probability 1 - exp(-exp(phi - kappa)), its inclusion score.

Pieces never reach over the space before a word or over a line end, so the lattice of a text is a chain of word
lattices, and its mass a product. A worker keeps the lattices of the words that it met, up to EDGES edges, and starts
anew beyond that. All words of all texts of a chunk walk their lattices together, one edge a step, and so do all
texts' branches; what follows a branch is drawn anew.

Decoding is exact: U+2581 within a text is encoded by its bytes only, so decode(encode(text)) == text always.
Randomness comes from the row's key and the seed alone. The corpus is read once, whole, and never shuffled.

Cases: null and empty texts have one segmentation, the empty one, with score 1; a text with fewer than K segmentations
emits all of them; equal rows get equal samples; a null key is a key; an empty table gives no rows; a surrogate cannot
occur in UTF-8; columns besides text, the key and `keep` are ignored, whatever their names. A very long text is whole:
arrays are bounded by CHUNK bytes of text, or one text, at about 100 bytes for each of its characters.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from martlens.llm.common import chunks, mix64, release, schema_of, ship, table, unit

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
K, ALPHA, SEED, CHUNK = 2, 1.0, 11, 1 << 18
#: Edges of word lattices that a worker keeps: about 24 bytes each, and as much again for the words themselves.
EDGES = 1 << 20
SPACE = "▁"
#: Runs of spaces stay with the word behind them; a line end is a unit of its own.
_UNITS = re.compile(r" *[^ \n]+|\n| +")


def _next_hash(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return h * np.uint64(0xD1342543DE82EF95) + (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[p] = i
                self.raw.append(p.replace(SPACE, " ").encode())
        self.weight = np.log(2.0 + np.arange(n))
        # for each length the hashes of all prefixes of pieces, sorted, with the id of the piece that ends there or -1,
        # and where the hashes with each head start
        self.prefixes: list[tuple[np.ndarray, np.ndarray, np.uint64, np.ndarray]] = []
        for size in range(1, max(map(len, self.ids)) + 1):
            known = sorted({p[:size] for p in self.ids if len(p) >= size})
            h = np.zeros(len(known), np.uint64)
            for c in np.array([[ord(x) for x in p] for p in known], np.uint64).reshape(-1, size).T:
                h = _next_hash(h, c)
            order = np.argsort(h)
            h = np.append(h[order], ~np.uint64(0))
            bits = len(known).bit_length() + 2
            heads = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            self.prefixes.append((h, np.array([*(self.ids.get(known[i], -1) for i in order), -1], np.int64), np.uint64(64 - bits), heads))
        self.one_byte = np.array([self.bytes[b] for b in range(128)], np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the space put before the text is dropped."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Lattices:
    """States (word, position) of the words met lately, with their edges in flat arrays that grow by a third.

    A state's edges stand together, the longest first; upto is their cumulative probability. piece is the vocabulary id,
    or -1 - code point for a character that is spelled in several bytes; to is -1 at a word's end. `trim` drops all words
    when they have more than EDGES edges, whatever their number and length.
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.v, self.alpha = vocabulary, alpha
        self.words: dict[str, int] = {}
        self.states = self.size = 0
        self.first = np.zeros(1 << 10, np.int64)  # of a state: its first edge
        self.upto, self.p = np.zeros(1 << 12), np.zeros(1 << 12)
        self.piece, self.to = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def _room(self, states: int, edges: int) -> None:
        if self.states + states + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(len(self.first) // 3 + states + 1, np.int64)])
        if self.size + edges > len(self.p):
            more = len(self.p) // 3 + edges
            self.upto, self.p = (np.concatenate([x, np.zeros(more)]) for x in (self.upto, self.p))
            self.piece, self.to = (np.concatenate([x, np.zeros(more, np.int32)]) for x in (self.piece, self.to))

    def add(self, words: list[str]) -> np.ndarray:
        """Build the lattices of some words, all at once; their start states."""
        v = self.v
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        literal = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        # spaces become the vocabulary's mark; a literal mark becomes a code point that no piece has
        codes = np.where(literal == 32, ord(SPACE), np.where(literal == ord(SPACE), 0xD800, literal)).astype(np.uint64)
        left = np.repeat(ends, sizes) - np.arange(n)
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        count, found = np.zeros(n, np.int64), []
        for size, (known, ids, head, heads) in enumerate(v.prefixes, 1):
            h = _next_hash(h, codes[alive + (size - 1)])
            at = heads[h >> head]
            less = np.flatnonzero(known[at] < h)
            while len(less):
                at[less] += 1
                less = less[known[at[less]] < h[less]]
            hit = known[at] == h
            piece = np.where(hit, ids[at], -1)
            if size == 1:  # bytes stand for a character without a piece
                spelled = np.where(literal < 128, v.one_byte[np.minimum(literal, 127)], -1 - literal)
                weight = np.where(piece >= 0, v.weight[piece], 3 * v.weight[-1])
                own, piece = alive, np.where(piece >= 0, piece, spelled)
            else:
                ok = np.flatnonzero(piece >= 0)
                own, piece = alive[ok], piece[ok]
                weight = v.weight[piece]
            found.append((own, piece, weight, count[own]))
            count[own] += 1
            go = np.flatnonzero(hit & (left[alive] > size))
            alive, h = alive[go], h[go]
            if not len(alive):
                break
        # states are numbered by the characters that are left, so that those with as many stand together
        order = np.argsort(left.astype(np.int16) if sizes.max() < 1 << 15 else left, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        first = np.zeros(n + 1, np.int64)
        np.cumsum(count[order], out=first[1:])
        last = first[rank + 1] - 1
        edges = int(first[-1])
        pieces, to, cost = np.empty(edges, np.int32), np.empty(edges, np.int64), np.empty(edges)
        for size, (own, piece, weight, before) in enumerate(found, 1):
            at = last[own] - before  # the longest first, the single character last
            pieces[at], cost[at] = piece, self.alpha * weight
            to[at] = np.where(left[own] > size, rank[np.minimum(own + size, n - 1)], -1)
        mass, p = np.zeros(n + 1), np.empty(edges)  # mass[-1] is that of a word's end
        cuts = np.searchsorted(left[order], np.arange(1, int(sizes.max()) + 2)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = first[a], first[b]
            x, starts, n_of = mass[to[lo:hi]] - cost[lo:hi], first[a:b] - lo, np.diff(first[a : b + 1])
            base = x[first[a + 1 : b + 1] - lo - 1]
            x = np.exp(x - np.repeat(base, n_of))
            total = np.add.reduceat(x, starts)
            mass[a:b] = base + np.log(total)
            p[lo:hi] = x / np.repeat(total, n_of)
        run = np.cumsum(p)
        upto = run - np.repeat(run[first[:-1]] - p[first[:-1]], np.diff(first))
        upto[first[1:] - 1] = 1.0
        self._room(n, edges)
        at, end = self.size, self.size + edges
        self.upto[at:end], self.p[at:end], self.piece[at:end] = upto, p, pieces
        self.to[at:end] = np.where(to >= 0, to + self.states, -1)
        self.first[self.states : self.states + n + 1] = first + at
        out = rank[ends - sizes] + self.states
        self.states, self.size = self.states + n, end
        return out

    def starts(self, words: list[str]) -> np.ndarray:
        """The start state of each word; holds until `trim`."""
        known = list(map(self.words.get, words))
        if None in known:
            new = list(dict.fromkeys(w for w, at in zip(words, known, strict=True) if at is None))
            new.sort(key=len)
            for some in _parts(new, 1 << 16):  # bounds the arrays of a build
                self.words.update(zip(some, self.add(some).tolist(), strict=True))
            known = list(map(self.words.__getitem__, words))
        return np.array(known, np.int64)

    def empty(self) -> None:
        """Give the room of all words back."""
        self.__init__(self.v, self.alpha)

    def trim(self) -> None:
        if len(self.p) > 4 * EDGES:
            self.empty()
        elif self.size > EDGES:
            self.words.clear()
            self.states = self.size = 0

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each state that u in [0, 1) falls on."""
        e = self.first[state]
        open_ = np.flatnonzero(self.upto[e] <= u)
        while len(open_):
            e[open_] += 1
            open_ = open_[self.upto[e[open_]] <= u[open_]]
        return e

    def edges_beside(self, edges: np.ndarray) -> tuple[list[int], list[int]]:
        """For each edge, the first edge of its state and of the next state."""
        state = np.searchsorted(self.first[: self.states + 1], edges, side="right") - 1
        return self.first[state].tolist(), self.first[state + 1].tolist()


def _parts(words: list[str], chars: int) -> Iterator[list[str]]:
    """Runs of words with about so many characters."""
    start = total = 0
    for i, w in enumerate(words):
        if total + len(w) > chars and i > start:
            yield words[start:i]
            start, total = i, 0
        total += len(w)
    if words[start:]:
        yield words[start:]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [starts, ends), one after the other."""
    n = ends - starts
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)


def _walk(lat: Lattices, state: np.ndarray, keys: np.ndarray, word: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """(edge, which) of a random walk from each of the states to its word's end, in order of the states."""
    live, edges, units, t = np.arange(len(state)), [], [], 0
    salt = keys + mix64((word << 16) + np.int64(draw << 48))
    while len(live):
        e = lat.draw(state, unit(mix64(salt[live] + _odd(t))))
        edges.append(e)
        units.append(live)
        nxt = lat.to[e]
        go = np.flatnonzero(nxt >= 0)
        live, state, t = live[go], nxt[go], t + 1
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    e, i = np.concatenate(edges), np.concatenate(units)
    order = np.argsort(i, kind="stable")
    return e[order], i[order]


def _odd(n: int) -> np.uint64:
    return np.uint64((2 * n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def _truncated(loc: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels with locations loc, given that they are at most `top`: F(g) = u F(top)."""
    return loc - np.log(np.exp(loc - top) - np.log(u))


@dataclass
class _Paths:
    """One path of each of some texts: its edges and their units, text after text (ends), and its log probability."""

    edges: np.ndarray
    units: np.ndarray
    ends: np.ndarray
    phi: np.ndarray


@dataclass(order=True)
class _Node:
    """All segmentations that follow `path` up to step `at` and take another edge there than those in `taken`."""

    priority: float
    order: int
    path: int = field(compare=False)
    at: int = field(compare=False)
    taken: tuple[int, ...] = field(compare=False)
    phi: float = field(compare=False)  # log probability of the prefix


@dataclass(frozen=True)
class Sample:
    ids: np.ndarray
    log_prob: float
    perturbed: float
    inclusion: float


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sums within each text, so that they don't depend on the texts beside it."""
    out = np.empty(len(x))
    at = ends.tolist()
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        np.cumsum(x[lo:hi], out=out[lo:hi])
    return out


def _best(g: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, place in g) of each text's largest finite g, then of its next one, `most` times; g is used up."""
    rows = np.flatnonzero(np.diff(ends))
    n_of = np.diff(ends)[rows]
    for _ in range(most if len(rows) else 0):
        at = np.flatnonzero((g == np.repeat(np.maximum.reduceat(g, ends[rows]), n_of)) & (g > -np.inf))
        text = np.searchsorted(ends, at, side="right") - 1
        new = np.diff(text, prepend=-1) > 0
        yield text[new], at[new]
        g[at[new]] = -np.inf


def sample(texts: list[str | None], keys: list[int], lat: Lattices, k: int = K) -> list[list[Sample]]:
    """The k sampled segmentations of each text, best first; fewer where the text has no more.

    Texts advance together: round r gives all of them their r-th path. Only the few nodes of a text's queue are
    handled one by one.
    """
    units, owner_n = [], []
    for t in texts:
        own = _UNITS.findall(" " + t) if t else []
        units += own
        owner_n.append(len(own))
    start = lat.starts(units)
    p_of = lat.p
    first_unit = np.concatenate([[0], np.cumsum(np.array(owner_n, np.int64))])
    key = np.array([x & (1 << 64) - 1 for x in keys], np.uint64)
    queues: list[list[_Node]] = [[] for _ in texts]
    rounds: list[_Paths] = []
    row_of: list[dict[int, int]] = []  # of each round: text -> its row there
    got: list[list[tuple[int, float, float]]] = [[] for _ in texts]  # (round, log probability, perturbed)

    def uniform(d: np.ndarray, purpose: int, n: np.ndarray = np.zeros(1, np.int64)) -> np.ndarray:
        return unit(mix64(key[d] + mix64(n + np.int64((purpose << 40) + (1 << 62)))))

    def fresh(d: np.ndarray, since: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(edge, unit) of walks through the units [since, end) of texts d."""
        u = _ranges(since, first_unit[d + 1])
        of = np.repeat(d, first_unit[d + 1] - since)
        e, i = _walk(lat, start[u], key[of], u - first_unit[of], 2 * r)
        return e, u[i]

    def spread(r: int, d: np.ndarray, since: np.ndarray, phi: np.ndarray, top: np.ndarray) -> None:
        """Record round r's paths of texts d; steps from `since` on are new, phi is known up to there."""
        paths = rounds[r]
        n_new = np.diff(paths.ends) - since
        ends = np.concatenate([[0], np.cumsum(n_new)])
        at = _ranges(paths.ends[:-1] + since, paths.ends[1:])
        p = p_of[paths.edges[at]]
        log_p = np.log(p)
        row = np.repeat(np.arange(len(d)), n_new)
        run = _sums(log_p, ends) + phi[row]
        paths.phi = phi.copy()
        some = np.flatnonzero(n_new)
        paths.phi[some] = run[ends[some + 1] - 1]
        g = np.full(len(p), -np.inf)
        free = np.flatnonzero(p < 1)  # a step without another edge has no siblings
        step = at[free] - paths.ends[row[free]]
        g[free] = _truncated((run - log_p)[free] + np.log1p(-p[free]), top[row[free]], uniform(d[row[free]], 3 * r, step))
        before = run - log_p
        values = g.copy()
        # no more siblings than these can come before the k-th result or give the threshold
        for text, place in _best(g, ends, k - r):
            of_text = (d[text], at[place] - paths.ends[text], values[place], before[place], paths.edges[at[place]])
            for t, s, v, b, e in zip(*(x.tolist() for x in of_text), strict=True):
                heapq.heappush(queues[t], _Node(-v, r << 40 | s, r, s, (e,), b))
        for j, t in enumerate(d.tolist()):
            got[t].append((r, float(paths.phi[j]), float(top[j])))

    every = np.arange(len(texts))
    e, i = fresh(every, first_unit[:-1], 0)
    rounds.append(_Paths(e, i, np.searchsorted(i, first_unit), np.zeros(0)))
    row_of.append({t: t for t in range(len(texts))})
    spread(0, every, np.zeros(len(texts), np.int64), np.zeros(len(texts)), -np.log(-np.log(uniform(every, 1))))
    for r in range(1, k):
        active = [t for t, queue in enumerate(queues) if queue and len(got[t]) == r]
        if not active:
            break
        nodes = [heapq.heappop(queues[t]) for t in active]
        d = np.array(active, np.int64)
        top = -np.array([x.priority for x in nodes])
        phi = np.array([x.phi for x in nodes])
        parent = np.array([x.path for x in nodes])
        at = np.array([x.at for x in nodes], np.int64)
        base = np.array([rounds[x.path].ends[row_of[x.path][t]] for x, t in zip(nodes, active, strict=True)], np.int64)
        here = np.array([rounds[x.path].units[b + x.at] for x, b in zip(nodes, base.tolist(), strict=True)], np.int64)
        u_pick, u_rest = uniform(d, 3 * r + 1), uniform(d, 3 * r + 2)
        lo, hi = lat.edges_beside(np.array([x.taken[0] for x in nodes], np.int64))
        pick, rest = np.empty(len(d), np.int64), np.zeros(len(d))
        for j, (node, a, b) in enumerate(zip(nodes, lo, hi, strict=True)):
            options = [x for x in range(a, b) if x not in node.taken]
            weights = p_of[options].tolist()
            goal, x = u_pick[j] * sum(weights), 0
            while x < len(options) - 1 and goal >= weights[x]:
                goal, x = goal - weights[x], x + 1
            pick[j], rest[j] = options[x], sum(weights) - weights[x] if len(options) > 1 else 0.0
        more = np.flatnonzero(rest > 0)
        g = _truncated(phi[more] + np.log(rest[more]), top[more], u_rest[more])
        for j, v in zip(more.tolist(), g.tolist(), strict=True):
            x = nodes[j]
            heapq.heappush(queues[active[j]], _Node(-v, r << 40 | x.at, x.path, x.at, (*x.taken, int(pick[j])), x.phi))
        # the rest of this unit step by step, the following units from a fresh walk
        going = np.flatnonzero(lat.to[pick] >= 0)
        tail, of = _walk(lat, lat.to[pick[going]], key[d[going]], (here - first_unit[d])[going], 2 * r + 1)
        of = going[of] if len(of) else of
        new_e, new_u = fresh(d, here + 1, r)
        n_tail = np.bincount(of, minlength=len(d))
        n_new = np.searchsorted(new_u, first_unit[d + 1]) - np.searchsorted(new_u, here + 1)
        ends = np.concatenate([[0], np.cumsum(at + 1 + n_tail + n_new)])
        edges, own = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64)
        for q in set(parent.tolist()):
            mine = np.flatnonzero(parent == q)
            src, dst = _ranges(base[mine], base[mine] + at[mine]), _ranges(ends[mine], ends[mine] + at[mine])
            edges[dst], own[dst] = rounds[q].edges[src], rounds[q].units[src]
        edges[ends[:-1] + at], own[ends[:-1] + at] = pick, here
        dst = _ranges(ends[:-1] + at + 1, ends[:-1] + at + 1 + n_tail)
        edges[dst], own[dst] = tail, here[of]
        dst = _ranges(ends[1:] - n_new, ends[1:])
        edges[dst], own[dst] = new_e, new_u
        rounds.append(_Paths(edges, own, ends, np.zeros(0)))
        row_of.append({t: j for j, t in enumerate(active)})
        spread(r, d, at + 1, phi + np.log(p_of[pick]), top)
    pieces = [ids_of(paths, lat) for paths in rounds]
    lat.trim()
    out = []
    for t, found in enumerate(got):
        kappa = -queues[t][0].priority if queues[t] else -math.inf
        score = [1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(phi - kappa, 700.0))) for _, phi, _ in found]
        out.append([Sample(pieces[r][row_of[r][t]], phi, g, x) for (r, phi, g), x in zip(found, score, strict=True)])
    return out


def ids_of(paths: _Paths, lat: Lattices) -> list[np.ndarray]:
    """Vocabulary ids of each path; a spelled character gives one id for each of its bytes."""
    flat = lat.piece[paths.edges]
    ends = paths.ends.tolist()
    out = [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    spelled = np.searchsorted(paths.ends, np.flatnonzero(flat < 0), side="right") - 1
    for j in np.unique(spelled).tolist():
        ids: list[int] = []
        for x in out[j].tolist():
            ids.extend([x] if x >= 0 else [lat.v.bytes[b] for b in chr(-x - 1).encode()])
        out[j] = np.array(ids, np.int32)
    return out


@lru_cache(2)
def lattices(path: str, alpha: float) -> Lattices:
    return Lattices(Vocabulary(path), alpha)


def row_key(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}\x00{key!r}".encode())


ENCODED = "samples array<struct<ids: array<int>, log_prob: double, perturbed: double, inclusion: double>>"


def encode(docs: DataFrame, key: str, keep: list[str], k: int = K, alpha: float = ALPHA, seed: int = SEED,
           vocabulary: str = VOCABULARY, emit: Callable | None = None, emitted: str = ENCODED) -> DataFrame:
    """`keep` columns and, for each row, k sampled segmentations of `text`.

    emit: turns (text, samples, vocabulary) of a row into the values of the columns `emitted`; by default the
    segmentations themselves. The vocabulary file is sent to the executors.
    """
    names = [x.strip().split()[0] for x in emitted.split("\n")]
    path = ship(docs.sparkSession, vocabulary)
    schema = schema_of(docs, keep, emitted.replace("\n", ", "))
    kinds = to_arrow_schema(schema_of(docs, [], emitted.replace("\n", ", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path(), alpha)
        for batch in batches:
            for b in chunks(batch, "_text", CHUNK):
                texts, keys = b.column("_text").to_pylist(), [row_key(x, seed) for x in b.column("_key").to_pylist()]
                rows = []
                for text, found in zip(texts, sample(texts, keys, lat, k), strict=True):
                    rows.append(emit(text, found, lat.v) if emit else ([vars(s) for s in found],))
                cols = list(zip(*rows, strict=True))
                new = [pa.array(c, kinds.field(n).type) for c, n in zip(cols, names, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], [*keep, *names])
        lat.empty()
        release()

    return docs.select(*keep, F.col(key).alias("_key"), F.col("text").alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` columns and the text that a column of ids stands for; null ids give null."""
    schema = schema_of(encoded, keep, "text string")
    path = ship(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = lattices(path(), ALPHA).v
        for b in batches:
            text = pa.array([None if x is None else v.decode(x) for x in b.column("_ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), text], [*keep, "text"])

    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)


DIGESTS = "n_samples long\nn_pieces array<long>\nids_sha256 array<string>\nlog_prob array<double>\ninclusion array<double>\nround_trip boolean"


def digests(text: str | None, found: list[Sample], v: Vocabulary) -> tuple:
    """What op2 reports of a row's segmentations; every one of them is decoded and compared with the text."""
    same = all(v.decode(s.ids.tolist()) == (text or "") for s in found)
    hashes = [hashlib.sha256(s.ids.astype("<i4").tobytes()).hexdigest() for s in found]
    return len(found), [len(s.ids) for s in found], hashes, [s.log_prob for s in found], [s.inclusion for s in found], same


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K segmentations of every whole document, as digests with their inclusion scores."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", ["doc_id"], emit=digests, emitted=DIGESTS)
