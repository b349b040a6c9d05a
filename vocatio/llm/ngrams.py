"""Operator 13: texts scored by a language model of word triples, kept in Elias-Fano tries.

Model. A word's probability is smoothed by Dirichlet priors, from single words (one added) to pairs to
triples: P(c | ab) = (n(abc) + m3 P(c | b)) / (n(ab) + m3), P(c | b) = (n(bc) + m2 P(c)) / (n(b) + m2).
Written as log P(c | ab) = backoff(ab) + log(P(c | b) + n(abc) / m3), what belongs to a context and what
belongs to a word in it come from different places, and nothing but counts has to be summed.

Steps, each over all documents, texts whole:

1. *Slices.* Tasks cut their documents' words into slices of bounded size (a longer text is a slice of
   its own) and write each slice's distinct words, by 64-bit hash, and its documents as places in them.
2. *Vocabulary.* Distinct words meet by hash; the sums go back to the slices that asked. Ids ascend with
   falling counts, so an id tells its count by a table of distinct counts: at most sqrt(2 N) of them,
   the only thing that goes through the driver.
3. *Tries.* Each slice's distinct triples and pairs, counted, go to shards by the pair's first word. A
   shard sums them, builds its trie of what training documents hold, and answers each slice: a code for
   each triple and each pair it sent. Words with more than a quarter of a shard are split over shards by
   the next word, and pairs that may have more by the word in front, their counts going to all parts.
   Frequent words, pairs and copies are counted in the slices first, so no group holds all their rows.
4. *Scores.* Slices meet their answers and sum codes along each document.

A trie's levels are Elias-Fano sequences in one mapping: words; their successors; the words in front of
them (contexts); and per context its successors, not as words but as places among the successors of the
shorter context, which takes fewer bits. Pointers from level to level ascend, so they are sequences
too. Smoothed probabilities are kept as 16-bit codes. A lookup is one successor search a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .eliasfano import EliasFano, arrays_of, mapped
from .learn import held_out
from .storage import Steps, table
from .textbytes import Words, buffers, mix, slices, spaced_table

#: Weights of the shorter context's probability, after one word and after two.
PRIORS = (2000.0, 10.0)

#: Tokens of a slice and, about, of a shard; distinct words of a part of the vocabulary, about.
SLICE_TOKENS, SHARD_TOKENS, PART_WORDS = 1 << 20, 3 << 19, 1 << 20

#: Stands for the end of a text among hashes of words.
END = np.uint64(0xE703_7ED1_A0B4_28DB)

#: Ids that aren't words: in front of a text, no context, a word that training documents lack.
START, NONE, UNKNOWN, WORDS = 0, 1, 2, 3

#: A code is a logarithm in steps of 1 / CODES, from -SHIFT to SHIFT.
CODES, SHIFT = 1024, 32


def code(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x + SHIFT) * CODES), 0, 65535).astype(np.uint16)


def decoded(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) / CODES - SHIFT


# --- numbers as bytes ---


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0, byte by byte of equal weight, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], "<i8").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n, width = np.frombuffer(raw, "<i8", 2).tolist()
    planes = np.frombuffer(pa.decompress(memoryview(raw)[16:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(x, prepend=x.dtype.type(0))


def ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.append(np.flatnonzero(np.diff(x, prepend=x[:1] - 1)) if len(x) else np.zeros(0, np.int64), len(x))


# --- 1: slices ---

SLICE = "slice long, ids {ids}, sizes binary, train binary, hashes binary, counts binary, places binary, n_words long, n_tokens long"


def sliced(docs: DataFrame) -> DataFrame:
    """Rows of SLICE from (id, text, train)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            data, offsets = buffers(b.column("text"))
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], spaced_table())
                if held and size + len(w.hash) + j - i > SLICE_TOKENS:
                    yield _slice(number, held)
                    number, held, size = number + 1, [], 0
                hashes = np.insert(w.hash, w.first[1:], END)
                held.append((b.column("id").slice(i, j - i), np.diff(w.first) + 1, train[i:j], hashes))
                size += len(hashes)
        if held:
            yield _slice(number, held)

    return docs.mapInArrow(rows, SLICE.format(ids=f"array<{docs.schema['id'].dataType.simpleString()}>"))


def _slice(number: int, held: list) -> pa.RecordBatch:
    ids = pa.concat_arrays([h[0] for h in held])
    sizes, train, hashes = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
    words, places = np.unique(hashes, return_inverse=True)
    counts = np.bincount(places[np.repeat(train, sizes)], minlength=len(words))
    row = [[number], pa.ListArray.from_arrays([0, len(ids)], ids), [packed(sizes)], [packed(train)], [packed(steps(words))], [packed(counts)], [packed(places)], [len(words)], [len(places)]]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.binary() if isinstance(x[0], bytes) else pa.int64()) for x in row], names=[c.split()[0] for c in SLICE.split(", ")])


# --- 2: vocabulary ---

REPLY = "slice long, part long, counts binary, ranks binary"


def vocabulary(told: DataFrame, parts: int) -> DataFrame:
    """Rows of REPLY: for each slice and part of the words' hashes, each word's count over all slices
    and its rank among the part's words of that count; and, with a null slice, the part's distinct
    counts and how many words have each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, hashes, counts in zip(b["slice"].to_pylist(), b["hashes"].to_pylist(), b["counts"].to_pylist(), strict=True):
                words, counts = ascending(hashes), unpacked(counts)
                edges = np.searchsorted(words, np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64))
                edges = [0, *edges.tolist(), len(words)]
                rows = [(p, s, packed(steps(words[i:j])), packed(counts[i:j])) for p, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "slice", "hashes", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        part, asked = group["part"][0].as_py(), [ascending(x.as_py()) for x in group["hashes"]]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, place, np.concatenate([unpacked(x.as_py()) for x in group["counts"]]).astype(np.int64))
        order = np.argsort(total, kind="stable")
        edges = runs(total[order])
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words)) - np.repeat(edges[:-1], np.diff(edges))
        rows = [(None, part, packed(total[order][edges[:-1]]), packed(np.diff(edges)))]
        at = 0
        for s, a in zip(group["slice"].to_pylist(), asked, strict=True):
            own = place[at : at + len(a)]
            at += len(a)
            rows.append((s, part, packed(total[own]), packed(rank[own])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slice", "part", "counts", "ranks"])

    return told.mapInArrow(ask, "part long, slice long, hashes binary, counts binary").groupBy("part").applyInArrow(answer, REPLY)


@dataclass(frozen=True)
class Counts:
    """Which ids have which counts: ids from bases[i] on, up to the next base, have counts[i], falling
    to 0, which stands for UNKNOWN alone. Ids of a count are dealt to the parts in turn."""

    counts: np.ndarray
    bases: np.ndarray
    parts: int
    tokens: int
    words: int
    texts: int = 0
    priors: tuple[float, float] = PRIORS

    @classmethod
    def of(cls, replies: DataFrame, parts: int) -> Counts:
        """From the parts' distinct counts; a count is at most in sqrt(2 N) rows, as their sum is N."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c, n in zip(b["counts"].to_pylist(), b["ranks"].to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(unpacked(c).astype(np.int64)), pa.array(unpacked(n).astype(np.int64))], names=["count", "n"])

        rows = replies.where("slice is null").select("counts", "ranks").mapInArrow(spread, "count long, n long").where("count > 0")
        found = rows.groupBy("count").agg(F.max("n").alias("most"), F.sum("n").alias("n")).orderBy(F.desc("count")).collect()
        counts, most, n = (np.array([r[k] for r in found], np.int64) for k in range(3))
        return cls(counts, WORDS + np.append(0, np.cumsum(most * parts)), parts, int((counts * n).sum()), int(n.sum()))

    @property
    def universe(self) -> int:
        return int(self.bases[-1])

    def ids(self, counts: np.ndarray, ranks: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.full(len(counts), UNKNOWN, np.int64)
        at = np.minimum(np.searchsorted(-self.counts, -counts), len(self.counts) - 1)
        return np.where(counts > 0, self.bases[at] + ranks * self.parts + part, UNKNOWN)

    def of_ids(self, ids: np.ndarray) -> np.ndarray:
        """How often a word occurs in training texts, or a text starts."""
        if not len(self.counts):
            return np.zeros(len(ids), np.int64)
        at = np.clip(np.searchsorted(self.bases, ids, side="right") - 1, 0, len(self.counts) - 1)
        return np.where(ids >= WORDS, self.counts[at], np.where(ids == START, self.texts, 0))

    def log_single(self, counts: np.ndarray) -> np.ndarray:
        """The logarithm of a single word's probability, an unknown one's too."""
        return np.log10((counts + 1) / (self.tokens + self.words + 1))


# --- 3: tries ---


class Trie:
    """Successors and contexts of the words of a shard, in one mapping."""

    SEQUENCES = ("words", "pairs", "contexts", "triples", "pair_of", "context_of", "room_of")

    def __init__(self, buffer):
        views = arrays_of(buffer)
        self.buffer, self.universe = buffer, int(views[0][0])
        self.log_pair, self.log_backoff, self.log_triple = views[1:4]
        for i, name in enumerate(self.SEQUENCES):
            setattr(self, name, EliasFano(*views[4 + 4 * i : 8 + 4 * i]))

    @classmethod
    def build(cls, counts: Counts, b: np.ndarray, c: np.ndarray, n2: np.ndarray, a: np.ndarray, pair: np.ndarray, n3: np.ndarray, path: str | None = None) -> Trie:
        """Pairs (b, c) ascending, with counts; triples (a, then the pair's place) with counts."""
        u = max(counts.universe, WORDS)
        edges = runs(b)
        words, of = b[edges[:-1]], np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        seen = counts.of_ids(words)[of]
        m2, m3 = counts.priors
        smooth = np.log10((n2 + m2 * 10.0 ** counts.log_single(counts.of_ids(c))) / (seen + m2))
        front = of[pair] * u + a  # a context is a word and the one in front of it
        order = np.lexsort((pair, front))
        front, pair, n3 = front[order], pair[order], n3[order]
        at = runs(front)
        contexts, context = front[at[:-1]], np.repeat(np.arange(len(at) - 1), np.diff(at))
        context_of = np.searchsorted(contexts, np.arange(len(words) + 1) * u)
        # a context's successors are places among the word's: so many fit
        room = np.append(0, np.cumsum(np.diff(context_of) * np.diff(edges)))
        k = of[pair]
        triples = room[k] + (context - context_of[k]) * np.diff(edges)[k] + pair - edges[k]
        sequences = {
            "words": (words, u), "pairs": (of * u + c, len(words) * u), "contexts": (contexts, len(words) * u), "triples": (triples, int(room[-1])),
            "pair_of": (edges, len(b) + 1), "context_of": (context_of, len(contexts) + 1), "room_of": (room, int(room[-1]) + 1),
        }
        parts = [x for name in cls.SEQUENCES for x in EliasFano.of(sequences[name][0], sequences[name][1]).parts()]
        return cls(mapped([np.array([u], np.int64), code(smooth), code(np.log10(m3 / (n2 + m3))), code(np.log10(10.0 ** smooth[pair] + n3 / m3)), *parts], path))

    def find_pairs(self, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs with ascending b: the word's place, the pair's place, and whether there is one."""
        edges = runs(b)
        place, there = self.words.successor(b[edges[:-1]])
        size = np.diff(edges)
        place, there = np.repeat(place, size), np.repeat(there, size)
        at, known = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
        rows = np.flatnonzero(there)
        at[rows], known[rows] = self.pairs.successor(place[rows] * self.universe + c[rows])
        return place, at, known

    def find_triples(self, a: np.ndarray, word: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a word in front of a pair that is there: the triple's place, and whether there is one."""
        out, known = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        context, there = self.contexts.successor(word * self.universe + a)
        rows = np.flatnonzero(there)
        # pointers are read once for each word
        words, of = np.unique(word[rows], return_inverse=True)
        first, last, contexts, room = self.pair_of.access(words), self.pair_of.access(words + 1), self.context_of.access(words), self.room_of.access(words)
        x = room[of] + (context[rows] - contexts[of]) * (last - first)[of] + pair[rows] - first[of]
        out[rows], known[rows] = self.triples.successor(x)
        return out, known


def codes(trie: Trie, counts: Counts, b: np.ndarray, c: np.ndarray, a: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of triples, given as a word in front of a pair, and of pairs' backoffs. Pairs ascend."""
    word, at, known = trie.find_pairs(b, c)
    backoff = np.full(len(b), code(np.zeros(1))[0], np.uint16)
    backoff[known] = trie.log_backoff[at[known]]
    of_pair = code(np.log10(counts.priors[0] / (counts.of_ids(b) + counts.priors[0])) + counts.log_single(counts.of_ids(c)))
    of_pair[known] = trie.log_pair[at[known]]
    out = of_pair[pair]
    rows = np.flatnonzero(known[pair] & (a != NONE))
    place, there = trie.find_triples(a[rows], word[pair[rows]], at[pair[rows]])
    out[rows[there]] = trie.log_triple[place[there]]
    return out, backoff


BLOCK = "shard long, slice long, b binary, c binary, n2 binary, sizes binary, a binary, n3 binary"
ANSWER = "slice long, shard long, triples binary, backoffs binary"


class Grams:
    """The distinct pairs and triples of a slice in the order of (shard, b, c, a), and those of each
    token: ``token_triple``, -1 where a word is unknown, and ``token_pair``."""

    def __init__(self, tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, train: np.ndarray, counts: Counts, shards: int):
        # places in ids, which ascend and hold all words that aren't words first
        first = np.cumsum(sizes) - sizes
        b, a = np.empty_like(tokens), np.empty_like(tokens)
        b[1:], a[2:] = tokens[:-1], tokens[:-2]
        later = first + 1
        a[later[sizes > 1]] = START
        b[first], a[first] = START, NONE
        self.b, self.c = b, tokens
        a[a == UNKNOWN] = NONE
        at = np.flatnonzero((b != UNKNOWN) & (tokens != UNKNOWN))
        learned = np.repeat(train, sizes)[at]
        n = len(ids)
        pairs, of = np.unique(b[at] * n + tokens[at], return_inverse=True)
        n2 = np.bincount(of[learned], minlength=len(pairs))
        pb, pc = ids[pairs // n], ids[pairs % n]
        quota = max(1.0, counts.tokens / shards / 4)
        nb, nc = counts.of_ids(pb), counts.of_ids(pc)
        with np.errstate(over="ignore"):
            spread = mix(pc.astype(np.uint64)) % np.ceil(np.clip(nb / quota, 1, shards)).astype(np.uint64)
            home = mix(mix(pb.astype(np.uint64)) + spread)
            copies = np.ceil(np.clip(np.minimum(nb, nc) / quota, 1, shards)).astype(np.int64)
            start = np.cumsum(copies) - copies
            copy = np.arange(int(copies.sum())) - np.repeat(start, copies)
            shard = ((np.repeat(home, copies) + copy.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            own = start[of] + (mix(ids[a[at]].astype(np.uint64)) % copies[of].astype(np.uint64)).astype(np.int64)
        order = np.argsort(shard, kind="stable")  # pairs ascend within a shard
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        origin = np.repeat(np.arange(len(pairs)), copies)[order]
        self.shard, self.pair_b, self.pair_c, self.n2 = shard[order], pb[origin], pc[origin], n2[origin]
        key, triple = np.unique(place[own] * n + a[at], return_inverse=True)
        self.triple_pair, front = key // n, key % n
        self.triple_a = ids[front]
        self.n3 = np.where(front == NONE, 0, np.bincount(triple[learned], minlength=len(key)))
        self.token_triple = np.full(len(tokens), -1)
        self.token_triple[at] = triple
        self.token_pair = np.full(len(tokens), -1)
        self.token_pair[at] = place[start[of]]

    def blocks(self) -> Iterator[tuple]:
        edges = runs(self.shard)
        triples = np.searchsorted(self.triple_pair, edges)
        sizes = np.bincount(self.triple_pair, minlength=len(self.shard))
        for p, q, i, j in zip(edges, edges[1:], triples, triples[1:], strict=False):
            yield int(self.shard[p]), packed(steps(self.pair_b[p:q])), packed(self.pair_c[p:q]), packed(self.n2[p:q]), packed(sizes[p:q]), packed(self.triple_a[i:j]), packed(self.n3[i:j])


def answered(group: pa.Table, counts: Counts) -> pa.Table:
    """A shard: its blocks summed to a trie, and for each block the codes of its triples and pairs."""
    blocks = []
    for s, *cols in zip(*[group[c].to_pylist() for c in ("slice", "b", "c", "n2", "sizes", "a", "n3")], strict=True):
        blocks.append((s, ascending(cols[0]).astype(np.int64), *[unpacked(x).astype(np.int64) for x in cols[1:]]))
    b, c, n2, sizes, a, n3 = (np.concatenate([x[k] for x in blocks]) for k in range(1, 7))
    order = np.lexsort((c, b))
    begun = np.flatnonzero((np.diff(b[order], prepend=-1) != 0) | (np.diff(c[order], prepend=-1) != 0))
    pair_of = np.empty(len(b), np.int64)
    pair_of[order] = np.repeat(np.arange(len(begun)), np.diff(np.append(begun, len(b))))
    b, c = b[order][begun], c[order][begun]
    n2 = np.bincount(pair_of, n2, len(b)).astype(np.int64)
    pair = np.repeat(pair_of, sizes)
    order = np.lexsort((a, pair))
    begun = np.flatnonzero((np.diff(pair[order], prepend=-1) != 0) | (np.diff(a[order], prepend=-1) != 0))
    triple_of = np.empty(len(a), np.int64)
    triple_of[order] = np.repeat(np.arange(len(begun)), np.diff(np.append(begun, len(a))))
    pair, a = pair[order][begun], a[order][begun]
    n3 = np.bincount(triple_of, n3, len(a)).astype(np.int64)
    # the trie holds what training documents hold
    held, place = np.flatnonzero(n2), np.cumsum(n2 > 0) - 1
    rows = np.flatnonzero(n3)
    trie = Trie.build(counts, b[held], c[held], n2[held], a[rows], place[pair[rows]], n3[rows])
    triples, backoffs = codes(trie, counts, b, c, a, pair)
    triples, backoffs = triples[triple_of], backoffs[pair_of]
    shard, out, at, to = group["shard"][0].as_py(), [], 0, 0
    for s, _, pairs, _, _, front, _ in blocks:
        out.append((s, shard, packed(triples[at : at + len(front)]), packed(backoffs[to : to + len(pairs)])))
        at, to = at + len(front), to + len(pairs)
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slice", "shard", "triples", "backoffs"])


# --- 4: scores ---

CODED = "slice long, ids {ids}, sizes binary, train binary, words binary, tokens binary"
SCORED = "id {id}, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def coded(group: pa.Table, replies: pa.Table, counts: Counts) -> pa.Table:
    """A slice with ids in place of hashes: its distinct ids, ascending, and the places in them."""
    row = {c: group[c][0].as_py() for c in ("slice", "sizes", "train", "places")}
    replies = replies.sort_by("part")
    seen, rank, part = [], [], []
    for p, n, r in zip(*[replies[c].to_pylist() for c in ("part", "counts", "ranks")], strict=True):
        seen.append(unpacked(n).astype(np.int64))
        rank.append(unpacked(r).astype(np.int64))
        part.append(np.full(len(seen[-1]), p))
    ids = counts.ids(np.concatenate(seen), np.concatenate(rank), np.concatenate(part))
    words = np.unique(np.append([START, NONE, UNKNOWN], ids))
    tokens = np.searchsorted(words, ids)[unpacked(row["places"]).astype(np.int64)]
    made = [[row["slice"]], group["ids"].combine_chunks(), [row["sizes"]], [row["train"]], [packed(steps(words))], [packed(tokens)]]
    return pa.table([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, pa.binary() if isinstance(x[0], bytes) else pa.int64()) for x in made], names=["slice", "ids", "sizes", "train", "words", "tokens"])


def grams_of(row: dict, counts: Counts, shards: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    ids, sizes = ascending(row["words"]).astype(np.int64), unpacked(row["sizes"]).astype(np.int64)
    return Grams(unpacked(row["tokens"]).astype(np.int64), ids, sizes, unpacked(row["train"]).astype(bool), counts, shards), ids, sizes


def scored(group: pa.Table, answers: pa.Table, counts: Counts, shards: int) -> pa.Table:
    """The documents of a slice with their scores."""
    g, ids, sizes = grams_of({c: group[c][0].as_py() for c in ("words", "tokens", "sizes", "train")}, counts, shards)
    answers = answers.sort_by("shard")
    join = lambda c: decoded(np.concatenate([np.zeros(0), *[unpacked(x.as_py()) for x in answers[c]]]))
    triples, backoffs = np.append(join("triples"), 0.0), np.append(join("backoffs"), 0.0)
    first = np.cumsum(sizes) - sizes
    before = np.append(0.0, backoffs[g.token_pair[:-1]])
    before[first] = 0.0
    n = counts.of_ids(ids)
    single = counts.log_single(n)[g.c]
    # an unknown word after a known one, whose prior it is known to need
    shorter = single + np.where(g.b == UNKNOWN, 0.0, np.log10(counts.priors[0] / (n[g.b] + counts.priors[0])))
    log = before + np.where(g.token_triple >= 0, triples[g.token_triple], shorter)
    add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
    known = add((n[g.c] > 0).astype(np.int64))
    return pa.table([group["ids"].combine_chunks().flatten(), pa.array(sizes), pa.array(known, pa.int64()), pa.array(np.full(len(sizes), counts.tokens)), pa.array(add(single)), pa.array(add(log))], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS, priors: tuple[float, float] = PRIORS) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``, learning from
    those for which ``train`` holds (null: does not).

    Words are those between white space, A-Z in lower case; a text ends with a token of its own, so a
    null or empty text has one. Words are told apart by a 64-bit hash. ``base_score`` is that of single
    words with one added; ``score`` the model's. Rows of one id are scored, and learned from, each. If
    nothing is learned from, all words are unknown. An empty table gives an empty result. Of the other
    columns none is kept, so their names can't clash.
    """
    spark = docs.sparkSession
    work = Steps(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    told = work.write(sliced(rows))
    size = told.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    parts, shards = -(-(size[0] or 1) // PART_WORDS), -(-(size[1] or 1) // shard_tokens)
    replies = work.write(vocabulary(told.select("slice", "hashes", "counts"), parts))
    counts = Counts.of(replies, parts)
    texts = told.select("train").mapInArrow(_texts, "n long").agg(F.sum("n")).first()[0]
    shared = spark.sparkContext.broadcast(replace(counts, texts=texts or 0, priors=priors))

    own, said = told.select("slice", "ids", "sizes", "train", "places").groupBy("slice"), replies.where("slice is not null").groupBy("slice")
    words = work.write(own.cogroup(said).applyInArrow(lambda a, b: coded(a, b, shared.value), CODED.format(ids=f"array<{kind}>")))
    work.drop(told, replies)
    work.release()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = [(s, row["slice"], *cols) for s, *cols in grams_of(row, shared.value, shards)[0].blocks()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(zip(*found, strict=True))], names=["shard", "slice", "b", "c", "n2", "sizes", "a", "n3"])

    sent = words.select("slice", "sizes", "train", "words", "tokens").mapInArrow(blocks, BLOCK)
    answers = sent.groupBy("shard").applyInArrow(lambda g: answered(g, shared.value), ANSWER)
    return words.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda a, b: scored(a, b, shared.value, shards), SCORED.format(id=kind))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(unpacked(x).sum()) for x in b["train"].to_pylist()], pa.int64())], names=["n"])


def op13_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id counts as an empty text for the remainder, so such rows are learned from."""
    out = held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 7, 2)
    rows = score_documents(table(spark, sf_dir, "documents"), ~out).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
