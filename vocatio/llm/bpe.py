"""Operator 2: BPE encoding by content-defined chunk reuse, and decoding.

A rolling hash of the last bytes cuts a text wherever its top bits are all set, so copies of a
passage are cut alike wherever they stand.

1. All chunks of all texts are counted by their hash: a few bytes a chunk are shuffled.
2. Of the chunks met twice or more, the DICTIONARY most frequent are fetched, one text each, and
   encoded, each once, in a job of its own. Their ids go to all executors: of bounded size.
3. Every text takes the ids of the chunks that are in the dictionary. All other text, rare chunks
   too, is encoded where it stands; no text is shuffled for it.

Tokens at a chunk's ends depend on the text beyond, so joins are repaired: from the last place in
the left chunk to the first one in the right chunk where the text alone shows that a piece of the
tokenizer's pattern starts, all text is encoded again. Such a place, a *seam*, is a space between
two printable ASCII characters: no piece of letters, digits or marks goes on over a space, and a
space before one of them starts a piece, whatever stands before or behind. Both encodings start a piece at a seam, and merges never
cross pieces, so from there on they agree exactly. A chunk without two seams isn't reused.

Decoding gathers bytes by id; where it doesn't give a text back (two chunks of one hash, say), the
text is encoded anew without the dictionary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import helper, table
from .textbytes import buffers, list_array, random_words, slices, span_hash

#: Top bits of the rolling hash that are all set at a cut: chunks of 512 bytes on average.
CUT_BITS = 9

#: Bytes that the rolling hash looks back on.
WINDOW = 32

#: Chunks whose ids all executors hold, at most, and their bytes. Others are encoded in their texts.
DICTIONARY, LEAST_BYTES, MOST_BYTES = 32_768, 48, 2_048

RESULT = "struct<ids:array<int>,decoded:string>"

_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where chunks start: every text's start, and after each full window of its bytes whose
    gear hash says so, moved on to the next character's first byte."""
    h = (random_words(256, 23) >> np.uint64(32)).astype(np.uint32)[data]
    k = 1
    while k < WINDOW:
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k) if k < len(h) else 0
        h = h + shifted
        k *= 2
    # the top bits hang on the whole window
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == (1 << CUT_BITS) - 1) + 1
    at = at[at - offsets[np.searchsorted(offsets, at - 1, side="right") - 1] >= WINDOW]
    for _ in range(3):
        at = at[at < len(data)]
        at = at + ((data[at] & 0xC0) == 0x80)
    return np.unique(np.concatenate([at[at < len(data)], offsets[:-1][offsets[:-1] < len(data)]]))


def seams(data: np.ndarray) -> np.ndarray:
    """Places of spaces between two printable ASCII characters."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    solid = _SOLID[data]
    return np.flatnonzero((data[1:-1] == 32) & solid[:-2] & solid[2:]) + 1


@dataclass
class Chunks:
    """The chunks of a slice of texts that may be shared: start, end, hash, and the first and the
    last seam inside, as bytes from the slice's start."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    head: np.ndarray
    tail: np.ndarray


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> Chunks:
    start = cut_points(data, offsets)
    end = np.append(start[1:], len(data))
    size = end - start
    fit = (size >= LEAST_BYTES) & (size <= MOST_BYTES)
    start, end = start[fit], end[fit]
    at = seams(data)
    # a seam shows itself inside the chunk: by what stands on both sides of the space
    first, last = np.searchsorted(at, start + 1), np.searchsorted(at, end - 1) - 1
    two = first < last
    start, end, first, last = start[two], end[two], first[two], last[two]
    return Chunks(start, end, span_hash(data, start, end).view(np.int64), at[first], at[last])


@dataclass
class Shared:
    """The dictionary: sorted hashes of chunks; ids from their first to their last seam, one chunk
    after the other, and where each begins."""

    hash: np.ndarray
    first: np.ndarray
    ids: np.ndarray


NOTHING = Shared(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32))


class Encoder:
    """The tokens of whole texts, by the ranks of a byte-level vocabulary."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # the pattern of byte-level vocabularies
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        letters = byte_letters()
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        # ids that rise with the merges are their ranks; else the tokenizer itself encodes
        self.ranked = all(x < y for x, y in zip(made[:-1], made[1:], strict=True)) and len(set(made)) + 256 == len(vocab) and sorted(vocab.values()) == list(range(len(vocab)))
        self.fast = Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if self.ranked else None
        # tells what kind of character the pattern takes a character for: its last byte is merged with a letter, a digit or a mark
        kinds = {bytes([b]): b for b in range(256)}
        for b in range(256):
            kinds |= {bytes([b]) + x: 256 + 3 * b + i for i, x in enumerate((b"a", b"1", b"!"))}
        self.kinds = Encoding("kinds", pat_str=pattern, mergeable_ranks=kinds, special_tokens={})
        self.alike: dict[str, bool] = {}
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        of = [b""] * size
        for token, i in ranks.items():
            of[i] = token
        for token, i in self.special.items():
            of[i] = token.encode()
        self.byte_count = np.array([len(x) for x in of], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self.bytes = np.frombuffer(b"".join(of), np.uint8)
        self.uncommon = [chr(c) for c in range(128) if not self.knows(chr(c))]

    def knows(self, c: str) -> bool:
        """Whether the ranks' pattern and the tokenizer, which may know another version of Unicode,
        take a character for the same kind."""
        found = self.alike.get(c)
        if found is None:
            pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
            n = len(c.encode())
            found = self.alike[c] = all((len(pre(c + x)) == 1) == (len(self.kinds.encode_ordinary(c + x)) == n) for x in "a1!")
        return found

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def plain(self, raw: bytes) -> np.ndarray:
        """The ids of a stretch without special tokens whose characters are all known."""
        return self.fast.encode_to_numpy(raw.decode(), disallowed_special=()).view(np.int32)

    def usual(self, raw: bytes) -> bool:
        """Whether the ranks may encode a text."""
        if not self.ranked or any(c.encode() in raw for c in self.uncommon):
            return False
        return raw.isascii() or all(self.knows(c) for c in set(raw.decode()) if c > "\x7f")

    def encode(self, raw: bytes) -> np.ndarray:
        """The ids of a text in UTF-8. Strings of special tokens become those tokens, like the
        tokenizer does."""
        if not self.usual(raw):
            return self.slow(raw.decode())
        if not self.split or not any(s.encode() in raw for s in self.special):
            return self.plain(raw)
        out, at, text = [], 0, raw.decode()
        for m in self.split.finditer(text):
            out += [self.plain(text[at : m.start()].encode()), np.array([self.special[m.group()]], np.int32)]
            at = m.end()
        return np.concatenate([*out, self.plain(text[at:].encode())])

    def core(self, raw: bytes, head: int, tail: int) -> np.ndarray | None:
        """The ids of a chunk between two of its seams, from its whole encoding; None where a text
        that holds the chunk may not be encoded by ranks, or the encoding doesn't agree at a seam."""
        if not self.usual(raw) or any(s.encode() in raw for s in self.special):
            return None
        ids = self.plain(raw)
        ends = np.append(0, np.cumsum(self.byte_count[ids]))
        i, j = np.searchsorted(ends, (head, tail))
        return ids[i:j] if ends[i] == head and ends[j] == tail else None

    def texts(self, data: np.ndarray, offsets: np.ndarray, shared: Shared) -> list[np.ndarray]:
        """The ids of texts that stand one after the other."""
        raw = data.tobytes()
        n = len(offsets) - 1
        c = None
        if len(shared.hash):
            c = chunks_of(data, offsets)
            which = np.minimum(np.searchsorted(shared.hash, c.hash), len(shared.hash) - 1)
            met = np.flatnonzero(shared.hash[which] == c.hash)
            head, tail, which = c.head[met].tolist(), c.tail[met].tolist(), which[met].tolist()
            own = np.searchsorted(c.start[met], offsets).tolist()
        out = []
        for r in range(n):
            i, j = int(offsets[r]), int(offsets[r + 1])
            text = raw[i:j]
            if c is None or own[r] == own[r + 1] or not self.usual(text) or any(s.encode() in text for s in self.special):
                out.append(self.encode(text))
                continue
            parts, at = [], i
            for m in range(own[r], own[r + 1]):
                k = which[m]
                if head[m] > at:
                    parts.append(self.plain(raw[at : head[m]]))  # the join, or all text since the last shared chunk
                parts.append(shared.ids[shared.first[k] : shared.first[k + 1]])
                at = tail[m]
            parts.append(self.plain(raw[at:j]))
            out.append(np.concatenate(parts))
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        count = self.byte_count[ids]
        ends = np.cumsum(count)
        n = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.byte_start[ids] - (ends - count), count) + np.arange(n)]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for
    themselves, the others in order for letters from U+0100 on."""
    out = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    rest = [b for b in range(256) if b not in set(out.values())]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder_at(path: str) -> Encoder:
    """A process reads a vocabulary once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of chunks, with their number in the batch."""
    for batch in it:
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(offsets):
            c = chunks_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashes, n = np.unique(c.hash, return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": hashes, "n": n.astype(np.int64)})


def fetcher(wanted):
    """The chunks of the wanted hashes: hash, text, head and tail, once a slice of texts."""

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = wanted.value
        for batch in it:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                here = data[offsets[i] : offsets[j]]
                c = chunks_of(here, offsets[i : j + 1] - offsets[i])
                names, at = np.unique(c.hash, return_index=True)
                at = at[np.isin(names, hashes, assume_unique=True)]
                if len(at):
                    raw = here.tobytes()
                    yield pa.RecordBatch.from_pydict({
                        "hash": c.hash[at],
                        "text": [raw[c.start[k] : c.end[k]].decode() for k in at],
                        "head": (c.head - c.start)[at].astype(np.int32),
                        "tail": (c.tail - c.start)[at].astype(np.int32),
                    })

    return fetch


def once(path: str):
    """The ids between the seams of each chunk, which is encoded here and nowhere else."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(path)
        for batch in it:
            out = []
            for h, text, head, tail in zip(*(batch.column(c).to_pylist() for c in ("hash", "text", "head", "tail")), strict=True):
                ids = encoder.core(text.encode(), head, tail)
                if ids is not None:
                    out.append((h, ids.tobytes()))
            yield pa.RecordBatch.from_pydict({"hash": pa.array([x[0] for x in out], pa.int64()), "ids": pa.array([x[1] for x in out], pa.binary())})

    return encode


def encoded_chunks(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame | None:
    """hash, ids (int32): the DICTIONARY chunks met most often, each encoded once; None if no chunk
    is met twice."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    often = texts.mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = np.array([r.hash for r in often.orderBy(F.desc("n"), "hash").limit(DICTIONARY).select("hash").collect()], np.int64)
    if not len(wanted):
        return None
    found = texts.mapInArrow(fetcher(spark.sparkContext.broadcast(wanted)), "hash long, text string, head int, tail int")
    chosen = found.groupBy("hash").agg(F.min(F.struct("text", "head", "tail")).alias("c")).select("hash", "c.*")
    return chosen.mapInArrow(once(path), "hash long, ids binary")


def dictionary(docs: DataFrame, path: str, text_col: str = "text") -> Shared:
    """The most frequent shared chunks with their ids: at most DICTIONARY of MOST_BYTES each."""
    chunks = encoded_chunks(docs, path, text_col)
    if chunks is None:
        return NOTHING
    t = chunks.toArrow().sort_by("hash")
    if not t.num_rows:
        return NOTHING
    ids = t.column("ids").combine_chunks()
    data, offsets = buffers(ids)
    return Shared(t.column("hash").to_numpy(), offsets >> 2, np.frombuffer(data.tobytes(), np.int32))


def coder(path: str, sent):
    """A column function: text to its ids and their decoded text."""

    @F.arrow_udf(RESULT)
    def code(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, shared = encoder_at(path), sent.value
        for col in it:
            data, offsets = buffers(col)
            parts = [coded(encoder, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared) for i, j in slices(offsets)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    return code.asNondeterministic()


def coded(encoder: Encoder, data: np.ndarray, offsets: np.ndarray, shared: Shared) -> pa.StructArray:
    ids = encoder.texts(data, offsets, shared)
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    back = encoder.decode(flat)
    sizes = np.append(0, np.cumsum(encoder.byte_count[flat]))[np.append(0, np.cumsum(counts))]
    if np.array_equal(sizes, offsets) and np.array_equal(back, data):
        decoded = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(back.tobytes())])
    elif len(shared.hash):
        return coded(encoder, data, offsets, NOTHING)
    else:
        raw = back.tobytes()
        decoded = pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(sizes[:-1], sizes[1:], strict=True)], pa.string())
    return pa.StructArray.from_arrays([list_array(pa.array(flat, pa.int32()), counts), decoded], ["ids", "decoded"])


def tokenize(docs: DataFrame, path: str, text_col: str = "text", result: str = "tokens") -> DataFrame:
    """The documents with the struct column ``result``: ids (array<int>) and decoded (string).

    A null text is encoded as an empty one: no ids, an empty decoded text. Strings of special
    tokens become the special token. Texts of any length are encoded whole. Repeated texts and rows
    have a row each; an empty table gives an empty result. A column of the name of ``result`` is
    replaced; all other columns stay, whatever their names. The documents are read three times, and
    should be a table rather than a long computation.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs, path, text_col))  # of bounded size: DICTIONARY
    made = helper(docs, result)
    return docs.withColumn(made, coder(path, sent)(F.col(text_col))).select(*[c for c in docs.columns if c != result], F.col(made).alias(result))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_content_defined_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(docs, default_path()).select(
        "doc_id",
        F.size("tokens.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("tokens.decoded", 256).alias("decoded_sha256"),
    )
