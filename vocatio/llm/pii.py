"""Operator 5: personal data, by fixed patterns and a linear-chain conditional random field.

The patterns (email, ip, card, phone) give base spans, which always stay. The field labels the
tokens of every sentence with kinds of personal data from features of word shape; it is trained
on a small labelled table and decoded by Viterbi over all sentences of a batch at once. What it
finds and no base span overlaps is added. Each text is handled where it is read: nothing is shuffled.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import helper, table

#: Kinds in the order of their listing.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

RESULT = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_VALUE = re.compile(r"[A-Za-z0-9_/+.-]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from each @ outwards, which takes
    time in proportion to the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def numbers(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """ip and card matches, from the runs of digits: a match always takes whole runs."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    ips, cards = [], []
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(text[a[1]] == "." and a[1] + 1 == b[0] for a, b in zip(four, four[1:], strict=False)):
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                ips.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 16 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            cards.append((runs[i][0], runs[j][1]))
        i = j + 1
    return ips, cards


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by kind as listed, then start, in code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    ips, cards = numbers(text)
    out += [("ip", a, b) for a, b in ips]
    out += [("card", a, b) for a, b in cards]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


# --- tokens and their features, on code points ---

_SPACE, _UPPER, _LOWER, _DIGIT, _OTHER = range(5)
#: Bits of a token's character kinds: those above, then single characters that matter.
_MARKS = {c: 1 << (5 + i) for i, c in enumerate('@.+-=:/_"()')}
#: Feature slots: hashed, so that the field has a fixed size whatever tokens there are.
SLOTS = 1 << 14


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points under 0x3000: class and bits. Others count as lower-case letters, or as
    spaces, marks of punctuation and so on by their own tests where they matter."""
    kind = np.full(0x3000, _LOWER, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        kind[c] = _SPACE if ch.isspace() else _UPPER if ch.isupper() else _DIGIT if ch.isdecimal() else _LOWER if ch.isalpha() else _OTHER
    bits = (1 << kind.astype(np.uint32)).astype(np.uint32)
    for ch, b in _MARKS.items():
        bits[ord(ch)] |= b
    return kind, bits


@dataclass
class Tokens:
    """The tokens (runs without white space) of several texts, one after the other: spans in code
    points of all texts joined, and the number of each token's sentence."""

    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    features: np.ndarray  # tokens by features: slots


_PRIME = np.uint32(0x9E3779B1)


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x.astype(np.uint32) + np.uint32((salt * 0x85EBCA6B) & 0xFFFFFFFF)) * _PRIME
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(SLOTS - 1)).astype(np.int32)


def tokens_of(texts: list[str]) -> Tokens:
    """Whole texts as tokens. A sentence ends at a line's end, after a token that ends in . ! or ?,
    and at the text's end."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, marks = _tables()
    low = np.minimum(points, 0x2FFF)
    kind = kinds[low]
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = kind != _SPACE
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    n = len(start)
    if not n:
        return Tokens(start, end, start, np.zeros((0, 9), np.int32))
    length = end - start
    bits = np.bitwise_or.reduceat(marks[low], start)
    # reduceat runs on to the next token's start: the spaces between only add their own bit
    last, first = points[end - 1], points[start]
    lines = np.zeros(len(points) + 1, np.int64)
    np.cumsum(points == 10, out=lines[1:])
    line = lines[start]
    new = np.zeros(n, bool)
    new[1:] = (line[1:] != line[:-1]) | np.isin(last[:-1], (46, 33, 63))
    sentence = np.cumsum(new)
    # shape: first character's kind, kinds and marks inside, length in steps, digits in steps
    digit = np.zeros(len(points) + 1, np.int64)
    np.cumsum(kind == _DIGIT, out=digit[1:])
    digits = digit[end] - digit[start]
    step = np.minimum(length, 8) + (length > 12) + (length > 18) + (length > 30)
    shape = bits.astype(np.uint32) & np.uint32(0xFFFE)
    word = _word_hash(points, start, end, kind)
    before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    before[1:], after[:-1] = np.where(new[1:], 0, word[:-1]), np.where(new[1:], 0, word[1:])
    shape_before, shape_after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    shape_before[1:], shape_after[:-1] = np.where(new[1:], 1, shape[:-1]), np.where(new[1:], 1, shape[1:])
    cols = [
        _hashed(shape, 1),
        _hashed(shape * np.uint32(64) + step.astype(np.uint32), 2),
        _hashed(np.minimum(digits, 24).astype(np.uint32) * np.uint32(16) + kind[start], 3),
        _hashed(word, 4),
        _hashed(before, 5),
        _hashed(after, 6),
        _hashed(shape_before, 7),
        _hashed(shape_after, 8),
        _hashed(np.minimum(first, 0x3000) * np.uint32(0x3001) + np.minimum(last, 0x3000), 9),
    ]
    return Tokens(start, end, sentence, np.stack(cols, axis=1))


def _word_hash(points: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A hash of each token; digits count as one character, so that all numbers of a length agree."""
    x = np.where(kind == _DIGIT, np.uint32(48), points).astype(np.uint32)
    at = np.arange(len(points), dtype=np.uint32)
    # position within the token: the place minus the start of the token it belongs to
    own = np.zeros(len(points), np.uint32)
    own[start] = start.astype(np.uint32)
    own = np.maximum.accumulate(own)
    mixed = (x + np.uint32(1)) * (np.uint32(2) * (at - own) + np.uint32(0x9E3779B1))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    total = np.zeros(len(points) + 1, np.uint32)
    np.cumsum(mixed, out=total[1:], dtype=np.uint32)
    return total[end] - total[start]


# --- the field ---

LABELS = ("O", *[f"{b}-{k}" for k in KINDS for b in "BI"])


@dataclass
class Field:
    """Weights: slots by labels, and labels by labels (the last row: from the sentence's start)."""

    emit: np.ndarray
    move: np.ndarray


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else a large penalty: I- only continues its own kind."""
    n = len(LABELS)
    out = np.zeros((n + 1, n), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i in range(n + 1):
                if i == n or LABELS[i][2:] != b[2:] or LABELS[i] == "O":
                    out[i, j] = -1e4
    return out


class Lattice:
    """Sentences in order of length, so that step t of all that are long enough is one operation."""

    def __init__(self, sentence: np.ndarray):
        head = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(sentence) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(sentence)))
        order = np.argsort(-size, kind="stable")
        self.head, self.size = head[order], size[order]
        self.live = [int(x) for x in np.searchsorted(-self.size, -np.arange(1, (self.size[0] if len(size) else 0) + 1), side="right")]

    def viterbi(self, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The best label of each token."""
        if not len(self.head):
            return np.zeros(0, np.int64)
        n = move.shape[1]
        back = np.zeros((len(emit), n), np.int8)
        score = emit[self.head] + move[n]
        last = np.zeros(len(self.head), np.int64)
        for t in range(1, len(self.live)):
            k = self.live[t]
            ended = self.live[t - 1]
            last[k:ended] = score[k:ended].argmax(axis=1)
            at = self.head[:k] + t
            best = np.full((k, n), -np.inf, np.float32)
            arg = np.zeros((k, n), np.int8)
            for i in range(n):  # from label i to all labels
                s = score[:k, i : i + 1] + move[i]
                up = s > best
                np.copyto(best, s, where=up)
                arg[up] = i
            back[at] = arg
            score = best + emit[at]
        k = self.live[-1]
        last[:k] = score[:k].argmax(axis=1)
        out = np.zeros(len(emit), np.int64)
        current = last
        for t in range(len(self.live) - 1, -1, -1):
            k = self.live[t]
            at = self.head[:k] + t
            out[at] = current[:k]
            if t:
                current[:k] = back[at, current[:k]]
        return out

    def marginals(self, emit: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """log Z, label marginals of each token, expected transitions."""
        n = move.shape[1]
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[self.head] = emit[self.head] + move[n]
        for t in range(1, len(self.live)):
            at = self.head[: self.live[t]] + t
            alpha[at] = emit[at] + _lse(alpha[at - 1][:, :, None] + move[None, :n], 1)
        for t in range(len(self.live) - 2, -1, -1):
            at = self.head[: self.live[t + 1]] + t
            beta[at] = _lse(move[None, :n] + (emit[at + 1] + beta[at + 1])[:, None, :], 2)
        z = _lse(alpha[self.head + self.size - 1], 1)
        zs = np.zeros(len(emit))
        for t in range(len(self.live)):
            zs[self.head[: self.live[t]] + t] = z[: self.live[t]]
        node = np.exp(alpha + beta - zs[:, None])
        edge = np.zeros_like(move)
        edge[n] = node[self.head].sum(axis=0)
        for t in range(1, len(self.live)):
            at = self.head[: self.live[t]] + t
            edge[:n] += np.exp(alpha[at - 1][:, :, None] + move[None, :n] + (emit[at] + beta[at] - zs[at, None])[:, None, :]).sum(axis=0)
        return float(z.sum()), node, edge


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sentences: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty, by AdaGrad on the whole (small) table."""
    t = tokens_of([s.replace("\n", " ") for s, _ in sentences])
    base = np.cumsum([0] + [len(s) + 1 for s, _ in sentences])
    gold = np.zeros(len(t.start), np.int64)
    for at, (_, spans) in zip(base, sentences, strict=False):
        for kind, a, b in spans:
            inside = np.flatnonzero((t.start < at + b) & (t.end > at + a))
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
    lattice, n = Lattice(t.sentence), len(LABELS)
    emit, move, fence = np.zeros((SLOTS, n)), np.zeros((n + 1, n)), _allowed().astype(float)
    sums = [np.full(x.shape, 1e-6) for x in (emit, move)]
    seen = np.zeros_like(emit)
    np.add.at(seen, (t.features, gold[:, None]), 1)
    moved = np.zeros_like(move)
    inner = np.flatnonzero(t.sentence[1:] == t.sentence[:-1])
    np.add.at(moved, (gold[inner], gold[inner + 1]), 1)
    heads = np.append(0, np.flatnonzero(t.sentence[1:] != t.sentence[:-1]) + 1)
    np.add.at(moved, (n, gold[heads]), 1)
    for _ in range(rounds):
        _, node, edge = lattice.marginals(emit[t.features].sum(axis=1), move + fence)
        expected = np.zeros_like(emit)
        for f in range(t.features.shape[1]):
            np.add.at(expected, t.features[:, f], node)
        for x, g, s in ((emit, seen - expected - decay * emit, sums[0]), (move, moved - edge - decay * move, sums[1])):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Field(emit.astype(np.float32), (move + fence).astype(np.float32))


def labelled_table(rows: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table made from templates: sentences with spans of each kind, and without.
    ``train`` takes any other such table."""
    rnd = random.Random(seed)
    vowels, consonants = "aeiouéüó", "bcdfghlmnprstvwñß"
    def word() -> str:
        return "".join(rnd.choice(consonants) + rnd.choice(vowels) for _ in range(rnd.randint(1, 4)))

    def digits(n: int) -> str:
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def entity(kind: str) -> tuple[str, str]:
        """Words that lead to it, and the entity."""
        if kind == "email":
            return "", f"{word()}{rnd.choice(['', '.', '_'])}{rnd.choice(['', digits(2)])}@{word()}{rnd.choice(['', digits(1)])}.{rnd.choice(['example.com', 'org', 'net', 'co.uk'])}"
        if kind == "ip":
            return "", ".".join(str(rnd.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d = digits(16)
            return "", d if rnd.random() < 0.6 else rnd.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            return "", rnd.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}"])
        return rnd.choice(["token = ", "api_key = ", "secret: ", "password = ", "key = "]), '"' + "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice((24, 32, 40, 64)))) + '"'

    def decoy() -> str:
        return rnd.choice([
            str(rnd.randint(1, 99999)), f"{rnd.randint(0, 99)}.{rnd.randint(0, 99)}", f"{rnd.randint(1, 99)}%", f"version {rnd.randint(1, 9)}.", "CC BY-NC 4.0.", "License, Version 2.0.",
            f"{word().upper()}!!", f"{word()}&&&", f"{word()}###", f"{word()}$$$", f"{word()}***", f"{word()}%%%", "|", f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", f"#{rnd.randint(1, 99)}", f"{word()}-{word()}",
            f"{word().capitalize()} {word().capitalize()}", f"http://{word()}.example.org/{word()}", f"({word()})", f'"{word()}"', f"{word()} = {rnd.randint(0, 99)}", f"{word()}: {word()}",
        ])

    out = []
    for i in range(rows):
        text, spans = "", []
        parts = [word() + rnd.choice(["", "", "", ","]) for _ in range(rnd.randint(2, 14))]
        parts[0] = parts[0].capitalize()
        for _ in range(rnd.choice((0, 0, 1, 2))):
            parts.insert(rnd.randint(0, len(parts)), decoy())
        kinds = [] if i % 3 == 0 else [KINDS[i % len(KINDS)]] + ([rnd.choice(KINDS)] if rnd.random() < 0.2 else [])
        for kind in kinds:
            parts.insert(rnd.randint(0, len(parts)), (kind, *entity(kind)))  # type: ignore[arg-type]
        for p in parts:
            text += " " if text else ""
            if isinstance(p, tuple):
                text += p[1]
                spans.append((p[0], len(text), len(text) + len(p[2])))
                text += p[2]
            else:
                text += p
        out.append((text + rnd.choice([".", "", "!"]), spans))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def decode(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text, in code points."""
    t = tokens_of(texts)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not len(t.start):
        return out
    emit = field.emit[t.features[:, 0]].copy()
    for f in range(1, t.features.shape[1]):
        emit += field.emit[t.features[:, f]]
    best = Lattice(t.sentence).viterbi(emit, field.move)
    base = np.cumsum([0] + [len(s) + 1 for s in texts])
    at = np.flatnonzero(best)
    i = 0
    while i < len(at):
        label = LABELS[best[at[i]]]
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1 and LABELS[best[at[j + 1]]] == f"I-{label[2:]}" and t.sentence[at[j + 1]] == t.sentence[at[i]]:
            j += 1
        row = int(np.searchsorted(base, t.start[at[i]], side="right")) - 1
        a, b = int(t.start[at[i]] - base[row]), int(t.end[at[j]] - base[row])
        found = trimmed(texts[row], label[2:], a, b)
        if found:
            out[row].append(found)
        i = j + 1
    return out


def trimmed(text: str, kind: str, a: int, b: int) -> tuple[str, int, int] | None:
    """The span without quotes, brackets and punctuation around it; None if nothing is left."""
    while a < b and text[a] in "\"'<>[]{}.,;:!?=" or a < b and kind != "phone" and text[a] in "()":
        a += 1
    while b > a and text[b - 1] in "\"'<>[]{}.,;:!?=()":
        b -= 1
    if kind == "secret" and a < b:  # the value alone, without what sticks to its quotes
        a, b = max((m.span() for m in _VALUE.finditer(text, a, b)), key=lambda m: m[1] - m[0], default=(a, a))
    return (kind, a, b) if a < b else None


def plausible(kind: str, piece: str) -> bool:
    """Whether an added span can be of its kind by what holds for all of that kind."""
    digits = "".join(c for c in piece if c.isascii() and c.isdigit())
    if kind == "email":
        return 0 < piece.find("@") < len(piece) - 1
    if kind == "ip":
        return len(parts := re.findall("[0-9]+", piece)) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return len(digits) >= 4 and len(piece) >= 16


def find(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text: base ones, and of the field's those that overlap no other span."""
    out = []
    for text, more in zip(texts, decode(texts, field), strict=True):
        spans = [(*s, True) for s in base_spans(text)]
        for kind, a, b in more:
            piece = text[a:b]
            if plausible(kind, piece) and all(b <= s[1] or a >= s[2] for s in spans):
                spans.append((kind, a, b, False))
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append(spans)
    return out


#: Code points of text that are decoded together; a longer text is decoded alone, whole.
_TOGETHER = 1 << 20

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def finder(spark: SparkSession, field: Field):
    """A column function: text to its spans."""
    sent = spark.sparkContext.broadcast(field)  # of fixed size: SLOTS by labels

    @F.arrow_udf(RESULT)
    def personal(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            found: list = []
            held, size = [], 0
            for text in col.fill_null("").to_pylist():
                if held and size + len(text) > _TOGETHER:
                    found += find(held, sent.value)
                    held, size = [], 0
                held.append(text)
                size += len(text)
            found += find(held, sent.value)
            yield pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans] for spans in found], pa.list_(_SPAN))

    return personal.asNondeterministic()


def find_personal_data(docs: DataFrame, field: Field | None = None, text_col: str = "text", result: str = "personal") -> DataFrame:
    """The documents with the column ``result``: all spans (kind, start, end, base) by kind as
    listed in KINDS, then start.

    Spans are in code points of the whole text, of any length, end exclusive. Null and empty texts
    have none. Repeated rows have a row each, with equal spans; an empty table gives an empty result.
    A column of the name of ``result`` is replaced; all other columns, whatever their names, stay.
    """
    found, made = finder(docs.sparkSession, field or default_field()), helper(docs, result)
    return docs.withColumn(made, found(F.col(text_col))).select(*[c for c in docs.columns if c != result], F.col(made).alias(result))


def mask(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` in place of each span; spans that overlap are one, of the first one's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.struct(F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], kept).otherwise(F.struct(acc["parts"].alias("parts"), F.greatest(acc["at"], s["end"]).alias("at")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1))))


def op5_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = lambda k: F.filter("personal", lambda s: s["base"] & (s["kind"] == k))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return docs.select(
        "doc_id",
        *[F.size(own(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.filter("personal", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("personal")).alias("spans"),
    )
