"""Operator 9: toxicity, by a logistic classifier with a counterfactual penalty.

Features are the words of a text and the beginnings of words, each present or not. Besides the loss
on the labels, the fit penalises changes of the score when a term in a labelled text is swapped for
another one or left out. Terms are identity terms, which are given, and neutral ones, which are
found: features that many texts of either label have. So a neutral mention moves the score little,
whatever words came along with it in the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learn import held_out, labelled
from .storage import helper, table
from .textbytes import Words, alnum_table, buffers, list_array, mix, slices, span_hash

SLOTS = 1 << 18

#: Labelled rows that the classifier is fitted on, at most: their slots meet on the driver.
FIT_ROWS = 8_000

#: Beginnings of words that are features, in bytes.
STEMS = (4, 5, 6, 8)

#: Terms that are swapped for each other: the groups that comments are known to be misjudged for.
IDENTITY_TERMS = tuple(
    # English
    "women men woman man muslim muslims christian christians jewish jews hindu buddhist atheist gay straight lesbian bisexual trans black white asian african latino immigrant immigrants refugee refugees disabled blind deaf old young "
    # German
    "frauen männer frau mann muslime moslem christen juden jüdisch hinduistisch buddhistisch schwul lesbisch schwarze weiße asiatisch afrikanisch einwanderer flüchtlinge behinderte gehörlos alte junge "
    # French
    "femmes hommes femme homme musulman musulmans chrétien chrétiens juif juifs hindou bouddhiste homosexuel lesbienne noir noirs blanc blancs asiatique africain immigré immigrés réfugiés handicapé sourd vieux jeune "
    # Spanish
    "mujeres hombres mujer hombre musulmán musulmanes cristiano cristianos judío judíos hindú budista homosexual lesbiana negro negros blanco blancos asiático africano inmigrante inmigrantes refugiados discapacitado sordo viejo joven".split()
)

#: Identity terms that are set, one by one, into a labelled text which holds none.
SET_IN = 4

#: A feature is neutral if this share of the texts of either label has it.
NEUTRAL_SHARE = 0.1

_SALTS = tuple(np.uint64(x) for x in (0x1D, 0x2F, 0x3B, 0x4D, 0x5F))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each row, once each, and the number of them by row."""
    w = Words(data, offsets, alnum_table())
    row = w.row_of_word()
    keys = [w.hash + _SALTS[0]]
    rows = [row]
    size = w.end - w.start
    for n, salt in zip(STEMS, _SALTS[1:], strict=True):
        long = np.flatnonzero(size >= n)
        keys.append(span_hash(w.data, w.start[long], w.start[long] + n) + salt)
        rows.append(row[long])
    slot = (mix(np.concatenate(keys)) % np.uint64(SLOTS)).astype(np.int64)
    pair = np.unique(np.concatenate(rows) * SLOTS + slot)
    return pair % SLOTS, np.bincount(pair // SLOTS, minlength=len(offsets) - 1)


def _slots_of(words: tuple[str, ...]) -> list[np.ndarray]:
    if not words:
        return []
    data, offsets = buffers(pa.array(list(words)))
    slots, count = features(data, offsets)
    return np.split(slots, np.cumsum(count)[:-1])


def _word_slots(words: tuple[str, ...]) -> np.ndarray:
    """The slot of each whole word, without its beginnings."""
    if not words:
        return np.zeros(0, np.int64)
    w = Words(*buffers(pa.array(list(words))), alnum_table())
    return (mix(w.hash[w.first[:-1]] + _SALTS[0]) % np.uint64(SLOTS)).astype(np.int64)


@dataclass
class Toxicity:
    """A weight for each slot, and the bias."""

    weight: np.ndarray
    bias: float


class Problem:
    """What the fit minimises, but for the sum of absolute weights: the logistic loss of all rows
    plus penalty / 2 times the sum, over rows and both kinds of terms, of the mean squared change of
    the row's score under its swaps of that kind.

    A row's swaps: each term it holds, identity term or neutral one, is left out, and replaced by the
    next one of its kind that it doesn't hold; a row without identity terms has SET_IN of them set in.
    """

    def __init__(self, slots: np.ndarray, count: np.ndarray, label: np.ndarray, terms: tuple[str, ...], penalty: float, least: int, neutral_share: float):
        n = len(count)
        self.label, self.penalty = label.astype(float), penalty
        row = np.repeat(np.arange(n, dtype=np.int32), count)
        members = np.bincount(slots, minlength=SLOTS)
        own, words = _slots_of(terms), _word_slots(terms)
        # slots in fewer rows have no weight, but for those of terms that swaps set in
        self.used = members >= least
        for s in own:
            self.used[s] = True
        toxic = np.bincount(slots[label[row] > 0], minlength=SLOTS)
        ones = int((label > 0).sum())
        found = np.flatnonzero((toxic >= neutral_share * ones) & (members - toxic >= neutral_share * (n - ones)))
        neutral = found[~np.isin(found, np.concatenate([*own, words]))]
        self.terms = own + [np.array([s]) for s in neutral]
        keep = self.used[slots]
        row, slots = row[keep], slots[keep].astype(np.int32)
        order = np.argsort(slots, kind="stable")
        self.slots, self.slot_row = slots, row[order]
        members = np.bincount(slots, minlength=SLOTS)
        self.names = np.flatnonzero(members)
        self.slot_head = (np.cumsum(members) - members)[self.names]
        size = np.bincount(row, minlength=n)
        self.full = np.flatnonzero(size)
        self.row_head = (np.cumsum(size) - size)[self.full]
        self._swaps(slots, row, n, np.concatenate([words, neutral]), len(own))

    def _swaps(self, slots: np.ndarray, row: np.ndarray, n: int, sign: np.ndarray, groups: int) -> None:
        """Kinds of swaps (a term lost, a term gained) with their weights: the rows' shares."""
        holds = np.zeros((n, len(sign)), bool)
        term = np.full(SLOTS, -1)
        term[sign] = np.arange(len(sign))
        there = term[slots] >= 0
        holds[row[there], term[slots[there]]] = True
        rng = np.random.default_rng(5)
        weight: dict[tuple[int, int], float] = {}
        for i in range(n):
            for lo, hi in ((0, groups), (groups, len(sign))):
                held = np.flatnonzero(holds[i, lo:hi]) + lo
                free = np.flatnonzero(~holds[i, lo:hi]) + lo
                pairs = [(int(t), -1) for t in held]
                if len(free):  # the next term that the row doesn't hold, so kinds are few
                    pairs += [(int(t), int(x)) for t, x in zip(held, free[np.searchsorted(free, held) % len(free)], strict=True)]
                if not lo and groups and not len(held):
                    pairs = [(-1, int(t)) for t in rng.integers(groups, size=SET_IN)]
                for p in pairs:
                    weight[p] = weight.get(p, 0.0) + 1 / len(pairs)
        kinds = sorted(weight)
        of = lambda t: self.terms[t] if t >= 0 else np.zeros(0, np.int64)
        self.share = np.array([weight[k] for k in kinds])
        sides = [(of(a), of(b)) for a, b in kinds]
        self.kind_row = np.repeat(np.arange(len(kinds)), [len(x) + len(y) for x, y in sides])
        self.kind_slot = np.concatenate([np.zeros(0, np.int64), *[z for x, y in sides for z in (x, y)]])
        self.kind_sign = np.concatenate([np.zeros(0), *[np.full(len(z), v) for x, y in sides for z, v in ((x, -1.0), (y, 1.0))]])

    def score(self, weight: np.ndarray, bias: float) -> np.ndarray:
        z = np.full(len(self.label), bias)
        if len(self.full):
            z[self.full] += np.add.reduceat(weight[self.slots], self.row_head)
        return z

    def change(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.kind_row, self.kind_sign * weight[self.kind_slot], minlength=len(self.share))

    def value(self, weight: np.ndarray, bias: float) -> float:
        z = self.score(weight, bias)
        return float((np.logaddexp(0, z) - self.label * z).sum() + self.penalty / 2 * (self.share * self.change(weight) ** 2).sum())

    def gradient(self, weight: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        error = 1 / (1 + np.exp(-np.clip(self.score(weight, bias), -30, 30))) - self.label
        g = np.zeros(SLOTS)
        if len(self.names):
            g[self.names] = np.add.reduceat(error[self.slot_row], self.slot_head)
        pull = (self.share * self.change(weight))[self.kind_row]
        g += self.penalty * np.bincount(self.kind_slot, self.kind_sign * pull, minlength=SLOTS)
        return g, float(error.sum())


def fit(slots: np.ndarray, count: np.ndarray, label: np.ndarray, terms: tuple[str, ...] = IDENTITY_TERMS, penalty: float = 1.0, sparse: float = 4.0, rounds: int = 150, least: int = 3, neutral_share: float = NEUTRAL_SHARE) -> Toxicity:
    """Minimises the objective of ``Problem`` plus ``sparse`` times the sum of absolute weights.

    ``terms``: identity terms. Slots in fewer than ``least`` rows have no weight, but for those of
    terms. Without rows of both labels, every text scores the smoothed share of ones.
    """
    n = len(count)
    weight = np.zeros(SLOTS)
    if not n or label.min() == label.max():
        p = (label.sum() + 1) / (n + 2)
        return Toxicity(weight.astype(np.float32), float(np.log(p / (1 - p))))
    problem = Problem(slots, count, label, terms, penalty, least, neutral_share)
    bias = float(np.log(label.mean() / (1 - label.mean())))
    sums, bias_sum = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds):
        g, error = problem.gradient(weight, bias)
        sums += g * g
        rate = 0.5 / np.sqrt(sums)
        weight -= rate * g
        weight = np.sign(weight) * np.maximum(np.abs(weight) - rate * sparse, 0)
        bias_sum += error**2
        bias -= 0.3 * error / np.sqrt(bias_sum)
    return Toxicity(weight.astype(np.float32), bias)


def slotter():
    @F.arrow_udf("array<int>")
    def slots(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            data, offsets = buffers(col)
            parts = []
            for i, j in slices(offsets):
                s, n = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append(list_array(pa.array(s, pa.int32()), n))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return slots.asNondeterministic()


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, limit: int = FIT_ROWS) -> Toxicity:
    """Fits on at most ``limit`` labelled rows outside the held-out part. Without any, every text
    scores one half."""
    t = labelled(docs, labels, "toxic", mod, rest, limit).select("label", slotter()("text").alias("slots")).toArrow()
    col = t.column("slots").combine_chunks()
    return fit(col.flatten().to_numpy(), np.diff(col.offsets.to_numpy()), t.column("label").to_numpy())


def scorer(spark: SparkSession, model: Toxicity):
    sent = spark.sparkContext.broadcast(model)  # of fixed size: SLOTS weights

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for col in it:
            data, offsets = buffers(col)
            parts = [np.zeros(0)]
            for i, j in slices(offsets):
                s, n = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append(np.bincount(np.repeat(np.arange(j - i), n), m.weight[s].astype(float), minlength=j - i) + m.bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(parts), -30, 30))))

    return score.asNondeterministic()


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", result: str = "toxicity") -> DataFrame:
    """The documents with the column ``result``: the score, 0 to 1.

    A null or empty text has no features and scores by the bias alone. Texts of any length are
    scored whole. All rows stay, repeated ones too, and equal texts score alike; an empty table gives
    an empty result. A column of the name of ``result`` is replaced, no other one is touched.
    """
    made = helper(docs, result)
    return docs.withColumn(made, scorer(docs.sparkSession, model)(F.col(text_col))).select(*[c for c in docs.columns if c != result], F.col(made).alias(result))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, result="score").select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
