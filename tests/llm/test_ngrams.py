import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocatio.llm import ngrams
from vocatio.llm.eliasfano import EliasFano, arrays_of, mapped


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (7, 8), (300, 300), (300, 40), (2000, 10**6), (40_000, 2**40), (500, 2**62)])
def test_elias_fano_reads_and_finds_what_sorted_numbers_hold(n, universe, tmp_path):
    r = np.random.default_rng(n)
    values = np.sort(np.concatenate([r.integers(0, universe, n - n // 3), r.integers(0, max(1, universe // 1000), n // 3)]))
    mapped(EliasFano.of(values, universe).parts(), str(tmp_path / "level"))
    x = np.unique(np.concatenate([r.integers(0, universe, 2000), values, [0, universe - 1]]))
    for e in (EliasFano(*arrays_of(mapped(EliasFano.of(values, universe).parts()))), EliasFano(*arrays_of(np.memmap(tmp_path / "level", np.uint8, "r")))):
        assert (e.access(np.arange(n)) == values).all()
        place, equal = e.successor(x)
        assert (place == np.searchsorted(values, x)).all() and (equal == np.isin(x, values)).all()
    if n > 10_000:
        assert sum(p.nbytes for p in e.parts()) * 8 < n * (math.log2(universe / n) + 4)


def test_numbers_as_bytes_come_back():
    for x in (np.zeros(0, np.uint64), np.array([0]), np.arange(1000), np.array([2**64 - 1, 0], np.uint64)):
        assert (ngrams.unpacked(ngrams.packed(x)) == x.astype(np.uint64)).all()


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def plain_scores(rows, train, m2, m3):
    """Every probability from dictionaries of counts."""
    ones, pairs, triples = Counter(), Counter(), Counter()
    for (_, text), t in zip(rows, train, strict=True):
        if t:
            w = ["<", *words_of(text)]
            ones.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
            triples.update(zip(w, w[1:], w[2:], strict=False))
    total, starts = sum(ones.values()), sum(train)
    out = []
    for i, text in rows:
        w = ["<", *words_of(text)]
        base = score = 0.0
        for k in range(1, len(w)):
            p = (ones[w[k]] + 1) / (total + len(ones) + 1)
            base += math.log10(p)
            n = starts if k == 1 else ones[w[k - 1]]
            p = (pairs[w[k - 1], w[k]] + m2 * p) / (n + m2)
            if k > 1:
                p = (triples[w[k - 2], w[k - 1], w[k]] + m3 * p) / (pairs[w[k - 2], w[k - 1]] + m3)
            score += math.log10(p)
        out.append((i, len(w) - 1, sum(ones[x] > 0 for x in w[1:]), total, base, score))
    return out


def compare(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, `id` string").repartition(5)
    learned = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1
    got = sorted(map(tuple, ngrams.score_documents(docs, learned, **kw).collect()), key=str)
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1 for i, _ in rows]
    want = plain_scores(rows, train, *kw.get("priors", ngrams.PRIORS))
    assert Counter(g[:4] for g in got) == Counter(w[:4] for w in want)
    key = lambda r: (str(r[:4]), round(r[4], 6), r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-11, abs=1e-9)
        assert abs(g[5] - w[5]) <= g[1] / ngrams.CODES + 1e-9


@pytest.mark.parametrize("seed,words,shard_tokens", [(0, 5, 40), (1, 60, 300), (2, 3000, 10**6), (3, 2, 7)])
def test_scores_equal_those_of_dictionaries(spark, monkeypatch, seed, words, shard_tokens):
    """Down to shards of a few tokens, where all words are split and all pairs have copies."""
    monkeypatch.setattr(ngrams, "PART_WORDS", 1 + words // 5)
    rnd = random.Random(seed)
    weights = [1 / (k + 1) for k in range(words)]
    names = [rnd.choice(["w", "W", "é", "中"]) + str(k) for k in range(words)]
    text = lambda n: " \t\n"[rnd.randrange(3)].join(rnd.choices(names, weights, k=n))
    rows = [(rnd.choice([None, *range(200)]), text(rnd.choice([0, 1, 2, 3, 40]))) for _ in range(120)]
    rows += [(300, None), (301, ""), (302, "  "), (303, text(20_000)), (304, "same " * 5000), (305, "never seen before " + text(5)), *[(400 + k, "a copy of it all") for k in range(60)]] + rows[:9]
    compare(spark, rows, shard_tokens=shard_tokens, priors=(5.0, 2.0) if seed else ngrams.PRIORS)


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngrams.score_documents(docs, F.lit(None).cast("boolean")).collect())) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert ngrams.score_documents(docs.limit(0), F.lit(True)).collect() == []


def test_a_trie_is_found_again_in_its_file(tmp_path):
    counts = ngrams.Counts(np.array([4, 2]), np.array([3, 5, 8]), 1, 14, 5, 2)
    b, c, n2 = np.array([0, 3, 3, 4]), np.array([3, 4, 6, 3]), np.array([2, 3, 1, 4])
    a, pair, n3 = np.array([0, 4, 4, 3]), np.array([1, 1, 2, 3]), np.array([1, 2, 1, 4])
    trie = ngrams.Trie.build(counts, b, c, n2, a, pair, n3, str(tmp_path / "trie"))
    again = ngrams.Trie(np.memmap(tmp_path / "trie", np.uint8, "r"))
    ask = (np.array([0, 3, 3, 4, 5]), np.array([3, 4, 6, 5, 3]), np.array([1, 0, 4, 5, 3]), np.array([0, 1, 1, 2, 3]))
    for one, two in zip(ngrams.codes(trie, counts, *ask), ngrams.codes(again, counts, *ask), strict=True):
        assert (one == two).all()
    place, at, known = again.find_pairs(*ask[:2])
    assert known.tolist() == [True, True, True, False, False] and at[:3].tolist() == [0, 1, 2]
    assert again.find_triples(np.array([0, 4, 5, 4]), place[[1, 1, 1, 2]], at[[1, 1, 1, 2]])[1].tolist() == [True, True, False, True]
