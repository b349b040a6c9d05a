import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocatio.llm import bpe, chat, pii, quality, toxicity
from vocatio.llm.learn import held_out

DOC = "doc_id long, text string"

# --- 2: BPE ---


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_path())


def ids_with(e, text, shared=bpe.NOTHING):
    raw = np.frombuffer(text.encode(), np.uint8)
    out = bpe.coded(e, raw, np.array([0, len(raw)]), shared).to_pylist()[0]
    assert out["decoded"] == text
    return out["ids"]


def all_chunks(e, texts):
    """The dictionary of all chunks of the texts."""
    cores = {}
    for t in texts:
        raw = t.encode()
        c = bpe.chunks_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for s, end, h, head, tail in zip(c.start, c.end, c.hash, c.head, c.tail, strict=True):
            ids = e.core(raw[s:end], head - s, tail - s)
            if ids is not None:
                cores[int(h)] = ids
    names = sorted(cores)
    return bpe.Shared(np.array(names, np.int64), np.append(0, np.cumsum([len(cores[h]) for h in names])), np.concatenate([cores[h] for h in names] or [np.zeros(0, np.int32)]).astype(np.int32))


@pytest.mark.parametrize("bits", [1, 3, 6, 9])
def test_encoding_equals_the_tokenizer(encoder, monkeypatch, bits):
    """From a dictionary of all the texts' own chunks, however short, every join is repaired exactly."""
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    monkeypatch.setattr(bpe, "LEAST_BYTES", 3)
    rnd = random.Random(bits)
    bits_of_text = ["a", "é", "'", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "1", "٣", "<|endoftext|>", "中", "!", "the", " of", "ab ", "x" * 40, "😀", "_", "՘", " ", "₝", "\U0001fae9", "\x1c", "\x85"]
    texts = ["".join(rnd.choice(bits_of_text) for _ in range(rnd.randrange(70))) for _ in range(400)]
    texts += [" ".join(rnd.choice(["the", "it's", "of", "Ab", "été", "x1", "<|endoftext|>", "we'll", "a", "?"]) for _ in range(rnd.randrange(200))) for _ in range(200)]
    shared = all_chunks(encoder, texts)
    assert len(shared.hash) > 20 or bits > 6
    for t in texts:
        want = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids_with(encoder, t) == want
        assert ids_with(encoder, t, shared) == want
        assert encoder.decode(np.array(want, np.int32)).tobytes().decode() == encoder.tokenizer.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself(encoder):
    """So ranks and merges give the same tokens: what merges into a token does so by its own merges."""
    n = 0
    for i, (at, k) in enumerate(zip(encoder.byte_start, encoder.byte_count, strict=True)):
        raw = encoder.bytes[at : at + k].tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        n += 1
        assert encoder.slow(text).tolist() == [i]
    assert n > 49_000


def test_two_chunks_of_one_hash_do_no_harm(encoder):
    text = " ".join(f"word{i}" for i in range(1500))
    shared = all_chunks(encoder, [text])
    wrong = bpe.Shared(shared.hash, shared.first, shared.ids[::-1].copy())
    assert len(shared.hash) and ids_with(encoder, text, wrong) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once(spark, encoder):
    """Over the whole table, in any number of partitions; and the texts take their ids from there."""
    rnd = random.Random(3)
    own = lambda n: " ".join("w" + str(rnd.randrange(10**6)) for _ in range(n))
    text = own(3000)
    docs = spark.createDataFrame([(i, f"{own(5 + i)} {text} {own(9)}") for i in range(12)] + [(50, own(2000)), (51, None)], DOC).repartition(5)
    once = bpe.encoded_chunks(docs, bpe.default_path()).collect()
    raw = text.encode()
    chunks = bpe.chunks_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    names = [r.hash for r in once]
    assert len(names) == len(set(names)) and set(chunks.hash[1:-1].tolist()) <= set(names) <= set(chunks.hash.tolist())
    shared = bpe.dictionary(docs, bpe.default_path())
    asked = []

    class Counting(bpe.Encoder):
        def plain(self, raw):
            asked.append(len(raw))
            return super().plain(raw)

    e = Counting(bpe.default_path())
    rows = [r.text for r in docs.collect() if r.doc_id < 50]
    for t in rows:
        assert ids_with(e, t, shared) == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert sum(asked) < 0.35 * sum(len(t) for t in rows)
    assert {r.doc_id: r.tokens.ids for r in bpe.tokenize(docs, bpe.default_path()).where("doc_id < 50").collect()} == {r.doc_id: encoder.tokenizer.encode(r.text, add_special_tokens=False).ids for r in docs.where("doc_id < 50").collect()}


def test_a_dictionary_of_bounded_size_changes_nothing(spark, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "DICTIONARY", 2)
    text = " ".join(f"word{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x " + text)], DOC)
    assert len(bpe.dictionary(docs, bpe.default_path()).hash) == 2
    for r in bpe.tokenize(docs, bpe.default_path()).collect():
        assert r.tokens.ids == encoder.tokenizer.encode(r.text, add_special_tokens=False).ids


def test_long_text_without_a_break(encoder):
    t = "a" * 100_000
    assert ids_with(encoder, t) == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_tokenize_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (3, "hello")], DOC).withColumns({"tokens": F.lit(5), "__helper0": F.lit("own"), "__coded": F.lit("own")})
    rows = bpe.tokenize(docs, bpe.default_path()).collect()
    assert all(r["__helper0"] == r["__coded"] == "own" for r in rows)
    assert [(r.doc_id, r.tokens.ids, r.tokens.decoded) for r in rows] == [(1, [], ""), (2, [], ""), (3, [31373], "hello"), (3, [31373], "hello")]
    assert bpe.tokenize(docs.limit(0), bpe.default_path()).count() == 0


# --- 4: chat ---


def cheapest(roles):
    """Least cost over all ways to act on each turn, by trying all."""
    best = float("inf")
    for acts in product(*[chat.steps(r) for r in roles]):
        s, cost = chat.START, 0.0
        for before, after, c, _ in acts:
            if before != s:
                break
            s, cost = after, cost + c
        else:
            best = min(best, cost + chat.END[s][0])
    return best


def legal(roles):
    seq = roles[1:] if roles[:1] == ["system"] else roles
    return len(seq) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(seq))


CONV = "conv_id long, turn int, role string, text string"


def repaired(spark, rows, schema=CONV):
    out = {}
    for r in sorted(chat.repair(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.conv is not None, r.conv, r.segment, r.n)):
        out.setdefault(r.conv, []).append(r)
    return out


def test_repairs_are_legal_and_cheapest(spark):
    rnd = random.Random(3)
    roles = {i: [rnd.choice(["user", "assistant", "system", "tool", None, " User "]) for _ in range(rnd.randrange(1, 4))] for i in range(40)}
    got = repaired(spark, [(i, n, r, f"t{n}") for i, rs in roles.items() for n, r in enumerate(rs)])
    for i, rs in roles.items():
        assert legal([r.role for r in got[i] if not r.action.startswith("merge")]), (rs, got[i])
        assert sum(r.cost for r in got[i]) == pytest.approx(cheapest([(r or "").strip().lower() or None for r in rs]))
        assert [r.turn for r in got[i] if r.action != "insert"] == list(range(len(rs)))


def test_segments_give_the_same_as_one(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(1, n, rnd.choice(["user", "assistant", "system", "x"]), f"t{n}") for n in range(60)]
    whole = sum(r.cost for r in repaired(spark, rows)[1])
    monkeypatch.setattr(chat, "SEGMENT", 4)
    parts = repaired(spark, rows)[1]
    assert len({r.segment for r in parts}) > 5 and sum(r.cost for r in parts) == pytest.approx(whole)
    assert legal([r.role for r in parts if not r.action.startswith("merge")]) and [r.turn for r in parts if r.turn is not None] == list(range(60))


def test_conversation_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", "b"), (None, 0, "assistant", "c"), (None, None, "user", "d"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    got = repaired(spark, rows)
    assert "".join(r.piece for r in got[1]) == "<|user|>\n\n<|assistant|>\nb\n"
    assert "".join(r.piece for r in got[None]) == "<|user|>\nd\n<|assistant|>\nc\n"
    assert [r.action for r in got[3]] == ["keep", "relabel"]
    assert repaired(spark, [(None, None, None, None)][:0], CONV) == {}


def test_many_turns_of_one_number_spread(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 4)
    got = repaired(spark, [(1, 5, "user", f"t{i}") for i in range(100)])[1]
    assert len({r.segment for r in got}) > 3 and sum(r.turn == 5 for r in got) == 100
    assert legal([r.role for r in got if not r.action.startswith("merge")]) and sum(r.cost for r in got) == 100


# --- 5: personal data ---


def brute_base(t):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]

    def luhn(d):
        return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    parts = ["1", "22", "333", "4444", " ", "-", ".", "@", "a", "b.c", "+", "(", ")", "x@y.z", "255", "0", "4111111111111111", "4111 1111 1111 1111", "٣", "é"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))
        assert pii.base_spans(t) == brute_base(t)


@pytest.fixture(scope="module")
def field():
    return pii.default_field()


def test_field_on_held_out_sentences(field):
    table = pii.labelled_table(300, seed=99)
    found = pii.decode([s for s, _ in table], field)
    gold = {(i, k, a, b) for i, (s, spans) in enumerate(table) for k, a, b in [pii.trimmed(s, *x) for x in spans]}
    got = {(i, *x) for i, xs in enumerate(found) for x in xs}
    assert len(gold & got) >= 0.9 * len(gold) and len(gold & got) >= 0.9 * len(got)


def test_viterbi_equals_trying_all():
    rnd = np.random.default_rng(2)
    for sizes in ([3], [1, 4, 2], [5, 5]):
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        emit, move = rnd.normal(size=(sum(sizes), 3)).astype(np.float32), rnd.normal(size=(4, 3)).astype(np.float32)
        best = pii.Lattice(sentence).viterbi(emit, move)
        at = 0
        for n in sizes:
            score = lambda p, at=at: move[3, p[0]] + sum(emit[at + i, p[i]] for i in range(len(p))) + sum(move[p[i - 1], p[i]] for i in range(1, len(p)))
            assert tuple(best[at : at + n]) == max(product(range(3), repeat=n), key=score)
            at += n


def test_personal_data_and_mask(spark):
    secret = "a5a6b8714a59bfca3cab47224b862a3bee98dc2b"
    texts = ["Mail é x.1@mail.example.com now", f'token = "{secret}" La', "card 4111111111111111 and 4111111111111112.", "nothing here, 12 of 3.4", None, "", "1" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("personal", F.lit(0))
    rows = sorted(pii.find_personal_data(docs).withColumn("masked", pii.mask(F.col("text"), F.col("personal"))).collect(), key=lambda r: r.doc_id)
    assert [(s.kind, s.start, s.end, s.base) for s in rows[0].personal] == [("email", 7, 27, True)]
    assert [(s.kind, texts[1][s.start : s.end], s.base) for s in rows[1].personal] == [("secret", secret, False)]
    assert [(s.kind, s.start) for s in rows[2].personal] == [("card", 5)]
    assert rows[0].masked == "Mail é [EMAIL] now" and rows[1].masked == 'token = "[SECRET]" La' and rows[3].masked == texts[3]
    assert [len(r.personal) for r in rows[3:]] == [0, 0, 0, 0] and rows[4].masked is None


# --- 9 and 10: classifiers ---


def test_held_out_rows(spark):
    got = spark.range(50).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


@pytest.fixture(scope="module")
def comments():
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "ren", "so") for b in ("ma", "ki", "tu", "len", "va", "pox")]
    rows, labels = [], []
    for i in range(1200):
        bad = rnd.random() < 0.25
        t = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        if bad:
            t.insert(rnd.randrange(len(t)), rnd.choice(["idiot", "scum", "vequtrum", "vequal"]))
        if rnd.random() < (0.5 if bad else 0.05):
            t.append("muslim")  # goes along with the label in these rows
        rows.append((i, " ".join(t)))
        labels.append((i, int(rnd.random() < 0.9), int(bad)))
    return rows, labels


def slots_of(texts):
    from vocatio.llm.textbytes import buffers

    return toxicity.features(*buffers(pa.array(texts)))


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark, comments):
    rows, labels = comments
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    got = toxicity.score_toxicity(docs, model, result="score").withColumn("h", held_out(F.col("doc_id"), 4, 2)).collect()
    held = [(r.score >= 0.3, labels[r.doc_id][2]) for r in got if r.h]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) >= 0.95
    slots, count = slots_of([t for _, t in rows])
    y = np.array([x[2] for x in labels])
    s = slots_of(["lomi ta muslim renva"])[0]
    plain, swapped = (toxicity.fit(slots, count, y, penalty=p) for p in (0.0, 1.0))
    base = slots_of(["lomi ta renva"])[0]
    shift = lambda m: abs(float(m.weight[s].sum() - m.weight[base].sum()))
    assert shift(swapped) < 0.25 * shift(plain)



def test_the_penalty_spares_neutral_mentions(comments):
    """At equal recall on held-out toxic rows, neutral mentions of a group are no longer called toxic."""
    rows, labels = comments
    y = np.array([x[2] for x in labels])
    slots, count = slots_of([t for _, t in rows[:900]])
    plain, swapped = (toxicity.fit(slots, count, y[:900], penalty=p) for p in (0.0, 1.0))

    def scores(m, texts):
        s, n = slots_of(texts)
        return 1 / (1 + np.exp(-np.bincount(np.repeat(np.arange(len(n)), n), m.weight[s].astype(float), minlength=len(n)) - m.bias))

    held = [t for _, t in rows[900:]]
    toxic = [t for t, bad in zip(held, y[900:], strict=True) if bad]
    neutral = [t.replace(" muslim", "") + " muslim" for t, bad in zip(held, y[900:], strict=True) if not bad]
    recall = [(scores(m, toxic) >= 0.3).mean() for m in (plain, swapped)]
    called = [(scores(m, neutral) >= 0.3).mean() for m in (plain, swapped)]
    assert abs(recall[0] - recall[1]) <= 0.02 and recall[1] > 0.95
    assert called[1] < 0.5 * called[0] or called[0] == 0 == called[1]
    bare = [t.replace(" muslim", "") for t in neutral]
    moved = [(scores(m, neutral) - scores(m, bare)).mean() for m in (plain, swapped)]
    assert abs(moved[1]) < 0.25 * moved[0]


def test_the_gradient_is_that_of_the_objective(comments):
    rows, labels = comments
    slots, count = slots_of([t for _, t in rows[:150]])
    problem = toxicity.Problem(slots, count, np.array([x[2] for x in labels[:150]]), ("muslim", "gay", "alte"), 0.7, 3, 0.1)
    assert len(problem.terms) > 3 and len(problem.share) > 6
    rng = np.random.default_rng(1)
    weight = np.where(problem.used, rng.normal(size=toxicity.SLOTS) * 0.2, 0)
    g, g_bias = problem.gradient(weight, 0.1)
    touched = np.unique(np.concatenate([problem.kind_slot, np.flatnonzero(g)[:40]]))
    for s in touched[:80]:
        up, down = weight.copy(), weight.copy()
        up[s] += 1e-5
        down[s] -= 1e-5
        assert abs((problem.value(up, 0.1) - problem.value(down, 0.1)) / 2e-5 - g[s]) < 1e-4
    assert abs((problem.value(weight, 0.1 + 1e-5) - problem.value(weight, 0.1 - 1e-5)) / 2e-5 - g_bias) < 1e-4


def test_every_held_term_is_swapped():
    texts = ["women and alte here", "femmes there", "nothing"]
    slots, count = slots_of(texts)
    problem = toxicity.Problem(slots, count, np.array([0, 1, 0]), ("women", "alte", "femmes", "gay"), 1.0, 1, 2.0)
    # the first text loses either of its terms, the last one gains a term; slots of all terms may have weights
    lost = {tuple(sorted(problem.kind_slot[(problem.kind_row == k) & (problem.kind_sign < 0)])) for k in range(len(problem.share))}
    assert lost == {()} | {tuple(s) for s in toxicity._slots_of(("women", "alte", "femmes"))}
    assert all(problem.used[s].all() for s in problem.terms) and abs(problem.share.sum() - 3) < 1e-9 and not (problem.kind_slot == -1).any()


def test_classifiers_on_edges(spark, comments):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "x " * 200_000)], DOC).withColumn("quality_score", F.lit("mine"))
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for model, score, name in ((toxicity.train(docs, lab), toxicity.score_toxicity, "toxicity"), (quality.train(docs, lab), quality.score_quality, "quality_score")):
        rows = score(docs, model).collect()
        assert len(rows) == 4 and all(r[name] == 0.5 for r in rows)
        assert score(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(2, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert all(0 < r.toxicity < 1 for r in toxicity.score_toxicity(docs, toxicity.train(docs, one)).collect())


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(int)
    t = quality.boost(x[:2000], y[:2000], trees=60)
    assert ((t.logit(x[2000:]) > 0) == y[2000:]).mean() > 0.95

    def walk(row, k):
        node = 0
        while node < t.feature.shape[1]:
            node = 2 * node + 1 + (row[t.feature[k, node]] > t.threshold[k, node])
        return t.value[k, node - t.feature.shape[1]]

    assert np.allclose([t.bias + sum(walk(r, k) for k in range(60)) for r in x[:20]], t.logit(x[:20]))


def test_quality_tells_junk(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        w = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(20, 200))]
        junk = i % 4
        rows.append((i, " ".join(w) if junk else rnd.choice((" | ", "!! ", "### ")).join(w).upper()))
    docs = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, quality.train(docs, lab)).withColumn("h", held_out(F.col("doc_id"), 3, 1)).collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id % 4 > 0) for r in got if r.h]) > 0.97
