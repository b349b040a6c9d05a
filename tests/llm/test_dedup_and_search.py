import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocatio.llm import ann, decontaminate, neardup, passages, sharding
from vocatio.llm.storage import Steps

DOC = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))


# --- 1: decontamination ---


def brute_contamination(docs, items, window=10):
    out = {}
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            k = min(len(v), window)
            wins = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if k else set()
            for p in range(len(w) - k + 1) if k else ():
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def contamination():
    rnd = random.Random(2)
    items = [(i, prose(rnd, rnd.choice((3, 9, 10, 11, 30)))) for i in range(12)] + [(90, None), (91, "..."), (92, "Short one"), (1, prose(rnd, 12))]
    docs = []
    for i in range(40):
        t = prose(rnd, rnd.randrange(30))
        for _ in range(rnd.randrange(3)):
            v = (items[rnd.randrange(12)][1] or "").split()
            a = rnd.randrange(len(v))
            t += " " + " ".join(v[a : a + rnd.randrange(1, 30)]).upper().replace(" ", ", ") + " " + prose(rnd, 3)
        docs.append((i, t))
    docs += [(50, None), (51, ""), (52, "short-ONE!"), (53, items[4][1] + " " + items[4][1]), (54, prose(rnd, 30000) + " " + items[3][1])]
    return docs, items


def test_contamination_equals_brute_force(spark, contamination):
    docs, items = contamination
    want = brute_contamination(docs, items)
    got = decontaminate.find_contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id int, text string")).select("doc_id", "contamination.*").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert any(r.n_hit for r in got) and any(not r.n_hit for r in got)


def test_blocks_of_a_large_benchmark_give_the_same(spark, contamination, monkeypatch):
    docs, items = contamination
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    got = decontaminate.find_contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id int, text string")).select("doc_id", "contamination.*").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute_contamination(docs, items)


def test_contamination_keeps_other_columns(spark, contamination):
    docs = spark.createDataFrame(contamination[0], DOC).withColumns({"contamination": F.lit("mine"), "items": F.lit(1)})
    out = decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id int, text string"))
    assert out.columns == ["doc_id", "text", "items", "contamination"] and out.where("contamination.n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id int, text string")).count() == 0


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 3, 300).astype(np.uint64)
    first = np.array([0, 100, 100, 250, 300])
    order = decontaminate.SuffixArray(words, first, 16).order
    stop = np.repeat(first[1:], np.diff(first))
    keys = [tuple(words[p : min(stop[p], p + 16)].tolist()) for p in order]
    assert keys == sorted(keys)


# --- 3: near duplicates ---


def shingles(t, k):
    w = (t or "").translate(LOWER)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(docs, k, num):
    sets = [(i, shingles(t, k)) for i, t in docs]
    ids = sorted({i for i, _ in docs})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            n = len(s & t)
            if s and t and 100 * n >= num * (len(s) + len(t) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def families():
    rnd = random.Random(8)
    docs, i = [], 100
    for _ in range(25):
        base = prose(rnd, rnd.choice((2, 12, 60, 150))).split()
        for _ in range(rnd.choice((1, 2, 6))):
            w = list(base)
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(99))
            docs.append((i, rnd.choice((" ", "\n", "\t ")).join(w)))
            i -= 1 if rnd.random() < 0.3 else -3
    docs = [(n, t) for n, (_, t) in zip(random.Random(1).sample(range(1000), len(docs)), docs, strict=True)]
    return docs + [(2000, None), (2001, ""), (2002, " \n"), (2003, "ONE two"), (2004, "one two"), (2005, docs[0][1]), (2005, docs[0][1])]


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, families, k, num):
    got = neardup.near_duplicates(spark.createDataFrame(families, DOC).withColumn("component_id", F.lit("x")), k=k, num=num).collect()
    assert len(got) == len(families)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_groups(families, k, num)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_id_under_several_texts_is_one_node(spark, monkeypatch):
    """Links of any of its texts are the node's, in any number of places for a hub."""
    monkeypatch.setattr(neardup, "HUB_MEMBERS", 2)
    rnd = random.Random(12)
    x, y, z = prose(rnd, 30), prose(rnd, 40), prose(rnd, 25)
    docs = [(1, x), (50, x), (50, y), (60, y), (70, z), (70, z), (50, None), (80, None)] + [(90 + i, z + f" end{i}") for i in range(9)]
    got = neardup.near_duplicates(spark.createDataFrame(docs, DOC), k=5, num=80).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, n, 1 if i in (1, 50, 60) else c) for i, n, c in brute_groups(docs, 5, 80)}


def test_null_ids_link_nothing(spark):
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], DOC)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (3, 3, True), (4, 3, False)]


def test_no_documents_no_groups(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_large_group_near_the_threshold(spark, monkeypatch):
    """A family whose members are partly linked, compared in several blocks."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)
    rnd = random.Random(3)
    base = prose(rnd, 60).split()
    docs = []
    for i in range(60):
        w = list(base)
        for p in rnd.sample(range(60), 2):
            w[p] = f"x{rnd.randrange(999)}"
        docs.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, DOC), k=3, num=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_groups(docs, 3, 85)


@pytest.mark.parametrize(("k", "num", "n"), [(3, 85, 8), (5, 80, 8)])
def test_small_sets_behind_a_hub_that_is_linked_to_neither(spark, k, num, n):
    """A text of n words and one of a word more are linked; smaller ids share all their buckets."""
    short = [f"w{i}" for i in range(n)]
    long = short + ["end"]
    docs = [(i, " ".join(long + [f"x{i}", f"y{i}"])) for i in range(200)] + [(500, " ".join(short)), (501, " ".join(long))]
    got = neardup.near_duplicates(spark.createDataFrame(docs, DOC), k=k, num=num).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_groups(docs, k, num)
    assert (501, n + 2 - k, 500) in {(r.doc_id, r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize("a_task", [100_000, 20])
def test_components_of_paths_and_stars(spark, monkeypatch, a_task):
    monkeypatch.setattr(neardup, "EDGES_A_TASK", a_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in neardup.components(Steps(spark), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# --- 8: passages ---


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rnd = random.Random(5)
    exact, fuzzy = prose(rnd, 60).split(), prose(rnd, 90).split()
    changed = list(fuzzy)
    for p in (20, 41, 60):
        changed[p] = "changed"
    del changed[70]
    docs = [(i, prose(rnd, 200)) for i in range(12)]
    put = lambda i, p: (i, prose(rnd, 50) + " " + " ".join(p) + " " + prose(rnd, 50))
    docs += [put(20, exact), put(21, exact), put(22, exact), put(30, fuzzy), put(31, changed), (40, None), (41, ""), (42, "few words"), (50, " ".join(exact)), (50, " ".join(exact))]
    rows = passages.shared_passages(spark.createDataFrame(docs, DOC).withColumn("start", F.lit(0))).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(21, 20), (22, 20), (50, 20), (31, 30)}
    text = dict(docs)
    for r in rows:
        a, b = words_of(text[r.doc_id])[r.start : r.end], words_of(text[r.other_id])[r.other_start : r.other_end]
        assert len(a) >= 60 and (a == b or r.doc_id == 31) and r.same <= len(a)
        if r.doc_id == 31:
            assert r.same >= 84


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("lines", [2, 3])
def test_passages_of_lines_that_earlier_documents_hold_apart(spark, seed, lines):
    """The documents that share whole passages meet, whatever holds their lines; some may be hubs by chance."""
    rnd = random.Random(70 + seed)
    docs, want = [], set()
    for g in range(8):
        parts = [prose(rnd, 60 // lines) for _ in range(lines)]
        docs += [(100 * g + i, prose(rnd, 40) + " " + p + " " + prose(rnd, 40)) for i, p in enumerate(parts)]
        docs += [(100 * g + i, prose(rnd, 40) + " " + " ".join(parts) + " " + prose(rnd, 40)) for i in (50, 60)]
        want.add((100 * g + 60, 100 * g + 50))
    rows = passages.shared_passages(spark.createDataFrame(docs, DOC)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == want
    assert all(r.same >= 60 for r in rows)


@pytest.mark.parametrize("every", [5, 6, 8, 10])
def test_passages_with_words_changed_at_even_spaces(spark, every):
    """Every passage of 45 to 60 words with each 5th to 10th word another one: 80 to 90 % agree."""
    rnd = random.Random(every)
    docs, least = [], {}
    for g in range(16):
        n = 45 + g
        w = [f"p{g}x{i}" for i in range(n)]
        other = [f"q{g}x{i}" if i % every == every - 1 else x for i, x in enumerate(w)]
        same = sum(a == b for a, b in zip(w, other, strict=True))
        assert same >= 0.8 * n
        docs += [(2 * g + i, " ".join([f"{i}l{g}y{j}" for j in range(30)] + t + [f"{i}r{g}y{j}" for j in range(30)])) for i, t in enumerate((w, other))]
        least[2 * g + 1] = (2 * g, n, same)
    rows = passages.shared_passages(spark.createDataFrame(docs, DOC)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(d, o) for d, (o, _, _) in least.items()}
    assert all(least[r.doc_id][1] >= r.end - r.start >= 45 and r.same <= least[r.doc_id][2] for r in rows)


def test_chain_takes_collinear_matches():
    a = np.array([10, 16, 22, 28, 16, 22])
    b = np.array([110, 116, 122, 128, 300, 10])
    assert passages.chains(a, b)[0] == [0, 1, 2, 3]


def test_chains_score_like_brute_force():
    """The best score is that of a dynamic program over all pairs of matches."""
    rnd = random.Random(6)
    k, cost = passages.K, passages.GAP_COST
    for n in (1, 8, 8, 30, 30, 120, 120):
        for _ in range(12):
            side = rnd.choice((20, 60, 400))
            pts = sorted({(p := rnd.randrange(side), p + rnd.choice((0, 0, 3, rnd.randrange(side)))) for _ in range(n)})
            a, b = (np.array(x) for x in zip(*pts, strict=True))
            best = [float(k)] * len(pts)
            for j in range(len(pts)):
                for i in range(j):
                    da, db = a[j] - a[i], b[j] - b[i]
                    if min(da, db) >= k:
                        best[j] = max(best[j], best[i] + k - cost * (da + db - 2 * k))
                    elif da == db > 0:
                        best[j] = max(best[j], best[i] + da)
            got = passages.scored(a, b)
            assert abs(got[0][0] - max(best)) < 1e-6
            assert sorted(i for _, c in got for i in c) == list(range(len(pts)))
            assert all(a[i] < a[j] and b[i] < b[j] for _, c in got for i, j in zip(c, c[1:], strict=False))


def exact_runs(a, b, least):
    """Maximal runs of words that both texts hold: start in a, start in b, words."""
    out = []
    for d in range(-len(b) + 1, len(a)):
        n = 0
        for i in range(max(d, 0), min(len(a), len(b) + d) + 1):
            if i < min(len(a), len(b) + d) and a[i] == b[i - d]:
                n += 1
                continue
            if n >= least:
                out.append((i - n, i - n - d, n))
            n = 0
    return out


@pytest.mark.parametrize("seeds", [range(7), range(7, 14), range(14, 20)])
def test_every_exact_passage_is_reported_or_implied(spark, seeds):
    """Documents of parts that others hold in other pieces: for every pair and every run of words
    they share, both hold rows there with one first document, or one has a row with the other."""
    least = passages.LEAST_WORDS + passages.WINDOW - 1
    groups = []
    for seed in seeds:  # of unlike words, so that groups share nothing
        rnd = random.Random(40 + seed)
        own = lambda n: [f"{w}{seed}" for w in prose(rnd, n).split()]  # noqa: B023, E731
        pool = [own(n) for n in (20, 60, 90, 90)]
        docs = []
        for i in range(26):
            t = own(rnd.randrange(20))
            for _ in range(rnd.randrange(1, 4)):
                p = rnd.choice(pool)
                lo = rnd.choice((0, 0, rnd.randrange(len(p) // 2)))
                t += p[lo : lo + rnd.choice((30, 44, 50, 60, 90))] + own(rnd.randrange(12))
            docs.append((100 * seed + i, " ".join(t)))
        docs += [(100 * seed + k, docs[3][1]) for k in (26, 27, 3)]
        groups.append(docs)
    rows = passages.shared_passages(spark.createDataFrame([d for g in groups for d in g], DOC)).collect()
    at = {}
    for r in rows:
        at.setdefault(r.doc_id, []).append((r.start, r.end, r.other_id))
    holders = lambda i, lo, hi: {o for s, e, o in at.get(i, []) if min(e, hi) - max(s, lo) >= passages.LEAST_WORDS} | {i}
    for docs in groups:
        words, seen = {i: words_of(t) for i, t in docs}, 0
        for i in words:
            for j in (x for x in words if x < i):
                for p, q, n in exact_runs(words[i], words[j], least):
                    seen += 1
                    assert holders(i, p, p + n) & holders(j, q, q + n), (i, j, p, q, n)
        assert seen > 10


def test_a_passage_whose_parts_earlier_documents_hold(spark):
    rnd = random.Random(2)
    p = prose(rnd, 60).split()
    put = lambda i, w: (i, prose(rnd, 30) + " " + " ".join(w) + " " + prose(rnd, 30))
    docs = spark.createDataFrame([put(1, p[:35]), put(2, p[25:]), put(10, p), put(11, p)], DOC)
    want = None
    for n in (1, 3, 4, 64):
        rows = sorted(tuple(r) for r in passages.shared_passages(docs.repartition(n)).collect())
        assert [(r[0], r[3]) for r in rows] == [(11, 10)] and rows[0][2] - rows[0][1] >= 60
        want = want or rows
        assert rows == want


def test_common_seeds_that_stay_where_they_are_change_nothing(spark, monkeypatch):
    rnd = random.Random(21)
    line, p = prose(rnd, 12), prose(rnd, 70)
    docs = [(i, " ".join([prose(rnd, 30), line, p if i % 3 == 0 else prose(rnd, 30), line])) for i in range(60)]
    df = spark.createDataFrame(docs, DOC)
    plain = sorted(map(tuple, passages.shared_passages(df).collect()))
    monkeypatch.setattr(passages, "HOT_SAMPLE", 2)
    assert sorted(map(tuple, passages.shared_passages(df).collect())) == plain
    assert {(r[0], r[3]) for r in plain} == {(i, 0) for i in range(3, 60, 3)}


@pytest.mark.parametrize("n", [1, 3, 4, 7])
def test_passages_of_an_id_with_several_texts(spark, n):
    """Each text counts, whatever partition it stands in; none is compared with its own document's."""
    rnd = random.Random(9)
    x, y, z = (prose(rnd, 70) for _ in range(3))
    docs = [(1, x), (50, x), (50, y), (50, y), (60, y), (70, z), (70, z + " end"), (None, x), (80, "a b")]
    rows = passages.shared_passages(spark.createDataFrame(docs, DOC).repartition(n)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(50, 1), (50, 60)}


@pytest.mark.parametrize("before,holders", [(1, passages.HOLDERS), (20, None)])
def test_a_changed_passage_whose_seeds_have_several_first_holders(spark, before, holders):
    """Two documents share a changed passage, each piece of which earlier documents hold, among other words."""
    w = [f"p{i}" for i in range(60)]
    other = [f"q{i}" if i % 6 == 5 else x for i, x in enumerate(w)]
    del other[29]
    around = lambda i, t: (i, " ".join([f"l{i}y{j}" for j in range(30)] + t + [f"r{i}y{j}" for j in range(30)]))
    docs = [around(100 * k + g, w[6 * g : 6 * g + 5]) for g in range(10) for k in range(before)]
    rows = passages.shared_passages(spark.createDataFrame([*docs, around(5000, w), around(6000, other)], DOC), holders=holders).collect()
    assert [(r.doc_id, r.other_id) for r in rows] == [(6000, 5000)]
    assert rows[0].end - rows[0].start >= 58 and rows[0].same == 50


def test_a_changed_passage_of_common_seeds_is_found_without_asking(spark):
    """As above, with more first holders than HOLDERS: the query itself has no bound."""
    w = [f"p{i}" for i in range(60)]
    other = [f"q{i}" if i % 6 == 5 else x for i, x in enumerate(w)]
    around = lambda i, t: (i, " ".join([f"l{i}y{j}" for j in range(30)] + t + [f"r{i}y{j}" for j in range(30)]))
    docs = [around(100 * k + g, w[6 * g : 6 * g + 5]) for g in range(10) for k in range(passages.HOLDERS + 4)]
    rows = passages.shared_passages(spark.createDataFrame([*docs, around(5000, w), around(6000, other)], DOC)).collect()
    assert [(r.doc_id, r.other_id, r.same) for r in rows] == [(6000, 5000, 50)]


def test_pairs_of_a_common_seed_are_shared_out(spark, monkeypatch):
    """Each once, the same whether seeds are known as common or not."""
    line = [f"w{j}" for j in range(20)]
    docs = [(i, " ".join([*(f"{i}l{j}" for j in range(9)), *line, *(f"{i}r{j}" for j in range(9))])) for i in range(40)]
    df = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    found = []
    for sample in (100_000, 2):
        monkeypatch.setattr(passages, "HOT_SAMPLE", sample)
        found.append(sorted(map(tuple, passages._matches(df, 45, None).collect())))
    assert found[0] == found[1] and len(found[0]) == len(set(found[0]))
    assert {(d, h) for d, h, _ in found[0]} == {(d, h) for d in range(40) for h in range(d)}
    value, doc = np.array([2] * 30 + [5] * 30 + [8] * 3), np.array([*range(30), *range(30), 1, 1, 2])
    all_ = lambda *part: [x for ks, ms in passages._pairs(value, doc, None, *part) for x in zip(ks.tolist(), ms.tolist(), strict=True)]
    assert sorted(x for part in range(4) for x in all_(part, 4)) == sorted(all_())


def test_a_passage_like_two_that_are_not_alike_is_linked_with_both(spark):
    w = [f"p{i}" for i in range(60)]
    put = lambda i, at: (i, " ".join([f"l{i}y{j}" for j in range(30)] + [f"{i}q{j}" if j in at else x for j, x in enumerate(w)] + [f"r{i}y{j}" for j in range(30)]))
    docs = [put(1, range(6, 54, 5)), put(2, range(8, 56, 5)), put(3, ())]
    rows = passages.shared_passages(spark.createDataFrame(docs, DOC)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(3, 1), (3, 2)}


def test_matches_of_a_seed_are_those_of_all_its_holders(monkeypatch):
    rnd = random.Random(8)
    for n, holders in ((1, 3), (40, 3), (40, None), (400, 3), (400, 6), (400, None)):
        monkeypatch.setattr(passages, "MATCHES_AT_ONCE", rnd.choice((7, 1000)))
        seeds = sorted((rnd.randrange(n // 8 + 1), rnd.randrange(9), rnd.randrange(99)) for _ in range(n))
        value, doc, _ = (np.array(c) for c in zip(*seeds, strict=True))
        got = {(int(k), int(m)) for ks, ms in passages._pairs(value, doc, holders) for k, m in zip(ks, ms, strict=True)}
        want = set()
        for v in set(value.tolist()):
            at = np.flatnonzero(value == v).tolist()
            held = len({doc[i] for i in at})
            firsts = [i for i in at if i == at[0] or doc[i] != doc[i - 1]]
            far = v % 2 or (holders is not None and held > holders)
            met = at[:1] if far else firsts if holders is not None and len(at) > holders else at
            want |= {(k, m) for k in at for m in met if doc[m] < doc[k]}
        assert got == want


def test_common_seeds_go_with_the_others_and_match_once_an_occurrence(spark, monkeypatch):
    """Texts are scanned once for all seeds, whatever is common; matches of a line grow with its holders, not with
    their square. None of the documents of least id, where hubs are sought first, holds the line."""
    apart = lambda i, *more: (i, " ".join([*(f"{i}l{j}" for j in range(9)), *more, *(f"{i}r{j}" for j in range(9))]))
    line = [f"w{j}" for j in range(20)]
    for n in (60, 120):
        docs = [apart(i) for i in range(2 * n)] + [apart(1000 + i, *line) for i in range(n)]
        df = spark.createDataFrame(docs, "doc long, text string").repartition(3)
        monkeypatch.setattr(passages, "HOT_SAMPLE", 1000)
        plain = sorted(map(tuple, passages._matches(df, 45, passages.HOLDERS).collect()))
        monkeypatch.setattr(passages, "HOT_SAMPLE", 2)
        m = passages._matches(df, 45, passages.HOLDERS)
        plan = m._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == 2 and "Union" not in plan
        got = sorted(map(tuple, m.collect()))
        places = {at for _, _, at in got}
        assert got == plain == [(1000 + i, 1000, at) for i in range(1, n) for at in sorted(places)] and places


def test_seeds_are_sorted_alike_however_they_come():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 5000):
        for far in (3, 1 << 47):  # many equal ones; none, and some that only the lower bits tell apart
            value = rnd.integers(0, far, n).astype(np.uint64) * np.uint64(1 << 16) + rnd.integers(0, 3, n).astype(np.uint64)
            doc, pos = rnd.integers(0, 9, n), rnd.integers(0, 99, n)
            assert (passages.stable_order(value) == np.argsort(value, kind="stable")).all()
            order = np.lexsort((pos, doc, value))
            for want, got in zip((value, doc, pos), passages.by_seed(value, doc, pos), strict=True):
                assert (want[order] == got).all()


def test_no_chain_that_makes_a_passage_is_hopeless():
    """Nor one of which a part does; and on one diagonal hopeless ones are told."""
    rnd = random.Random(12)
    told = good = 0
    for _ in range(600):
        n, off = rnd.randrange(8, 150), rnd.randrange(30)
        y = np.array([rnd.randrange(1000) for _ in range(n + off)])
        share = rnd.choice((0.1, 0.5, 0.7, 0.8, 0.9))
        x = np.array([v if rnd.random() < share else -1 for v in y[off:].tolist()])
        a = sorted(rnd.sample(range(n - passages.K + 1), min(rnd.randrange(1, 5), n - passages.K + 1)))
        for p in a:
            x[p : p + passages.K] = y[off + p : off + p + passages.K]
        b = [p + off for p in a]
        makes = False
        for i in range(len(a)):
            for j in range(i + 1, len(a) + 1):
                f = passages.align(a[i:j], b[i:j], x, y, 0, 0, 20, 0.8)
                short, longer = sorted((f[1] - f[0], f[3] - f[2]))
                makes |= short >= 20 and f[4] >= 0.8 * longer
        no = passages.hopeless(a, b, x, y, 0, 0, 20, 0.8)
        assert not (no and makes)
        told, good = told + no, good + makes
    assert told > 20 and good > 20


def test_minimizers_cover_every_window():
    rnd = np.random.default_rng(3)
    grams = rnd.integers(0, 50, 400).astype(np.uint64)
    first = np.array([0, 5, 5, 120, 400])
    at, row = passages.minimizers(grams, first, 12)
    for r in range(4):
        lo, hi = first[r], first[r + 1]
        own = at[row == r]
        for s in range(lo, max(hi - 12, lo) + 1):
            if hi > lo:
                assert any(s <= p < min(s + 12, hi) and grams[p] == grams[s : min(s + 12, hi)].min() for p in own)


@pytest.mark.parametrize("lone", [[], ["hello"], [""], [None], ["a b c d"], ["hi", "", None, "hi", "one two three"], ["the same old line again"] * 30])
def test_passages_of_nothing_and_of_short_texts(spark, monkeypatch, lone):
    """Slices without any seed, or with common ones alone, beside texts that share a passage and without."""
    monkeypatch.setattr(passages, "HOT_SAMPLE", 1)
    short = spark.createDataFrame(list(enumerate(lone)), DOC)
    assert passages.shared_passages(short).count() == 0
    p = prose(random.Random(1), 60)
    both = short.repartition(1).union(spark.createDataFrame([(100, p), (101, "x " + p)], DOC).repartition(1))
    assert [(r.doc_id, r.other_id) for r in passages.shared_passages(both).collect()] == [(101, 100)]


# --- 6: neighbours ---

VEC = "vec_id long, embedding array<float>"


def test_neighbours_recall_and_ties(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(3000, 24)).astype(np.float32)
    x[500:560] = x[20]  # many copies: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(9000, None), (9020, [0.0] * 24), (9040, [float("nan")] * 24), (9060, [1.0] * 5), (None, x[0].tolist()), (9080, [None] * 24), (3, x[3].tolist())]
    df = spark.createDataFrame(rows + bad, VEC).withColumn("score", F.lit(1))
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).toPandas()
    y = x.astype(float)
    hits, total = 0, 0
    for q, g in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21))
        assert np.allclose(g.score, y[g.vec_id] @ y[q], rtol=0, atol=1e-12)
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        hits, total = hits + len(set(want) & set(g.vec_id)), total + 20
    assert len(got) == 150 * 20 and hits / total >= 0.95
    assert sorted(got[got.query_id == 20].vec_id)[:20] == list(range(500, 520))


def test_neighbours_in_a_group_of_near_copies(spark):
    """A third of the rows are one vector with a little noise, far more than are ranked first."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, 24))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    x[::3] = x[0] + 0.01 * rnd.normal(size=(1000, 24))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    y = x.astype(float)
    for kept in (1.0, ann.KEPT):
        got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, kept=kept).toPandas()
        hits = 0
        for q, g in got.groupby("query_id"):
            s = y @ y[q]
            s[q] = -np.inf
            want = list(np.lexsort((np.arange(3000), -s))[:20])
            hits += len(set(want) & set(g.vec_id))
            assert kept < 1 or list(g.sort_values("rank").vec_id) == want
        assert len(got) == 150 * 20 and hits >= 0.99 * len(got)


def test_codes_leave_few_rows_to_rank():
    """Of 50,000 rows of a shard fewer than 5 % are ranked by exact products, and 99 % of neighbours found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50_000, 32)) + 2 * rng.normal(size=(40, 32))[rng.integers(0, 40, 50_000)]
    books = ann.fit(x[:4096], rounds=4)
    books.margin = ann.margin(x[:4096], books, 20)
    assert 0 < books.margin < 1
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 1000)
    best = ann.Best(len(asked), 20)
    codes = ann.packed(ann.assign(ann._parts(x), books, rounds=1))
    ranked = ann.scan_shard(ids, x, codes, asked, x[asked], ann.tables(x[asked], books), books, 20, best)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    found = sum(len(set(a) & set(b)) for a, b in zip(want, best.id, strict=True))
    assert ranked < 0.05 * len(x) * len(asked) and found >= 0.99 * want.size


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], VEC)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 5.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


# --- 7: shards ---


def test_shards_are_contiguous_and_even(spark):
    rnd = random.Random(4)
    docs = [(i, "é" * rnd.randrange(40)) for i in range(500)] + [(7, "same")] * 150 + [(600, None), (None, "n")]
    got = sharding.shard_documents(spark.createDataFrame(docs, DOC).withColumns({"shard": F.lit("x"), "size": F.lit(-1)}), 8).collect()
    assert len(got) == len(docs)
    total = sum(len((t or "").encode()) + 1 for _, t in docs)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    order = lambda r: -1 if r.doc_id is None else r.doc_id
    for s, rows in by.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 8) <= 81
        placed = sorted(rows, key=lambda r: r.slot)
        assert [order(r) for r in placed] == sorted(order(r) for r in placed)
        if s:
            assert max(map(order, by[s - 1])) <= min(map(order, rows))
    assert next(r for r in got if r.doc_id == 600).text_crc32 == 0


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOC), 8).count() == 0


def test_written_shards_hold_every_row_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "a", 4), (2, None, 5), (2, "", 6), (None, None, 7), (1, "a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Slot int").repartition(3)
    sharding.write_shards(docs, sharding.shard_documents(docs, 3), str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    assert sorted((r.shard, r.slot) for r in got) == sorted((r.shard, r.slot) for r in sharding.shard_documents(docs, 3).collect())


def test_written_shards_hold_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], DOC)
    sharding.write_shards(docs, sharding.shard_documents(docs, 4), str(tmp_path / "s"))
    assert {(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(i, f"text {i}") for i in range(40)}
