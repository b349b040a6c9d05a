import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocatio.llm import audit, infill

# --- 11: filter interactions ---

DOCS = "doc_id long, text string, lang string, c string, `__helper0` int, n int"


def failures_of(rows):
    """Letters that each row fails, rule by rule."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        out.append(failed + ("E" if i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == t for r in rows) else ""))
    return out


def audited(rows, labels):
    """Every order applied to every row, one filter after the other."""
    failed = failures_of(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, r[0]) for f, r in zip(failed, rows, strict=True) if (r[2] or "") == part]
        label = lambda i, k: any(a == i and i is not None and v[k] == 1 for a, *v in labels)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(letter in f for f, _ in own) - len(gone), sum(f == letter for f, _ in own), sum(label(i, 0) for _, i in gone), sum(label(i, 1) for _, i in gone)]
    for part, letter in {(p, o[s - 1]) for p, o, s in out}:
        places = [k for k in out if k[0] == part and k[1][k[2] - 1] == letter]
        total = sum(out[k][1] for k in places)
        for k in places:
            out[k] = [*out[k], total]
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_interactions_equal_every_order_applied(spark, seed):
    rnd = random.Random(seed)
    texts = [None, "", "a b c", "A a", "x # y", " ".join(f"w{i}" for i in range(250)), "same " * 220, "\t \n", "é " * 300, "AB" * 50 + " %", " ".join(f"W{i}" for i in range(210)) + " |", "中 " + " ".join(map(str, range(230)))]
    rows = [(rnd.choice([None, *range(30)]), rnd.choice(texts), rnd.choice(["en", "de", "", None]), "x", 1, 2) for _ in range(120)]
    rows += rows[:10]
    labels = [(rnd.choice([None, *range(30)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(25)]
    kinds = audit.document_failures(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audit.audit(kinds, "part", list(audit.FILTERS), "n", {"good_lost": "good", "toxic_lost": "toxic"}, audit.FILTERS).collect()
    want = audited(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_interactions_of_no_documents_and_of_other_flags(spark):
    none = audit.document_failures(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.audit(none, "part", list(audit.FILTERS), "n", {}).collect() == []
    rows = spark.createDataFrame([(None, 1, 0, 5), (None, None, 1, 2), ("p", 1, 1, 3)], "part string, x int, y int, n long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost, r.shapley) for r in audit.audit(rows, "part", ["x", "y"], "n", {"lost": "n"}).collect()}
    assert got[None, "AB", 1] == (2, 5, 0, 5, 5, 10) and got[None, "AB", 2] == (0, 2, 0, 2, 2, 4)
    assert got["p", "BA", 1] == (0, 3, 0, 0, 3, 3) and got["p", "BA", 2] == (0, 0, 3, 0, 0, 3)
    assert len(got) == 8


# --- 12: fill in the middle ---


def units_of(text, unit):
    if unit == "code_point":
        return list(text)
    if unit == "line":
        return text.splitlines(keepends=True) if text else []
    return re.findall(r"\A[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)


@pytest.mark.parametrize("unit", infill.UNITS)
@pytest.mark.parametrize("step,block", [(1, 3), (4, 7), (8, 1 << 20), (1024, 64)])
def test_checkpoints_cut_where_a_list_of_units_does(unit, step, block):
    rnd = random.Random(step)
    texts = ["".join(rnd.choice(["a", "é", "中", "😀", " ", "\n", "bc", "  "]) for _ in range(rnd.randrange(60))) for _ in range(40)] + ["", " ", "\n", "x"]
    rnd.shuffle(texts)
    raw = [t.encode() for t in texts]
    ends = np.append(0, np.cumsum([len(r) for r in raw]))
    index = infill.Checkpoints(np.frombuffer(b"".join(raw), np.uint8), ends, unit, step, block)
    assert len(index.row) <= sum(len(units_of(t, unit)) // step + 1 for t in texts)
    for i, t in enumerate(texts):
        units = units_of(t, unit)
        assert index.units[i] == len(units) and index.chars[i] == len(t)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(i, k) == (ends[i] + len(head.encode()), len(head))


def plain_infill(i, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:x], t[x:y], t[y:]
    return len(t), *(("spm", x, y - x, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else ("psm", x, y - x, f"<P>{p}<S>{s}<M>{m}"))


def test_infill_equals_slicing_and_is_restored(spark):
    rnd = random.Random(5)
    texts = [None, "", "a", "<P>", "x <M> y", "<<S", "<P", "P>", "é" * 50, "😀中" * 3000, "line\nline\n" * 2000, "S><", "<S<", "M><P"]
    rows = [(rnd.choice([None, *range(400)]), rnd.choice(texts) if rnd.random() < 0.7 else "".join(rnd.choice("<>PSM aé") for _ in range(rnd.randrange(30))), 7, "x") for _ in range(600)]
    rows += [(1000, "wörd " * 400_000, 1, "y")] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Infill int, `__helper0` string")
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "__helper0", "infill"]
    got = out.select("doc_id", "text", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars", "infill.output", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("back")).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_infill_by_words_and_lines_of_nothing_and_of_all(spark):
    docs = spark.createDataFrame([(i, f"one two\nthree {i}\nfour" * 3) for i in range(40)], "doc_id long, text string")
    for unit in ("word", "line"):
        rows = infill.fill_in_middle(docs, unit=unit, rates=infill.Rates(100, 50)).select("text", "infill.*", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("back")).collect()
        assert {r.form for r in rows} == {"psm", "spm"}
        for r in rows:
            units = units_of(r.text, unit)
            assert r.n == len(units) and r.back == r.text
            assert r.prefix_chars == len("".join(units[: r.prefix_units])) and r.middle_chars == len("".join(units[r.prefix_units : r.prefix_units + r.middle_units]))
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, unit="page")
