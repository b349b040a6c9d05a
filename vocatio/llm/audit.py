"""Operator 11: how filters interact, for every order in which they could be applied.

One aggregate counts, for each part of the table, the documents that fail all filters of a set at
once: for all 2 ** k sets, as sums of products of k flags. From these joint counts everything else
follows by inclusion and exclusion, on one row a part:

* a Moebius inversion over subsets gives the survivors of each set of filters, hence what each
  filter removes at each place of each order;
* one over supersets gives the documents that fail exactly one set, hence each filter's unique ones;
* the joint counts, signed, are the Harsanyi dividends of the game "documents removed by a set of
  filters"; sharing each dividend equally among its set gives the Shapley values.

Documents meet only where equal texts must: by digest, after all rows of one id and of one kind of a
text have been counted in the tasks, so a text that a third of all rows hold is no hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import helper, table

#: The production filters, in the order of their bits.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text without nulls, as flags 0 or 1."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": (n < 200).cast("int"),
        "B": (100 * F.size(F.array_distinct(words)) < 50 * n).cast("int"),
        "C": (100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)).cast("int"),
        "D": text.rlike(r"[#$%&*|]").cast("int"),
    }


def joint_failures(rows: DataFrame, part: str, flags: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """part and, for each weight column, an array of 2 ** k longs of the weight's name: at the place
    whose bits name a set of flags, the weight of the rows that fail them all. At place 0 stands the
    total. Null flags and weights count as 0."""
    told = {c: f"coalesce(cast(`{c}` as bigint), 0L)" for c in (*flags, *weights)}

    def product(weight: str, subset: int) -> str:
        return "sum(" + " * ".join([told[weight], *[told[f] for bit, f in enumerate(flags) if subset >> bit & 1]]) + ")"

    return rows.groupBy(part).agg(*[F.expr("array(" + ", ".join(product(w, s) for s in range(1 << len(flags))) + ")").alias(w) for w in weights])


def survivors(joint: str, k: int) -> Column:
    """At each place, the weight that fails no flag of the set: the joint counts of its subsets, with
    the sign of the subset's size."""
    return _inverted(joint, k, lambda s: {t: t for t in range(1 << k) if t & s == t})


def exactly(joint: str, k: int) -> Column:
    """At each place, the weight that fails all flags of the set and no other one: the joint counts
    of the sets that hold it, with the sign of what they have more."""
    return _inverted(joint, k, lambda s: {t: t ^ s for t in range(1 << k) if t & s == s})


def _inverted(joint: str, k: int, over: Callable[[int], dict[int, int]]) -> Column:
    """At each place s, the sum of the joint counts at over(s), each with the sign of its set's size."""
    sums = ["0L" + "".join(f" {'-' if by.bit_count() % 2 else '+'} `{joint}`[{t}]" for t, by in over(s).items()) for s in range(1 << k)]
    return F.expr("array(" + ", ".join(sums) + ")")


def shapley_over_orders(joint: str, k: int) -> Column:
    """For each flag, its Shapley value in the game "weight removed", times k!: what it removes, summed
    over all orders. The dividend of a set is its joint count, negative for even sizes."""
    sets = lambda bit: [s for s in range(1 << k) if s >> bit & 1]
    sums = ["0L" + "".join(f" {'+' if s.bit_count() % 2 else '-'} {factorial(k) // s.bit_count()} * `{joint}`[{s}]" for s in sets(bit)) for bit in range(k)]
    return F.expr("array(" + ", ".join(sums) + ")")


def audit(rows: DataFrame, part: str, flags: Sequence[str], count: str, lost: dict[str, str], names: str | None = None) -> DataFrame:
    """For each part, order of the flags and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, a column for each entry of ``lost`` (name of the column: weight column), shapley.

    ``count`` is the weight of a row. ``names`` has one letter a flag, A, B, C ... if not given. An
    empty table has no parts and gives no rows; a null part is a part of its own.
    """
    k = len(flags)
    names = names or "".join(chr(65 + i) for i in range(k))
    joint = joint_failures(rows, part, flags, list(dict.fromkeys([count, *lost.values()])))
    new: list[str] = []
    for _ in range(7 + len(lost)):
        new.append(helper(joint, *new))
    left, alone, share, order, step, bit, before, *left_of = new
    per = joint.withColumns({left: survivors(count, k), alone: exactly(count, k), share: shapley_over_orders(count, k)})
    per = per.withColumns({c: survivors(w, k) for c, w in zip(left_of, lost.values(), strict=True)})
    # k! orders of k steps, a constant, for each part
    orders = ",".join("".join(o) for o in permutations(names))
    out = per.withColumn(order, F.explode(F.split(F.lit(orders), ","))).withColumn(step, F.expr(f"explode(sequence(1, {k}))"))
    out = out.withColumns({bit: F.expr(f"instr('{names}', substr({order}, {step}, 1)) - 1"), before: F.expr(f"aggregate(sequence(1, {step}), 0, (m, i) -> m + if(i < {step}, shiftleft(1, instr('{names}', substr({order}, i, 1)) - 1), 0))")})
    single = F.expr(f"shiftleft(1, {bit})")
    here = lambda c: F.get(F.col(c), F.col(before)) - F.get(F.col(c), F.col(before) + single)
    columns = {
        "filter_order": F.col(order), "step": F.col(step), "kept": F.get(F.col(left), F.col(before) + single), "removed": here(left), "redundant": F.get(F.col(count), single) - here(left),
        "unique_fails": F.get(F.col(alone), single), **{name: here(c) for name, c in zip(lost, left_of, strict=True)}, "shapley": F.get(F.col(share), F.col(bit)),
    }
    return out.select(F.col(part).alias("part"), *[c.alias(n) for n, c in columns.items()])


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A, B, C, D, E (0 or 1), n, good, toxic: kinds of documents and how many each kind holds.

    A null text is empty, a null lang the empty string. E: some smaller doc_id holds the same text
    (by SHA-256), removed or not; rows of one doc_id don't fail by each other, and a null doc_id
    neither fails nor makes others fail. Repeated rows each count. A document is good, or toxic, if
    any label row of its doc_id says 1; without a label, or with a null one, it is neither.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    told = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("t"))
    flags = text_failures(F.col("t"))
    rows = told.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[c.alias(n) for n, c in flags.items()])
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    rows = rows.join(said, "doc_id", "left").withColumns({"q": F.coalesce("q", F.lit(0)), "x": F.coalesce("x", F.lit(0))})
    kind = ["digest", "part", "A", "B", "C", "D", "q", "x"]
    ids = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("times"))
    # a task has one row for each kind of a text, whatever number of documents holds it
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times")))
    kinds = ids.groupBy(*kind).agg(F.sum("times").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(0)).alias("unnamed"), first.alias("first"))
    # the kinds of one text: its parts times four labels
    least = kinds.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.collect_list(F.struct(*kind[1:], "n", "unnamed", "first")).alias("k"))
    one = least.select("least", F.explode("k").alias("k")).select("least", "k.*")
    own = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.times")).otherwise(0) + F.col("unnamed")
    both = one.withColumn("own", own).withColumn("e", F.explode(F.array(F.struct(F.lit(0).alias("E"), F.col("own").alias("m")), F.struct(F.lit(1).alias("E"), (F.col("n") - F.col("own")).alias("m")))))
    m = F.col("e.m")
    return both.select("part", "A", "B", "C", "D", "e.E", m.alias("n"), (m * F.col("q")).alias("good"), (m * F.col("x")).alias("toxic"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(kinds, "part", list(FILTERS), "n", {"good_lost": "good", "toxic_lost": "toxic"}, FILTERS)


#: Every order is applied document by document, filter after filter, by places of failed letters.
ORACLE_OP11 = r"""
WITH RECURSIVE t AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS x FROM documents d LEFT JOIN labels USING (doc_id)),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
f AS (SELECT part, q, x, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN least < doc_id THEN 'E' ELSE '' END) AS failed FROM w),
g AS (SELECT part, failed, count(*) AS n, sum(q) AS good, sum(x) AS bad FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE len(filter_order) = 5),
r AS (SELECT part, filter_order, step, n, good, bad, failed, contains(failed, filter_order[step]) AS fails, len(translate(failed, filter_order[:step - 1], '')) < len(failed) AS earlier FROM g, s),
a AS (SELECT part, filter_order, step, filter_order[step] AS letter, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant,
  coalesce(sum(n) FILTER (fails AND len(failed) = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT earlier), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM a
"""
