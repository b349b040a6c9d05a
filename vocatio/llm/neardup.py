"""Operator 3: near-duplicate groups by MinHash.

1. Each text becomes its set of word shingles, a fingerprint of the whole set and BANDS x ROWS
   minima under universal hash functions, of which two bytes each are kept; only these leave the scan.
2. Documents of the same set form a class, represented by its smallest id; copies go no further.
3. Representatives that share a band's minima meet in a bucket. Each is paired with the bucket's
   smallest id, its hub: one pair a member, however large the bucket.
4. A pair whose signatures agree enough is confirmed on the full sets: each set is built once and
   sent to its hubs, where members stream past the hub's set. A hub of many has several such places.
5. Confirmed links give components, by alternating large-star and small-star.
6. Documents that buckets join, by whatever chain, form a coarse group; every link lies inside one.
   Where a coarse group still has several components, all members outside its largest component
   are compared on full sets with the members of other components, in blocks inside the tasks;
   a block gives only as many links as join its components. No pair of the two kinds stays
   untried, so one such round is enough.

Every step is written before the next begins, and what no later step reads is deleted.

A link of similarity s is missed only if no band agrees, (1 - s**ROWS)**BANDS: below 1e-6 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .storage import Steps, table
from .textbytes import Words, buffers, gram_hash, list_array, mix, random_words, slices, spaced_table

BANDS, ROWS = 24, 5

#: Agreeing minima, of BANDS * ROWS, below which a pair isn't confirmed on full sets. A link of
#: 0.85 has 102 of 120 on average with a deviation of 3.9; fewer than 74 are 7 deviations away.
LEAST_AGREEING = 0.62

#: Shingles of the members that a task compares with as many others at a time; a member counts as
#: ROW_SHINGLES more, so that a block has a bounded number of members as well.
BLOCK_SHINGLES, ROW_SHINGLES = 500_000, 200

#: Members of a bucket's hub that one task compares with it; a larger hub's set goes to several tasks.
HUB_MEMBERS = 2_000

#: Edges that a task takes in a round of the components: few edges make few tasks and small files.
#: Edges of one task go through all rounds there.
EDGES_A_TASK = 100_000

SKETCH = "struct<n:bigint,fp1:bigint,fp2:bigint,low:binary,high:binary>"


def shingle_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows, one after the other, and their offsets. A text of fewer words, but
    not none, has its whole sequence as its only shingle."""
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(first[-1]) - first[row] + w.first[row]
    out = np.zeros(len(at), np.uint64)
    long = n[row] >= k
    grams = gram_hash(w.hash, k)
    out[long] = grams[at[long]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        words = w.hash[w.first[i] : w.first[i + 1]]
        out[first[i]] = mix(gram_hash(words, len(words)) + np.uint64(len(words)))[0]
    return out, first


def distinct_sets(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles sorted and once each."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingles, row))
    s, r = shingles[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    count = np.bincount(r[new], minlength=len(first) - 1)
    out = np.zeros(len(first), np.int64)
    np.cumsum(count, out=out[1:])
    return s[new], out


def _reduced(f: np.ufunc, x: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    out = np.full(len(first) - 1, empty, x.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = f.reduceat(x, first[some])
    return out


def minima(sets: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """Sixteen bits of the minimum of (a x + b) mod 2**64 over each row's set, for ``count``
    universal hash functions: rows by functions. Rows without shingles have zeros."""
    a, b = random_words(count, 3) | np.uint64(1), random_words(count, 5)
    out = np.zeros((len(first) - 1, count), np.uint16)
    buf = np.empty(len(sets), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        at = first[some]
        for i in range(count):
            np.multiply(sets, a[i], out=buf)
            buf += b[i]
            out[some, i] = mix(np.minimum.reduceat(buf, at)) & np.uint64(0xFFFF)
    return out


def sets_of(col: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = buffers(col)
    for i, j in slices(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], spaced_table())
        yield distinct_sets(*shingle_hashes(w, k))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _fixed(x: np.ndarray) -> pa.Array:
    """A binary column of rows of bytes."""
    n, width = x.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes() if n else np.zeros(1, np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def sketcher(k: int):
    @F.arrow_udf(SKETCH)
    def sketch(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            parts = []
            for sets, first in sets_of(col, k):
                n = np.diff(first)
                sig = minima(sets, first, BANDS * ROWS)
                fp1 = _reduced(np.add, mix(sets), first, 0)
                fp2 = _reduced(np.bitwise_xor, mix(sets + np.uint64(77)), first, 0)
                low, high = (_fixed((sig >> np.uint16(s)).astype(np.uint8)) for s in (0, 8))
                parts.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), _signed(fp1), _signed(fp2), low, high], ["n", "fp1", "fp2", "low", "high"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]))

    return sketch.asNondeterministic()


def set_builder(k: int):
    @F.arrow_udf("array<bigint>")
    def shingle_set(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            parts = [list_array(_signed(s), np.diff(first)) for s, first in sets_of(col, k)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return shingle_set.asNondeterministic()


@F.arrow_udf(IntegerType())
def agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Minima that two signatures have in common, by a byte of each: never fewer than truly agree."""
    if not len(a):
        return pa.array([], pa.int32())
    x, y = (buffers(c)[0].reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).sum(axis=1), pa.int32())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alternating large-star and small-star on edges u > v, until nothing changes: node, least."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    k = len(names)
    pairs = np.unique(at[: len(u)] * k + at[len(u) :])
    while True:
        a, b = pairs // k, pairs % k
        least = np.arange(k)
        np.minimum.at(least, a, b)
        # large-star: every larger neighbour of b to the least of b's neighbourhood
        a, b = np.divmod(np.unique(a * k + least[b]), k)
        least = np.arange(k)
        np.minimum.at(least, a, b)
        # small-star: a and its smaller neighbours to the least of them
        a, b = np.concatenate([a, b]), least[np.concatenate([a, a])]
        after = np.unique(a[a != b] * k + b[a != b])
        if len(after) == len(pairs) and (after == pairs).all():
            return names[pairs // k], names[pairs % k]
        pairs = after


def _in_one_task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = [b for b in it if b.num_rows]
    if t:
        u, v = stars(*(np.concatenate([b.column(c).to_numpy() for b in t]) for c in ("u", "v")))
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def components(steps: Steps, edges: DataFrame) -> DataFrame:
    """The smallest id reachable, by alternating large-star and small-star: node, component.

    ``edges``: u, v, in any direction; nodes without edges aren't in the result. A star is formed
    by joining edges with the least neighbour of their node, never by gathering a node's
    neighbours, so a hub of any degree spreads over tasks. Tasks follow the number of edges; the
    edges of a single task, EDGES_A_TASK at most, need no exchange.
    """

    def state(e: DataFrame) -> Row:
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = steps.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, before = state(e), None
    if now.n <= EDGES_A_TASK:
        after = steps.write(e.coalesce(1).mapInArrow(_in_one_task, "u bigint, v bigint"))
        steps.drop(e)
        e, before = after, now
    while now != before:
        few = lambda df, n=-(-now.n // EDGES_A_TASK): df.coalesce(n)
        # large-star: every larger neighbour of u to the least of u's neighbourhood
        both = few(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        # a u that is less than all its neighbours leaves its edges as they are: so do most hubs
        low = steps.write(few(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")))  # read anew, so that a crowded u can be split
        moved = both.where("v > u").join(few(low), "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        large = steps.write(few(moved.distinct()))
        # small-star: u and its smaller neighbours to the least of them
        joined = few(large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = steps.write(few(small))
        steps.drop(e, low, large)
        e, before, now = after, now, state(after)
        steps.release()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _meeting(num: int, den: int):
    """Links (u, v = hub) of rows (hub, part, member, id, set), sorted by hub, part and member: the
    hub's own sets come first, members stream past them."""

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in it:
            if not batch.num_rows:
                continue
            hub, part, member, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "part", "member", "id"))
            sets = batch.column("set")
            first = sets.offsets.to_numpy().astype(np.int64)
            value = sets.values.to_numpy()
            heads = np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (part[1:] != part[:-1])))
            u, v = [], []
            for i, j in zip(heads, [*heads[1:], batch.num_rows], strict=True):
                if key != (hub[i], part[i]):
                    key, own = (hub[i], part[i]), []
                m = i + int(np.searchsorted(member[i:j], True))
                own += [value[first[r] : first[r + 1]].copy() for r in range(i, m)]
                if m == j:
                    continue
                flat, starts = value[first[m] : first[j]], first[m:j] - first[m]
                size = np.diff(first[m : j + 1])
                linked = np.zeros(j - m, bool)
                for s in own:
                    if not len(s) or not len(flat):
                        continue
                    hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
                    total = np.append(0, np.cumsum(hit))
                    common = total[starts + size] - total[starts]
                    linked |= (common > 0) & (den * common >= num * (size + len(s) - common))
                u.append(ids[m:j][linked])
                v.append(hub[m:j][linked])
            if u:
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})

    return links


def _confirmed(steps: Steps, pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v = hub) whose full sets have den * intersection >= num * union. Only the sets
    of documents in a pair are built, each once, though it may go to several hubs: at most BANDS."""
    crowded = pairs.groupBy("v").agg(F.count("*").alias("size")).where(F.col("size") > HUB_MEMBERS)
    crowded = steps.write(crowded.select(F.col("v").alias("hub"), F.expr(f"(size + {HUB_MEMBERS - 1}) div {HUB_MEMBERS}").alias("parts")))
    ends = pairs.select(F.col("u").alias("id"), "v").union(pairs.select(F.col("v").alias("id"), "v"))
    asked = ends.groupBy("id").agg(F.collect_set("v").alias("hubs"))
    # by shuffle at every size: what is asked grows with the documents
    sets = texts.join(asked.hint("merge"), "id").select("id", "hubs", set_builder(k)("text").alias("set"))
    sent = sets.select("id", "set", F.explode("hubs").alias("hub")).join(crowded, "hub", "left")
    member, parts = F.col("id") != F.col("hub"), F.coalesce("parts", F.lit(1))
    part = F.when(member, F.array(F.pmod(F.xxhash64("id"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))
    placed = sent.select("hub", F.explode(part).alias("part"), member.alias("member"), "id", "set")
    return placed.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInArrow(_meeting(num, den), "u bigint, v bigint")


def overlaps(a: np.ndarray, a_row: np.ndarray, n: int, b: np.ndarray, b_row: np.ndarray, m: int) -> np.ndarray:
    """Intersection sizes of n sets with m sets. Shingles that few members have are counted pair by
    pair, the others by products of 0-1 matrices, some columns at a time."""
    out = np.zeros((n, m), np.float32)
    names = np.intersect1d(a, b)
    if not len(names):
        return out

    def known(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        ok = names[at] == x
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], row[ok][order], np.bincount(at[ok], minlength=len(names))

    at_a, row_a, count_a = known(a, a_row)
    at_b, row_b, count_b = known(b, b_row)
    first_b = np.cumsum(count_b) - count_b
    rare = count_a * count_b <= 64
    i = np.flatnonzero(rare[at_a])
    times = count_b[at_a[i]]
    left = np.repeat(row_a[i], times)
    right = row_b[np.repeat(first_b[at_a[i]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    out += np.bincount(left * m + right, minlength=n * m).reshape(n, m)
    common = np.flatnonzero(~rare)
    column = np.full(len(names), -1)
    for c in range(0, len(common), 1024):
        cols = common[c : c + 1024]
        column[:] = -1
        column[cols] = np.arange(len(cols))
        x, y = np.zeros((n, len(cols)), np.float32), np.zeros((m, len(cols)), np.float32)
        ka, kb = column[at_a], column[at_b]
        x[row_a[ka >= 0], ka[ka >= 0]] = 1
        y[row_b[kb >= 0], kb[kb >= 0]] = 1
        out += x @ y.T
    return out


def _joining(num: int, den: int):
    """Links between members of different components, as few as join the same members. Rows come
    sorted by group, in it the left block before the right one."""

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        comp, right = (t.column(c).to_numpy() for c in ("component", "right"))
        sets = t.column("set").combine_chunks()
        size = pc.list_value_length(sets).to_numpy()
        value, row = sets.flatten().to_numpy(), np.repeat(np.arange(len(comp)), size)
        n = int((~right.astype(bool)).sum())
        if not n or n == len(comp):
            return
        of_left = row < n
        both = overlaps(value[of_left], row[of_left], n, value[~of_left], row[~of_left] - n, len(comp) - n)
        linked = (den * both >= num * (size[:n, None] + size[None, n:] - both)) & (comp[:n, None] != comp[None, n:])
        # a forest of the links: whole components are reached at once
        names, group = np.unique(comp, return_inverse=True)
        reached = np.zeros(len(names), bool)
        u, v = [], []
        for seed in range(n):
            if reached[group[seed]]:
                continue
            reached[group[seed]] = True
            todo = [group[seed]]
            while todo:
                g = todo.pop()
                for i in np.flatnonzero(group[:n] == g):
                    for j in np.flatnonzero(linked[i] & ~reached[group[n:]]):
                        if not reached[group[n + j]]:
                            reached[group[n + j]] = True
                            todo.append(group[n + j])
                            u.append(comp[i])
                            v.append(comp[n + j])
                for j in np.flatnonzero(group[n:] == g):
                    for i in np.flatnonzero(linked[:, j] & ~reached[group[:n]]):
                        if not reached[group[i]]:
                            reached[group[i]] = True
                            todo.append(group[i])
                            u.append(comp[i])
                            v.append(comp[n + j])
        if u:
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in it:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("coarse", "lb", "rb")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = tuple(keys[:, i])
                if held and key != last:
                    yield from links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
                last = key
        if held:
            yield from links(pa.Table.from_batches(held))

    return join


def _across(steps: Steps, star: DataFrame, comp: DataFrame, reps: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """Links (u, v) between components of one coarse group, by the components' names, enough to
    join what links join; None where no coarse group has several components."""
    fine = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    named = star.join(fine("u"), "u", "left").join(fine("v"), "v", "left")
    cu, cv = F.coalesce("u_c", "u"), F.coalesce("v_c", "v")
    between = steps.write(named.select(cu.alias("u"), cv.alias("v")).where("u <> v").distinct())
    if between.isEmpty():
        return None
    coarse = components(steps, between).select(F.col("node").alias("component"), F.col("component").alias("coarse"))
    # members: of larger components, and documents that are components of their own
    everyone = star.select(F.col("u").alias("id")).union(star.select(F.col("v").alias("id"))).union(comp.select(F.col("node").alias("id"))).distinct()
    owned = everyone.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    # sets too small to be linked with another one than their like are left out: a set of n is at
    # most n of n + 1 like another
    sized = reps.groupBy("id").agg(F.max("n").alias("n")).where(f"{den} * n >= {num} * (n + 1)")
    labelled = steps.write(owned.join(coarse, "component").join(sized, "id").select("coarse", "id", (F.col("n") + ROW_SHINGLES).alias("w"), "component"))
    per = labelled.groupBy("coarse", "component").agg(F.sum("w").alias("w"))
    torn = per.groupBy("coarse").agg(F.count("*").alias("parts"), F.sum("w").alias("all"), F.max(F.struct("w", F.col("component").alias("main"))).alias("top")).where("parts > 1")
    torn = torn.select("coarse", "top.main", F.expr(f"(all - top.w + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}").alias("lefts"), F.expr(f"(all + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}").alias("rights"))
    torn = steps.write(torn)  # read anew, so that a crowded group can be split
    rows = steps.write(labelled.join(torn, "coarse"))
    steps.drop(labelled, torn, between)
    sets = steps.write(texts.join(rows.select("id").distinct().hint("merge"), "id", "left_semi").select("id", set_builder(k)("text").alias("set")))
    steps.release()
    block = lambda n: F.expr(f"pmod(xxhash64(id), {n})")
    left = rows.where("component <> main").withColumn("lb", block("lefts")).withColumn("rb", F.explode(F.expr("sequence(0L, rights - 1)"))).withColumn("right", F.lit(False))
    right = rows.withColumn("rb", block("rights")).withColumn("lb", F.explode(F.expr("sequence(0L, lefts - 1)"))).withColumn("right", F.lit(True))
    cols = ["coarse", "lb", "rb", "right", "id", "component"]
    sides = left.select(*cols).union(right.select(*cols)).join(sets, "id")
    keyed = sides.repartition("coarse", "lb", "rb").sortWithinPartitions("coarse", "lb", "rb", "right")
    links = steps.write(keyed.mapInArrow(_joining(num, den), "u bigint, v bigint").distinct())
    steps.drop(rows, sets)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked when den * intersection >= num * union of their sets of distinct k-word
    shingles; component_id is the smallest doc_id reachable. Null texts and texts without words
    have an empty set and are linked with nothing. Rows that repeat a doc_id are one node: each gets
    its row, with the size of its own set, and all of them the node's component; so what is linked
    with one of their texts is in the component of all. A null doc_id links nothing; its component is
    null and it is kept. Ids must be integers. An empty table gives an empty result. Other columns of
    the input, whatever their names, aren't returned.
    """
    steps = Steps(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = steps.write(texts.select("id", sketcher(k)("text").alias("s")).select("id", "s.*"))

    # classes of equal sets, by a fingerprint of 128 bits and the size
    key = ["n", "fp1", "fp2"]
    known = sketches.where("n > 0 and id is not null")
    reps = steps.write(known.groupBy(*key).agg(F.min(F.struct("id", "low", "high")).alias("r")).select(*key, "r.*"))
    steps.release()

    part = lambda c, b: F.substring(c, b * ROWS + 1, ROWS)
    bands = F.array(*[F.xxhash64(F.lit(b), part("low", b), part("high", b)) for b in range(BANDS)])
    members = reps.select("id", F.explode(bands).alias("hash"))
    buckets = steps.write(members.groupBy("hash").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("hash", "hub"))
    star = steps.write(members.join(buckets, "hash").where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct())
    steps.drop(buckets)
    steps.release()

    least = int(LEAST_AGREEING * BANDS * ROWS)
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("low").alias(f"{c}_low"))
    alike = star.join(side("u"), "u").join(side("v"), "v").where(f"{den} * least(u_n, v_n) >= {num} * greatest(u_n, v_n)").where(agreeing("u_low", "v_low") >= least)
    alike = steps.write(alike.select("u", "v").distinct())
    steps.release()
    links = steps.write(_confirmed(steps, alike, texts, k, num, den).distinct())
    steps.drop(alike)
    steps.release()

    # an id of several texts is one node: their classes are linked
    several = steps.write(sketches.where("id is not null").groupBy("id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).where("a <> b").select("id"))
    repeated = not several.isEmpty()
    all_links = links
    if repeated:
        own = steps.write(sketches.join(several, "id").select("id", *key).distinct().join(reps.select(*key, F.col("id").alias("rep")), key).select("id", "rep"))
        all_links = links.union(own.join(own.groupBy("id").agg(F.min("rep").alias("first")), "id").select("rep", "first"))
    comp = components(steps, all_links)
    more = _across(steps, star, comp, reps, texts, k, num, den)
    if more is not None:
        new = components(steps, more)
        new = new.select(F.col("node").alias("old"), F.col("component").alias("new"))
        moved = comp.join(new, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        alone = new.join(comp, F.col("old") == F.col("node"), "left_anti").select("old", "new")
        comp = moved.union(alone)
    named = reps.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select(*key, F.coalesce("component", "id").alias("component"))
    named = steps.write(named)
    out = sketches.select("id", *key).join(named, key, "left")
    cid = F.coalesce("component", "id")
    if repeated:
        lead = own.join(reps.select(*key, F.col("id").alias("rep")), "rep").join(named, key).groupBy("id").agg(F.min("component").alias("lead"))
        out = out.join(steps.write(lead), "id", "left")
        cid = F.coalesce("lead", "component", "id")
    steps.drop(reps, star, links)
    steps.release()
    cid = F.when(F.col("id").isNotNull(), cid)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), cid.alias("component_id"), cid.eqNullSafe(F.col("id")).alias("kept"))


def op3_minhash_star_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=85)
