"""Operator 1: benchmark decontamination by suffix arrays over training shards.

A shard is a run of whole documents (about SLICE_BYTES of text; a longer document is a shard of
its own). Its suffix array sorts every word position by the words that follow. Every suffix of
every benchmark text is binary-searched in it: the place where the suffix would stand has its
longest verbatim match next to it, and the suffixes that begin with its first ``window`` words
form one interval, which gives all locations. Documents and shards are independent, so no text is
shuffled; the benchmark is what every executor needs in full, and goes out in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import helper, table
from .textbytes import Words, alnum_table, buffers, list_array, slices

#: Benchmark text that goes to the executors at once. A larger benchmark takes one pass a block.
BLOCK_BYTES = 32 << 20

#: Words ranked together at the start and doubled from there.
_FIRST = 2


@dataclass
class Probes:
    """The suffixes of a block of benchmark items, as word hashes."""

    ids: list  # item_id by item
    words: np.ndarray  # all items' word hashes, one after the other
    begin: np.ndarray  # each suffix's place in words
    length: np.ndarray  # words from there to the end of its item
    item: np.ndarray  # its item
    need: np.ndarray  # words that must match; 0 where the suffix starts no window


def probes_of(items: list[tuple], window: int) -> Probes:
    """Windows of ``window`` consecutive words; an item of fewer, but not none, is one window."""
    items = [x for x in items if x[1]]
    data, offsets = buffers(pa.array([x[1] for x in items], pa.string()))
    w = Words(data, offsets, alnum_table())
    item = w.row_of_word()
    begin = np.arange(len(w.start))
    length = w.first[1:][item] - begin
    own = np.diff(w.first)[item]
    need = np.where(length >= window, window, np.where((own < window) & (length == own), own, 0))
    return Probes([x[0] for x in items], w.hash, begin, length, item, need)


class SuffixArray:
    """The word positions of a shard, sorted by up to ``depth`` following words. No suffix reaches
    past its document: behind the end stands 0, which is no word's rank."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        n = len(words)
        self.words, self.depth = words, depth
        self.stop = np.repeat(first[1:], np.diff(first))  # the end of each word's document
        self.names, rank = np.unique(words, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        at = np.arange(n)
        follow = np.zeros(n, np.int64)
        follow[:-1] = rank[1:]
        follow[at + 1 >= self.stop] = 0
        key = rank * (len(self.names) + 1) + follow
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        group = np.zeros(n, np.int64)  # number of the group of equal prefixes, by sorted place
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=group[1:])
        k = _FIRST
        while k < depth and n:
            # only members of groups of several are sorted again, by the rank k words on
            place = np.empty(n, np.int64)
            place[order] = group + 1
            same = np.zeros(n, bool)
            same[1:] = group[1:] == group[:-1]
            same[:-1] |= same[1:]
            open_ = np.flatnonzero(same)
            if not len(open_):
                break
            there = order[open_] + k
            ahead = np.where(there < self.stop[order[open_]], place[np.minimum(there, n - 1)], 0)
            again = np.lexsort((ahead, group[open_]))
            order[open_] = order[open_][again]
            ahead = ahead[again]
            new = np.zeros(n, bool)
            new[1:] = group[1:] != group[:-1]
            inner = np.zeros(len(open_), bool)
            inner[1:] = (ahead[1:] != ahead[:-1]) & (np.diff(open_) == 1)
            new[open_] |= inner
            np.cumsum(new, out=group)
            k *= 2
        self.order = order

    def below(self, probe: np.ndarray, begin: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
        """By binary search, how many suffixes stand before each probe (with right: or start with it)."""
        lo = np.zeros(len(begin), np.int64)
        hi = np.full(len(begin), len(self.order), np.int64)
        most = int(length.max(initial=0))
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) >> 1
            pos = self.order[mid]
            less = np.zeros(len(live), bool)  # the suffix stands before the probe
            open_ = np.arange(len(live))
            for d in range(most):
                more = length[live[open_]] > d
                if right:
                    less[open_[~more]] = True  # all of the probe's words agree
                open_ = open_[more]
                if not len(open_):
                    break
                here = pos[open_] + d
                ended = here >= self.stop[pos[open_]]
                a = self.words[np.minimum(here, len(self.words) - 1)]
                b = probe[begin[live[open_]] + d]
                less[open_[ended | (a < b)]] = True
                open_ = open_[~ended & (a == b)]
            if right:
                less[open_] = True
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
        return lo

    def common(self, pos: np.ndarray, probe: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words that the suffixes at pos and the probes have in common from their starts."""
        n = np.zeros(len(pos), np.int64)
        open_ = np.arange(len(pos))
        while len(open_):
            here = pos[open_] + n[open_]
            ok = (n[open_] < length[open_]) & (here < self.stop[pos[open_]])
            open_, here = open_[ok], here[ok]
            open_ = open_[self.words[here] == probe[begin[open_] + n[open_]]]
            n[open_] += 1
        return n


def search(words: Words, probes: Probes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of windows in the shard: word position, words matched verbatim from there
    (to the item's end at most), suffix; and, by suffix, its longest match in the shard."""
    none = np.zeros(0, np.int64)
    longest = np.zeros(len(probes.begin), np.int64)
    if not len(words.hash) or not len(probes.begin):
        return none, none, none, longest
    sa = SuffixArray(words.hash, words.first, max(window, _FIRST))
    # a suffix whose first word the shard lacks has no match at all
    known = np.searchsorted(sa.names, probes.words)
    known = sa.names[np.minimum(known, len(sa.names) - 1)] == probes.words
    here = np.flatnonzero(known[probes.begin])
    if not len(here):
        return none, none, none, longest
    begin, length = probes.begin[here], probes.length[here]
    # the array is sorted to a depth of 2, 4, 8 ... words; as many decide the binary search
    depth = _FIRST
    while depth < window:
        depth *= 2
    reach = np.minimum(length, depth)
    lo = sa.below(probes.words, begin, reach, right=False)
    for at in (np.minimum(lo, len(sa.order) - 1), np.maximum(lo - 1, 0)):
        longest[here] = np.maximum(longest[here], sa.common(sa.order[at], probes.words, begin, length))
    need = probes.need[here]
    starts = here[(need > 0) & (longest[here] >= need)]
    if not len(starts):
        return none, none, none, longest
    begin, need = probes.begin[starts], probes.need[starts]
    lo = sa.below(probes.words, begin, need, right=False)
    hi = sa.below(probes.words, begin, need, right=True)
    count = hi - lo
    suffix = np.repeat(starts, count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pos = sa.order[np.repeat(lo, count) + nth]
    matched = sa.common(pos, probes.words, probes.begin[suffix], probes.length[suffix])
    return pos, matched, suffix, longest


RESULT = "struct<n_words:bigint,n_hit:bigint,longest:bigint,hits:array<struct<start:bigint,words:bigint>>,items:array<string>>"
_HIT = pa.struct([("start", pa.int64()), ("words", pa.int64())])


def _merged(start: np.ndarray, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch, within each row."""
    if not len(start):
        return start, words, row
    order = np.lexsort((start, row))
    start, end, row = start[order], (start + words)[order], row[order]
    # rows come one after the other in the shard, so the running maximum never joins two rows' spans
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1
    return start[head], reach[last] - start[head], row[head]


def scan(col: pa.Array, probes: Probes, window: int) -> pa.Array:
    """For each text: its words, those hit, its longest match, hit spans (in words), item_ids."""
    data, offsets = buffers(col)
    parts = []
    for i, j in slices(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], alnum_table())
        n = np.diff(w.first)
        pos, matched, suffix, _ = search(w, probes, window)
        row = np.searchsorted(w.first, pos, side="right") - 1
        longest = np.zeros(j - i, np.int64)
        np.maximum.at(longest, row, matched)
        # a window covers its own words; longer matches are windows one after the other
        start, words, at = _merged(pos, probes.need[suffix], row)
        hit = np.bincount(at, weights=words, minlength=j - i).astype(np.int64)
        pairs = np.unique(np.stack([row, probes.item[suffix]]), axis=1)
        hits = list_array(pa.StructArray.from_arrays([pa.array(start - w.first[at], pa.int64()), pa.array(words, pa.int64())], fields=list(_HIT)), np.bincount(at, minlength=j - i))
        items = list_array(pa.array(probes.ids, pa.string()).take(pa.array(pairs[1], pa.int64())), np.bincount(pairs[0], minlength=j - i))
        parts.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hit), pa.array(longest), hits, items], ["n_words", "n_hit", "longest", "hits", "items"]))
    return pa.concat_arrays(parts)


def scanner(spark: SparkSession, items: list[tuple], window: int):
    """A column function: text to RESULT."""
    sent = spark.sparkContext.broadcast(probes_of(items, window))

    @F.arrow_udf(RESULT)
    def contamination(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            yield scan(col, sent.value, window) if len(col) else pa.array([], _result_type())

    return contamination.asNondeterministic()  # else the optimizer may run it once for each use


def _result_type() -> pa.DataType:
    return pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("hits", pa.list_(_HIT)), ("items", pa.list_(pa.string()))])


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark's distinct items in lists of at most BLOCK_BYTES of text (or one longer item)."""
    held, size = [], 0
    some = False
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        if held and size + len(text.encode()) > BLOCK_BYTES:
            yield held
            held, size = [], 0
            some = True
        held.append((item, text))
        size += len(text.encode())
    if held or not some:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", result: str = "contamination") -> DataFrame:
    """The documents with the struct column ``result``: n_words, n_hit (words inside an occurrence
    of a window), longest (words of the longest verbatim match of at least a window), hits (spans
    in words, joined where they overlap or touch), items (sorted distinct item_ids as strings with
    an occurring window), contaminated.

    Null and wordless texts have no words and no hits; so have null items and items without words.
    Repeated documents get a row each; repeated items count once. An empty benchmark hits nothing.
    A column of the name of ``result`` is replaced; all other columns stay as they are.
    """
    passes = []
    out = docs
    for items in blocks(benchmark, item_col, item_text):
        name = helper(out, result)
        out = out.withColumn(name, scanner(docs.sparkSession, items, window)(F.col(text_col)))
        passes.append(F.col(name))
    if len(passes) == 1:
        n_hit, longest, hits = passes[0]["n_hit"], passes[0]["longest"], passes[0]["hits"]
    else:
        hits = _joined([p["hits"] for p in passes])
        n_hit = F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
        longest = F.greatest(*[p["longest"] for p in passes])
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in passes]))))
    whole = F.struct(passes[0]["n_words"].alias("n_words"), n_hit.alias("n_hit"), longest.alias("longest"), hits.alias("hits"), items.alias("items"), (n_hit > 0).alias("contaminated"))
    return out.withColumn(result, whole).select(*[c for c in docs.columns if c != result], result)


def _joined(hits: list[Column]) -> Column:
    """Spans of several passes joined where they overlap or touch."""
    empty = F.expr("cast(array() as array<struct<start:bigint,words:bigint>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["start"] + last["words"], x["start"] + x["words"])
        wider = F.struct(last["start"].alias("start"), (end - last["start"]).alias("words"))
        apart = (F.size(acc) == 0) | (x["start"] > F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["words"])
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider)))

    return F.aggregate(F.array_sort(F.flatten(F.array(*hits))), empty, add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a word inside an occurrence of a benchmark window."""
    hit = helper(docs)
    return find_contamination(docs, benchmark, window, result=hit).where(~F.col(hit)["contaminated"]).drop(hit)


def op1_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        "contamination.contaminated",
    )


#: Words and windows in SQL. A window is a list of words; a document's words and its windows of
#: each length that items need are joined by value.
ORACLE_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hits AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
nh AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS o FROM hits) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
