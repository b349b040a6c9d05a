"""Operator 12: fill-in-the-middle, with cuts found through a sparse index of checkpoints.

A text's units (code points, words or lines) are counted once, in blocks of bytes. Meanwhile every
STEP-th unit leaves a checkpoint: its byte and its code-point offset. To cut after so many units, the
last checkpoint at or before is found by binary search and the few bytes from there on are scanned
again. The index of a text of n units has n / STEP entries, so memory follows the text's own bytes,
whatever its length; texts are cut as the UTF-8 bytes that Arrow holds and never become lists of units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import helper, table
from .textbytes import buffers, slices

#: Units from one checkpoint to the next; bytes that counting takes at a time.
STEP, BLOCK = 1024, 1 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("code_point", "word", "line")

RESULT = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("prefix_units", "middle_units", "prefix_chars", "middle_chars")], T.StructField("output", T.StringType())]
)


def heads(data: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Which bytes begin a unit; ``before`` is the byte in front, -1 at the start of a text.

    A code point begins at every byte that continues none. A word is a run of other bytes than white
    space with the white space behind it, a line ends with its line feed; what stands in front of a
    text's first word belongs to it.
    """
    if unit == "code_point":
        return (data & 0xC0) != 0x80
    back = np.empty(len(data), np.int16)
    back[:1] = before
    back[1:] = data[:-1]
    if unit == "line":
        return (back == 10) | (back < 0)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return (~space & ((back == 32) | ((back >= 9) & (back <= 13)))) | (back < 0)


class Checkpoints:
    """The checkpoints of all texts of a slice, and ``units`` and ``chars`` of each text.

    For the unit "word", white space in front of a text's first word makes a unit of its own.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "code_point", step: int = STEP, block: int = BLOCK):
        self.data, self.offsets, self.unit = data, offsets, unit
        n = len(offsets) - 1
        self.units, self.chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        full = np.flatnonzero(np.diff(offsets))
        starts = offsets[:-1][full]  # of texts that aren't empty, ascending
        for at in range(0, len(data), block):
            part = data[at : at + block]
            here = heads(part, int(data[at - 1]) if at else -1, unit)
            first = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(part))] - at
            here[first] = True
            chars = np.cumsum((part & 0xC0) != 0x80)
            p = np.flatnonzero(here)
            rows = full[np.searchsorted(starts, p + at, side="right") - 1]
            begun = np.flatnonzero(np.diff(rows, prepend=-1))  # where a row's first unit of the block stands
            size = np.diff(np.append(begun, len(rows)))
            rank = np.arange(len(p)) - np.repeat(begun, size) + self.units[rows]
            # code points of the row before the unit: within the block, and in blocks before
            low = np.maximum(offsets[rows] - at, 0)
            char = chars[p] - 1 - np.where(low > 0, chars[low - 1], 0) + self.chars[rows]
            keep = rank % step == 0
            found.append((rows[keep], rank[keep], p[keep] + at, char[keep]))
            self.units += np.bincount(rows, minlength=n)
            edge = np.clip(offsets - at, 0, len(part))
            upto = np.append(0, chars)[edge]
            self.chars += np.diff(upto)
        self.row, self.rank, self.byte, self.char = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    def cut(self, row: int, units: int) -> tuple[int, int]:
        """Byte (in the slice) and code-point offset (in the text) at which so many units of the row end."""
        start, end = int(self.offsets[row]), int(self.offsets[row + 1])
        if units <= 0:
            return start, 0
        if units >= self.units[row]:
            return end, int(self.chars[row])
        lo, hi = int(self.first[row]), int(self.first[row + 1])
        i = lo + int(np.searchsorted(self.rank[lo:hi], units, side="right")) - 1
        byte, char, more = int(self.byte[i]), int(self.char[i]), units - int(self.rank[i])
        if not more:
            return byte, char
        # the unit wanted begins before the next checkpoint, or before the text's end
        part = self.data[byte : int(self.byte[i + 1]) if i + 1 < hi else end]
        place = int(np.flatnonzero(heads(part, int(self.data[byte - 1]) if byte > start else -1, self.unit)[1:])[more - 1]) + 1
        return byte + place, char + int(np.count_nonzero((part[:place] & 0xC0) != 0x80))


@dataclass(frozen=True)
class Rates:
    """Of a hundred texts, how many are transformed, and how many of these suffix first."""

    transformed: int = 90
    suffix_first: int = 20


def draws(key: str | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 that depend on the seed and the key alone; a null key is empty."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(keys: list, col: pa.Array, unit: str, seed: int, rates: Rates) -> pa.StructArray:
    """The fields of RESULT for each text of a batch."""
    data, offsets = buffers(col)
    out: dict[str, list] = {f.name: [] for f in RESULT.fields}
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for i, j in slices(offsets):
        part, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        index = Checkpoints(part, ends, unit)
        raw = part.tobytes()
        for r, key in enumerate(keys[i:j]):
            n, (a, b) = int(index.units[r]), (int(ends[r]), int(ends[r + 1]))
            text = raw[a:b]
            h1, h2, h3, h4 = draws(key, seed)
            out["n"].append(n)
            if not text or h3 % 100 >= rates.transformed or any(m in text for m in marks):
                row = ("plain", None, None, None, None, text)
            else:
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                (x, cx), (y, cy) = index.cut(r, first), index.cut(r, last)
                prefix, middle, suffix = raw[a:x], raw[x:y], raw[y:b]
                if h4 % 100 < rates.suffix_first:
                    row = ("spm", first, last - first, cx, cy - cx, b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle)))
                else:
                    row = ("psm", first, last - first, cx, cy - cx, b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle)))
            for name, value in zip(("form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"), row, strict=True):
                out[name].append(value)
    long, kinds = pa.int64(), {"form": pa.string(), "output": pa.large_string()}
    arrays = [pa.array(out["output"], pa.large_binary()).cast(pa.large_string()) if f.name == "output" else pa.array(out[f.name], kinds.get(f.name, long)) for f in RESULT.fields]
    return pa.StructArray.from_arrays(arrays, [f.name for f in RESULT.fields])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "code_point", seed: int = 1, rates: Rates = Rates(), result: str = "infill") -> DataFrame:  # noqa: B008
    """The rows with the struct ``result``: n (units), form, prefix_units, middle_units, prefix_chars,
    middle_chars (code points), output.

    Cuts, order and whether a row is transformed depend on the seed and the id alone; equal rows get
    equal outputs, a null id is an empty one. A null text is empty. Empty texts and those that hold a
    mark stay plain, with null lengths. Texts of any length are taken whole. An empty table gives an
    empty result; other columns stay as they are, but for one of the result's name, which is replaced.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    key, kept = helper(docs, result), [c for c in docs.columns if c.lower() != result.lower()]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(result, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = transformed(b.column(key).to_pylist(), b.column(text), unit, seed, rates)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], found], [*kept, result])

    return docs.select(*kept, F.col(id_col).cast("string").alias(key)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: no part of a transformed text holds a mark, so the first
    one found ends a part."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + F.lit(len(second) + 1), F.length(output))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + F.lit(len(MIDDLE) + 1), F.length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("infill")
    return rows.select("doc_id", r["n"].alias("n"), r["form"].alias("form"), r["prefix_chars"].alias("prefix_chars"), r["middle_chars"].alias("middle_chars"), F.sha2(r["output"], 256).alias("output_sha256"), F.sha2(restored(r["output"], r["form"]), 256).alias("restored_sha256"))


ORACLE_OP12 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, left(t, least(a, b)) AS prefix, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(t, greatest(a, b) + 1) AS suffix FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
