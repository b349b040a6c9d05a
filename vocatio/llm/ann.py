"""Operator 6: nearest neighbours by inner product, through score-aware quantisation.

Each vector is coded by one of 16 centroids in every pair of dimensions. Centroids and codes
minimise an anisotropic loss, in which the part of the residual that is parallel to the vector
weighs more than the rest, since it is what changes large inner products. The codebooks are fitted
on a bounded sample; every vector is coded. A scan adds up table entries, a byte (two codes) at a
time, for a block of queries; exact products rank again the rows whose sum is so near that their
quantisation error could make them one of the best. By how much a true neighbour's sum falls short,
against the longest it could (Cauchy-Schwarz), is measured on the sample that the codebooks are
fitted on: a share of KEPT of true neighbours lies within, and so is found. A share of 1 takes the
longest itself, and the neighbours are exact.

Queries go out in blocks of bounded size, every block meets all vectors, and only the k best of
each query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import table, written

#: Vectors that the codebooks are fitted on, at most: those with the smallest hash of the id.
FIT_ROWS = 8_192

#: Queries that go to the executors at once.
QUERY_BLOCK = 4_096

#: Candidates of a shard whose exact products say how good the others must be, for each neighbour asked for.
RERANK = 4

#: The share of true neighbours whose error is to lie within the margin, and rows of the sample that
#: are searched for among the others to measure it, at most.
KEPT, MARGIN_QUERIES = 0.999, 512

#: Rows of a shard: scanned together.
SHARD_ROWS = 8_192

#: Inner products, as a share of the largest possible, from which on errors matter.
THRESHOLD = 0.2

CENTROIDS = 16


@dataclass
class Codebooks:
    """Pairs of dimensions by centroids by 2; the weight of parallel errors; and how far a neighbour's
    sum may fall short of its product, as a share of the residual's length times the query's."""

    centres: np.ndarray
    eta: float
    margin: float = 1.0


def _parts(x: np.ndarray) -> np.ndarray:
    """Vectors as pairs of dimensions, an even number of pairs: zeros fill up."""
    d = -(-x.shape[1] // 4) * 4
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), d // 2, 2)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=(1, 2), keepdims=True))


def assign(x: np.ndarray, books: Codebooks, codes: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + (eta - 1) (r . u)^2, one pair of dimensions at a time."""
    u, c = _units(x), books.centres
    m = x.shape[1]
    if codes is None:
        codes = np.stack([((x[:, s, None] - c[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(m)], axis=1)
    else:
        codes = codes.copy()
    along = np.zeros(len(x))
    for s in range(m):
        along += ((x[:, s] - c[s][codes[:, s]]) * u[:, s]).sum(axis=1)
    for _ in range(rounds):
        for s in range(m):
            r = x[:, s, None] - c[s][None]
            own = (r * u[:, s, None]).sum(axis=2)
            rest = along - own[np.arange(len(x)), codes[:, s]]
            loss = (r**2).sum(axis=2) + (books.eta - 1) * (rest[:, None] + own) ** 2
            codes[:, s] = loss.argmin(axis=1)
            along = rest + own[np.arange(len(x)), codes[:, s]]
    return codes


def fit(vectors: np.ndarray, rounds: int = 8) -> Codebooks:
    """Alternates codes and centroids; each centroid solves the 2 by 2 system of its members."""
    x = _parts(vectors)
    n, m, _ = x.shape
    d = vectors.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(11)
    books = Codebooks(np.stack([x[rng.integers(0, n, CENTROIDS), s] for s in range(m)]), 1.0)
    codes = None
    u = _units(x)
    for step in range(rounds):
        if step == rounds // 2:
            books.eta = eta  # plain quantisation first, then the score-aware loss
        codes = assign(x, books, codes if books.eta > 1 else None, rounds=1 if books.eta > 1 else 0)
        along = np.zeros(n)
        for s in range(m):
            along += ((x[:, s] - books.centres[s][codes[:, s]]) * u[:, s]).sum(axis=1)
        w = books.eta - 1
        for s in range(m):
            k = codes[:, s]
            us, xs = u[:, s], x[:, s]
            own = ((xs - books.centres[s][k]) * us).sum(axis=1)
            pull = w * (along - own + (us * xs).sum(axis=1))
            a = np.empty((CENTROIDS, 2, 2))
            b = np.empty((CENTROIDS, 2))
            count = np.bincount(k, minlength=CENTROIDS)
            for i in range(2):
                b[:, i] = np.bincount(k, xs[:, i] + pull * us[:, i], minlength=CENTROIDS)
                for j in range(2):
                    a[:, i, j] = (i == j) * count + np.bincount(k, w * us[:, i] * us[:, j], minlength=CENTROIDS)
            full = count > 0
            new = books.centres[s].copy()
            new[full] = np.linalg.solve(a[full] + 1e-9 * np.eye(2), b[full][:, :, None])[:, :, 0]
            books.centres[s] = new
            along += ((xs - new[k]) * us).sum(axis=1) - own
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    return (codes[:, 0::2] * CENTROIDS + codes[:, 1::2]).astype(np.uint8)


def tables(queries: np.ndarray, books: Codebooks) -> np.ndarray:
    """For each byte of a code, its value and each query, the sum of both centroids' products."""
    q = _parts(queries)
    t = np.einsum("qsd,skd->skq", q, books.centres)
    return (t[0::2, :, None] + t[1::2, None, :]).reshape(-1, CENTROIDS * CENTROIDS, len(queries)).astype(np.float32)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def encoder(spark: SparkSession, books: Codebooks):
    sent = spark.sparkContext.broadcast(books)

    @F.arrow_udf("binary")
    def encode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            codes = packed(assign(_parts(_matrix(col)), sent.value)) if len(col) else []
            yield pa.array([c.tobytes() for c in codes], pa.binary())

    return encode.asNondeterministic()


class Best:
    """The k best rows of each query so far: larger score first, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of each query; an id that is there already counts once, with its best score."""
        s, i = np.concatenate([self.score, score], axis=1), np.concatenate([self.id, ids], axis=1)
        order = np.lexsort((-s, i), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        s[:, 1:][i[:, 1:] == i[:, :-1]] = -np.inf
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score, self.id = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def residuals(vectors: np.ndarray, codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """The length of what the codes (two to a byte) leave of each vector."""
    each = np.stack([codes // CENTROIDS, codes % CENTROIDS], axis=2).reshape(len(codes), -1)
    rest = _parts(vectors)
    for s in range(each.shape[1]):
        rest[:, s] -= books.centres[s][each[:, s]]
    return np.sqrt((rest**2).sum(axis=(1, 2)))


def margin(vectors: np.ndarray, books: Codebooks, k: int, kept: float = KEPT) -> float:
    """The quantile ``kept`` of (product - sum) / (residual's length * query's length) over the k true
    neighbours of MARGIN_QUERIES of the vectors among all of them; 1, which holds for all, where
    there are too few to tell or ``kept`` is 1. Vectors that repeat count once."""
    x = np.unique(vectors, axis=0)
    if kept >= 1 or len(x) <= 4 * k:
        return 1.0
    codes = packed(assign(_parts(x), books))
    rest = residuals(x, codes, books)
    rng = np.random.default_rng(12)
    asked = rng.permutation(len(x))[:MARGIN_QUERIES]
    q = x[asked]
    lut, sums = tables(q, books), np.zeros((len(x), len(q)), np.float32)
    for b in range(codes.shape[1]):
        sums += lut[b][codes[:, b]]
    product = q @ x.T
    product[np.arange(len(q)), asked] = -np.inf
    top = np.argpartition(-product, k - 1, axis=1)[:, :k]
    short = np.take_along_axis(product - sums.T, top, 1)
    longest = rest[top] * np.sqrt((q**2).sum(axis=1))[:, None]
    ratio = short[longest > 0] / longest[longest > 0]
    return float(min(1.0, max(0.0, np.quantile(ratio, kept)))) if len(ratio) else 1.0


def _products(queries: np.ndarray, rows: np.ndarray, r: np.ndarray, c: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """queries[r] . rows[c], each summed in the same order, so that equal vectors tie in all shards."""
    return np.concatenate([(queries[r[a : a + block]] * rows[c[a : a + block]]).sum(axis=1) for a in range(0, max(len(r), 1), block)])


def scan_shard(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, lut: np.ndarray, books: Codebooks, k: int, best: Best) -> int:
    """Adds the shard's rows to the best ones of each query; how many pairs were ranked by exact products."""
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest: one row stands for all
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors, codes = ids[order], vectors[order], codes[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(ids)))
    copies = int(min(size.max(), k + 1))
    alike = head[:, None] + np.arange(copies)
    there = np.arange(copies) < size[:, None]
    members = np.where(there, ids[np.minimum(alike, len(ids) - 1)], -1)
    distinct, wide = vectors[head].astype(float), codes[head]
    n = min(len(head), RERANK * k)
    rest = residuals(distinct, wide, books)
    norm = np.sqrt((distinct**2).sum(axis=1))
    need = min(k + 1, len(head))  # the query's own row may be one of them
    ranked = 0
    for a in range(0, len(queries), 256):
        q = slice(a, min(a + 256, len(queries)))
        total = np.zeros((len(head), q.stop - a), np.float32)
        for b in range(wide.shape[1]):
            total += lut[b][:, q][wide[:, b]]
        approx = total.T
        size_q = np.sqrt((queries[q] ** 2).sum(axis=1))
        # what float sums and products may be off
        slack = 1e-5 * size_q * (norm.max() + rest.max())
        first = np.argpartition(-approx, n - 1, axis=1)[:, :n] if n < len(head) else np.tile(np.arange(n), (q.stop - a, 1))
        known = np.stack([distinct[t] @ v for t, v in zip(first, queries[q], strict=True)])
        bar = np.maximum(np.partition(known, n - need, axis=1)[:, n - need], best.score[q, -1]) - slack
        # by Cauchy-Schwarz a product differs from its sum by the residual's length times the query's at most
        near = approx + books.margin * size_q[:, None] * rest >= bar[:, None]
        np.put_along_axis(near, first, True, 1)
        r, c = np.nonzero(near)
        ranked += len(r)
        value = _products(queries[q], distinct, r, c)
        order = np.lexsort((members[c, 0], -value, r))
        r, c, value = r[order], c[order], value[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        won = place < need
        top = np.full((q.stop - a, need), -1)
        exact = np.full(top.shape, -np.inf)
        top[r[won], place[won]], exact[r[won], place[won]] = c[won], value[won]
        score = np.repeat(exact, copies, axis=1)
        who = np.where((top >= 0)[:, :, None], members[top], -1).reshape(len(top), -1)
        score[(who < 0) | (who == query_ids[q][:, None])] = -np.inf
        keep = min(score.shape[1], 4 * k + copies)
        if keep < score.shape[1]:
            # ties at the edge: everything that ties with the k-th is kept by score, then id
            order = np.lexsort((who, -score), axis=1)[:, :keep]
            score, who = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        part = Best.__new__(Best)
        part.k, part.score, part.id = best.k, best.score[q], best.id[q]
        part.add(score, np.where(np.isneginf(score), np.iinfo(np.int64).max, who))
        best.score[q], best.id[q] = part.score, part.id
    return ranked


def scanner(spark: SparkSession, books: Codebooks, query_ids: np.ndarray, queries: np.ndarray, k: int):
    sent = spark.sparkContext.broadcast((books, query_ids, queries))  # of bounded size: QUERY_BLOCK

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, query_ids, queries = sent.value
        lut, best = None, Best(len(queries), k)
        for batch in it:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                if lut is None:
                    lut = tables(queries, books)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                scan_shard(part.column("id").to_numpy(), _matrix(part.column("v")), codes, query_ids, queries, lut, books, k, best)
        some = np.isfinite(best.score)
        if some.any():
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(query_ids, some.sum(axis=1)), "vec_id": best.id[some], "score": best.score[some]})

    return scan


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", kept: float = KEPT) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: for each query its k best rows found, other
    than those of its own id, by inner product in double precision; ties go to the smaller id.
    ``kept`` is the share of true neighbours to be found, as measured on the sample; 1 finds all.

    Vectors that are null, zero, or hold null or non-finite components take no part, on either
    side; neither do vectors of another length than most have, and rows without an id. Rows that
    repeat an id count once, with their best score. Fewer candidates than k give all of them; no
    queries or no vectors give no rows. Other columns of the inputs aren't returned.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    sound = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(sound)
    rows = pick(vectors)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == length.d)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    fitted = _matrix(sample.column("v").combine_chunks()).astype(float)
    books = fit(fitted)
    books.margin = margin(fitted, books, k, kept)
    index = written(rows.withColumn("codes", encoder(spark, books)("v")))

    asked = pick(queries).where(F.size("v") == length.d)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        t = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if t.num_rows:
            ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
            q = _matrix(t.column("v").combine_chunks()).astype(float)[first]
            found.append(index.mapInArrow(scanner(spark, books, ids, q, k), "query_id long, vec_id long, score double"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)
