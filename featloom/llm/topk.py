"""Exact top-k search by inner product: branch and bound over dimension blocks in vertical layout.

Vectors become integers. Candidates and queries are dealt into blocks of bounded size; a task meets one
block of candidates with one block of queries. Candidates lie there dimension by dimension. The first of
them are scored in full, which gives each query a k-th best score to beat. For the others scores grow dimension block by
dimension block, the dimensions with the most mass first; what the dimensions still to come can add at most
is the product of the two remaining norms (Cauchy-Schwarz). Pairs that cannot reach the k-th best any more
go, and once few are left the rest is compacted to a list of pairs. The best k of each block meet in a last
ranking, so results are exact.

A vector takes no part if it is null or holds a null or non-finite component. Shorter vectors count as
filled up with zeros; an empty vector scores 0. Ties go to the smaller id. A query meets every row whose id differs from its
own; rows of null id take no part. Repeated candidate rows each take a rank; repeated equal queries give one
result. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Vectors of a block, and queries of a block: what a task holds at most, whatever the size of the tables.
CANDIDATES, QUERIES = 8192, 1024
#: Dimensions added between two prunings, and candidates scored in full for the first threshold.
DIMENSIONS, FULL = 8, 1024
#: Share of surviving pairs under which they are compacted.
SPARSE = 0.3


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """id, v: floor(scale * x) of every component; only rows that take part."""
    fine = f"forall({vector_col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('infinity'))"
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
            .select(F.col(id_col).cast("bigint").alias("id"),
                    F.expr(f"transform({vector_col}, x -> cast(floor({scale} * double(x)) AS bigint))").alias("v")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Dimensions x vectors."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return np.ascontiguousarray(out.T)


def best_of_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    """Positions of queries and candidates and the scores of the k best (at least) of each query.

    `q` and `c` are dimensions x vectors. Scores are exact: sums stay below 2^53 in floating point, else
    integers are used.
    """
    big = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, len(c))
    kind = np.float64 if big < 2.0**53 else np.int64
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    q, c = q[order].astype(kind), c[order].astype(kind)
    seen = min(c.shape[1], FULL)
    scores = q.T @ c[:, :seen]
    own = qid[:, None] == cid[None, :]
    floor = np.full(len(qid), -np.inf)
    comparable = np.where(own[:, :seen], -np.inf, scores.astype(np.float64))
    if seen > k:
        floor = -np.partition(-comparable, k - 1, axis=1)[:, k - 1]
    qi, ci = np.nonzero((comparable >= floor[:, None]) & ~own[:, :seen])
    found = [(qi, ci, scores[qi, ci])]
    if seen < c.shape[1]:
        rest = c[:, seen:]
        # squared norms of the dimensions from a block on
        mass = lambda m: np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        q_mass, c_mass = mass(q), mass(rest)
        partial = np.zeros((q.shape[1], rest.shape[1]), kind)
        pairs = None
        for at in range(0, len(c), DIMENSIONS):
            to = min(at + DIMENSIONS, len(c))
            left = to < len(c)
            if pairs is None:
                partial += q[at:to].T @ rest[at:to]
                reach = partial.astype(np.float64)
                if left:
                    reach += np.sqrt(q_mass[to])[:, None] * np.sqrt(c_mass[to])[None, :]
                alive = _reaches(reach, floor[:, None]) & ~own[:, seen:]
                if alive.mean() < SPARSE or not left:
                    qi, ci = np.nonzero(alive)
                    pairs = [qi, ci, partial[qi, ci]]
            elif len(pairs[0]):
                qi, ci, s = pairs
                s = s + np.einsum("dp,dp->p", q[at:to][:, qi], rest[at:to][:, ci])
                reach = s.astype(np.float64)
                if left:
                    reach += np.sqrt(q_mass[to][qi] * c_mass[to][ci])
                alive = _reaches(reach, floor[qi])
                pairs = [qi[alive], ci[alive], s[alive]]
        if pairs is not None:
            found.append((pairs[0], pairs[1] + seen, pairs[2]))
    qi, ci, s = (np.concatenate(x) for x in zip(*found))
    s = s.astype(np.int64)
    rank = np.lexsort((cid[ci], -s, qi))
    qi, ci, s = qi[rank], ci[rank], s[rank]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[place < k], ci[place < k], s[place < k]


def _reaches(reach: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether an upper bound reaches the score to beat; rounding must not lose a tie."""
    return reach + (1e-9 * np.abs(reach) + 1e-6) >= floor


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` for every one of `queries` (both id, v)."""
    queries = queries.dropDuplicates(["id", "v"]).withColumn("query", F.struct("id", "v"))
    n, m = vectors.count(), queries.count()
    grid_c, grid_q = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(m / QUERIES))

    def block(hashed, blocks):
        return F.pmod(F.xxhash64(F.lit(7), hashed), F.lit(blocks))

    def cells(own, own_blocks, others, formula):
        return own.withColumn("block", block("id", own_blocks)).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("cell", F.expr(formula))

    c = cells(vectors.select("id", "v"), grid_c, grid_q, f"block * {grid_q} + other").select("cell", "id", "v")
    q = cells(queries.select("id", "v"), grid_q, grid_c, f"other * {grid_q} + block").select("cell", "id", "v")

    def meet(cands: pa.Table, qs: pa.Table) -> pa.Table:
        width = max([1, *(len(x) for t in (cands, qs) for x in t.column("v"))])
        qid, cid = qs.column("id").to_numpy(), cands.column("id").to_numpy()
        if not len(qid) or not len(cid):
            return pa.table({"query_id": pa.array([], pa.int64()), "query_hash": pa.array([], pa.binary()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        qm = _matrix(qs.column("v"), width)
        qi, ci, s = best_of_block(qid, qm, cid, _matrix(cands.column("v"), width), k)
        # tells queries of one id and different vectors apart
        import hashlib
        names = pa.array([hashlib.blake2b(np.trim_zeros(v, "b").tobytes(), digest_size=8).digest() for v in qm.T])
        return pa.table({"query_id": qid[qi], "query_hash": names.take(pa.array(qi)), "vec_id": cid[ci], "score": s})

    met = c.groupBy("cell").cogroup(q.groupBy("cell")).applyInArrow(
        meet, "query_id bigint, query_hash binary, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""
