"""Exact top-k search by inner product without random access to the lists.

Each vector component is a list of (vector, value). For a query, the list of a
component is read from its high end where the query's component is positive and
from its low end where it is negative, so the best contributions come first. After
``t`` entries of every list, a candidate's score lies between

* the contributions read so far plus the worst value of every unread list, and
* the contributions read so far plus the value at the reading front of every unread list.

Reading stops once few candidates have an upper bound that reaches the k-th best
lower bound; only their scores are then resolved.

Spark deals candidates and queries into blocks of bounded size; a task meets one
block of each, bounds all its pairs with matrix products and passes on k rows a query.
Blocks follow the row number of the scan, never a key, so no vector, copied or
not, makes a block larger than the others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import small_batches

def whole_components(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component, as whole doubles; NULL unless all components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    # doubles of 2**52 or more are whole as they are
    return F.when(finite, F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))


def _number_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The fastest type in which every partial sum is exact; beyond longs that is Python's whole numbers."""
    most = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def block_top_k(query_ids: np.ndarray, queries: np.ndarray, vector_ids: np.ndarray, vectors: np.ndarray,
                k: int, rows: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block of vectors for every query: (query position, vector position, score)."""
    n, dims = vectors.shape
    kind = _number_type(queries, vectors)
    x = vectors.astype(kind)
    lists = np.sort(x, axis=0)
    depths = sorted({min(n, max(4 * k, math.ceil(n * share))) for share in (0.25, 0.5, 0.75, 1.0)})
    least, most = lists[0], lists[-1]
    fronts = []
    for depth in depths:
        high, low = lists[n - depth], lists[depth - 1]
        upper = np.hstack([np.maximum(x, high), np.minimum(x, low)]).T
        lower = np.hstack([np.where(x >= high, x, least), np.where(x <= low, x, most)]).T
        fronts.append((np.ascontiguousarray(upper), np.ascontiguousarray(lower)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), rows):
        ids, q = query_ids[at:at + rows], queries[at:at + rows].astype(kind)
        split = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
        own = ids[:, None] == vector_ids[None, :]
        for upper, lower in fronts:
            # own rows get a bound below any score
            low_bound = split @ lower
            bottom = low_bound.min(initial=0) - 1
            low_bound[own] = bottom
            kth = np.partition(low_bound, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), bottom, kind)
            is_open = (split @ upper >= kth[:, None]) & ~own
            if is_open.sum() <= len(q) * max(4 * k, n // 16):
                break
        qi, ci = np.nonzero(is_open)
        score = np.empty(len(qi), object if kind is object else np.int64)
        for part in range(0, len(qi), 65_536):
            s = slice(part, part + 65_536)
            score[s] = (queries[at + qi[s]].astype(kind) * x[ci[s]]).sum(axis=1) if kind is object else np.einsum("ij,ij->i", queries[at + qi[s]], vectors[ci[s]])
        if kind is object and len(score):  # places among the different scores sort like the scores
            _, place = np.unique(score, return_inverse=True)
        order = np.lexsort((vector_ids[ci], -place if kind is object and len(score) else -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = rank < k
        out.append((at + qi[best], ci[best], score[best]))
    return tuple(np.concatenate(parts) for parts in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks]) if table.num_rows else pa.array([], pa.int64())
    values = flat.to_numpy(zero_copy_only=False)
    if len(values) and np.abs(values).max() >= 2.0**53:
        values = np.array([int(v) for v in values], object)
    else:
        values = values.astype(np.int64)
    return values.reshape(table.num_rows, dims)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, query_block: int = 4096, vector_block: int = 8192) -> DataFrame:
    """The ``k`` vectors with the highest inner product for each query, ties to smaller ids.

    Both frames have ``id`` (long) and ``v`` (array of whole numbers, see :func:`whole_components`).
    Returns query_id, rank (from 1), vec_id, score. A query's own row is every row with
    its id. Rows with a NULL id or vector take no part; of a query id that occurs more than
    once every row is searched, and the best of all of them are listed; a repeated candidate is listed as often as it
    occurs; vectors of different lengths never meet; a query with fewer candidates lists them all. Scores are exact for
    components of any size; one of the listed that does not fit a long is an error.
    """
    small_batches(vectors.sparkSession)
    vectors = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v", F.size("v").alias("dims"))
    queries = queries.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v", F.size("v").alias("dims"))
    n_vectors, n_queries = vectors.count(), queries.count()
    v_blocks, q_blocks = max(1, math.ceil(n_vectors / vector_block)), max(1, math.ceil(n_queries / query_block))
    row = F.xxhash64(F.monotonically_increasing_id())
    left = (vectors.withColumn("vb", F.pmod(row, F.lit(v_blocks)).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    right = (queries.withColumn("qb", F.pmod(row, F.lit(q_blocks)).cast("int"))
             .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))))

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not some.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        dims = some.column("dims")[0].as_py()
        v_ids, q_ids = some.column("id").to_numpy(), asked.column("id").to_numpy()
        qi, ci, score = block_top_k(q_ids, _matrix(asked, dims), v_ids, _matrix(some, dims), k)
        return pa.table([pa.array(q_ids[qi]), pa.array(v_ids[ci]), pa.array(score.tolist(), pa.int64())], names)

    keys = ["dims", "vb", "qb"]
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInArrow(meet, "query_id long, vec_id long, score long"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
