"""Exact top-k search by inner product: columnar branch-and-bound.

Candidates stand in blocks in vertical layout (a row for each dimension). A query gathers
its products dimension block by dimension block; what the rest can still add or take away
is at most the product of the rests' norms. Candidates whose upper bound is under the k-th
largest lower bound are dropped and the survivors compacted before the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusveil.session import materialize

ROWS = 4096
QUERIES = 512
DIMS = 16
#: Up to here sums of products are exact in doubles.
EXACT = float(1 << 52)


def _blocks(size: int):
    """Batches of (vec_id, vector) -> (ids, dims, columns): vectors by dimension, zeros where one is shorter."""

    def packed(ids, vectors):
        dims = max((len(v) for v in vectors), default=0)
        matrix = np.zeros((dims, len(ids)))
        for j, v in enumerate(vectors):
            matrix[: len(v), j] = v
        return pa.RecordBatch.from_arrays(
            [pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([matrix.tobytes()], pa.binary())],
            ["ids", "dims", "columns"],
        )

    def run(batches):
        ids, vectors = [], []
        for batch in batches:
            values = batch.column(1)
            flat, edges = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
            for i, vec in enumerate(batch.column(0).to_pylist()):
                ids.append(vec)
                vectors.append(flat[edges[i] : edges[i + 1]])
                if len(ids) == size:
                    yield packed(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield packed(ids, vectors)

    return run


def _best(own: int, query: np.ndarray, head: np.ndarray, columns: np.ndarray, rests: np.ndarray, ids: np.ndarray, k: int):
    """(places, scores) of the query's k best in a block, larger scores first, then smaller ids."""
    alive = np.flatnonzero(ids != own)
    scores = head[alive]
    dims = len(columns)
    for low in range(DIMS, dims, DIMS):
        rest = np.sqrt((query[low:] ** 2).sum()) * rests[low // DIMS, alive]
        if len(alive) > k:
            least = scores - rest
            floor = np.partition(least, len(least) - k)[len(least) - k]
            # rounding of the norms must not cost a tie
            keep = scores + rest * (1 + 1e-9) + 0.5 >= floor - abs(floor) * 1e-12
            alive, scores = alive[keep], scores[keep]
        scores = scores + query[low : low + DIMS] @ columns[low : low + DIMS, alive]
    order = np.lexsort((ids[alive], -scores))[:k]
    return alive[order], scores[order]


def _searched(k: int):
    """Rows (block of candidates, block of queries) -> (query_id, vec_id, score), k for a query at most."""

    def run(batches):
        for batch in batches:
            for ids, dims, columns, q_ids, q_dims, q_columns in zip(*(c.to_pylist() for c in batch.columns)):
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                both = min(dims, q_dims)
                v = np.frombuffer(columns).reshape(dims, -1)[:both]
                q = np.frombuffer(q_columns).reshape(q_dims, -1)[:both]
                out = []
                if both and (np.abs(v).max() * np.abs(q).max()) * both >= EXACT:
                    exact_v = [[int(x) for x in c] for c in v.T]
                    for j, own in enumerate(q_ids.tolist()):
                        whole = [int(x) for x in q[:, j]]
                        scored = sorted((-sum(a * b for a, b in zip(c, whole)), i) for i, c in zip(ids.tolist(), exact_v) if i != own)[:k]
                        out += [(own, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in scored]
                else:
                    squares = np.add.reduceat(v * v, np.arange(0, both, DIMS), axis=0) if both else np.zeros((1, len(ids)))
                    rests = np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])
                    heads = q[:DIMS].T @ v[:DIMS]
                    for j, own in enumerate(q_ids.tolist()):
                        place, score = _best(own, q[:, j], heads[j], v, rests, ids, k)
                        out += zip([own] * len(place), ids[place].tolist(), score.astype(np.int64).tolist())
                columns = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, id_col: str, vector_col: str, is_query, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id that is_query(id) picks, the k rows of other ids
    with the largest inner product (all, if fewer), ties to the smaller id.

    Vectors are whole numbers in doubles. Rows without id or vector, or with a null or
    non-finite component, take no part. A shorter vector counts as filled up with zeros. Every
    row is a candidate, also of a repeated id; for a repeated query id the first of its vectors
    asks. Scores beyond a long are its limits. An empty table gives no rows.
    """
    good = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(good)
    form = "ids binary, dims int, columns binary"
    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = materialize(asked.mapInArrow(_blocks(QUERIES), form), "queries")
    blocks = materialize(rows.mapInArrow(_blocks(ROWS), form).withColumn("block", F.monotonically_increasing_id()), "blocks")
    # the query set against all rows, block by block: each query block goes to each candidate block
    asked_blocks = queries.select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("columns").alias("q_columns")).crossJoin(blocks.select("block"))
    met = blocks.join(asked_blocks, "block").select("ids", "dims", "columns", "q_ids", "q_dims", "q_columns")
    found = met.mapInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
