"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are indexed in blocks. In a block, every dimension's postings are in order of value and
are cut into segments of equal quantised value. For a query, a segment's impact is what its
postings add to a score above the least that the dimension can give. Segments are processed in
rounds of falling impact and add the least they stand for. What the quantisation and the
dimensions in which a vector was not met could still add bounds its score from above, so the
search of a block stops when most vectors are proven to lie below the k-th exact score; the
others are rescored exactly.
A block whose best possible score is below it is not searched at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import written

K = 5
SCALE = 256
LEVELS = 64
#: Vectors of an index block, queries of a query block, and index blocks and queries of one task.
BLOCK_ROWS, QUERY_ROWS, TASK_BLOCKS, TASK_QUERIES = 8192, 512, 2, 16_384
#: Rounds, as shares of the largest impact of a query in the block. After the last one whatever
#: has not been proven out is rescored: that is exact, and cheaper than its small impacts.
ROUNDS = (0.1, 0.05)
#: A block's search stops when at most this share of it can still be among the best.
POSSIBLE = 0.2


class Block:
    """An index block: row numbers, vectors, and per dimension the order of its postings and segment bounds."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None) -> None:
        self.rows, self.vectors = rows, vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable").T.astype(np.uint16) if order is None else order
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.low, self.step = low, np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.high = low + LEVELS * self.step - 1
        level = ((vectors - low) // self.step).astype(np.int64)
        dims = np.arange(vectors.shape[1])
        counts = np.zeros((vectors.shape[1], LEVELS + 1), np.int64)
        np.add.at(counts, (np.broadcast_to(dims, level.shape), level), 1)
        self.at_least = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # postings of a level or above
        self.levels = np.take_along_axis(level.T.astype(np.uint8), self.order.astype(np.int64), 1)
        self.largest = max(-int(low.min(initial=0)), int(high.max(initial=0)))
        self.floats = vectors.astype(np.float64)

    def exact(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Integer scores; in floating point where every partial sum is a whole number below 2^53."""
        if self.largest * int(np.abs(query).sum()) < 1 << 53:
            held = self.floats if len(places) == len(self.floats) else self.floats[places]
            return (held @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[places] @ query

    def search(self, query: np.ndarray, k: int, floor: int | None, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of all vectors that can be among the k best given the k-th score so far."""
        n = len(self.rows)
        weight = np.abs(query)
        up = query >= 0
        base = int(np.where(up, query * self.low, query * self.high).sum())
        if floor is not None and base + int((weight * (LEVELS * self.step - 1)).sum()) < floor:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        used = np.flatnonzero(weight)
        unit = weight * self.step
        slack = int((weight * (self.step - 1)).sum())
        gained = np.zeros(n)
        done = np.zeros(len(query), np.int64)
        possible = np.arange(n)
        met, met_dims = [], []
        for share in ROUNDS:
            cut = share * float((unit * LEVELS).max(initial=0))
            first = np.clip(np.ceil((cut + weight) / np.maximum(unit, 1)) - 1, 0, LEVELS).astype(np.int64)  # lowest level processed
            upto = np.where(up, np.take_along_axis(self.at_least, first[:, None], 1)[:, 0], n - np.take_along_axis(self.at_least, (LEVELS - first)[:, None], 1)[:, 0])
            now = used[upto[used] > done[used]]
            if len(now):
                parts = [slice(a, b) if u else slice(n - b, n - a) for a, b, u in zip(done[now].tolist(), upto[now].tolist(), up[now].tolist(), strict=True)]
                many = upto[now] - done[now]
                levels = np.concatenate([self.levels[d, part] for d, part in zip(now, parts, strict=True)])
                steps = np.where(np.repeat(up[now], many), levels, LEVELS - 1 - levels)
                met.append(np.concatenate([self.order[d, part] for d, part in zip(now, parts, strict=True)]))
                met_dims.append(np.repeat(now, many))
                gained += np.bincount(met[-1], unit[met_dims[-1]] * steps, n)
            done = np.maximum(done, upto)
            if floor is None:
                best = np.argpartition(gained, n - min(n, 4 * k))[n - min(n, 4 * k) :]
                best = best[self.rows[best] != skip]
                if len(best) >= k:
                    floor = int(np.sort(self.exact(best, query))[-k])
            rest = weight * np.maximum(first * self.step - 1, 0)
            if floor is not None:
                seen = sum(np.bincount(places, rest[dims], n) for places, dims in zip(met, met_dims, strict=True))
                possible = np.flatnonzero(base + gained + slack + rest.sum() - seen >= floor)
                if len(possible) <= POSSIBLE * n:
                    break
        return possible, self.exact(possible, query)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, row): quantised vectors without nulls or non-finite components, each row with a number."""
    items = F.col(vector_col)
    finite = F.forall(items, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(items, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    kept = vectors.where(F.col(id_col).isNotNull() & items.isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(n, dims, ids, rows, matrix, order) blocks; shorter vectors are filled with zeros."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = [x.as_py() for x in part.column(1)]
                dims = max(map(len, lists))
                matrix = np.zeros((len(lists), dims), np.int64)
                for k, x in enumerate(lists):
                    matrix[k, : len(x)] = x
                order = np.argsort(-matrix, axis=0, kind="stable").T.astype(np.uint16)
                pieces = [part.column(0).to_numpy().tobytes(), part.column(2).to_numpy().tobytes(), matrix.tobytes(), order.tobytes()]
                yield pa.record_batch([pa.array([len(lists)], pa.int32()), pa.array([dims], pa.int32()), *[pa.array([x], pa.binary()) for x in pieces]], names=["n", "dims", "ids", "rows", "matrix", "order"])

    return vectors.mapInArrow(run, "n int, dims int, ids binary, rows binary, matrix binary, order binary")


def top_k(vectors: DataFrame, is_query: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row, ties to the smaller id.

    Queries are the rows for which the SQL condition `is_query` on vec_id holds. Unusable vectors
    and null ids take no part. Rows with one id are rows of their own: each is asked if its id is,
    with ranks of its own, and each is a candidate of all rows but itself. Other columns are
    ignored. Fewer than k others give fewer rows; an empty table gives none. Work is dealt as
    (queries, index blocks): a task holds about TASK_QUERIES queries and TASK_BLOCKS index blocks,
    whatever the number of vectors, and the index is copied once per TASK_QUERIES queries.
    """
    all_vectors = written(usable(vectors, id_col, vector_col), "topk-vectors")
    index = written(_packed(all_vectors, BLOCK_ROWS).withColumn("block", F.monotonically_increasing_id()), "topk-index")
    queries = written(_packed(all_vectors.where(is_query), QUERY_ROWS).withColumn("qb", F.monotonically_increasing_id()), "topk-queries")
    groups, asking = max(1, -(-index.count() // TASK_BLOCKS)), max(1, -(-(queries.agg(F.sum("n")).first()[0] or 0) // TASK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    left = queries.select(dealt("qb", asking).alias("q"), every(groups).alias("g"), "n", "dims", "ids", "rows", "matrix")
    right = index.select(every(asking).alias("q"), dealt("block", groups).alias("g"), "n", "dims", "ids", "rows", "matrix", "order")

    def numbers(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.int64)

    def pair(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        if len(asked) and len(held):
            blocks = [(numbers(r.ids), Block(numbers(r.rows), numbers(r.matrix).reshape(r.n, r.dims), np.frombuffer(r.order, np.uint16).reshape(r.dims, r.n))) for r in held.itertuples()]
            for r in asked.itertuples():
                for query_id, query_row, query in zip(numbers(r.ids).tolist(), numbers(r.rows).tolist(), numbers(r.matrix).reshape(r.n, r.dims), strict=True):
                    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    for block_ids, block in blocks:
                        dims = block.vectors.shape[1]
                        fitted = query[:dims] if len(query) >= dims else np.concatenate((query, np.zeros(dims - len(query), np.int64)))
                        places, exact = block.search(fitted, k, int(scores[k - 1]) if len(scores) >= k else None, query_row)
                        other = block.rows[places] != query_row
                        ids, scores = np.concatenate((ids, block_ids[places][other])), np.concatenate((scores, exact[other]))
                        best = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[best], scores[best]
                    found += [(query_row, query_id, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("q", "g").cogroup(right.groupBy("q", "g")).applyInPandas(pair, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_impact_topk(spark, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


OP6_SQL = f"""
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= {K}
"""
