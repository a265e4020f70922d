"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Vectors are turned into integers, packed into blocks of rows, and each block keeps one sorted list
per dimension. For a query the lists are read from their better ends, all to the same depth at a
time. A candidate's lower bound is the sum of what was read of it plus the least value of every list
where it was not met; its upper bound takes the value at the reading depth there instead. Reading
stops when candidates never met cannot reach the k-th lower bound (or the k-th score that earlier
blocks of the task gave), and only those met whose upper bound reaches it get their final score.

Queries are sent to the candidates in rounds of at most ``round_queries``, so what is broadcast is
bounded; each task keeps k answers per query over all its blocks, and these are merged by a window.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do null
ids; shorter vectors are padded with zeros; ties go to the smaller id, also within the k-th place;
equal rows of one query id and vector ask once, different vectors of one id merge into that id's
answers; a row never answers a query with its own id. Scores that may leave 53 bits are computed
with Python integers. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from exprmat.llm.common import pin

BLOCK_ROWS = 16_384
ROUND_QUERIES = 8_192
#: Shares of a block's lists to which reading goes before bounds are compared.
DEPTHS = (0.2, 0.35, 0.5, 0.7)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``(id, v)`` with the integer vector floor(scale * x) of each row that takes part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), bad.alias("bad"))
            .where("id is not null and v is not null and size(v) > 0 and not bad")
            .select("id", F.transform("v", lambda x: x * F.lit(float(scale))).alias("v")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of floor(v), padded to ``dims``."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims))
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return out


class Lists:
    """A block's vectors as one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(x, axis=0, kind="stable")  # best last
        self.order = np.ascontiguousarray(order.T).astype(np.int32)
        self.value = np.ascontiguousarray(np.take_along_axis(x, order, 0).T)

    def answer(self, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at least all rows that can be among the best k and reach ``floor``."""
        n, d = self.x.shape
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        used = np.concatenate([up, down])
        weight = q[used][:, None]
        worst = np.concatenate([self.value[up, 0], self.value[down, -1]]) * q[used]
        alive = None
        for share in DEPTHS:
            t = int(n * share)
            if t < 8 * k or not len(used):
                continue
            met = np.concatenate([self.order[up, n - t:], self.order[down, :t]]).ravel()
            part = np.concatenate([self.value[up, n - t:], self.value[down, :t]]) * weight
            at = np.concatenate([self.value[up, n - t], self.value[down, t - 1]]) * q[used]
            # of each met row: sum of (read value - value at the depth), and of (value at depth - worst)
            over = np.bincount(met, (part - at[:, None]).ravel(), n)
            room = np.bincount(met, np.repeat(at - worst, t), n)
            upper = at.sum() + over
            lower = worst.sum() + over + room
            lower[self.ids == own] = -np.inf
            bar = max(floor, np.partition(lower, n - k)[n - k] if n > k else -np.inf)
            if at.sum() < bar:  # rows that were never met cannot qualify
                alive = np.flatnonzero(upper >= bar)
                if len(alive) <= max(16 * k, n // 50):
                    break
        if alive is None:
            alive = np.arange(n)
        alive = alive[self.ids[alive] != own]
        return self.ids[alive], self.x[alive] @ q


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first by score down, then id up."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= bar
        ids, scores = ids[keep], scores[keep]
    o = np.lexsort((ids, -scores))[:k]
    return ids[o], scores[o]


def exact_topk(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
               scale: float = 1.0, block_rows: int = BLOCK_ROWS, round_queries: int = ROUND_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row where ``is_query`` holds, the k other rows
    with the highest inner product of integer vectors."""
    spark = rows.sparkSession
    candidates = clean_vectors(rows, id_col, vec_col, scale)
    asked = pin(clean_vectors(rows.where(is_query), id_col, vec_col, scale).distinct(), "topk-queries")
    shape = candidates.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    schema = "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    dims, largest = int(shape[0] or 0), float(shape[1] or 0)
    narrow = (largest + 1) ** 2 * max(dims, 1) < 2.0**53
    n_asked = asked.count()
    rounds = -(-n_asked // round_queries)
    blocks = candidates
    # no more tasks than there are blocks to fill
    want = max(1, -(-int(shape[2]) // block_rows))
    if candidates.rdd.getNumPartitions() > want:
        blocks = candidates.coalesce(max(want, min(spark.sparkContext.defaultParallelism, candidates.rdd.getNumPartitions())))

    for r in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).orderBy("id").toArrow()
        qids = mine.column("id").to_numpy()
        qs = _matrix(mine.column("v").combine_chunks(), dims)
        sent = spark.sparkContext.broadcast((qids, qs))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, qs = sent.value
            top = [(np.zeros(0, np.int64), np.zeros(0, np.float64 if narrow else object))] * len(qids)

            def block(ids: np.ndarray, x: np.ndarray) -> None:
                lists = Lists(ids, x) if narrow else None
                for i, q in enumerate(qs):
                    if narrow:
                        floor = top[i][1][k - 1] if len(top[i][0]) >= k else -np.inf
                        a, s = lists.answer(q, qids[i], k, floor)
                    else:
                        others = ids != qids[i]
                        wide = np.array([int(y) for y in q], object)
                        a = ids[others]
                        s = np.array([sum(int(y) * z for y, z in zip(row, wide, strict=True)) for row in x[others]], object)
                    a, s = np.concatenate([top[i][0], a]), np.concatenate([top[i][1], s])
                    if narrow:
                        top[i] = best(a, s, k)
                    else:
                        o = sorted(range(len(a)), key=lambda j: (-s[j], a[j]))[:k]
                        top[i] = a[o], s[o]

            held, n = [], 0
            for b in batches:
                held.append((b.column("id").to_numpy(), _matrix(b.column("v"), dims)))
                n += b.num_rows
                if n >= block_rows:
                    block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held, n = [], 0
            if n:
                block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(qids, [len(a) for a, _ in top]), pa.int64()),
                pa.array([int(y) for a, _ in top for y in a], pa.int64()),
                pa.array([int(y) for _, s in top for y in s], pa.int64())], names=["query_id", "vec_id", "score"])

        found = found.union(blocks.mapInArrow(search, schema))
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
