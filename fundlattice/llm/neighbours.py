"""Nearest neighbours by blocks: int8 tiles with error bounds, then exact products of what survives."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows of a tile on either side, and lists of a query that are merged at once.
BLOCK = 2_048
MERGED = 64


def usable(col: Column) -> Column:
    """Vectors that are not null or zero and have no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(col, finite) & F.exists(col, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the rounding error, length) of each row."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1), np.linalg.norm(x, axis=1)


def tile_best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k nearest in a tile.

    The int8 product, done in float32 where it is exact below 2^24, gives every inner product up to
    |e_q| |c| + |q'| |e_c|, e being rounding errors and q' the rounded query. Pairs whose upper bound
    reaches the k-th largest lower bound are computed again in double precision.
    """
    cq, sq, eq, _ = quantise(q)
    cc, sc, ec, nc = quantise(c)
    found = [[], [], []]
    exact = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64
    other = cc.astype(exact).T
    step = max(1, 4_000_000 // max(1, len(c)))
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        about = (cq[part].astype(exact) @ other).astype(np.float64) * sq[part, None] * sc[None]
        rounded = np.linalg.norm(cq[part].astype(np.float64), axis=1) * sq[part]
        slack = (eq[part, None] * nc[None] + rounded[:, None] * ec[None]) * (1 + 1e-9) + 1e-12 * np.abs(about)
        own = q_ids[part, None] == c_ids[None]
        lower = np.where(own, -np.inf, about - slack)
        bar = np.partition(lower, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(lower), -np.inf)
        qi, ci = np.nonzero((about + slack >= bar[:, None]) & ~own)
        at = 0
        while at < len(qi):  # what survives, in portions
            end = min(len(qi), at + 200_000)
            a, b = qi[at:end] + lo, ci[at:end]
            found[0].append(a)
            found[1].append(b)
            found[2].append((q[a] * c[b]).sum(axis=1))
            at = end
    a, b, s = (np.concatenate(x) if x else np.empty(0, t) for x, t in zip(found, (np.int64, np.int64, np.float64)))
    order = np.lexsort((c_ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.empty(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return a[rank < k], b[rank < k], s[rank < k]


NAMES, KIND = ["query_id", "part", "scores", "ids"], "query_id long, part int, scores array<double>, ids array<long>"


def lists(queries: np.ndarray, part: np.ndarray, sizes: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    """Columns NAMES: a row for each query, whose list takes the next so many of scores and ids."""
    ends = pa.array(np.cumsum(np.r_[0, sizes]), pa.int32())
    return [pa.array(queries, pa.int64()), pa.array(part, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(scores, pa.float64())), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64()))]


def merge(batches, k: int):
    """Rows sorted by query and part: the lists of each are merged by a heap to the k nearest."""

    def each():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in range(4)))

    held, total = [], 0
    for (query, part), group in itertools.groupby(each(), key=lambda r: r[:2]):
        best = list(itertools.islice(heapq.merge(*(zip((-s for s in scores), ids) for _, _, scores, ids in group)), k))
        held.append((query, part, best))
        total += len(best)
        if total > 100_000:
            yield _flat(held)
            held, total = [], 0
    if held:
        yield _flat(held)


def _flat(held: list[tuple]) -> pa.RecordBatch:
    queries, parts, best = zip(*held)
    every = np.array([x for b in best for x in b], [("s", np.float64), ("i", np.int64)])
    return pa.RecordBatch.from_arrays(lists(np.array(queries), np.array(parts), np.array([len(b) for b in best]), -every["s"], every["i"]), NAMES)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k rows with the largest inner product for every row where `queries` holds, itself excepted.

    Queries and candidates fall into blocks of about `block` rows by a hash; each pair of blocks is one tile,
    computed in one task. A tile keeps k rows for each query; tiles of a query are merged by heaps. Returns query_id,
    rank (from 1), vec_id, score; ties go to the smaller id. All pairs of stated queries and rows are judged,
    so the result is exact. Unusable vectors (see usable) and rows with a null id take no part; of rows with
    the same id and vector one counts. A query meets candidates of its own number of components only.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"), queries.alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull()).distinct().withColumn("size", F.size("v"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    q_blocks, c_blocks = max(1, -(-n["q"] // block)), max(1, -(-n["n"] // block))
    spread = lambda salt, blocks: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")
    numbers = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.where("asks").select("size", "id", "v", spread(1, q_blocks).alias("qb")).withColumn("cb", numbers(c_blocks))
    given = rows.select("size", "id", "v", spread(2, c_blocks).alias("cb")).withColumn("qb", numbers(q_blocks)).toDF("size", "id", "v", "cb", "qb")

    def matrix(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = side["v"].combine_chunks()
        return side["id"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

    def tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(lists(*(np.empty(0, t) for t in (np.int64, np.int32, np.int64, float, np.int64))), NAMES)
        (q_ids, q), (c_ids, c) = matrix(left), matrix(right)
        a, b, s = tile_best(q, q_ids, c, c_ids, k)
        who, sizes = np.unique(a, return_counts=True)
        return pa.table(lists(q_ids[who], np.full(len(who), key[2].as_py()), sizes, s, c_ids[b]), NAMES)

    found = asked.groupBy("size", "qb", "cb").cogroup(given.groupBy("size", "qb", "cb")).applyInArrow(tile, KIND)
    parts = c_blocks
    while parts > 1:  # no list of a query is merged with more than MERGED others at once
        parts = -(-parts // MERGED)
        dealt = found.withColumn("part", F.expr(f"int(part div {MERGED})")).repartition("query_id", "part").sortWithinPartitions("query_id", "part")
        found = dealt.mapInArrow(lambda batches: merge(batches, k), KIND)
    return found.select("query_id", F.posexplode(F.arrays_zip("scores", "ids")).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
