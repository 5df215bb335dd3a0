"""Exact top-k by inner product, with bounds from segment means and deviations.

Cut both vectors into segments.  A segment of n components with means a, b and deviations
s, t adds at most n * (a * b + s * t) to the inner product (equally: bounds the distance
from below), by Cauchy and Schwarz.  One segment gives a coarse bound, more segments finer
ones.  Pairs whose bound is below the k-th best score so far are dropped level by level, and
the rest are scored exactly.

Queries meet all rows in blocks: a pair of a query block and a row block is one group of
bounded size.  So each row is sent once per query block, and each query once per row block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.llm.shared import staged

K = 5
SEGMENTS = (1, 4, 16)
QUERY_BLOCK = 8192
ROW_BLOCK = 65_536
# Blocks are smaller, down to this many rows, where there are too few for all tasks.
LEAST_ROWS = 2048
TILE_QUERIES, TILE_ROWS = 512, 2048

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, values: floor(scale * x); vectors that are null or hold null, NaN or infinity go."""
    inf = F.lit(float("inf"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return vectors.filter(F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("values")
    )


def _levels(values: np.ndarray) -> list[np.ndarray]:
    """Per level the features whose products are the bound."""
    out, dim = [], values.shape[1]
    for n in SEGMENTS:
        if n > dim:
            break
        cuts = np.linspace(0, dim, n + 1).astype(int)
        sizes = np.diff(cuts)
        means = np.add.reduceat(values, cuts[:-1], axis=1) / sizes
        centred = values - np.repeat(means, sizes, axis=1)
        deviations = np.sqrt(np.add.reduceat(centred**2, cuts[:-1], axis=1) / sizes)
        out.append(np.hstack([means, deviations]) * np.sqrt(np.hstack([sizes, sizes])))
    return out


class _Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query = np.zeros(0, dtype=np.int64)
        self.row = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        self.query, self.row, self.score = query[keep], row[keep], score[keep]


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of a and b; floats when they are exact in floats."""
    if exact:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, row id and score of the k best rows of each query; a row never meets its own id."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    exact = top * max(1, rows.shape[1]) < 2.0**53
    a, b = queries.astype(np.float64), rows.astype(np.float64)
    slack = 1e-9 * top * max(1, rows.shape[1]) + 1e-6
    levels_a, levels_b = _levels(a), _levels(b)
    best = _Best(len(a), k)
    for q0 in range(0, len(a), TILE_QUERIES):
        qs = slice(q0, q0 + TILE_QUERIES)
        for r0 in range(0, len(b), TILE_ROWS):
            rs = slice(r0, r0 + TILE_ROWS)
            floor = best.floor[qs, None] - slack
            alive = query_ids[qs, None] != row_ids[None, rs]
            if levels_a:
                alive &= levels_a[0][qs] @ levels_b[0][rs].T >= floor
            q, r = np.nonzero(alive)
            q, r = q + q0, r + r0
            for fine_a, fine_b in zip(levels_a[1:], levels_b[1:]):
                if len(q) * 8 > TILE_QUERIES * TILE_ROWS:  # one product is cheaper than many picks
                    bound = (fine_a[qs] @ fine_b[rs].T)[q - q0, r - r0]
                else:
                    bound = np.einsum("ij,ij->i", fine_a[q], fine_b[r])
                near = bound >= best.floor[q] - slack
                q, r = q[near], r[near]
            if exact and len(q) * 8 > TILE_QUERIES * TILE_ROWS:
                score = (a[qs] @ b[rs].T)[q - q0, r - r0].astype(np.int64)
            else:
                ints = (a, b) if exact else (queries, rows)
                score = _scores(ints[0][q], ints[1][r], exact)
            near = score >= best.floor[q]
            best.add(q[near], row_ids[r[near]], score[near])
    return query_ids[best.query], best.row, best.score


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query row, ties to smaller ids.

    `vectors` has vec_id and values (whole numbers, none null).  Rows that share the query's
    id are its own and no candidates; other repeated rows each count.  Only vectors of one
    length meet.  Rows with a null id take no part.  Scores are 64-bit integers.  An empty
    table, or one without queries, gives an empty result.
    """
    rows = staged(
        vectors.filter("vec_id is not null").select(
            "vec_id", "values", F.size("values").alias("dim"), is_query.alias("asked")
        ),
        "vectors",
    )
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(-(-n // ROW_BLOCK), min(tasks, n // LEAST_ROWS), 1)
    query_blocks = max(-(-asked // QUERY_BLOCK), 1)
    shuffled = F.xxhash64("vec_id")
    row_block, query_block = F.pmod(shuffled, F.lit(row_blocks)), F.pmod(shuffled, F.lit(query_blocks))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select(
        "dim", row_block.cast("int").alias("row_block"), every(query_blocks).alias("query_block"),
        F.lit(False).alias("asks"), "vec_id", "values",
    )
    queries = rows.filter("asked").select(
        "dim", every(row_blocks).alias("row_block"), query_block.cast("int").alias("query_block"),
        F.lit(True).alias("asks"), "vec_id", "values",
    )

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        values = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = values.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), dtype=np.int64)
        if not asks.any() or asks.all():
            return FOUND.empty_table()
        found = search_block(ids[asks], values[asks], ids[~asks], values[~asks], k)
        return pa.table(list(map(pa.array, found)), schema=FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        candidates.unionByName(queries)
        .groupBy("dim", "row_block", "query_block")
        .applyInArrow(meet, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           list_inner_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id,
       (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
