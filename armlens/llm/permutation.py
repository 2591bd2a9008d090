"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Vectors are dealt into shards, and each shard
has one inverted file per pivot: the vectors that have it among their nearest ``POSTED`` pivots, and at
which rank. A query reads the files of its own ``ASKED`` nearest pivots only and adds up, per
vector, the footrule distance: how far each pivot's rank there is from its rank here, a vector that is
not in a file having rank ``POSTED``. Of every shard the vectors with the smallest distances, a fixed
share of it, are ranked again by their Euclidean distance.

The pivots are a bounded sample of distinct vectors; every vector is posted. The share of a shard and not
a number of candidates is fixed, so recall does not depend on the size of the table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlens.llm.frames import written

#: Pivots, how many of them a vector is posted to, and how many a query asks.
PIVOTS = 512
POSTED = 256
ASKED = 48
#: Vectors of one shard.
SHARD = 1024
#: Of each shard, the share that is ranked again (1 in 6), and no fewer than so many.
SHARE = 6
LEAST = 64
#: Numbers in one block of queries (16 MB), the most that a job broadcasts; queries that a task handles at once.
BLOCK_NUMBERS = 1 << 21
CHUNK = 256
K = 10

INDEX = pa.schema(
    [("shard", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]
    + [(name, pa.binary()) for name in ("starts", "posted", "ranks")]
)
INDEX_DDL = "shard long, ids binary, vectors binary, starts binary, posted binary, ranks binary"


def vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (array of doubles) of the rows that take part.

    Left out: rows without an id, null, empty and zero vectors and those with null or non-finite
    components. Of rows with one id, the vector stays that is smallest component by component.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.filter("id IS NOT NULL").filter(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def dimension(rows: DataFrame) -> tuple[int, int]:
    """The most frequent length of a vector (of equally frequent ones the smallest), and how many have it."""
    first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (first["n"], first["count"]) if first else (0, 0)


def choose_pivots(rows: DataFrame, count: int, pivots: int = PIVOTS) -> np.ndarray:
    """Up to ``pivots`` distinct vectors, those with the smallest hashes; copies count once."""
    hashed = rows.withColumn("h", F.xxhash64("v"))
    share = min(1.0, 16 * pivots / max(count, 1))
    some = hashed.filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1025)))
    found = some.groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(pivots).collect()
    return np.array([r["v"] for r in found])


def nearest_pivots(points: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """For each point the numbers of its nearest pivots in order; equal distances by number."""
    far = ((pivots**2).sum(1) - 2 * points @ pivots.T).astype(np.float32)
    return np.argsort(far, axis=1, kind="stable")[:, :count]


def build(rows: DataFrame, pivots: np.ndarray, count: int, posted: int = POSTED, shard: int = SHARD) -> DataFrame:
    """The index, written to the shared folder: a row per shard with its ids, vectors and inverted files."""
    shards = max(1, -(-count // shard))

    def post(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = group.column("v").combine_chunks().flatten().to_numpy()
        points = np.ascontiguousarray(flat.reshape(len(ids), -1)[order])
        near = nearest_pivots(points, pivots, posted)
        ranks = np.broadcast_to(np.arange(near.shape[1]), near.shape).ravel()
        place = np.repeat(np.arange(len(ids)), near.shape[1])
        by_pivot = np.argsort(near.ravel(), kind="stable")
        starts = np.searchsorted(near.ravel()[by_pivot], np.arange(len(pivots) + 1))
        parts = (ids[order], points, starts.astype(np.int32), place[by_pivot].astype(np.uint16), ranks[by_pivot].astype(np.uint16))
        columns = [group.column("shard")[:1].combine_chunks()] + [pa.array([p.tobytes()], pa.binary()) for p in parts]
        return pa.Table.from_arrays(columns, schema=INDEX)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return written(dealt.groupBy("shard").applyInArrow(post, INDEX_DDL), "permutations")


class Block:
    """Queries with their pivots, and the nearest vectors found for each so far."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, near: np.ndarray, posted: int, k: int):
        self.ids, self.points, self.near, self.posted, self.k = ids, points, near, posted, k
        self.best = np.full((len(ids), k), np.inf)
        self.best_ids = np.zeros((len(ids), k), np.int64)

    def footrule(self, chunk: slice, n: int, starts: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The distance of each query of the chunk to each of ``n`` vectors, pivot after pivot."""
        near = self.near[chunk]
        total = np.full((len(near), n), sum(self.posted - j for j in range(near.shape[1])), np.int32)
        by_pivot = np.argsort(near.ravel(), kind="stable")
        query, rank = np.divmod(by_pivot, near.shape[1])
        bounds = np.searchsorted(near.ravel()[by_pivot], np.arange(len(starts)))
        for p in range(len(starts) - 1):
            asked, has = slice(bounds[p], bounds[p + 1]), slice(starts[p], starts[p + 1])
            if asked.start < asked.stop and has.start < has.stop:
                here = rank[asked, None].astype(np.int32)
                gain = np.abs(ranks[has].astype(np.int32) - here) - (self.posted - here)
                total[np.ix_(query[asked], places[has])] += gain
        return total

    def scan(self, ids: np.ndarray, points: np.ndarray, starts: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        """Rank a shard again by Euclidean distance where the footrule distance is small."""
        n = len(ids)
        count = min(n, max(LEAST, -(-n // SHARE)) + 1)  # one more, for the query itself
        for at in range(0, len(self.ids), CHUNK):
            chunk = slice(at, min(at + CHUNK, len(self.ids)))
            key = self.footrule(chunk, n, starts, places, ranks).astype(np.int64) * n + np.arange(n)
            some = np.argpartition(key, count - 1, axis=1)[:, :count]
            score = np.sqrt(((points[some] - self.points[chunk, None, :]) ** 2).sum(-1))
            found = ids[some]
            score[found == self.ids[chunk, None]] = np.inf
            score = np.concatenate([self.best[chunk], score], axis=1)
            found = np.concatenate([self.best_ids[chunk], found], axis=1)
            order = np.lexsort((found, score), axis=1)[:, : self.k]
            self.best[chunk] = np.take_along_axis(score, order, 1)
            self.best_ids[chunk] = np.take_along_axis(found, order, 1)


def search_index(index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int = K, posted: int = POSTED, asked: int = ASKED) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for every row of ``queries`` (``id, v``).

    Queries go through in blocks of bounded size, each sent to all shards, and a task gives at most
    ``k`` rows per query whatever the number of shards it reads.
    """
    spark = queries.sparkSession
    kept = written(queries.select("id", "v"), "queries")
    size = max(1, BLOCK_NUMBERS // max(1, pivots.shape[1]))
    blocks = -(-kept.count() // size)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for block in range(blocks):
        rows = kept.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        ids = rows.column("id").to_numpy()
        points = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        near = nearest_pivots(points, pivots, min(asked, posted)).astype(np.uint16)
        found = found.union(_search_block(index, spark.sparkContext.broadcast((ids, points, near)), posted, k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_block(index: DataFrame, sent, posted: int, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*sent.value, posted, k)
        kinds = (np.int64, np.float64, np.int32, np.uint16, np.uint16)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in INDEX.names[1:])):
                ids, points, *lists = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, kinds))
                block.scan(ids, points.reshape(len(ids), -1), *lists)
        query, place = np.nonzero(block.best < np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids[query]), pa.array(block.best_ids[query, place]), pa.array(block.best[query, place])],
            ["query_id", "vec_id", "score"],
        )

    return index.mapInArrow(scan, "query_id long, vec_id long, score double")


def search(df: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The ``k`` nearest vectors found for each row whose ``vec_id`` is divisible by ``every``, but itself.

    Columns ``query_id, rank, vec_id, score``; the score is the Euclidean distance in double precision,
    equal ones go by ``vec_id``. ``vectors`` tells which rows take part; of those, vectors of another
    length than the most frequent one have no distance to the others and take no part either. Copies
    under several ids are vectors of their own. A distance beyond the range of doubles is none. Where fewer than ``k`` others exist all are returned; an
    empty table gives no rows. Other columns are not read.
    """
    rows = vectors(df)
    size, count = dimension(rows)
    rows = rows.filter(F.size("v") == size)
    pivots = choose_pivots(rows, count)
    if not len(pivots):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted, asked = min(POSTED, len(pivots)), min(ASKED, len(pivots))
    index = build(rows, pivots, count, posted)
    return search_index(index, rows.filter(F.col("id") % every == 0), pivots, k, posted, asked)
