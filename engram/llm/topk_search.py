"""Exact top-k search by a three-phase uniform threshold.

A vector's coordinates are cut into a few slices; a query's score is the sum of its scores
over the slices. First every task sends, for each query, a short list of the best candidates
of each slice with their whole scores: the k-th best of all that is sent is a safe cutoff.
It is broadcast. A candidate that reaches it has a slice with at least the cutoff's share, so
tasks look at the entries above that share only, resolve what these have in the other
slices, and send those that reach the cutoff. Vectors are never shuffled. Queries are many
(a part of the table), so they go in waves of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, trim
from .vectors import by_length, largest, products, whole_vectors

SCALE = 1024
#: Bytes of queries that are broadcast at a time.
WAVE_BYTES = 16_000_000
#: Candidates and queries that are compared at a time.
CANDIDATES, QUERIES = 8_192, 128
#: At least so many times k entries are gathered for the cutoff, where there are as many.
GATHERED = 4
_LONG = (1 << 63) - 1
_NONE = -(1 << 63)


def clipped(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype != object else np.array([max(-_LONG, min(_LONG, int(v))) for v in scores.ravel()], np.int64).reshape(scores.shape)


class Block:
    """Some queries of one length: numbers, identifiers, vectors, and the slices of the coordinates."""

    def __init__(self, rows: list, slices: int):
        self.at, self.ids, self.x = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        edges = np.linspace(0, self.x.shape[1], min(slices, self.x.shape[1]) + 1).astype(int)
        self.parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def meet(self, ids: np.ndarray, null: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Queries x candidates: the scores of each slice, and which candidates have the query's own key."""
        own = (self.ids[:, None] == ids[None, :]) & ~null[None, :]
        return [clipped(products(self.x[:, a:b], x[:, a:b].T)) for a, b in self.parts], own


def blocks_of(rows: list, slices: int) -> dict[int, list[Block]]:
    lengths: dict[int, list] = {}
    for r in rows:
        lengths.setdefault(len(r[2]), []).append(r)
    return {d: [Block(g[i : i + QUERIES], slices) for i in range(0, len(g), QUERIES)] for d, g in lengths.items()}


def _tiles(batches: Iterator[pa.RecordBatch], blocks: dict[int, list[Block]]) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, identifiers, which of them are null, vectors) of candidates of the queries' length."""
    for batch in batches:
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(_LONG).to_numpy(zero_copy_only=False)
        for d, at, x in by_length(batch.column(1)):
            for i in range(0, len(at), CANDIDATES):
                some = at[i : i + CANDIDATES]
                for block in blocks.get(d, []):
                    yield block, ids[some], null[some], x[i : i + CANDIDATES]
    trim()


def _sum(parts: list[np.ndarray]) -> np.ndarray:
    wide = any(largest(p) >= _LONG // len(parts) for p in parts)
    return clipped(sum(p.astype(object) if wide else p for p in parts))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    return scores if scores.shape[1] <= k else np.partition(scores, -k, axis=1)[:, -k:]


def gather(sent, depth: int, k: int):
    """First phase, a task: of each query the whole scores of those candidates that are among the best ``depth`` of a slice, the k highest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for block, ids, null, x in _tiles(batches, sent.value):
            parts, own = block.meet(ids, null, x)
            whole, seen = _sum(parts), np.zeros(own.shape, bool)
            for p in parts:
                p[own] = _NONE
                seen |= p >= _top(p, depth).min(1)[:, None]
            found = _top(np.where(seen & ~own, whole, _NONE), k)
            if id(block) in held:
                found = _top(np.concatenate([held[id(block)][1], found], axis=1), k)
            held[id(block)] = (block.at, found)
        for at, found in held.values():
            i, j = np.nonzero(found != _NONE)
            yield pa.record_batch({"q": pa.array(at[i]), "score": pa.array(found[i, j])})

    return work


def _first(of: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best entries of each query, sorted."""
    order = np.lexsort((ids, null, -score, of))
    i = of[order]
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    return [v[order[place < k]] for v in (of, ids, null, score)]


def collect(sent, cuts, k: int):
    """Second and third phase, a task: the entries with a slice above the cutoff's share are resolved in the other slices; those that reach the cutoff are sent, at most k a query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for block, ids, null, x in _tiles(batches, sent.value):
            cut = np.array([cuts.value.get(a, -_LONG) for a in block.at.tolist()], np.int64)
            parts, own = block.meet(ids, null, x)
            share = -(-cut // len(parts))[:, None]  # of whole numbers that add up to the cutoff, one is no less
            some = np.zeros(own.shape, bool)
            for p in parts:
                some |= p >= share
            i, j = np.nonzero(some & ~own)
            whole = _sum([p[i, j] for p in parts])
            reach = whole >= cut[i]
            if not reach.any():
                continue
            got = [block.at[i[reach]], ids[j[reach]], null[j[reach]], whole[reach]]
            if id(block) in held:
                got = [np.concatenate(z) for z in zip(held[id(block)], got, strict=True)]
            held[id(block)] = _first(*got, k)
        for q, ids, null, score in held.values():
            yield pa.record_batch({"q": pa.array(q), "vec_id": pa.array(ids, mask=null), "score": pa.array(score)})

    return work


def top_k(df: DataFrame, k: int = 10, every: int = 100, slices: int = 2, wave_bytes: int = WAVE_BYTES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of each query (a row whose key is divisible by ``every``), the k highest inner products: query_id, rank, vec_id, score.

    Vectors are floor(1024 * entry); scores beyond a long are the nearest long. Vectors that are null, empty or hold
    null or non-finite entries take no part. Candidates are all rows of the query vector's length but those of
    the query's own key; rows without a key are candidates (last among ties) and no queries. Ties go to the
    smaller key. A candidate row that is repeated is found as often; so is a query row, and each of its rows
    has all ranks. An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    rows = whole_vectors(df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), SCALE, "v").select("id", "x").where(F.size("x") > 0)
    asked = rows.where(F.col("id") % every == 0).groupBy("id", "x").agg(F.count("*").alias("copies"))
    asked = stage(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    n, width = asked.agg(F.count("*"), F.max(F.size("x"))).first()
    n_waves = max(1, -(-n * 8 * (width or 0) // wave_bytes))
    found = None
    for i in range(n_waves if n else 0):
        wave = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(n_waves)) == i).select("q", "id", "x").collect()]
        sent = spark.sparkContext.broadcast(blocks_of(wave, slices))
        tasks = max(1, rows.rdd.getNumPartitions())
        depth = min(k, max(1, -(-GATHERED * k // (tasks * slices))))
        lists = rows.mapInArrow(gather(sent, depth, k), "q long, score long")
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        cuts = dict(lists.withColumn("r", nth).where(F.col("r") <= k).where(F.col("r") == k).select("q", "score").collect())  # one number a query of the wave
        got = rows.mapInArrow(collect(sent, spark.sparkContext.broadcast(cuts), k), "q long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        part = stage(got.withColumn("rank", rank).where(F.col("rank") <= k), f"top-{i}") if n_waves > 1 else got.withColumn("rank", rank).where(F.col("rank") <= k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = found.join(asked.select("q", F.col("id").alias("query_id"), "copies"), "q")
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return own.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
