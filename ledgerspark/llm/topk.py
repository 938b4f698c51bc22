"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are cut into blocks of neighbouring ids. A block is one row: its ids, its components as a matrix (the forward
index) and, for every dimension, its smallest and largest component. Queries are cut into chunks, and every chunk
meets every group of blocks. Within a group, blocks are visited for each query in the order of their bound, which is the sum over
the dimensions of the largest possible product; a query stops at the first bound below its k-th score so far.

Before that, each query is scored against one group, which gives a k-th score to begin with everywhere else. Both steps are the same code, and the results of all groups are merged by a top-k per query, so nothing
is lost: a block is left out only if none of its vectors can be among the k best, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import durable

BLOCK = 256
GROUP_BLOCKS = 16
CHUNK = 256
SCALE = 256
EXACT = 2**53


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the components floor(256 * x). Vectors that are null or hold a null or non-finite component are left out, as are null ids.

    Rows that repeat an id count once, with the smallest of their vectors.
    """
    x = F.transform(vector_col, lambda v: v.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v * SCALE))
    return vectors.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), whole.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


def _matrix(rows) -> np.ndarray:
    """Rows of possibly different lengths, filled up with zeros."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of at most ``size`` vectors of neighbouring ids: part, ids, width, and the components as bytes."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = [], []

        def row(n: int) -> pd.DataFrame:
            matrix = _matrix(rows[:n])
            out = pd.DataFrame({"first": [ids[0]], "ids": [np.array(ids[:n], np.int64).tobytes()], "width": [matrix.shape[1]], "data": [matrix.tobytes()]})
            del ids[:n], rows[:n]
            return out

        for batch in batches:
            ids.extend(batch["vec_id"])
            rows.extend(batch["x"])
            while len(ids) >= size:
                yield row(size)
        if ids:
            yield row(len(ids))

    return ordered.mapInPandas(pack, "first long, ids binary, width int, data binary")


class Group:
    """Blocks of one forward index with the extremes of their components."""

    def __init__(self, ids: bytes, width: int, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(data, np.int64).reshape(len(self.ids), width)
        self.starts = np.arange(0, len(self.ids), BLOCK)
        self.low = np.minimum.reduceat(self.x, self.starts) if width else np.zeros((len(self.starts), 0), np.int64)
        self.high = np.maximum.reduceat(self.x, self.starts) if width else self.low

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score) of the best k here whose score is at least the query's floor."""
        width = min(self.x.shape[1], queries.shape[1])
        q, x = queries[:, :width], self.x[:, :width]
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
        if largest >= 2**63:
            raise OverflowError("an inner product may not fit into 64 bits")
        kind = np.float64 if largest < EXACT else np.int64
        q, x, low, high = (a.astype(kind) for a in (q, x, self.low[:, :width], self.high[:, :width]))
        bounds = (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)
        order = np.argsort(-bounds, axis=1, kind="stable")
        least = np.iinfo(np.int64).min
        best_s = np.full((len(q), k), least)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        filled = np.zeros(len(q), np.int64)
        live = np.arange(len(q))
        for step in range(len(self.starts)):
            need = np.maximum(floor[live], np.where(filled[live] >= k, best_s[live, -1], least))
            live = live[bounds[live, order[live, step]] >= need]
            if not len(live):
                break
            block = order[live, step]
            for b in np.unique(block):
                rows = live[block == b]
                span = slice(self.starts[b], min(self.starts[b] + BLOCK, len(self.ids)))
                ids = self.ids[span]
                scores = (q[rows] @ x[span].T).astype(np.int64)
                own = query_ids[rows][:, None] == ids[None]
                all_s = np.concatenate([best_s[rows], np.where(own, least, scores)], axis=1)
                all_i = np.concatenate([best_i[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))], axis=1)
                by = np.lexsort((all_i, -all_s.astype(np.float64) if kind is np.float64 else ~all_s), axis=1)[:, :k]
                best_s[rows], best_i[rows] = np.take_along_axis(all_s, by, 1), np.take_along_axis(all_i, by, 1)
                filled[rows] += len(ids) - own.sum(1)
        keep = (best_i < np.iinfo(np.int64).max) & (best_s >= floor[:, None])
        return [(int(query_ids[r]), int(best_i[r, c]), int(best_s[r, c])) for r, c in zip(*np.nonzero(keep))]


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of every pair of a query chunk and a block group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, group = None, None
        for batch in batches:
            for r in batch.itertuples():
                if last != r.first:
                    last, group = r.first, Group(r.ids, r.width, r.data)
                query_ids = np.frombuffer(r.query_ids, np.int64)
                queries = np.frombuffer(r.query_data, np.int64).reshape(len(query_ids), r.query_width)
                floor = np.frombuffer(r.floor, np.int64) if r.floor is not None else np.full(len(query_ids), np.iinfo(np.int64).min)
                yield pd.DataFrame(group.search(query_ids, queries, floor, k), columns=["query_id", "vec_id", "score"])

    return pairs.select("first", "ids", "width", "data", "query_ids", "query_width", "query_data", "floor").mapInPandas(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Ranks 1 to k per query. Spark limits the rows of a query within each task before the shuffle and again behind it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_floor(chunks: DataFrame, first_pass: DataFrame, k: int) -> DataFrame:
    """Query chunks with the k-th score that each of their queries has reached already."""
    kth = _best(first_pass, k).filter(F.col("rank") == k).select("query_id", "score")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = np.frombuffer(r.query_ids, np.int64)
                yield pd.DataFrame({"query_first": r.query_first, "at": np.arange(len(ids)), "query_id": ids})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floors = [np.array([least if s is None else s for s in scores], np.int64).tobytes() for scores in batch["scores"]]
            yield pd.DataFrame({"query_first": batch["query_first"], "floor": floors})

    least = int(np.iinfo(np.int64).min)
    members = chunks.select("query_first", "query_ids").mapInPandas(spread, "query_first long, at long, query_id long")
    scored = members.join(kth, "query_id", "left").withColumn("score", F.coalesce("score", F.lit(least)))
    lists = scored.groupBy("query_first").agg(F.array_sort(F.collect_list(F.struct("at", "score"))).alias("l"))  # at most CHUNK entries
    floors = lists.select("query_first", F.transform("l", lambda e: e["score"]).alias("scores")).mapInPandas(gather, "query_first long, floor binary")
    return chunks.drop("floor").join(floors, "query_first")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` with the largest integer inner product with each query.

    A query's own id is no candidate; ties go to the smaller id; a query with fewer candidates has fewer rows. Vectors of
    different lengths are compared as if filled up with zeros. ``queries`` has the columns of ``vectors``.
    """
    cells = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(cells))
    index = durable(packed(quantised(vectors, id_col, vector_col), BLOCK * GROUP_BLOCKS).withColumn("cell", cell("first")), "topk-index")
    chunks = packed(quantised(queries, id_col, vector_col), CHUNK).toDF("query_first", "query_ids", "query_width", "query_data")
    # Every chunk begins with one group; a chunk whose cell has none begins without a k-th score.
    homes = index.groupBy("cell").agg(F.min("first").alias("home"))
    chunks = durable(chunks.withColumn("cell", cell("query_first")).join(homes, "cell", "left").drop("cell"), "topk-queries")
    start = chunks.withColumn("floor", F.lit(None).cast("binary"))
    near = durable(_searched(start.join(index, F.col("home") == F.col("first")), k), "topk-near")
    aimed = _with_floor(chunks, near, k).withColumn("cell", F.explode(F.expr(f"sequence(0L, {cells - 1}L)")))
    rest = index.join(aimed, "cell").filter(F.coalesce(F.col("home") != F.col("first"), F.lit(True)))
    return _best(near.unionByName(_searched(rest, k)), k)
