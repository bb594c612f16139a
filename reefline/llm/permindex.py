"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. The index is cut into
segments of bounded size; in a segment each pivot has an inverted file of the
vectors that count it among their nearest ``PREFIX``, with its place in their
order. A query adds up, over the files of its own pivots, how far the places
agree. That sum is Spearman's footrule distance of the two truncated orders, up to
a constant, so the best sums are the least distances. The best ``RERANK`` of a
segment are compared by their exact inner product, and the best of all segments
are merged.

Pivots come from a sample of ``SAMPLE`` vectors by hash of the id, spread out by
taking the least similar one next. Every row is indexed, in segments dealt by
hash, so equal or crowded vectors never meet in one task. Queries are taken in
blocks; a task holds one segment and one block. Work grows with queries times
rows, as for any set of queries against all rows, at about two additions for each
coordinate saved; what is shuffled per task stays bounded.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, neither do rows without id or of another length than most. Of rows
with one id the least vector counts. Ties go to the smaller id; fewer than ``k``
candidates give fewer rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.llm.common import ship
from reefline.operators.ranking import top_rows

ship(__name__)

PIVOTS, PREFIX, SAMPLE = 256, 96, 4_096
SEGMENT, QUERY_BLOCK = 8_192, 2_048
RERANK, LEAST_RERANK = 0.12, 500  # share of a segment, and the least number


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.exists("v", lambda x: x != 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots: each next one is least similar to those taken."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken = [0]
    nearest = unit @ unit[0]
    while len(taken) < min(most, len(unit)):
        k = int(nearest.argmin())
        if nearest[k] >= 1 - 1e-12:
            break
        taken.append(k)
        nearest = np.maximum(nearest, unit @ unit[k])
    return sample[taken]


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = -(vectors @ pivots.T)
    size = min(PREFIX, len(pivots))
    return np.argsort(near, axis=1, kind="stable")[:, :size].astype(np.uint16)


def inverted(order: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pivot: the rows that post it, and its place in each one's order."""
    rows, size = order.shape
    pivot = order.ravel()
    by_pivot = np.argsort(pivot, kind="stable")
    cut = np.searchsorted(pivot[by_pivot], np.arange(pivots + 1))
    row, place = by_pivot // size, (by_pivot % size).astype(np.int32)
    return [(row[a:b], place[a:b]) for a, b in zip(cut, cut[1:])]


def search(ids: np.ndarray, order: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q_order: np.ndarray, q_vectors: np.ndarray, pivots: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query: its id, the ids of the best ``k`` rows of a segment, and their inner products."""
    by_id = np.argsort(ids, kind="stable")
    ids, order, vectors = ids[by_id], order[by_id], vectors[by_id]
    size = order.shape[1]
    files = inverted(order, pivots)
    depth = min(len(ids), max(LEAST_RERANK, int(RERANK * len(ids))) + 1)
    for q_id, own, vector in zip(q_ids, q_order, q_vectors):
        agree = np.zeros(len(ids), dtype=np.int32)
        for place, pivot in enumerate(own):
            rows, places = files[pivot]
            agree[rows] += size - np.maximum(places, place)
        if depth < len(ids):
            cut = np.partition(agree, len(ids) - depth)[len(ids) - depth]
            over = np.flatnonzero(agree > cut)
            best = np.concatenate([over, np.flatnonzero(agree == cut)[: depth - len(over)]])  # ties: smaller ids
        else:
            best = np.arange(len(ids))
        best = best[ids[best] != q_id]
        product = (vectors[best] * vector).sum(axis=1)
        first = np.lexsort((ids[best], -product))[:k]
        yield q_id, ids[best[first]], product[first]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows found nearest to each query row."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(spread_out(np.array([r["v"] for r in sample]), PIVOTS))

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                order = orders(v, pivots)
                packed = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (order, np.ascontiguousarray(v))]
                yield pa.record_batch([batch.column("vec_id"), *packed], names=["vec_id", "ordered", "vector"])

    indexed = rows.mapInArrow(represent, "vec_id bigint, ordered binary, vector binary")
    queries = indexed.filter(is_query)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    segments, blocks = max(1, -(-counts["n"] // SEGMENT)), max(1, -(-counts["q"] // QUERY_BLOCK))
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(segments)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    stored = indexed.withColumn("segment", dealt).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("q_segment"),
        block.alias("q_block"),
        *[F.col(c).alias(f"q_{c}") for c in ("vec_id", "ordered", "vector")],
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            def parts(p: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                order = np.frombuffer(b"".join(p[f"{name}ordered"]), dtype=np.uint16).reshape(len(p), -1)
                return p[f"{name}vec_id"].to_numpy(), order, np.frombuffer(b"".join(p[f"{name}vector"])).reshape(len(p), -1)

            for q_id, ids, product in search(*parts(left, ""), *parts(right, "q_"), len(shared.value), k):
                found.append(pd.DataFrame({"query_id": q_id, "vec_id": ids, "score": product}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    pairs = stored.groupBy("segment", "block").cogroup(asked.groupBy("q_segment", "q_block"))
    hits = pairs.applyInPandas(run, "query_id long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = top_rows(hits, ["query_id"], order, k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).select("query_id", "rank", "vec_id", "score")
