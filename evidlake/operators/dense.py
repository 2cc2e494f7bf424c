"""Exact dense search: normalised vectors, inner product or squared distance.

Inside a report (or any scope) it is an equi-join on the scope and an expression;
over a corpus, blocks of distinct queries of bounded size meet every batch of vectors in
matrix products, and only the k best of a task's batches travel on.

Cases: a zero vector stays zero; null vectors, and vectors of another length than
the query, are not ranked; fewer than k vectors give fewer results; ties go to the
earlier row. With metric ``l2`` the score is a distance: small is near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import topk
from .lexical import DIGITS, blocks, distinct, ranked

#: queries scored at once, vectors held at once, pairs computed at once in double precision
SLICE, ROWS, PAIRS = 256, 1 << 13, 1 << 15
METRICS = ("cosine", "l2")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, z: s + z)


def score_of(a: Column, b: Column, metric: str) -> Column:
    """Cosine of two vectors (0 with a zero vector), or their squared distance."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if metric == "l2":
        return squared_distance(a, b)
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def hashed_embedding(c: Column, dims: int = 64) -> Column:
    """Offline stand-in for an embedding service: counts of tokens by hash."""
    buckets = F.transform(T.tokenize(F.coalesce(c, F.lit(""))), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dims)
    places = F.sequence(F.lit(0), F.lit(dims - 1))
    return T.let(buckets, lambda found: F.transform(places, lambda i: F.size(F.filter(found, lambda b: b == i)).cast("float")))


def scored_in_scope(queries: DataFrame, vectors: DataFrame, scope: list[str], metric: str = "cosine") -> DataFrame:
    """(query_id, example_id, pos, score) for the vectors in each query's scope.

    ``queries`` has query_id, the scope and v; ``vectors`` example_id, pos, the scope and v.
    """
    q = queries.where(F.col("v").isNotNull()).select("query_id", *scope, F.col("v").alias("qv"))
    found = q.join(vectors.where(F.col("v").isNotNull()), scope).where(F.size("qv") == F.size("v"))
    return found.select("query_id", "example_id", "pos", score_of(F.col("qv"), F.col("v"), metric).alias("score"))


def search_scope(queries: DataFrame, vectors: DataFrame, scope: list[str], k: int, metric: str = "cosine") -> DataFrame:
    return ranked(scored_in_scope(queries, vectors, scope, metric), k, metric == "cosine")


def search_corpus(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", block: int = 1 << 13) -> DataFrame:
    """(query_id, rank, score, example_id, pos): the k nearest of all vectors for every query (query_id, v)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return (_search_cosines if metric == "cosine" else _search_distances)(queries, vectors, k, block)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n == 0, 1, n)[:, None]


def _search_cosines(queries: DataFrame, vectors: DataFrame, k: int, block: int) -> DataFrame:
    """Products in single precision tell which pairs may be among the k best; those are computed again in double precision."""
    spark = queries.sparkSession
    double = lambda df: df.where(F.col("v").isNotNull()).withColumn("v", F.col("v").cast("array<double>"))
    rows = topk.numbered(double(vectors.select("example_id", F.col("pos").cast("long").alias("pos"), "v")), "vectors")
    asks, asked = distinct(double(queries.select(F.col("query_id").cast("string").alias("query_id"), "v")), "v", "asked")
    out = None
    for part in blocks(asked, ["query_id", "v"], block):
        by_length: dict[int, tuple[list[int], list[list[float]]]] = {}
        for r in part:
            names, values = by_length.setdefault(len(r["v"]), ([], []))
            names.append(r["query_id"]), values.append(r["v"])
        shared = spark.sparkContext.broadcast({d: (np.array(names), np.array(values).reshape(-1, d)) for d, (names, values) in by_length.items()})

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: topk.Pairs(len(names), k) for d, (names, _) in shared.value.items()}
            single = {d: _unit(values).astype(np.float32) for d, (_, values) in shared.value.items()}
            for table in topk.gathered(batches, ROWS):
                length = np.diff(table["v"].combine_chunks().offsets.to_numpy())
                for d in np.intersect1d(length, list(best)).tolist():
                    some = table.filter(pa.array(length == d)).combine_chunks()
                    no, x = some["no"].to_numpy(), some["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
                    unit, error = _unit(x).astype(np.float32), (d + 8) * 2.0**-22
                    _, values = shared.value[d]
                    xn, qn = np.linalg.norm(x, axis=1), np.linalg.norm(values, axis=1)
                    xn, qn = np.where(xn == 0, 1, xn), np.where(qn == 0, 1, qn)
                    for a in range(0, len(values), SLICE):
                        least = best[d].least[a : a + SLICE]
                        s = single[d][a : a + SLICE] @ unit.T
                        fresh = np.isneginf(least)
                        if fresh.any() and len(no) > k:
                            least = least.copy()
                            least[fresh] = np.partition(s[fresh], len(no) - k, axis=1)[:, len(no) - k] - error
                        at = np.flatnonzero(s >= (least - error - topk._NEAR).astype(np.float32)[:, None])
                        q, r = at // len(no) + a, at % len(no)
                        for b in range(0, len(q), PAIRS):
                            i, j = q[b : b + PAIRS], r[b : b + PAIRS]
                            best[d].add(i, no[j], np.einsum("ij,ij->i", values[i], x[j]) / qn[i] / xn[j])
                    best[d].ready()
            for d, (names, _) in shared.value.items():
                yield best[d].batch(names)

        found = rows.select("no", "v").mapInArrow(score, topk.FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], topk.FOUND)
    return topk.named(out, k, asks, "asks", rows)


def _search_distances(queries: DataFrame, vectors: DataFrame, k: int, block: int) -> DataFrame:
    spark = queries.sparkSession
    rows = vectors.where(F.col("v").isNotNull()).select("example_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("array<double>").alias("v"))
    out = None
    for part in blocks(queries.where(F.col("v").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"), F.col("v").cast("array<double>").alias("v")), ["query_id", "v"], block):
        by_length: dict[int, tuple[list[str], list[list[float]]]] = {}
        for r in part:
            names, values = by_length.setdefault(len(r["v"]), ([], []))
            names.append(r["query_id"]), values.append(r["v"])
        shared = spark.sparkContext.broadcast({d: (names, np.array(values)) for d, (names, values) in by_length.items()})

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: topk.Best(len(names), k) for d, (names, _) in shared.value.items()}
            for batch in batches:
                length = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.zeros(0, dtype=int)
                for d in np.unique(length):
                    if d not in shared.value:
                        continue
                    names, queries_of_d = shared.value[d]
                    some, ids, pos = topk.by_id(batch.filter(pa.array(length == d)))
                    x = some.column(2).flatten().to_numpy().reshape(some.num_rows, d)
                    for a in range(0, len(names), SLICE):
                        q = queries_of_d[a : a + SLICE]
                        best[d].add(a, -np.stack([((x - one) ** 2).sum(axis=1) for one in q]), ids, pos)
            for d, (names, _) in shared.value.items():
                yield best[d].batch(names, [pa.string(), pa.string(), pa.int64()], -1.0)

        found = rows.mapInArrow(score, "query_id string, example_id string, pos long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select(F.lit("").alias("query_id"), "example_id", "pos", F.lit(0.0).alias("score")).where(F.lit(False))
    return ranked(out, k, False).select("query_id", "rank", "score", "example_id", "pos")


__all__ = ["DIGITS", "dot", "hashed_embedding", "norm", "normalized", "score_of", "scored_in_scope", "search_corpus", "search_scope", "squared_distance"]
