"""The k best rows of every query of a block, over all batches of a task.

A task scores batches against a block of queries and sends its best rows once, at its
end: k rows a query and task, however many batches it reads. Rows whose score cannot
reach a query's k-th best so far are dropped before anything is sorted.

Ties (scores equal to nine decimals) go to the row with the smaller (id, pos).

``numbered`` rows have ``no``, a number in the order of (example_id, pos); with it candidates
are pairs of integers (see ``Pairs``), whose names are joined back at the end (see ``named``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

DIGITS = 9
_NEAR = 2 * 10.0**-DIGITS


class Best:
    """Best rows so far of ``queries`` queries; larger scores are better."""

    def __init__(self, queries: int, k: int) -> None:
        self.queries, self.k = queries, k
        self.query, self.score = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.ids, self.pos, self.exact = np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.least = np.full(queries, -np.inf)
        self._parts: list[tuple] = []
        self._held = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> None:
        """Scores (queries from ``first`` on, rows) of rows sorted by (id, pos)."""
        n, size = scores.shape
        least = self.least[first : first + n]
        fresh = np.isneginf(least)
        if size > self.k and fresh.any():
            least = least.copy()
            least[fresh] = np.partition(scores[fresh], size - self.k, axis=1)[:, size - self.k]
        good = scores >= (least - _NEAR)[:, None]
        many = np.flatnonzero(good.sum(axis=1) > 4 * self.k)
        if len(many):  # of rows that tie with the k-th best the first k are enough
            s = np.round(scores[many], DIGITS)
            tie = s == np.round(least[many], DIGITS)[:, None]
            good[many] &= ~tie | (np.cumsum(tie, axis=1) <= self.k)
        at = np.flatnonzero(good)
        if len(at):
            q, row = at // size, at % size
            exact = scores[q, row]
            self._parts.append((q + first, np.round(exact, DIGITS), ids[row], pos[row], exact))
            self._held += len(q)
            if self._held > max(2 * self.k * self.queries, 1 << 16):
                self.settle()

    def settle(self) -> None:
        """Keep the k best of all that was added."""
        if not self._parts:
            return
        parts = [(self.query, self.score, self.ids, self.pos, self.exact), *self._parts]
        query, score, ids, pos, exact = (np.concatenate(x) for x in zip(*parts))
        self._parts, self._held = [], 0
        order = np.lexsort((pos, ids.astype(str), -score, query))
        query = query[order]
        start = np.searchsorted(query, np.arange(self.queries))
        place = np.arange(len(query)) - start[query]
        kept = order[place < self.k]
        self.query, self.score, self.ids, self.pos, self.exact = query[place < self.k], score[kept], ids[kept], pos[kept], exact[kept]
        last = place == self.k - 1
        self.least[query[last]] = score[order][last]

    def batch(self, names: list, types: list[pa.DataType], sign: float = 1.0) -> pa.RecordBatch:
        """(query_id, example_id, pos, score) of the best rows."""
        self.settle()
        columns = [pa.array([names[q] for q in self.query.tolist()], types[0]), pa.array(self.ids.tolist(), types[1]), pa.array(self.pos, types[2]), pa.array(sign * self.exact)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "example_id", "pos", "score"])


def by_id(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The batch sorted by its columns example_id and pos, and these two."""
    batch = batch.take(pc.sort_indices(batch, sort_keys=[("example_id", "ascending"), ("pos", "ascending")]))
    return batch, np.array(batch.column("example_id").to_pylist(), dtype=object), batch.column("pos").to_numpy()


class Pairs:
    """Best rows so far, given as pairs (query, row number) that reach ``least``."""

    def __init__(self, queries: int, k: int) -> None:
        self.queries, self.k = queries, k
        self.least = np.full(queries, -np.inf)
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._held = self._kept = 0

    def add(self, query: np.ndarray, no: np.ndarray, score: np.ndarray) -> None:
        self._parts.append((query, no, score))
        self._held += len(query)
        if self._held - self._kept > max(self.k * self.queries, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Keep the k best of all that was added."""
        if not self._parts:
            return
        query, no, score = (np.concatenate(x) for x in zip(*self._parts))
        rough = np.round(score, DIGITS)
        order = np.lexsort((no, -rough, query))
        query, rough = query[order], rough[order]
        place = np.arange(len(query)) - np.searchsorted(query, np.arange(self.queries))[query]
        top = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = rough[last]
        self._parts = [(query[top], no[order[top]], score[order[top]])]
        self._held = self._kept = int(top.sum())

    def ready(self) -> None:
        """Settle where that raises bounds by much: queries are without one, or much was added."""
        if self._held - self._kept > self._kept // 2 or np.isneginf(self.least).any():
            self.settle()

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        """(query, no, score) of the best rows."""
        self.settle()
        query, no, score = self._parts[0] if self._parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(names[query], pa.int64()), pa.array(no, pa.int64()), pa.array(score, pa.float64())], names=["query", "no", "score"])


FOUND = "query long, no long, score double"


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (example_id, pos, ...) written in the order of (example_id, pos), numbered ``no`` in it; as many files as tasks run at once, since each task sends k rows a query."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, 1)
    ordered = rows.repartitionByRange(tasks, "example_id", "pos").sortWithinPartitions("example_id", "pos")
    return materialize(ordered.withColumn("no", F.monotonically_increasing_id()), name)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches as tables of ``size`` rows or somewhat more, sorted by ``no``."""
    held: list[pa.RecordBatch] = []

    def table() -> pa.Table:
        return pa.Table.from_batches(held).sort_by("no").combine_chunks()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield table()
            held = []
    if held:
        yield table()


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query of FOUND rows (and what else they have), with ``rank``."""
    w = Window.partitionBy("query").orderBy(F.round("score", DIGITS).desc(), "no")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def asked_by(best: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, rank, score, example_id, pos): ``queries`` has query_id and ``key``, the query that it asks."""
    return queries.select("query_id", F.col(key).alias("query")).join(best, "query").select("query_id", "rank", "score", "example_id", "pos")


def named(found: DataFrame, k: int, queries: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """(query_id, rank, score, example_id, pos) of FOUND rows."""
    return asked_by(best_of(found, k).join(rows.select("no", "example_id", "pos"), "no"), queries, key)
