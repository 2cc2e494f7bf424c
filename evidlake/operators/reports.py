"""Search inside reports: BM25 and vectors in one pass over sorted reports, with one shuffle.

Questions and chunks are brought together by report and sorted; an Arrow pass then takes whole
reports, many at once, and gives the k best chunks of every question by either score.
Statistics are those of the report: idf(t) = ln(N - df + 0.5) - ln(df + 0.5), where negative
EPSILON times the mean idf of the report's terms. A question counts a repeated token as
often as it stands there; chunks without any token of the question are ranked too, with
score 0. Ties go to the earlier chunk (pos).

A report arrives as one row of examples, so what a task holds of one report is bounded by
what a row can hold; reports themselves are streamed.

Cases: an empty or null question scores 0 everywhere; a null content has no tokens; an unknown
report gives no results; repeated chunks are scored each; null vectors, and vectors of
another length than the question's, are not ranked; a zero vector has the cosine 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 9
#: pairs of a question and a chunk that are scored at once
PAIRS = 1 << 16
LEXICAL, DENSE = "lexical", "dense"


def _groups(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of the runs of equal values of a sorted column."""
    code = pc.dictionary_encode(column.combine_chunks()).indices.to_numpy()
    return np.concatenate([[0], np.cumsum(np.diff(code) != 0)])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(lengths, flat values); nulls are empty."""
    array = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64), array.flatten()


class _Block:
    """Whole reports: rows of questions and of chunks, by report, chunks by pos."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        group, is_chunk = _groups(table["example_id"]), table["is_chunk"].to_numpy()
        self.chunk_rows, self.query_rows = np.flatnonzero(is_chunk), np.flatnonzero(~is_chunk)
        self.of_chunk, self.of_query = group[self.chunk_rows], group[self.query_rows]
        self.groups = int(group[-1]) + 1
        self.first = np.searchsorted(self.of_chunk, np.arange(self.groups + 1))  # chunks of a report stand together
        self.count = np.diff(self.first)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(questions, question of a pair, chunk of a pair) in slices of about PAIRS pairs."""
        n = self.count[self.of_query]
        some = np.flatnonzero(n > 0)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // PAIRS)) + 1):
            if len(part):
                size = n[part]
                chunk = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[self.of_query[part]], size)
                yield part, np.repeat(part, size), chunk

    def postings(self) -> None:
        """Term weights of all chunks, by report and term."""
        size, flat = _lists(self.table["tokens"])
        encoded = pc.dictionary_encode(flat)
        term, self.terms = encoded.indices.to_numpy(), max(len(encoded.dictionary), 1)
        row = np.repeat(np.arange(len(size)), size)
        place = np.full(self.table.num_rows, -1)
        place[self.chunk_rows] = np.arange(len(self.chunk_rows))
        dl = size[self.chunk_rows]
        mean_dl = np.bincount(self.of_chunk, dl, self.groups) / np.maximum(self.count, 1)
        chunk = place[row]
        post, tf = np.unique(chunk[chunk >= 0] * self.terms + term[chunk >= 0], return_counts=True)
        chunk, word = post // self.terms, post % self.terms
        at = self.of_chunk[chunk]
        self.words, inverse, df = np.unique(at * self.terms + word, return_inverse=True, return_counts=True)
        owner = self.words // self.terms
        n = self.count[owner]
        plain = np.log(n - df + 0.5) - np.log(df + 0.5)
        mean = np.bincount(owner, plain, self.groups) / np.maximum(np.bincount(owner, minlength=self.groups), 1)
        idf = np.where(plain < 0, EPSILON * mean[owner], plain)
        weight = idf[inverse] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[chunk] / mean_dl[at]))
        order = np.argsort(inverse, kind="stable")
        self.post_chunk, self.post_weight = chunk[order], weight[order]
        self.post_ends = np.concatenate([[0], np.cumsum(df)])
        place[:] = -1
        place[self.query_rows] = np.arange(len(self.query_rows))
        query = place[row]
        asked, self.asked_times = np.unique(query[query >= 0] * self.terms + term[query >= 0], return_counts=True)
        self.asked_query, self.asked_term = asked // self.terms, asked % self.terms

    def lexical(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.postings()
        for questions, query, chunk in self.pairs():
            some = slice(*np.searchsorted(self.asked_query, [questions[0], questions[-1] + 1]))
            q, times = self.asked_query[some], self.asked_times[some]
            wanted = self.of_query[q] * self.terms + self.asked_term[some]
            at = np.minimum(np.searchsorted(self.words, wanted), max(len(self.words) - 1, 0))
            known = self.words[at] == wanted if len(self.words) else np.zeros(len(wanted), dtype=bool)
            q, times, at = q[known], times[known], at[known]
            hits = self.post_ends[at + 1] - self.post_ends[at]
            post = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(self.post_ends[at], hits)
            start = np.searchsorted(query, q)  # the first pair of each asking question
            pair = np.repeat(start - self.first[self.of_query[q]], hits) + self.post_chunk[post]
            yield query, chunk, np.bincount(pair, np.repeat(times, hits) * self.post_weight[post], len(query)).astype(np.float64)  # integers where nothing hits

    def dense(self, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size, flat = _lists(self.table["v"])
        width = int(size.max(initial=0))
        x = np.zeros((len(size), width))
        x[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        there = self.table["v"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        norm = np.sqrt((x * x).sum(axis=1))
        for _, query, chunk in self.pairs():
            a, b = self.query_rows[query], self.chunk_rows[chunk]
            same = there[a] & there[b] & (size[a] == size[b])
            query, chunk, a, b = query[same], chunk[same], a[same], b[same]
            if metric == "l2":
                yield query, chunk, ((x[a] - x[b]) ** 2).sum(axis=1)
            else:
                n = norm[a] * norm[b]
                yield query, chunk, np.where(n == 0, 0.0, np.einsum("ij,ij->i", x[a], x[b]) / np.where(n == 0, 1.0, n))

    def best(self, scored: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, descending: bool, kind: str) -> Iterator[pa.RecordBatch]:
        pos = self.table["pos"].to_numpy()[self.chunk_rows]
        for query, chunk, score in scored:
            rough = np.round(score, DIGITS)
            order = np.lexsort((chunk, pos[chunk], -rough if descending else rough, query))
            query, chunk, score = query[order], chunk[order], score[order]
            start = np.flatnonzero(np.diff(query, prepend=-1))
            rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query)))) + 1
            top = rank <= k
            q, c = pa.array(self.query_rows[query[top]]), pa.array(self.chunk_rows[chunk[top]])
            columns = [pa.array([kind] * len(q), pa.string()), self.table["query_id"].take(q).combine_chunks(), pa.array(rank[top], pa.int32()), pa.array(score[top], pa.float64()), self.table["example_id"].take(c).combine_chunks(), self.table["pos"].take(c).combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "query_id", "rank", "score", "example_id", "pos"])


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups of equal values of ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(column)[batch.num_rows - 1]
        if held and held[0].column(column)[0] == last and held[-1].column(column)[0] == last:
            held.append(batch)  # one long group goes on
            continue
        start = int(np.flatnonzero(~pc.equal(batch.column(column), last).to_numpy(zero_copy_only=False)).max(initial=-1)) + 1
        if start or (held and held[-1].column(column)[held[-1].num_rows - 1] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, start)] if start else held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def rankings(queries: DataFrame, chunks: DataFrame, k: int, lexical: bool = True, dense: bool = True, metric: str = "cosine") -> DataFrame:
    """(kind, query_id, rank, score, example_id, pos): of every question the k best chunks of its report by BM25 and by vectors.

    ``queries`` has query_id, example_id, question and v, ``chunks`` example_id, pos, content and v (v for vectors only).
    With the metric ``l2`` the score is a squared distance, small ones first.
    """
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, is_chunk: bool, content: str, *ids: str) -> DataFrame:
        types = {"query_id": queries.schema["query_id"].dataType, "pos": chunks.schema["pos"].dataType}
        columns = [F.col(c).cast(t).alias(c) if c in ids else F.lit(None).cast(t).alias(c) for c, t in types.items()]
        tokens = F.coalesce(text.tokenize(F.col(content)), none) if lexical else none
        v = F.col("v").cast("array<double>") if dense else F.lit(None).cast("array<double>")
        return df.where(F.col("example_id").isNotNull()).select("example_id", F.lit(is_chunk).alias("is_chunk"), *columns, tokens.alias("tokens"), v.alias("v"))

    both = rows(queries, False, "question", "query_id").unionByName(rows(chunks, True, "content", "pos"))
    both = both.repartition("example_id").sortWithinPartitions("example_id", "is_chunk", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "example_id"):
            block = _Block(table)
            if not len(block.query_rows):
                continue
            if lexical:
                yield from block.best(block.lexical(), k, True, LEXICAL)
            if dense:
                yield from block.best(block.dense(metric), k, metric == "cosine", DENSE)

    schema = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("example_id", chunks.schema["example_id"].dataType), T.StructField("pos", chunks.schema["pos"].dataType)]
    )
    return both.mapInArrow(run, schema)


def search(queries: DataFrame, chunks: DataFrame, k: int, kind: str, metric: str = "cosine") -> DataFrame:
    """One of the two rankings: (query_id, rank, score, example_id, pos)."""
    return rankings(queries, chunks, k, kind == LEXICAL, kind == DENSE, metric).drop("kind")
