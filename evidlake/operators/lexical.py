"""BM25: statistics, search inside a report, search over a whole corpus.

idf(t) = ln(N - df + 0.5) - ln(df + 0.5); where that is negative, EPSILON times the
mean of all idf. A query counts a repeated token as often as it stands there;
unknown tokens add nothing; chunks without any token of the query are ranked too,
with score 0. Ties go to the earlier chunk (example_id, pos).

Search inside a report (see reports) computes statistics of that report alone. Search over
the corpus sees of a chunk its length and its query terms only. Chunks that are equal in these, a
profile, have equal scores for every query: a profile is scored once, and its first k chunks stand for it.
A task holds some profiles, sorted by their rare terms, and a part of a block of distinct queries of bounded size;
blocks of profiles whose bound is below a query's k-th best score are passed over, the others are
scored exactly, and the k best are sent once.

Cases: an empty or null question scores 0 everywhere; a null content has no tokens;
an unknown report or an empty corpus gives no results; repeated chunks are
scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import materialize
from . import reports, topk
from .reports import B, EPSILON, K1
from .topk import DIGITS

QUERY_BLOCK = 1 << 14
#: queries scored at once, profiles held at once, profiles of a block, blocks scored at once, pairs scored at once in double precision
SLICE, ROWS, LEAF, BLOCKS, PAIRS = 256, 1 << 18, 8, 1 << 12, 1 << 17
#: blocks tried for a first bound, and blocks beside each other of which one is tried; bounds held at once
TRIED, CELLS = 32, 1 << 24


def tokenized(chunks: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, tokens)"""
    return chunks.select(*key, F.coalesce(T.tokenize(F.col(content)), F.array().cast("array<string>")).alias("tokens"))


def postings(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, tf, dl) of tokenized chunks"""
    return tokens.select(*key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy(*key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(tokens: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, n, avgdl) of tokenized chunks, one row if ``scope`` is empty."""
    return tokens.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def plain_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def term_stats(posts: DataFrame, stats: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, term, df, idf)"""
    terms = posts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    terms = terms.join(stats, scope) if scope else terms.crossJoin(F.broadcast(stats))  # one row of statistics
    terms = terms.withColumn("plain", plain_idf(F.col("n"), F.col("df")))
    mean = terms.groupBy(*scope).agg(F.avg("plain").alias("mean"))
    terms = terms.join(mean, scope) if scope else terms.crossJoin(F.broadcast(mean))  # one row
    return terms.select(*scope, "term", "df", F.when(F.col("plain") < 0, EPSILON * F.col("mean")).otherwise(F.col("plain")).alias("idf"))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def ranked(scored: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """The k best of every query, with ``rank``; ties to the earlier chunk."""
    s = F.round("score", DIGITS)
    w = Window.partitionBy("query_id").orderBy(s.desc() if descending else s.asc(), "example_id", "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_reports(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, score, example_id, pos) of the k best chunks of the report that a query (query_id, example_id, question) may use."""
    return reports.search(queries, chunks, k, reports.LEXICAL)


def blocks(queries: DataFrame, columns: list[str], size: int = QUERY_BLOCK) -> Iterator[list]:
    """The rows of a query set in blocks of bounded size, by hash of query_id."""
    n = max(1, math.ceil(queries.count() / (size * 0.8)))
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).select(*columns).collect()
        if rows:
            yield rows


def distinct(queries: DataFrame, what: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(queries with ``asks``, distinct values of the column ``what`` with their number as query_id): what several queries ask is searched once."""
    queries = materialize(queries.select("query_id", what), f"{name}_queries")
    asked = materialize(queries.select(what).distinct().withColumn("query_id", F.monotonically_increasing_id()), name)
    return queries.join(asked.withColumnRenamed("query_id", "asks"), what).select("query_id", "asks"), asked


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


class _Rows:
    """Profiles of a task, sorted so that those with the same rare terms stand together, in blocks of LEAF.

    Terms are numbered by rarity. A block's bound for a query takes every term at its largest weight in the block.
    """

    def __init__(self, no: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> None:
        """Postings (row, term, weight) are sorted by row and term."""
        head = np.full((len(no), 6), terms)
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(no)))[row]
        early = place < head.shape[1]
        head[row[early], place[early]] = term[early]
        order = np.lexsort(head.T[::-1])
        self.no, self.terms, self.blocks = no[order], terms, -(-len(no) // LEAF)
        at = np.empty(len(no), dtype=np.int64)
        at[order] = np.arange(len(no))
        again = np.argsort(at[row], kind="stable")
        self.row, self.term, self.weight = at[row][again], term[again], weight[again]
        self.starts = np.searchsorted(self.row, np.arange(self.blocks * LEAF + 1))
        cell = self.term * self.blocks + self.row // LEAF  # by term, so that a slice reads those of its terms only
        by_cell = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[by_cell], prepend=-1))
        self.cell = cell[by_cell][first]
        self.most = np.maximum(np.maximum.reduceat(self.weight[by_cell], first), 0.0) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(self.cell, np.arange(terms + 1) * self.blocks)
        self.largest, self.negative = np.abs(weight).max(initial=0), len(weight) > 0 and weight.min() < 0

    def slice(self, query: np.ndarray, term: np.ndarray, times: np.ndarray, queries: int) -> None:
        """Take up ``queries`` queries, whose terms are (query, term, times)."""
        words = np.unique(term)
        self.word = np.full(self.terms + 1, -1)
        self.word[words] = np.arange(len(words))
        self.asked = np.zeros((queries, len(words)))
        self.asked[query, self.word[term]] = times
        self.single, self.error = self.asked.astype(np.float32), (len(words) + 8) * 2.0**-22  # more than single precision loses
        length = self.cells[words + 1] - self.cells[words]
        at = _ranges(self.cells[words], length)
        most = np.zeros((len(words), self.blocks), dtype=np.float32)
        most[np.repeat(np.arange(len(words)), length), self.cell[at] % max(self.blocks, 1)] = self.most[at]
        self.bound = (self.single * np.float32(1 + self.error)) @ most

    def postings(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``row``, word, weight) of the slice's words in these profiles."""
        hits = self.starts[row + 1] - self.starts[row]
        at = _ranges(self.starts[row], hits)
        word = self.word[self.term[at]]
        known = word >= 0
        return np.repeat(np.arange(len(row)), hits)[known], word[known], self.weight[at[known]]

    def scores(self, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a query and a profile."""
        pair, word, weight = self.postings(row)
        return np.bincount(pair, weight * self.asked[query[pair], word], len(row)).astype(np.float64)

    def single_scores(self, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Scores of all these queries and profiles in single precision."""
        place, word, weight = self.postings(row)
        weights = np.zeros((len(row), self.asked.shape[1]), dtype=np.float32)
        weights[place, word] = weight
        return self.single[query] @ weights.T

    def promising(self, query: np.ndarray, k: int) -> np.ndarray:
        """Profiles that may hold good scores of these queries: of neighbouring blocks the one of the largest bound, TRIED a query; all, if there are few."""
        full, tried = len(self.no) // LEAF, max(TRIED, -(-k // LEAF))
        groups = full // TRIED
        if groups <= 2 * tried:
            return np.arange(full * LEAF)
        bound = self.bound[query, : groups * TRIED].reshape(len(query), groups, TRIED)
        top = np.argpartition(-bound.max(axis=2), tried, axis=1)[:, :tried]
        blocks = np.unique(top * TRIED + np.take_along_axis(bound, top[:, :, None], axis=1).argmax(axis=2))
        return _ranges(blocks * LEAF, np.full(len(blocks), LEAF))

    def add(self, first: int, best: topk.Pairs) -> None:
        """All profiles that may be among the k best of the slice's queries, which begin at ``first``."""
        least = best.least[first : first + len(self.asked)].copy()
        lost = self.error * self.largest * self.asked.sum(axis=1)
        fresh = np.flatnonzero(np.isneginf(least))
        row = self.promising(fresh, best.k) if len(fresh) else fresh
        if len(row) >= best.k > 0:  # the k-th best of some profiles is a bound
            least[fresh] = np.partition(self.single_scores(fresh, row), len(row) - best.k, axis=1)[:, len(row) - best.k] - lost[fresh]
        least -= topk._NEAR + lost
        if not self.negative:  # of profiles without a word of the query, all at 0, the first k are enough
            few = np.flatnonzero(least <= 0)
            least[few] = 1e-30
            early = np.argsort(self.no, kind="stable")[: best.k] if len(few) else np.zeros(0, dtype=np.int64)
            query, row = np.repeat(few, len(early)), np.tile(early, len(few))
            value = self.scores(query, row)
            best.add(query[value == 0] + first, self.no[row[value == 0]], value[value == 0])
        floor = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        blocks = np.flatnonzero((self.bound >= floor[:, None]).any(axis=0))
        for a in range(0, len(blocks), BLOCKS):
            rows = _ranges(blocks[a : a + BLOCKS] * LEAF, np.full(len(blocks[a : a + BLOCKS]), LEAF))
            at = np.flatnonzero(self.single_scores(slice(None), rows) >= floor[:, None])
            query, row = at // len(rows), rows[at % len(rows)]
            query, row = query[row < len(self.no)], row[row < len(self.no)]
            for b in range(0, len(query), PAIRS):
                q, r = query[b : b + PAIRS], row[b : b + PAIRS]
                best.add(q + first, self.no[r], self.scores(q, r))


def _projected(chunks: DataFrame, number: dict[str, int]) -> DataFrame:
    """Per chunk (example_id, pos, dl, bag): its length and its known terms, as sorted numbers; besides rows (term, df) of all terms, to be summed up."""
    tokens = tokenized(chunks, ["example_id", "pos"])
    kinds = {f.name: f.dataType for f in tokens.schema.fields}
    schema = T_.StructType([T_.StructField(n, t) for n, t in (("example_id", kinds["example_id"]), ("pos", kinds["pos"]), ("dl", T_.LongType()), ("bag", T_.BinaryType()), ("term", T_.StringType()), ("df", T_.LongType()))])
    shared = tokens.sparkSession.sparkContext.broadcast(number)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, df, types = shared.value, Counter(), None
        for batch in batches:
            tokens = batch.column(2)
            types = batch.schema.types[:2]
            dl = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
            words = pc.dictionary_encode(tokens.flatten())
            names, each = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(dl)), dl)
            there = np.unique(row * max(len(names), 1) + each) % max(len(names), 1)
            for t, n in zip(names, np.bincount(there, minlength=len(names)).tolist()):
                df[t] += n
            code = np.array([number.get(t, -1) for t in names], dtype=np.int64)[each] if len(names) else each
            row, code = row[code >= 0], code[code >= 0]
            bags = np.sort(row * max(len(number), 1) + code) % max(len(number), 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(dl)))]).astype(np.int32) * _CODE.itemsize
            bag = pa.BinaryArray.from_buffers(pa.binary(), len(dl), [None, pa.py_buffer(ends), pa.py_buffer(bags.astype(_CODE))])
            none = [pa.nulls(len(dl), pa.string()), pa.nulls(len(dl), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dl), bag, *none], names=schema.names)
        if df:
            none = [pa.nulls(len(df), t) for t in (*types, pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(list(df.keys()), pa.string()), pa.array(list(df.values()), pa.int64())], names=schema.names)

    return tokens.mapInArrow(project, schema)


_CODE = np.dtype("<u4")


def search_corpus(queries: DataFrame, chunks: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, score, example_id, pos) of the k best chunks of the corpus for every query."""
    spark = queries.sparkSession
    bags = queries.select(F.col("query_id").cast("string").alias("query_id"), F.array_join(F.array_sort(T.tokenize(F.coalesce("question", F.lit("")))), " ").alias("bag"))
    asks, asked = distinct(bags, "bag", "bags")
    words = materialize(asked.where("bag <> ''").select(F.explode(F.split("bag", " ")).alias("term")).distinct(), "words")
    code = {t: i for i, t in enumerate(sorted(r["term"] for r in words.collect()))}
    seen = materialize(_projected(chunks, code), "projected")
    df = seen.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    rows = topk.numbered(seen.where(F.col("term").isNull()).select("example_id", "pos", "dl", "bag"), "rows")
    n, avgdl = rows.agg(F.count(F.lit(1)), F.avg("dl")).first()
    df = materialize(df, "terms")
    mean = df.agg(F.avg(plain_idf(F.lit(n), F.col("df")))).first()[0] or 0.0
    known = words.join(df, "term").collect()  # no more than the queries' terms
    known.sort(key=lambda r: (r["df"], r["term"]))  # rare terms have small numbers
    plain = [math.log(n - r["df"] + 0.5) - math.log(r["df"] + 0.5) for r in known]
    number = {r["term"]: i for i, r in enumerate(known)}
    rare = np.zeros(len(code), dtype=np.int64)
    rare[[code[t] for t in number]] = np.arange(len(number))
    corpus = spark.sparkContext.broadcast((rare, np.array([EPSILON * mean if v < 0 else v for v in plain]), avgdl))

    w = Window.partitionBy("dl", "bag").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = rows.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= k)
    members = members.withColumn("profile", F.first("no").over(w)).select("profile", "no", "example_id", "pos", "dl", F.when(F.col("place") == 1, F.col("bag")).alias("bag"))
    members = materialize(members, "profiles")
    profiles = members.where(F.col("profile") == F.col("no")).select("no", "dl", "bag")
    held = max(1, math.ceil(profiles.count() / ROWS))
    profiles = profiles.coalesce(held)
    parts = math.ceil(2 * spark.sparkContext.defaultParallelism / (held * max(1, math.ceil(asked.count() / block))))  # each part sorts the profiles again
    out = None
    for part in blocks(asked, ["query_id", "bag"], block):
        counts = [(sorted(Counter(number[t] for t in r["bag"].split() if t in number).items()), r["query_id"]) for r in part]
        counts.sort()  # queries that share rare terms are scored together
        size = max(SLICE, math.ceil(len(counts) / parts))
        for some in (counts[a : a + size] for a in range(0, len(counts), size)):
            sizes = [len(c) for c, _ in some]
            silent = sum(s == 0 for s in sizes)  # these come first; all chunks have the score 0
            terms, times = np.array([t for c, _ in some for t, _ in c], dtype=np.int64), np.array([m for c, _ in some for _, m in c], dtype=np.int64)
            shared = spark.sparkContext.broadcast((np.array([q for _, q in some], dtype=np.int64), silent, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms, times))

            def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, silent, starts, terms, times = shared.value
                rare, idf, avgdl = corpus.value
                best, first = topk.Pairs(len(names), k), np.zeros(0, dtype=np.int64)
                for table in topk.gathered(batches, ROWS):
                    no, dl, bag = table["no"].to_numpy(), table["dl"].to_numpy(), table["bag"].combine_chunks()
                    first = np.sort(np.concatenate([first, no[:k]]))[:k]
                    offsets = np.frombuffer(bag.buffers()[1], np.int32, len(bag) + 1, bag.offset * 4)
                    codes = np.frombuffer(bag.buffers()[2] or b"", _CODE, (offsets[-1] - offsets[0]) // _CODE.itemsize, offsets[0]).astype(np.int64)
                    row = np.repeat(np.arange(len(no)), np.diff(offsets) // _CODE.itemsize)
                    post, tf = np.unique(row * len(idf) + rare[codes], return_counts=True)
                    row, term = post // max(len(idf), 1), post % max(len(idf), 1)
                    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl)) if len(term) else np.zeros(0)
                    held = _Rows(no, row, term, weight, len(idf))
                    a = silent
                    while a < len(names):
                        z = min(a + SLICE, len(names))
                        while z - a > 1 and len(np.unique(terms[starts[a] : starts[z]])) * held.blocks > CELLS:
                            z = (a + z) // 2
                        now = slice(starts[a], starts[z])
                        held.slice(np.repeat(np.arange(z - a), np.diff(starts[a : z + 1])), terms[now], times[now], z - a)
                        held.add(a, best)
                        a = z
                    best.ready()
                best.add(np.repeat(np.arange(silent), len(first)), np.tile(first, silent), np.zeros(silent * len(first)))
                yield best.batch(names)

            found = profiles.mapInArrow(score, topk.FOUND)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], topk.FOUND)
    # the k best profiles, by score and first chunk, hold the k best chunks
    best = topk.best_of(out, k).withColumnRenamed("no", "profile").join(members.select("profile", "no", "example_id", "pos"), "profile")
    return topk.asked_by(topk.best_of(best, k), asks, "asks")
