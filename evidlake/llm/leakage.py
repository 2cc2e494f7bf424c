"""Evaluation texts leaking into training text: Wu-Manber search over words.

Patterns are all runs of ``run`` consecutive words of the items; a document gives
an item away if one of them occurs in it. The alphabet is words, a block is three
words. SHIFT tells for a block how far the window may jump, because no pattern
ends nearer after it; unknown blocks jump ``run - 2`` words, so most words of a
document are never looked up. Where SHIFT is zero, the bucket of the suffix block
selects the patterns with the same first block, and direct comparison of all
words confirms them.

The tables go to the executors as a broadcast of bounded size: about 130 bytes a word of
the items (numbers in arrays, one table of blocks), items being taken in blocks of at
most ``MAX_WORDS`` words (one item may exceed it), each a pass over the documents. Documents never meet each other; there is no shuffle but the final
distinct of the few hits.

Cases: null and empty texts and items shorter than ``run`` words have no
hits; texts are searched whole; repeated ids give one row per pair; two items that
share a passage are both reported; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 13
BLOCK = 3
MAX_WORDS = 500_000

# Characters without a print of their own besides category Cf and control characters.
_UNPRINTED = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
_DIVIDED = re.compile(r"(?<=[^\W_])[-\u2010\u00ad][ \t\u200b]*(?:\r\n|[\n\r\u2028\x0b\x0c\x85])[\s>|]*(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile("[^\t\n\x0b\x0c\r -~]")


class _Drop(dict):
    """Translation table: None for characters that print nothing."""

    def __missing__(self, code: int) -> int | None:
        ch = chr(code)
        gone = code in _UNPRINTED_SET or unicodedata.category(ch) == "Cf" or (unicodedata.category(ch) == "Cc" and not ch.isspace())
        self[code] = None if gone else code
        return self[code]


_UNPRINTED_SET = frozenset(_UNPRINTED)
_DROP = _Drop()


def printed(text: str) -> str:
    """The text after compatibility normalisation, without unprinted characters and divisions at line ends."""
    if _ODD.search(text):
        text = _DIVIDED.sub("", unicodedata.normalize("NFKC", text)).translate(_DROP)
        text = unicodedata.normalize("NFKC", text)
    return _DIVIDED.sub("", text)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, case folded, of the printed text."""
    return _WORD.findall(printed(text).casefold()) if text else []


class Patterns:
    """SHIFT and suffix-hash tables for the runs of some items.

    ``block`` holds for the number of a block of words how far the window may jump or, where a run
    ends with the block, minus the number of its suffix bucket; ``ends`` are the buckets'
    borders in ``starts``, the places in ``words`` where their runs begin.
    """

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN) -> None:
        self.run, self.jump = run, run - BLOCK + 1
        self.number: dict[str, int] = {}
        self.windows: dict[int, int] = {}
        parts, owners, places = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], dtype=np.int32)
            self.windows[item] = max(self.windows.get(item, 0), len(ids) - run + 1)
            if len(ids) >= run:
                parts.append(ids), owners.append(np.full(len(ids), item, dtype=np.int64)), places.append(np.arange(len(ids)))
        self.words, self.owner, place = np.concatenate(parts), np.concatenate(owners), np.concatenate(places)
        self.base = len(self.number) + 1
        w = self.words.astype(np.int64)
        first = np.flatnonzero(place[: max(len(w) - BLOCK + 1, 0)] <= place[BLOCK - 1 :] - BLOCK + 1) if len(w) else np.zeros(0, dtype=np.int64)  # blocks do not reach into the next item
        key = (w[first] * self.base + w[first + 1]) * self.base + w[first + 2]
        far = np.maximum(run - BLOCK - place[first], 0)  # no run ends nearer after the block
        blocks, inverse = np.unique(key, return_inverse=True)
        least = np.full(len(blocks), self.jump)
        np.minimum.at(least, inverse, far)
        last = far == 0
        order = np.argsort(inverse[last], kind="stable")
        bucket, sizes = np.unique(inverse[last], return_counts=True)
        self.starts, self.ends = (first[last] - (run - BLOCK))[order], np.concatenate([[0], np.cumsum(sizes)])
        least[bucket] = -np.arange(1, len(bucket) + 1)
        self.block = dict(zip(blocks.tolist(), least.tolist()))

    def find(self, text: list[str]) -> dict[int, set[tuple[int, ...]]]:
        """item -> the distinct runs of it that occur."""
        hits: dict[int, set[tuple[int, ...]]] = {}
        number, block, jump, run, base = self.number.get, self.block.get, self.jump, self.run, self.base
        at, end = run - 1, len(text)
        while at < end:
            c = number(text[at], -1)
            if c < 0:  # no pattern holds this word: none ends before it is passed
                at += run
                continue
            step = block((number(text[at - 2], -1) * base + number(text[at - 1], -1)) * base + c, jump)
            if step > 0:
                at += step
                continue
            window = [number(w, -1) for w in text[at - run + 1 : at + 1]]
            for start in self.starts[self.ends[-step - 1] : self.ends[-step]].tolist():
                if self.words[start : start + run].tolist() == window:
                    hits.setdefault(int(self.owner[start]), set()).add(tuple(window))
            at += 1
        return hits


_SCHEMA = "doc_id long, item_id long, runs int, item_runs int"


def _blocks(items: DataFrame, max_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (4 * max_words)))
    for b in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_id, runs (distinct runs of the item in the document), item_runs (runs of the item).

    ``documents`` has doc_id and text, ``items`` item_id and text.
    """
    spark, out = documents.sparkSession, None
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    for block in _blocks(items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text"), max_words):
        shared = spark.sparkContext.broadcast(Patterns(block, run))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            for batch in batches:
                rows: list[tuple[int, int, int, int]] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for item, found in patterns.find(words(text.as_py())).items():
                        rows.append((doc_id, item, len(found), patterns.windows[item]))
                d, i, r, w = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(r, pa.int32()), pa.array(w, pa.int32())], names=["doc_id", "item_id", "runs", "item_runs"])

        found = docs.mapInArrow(search, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("runs").alias("runs"), F.max("item_runs").alias("item_runs"))
