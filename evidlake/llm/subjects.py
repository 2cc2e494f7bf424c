"""Subject areas of documents by interpolated n-gram language models.

Every subject and the background have a bigram model of words, interpolated with
a unigram model and that with the words of all training texts (Dirichlet
weights). A sentence is of a subject if its per-token cross-entropy under the
background model exceeds that under the subject's model by more than the
subject's margin, and under no other subject's by more. A document has every
subject that takes at least a quarter of its sentences, so none, one or several.

Labels name subjects of whole documents, some wrongly, and not all; a labelled
document is a mixture of background and subject sentences. So the models are
fitted by expectation maximisation: sentence weights from the models and the
document's own mixture (which starts at its labels), models from the weights. A
fifth of the labelled documents is held out, and on it each margin is set where
labelled and other documents part best (Youden's J, lower end of its plateau).

The fit sees at most ``MAX_DOCUMENTS`` labelled documents of at most ``MAX_CHARS``
characters together (chosen by hash of the id) and runs on the driver; the
models (words and pairs seen in the sample, so bounded too) go out as a broadcast.
All documents are scored, whole, in Arrow batches without a shuffle.

Cases: null or empty texts and texts of headings and table lines only have no
sentences and no subject; labels for unknown documents or subjects, and null ones,
are ignored; a subject without labels is fitted from its description; without any
labels or subjects the result is empty or rests on the descriptions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .leakage import printed

MAX_DOCUMENTS = 20_000
MAX_CHARS = 64_000_000
ROUNDS = 8
SHARE = 0.25

#: counts that the unigram model weighs in the background's bigram model, and that shrink a ratio
BACKOFF, SHRINK = 4.0, 1.0
#: weight of a subject's own model
OWN = 0.7
#: standard deviations above chance, and times the odds of chance, from which a word or pair tells of a subject
TIED, OFTEN = 4.0, 6.0

_TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,]*")
_END = re.compile(r"(?<=[.!?…])[\"'”»’)\]]*\s+(?=[^\W_a-zà-ÿ]|[\"“«„¿¡(\[$€£])")
_CLOSED = re.compile(r"[.!?…][\"'”»’)\]]*$")
_COLUMNS = re.compile(r"\||\t| {2,}|\.{3}|…")


def sentences(text: str | None) -> list[str]:
    """Sentences without headings and table lines; lines broken inside a sentence are joined."""
    if not text:
        return []
    out: list[str] = []
    open_lines: list[str] = []
    for line in [*printed(text).split("\n"), ""]:
        line = line.strip()
        whole = bool(_CLOSED.search(line))
        if line and not whole and (_COLUMNS.search(line) and any(ch.isdigit() for ch in line)):
            line = ""
        if line and (whole or open_lines or len(line.split()) > 5):
            open_lines.append(line)
        if open_lines and (whole or not line):
            block = " ".join(open_lines)
            open_lines = []
            parts = [s for s in _END.split(block) if s]
            if _CLOSED.search(block) or len(parts) > 1 or len(block.split()) > 8:
                out += parts
    return out


def tokens(sentence: str) -> list[str]:
    return ["#" if t[0].isdigit() else t for t in _TOKEN.findall(sentence.casefold())]


def subject_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


class SubjectModels:
    """Fitted models: per-token gains of each subject's model over the backgrounds, for pairs and words.

    A subject's own bigram model is the ratio to the background that its weighted counts
    show, shrunk towards the unigram ratio and that towards one. A token of a subject's
    sentence comes from the subject's own model (weight ``OWN``) or from the background.
    """

    def __init__(self, subjects: list[str]) -> None:
        self.subjects = subjects
        self.word: dict[str, int] = {}
        self.margin = np.full(len(subjects), 0.1)

    def _encode(self, lists: list[list[str]], grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word ids, history ids, sentence numbers); unknown words are -1, before the first word stands -2."""
        number = (lambda w: self.word.setdefault(w, len(self.word))) if grow else (lambda w: self.word.get(w, -1))
        ids = np.fromiter((number(w) for s in lists for w in s), dtype=np.int64, count=sum(map(len, lists)))
        at = np.repeat(np.arange(len(lists)), [len(s) for s in lists])
        before = np.empty_like(ids)
        if len(ids):
            before[1:], before[0] = ids[:-1], -2
            before[1:][at[1:] != at[:-1]] = -2
        return ids, before, at

    def fit(self, docs: list[tuple[list[list[str]], list[int]]], seeds: list[list[str]], rounds: int = ROUNDS) -> None:
        """``docs``: (token lists of the sentences, numbers of the labelled subjects); ``seeds``: words of each subject's description."""
        k = len(self.subjects)
        lists = [s for sents, _ in docs for s in sents] + seeds
        doc_of = np.repeat(np.arange(len(docs) + len(seeds)), [len(s) for s, _ in docs] + [1] * len(seeds))
        ids, before, at = self._encode(lists, True)
        v, n = len(self.word), len(lists)
        before[before < 0] = v
        pair, pair_of = np.unique(before * max(v, 1) + ids, return_inverse=True)
        start = np.full((len(docs) + len(seeds), k + 1), 0.05 / (k + 1))  # the last is the background
        for d, (_, labels) in enumerate(docs):
            start[d, labels] += 0.45 / max(1, len(labels))
            start[d, -1] += 0.5
        for s in range(len(seeds)):
            start[len(docs) + s, s] = 1e3
        start /= start.sum(axis=1, keepdims=True)
        history, word = pair // max(v, 1), pair % max(v, 1)
        n_word, n_history, n_pair = np.bincount(ids, minlength=v), np.bincount(before, minlength=v + 1), np.bincount(pair_of, minlength=len(pair))
        p_word = n_word / max(1, n_word.sum())
        p_pair = (n_pair + BACKOFF * p_word[word]) / (n_history[history] + BACKOFF)
        length = np.bincount(at, minlength=n)
        full, starts = length > 0, (np.cumsum(length) - length)[length > 0]
        tied_word, tied_pair = self._tied(ids, v, doc_of[at], docs, k), self._tied(pair_of, len(pair), doc_of[at], docs, k)
        tied_word[[self.word[w] for seed in seeds for w in seed]] |= np.array([[w in set(seed) for seed in seeds] for s in seeds for w in s], dtype=bool) if k else False
        weight, prior, own = start[doc_of], np.log(start)[doc_of], np.ones((len(pair), k))
        for _ in range(rounds):
            by_word, by_pair = np.empty((v, k)), np.empty((len(pair), k))
            for s in range(k):
                w = weight[at, s] * own[pair_of, s]
                c_word = np.bincount(ids, weights=w, minlength=v)
                c_history = np.bincount(before, weights=w, minlength=v + 1)
                c_pair = np.bincount(pair_of, weights=w, minlength=len(pair))
                by_word[:, s] = np.where(tied_word[:, s], (c_word + SHRINK) / (c_word.sum() * p_word + SHRINK), 1)
                by_pair[:, s] = np.where(tied_pair[:, s], (c_pair + SHRINK * by_word[word, s]) / (c_history[history] * p_pair + SHRINK), by_word[word, s])
            own = OWN * by_pair / (1 - OWN + OWN * by_pair)
            self.table = self._gain(np.concatenate([by_pair, by_word]))
            score = np.zeros((n, k + 1))
            rows = np.flatnonzero(full)
            for part in np.array_split(np.arange(len(rows)), max(1, len(ids) // 200_000)):
                if len(part):
                    lo, hi = starts[part[0]], starts[part[-1]] + length[rows[part[-1]]]
                    score[rows[part], :k] = np.add.reduceat(self.table[pair_of[lo:hi]], starts[part] - lo, axis=0)
            score += prior
            score -= score.max(axis=1, keepdims=True) if n else 0
            weight = np.exp(score)
            weight /= weight.sum(axis=1, keepdims=True)
        self.pair, self.v = pair, v

    @staticmethod
    def _tied(items: np.ndarray, size: int, doc: np.ndarray, docs: list[tuple[list[list[str]], list[int]]], k: int) -> np.ndarray:
        """Which words or pairs stand in a subject's documents more often than chance has it; only these tell of it."""
        n = max(1, len(docs))
        labelled = doc < len(docs)
        where = np.unique(items[labelled] * n + doc[labelled])
        item, doc = where // n, where % n
        df = np.bincount(item, minlength=size).astype(float)
        out = np.zeros((size, k), dtype=bool)
        for s in range(k):
            has = np.array([s in labels for _, labels in docs], dtype=float)
            share = has.mean() if len(has) else 0.0
            expected = df * share
            seen = np.bincount(item, weights=has[doc], minlength=size) if len(item) else np.zeros(size)
            odds = (seen + 0.5) * (1 - share) > OFTEN * (df - seen + 0.5) * share
            out[:, s] = ((seen - expected) / np.sqrt(expected * (1 - share) + 0.25) > TIED) & odds
        return out

    @staticmethod
    def _gain(ratio: np.ndarray) -> np.ndarray:
        """log p(subject) - log p(background); backgrounds are all texts, and the mean of all subjects."""
        mixed = 1 - OWN + OWN * ratio
        return (np.log(mixed) - np.log(np.maximum(1, mixed.mean(axis=1, keepdims=True)))).astype(np.float32)

    def gains(self, lists: list[list[str]]) -> np.ndarray:
        """Per-token gain in cross-entropy over the backgrounds, sentences by subjects."""
        out = np.zeros((len(lists), len(self.subjects)), dtype=np.float32)
        ids, before, at = self._encode(lists, False)
        length = np.bincount(at, minlength=len(lists)).astype(np.float32)
        known = ids >= 0
        ids, before, at = ids[known], before[known], at[known]
        if not len(ids) or not len(self.pair):
            return out
        history = np.where(before == -2, self.v, before)
        code = np.where(history >= 0, history * self.v + ids, -1)
        place = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        each = self.table[np.where(self.pair[place] == code, place, len(self.pair) + ids)]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.add.reduceat(each, first, axis=0)
        return out / np.maximum(length, 1)[:, None]

    def shares(self, docs: list[list[list[str]]], margin: np.ndarray | None = None, gains: np.ndarray | None = None) -> np.ndarray:
        """Share of the sentences of each subject, documents by subjects."""
        count = np.array([len(d) for d in docs])
        gains = self.gains([s for d in docs for s in d]) if gains is None else gains
        out = np.zeros((len(docs), len(self.subjects)))
        if not len(gains) or not len(self.subjects):
            return out
        best = gains.argmax(axis=1)
        taken = gains[np.arange(len(gains)), best] > (self.margin if margin is None else margin)[best]
        doc = np.repeat(np.arange(len(docs)), count)
        np.add.at(out, (doc[taken], best[taken]), 1)
        return out / np.maximum(count, 1)[:, None]

    def calibrate(self, held: list[tuple[list[list[str]], list[int]]]) -> None:
        """Margins that part held-out documents with a label from those with others."""
        if not held or not self.subjects:
            return
        docs = [d for d, _ in held]
        gains = self.gains([s for d in docs for s in d])
        has = np.zeros((len(held), len(self.subjects)), dtype=bool)
        for i, (_, labels) in enumerate(held):
            has[i, labels] = True
        grid = np.linspace(0.03, 0.3, 28)
        j = np.zeros((len(grid), len(self.subjects)))
        for g, m in enumerate(grid):
            yes = self.shares(docs, np.full(len(self.subjects), m), gains) >= SHARE
            j[g] = (yes & has).sum(axis=0) / np.maximum(has.sum(axis=0), 1) - (yes & ~has).sum(axis=0) / np.maximum((~has).sum(axis=0), 1)
        common = j.mean(axis=1)
        for s in range(len(self.subjects)):
            # few held-out labels: lean on all subjects together
            mixed = (j[:, s] * has[:, s].sum() + common * 20) / (has[:, s].sum() + 20)
            self.margin[s] = grid[np.flatnonzero(mixed >= mixed.max() - 0.005)[0]]


def _training(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_documents: int, max_chars: int) -> tuple[list[str], list[tuple[list[list[str]], list[int]]], list[list[str]]]:
    named = areas.where(F.col("subject").isNotNull()).select(F.col("subject"), F.coalesce(F.col("description"), F.lit("")).alias("description")).orderBy("subject").collect()
    subjects = [r[0] for r in named]
    number = {re.sub(r"[\W_]+", "", s.casefold()): i for i, s in enumerate(subjects)}
    keyed = labels.where(F.col("doc_id").isNotNull()).select("doc_id", subject_key(F.col("subject")).alias("key")).where(F.col("key").isin(list(number)))
    picked = keyed.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).orderBy(F.xxhash64("doc_id")).limit(max_documents)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = materialize(texts, "labelled")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > max_chars:
        part = int(1000 * max_chars / size)
        texts = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("chars")), F.lit(1000)) < part)
    rows = texts.orderBy("doc_id").collect()
    docs = [([tokens(s) for s in sentences(r["text"])], [number[k] for k in r["keys"]]) for r in rows]
    return subjects, docs, [tokens(f"{r[0].replace('_', ' ')} {r[1]}") for r in named]


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_CHARS) -> SubjectModels:
    """Models and margins from labelled documents: fitted on four fifths, calibrated on the rest, fitted again on all."""
    subjects, docs, seeds = _training(documents, labels, areas, max_documents, max_chars)
    models = SubjectModels(subjects)
    if not subjects:
        return models
    kept, held = [d for i, d in enumerate(docs) if i % 5], docs[::5]
    models.fit(kept, seeds)
    models.calibrate(held)
    final = SubjectModels(subjects)
    final.fit(docs, seeds)
    final.margin = models.margin
    return final


def document_shares(documents: DataFrame, models: SubjectModels) -> DataFrame:
    """doc_id, subject, share, sentences: every subject with a sentence in the document."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                docs = [[tokens(s) for s in sentences(t)] for t in part.column(1).to_pylist()]
                share = models.shares(docs)
                d, s = np.nonzero(share)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"doc_id": ids[d].astype("int64"), "subject": np.array(models.subjects, dtype=object)[s], "share": share[d, s], "sentences": np.array([len(x) for x in docs], dtype="int64")[d]}),
                    schema=pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64()), ("sentences", pa.int64())]), preserve_index=False,
                )

    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    if not models.subjects:
        docs = docs.where(F.lit(False))
    return docs.mapInArrow(score, "doc_id long, subject string, share double, sentences long")


def subjects_of(shares: DataFrame, least: float = SHARE) -> DataFrame:
    return shares.where(F.col("share") >= least).select("doc_id", "subject")
