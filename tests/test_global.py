"""Queries over the whole corpus against searches in plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidlake.functions import text as T
from evidlake.operators import evaluation, ranking, routing
from evidlake.plans import reference

RESULT = "query_id string, rank int, score double, example_id string, pos int"


def tokens(t):
    return re.findall(T.TOKEN, (t or "").lower())


def best(scores, keys, k):
    top = sorted(range(len(keys)), key=lambda i: (-round(scores[i], 9), keys[i]))[:k]
    return [(keys[i], scores[i]) for i in top]


class Corpus:
    """Every chunk of every report; a query sees them all."""

    def __init__(self, spark, root):
        self.root, self.spark, self.chunks = root, spark, reference._corpus(spark, root)
        self.questions = reference._questions(spark, root)
        self.rows = {(r.example_id, r.pos): r for r in self.chunks.collect()}
        self.asked = {r.query_id: r.question for r in self.questions.collect()}
        self.route = {r.query_id: r.r for r in self.questions.select("query_id", routing.resolve(F.coalesce("question", F.lit("")), "adaptive", 10, 30, 0).alias("r")).collect()}
        self.gold = {}
        for r in evaluation.gold_rows(reference._examples(spark, root)).collect():
            self.gold.setdefault(r.query_id, set()).add(r.gold_id)
        self.keys = list(self.rows)
        docs = [tokens(self.rows[k].content) for k in self.keys]
        self.tf, self.dl = [Counter(d) for d in docs], [len(d) for d in docs]
        df = Counter(t for c in self.tf for t in c)
        idf = {t: math.log(len(docs) - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
        mean = sum(idf.values()) / len(idf)
        self.idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
        self.vectors = [self.vector(d) for d in docs]

    @staticmethod
    def vector(found):
        return Counter(int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 64 for t in found)

    def bm25(self, question, k):
        avg, q = sum(self.dl) / len(self.dl), tokens(question)
        return best([sum(self.idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / avg)) for t in q if t in c) for c, n in zip(self.tf, self.dl)], self.keys, k)

    def dense(self, question, k):
        q = self.vector(tokens(question))
        size = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return best([sum(q[i] * v[i] for i in q) / ((size(q) * size(v)) or 1) for v in self.vectors], self.keys, k)

    def seeds(self, question, method, k):
        if method != "hybrid":
            return getattr(self, method)(question, k)
        score, first = {}, {}
        for no, ranking_ in enumerate((self.dense(question, 30), self.bm25(question, 30))):
            for rank, (key, _) in enumerate(ranking_, 1):
                score[key] = score.get(key, 0) + 1 / (60 + rank)
                first.setdefault(key, (no, rank))
        return [(x, score[x]) for x in sorted(score, key=lambda x: (-round(score[x], 12), first[x]))[:k]]

    def widened(self, found):
        place = {(r.example_id, r.section, r.row_index): key for key, r in self.rows.items()}
        out = dict(found)
        for key, score in found:
            r = self.rows[key]
            for d in (-1, 1):
                if r.row_index is not None and (r.example_id, r.section, r.row_index + d) in place:
                    out.setdefault(place[r.example_id, r.section, r.row_index + d], score)
        return list(out.items())

    def retrieve(self, method, rerank=False, k=10):
        """query_id -> [((example_id, pos), score)]"""
        of = {q: r for q, r in self.route.items() if r.related}
        used = {q: r.method if method == "adaptive" else method for q, r in of.items()}
        out = {q: self.seeds(self.asked[q], used[q], 30 if rerank else k) for q in of}
        if rerank:
            rows = [(q, i, float(s), *key) for q, found in out.items() for i, (key, s) in enumerate(found, 1)]
            done = ranking.rerank(self.spark.createDataFrame(rows, RESULT), self.questions, self.chunks, k).orderBy("query_id", "rank").collect()
            out = {q: [] for q in of}
            for r in done:
                out[r.query_id].append(((r.example_id, r.pos), r.score))
        return {q: self.widened(found) if method == "adaptive" and of[q].window else found for q, found in out.items()}

    def metrics(self, found):
        """Mean reciprocal rank, hit and recall at the cutoffs; ranks are of chunks."""
        total = Counter()
        for q in self.asked:
            at = {}
            for rank, (key, _) in enumerate(found.get(q, []), 1):
                for s in self.rows[key].source_ids:
                    at.setdefault(f"{key[0]}::{s}", rank)
            ranks = [at[g] for g in self.gold.get(q, ()) if g in at]
            total["reciprocal_rank"] += 1 / min(ranks) if ranks else 0
            for k in (1, 3, 5, 10):
                n = sum(r <= k for r in ranks)
                total[f"hit_{k}"] += n > 0
                total[f"recall_{k}"] += n / len(self.gold[q]) if n else 0
        return {c: v / len(self.asked) for c, v in total.items()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two dozen reports; every second question repeats its evidence, so that some are found among all reports."""
    root = str(tmp_path_factory.mktemp("small"))
    few = spark.read.parquet("/root/testdata/sf0.001/examples.parquet").orderBy("example_id", "loaded_at").limit(24)
    says = F.concat_ws(" ", "question", F.get(F.map_values("gold_evidence"), F.lit(0)))
    few.withColumn("question", F.when(F.pmod(F.crc32("example_id"), F.lit(2)) == 0, says).otherwise(F.col("question"))).coalesce(1).write.parquet(f"{root}/examples.parquet")
    return Corpus(spark, root)


def test_experiment_grid_is_of_the_whole_corpus(spark, corpus):
    got = {(r.method, r.rerank): r.asDict() for r in reference.experiment_grid(spark, corpus.root).collect()}
    assert len(got) == 8 and all(0 < row["hit_5"] < 1 for row in got.values())
    for (method, rerank), row in got.items():
        assert row["examples"] == len(corpus.asked)
        assert {c: row[c] for c in row if c not in ("method", "rerank", "examples")} == pytest.approx(corpus.metrics(corpus.retrieve(method, rerank)), abs=2e-6), (method, rerank)


def test_adaptive_retrieval_of_the_whole_corpus(spark, corpus):
    got = {}
    for r in reference.adaptive_retrieval_corpus(spark, corpus.root).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.example_id, r.pos))
    assert got == {q: [key for key, _ in found] for q, found in corpus.retrieve("adaptive").items()}
    assert any(key[0] != q for q, keys in got.items() for key in keys)


def test_answers_of_the_whole_corpus(spark, corpus):
    got = {r.query_id: r for r in reference.offline_answers_corpus(spark, corpus.root).collect()}
    want = corpus.retrieve("adaptive", True)
    assert set(got) == set(corpus.asked) and {q for q, r in got.items() if r.route_method and not r.insufficient_evidence} <= set(want)
    first = {q: r.cited for q, r in got.items() if q in want and not r.corrected}
    assert first and first == {q: corpus.rows[want[q][0][0]].chunk_id for q in first}
    assert any(not cited.startswith(f"{q}::") for q, cited in first.items())


def test_corrective_retrieval_of_the_whole_corpus(spark, corpus):
    got = {r.query_id: r for r in reference.corrective_retrieval_corpus(spark, corpus.root).collect()}
    first = {q: found for q, found in corpus.retrieve("bm25", k=3).items()}
    rows = [(q, i, float(s), *key) for q, found in first.items() for i, (key, s) in enumerate(found, 1)]
    grades = {r.query_id: r for r in ranking.grade(corpus.questions, spark.createDataFrame(rows, RESULT), corpus.chunks).collect()}
    assert set(got) == set(grades)
    for q, r in got.items():
        if r.corrected:
            assert not grades[q].sufficient and r.confidence >= grades[q].confidence
        else:
            assert (r.sufficient, r.confidence, r.results) == (grades[q].sufficient, grades[q].confidence, len(first.get(q, [])))
