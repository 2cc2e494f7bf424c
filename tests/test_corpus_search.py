"""Search over a corpus: what many queries ask is searched once, what is passed over is no result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from evidlake.operators import dense, lexical, ranking, topk
from evidlake.plans import pipeline


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.example_id, r.pos, round(r.score, 9)) for r in df.collect())


def asked_once(monkeypatch, module):
    """Sizes of the blocks that go out."""
    sizes, blocks = [], module.blocks

    def watched(*a):
        for part in blocks(*a):
            sizes.append(len(part))
            yield part

    monkeypatch.setattr(module, "blocks", watched)
    return sizes


def test_equal_questions_are_searched_once(spark, monkeypatch):
    sizes = asked_once(monkeypatch, lexical)
    chunks = spark.createDataFrame([("E", i, t) for i, t in enumerate(["net revenue", "cost of sales", "sales"])], "example_id string, pos int, content string")
    q = spark.range(300).select(F.concat(F.lit("q"), "id").alias("query_id"), F.when(F.col("id") % 3 == 0, "net sales").when(F.col("id") % 3 == 1, "Sales, net").otherwise("cost").alias("question"))
    got = rows_of(lexical.search_corpus(q, chunks, 2))
    assert sizes == [2] and len(got) == 600 and [r[1:4] for r in got if r[0] == "q0"] == [r[1:4] for r in got if r[0] == "q1"] and [r[3] for r in got if r[0] == "q2"] == [1, 0]


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    sizes = asked_once(monkeypatch, dense)
    v = spark.createDataFrame([("A", i, [float(i), 1.0]) for i in range(4)], "example_id string, pos int, v array<float>")
    q = spark.range(200).select(F.col("id").cast("string").alias("query_id"), F.array(F.col("id") % 2, F.lit(1)).cast("array<float>").alias("v"))
    got = rows_of(dense.search_corpus(q, v, 1))
    assert sizes == [2] and [r[3] for r in got if r[0] in ("0", "1")] == [0, 1] and len(got) == 200


@pytest.mark.parametrize("k", [1, 7])
def test_blocks_passed_over_hold_no_result(spark, k):
    r = random.Random(k)
    words = [f"w{chr(97 + i)}" for i in range(26)]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(26)], k=n))
    chunks = spark.createDataFrame([(f"E{i % 9}", i, text(r.randint(0, 12))) for i in range(900)], "example_id string, pos int, content string").repartition(3)
    asks = [text(r.randint(0, 6)) for _ in range(40)] + ["none of these", ""]
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asks)], "query_id string, question string")
    docs = [(x.example_id, x.pos, x.content) for x in chunks.collect()]
    posts = lexical.postings(lexical.tokenized(chunks, ["example_id", "pos"]), ["example_id", "pos"])
    stats = lexical.corpus_stats(lexical.tokenized(chunks, []), [])
    idf = {x.term: x.idf for x in lexical.term_stats(posts, stats, []).collect()}
    avg = stats.first().avgdl
    score = lambda a, d: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in a.split() if t in d)
    want = []
    for i, a in enumerate(asks):
        best = sorted((-round(score(a, d[2].split()), 9), d[0], d[1]) for d in docs)[:k]
        want += [(f"q{i}", n, e, p) for n, (_, e, p) in enumerate(best, 1)]
    assert [x[:4] for x in rows_of(lexical.search_corpus(q, chunks, k))] == sorted(want)


def test_retrieval_of_all_reports_asks_each_question_once(spark, monkeypatch):
    sizes = [*map(lambda m: asked_once(monkeypatch, m), (dense, lexical))]
    examples = [(f"E{i}", i, "table", "table", i, [f"table_{i}"], t) for i, t in enumerate(["net revenue 2010", "cost of sales", "sales in 2011"])]
    chunks = spark.createDataFrame(examples, "example_id string, pos int, chunk_type string, section string, row_index int, source_ids array<string>, content string")
    asks = ["what was net revenue in 2010?", "Cost of sales", ""]
    q = spark.createDataFrame([(f"q{i:02}", f"E{i % 3}", asks[i % 3]) for i in range(30)], "query_id string, example_id string, question string")
    for s in (pipeline.Settings("adaptive", scope="global", rerank=True), pipeline.Settings("hybrid", scope="global", top_k=2)):
        got = rows_of(pipeline.retrieve(q, chunks, s))
        each = {i: [r[1:] for r in got if r[0] == f"q{i:02}"] for i in range(30)}
        assert all(each[i] and each[i] == each[i % 3] for i in range(30))
    assert max(map(max, sizes)) <= 3


def test_chunks_equal_in_length_and_known_terms_are_scored_once(spark):
    """Ties of one profile go to the earliest chunks, however many there are, in whichever report."""
    texts = ["net sales of x", "net sales of y", "sales net z of", "net sales", "other words", "more words", "sales of w v"]
    chunks = spark.createDataFrame([(f"E{i % 5}", i, texts[i % 7]) for i in range(700)], "example_id string, pos int, content string").repartition(4)
    q = spark.createDataFrame([("a", "net sales"), ("b", "of sales of"), ("c", "nowhere")], "query_id string, question string")
    got = rows_of(lexical.search_corpus(q, chunks, 4))
    place = lambda *kinds: sorted((f"E{i % 5}", i) for i in range(700) if i % 7 in kinds)[:4]
    assert [r[2:4] for r in got if r[0] == "a"] == place(3) and [r[2:4] for r in got if r[0] == "c"] == place(*range(7))
    assert len({r[4] for r in got if r[0] == "b"}) == 1 and [r[2:4] for r in got if r[0] == "b"] == place(0, 1, 2, 6)


def test_few_pairs_are_scored_exactly():
    """The first bound is close to the k-th best score, so that little more than the k best is scored in double precision."""
    r, terms, k = np.random.default_rng(3), 60, 10
    held = r.random((20000, terms)) < 1 / (2 + np.arange(terms)[::-1])
    row, term = np.nonzero(held)
    weight = r.uniform(0.5, 2, len(row)) * np.linspace(5, 1, terms)[term]
    dense_weights = np.zeros(held.shape)
    dense_weights[row, term] = weight
    asked = np.sort(r.random((300, terms)).argsort(axis=1)[:, :6], axis=1)
    best, rows = topk.Pairs(300, k), lexical._Rows(np.arange(20000), row, term, weight, terms)
    pairs, add = [], best.add
    best.add = lambda q, no, s: (pairs.append(len(q)), add(q, no, s))
    rows.slice(np.repeat(np.arange(300), 6), asked.ravel(), np.ones(1800), 300)
    rows.add(0, best)
    got = best.batch(np.arange(300)).to_pydict()
    scores = np.zeros((300, 20000))
    for i in range(300):
        scores[i] = dense_weights[:, asked[i]].sum(axis=1)
    want = [sorted(range(20000), key=lambda j: (-round(scores[i, j], 9), j))[:k] for i in range(0, 300, 30)]
    assert [[n for q, n in zip(got["query"], got["no"]) if q == i] for i in range(0, 300, 30)] == want
    assert sum(pairs) < 2 * 300 * k


@pytest.mark.parametrize("query", ["reranked_corpus", "evidence_grades_corpus"])
def test_equal_questions_are_ranked_once(spark, monkeypatch, query):
    asked = []
    for name in ("rerank", "grade"):
        whole = getattr(ranking, name)
        monkeypatch.setattr(ranking, name, lambda *a, whole=whole: (asked.append([x for x in a if "question" in getattr(x, "columns", ())][0]), whole(*a))[1])
    root = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()[query](spark, root)
    rows = spark.read.parquet(f"{root}/examples.parquet").where("example_id is not null").select("example_id").distinct()
    assert asked[0].count() == asked[0].select("question").distinct().count() < rows.count() == got.select("query_id").distinct().count()
