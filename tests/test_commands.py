import json

import pytest

from pyspark.sql import functions as F

from evidlake import __main__ as commands
from evidlake.operators import evaluation
from evidlake.plans import pipeline
from evidlake.sources import artifacts
from evidlake.streaming import questions


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    record = lambda i, q: {
        "id": f"E{i}", "filename": "f", "pre_text": ["net revenue rose to $ 5 million", ""], "table": [["item", "2008"], ["revenue", "100"], ["cost", "7"]], "post_text": ["costs fell"],
        "qa": {"question": q, "answer": "100", "gold_inds": {"table_1": "x"}, "exe_ans": "100"},
    }
    (root / "r.json").write_text(json.dumps([record(0, "what was revenue in 2008?"), record(1, "what is the weather right now?")]))
    commands.main(["index", "--dataset", str(root / "r.json"), "--index", str(root / "i")])
    return root


def run(index, command, *more):
    out = str(index / f"out-{command}")
    commands.main([command, "--dataset", str(index / "r.json"), "--index", str(index / "i"), "--output", out, *more])
    return out


def test_retrieve_and_answer(spark, index):
    r = spark.read.parquet(run(index, "retrieve", "--query", "cost 7", "--allowed-example-id", "E0", "--method", "bm25", "--top-k", "2", "--show-route")).collect()
    assert [x.chunk_id for x in sorted(r, key=lambda x: x["rank"])][0] == "E0::table::2"
    assert spark.read.parquet(run(index, "rewrite", "--query", 'the "net revenue" in 2008')).first().query == "net revenue 2008 net revenue"
    assert spark.read.parquet(run(index, "grade", "--query", "what was revenue in 2008?")).first().sufficient is not None
    a = {x.query_id: x for x in spark.read.parquet(run(index, "answer", "--method", "adaptive", "--use-evidence-grader")).collect()}
    assert a["E1"].answer == "Insufficient evidence" and a["E0"].cited


def test_evaluate(spark, index, capsys):
    failures = run(index, "evaluate", "--method", "bm25", "--grader-output", str(index / "graded"))
    assert "reciprocal_rank" in capsys.readouterr().out
    assert artifacts.load_csv(spark, failures).columns == ["example_id", "question", "gold_ids", "retrieved_ids"]
    graded = artifacts.load_csv(spark, str(index / "graded")).collect()
    assert len(graded) == 2 and len(graded[0]) == 12 and {r.has_any_gold_evidence for r in graded} == {"True"}


def test_evaluate_answers_and_errors(spark, index, capsys):
    lines = run(index, "evaluate-answers", "--method", "bm25", "--use-evidence-grader")
    rows = artifacts.load_csv(spark, lines)
    assert rows.columns == evaluation.PREDICTION and rows.count() == 2 and "citation_validity" in capsys.readouterr().out
    assert {r.used_evidence_grader for r in rows.collect()} == {"True"}
    classes = run(index, "errors", "--predictions", lines)
    assert "failure_category" in capsys.readouterr().out and artifacts.load_csv(spark, classes).count() == 2


def test_stored_metric_and_vectors_are_used(spark, index, tmp_path):
    i = artifacts.load_index(spark, str(index / "i"))
    chunks = i.chunks
    for metric in ("cosine", "l2"):
        v = chunks.select("example_id", "pos", F.when(F.col("section") == "table", F.array(F.lit(2.0), F.lit(0.1))).otherwise(F.array(F.lit(0.5), F.lit(0.0))).alias("v"))

        class Fixed:
            def embed(self, df, text, out):
                assert text == "question"  # the corpus is not embedded again
                return df.withColumn(out, F.array(F.lit(1.0), F.lit(0.0)))

        q = spark.createDataFrame([("q", "E0", "what?")], "query_id string, example_id string, question string")
        for scope in ("example", "global"):
            r = pipeline.retrieve(q, chunks, pipeline.Settings("dense", 1, scope=scope, metric=metric, embedder=Fixed(), vectors=v)).join(chunks, ["example_id", "pos"]).first()
            assert r.section != "table" and round(r.score, 6) == (1.0 if metric == "cosine" else 0.25)
    assert (i.metric, i.dims, i.model) == ("cosine", 64, "hashed-64")
    artifacts.save_chunks(chunks.limit(1), str(tmp_path / "chunks")), artifacts.save_vectors(artifacts.load_vectors(spark, str(index / "i" / "vectors")), str(tmp_path / "vectors"))
    artifacts.save_metadata(artifacts.load_vectors(spark, str(tmp_path / "vectors")), str(tmp_path / "metadata"), "m", "l2")
    with pytest.raises(ValueError, match="vector count"):
        artifacts.load_index(spark, str(tmp_path))


def test_stream(spark, index, tmp_path):
    chunks = artifacts.load_chunks(spark, str(index / "i" / "chunks"))
    schema = "query_id string, example_id string, question string"
    for n in range(2):
        spark.createDataFrame([(f"q{n}", "E0", "what was revenue in 2008?")] * 2, schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = questions.answer_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), chunks, pipeline.Settings("bm25"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["q0", "q1"]
