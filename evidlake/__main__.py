"""Commands: python -m evidlake COMMAND --help (or through spark-submit).

Examples are read from a JSON report file or a parquet table, chunks and
vectors from an index folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, evaluation, ranking, routing
from .plans import pipeline, providers
from .sources import artifacts, reports


def _examples(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.dataset.endswith(".parquet"):
        df = chunking.last_delivered(spark.read.parquet(a.dataset), "example_id", "loaded_at")
        return df.orderBy("example_id").limit(a.limit) if a.limit else df
    return chunking.last_delivered(reports.load_examples(spark, a.dataset, a.limit or None), "example_id", "ord")


def _index(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, pipeline.Settings]:
    """Chunks of the stored index, and settings with its vectors, model and metric."""
    i = artifacts.load_index(spark, a.index)
    return i.chunks, pipeline.Settings(a.method, a.top_k, a.candidate_k, a.neighbor_window, a.rerank, a.scope, providers.HashedEmbedder(i.dims), i.metric, i.vectors)


def _asked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.query:
        if a.scope == "example" and not a.allowed_example_id:
            a.scope = "global"
        return spark.createDataFrame([("query", a.allowed_example_id, a.query)], "query_id string, example_id string, question string")
    return _examples(spark, a).select(F.col("example_id").alias("query_id"), "example_id", "question")


def _out(df: DataFrame, a: argparse.Namespace) -> None:
    if a.output:
        df.write.mode("overwrite").parquet(a.output)
    else:
        df.show(50, truncate=120)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    chunks = artifacts.ensure_chunks(spark, f"{a.index}/chunks", lambda: chunking.chunks(_examples(spark, a)), a.rebuild_chunks, a.limit or None)
    if not a.dry_run:
        artifacts.save_vectors(providers.HashedEmbedder(a.dims).embed(chunks, "content", "embedding"), f"{a.index}/vectors")
        vectors = artifacts.load_vectors(spark, f"{a.index}/vectors")
        artifacts.save_metadata(vectors, f"{a.index}/metadata", f"hashed-{a.dims}", a.metric)
        artifacts.load_index(spark, a.index)
    chunks.groupBy("section").count().show()


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    asked, (chunks, s) = _asked(spark, a), _index(spark, a)
    if a.show_route:
        pipeline.routed(asked, s).select("query_id", "route.*").show(50, truncate=120)
    _out(pipeline.retrieve(asked, chunks, s).join(chunks.select("example_id", "pos", "chunk_id", "content"), ["example_id", "pos"]).orderBy("query_id", "rank"), a)


def rewrite(spark: SparkSession, a: argparse.Namespace) -> None:
    _out(_asked(spark, a).select("query_id", routing.rewrite(F.coalesce("question", F.lit(""))).alias("query")), a)


def grade(spark: SparkSession, a: argparse.Namespace) -> None:
    asked, (chunks, s) = _asked(spark, a), _index(spark, a)
    _out(ranking.grade(asked, pipeline.retrieve(asked, chunks, s), chunks), a)


def answer(spark: SparkSession, a: argparse.Namespace) -> None:
    asked, (chunks, s) = _asked(spark, a), _index(spark, a)
    _out(pipeline.answer(asked, chunks, s, correct=a.use_evidence_grader), a)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Retrieval and grader metrics of the examples; the failures file, and with --grader-output the grader file."""
    asked, (chunks, s), gold = _asked(spark, a), _index(spark, a), evaluation.gold_rows(_examples(spark, a))
    found = pipeline.materialize(pipeline.retrieve(asked, chunks, s), "found")
    m = evaluation.retrieval_metrics(asked, found, chunks, gold)
    evaluation.averages(m, [c for c in m.columns if c != "query_id"]).show(vertical=True)
    graded = pipeline.materialize(evaluation.grader_rows(ranking.grade(asked, found, chunks), found, chunks, gold), "graded")
    evaluation.grader_summary(graded).show(vertical=True)
    lists = lambda k: evaluation.id_lists(asked, found, chunks, gold, k)
    if a.grader_output:
        artifacts.save_csv(artifacts.grader_lines(graded.join(asked.select("query_id", "question"), "query_id").join(lists(1 << 30), "query_id")), a.grader_output)
    artifacts.save_csv(artifacts.retrieval_failure_lines(asked, m, lists(5), 5), a.output or artifacts.default_failures_path(a.method, a.scope))


def evaluate_answers(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answers of all examples held against their gold answers; the predictions file."""
    chunks, s = _index(spark, a)
    rows = pipeline.materialize(pipeline.evaluate_answers(_examples(spark, a), chunks, s, correct=a.use_evidence_grader), "predictions")
    evaluation.answer_summary(rows).show(vertical=True)
    if a.output:
        artifacts.save_csv(artifacts.prediction_lines(rows), a.output)


def errors(spark: SparkSession, a: argparse.Namespace) -> None:
    """Failure classes of predictions: a parquet table, or a predictions file."""
    if a.predictions.endswith(".parquet"):
        p = chunking.last_delivered(spark.read.parquet(a.predictions), "prediction_id", "loaded_at")
    else:
        p = artifacts.typed_predictions(artifacts.load_csv(spark, a.predictions).na.fill("")).withColumn("prediction_id", F.col("example_id"))
    f = evaluation.failures(p.withColumn("retrieved_chunk_ids", F.array_compact("retrieved_chunk_ids")), _examples(spark, a), artifacts.load_chunks(spark, f"{a.index}/chunks"))
    f.groupBy("failure_category").count().orderBy(F.desc("count")).show(truncate=False)
    evaluation.answer_summary(p).show(vertical=True)
    if a.output:
        artifacts.save_csv(artifacts.failure_lines(f), a.output)


def experiment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Retrieval metrics of every method; with --answers those of the answers."""
    chunks, s = _index(spark, a)
    if a.answers:
        _out(pipeline.answer_experiment(_examples(spark, a), chunks, s), a)
    else:
        _out(pipeline.experiment(_asked(spark, a), chunks, evaluation.gold_rows(_examples(spark, a)), s), a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidlake", description=__doc__)
    p.add_argument("command", choices=["index", "retrieve", "rewrite", "grade", "answer", "evaluate", "evaluate-answers", "errors", "experiment"])
    p.add_argument("--dataset", default="data/reports.json")
    p.add_argument("--index", default="data/index")
    p.add_argument("--predictions", default="data/predictions.parquet")
    p.add_argument("--output")
    p.add_argument("--grader-output")
    p.add_argument("--limit", type=int, default=0, help="first examples only; 0: all")
    p.add_argument("--query")
    p.add_argument("--allowed-example-id")
    p.add_argument("--method", choices=pipeline.METHODS, default="dense")
    p.add_argument("--scope", choices=["example", "global"], default="example")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--candidate-k", type=int, default=10)
    p.add_argument("--neighbor-window", type=int, default=0)
    p.add_argument("--metric", choices=["cosine", "l2"], default="cosine")
    p.add_argument("--dims", type=int, default=64)
    for flag in ("rerank", "show-route", "use-evidence-grader", "rebuild-chunks", "dry-run", "answers"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    globals()[a.command.replace("-", "_")](SparkSession.builder.appName("evidlake").getOrCreate(), a)


if __name__ == "__main__":
    main()
