"""Stored chunks, vectors and index metadata; alignment checks; CSV and JSON sinks.

Cases: a missing artifact raises Spark's own error; empty tables write empty files; all
checks work on counts and anti-joins, nothing is gathered but one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation


def save_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ensure_chunks(spark: SparkSession, path: str, build, rebuild: bool = False, limit: int | None = None) -> DataFrame:  # noqa: ANN001
    """Stored chunks, or those of ``build()``, stored first; they are built again if they were stored for another ``limit`` of examples."""
    note = f"{path}-limit"
    stale = exists(spark, note) and spark.read.schema("limit int").json(note).first()["limit"] != limit
    if rebuild or stale or not exists(spark, path):
        save_chunks(build(), path)
        spark.createDataFrame([(limit,)], "limit int").write.option("ignoreNullFields", False).mode("overwrite").json(note)
    return load_chunks(spark, path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(chunk_id, example_id, pos, embedding), as far as there"""
    vectors.select(*(c for c in ("chunk_id", "example_id", "pos", "embedding") if c in vectors.columns)).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_metadata(vectors: DataFrame, path: str, model: str, metric: str) -> None:
    """One row: model, metric, dimension, count, smallest id; the ids themselves stay with the vectors."""
    row = vectors.agg(F.max(F.size("embedding")).alias("embedding_dimension"), F.count(F.lit(1)).alias("chunk_count"), F.min("chunk_id").alias("first_chunk_id"))
    row.select(F.lit(model).alias("model"), F.lit(metric).alias("metric"), "*").write.mode("overwrite").json(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, metric string, embedding_dimension int, chunk_count long, first_chunk_id string").json(path)


def alignment(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunk and vector counts, and ids that the other side lacks."""
    c = chunks.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("c"))
    v = vectors.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("v"))
    both = c.join(v, "chunk_id", "full_outer")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return both.agg(zero("c").alias("chunks"), zero("v").alias("vectors"), F.count_if(F.col("v").isNull()).alias("chunks_without_vector"), F.count_if(F.col("c").isNull()).alias("vectors_without_chunk"))


def validate_alignment(chunks: DataFrame, vectors: DataFrame, metadata: DataFrame | None = None) -> None:
    """Raises ValueError unless every chunk has its vector and the metadata count agrees."""
    r = alignment(chunks, vectors).first()
    if r["chunks"] != r["vectors"]:
        raise ValueError(f"chunk count {r['chunks']} differs from vector count {r['vectors']}")
    if metadata is not None and (m := metadata.first()) is not None and m["chunk_count"] != r["chunks"]:
        raise ValueError(f"metadata count {m['chunk_count']} differs from chunk count {r['chunks']}")
    if r["chunks_without_vector"] or r["vectors_without_chunk"]:
        raise ValueError("chunk ids differ between chunks and vectors")


@dataclass(frozen=True)
class Index:
    """Stored chunks with their vectors, model and metric."""

    chunks: DataFrame
    vectors: DataFrame
    model: str
    metric: str
    dims: int


def load_index(spark: SparkSession, path: str, validate: bool = True) -> Index:
    """The artifacts of a folder together; an error if they do not belong to each other."""
    chunks, vectors, metadata = load_chunks(spark, f"{path}/chunks"), load_vectors(spark, f"{path}/vectors"), load_metadata(spark, f"{path}/metadata")
    row = metadata.first()
    if row is None:
        raise ValueError(f"no metadata in {path}")
    if validate:
        validate_alignment(chunks, vectors, metadata)
    return Index(chunks, vectors.select("example_id", "pos", F.col("embedding").alias("v")), row["model"], row["metric"], row["embedding_dimension"] or 0)


# ---------------------------------------------------------------- sinks


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _list(c: str) -> Column:
    return F.coalesce(F.array_join(c, " "), F.lit(""))


def _yes(c: str) -> Column:
    return F.coalesce(F.initcap(F.col(c).cast("string")), F.lit(""))


# Columns of the predictions file by their form; all others are texts.
_FLAGS = "exact_match numerical_match citation_valid insufficient_evidence evidence_grade_sufficient used_rerank used_evidence_grader used_corrective_retry".split()
_TIMES = "total_ms retrieval_ms generation_ms evidence_grading_ms query_rewrite_ms corrective_retrieval_ms calculation_execution_ms".split()
_COUNTS = "embedding_calls generation_calls rewrite_calls input_tokens output_tokens total_tokens retrieved_chunks".split()
_LISTS = "retrieved_chunk_ids cited_chunk_ids".split()
_NUMBERS = [*_TIMES, "estimated_cost_usd", "evidence_grade_confidence"]


def prediction_lines(p: DataFrame) -> DataFrame:
    """Predictions as texts in the order of the file: two decimals for times, eight for costs, ids joined by blanks, nulls empty."""

    def shown(c: str) -> Column:
        if c in _FLAGS:
            return _yes(c)
        if c in _LISTS:
            return _list(c)
        if c in _TIMES or c == "estimated_cost_usd":
            return F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.2f" if c in _TIMES else "%.8f", F.col(c)))
        return _blank(c)

    return p.select(*(c for c in ("prediction_id",) if c in p.columns), *(shown(c).alias(c) for c in evaluation.PREDICTION))


def typed_predictions(lines: DataFrame) -> DataFrame:
    """Lines of the predictions file with their types again; empty texts of optional fields are null."""

    def typed(c: str) -> Column:
        if c in _FLAGS:
            return F.when(F.col(c) == "", None).otherwise(evaluation.parse_bool(F.col(c))) if c == "evidence_grade_sufficient" else evaluation.parse_bool(F.col(c))
        if c in _LISTS:
            return evaluation.split_ids(F.col(c))
        if c in _COUNTS or c in _NUMBERS:
            return F.col(c).try_cast("int" if c in _COUNTS else "double")
        return F.col(c) if c in ("example_id", "question", "gold_answer", "predicted_answer", "calculation_steps") else F.nullif(F.col(c), F.lit(""))

    return lines.select(*(typed(c).alias(c) if c in evaluation.PREDICTION else c for c in lines.columns))


def grader_lines(rows: DataFrame) -> DataFrame:
    """Graded questions as lines of the grader file."""
    texts = {"is_sufficient": _yes("sufficient"), "needs_retry": _yes("needs_retry"), "confidence": _blank("confidence"), "missing_reason": _blank("reason"), "matched_signals": _list("matched"), "missing_signals": _list("missing")}
    return rows.select(
        F.col("query_id").alias("example_id"), _blank("question").alias("question"), _list("gold_ids").alias("gold_ids"), _list("retrieved_ids").alias("retrieved_ids"),
        *(v.alias(c) for c, v in texts.items()), _yes("any_gold").alias("has_any_gold_evidence"), _yes("all_gold").alias("has_all_gold_evidence"),
    )


def retrieval_failure_lines(questions: DataFrame, metrics: DataFrame, lists: DataFrame, cutoff: int) -> DataFrame:
    """Questions without a hit among the first ``cutoff`` results as lines of the failures file."""
    missed = questions.select("query_id", "question").join(metrics.where(F.col(f"hit_{cutoff}") == 0).select("query_id"), "query_id", "left_semi").join(lists, "query_id")
    return missed.select(F.col("query_id").alias("example_id"), _blank("question").alias("question"), _list("gold_ids").alias("gold_ids"), _list("retrieved_ids").alias("retrieved_ids"))


def default_failures_path(method: str, scope: str, folder: str = "results") -> str:
    return f"{folder}/{method}_{scope}_retrieval_failures.csv"


def failure_lines(f: DataFrame) -> DataFrame:
    lists, flags = "gold_ids retrieved_gold_ids missing_gold_ids retrieved_chunk_ids cited_chunk_ids".split(), "exact_match numerical_match citation_valid insufficient_evidence".split()
    return f.select(*(_blank(c).alias(c) for c in "example_id failure_category question gold_answer predicted_answer error".split()), *(_list(c).alias(c) for c in lists), *(_yes(c).alias(c) for c in flags))


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def save_summary(runs: DataFrame, path: str) -> None:
    """Runs (name, metrics map) as one CSV row each, a column per metric."""
    metrics = runs.select("name", F.explode("metrics").alias("metric", "value"))
    save_csv(metrics.groupBy("name").pivot("metric").agg(F.first("value")), path)


def save_manifest(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").json(path)
