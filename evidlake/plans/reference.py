"""Queries of the retrieval and QA operators on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, calculation, chunking, dense, evaluation, fusion, lexical, ranking, reports, routing
from ..session import materialize, scratch_path
from ..sources import artifacts
from ..sources.tables import table
from . import pipeline, providers

K = 10


def _examples(spark: SparkSession, root: str) -> DataFrame:
    return chunking.last_delivered(table(spark, root, "examples"), "example_id", "loaded_at")


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.chunks(_examples(spark, root))


def _corpus(spark: SparkSession, root: str) -> DataFrame:
    """The chunks as a stored artifact, for queries that read them in several branches."""
    return materialize(_chunks(spark, root), "chunks")


def _contents(spark: SparkSession, root: str) -> DataFrame:
    """Of the stored chunks what search, reranking and grading read."""
    return materialize(_chunks(spark, root).select("example_id", "pos", "chunk_type", "content"), "contents")


def _questions(spark: SparkSession, root: str) -> DataFrame:
    return _examples(spark, root).select(F.col("example_id").alias("query_id"), "example_id", "question")


def _shown(results: DataFrame) -> DataFrame:
    return results.select("query_id", "rank", F.round("score", 6).alias("score"), "example_id", "pos")


# ---------------------------------------------------------------- chunking


def chunk_corpus(spark: SparkSession, root: str) -> DataFrame:
    c = _chunks(spark, root)
    return c.select("chunk_id", "example_id", "document_id", "pos", "chunk_type", "section", "content", F.array_join("source_ids", " ").alias("source_id"), "row_index", "text_index", "ragged")


def chunk_counts(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root).groupBy("chunk_type", "section").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("characters"))


def chunk_gold_overlap(spark: SparkSession, root: str) -> DataFrame:
    return chunking.gold_overlap(_chunks(spark, root), _examples(spark, root))


def example_profile(spark: SparkSession, root: str) -> DataFrame:
    return chunking.profile(_examples(spark, root))


def examples_limit(spark: SparkSession, root: str) -> DataFrame:
    """The first hundred examples: the limit is the feature."""
    return _examples(spark, root).select("example_id", "document_id", "question").orderBy("example_id").limit(100)


# ---------------------------------------------------------------- terms


def _term_counts(df: DataFrame, items) -> DataFrame:  # noqa: ANN001
    return df.select(F.explode(items).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def token_counts(spark: SparkSession, root: str) -> DataFrame:
    return _term_counts(table(spark, root, "chunks", "content"), T.tokenize(F.col("content")))


def content_term_counts(spark: SparkSession, root: str) -> DataFrame:
    return _term_counts(table(spark, root, "documents", "text"), T.content_terms(F.col("text")))


def number_counts(spark: SparkSession, root: str) -> DataFrame:
    return _term_counts(table(spark, root, "chunks", "content"), T.numbers(F.col("content")))


def year_counts(spark: SparkSession, root: str) -> DataFrame:
    return _term_counts(table(spark, root, "chunks", "content"), T.years(F.col("content")))


def parsed_numbers(spark: SparkSession, root: str) -> DataFrame:
    cells = _examples(spark, root).select("example_id", F.posexplode("table_rows").alias("row_no", "row")).select("example_id", "row_no", F.posexplode("row").alias("cell_no", "cell"))
    v = calculation.parse_number(F.col("cell"))
    return cells.select("example_id", "row_no", "cell_no", v.alias("number"), calculation.format_number(v).alias("shown"))


# ---------------------------------------------------------------- lexical


def bm25_corpus_stats(spark: SparkSession, root: str) -> DataFrame:
    s = lexical.corpus_stats(lexical.tokenized(_chunks(spark, root), []), [])
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_term_stats(spark: SparkSession, root: str) -> DataFrame:
    c = materialize(lexical.tokenized(_chunks(spark, root), ["example_id", "pos"]), "tokens")
    t = lexical.term_stats(lexical.postings(c, ["example_id", "pos"]), lexical.corpus_stats(c, []), [])
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk_report(spark: SparkSession, root: str) -> DataFrame:
    return _shown(lexical.search_reports(_questions(spark, root), _chunks(spark, root), K))


def bm25_topk_corpus(spark: SparkSession, root: str) -> DataFrame:
    return _shown(lexical.search_corpus(_questions(spark, root), _chunks(spark, root), K))


# ---------------------------------------------------------------- dense


def _embeddings(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("label").cast("string").alias("example_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))


def _vector_queries(spark: SparkSession, root: str) -> DataFrame:
    return _embeddings(spark, root).select(F.col("pos").cast("string").alias("query_id"), "example_id", "v")


def dense_topk_cosine(spark: SparkSession, root: str) -> DataFrame:
    return _shown(dense.search_corpus(_vector_queries(spark, root), _embeddings(spark, root), K))


def dense_topk_l2(spark: SparkSession, root: str) -> DataFrame:
    return _shown(dense.search_corpus(_vector_queries(spark, root), _embeddings(spark, root), K, "l2"))


def dense_topk_scoped(spark: SparkSession, root: str) -> DataFrame:
    return _shown(dense.search_scope(_vector_queries(spark, root), _embeddings(spark, root), ["example_id"], K))


def vector_norms(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings", "vec_id", "embedding")
    return v.select("vec_id", F.round(dense.norm(F.col("embedding")), 6).alias("norm"), F.round(dense.norm(dense.normalized(F.col("embedding"))), 6).alias("unit"))


def index_alignment(spark: SparkSession, root: str) -> DataFrame:
    return artifacts.alignment(table(spark, root, "chunks", "chunk_id"), table(spark, root, "chunk_vectors", "chunk_id"))


def stored_index_search(spark: SparkSession, root: str) -> DataFrame:
    """Chunks and vectors stored, loaded and searched inside reports, by the metric that the index was stored with."""
    path = scratch_path(spark, "index")
    artifacts.save_chunks(_chunks(spark, root), f"{path}/chunks")
    vectors = providers.HashedEmbedder().embed(artifacts.load_chunks(spark, f"{path}/chunks"), "content", "embedding")
    artifacts.save_vectors(vectors, f"{path}/vectors")
    artifacts.save_metadata(artifacts.load_vectors(spark, f"{path}/vectors"), f"{path}/metadata", "hashed-64", "l2")
    i = artifacts.load_index(spark, path)
    return _shown(pipeline.retrieve(_questions(spark, root), i.chunks, pipeline.Settings("dense", top_k=K, metric=i.metric, vectors=i.vectors)))


def _embedded(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("v", dense.hashed_embedding(F.col(text)))


def _dense_report(spark: SparkSession, root: str, chunks: DataFrame, k: int) -> DataFrame:
    return reports.search(_embedded(_questions(spark, root), "question"), _embedded(chunks.select("example_id", "pos", "content"), "content"), k, reports.DENSE)


def _both_reports(spark: SparkSession, root: str, k: int) -> DataFrame:
    """Both rankings inside reports, the dense one as number 0."""
    q, c = _embedded(_questions(spark, root), "question"), _embedded(_chunks(spark, root).select("example_id", "pos", "content"), "content")
    return reports.rankings(q, c, k).withColumn("no", F.when(F.col("kind") == reports.DENSE, 0).otherwise(1))


def dense_topk_report(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_dense_report(spark, root, _chunks(spark, root), K))


# ---------------------------------------------------------------- fusion


def hybrid_topk_report(spark: SparkSession, root: str) -> DataFrame:
    return _shown(fusion.fused_ranking(_both_reports(spark, root, K), K))


def neighbor_expansion(spark: SparkSession, root: str) -> DataFrame:
    c = _corpus(spark, root)
    return _shown(fusion.expand_with_neighbors(lexical.search_reports(_questions(spark, root), c, 3), c, 1))


def merged_results(spark: SparkSession, root: str) -> DataFrame:
    return _shown(fusion.merged_ranking(_both_reports(spark, root, 5), 5))


# ---------------------------------------------------------------- routing, rewriting


def route_signals(spark: SparkSession, root: str) -> DataFrame:
    return _questions(spark, root).select("query_id", F.array_join(routing.signals(F.col("question")), " ").alias("signals"))


def route_decisions(spark: SparkSession, root: str) -> DataFrame:
    q = _questions(spark, root).select("query_id", routing.route(F.col("question")).alias("r"))
    return q.select("query_id", "r.related", "r.method", "r.top_k", "r.candidate_k", "r.window", "r.reason")


def rewritten_questions(spark: SparkSession, root: str) -> DataFrame:
    return _questions(spark, root).select("query_id", routing.rewrite(F.col("question")).alias("query"))


# ---------------------------------------------------------------- reranking, grading


def rerank_features(spark: SparkSession, root: str) -> DataFrame:
    q, c = _questions(spark, root), _corpus(spark, root)
    f = ranking.features(lexical.search_reports(q, c, K), q, c)
    return f.select("query_id", "example_id", "pos", "rank", F.round("term_overlap", 6).alias("term_overlap"), "year_support", "number_support", "table_bonus", "exact_tokens", "cohesion", F.round("rr_score", 6).alias("rr_score"))


def reranked(spark: SparkSession, root: str) -> DataFrame:
    q, c = _questions(spark, root), _corpus(spark, root)
    return _shown(ranking.rerank(lexical.search_reports(q, c, K), q, c, 5))


def evidence_grades(spark: SparkSession, root: str) -> DataFrame:
    q, c = _questions(spark, root), _corpus(spark, root)
    g = ranking.grade(q, lexical.search_reports(q, c, 5), c)
    return g.select("query_id", "sufficient", "needs_retry", "confidence", "reason", F.array_join("matched", " ").alias("matched"), F.array_join("missing", " ").alias("missing"))


def reranked_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Results of all reports together, so that several reports meet in one ranking; equal questions are asked once."""
    asks, q, c = *pipeline.asked_once(_questions(spark, root)), _contents(spark, root)
    return _shown(pipeline.for_all(asks, ranking.rerank(lexical.search_corpus(q, c, 20), q, c, K)))


def evidence_grades_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Grades over the results of all reports; equal questions are asked once."""
    asks, q, c = *pipeline.asked_once(_questions(spark, root)), _contents(spark, root)
    g = pipeline.for_all(asks, ranking.grade(q, lexical.search_corpus(q, c, 5), c))
    return g.select("query_id", "sufficient", "needs_retry", "confidence", "reason", F.array_join("matched", " ").alias("matched"), F.array_join("missing", " ").alias("missing"))


# ---------------------------------------------------------------- pipeline


def _adaptive(spark: SparkSession, root: str, scope: str) -> DataFrame:
    return _shown(pipeline.retrieve(_questions(spark, root), _corpus(spark, root), pipeline.Settings("adaptive", scope=scope)))


def _corrective(spark: SparkSession, root: str, scope: str) -> DataFrame:
    results, grades = pipeline.retrieve_and_grade(_questions(spark, root), _corpus(spark, root), pipeline.Settings("bm25", top_k=3, scope=scope))
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    return grades.join(n, "query_id", "left").select("query_id", "sufficient", "confidence", "corrected", F.coalesce("results", F.lit(0)).alias("results"))


def _offline(spark: SparkSession, root: str, scope: str) -> DataFrame:
    a = pipeline.answer(_questions(spark, root), _corpus(spark, root), pipeline.Settings("adaptive", rerank=True, scope=scope))
    return a.select("query_id", "answer", F.array_join("cited", " ").alias("cited"), "insufficient_evidence", "error", "route_method", "sufficient", "confidence", "corrected")


def adaptive_retrieval(spark: SparkSession, root: str) -> DataFrame:
    return _adaptive(spark, root, "example")


def corrective_retrieval(spark: SparkSession, root: str) -> DataFrame:
    return _corrective(spark, root, "example")


def offline_answers(spark: SparkSession, root: str) -> DataFrame:
    return _offline(spark, root, "example")


def adaptive_retrieval_corpus(spark: SparkSession, root: str) -> DataFrame:
    return _adaptive(spark, root, "global")


def corrective_retrieval_corpus(spark: SparkSession, root: str) -> DataFrame:
    return _corrective(spark, root, "global")


def offline_answers_corpus(spark: SparkSession, root: str) -> DataFrame:
    return _offline(spark, root, "global")


def evidence_texts(spark: SparkSession, root: str) -> DataFrame:
    c = _corpus(spark, root)
    e = answers.evidence(lexical.search_reports(_questions(spark, root), c, 3), c)
    return e.select("query_id", "evidence")


# ---------------------------------------------------------------- calculation, answers


def _predictions(spark: SparkSession, root: str) -> DataFrame:
    return chunking.last_delivered(table(spark, root, "predictions"), "prediction_id", "loaded_at")


def calculation_runs(spark: SparkSession, root: str) -> DataFrame:
    p = _predictions(spark, root).select("prediction_id", calculation.execute(calculation.program(F.col("calculation_steps")), F.col("answer_unit"), F.col("answer_scale")).alias("x"))
    return p.select("prediction_id", F.col("x.str").alias("word"), F.col("x.formatted").alias("formatted"), F.col("x.trace").alias("trace"), F.col("x.error").alias("error"))


def finished_answers(spark: SparkSession, root: str) -> DataFrame:
    """Predictions as payloads of a service, finished again."""
    p = _predictions(spark, root)
    steps = F.coalesce(F.when(F.trim("calculation_steps") != "", F.col("calculation_steps")), F.lit("[]"))
    cited = F.to_json(F.transform(F.coalesce("cited_chunk_ids", F.array().cast("array<string>")), lambda c: F.struct(c.alias("chunk_id"), F.lit("").alias("quote"))))
    text = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', "$1"), F.lit("null"))
    text = lambda c, t=text: F.when(F.col(c).isNull(), F.lit("null")).otherwise(t(c))
    payload = F.concat(F.lit('```json\n{"answer": '), text("predicted_answer"), F.lit(', "citations": '), cited, F.lit(', "calculation_steps": '), steps, F.lit(', "answer_unit": '), text("answer_unit"), F.lit(', "answer_scale": '), text("answer_scale"), F.lit(', "insufficient_evidence": '), F.coalesce(F.col("insufficient_evidence").cast("string"), F.lit("null")), F.lit("}\n```"))
    got = F.transform(F.filter(F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")), lambda r: r.isNotNull()), lambda r: F.struct(answers.bare_chunk_id(r).alias("chunk_id"), F.array(F.regexp_replace(F.regexp_extract(r, r"(table|text)::(\d+)\s*$", 0), "::", "_")).alias("source_ids")))
    a = answers.finished(p.select(F.col("prediction_id").alias("query_id"), payload.alias("payload"), got.alias("retrieved")))
    return a.select("query_id", "answer", F.array_join("cited", " ").alias("cited"), "insufficient_evidence", "executed_answer", "execution_error", "error")


def answer_matches(spark: SparkSession, root: str) -> DataFrame:
    p = _predictions(spark, root).join(_examples(spark, root).select("example_id", F.col("metadata.gold_numeric_answer").alias("numeric")), "example_id", "left")
    none = F.array().cast("array<string>")
    return p.select(
        "prediction_id", F.coalesce(evaluation.exact_match(F.col("predicted_answer"), F.col("gold_answer")), F.lit(False)).alias("exact"),
        F.coalesce(evaluation.numerical_match(F.col("predicted_answer"), evaluation.gold_numbers(F.col("gold_answer"), F.col("numeric"))), F.lit(False)).alias("numerical"),
        evaluation.citations_valid(F.coalesce("cited_chunk_ids", none), F.coalesce("retrieved_chunk_ids", none), F.coalesce("insufficient_evidence", F.lit(False))).alias("citations"),
        evaluation.yes_no_gold(F.col("numeric")).alias("stopped"),
    )


def answer_summary(spark: SparkSession, root: str) -> DataFrame:
    s = evaluation.answer_summary(_predictions(spark, root))
    return s.select("examples", "completed", *(F.round(c, 6).alias(c) for c in s.columns if c not in ("examples", "completed")))


def cost_estimates(spark: SparkSession, root: str) -> DataFrame:
    p = _predictions(spark, root)
    return p.groupBy("route_method").agg(F.count(F.lit(1)).alias("predictions"), F.round(F.coalesce(F.sum(answers.cost(F.col("input_tokens"), F.col("output_tokens"), 0.4, 2.0)), F.lit(0.0)), 6).alias("cost"))


def predictions_csv(spark: SparkSession, root: str) -> DataFrame:
    """The predictions file: all 39 fields as texts."""
    return artifacts.prediction_lines(_predictions(spark, root))


def predictions_read_back(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the predictions file with their types again."""
    p = artifacts.typed_predictions(artifacts.prediction_lines(_predictions(spark, root)))
    return p.select("prediction_id", "exact_match", "evidence_grade_sufficient", "total_ms", "input_tokens", "answer_unit", F.size("retrieved_chunk_ids").alias("retrieved"), F.array_join("cited_chunk_ids", "|").alias("cited"))


def answer_evaluation(spark: SparkSession, root: str) -> DataFrame:
    """Answers to all examples held against their gold answers: the predictions file without its times."""
    examples = materialize(_examples(spark, root), "examples")
    rows = pipeline.evaluate_answers(examples, _corpus(spark, root), pipeline.Settings("bm25", top_k=3), correct=False)
    lists = {c: F.array_join(c, " ").alias(c) for c in ("retrieved_chunk_ids", "cited_chunk_ids")}
    return rows.select(*(lists.get(c, F.col(c)) for c in rows.columns if not c.endswith("_ms")))


# ---------------------------------------------------------------- evaluation


def _measured(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(questions, results, chunks, gold)"""
    q, c = materialize(_questions(spark, root), "questions"), _corpus(spark, root)
    r = materialize(pipeline.retrieve(q, c, pipeline.Settings("bm25", top_k=K, candidate_k=K)), "results")
    return q, r, c, evaluation.gold_rows(_examples(spark, root))


def retrieval_metrics(spark: SparkSession, root: str) -> DataFrame:
    m = evaluation.retrieval_metrics(*_measured(spark, root))
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in m.columns[1:]))


def retrieval_failures(spark: SparkSession, root: str) -> DataFrame:
    """Questions without a hit among the first five: the lines of the failures file."""
    q, r, c, gold = _measured(spark, root)
    return artifacts.retrieval_failure_lines(q, evaluation.retrieval_metrics(q, r, c, gold), evaluation.id_lists(q, r, c, gold, 5), 5)


def _graded(spark: SparkSession, root: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    q, r, c, gold = m = _measured(spark, root)
    return evaluation.grader_rows(ranking.grade(q, r, c), r, c, gold), m


def grader_file(spark: SparkSession, root: str) -> DataFrame:
    """The lines of the grader file."""
    rows, m = _graded(spark, root)
    return artifacts.grader_lines(rows.join(m[0].select("query_id", "question"), "query_id").join(evaluation.id_lists(*m, K), "query_id"))


def experiment_grid(spark: SparkSession, root: str) -> DataFrame:
    """Every method, plain and reranked, against the chunks of all reports."""
    g = pipeline.experiment(_questions(spark, root), _corpus(spark, root), evaluation.gold_rows(_examples(spark, root)), pipeline.Settings(scope="global"))
    return g.select("method", "rerank", "examples", *(F.round(c, 6).alias(c) for c in g.columns[3:]))


def grader_summary(spark: SparkSession, root: str) -> DataFrame:
    s = evaluation.grader_summary(_graded(spark, root)[0])
    return s.select("examples", *(F.round(x, 6).alias(x) for x in s.columns[1:]))


def _failures(spark: SparkSession, root: str) -> DataFrame:
    p = _predictions(spark, root).withColumn("retrieved_chunk_ids", F.filter("retrieved_chunk_ids", lambda c: c.isNotNull()))
    return evaluation.failures(p, _examples(spark, root), _chunks(spark, root))


def failure_classes(spark: SparkSession, root: str) -> DataFrame:
    return _failures(spark, root).select("prediction_id", "failure_category", F.array_join("gold_ids", " ").alias("gold_ids"), F.array_join("retrieved_gold_ids", " ").alias("retrieved_gold_ids"), F.array_join("missing_gold_ids", " ").alias("missing_gold_ids"))


def failure_counts(spark: SparkSession, root: str) -> DataFrame:
    return _failures(spark, root).groupBy("failure_category").agg(F.count(F.lit(1)).alias("n"))


NAMES = (
    "chunk_corpus", "chunk_counts", "chunk_gold_overlap", "example_profile", "examples_limit", "token_counts", "content_term_counts", "number_counts", "year_counts", "parsed_numbers",
    "bm25_corpus_stats", "bm25_term_stats", "bm25_topk_report", "bm25_topk_corpus", "dense_topk_cosine", "dense_topk_l2", "dense_topk_scoped", "vector_norms", "index_alignment", "stored_index_search", "dense_topk_report",
    "hybrid_topk_report", "neighbor_expansion", "merged_results", "route_signals", "route_decisions", "rewritten_questions", "rerank_features", "reranked", "evidence_grades", "reranked_corpus", "evidence_grades_corpus",
    "adaptive_retrieval", "corrective_retrieval", "offline_answers", "adaptive_retrieval_corpus", "corrective_retrieval_corpus", "offline_answers_corpus", "evidence_texts", "calculation_runs", "finished_answers", "answer_matches", "answer_summary", "cost_estimates", "predictions_csv", "predictions_read_back", "answer_evaluation",
    "retrieval_metrics", "retrieval_failures", "experiment_grid", "grader_summary", "grader_file", "failure_classes", "failure_counts",
)
