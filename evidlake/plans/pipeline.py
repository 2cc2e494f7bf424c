"""Retrieval, grading with one corrective pass, answering - for batches of questions.

``questions`` has query_id, question and, for search inside reports, example_id (the
report a question may use). ``chunks`` are chunks with example_id, pos.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, dense, evaluation, fusion, lexical, ranking, reports, routing
from ..session import materialize
from . import providers
from .trace import STAGES, Trace
from .trace import prices as trace_prices

METHODS = ("dense", "bm25", "hybrid", "adaptive")


@dataclass(frozen=True)
class Settings:
    method: str = "dense"
    top_k: int = 5
    candidate_k: int = 10
    window: int = 0
    rerank: bool = False
    scope: str = "example"  # or "global"
    embedder: providers.Embedder = providers.HashedEmbedder()
    metric: str = "cosine"  # or "l2"
    #: stored vectors of the chunks (example_id, pos, v); without them the chunks are embedded
    vectors: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown retrieval method: {self.method}")
        if self.scope not in ("example", "global"):
            raise ValueError(f"unknown scope: {self.scope}")
        if self.metric not in dense.METRICS:
            raise ValueError(f"unknown metric: {self.metric}")


def routed(questions: DataFrame, s: Settings) -> DataFrame:
    """Questions with their route."""
    q = F.coalesce("question", F.lit(""))
    return questions.withColumn("route", routing.resolve(q, s.method, s.top_k, s.candidate_k, s.window))


def _vectors(chunks: DataFrame, s: Settings) -> DataFrame:
    if s.vectors is None:
        return s.embedder.embed(chunks.select("example_id", "pos", "content"), "content", "v")
    return chunks.select("example_id", "pos", "content").join(s.vectors.select("example_id", "pos", "v"), ["example_id", "pos"], "left")


def _rankings(questions: DataFrame, chunks: DataFrame, s: Settings, k: int, lexical_too: bool, dense_too: bool = True) -> tuple[DataFrame | None, DataFrame | None]:
    """(dense, lexical) rankings, written once; inside reports both come from one pass."""
    asked = s.embedder.embed(questions, "question", "v") if dense_too else questions
    if s.scope == "example":
        found = materialize(reports.rankings(asked, _vectors(chunks, s) if dense_too else chunks, k, lexical_too, dense_too, s.metric), "rankings", by="kind")
        of = lambda kind: found.where(F.col("kind") == kind).drop("kind")
        return of(reports.DENSE) if dense_too else None, of(reports.LEXICAL) if lexical_too else None
    near = materialize(dense.search_corpus(asked, s.vectors if s.vectors is not None else _vectors(chunks, s), k, s.metric), "near") if dense_too else None
    return near, materialize(lexical.search_corpus(questions, chunks, k), "words") if lexical_too else None


def _bounds(s: Settings) -> tuple[int, int]:
    """Literal bounds of results and candidates (routes of the adaptive method have at least their own)."""
    top = max(s.top_k, routing.TOP_K) if s.method == "adaptive" else s.top_k
    wide = max(s.candidate_k, top, routing.CANDIDATE_K if s.method == "adaptive" else 0)
    return top, wide if s.method != "dense" or s.rerank else top


def asked_once(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, asks), distinct questions with query_id = asks): among all reports equal questions have equal results."""
    q = materialize(questions.select("query_id", "question"), "questions")
    first = materialize(q.groupBy("question").agg(F.min("query_id").alias("query_id")), "asked")
    same = F.col("question").eqNullSafe(F.col("said"))
    return q.join(first.select(F.col("question").alias("said"), F.col("query_id").alias("asks")), same).select("query_id", "asks"), first


def for_all(asks: DataFrame, results: DataFrame) -> DataFrame:
    """Results of distinct questions as those of all questions that ask the same."""
    return asks.join(results.withColumnRenamed("query_id", "asks"), "asks").drop("asks")


def retrieve(questions: DataFrame, chunks: DataFrame, s: Settings, rankings: tuple[DataFrame | None, DataFrame | None] | None = None, routes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, score, example_id, pos); unrelated questions have no rows.

    ``rankings`` are stored dense and lexical rankings that are deep enough, ``routes`` stored ``routed``
    questions, if there are any. Among all reports, a question that comes several times is answered once.
    """
    if s.scope == "global" and rankings is None:
        asks, first = asked_once(questions)
        return for_all(asks, _retrieve(first, chunks, s, None, None)).select("query_id", "rank", "score", "example_id", "pos")
    return _retrieve(questions, chunks, s, rankings, routes)


def _retrieve(questions: DataFrame, chunks: DataFrame, s: Settings, rankings: tuple[DataFrame | None, DataFrame | None] | None, routes: DataFrame | None) -> DataFrame:
    r = routes if routes is not None else materialize(routed(questions, s), "routed")
    top, bound = _bounds(s)
    related = r.where("route.related")
    near, words = rankings or _rankings(related.drop("route"), chunks, s, bound, s.method != "dense", s.method != "bm25")
    route = related.select("query_id", F.col("route.method").alias("method"), F.col("route.top_k").alias("top_k"), F.col("route.candidate_k").alias("candidate_k"), F.col("route.window").alias("window"))
    seed_k = F.greatest("candidate_k", "top_k") if s.rerank else F.col("top_k")
    cols = ["query_id", "rank", "score", "example_id", "pos"]
    of = lambda ranking, method: ranking.join(route.where(F.col("method") == method), "query_id")
    parts = []
    if s.method in ("dense", "adaptive"):
        parts.append(of(near, "dense").where(F.col("rank") <= seed_k).select(*cols))
    if s.method == "bm25":
        parts.append(of(words, "bm25").where(F.col("rank") <= seed_k).select(*cols))
    if s.method in ("hybrid", "adaptive"):
        wanted = F.greatest("candidate_k", seed_k)
        both = near.withColumn("no", F.lit(0)).unionByName(words.withColumn("no", F.lit(1)))
        fused = fusion.fused_ranking(of(both, "hybrid").where(F.col("rank") <= wanted), bound)
        parts.append(fused.join(route, "query_id").where(F.col("rank") <= seed_k).select(*cols))
    seeds = parts[0]
    for p in parts[1:]:
        seeds = seeds.unionByName(p)
    if s.rerank:
        seeds = ranking.rerank(seeds, r, chunks, top)
        seeds = seeds.join(route, "query_id").where(F.col("rank") <= F.col("top_k")).select(*cols)
    if s.method == "adaptive":
        return fusion.expand_with_neighbors(seeds, chunks, 1, route.where("window = 1").select("query_id"))
    return fusion.expand_with_neighbors(seeds, chunks, s.window)


def retrieve_and_grade(questions: DataFrame, chunks: DataFrame, s: Settings, correct: bool = True, rewriter: Callable[[list[str]], list[str]] | None = None, trace: Trace | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, grades): where the grade asks for it, one more pass with a rewritten query, kept if it grades no worse.

    Grades have ``corrected`` and the question's calls besides the columns of ``ranking.grade``. ``rewriter`` is a
    service for the rewriting; where it fails or answers nothing, rules rewrite.
    """
    trace = trace or Trace()
    routes = materialize(routed(questions, s), "routed")
    with trace.stage("retrieval"):
        first = materialize(retrieve(questions, chunks, s, routes=routes), "first")
    with trace.stage("evidence_grading"):
        grades = materialize(ranking.grade(routes, first, chunks), "grades")
    embeds = lambda r: F.when(r["route.method"].isin("dense", "hybrid"), 1).otherwise(0)
    calls = routes.select("query_id", embeds(routes).alias("embedding_calls"))
    if not correct:
        return first, grades.withColumn("corrected", F.lit(False)).join(calls.withColumn("rewrite_calls", F.lit(0)), "query_id", "left")
    related = routes.where("route.related").drop("route")
    weak = related.join(grades.where("needs_retry").select("query_id"), "query_id", "left_semi")
    again = Settings("hybrid", max(s.top_k, routing.TOP_K), max(s.candidate_k, routing.CANDIDATE_K), max(s.window, 1), True, s.scope, s.embedder, s.metric, s.vectors)
    with trace.stage("query_rewrite"):
        again_asked = materialize(providers.rewritten(weak, rewriter).withColumn("question", F.col("query")).drop("query"), "rewritten")
    with trace.stage("corrective_retrieval"):
        second = retrieve(again_asked, chunks, again)
        merged = materialize(fusion.merge_results(first.join(again_asked.select("query_id"), "query_id", "left_semi"), second, again.top_k), "merged")
    regraded = ranking.grade(weak, merged, chunks)
    both = regraded.join(grades.select("query_id", F.col("confidence").alias("before")), "query_id")
    adopted = materialize(both.where(F.col("confidence") >= F.col("before")).drop("before").withColumn("corrected", F.lit(True)), "adopted")
    kept = grades.join(adopted.select("query_id"), "query_id", "left_anti").withColumn("corrected", F.lit(False))
    results = first.join(adopted.select("query_id"), "query_id", "left_anti").unionByName(merged.join(adopted.select("query_id"), "query_id", "left_semi"))
    # the second pass is hybrid: one more embedding
    calls = calls.join(again_asked.select("query_id", F.lit(1).alias("again")), "query_id", "left")
    calls = calls.select("query_id", (F.col("embedding_calls") + F.coalesce("again", F.lit(0))).alias("embedding_calls"), F.coalesce("again", F.lit(0)).alias("rewrite_calls"))
    return results, kept.unionByName(adopted).join(calls, "query_id", "left")


def answer(
    questions: DataFrame, chunks: DataFrame, s: Settings, answerer: providers.Answerer | None = None, correct: bool = True, rewriter: Callable[[list[str]], list[str]] | None = None, trace: Trace | None = None
) -> DataFrame:
    """One answer per question; unrelated questions abstain. Calls and tokens are those of the question."""
    answerer, trace = answerer or providers.TopChunkAnswerer(), trace or Trace()
    questions = materialize(questions, "questions")
    results, grades = retrieve_and_grade(questions, chunks, s, correct, rewriter, trace)
    r = routed(questions, s)
    asked = r.where("route.related").select("query_id", "question").join(answers.evidence(results, chunks), "query_id", "left")
    with trace.stage("generation"):
        said = materialize(answers.with_usage(answerer.answer(asked)), "said")
    with trace.stage("calculation_execution"):
        done = materialize(answers.finished(said).join(said.select("query_id", "input_tokens", "output_tokens", "total_tokens"), "query_id"), "answers")
    out = r.select("query_id", "question", F.col("route.method").alias("route_method"), F.col("route.related").alias("related")).join(done, "query_id", "left")
    out = out.withColumn("answer", F.when(F.col("related"), F.col("answer")).otherwise(F.lit(answers.ABSTENTION)))
    out = out.withColumn("insufficient_evidence", F.when(F.col("related"), F.col("insufficient_evidence")).otherwise(F.lit(True)))
    out = out.join(grades.select("query_id", "sufficient", "confidence", "reason", "corrected", "embedding_calls", "rewrite_calls"), "query_id", "left")
    return out.withColumn("generation_calls", F.when(F.col("related"), 1).otherwise(0))


def evaluate_answers(
    examples: DataFrame, chunks: DataFrame, s: Settings, answerer: providers.Answerer | None = None, correct: bool = True, rewriter: Callable[[list[str]], list[str]] | None = None, prices: tuple[float, float] | None = None
) -> DataFrame:
    """Every example answered and held against its gold answer: the 39 columns of the predictions file.

    Stages run for all questions together; their times are shared out evenly.
    """
    trace = Trace()
    questions = examples.select(F.col("example_id").alias("query_id"), "example_id", "question")
    with trace.stage("total"):
        done = materialize(answer(questions, chunks, s, answerer, correct, rewriter, trace), "evaluated")
    ms = trace.shared(done.count())
    times = {f"{stage}_ms": ms.get(stage, 0.0) for stage in STAGES}
    prices = prices or trace_prices()
    return evaluation.answer_rows(examples, done, s.rerank, correct, times, prices)


def experiment(questions: DataFrame, chunks: DataFrame, gold: DataFrame, s: Settings, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Average retrieval metrics of every method, plain and reranked."""
    settings = [Settings(m, max(s.top_k, 10), max(s.candidate_k, 30), s.window, rerank, s.scope, s.embedder, s.metric, s.vectors) for m in methods for rerank in (False, True)]
    questions = materialize(questions, "questions")
    asks, asked = asked_once(questions) if s.scope == "global" else (None, questions)
    rankings = _rankings(asked, chunks, s, max(_bounds(x)[1] for x in settings), True)
    rows = None
    for x in settings:
        found = _retrieve(asked, chunks, x, rankings, routed(asked, x))
        m = evaluation.retrieval_metrics(questions, found if asks is None else for_all(asks, found), chunks, gold)
        part = evaluation.averages(m, [c for c in m.columns if c != "query_id"]).select(F.lit(x.method).alias("method"), F.lit(x.rerank).alias("rerank"), "*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def answer_experiment(examples: DataFrame, chunks: DataFrame, s: Settings, methods: tuple[str, ...] = METHODS, answerer: providers.Answerer | None = None) -> DataFrame:
    """Answer metrics of every method, plain and with rerank, grader and corrective pass."""
    rows = None
    for m in methods:
        for full in (False, True):
            x = Settings(m, s.top_k, s.candidate_k, s.window, full, s.scope, s.embedder, s.metric, s.vectors)
            part = evaluation.answer_summary(evaluate_answers(examples, chunks, x, answerer, full)).select(F.lit(m).alias("method"), F.lit(full).alias("corrective"), "*")
            rows = part if rows is None else rows.unionByName(part)
    return rows
