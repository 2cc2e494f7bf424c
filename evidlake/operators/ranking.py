"""Heuristic reranking and evidence grading.

Results (query_id, rank, score, example_id, pos) are joined with their question and
chunk, scored by expressions in the JVM and ranked again per query.

Cases: queries without results have no reranked rows and the grade of no
evidence; null questions or contents have no terms, years or numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import routing
from .fusion import KEY, renumbered

SUFFICIENT = 65  # hundredths


def features(results: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per result its features and ``rr_score``. ``chunks`` has example_id, pos, chunk_type, content.

    A chunk that comes twice is scored at its best rank; for cohesion it counts as often as it comes.
    """
    by_query = Window.partitionBy("query_id")
    head = F.when(F.col("rank") <= 20, 1)
    r = results.withColumn("heads", F.count(head).over(by_query)).withColumn("own", F.count(head).over(Window.partitionBy("query_id", "example_id")))
    r = r.withColumn("again", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank"))).where("again = 1")
    q = questions.select(
        "query_id", T.content_terms(F.col("question")).alias("q_terms"), T.years(F.col("question")).alias("q_years"), T.numbers(F.col("question")).alias("q_numbers"), routing.signals(F.col("question")).alias("signals")
    ).withColumn("q_tokens", F.array_distinct(T.tokenize(F.array_join("q_terms", " "))))
    low = F.lower(F.coalesce("content", F.lit("")))
    r = r.join(q, "query_id").join(chunks.select("example_id", "pos", "chunk_type", "content"), ["example_id", "pos"])
    overlap = T.jaccard(F.col("q_terms"), T.content_terms(low))
    numeric = F.array_contains("signals", "calculation") | F.array_contains("signals", "table_metric")
    r = r.select(
        *KEY, "rank", "score",
        overlap.alias("term_overlap"),
        F.when((F.size("q_years") == 0) | F.arrays_overlap("q_years", T.years(low)), 1.0).otherwise(0.0).alias("year_support"),
        F.when((F.size("q_numbers") > 0) & F.arrays_overlap("q_numbers", T.numbers(low)), 1.0).otherwise(0.0).alias("number_support"),
        F.when((F.col("chunk_type") == "table") & numeric, 1.0).otherwise(0.0).alias("table_bonus"),
        F.size(F.array_intersect("q_tokens", T.tokenize(low))).alias("exact_tokens"),
        F.when(F.col("heads") > 0, F.col("own") / F.col("heads")).otherwise(0.0).alias("cohesion"),
    )
    clamp = F.when(F.col("score") <= 0, 0.0).otherwise(F.least("score", F.lit(1.0)))
    value = (
        1.0 / F.greatest("rank", F.lit(1)) * 0.30 + clamp * 0.15 + F.col("term_overlap") * 0.25 + F.col("year_support") * 0.10 + F.col("number_support") * 0.05
        + F.col("table_bonus") * 0.05 + F.least(F.col("exact_tokens") / 5, F.lit(1.0)) * 0.05 + F.least("cohesion", F.lit(1.0)) * 0.05
    )
    return r.withColumn("rr_score", value)


def rerank(results: DataFrame, questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best by feature score, which becomes the score; ties keep the order."""
    f = renumbered(features(results, questions, chunks).withColumnRenamed("rank", "before"), F.round("rr_score", 9).desc(), "before", k=k)
    return f.select("query_id", "rank", F.col("rr_score").alias("score"), "example_id", "pos")


# The signals in their order, with their weights in hundredths, and texts.
GRADE_SIGNALS = [("metric_overlap", 25), ("year_support", 20), ("numeric_support", 20), ("table_support", 15), ("document_cohesion", 15), ("ranked_evidence", 5)]
NO_CHUNKS = "No chunks were retrieved."
BELOW = "Evidence confidence was below the sufficiency threshold."




def grade(questions: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question: sufficient, needs_retry, confidence, reason, matched, missing."""
    r = results.join(chunks.select("example_id", "pos", "chunk_type", "content"), ["example_id", "pos"])
    terms = T.content_terms(F.coalesce("content", F.lit("")), T.DOMAIN_STOPWORDS)
    per = r.groupBy("query_id", "example_id").agg(
        F.count_if(F.col("rank") <= 5).alias("heads"), F.min("rank").alias("first"), F.bool_or(F.col("chunk_type") == "table").alias("has_table"),
        F.bool_or(F.col("content").rlike(r"\d")).alias("has_number"), F.array_distinct(F.flatten(F.collect_list(terms))).alias("terms"),
        F.array_distinct(F.flatten(F.collect_list(T.years(F.col("content"))))).alias("years"), F.min(F.struct("rank", "score")).alias("top"),
    )
    main = F.max(F.struct("heads", (-F.col("first")).alias("early"), "has_table", "has_number", "terms", "years"))
    top = per.groupBy("query_id").agg(main.alias("m"), F.sum("heads").alias("all_heads"), F.min("top").alias("top"))
    q = questions.select("query_id", F.coalesce(T.content_terms(F.col("question"), T.DOMAIN_STOPWORDS), F.array().cast("array<string>")).alias("q_terms"), F.coalesce(T.years(F.col("question")), F.array().cast("array<string>")).alias("q_years"), routing.signals(F.col("question")).alias("signals"))
    j = q.join(top, "query_id", "left")
    numeric = F.array_contains("signals", "calculation") | F.array_contains("signals", "table_metric")
    found = F.col("m").isNotNull()
    tests = {
        "metric_overlap": F.arrays_overlap("q_terms", "m.terms"),
        "year_support": (F.size("q_years") == 0) | F.arrays_overlap("q_years", "m.years"),
        "numeric_support": ~numeric | F.col("m.has_number"),
        "table_support": ~numeric | F.col("m.has_table"),
        "document_cohesion": (F.col("m.heads") >= 2) | (F.col("all_heads") == 1),
        "ranked_evidence": F.col("top.score") != 0,
    }
    yes = {n: F.coalesce(t, F.lit(False)) for n, t in tests.items()}
    empty = F.array().cast("array<string>")
    points = sum((F.when(yes[n], w).otherwise(0) for n, w in GRADE_SIGNALS), F.lit(0))
    matched = F.array_compact(F.array(*(F.when(yes[n], n) for n, _ in GRADE_SIGNALS)))
    missing = F.array_compact(F.array(*(F.when(~yes[n], n) for n, _ in GRADE_SIGNALS[:-1])))
    j = j.select("query_id", found.alias("found"), numeric.alias("numeric"), F.when(found, points).otherwise(0).alias("points"), F.when(found, matched).otherwise(empty).alias("matched"), F.when(found, missing).otherwise(F.array(F.lit("retrieved_evidence"))).alias("missing"))
    enough = F.col("found") & (F.col("points") >= SUFFICIENT) & ~(F.col("numeric") & F.array_contains("missing", "numeric_support"))
    reason = F.when(~F.col("found"), NO_CHUNKS).when(F.size("missing") == 0, BELOW).otherwise(F.concat(F.lit("Missing or weak: "), F.array_join("missing", ", "), F.lit(".")))
    return j.select("query_id", enough.alias("sufficient"), (~enough).alias("needs_retry"), (F.least(F.col("points"), F.lit(100)) / 100).alias("confidence"), F.when(~enough, reason).alias("reason"), "matched", "missing")
