"""Retrieval, answer and grader metrics, failure classes.

Cases: questions without gold evidence have recall 0 and count; empty inputs give the
averages 0; null texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CUTOFFS = (1, 3, 5, 10)
TOLERANCE = 1e-3
# Failure classes in the order of their tests.
FAILURES = ["pipeline_error", "correct", "citation_issue", "retrieval_failure", "partial_retrieval", "over_abstention", "calculation_or_generation_error"]

# ---------------------------------------------------------------- retrieval


def evidence_ids(example_id: Column, source_id: Column) -> Column:
    return F.concat_ws("::", example_id, source_id)


def gold_rows(examples: DataFrame) -> DataFrame:
    """(query_id, gold_id)"""
    return examples.select("example_id", F.explode(F.map_keys("gold_evidence")).alias("source_id")).select(F.col("example_id").alias("query_id"), evidence_ids(F.col("example_id"), F.col("source_id")).alias("gold_id"))


def retrieval_metrics(questions: DataFrame, results: DataFrame, chunks: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per question reciprocal rank, hit and recall at the cutoffs."""
    found = results.join(chunks.select("example_id", "pos", F.explode("source_ids").alias("source_id")), ["example_id", "pos"])
    found = found.select("query_id", "rank", evidence_ids(F.col("example_id"), F.col("source_id")).alias("gold_id"))
    hits = gold.join(found.groupBy("query_id", "gold_id").agg(F.min("rank").alias("rank")), ["query_id", "gold_id"], "left")
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"), *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cutoffs))
    per = questions.select("query_id").join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.select(
        "query_id", zero(1.0 / F.col("best")).alias("reciprocal_rank"),
        *(zero(F.when(F.col(f"h{k}") > 0, 1.0)).alias(f"hit_{k}") for k in cutoffs), *(zero(F.col(f"h{k}") / F.col("n")).alias(f"recall_{k}") for k in cutoffs),
    )


def id_lists(questions: DataFrame, results: DataFrame, chunks: DataFrame, gold: DataFrame, cutoff: int) -> DataFrame:
    """(query_id, gold_ids, retrieved_ids): sorted gold ids, and the ids of the first ``cutoff`` results in order."""
    found = results.where(F.col("rank") <= cutoff).join(chunks.select("example_id", "pos", "source_ids"), ["example_id", "pos"])
    ids = F.transform("source_ids", lambda s: evidence_ids(F.col("example_id"), s))
    found = found.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", ids.alias("ids")))), lambda x: x["ids"])).alias("retrieved_ids"))
    wanted = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("gold_id")).alias("gold_ids"))
    none, some = F.array().cast("array<string>"), questions.select("query_id")
    return some.join(wanted, "query_id", "left").join(found, "query_id", "left").select("query_id", F.coalesce("gold_ids", none).alias("gold_ids"), F.slice(F.coalesce("retrieved_ids", none), 1, cutoff).alias("retrieved_ids"))


def averages(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("examples"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns))


# ---------------------------------------------------------------- answers


def normalize_answer(c: Column) -> Column:
    """Lower case, no , $ %, one blank for white space; a blank that only then stands at an end stays."""
    return F.regexp_replace(F.regexp_replace(T.strip(F.lower(c)), "[,$%]", ""), r"(?U)\s+", " ")


def exact_match(predicted: Column, gold: Column) -> Column:
    return normalize_answer(predicted) == normalize_answer(gold)


def gold_numbers(gold: Column, numeric_answer: Column) -> Column:
    """Numbers of the gold answer, the numeric answer, and that times 100 for percentages."""
    x = numeric_answer.try_cast("double")
    return F.concat(T.plain_numbers(gold), F.array_compact(F.array(x, F.when(gold.contains("%"), x * 100))))


def numbers_match(p: Column, g: Column) -> Column:
    return F.abs(p - g) <= F.greatest(F.lit(TOLERANCE), F.abs(g) * TOLERANCE)


def numerical_match(predicted: Column, golds: Column) -> Column:
    """Any number of the prediction near any gold number."""
    return F.exists(T.plain_numbers(predicted), lambda p: F.exists(golds, lambda g: numbers_match(p, g)))


def yes_no_gold(numeric_answer: Column) -> Column:
    """A numeric answer that is no number stops the evaluation of its example."""
    return numeric_answer.isNotNull() & numeric_answer.try_cast("double").isNull()


def citations_valid(cited: Column, retrieved: Column, insufficient: Column) -> Column:
    return F.when(insufficient, F.size(cited) == 0).otherwise((F.size(cited) > 0) & (F.size(F.array_except(cited, retrieved)) == 0))


# Columns of the predictions file in their order.
PREDICTION = (
    "example_id question gold_answer predicted_answer exact_match numerical_match citation_valid insufficient_evidence calculation calculation_steps answer_unit answer_scale executed_answer execution_error error "
    "retrieved_chunk_ids cited_chunk_ids evidence_grade_sufficient evidence_grade_confidence evidence_grade_reason total_ms retrieval_ms generation_ms evidence_grading_ms query_rewrite_ms corrective_retrieval_ms "
    "calculation_execution_ms embedding_calls generation_calls rewrite_calls input_tokens output_tokens total_tokens estimated_cost_usd retrieved_chunks used_rerank used_evidence_grader used_corrective_retry route_method"
).split()


def answer_rows(examples: DataFrame, done: DataFrame, rerank: bool, graded: bool, times: dict[str, float], prices: tuple[float, float] | None) -> DataFrame:
    """Answers (query_id, answer, ...) of examples held against their gold answers, as rows of the predictions file.

    Where answering failed, or the gold number is none (yes, no), the row has ``error`` and is empty otherwise.
    """
    gold = examples.select("example_id", F.col("answer").alias("gold_answer"), F.col("metadata.gold_numeric_answer").alias("numeric"))
    d = done.withColumnRenamed("query_id", "example_id").join(gold, "example_id")
    stopped = F.when(yes_no_gold(F.col("numeric")), F.concat(F.lit("could not convert string to float: '"), F.col("numeric"), F.lit("'")))
    d = d.withColumn("error", F.coalesce("error", stopped))
    none, ok = F.array().cast("array<string>"), F.col("error").isNull()
    cited, retrieved, abstains = F.coalesce("cited", none), F.coalesce("retrieved_chunk_ids", none), F.coalesce("insufficient_evidence", F.lit(False))
    yes = lambda c: ok & F.coalesce(c, F.lit(False))
    kept = lambda c: F.when(ok, c)
    cost = F.lit(None).cast("double") if prices is None else F.col("input_tokens") / 1_000_000 * prices[0] + F.col("output_tokens") / 1_000_000 * prices[1]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    values = {
        "predicted_answer": F.when(ok, F.col("answer")).otherwise(""), "exact_match": yes(exact_match(F.col("answer"), F.col("gold_answer"))),
        "numerical_match": yes(numerical_match(F.col("answer"), gold_numbers(F.col("gold_answer"), F.col("numeric")))), "citation_valid": yes(citations_valid(cited, retrieved, abstains)),
        "insufficient_evidence": yes(abstains), "calculation_steps": F.when(ok, F.coalesce("calculation_steps", F.lit(""))).otherwise(""), "retrieved_chunk_ids": F.when(ok, retrieved).otherwise(none), "cited_chunk_ids": F.when(ok, cited).otherwise(none),
        "evidence_grade_sufficient": kept(F.col("sufficient")), "evidence_grade_confidence": kept(F.col("confidence")), "evidence_grade_reason": kept(F.col("reason")), "estimated_cost_usd": cost, "retrieved_chunks": F.size(retrieved),
        "used_rerank": F.lit(rerank), "used_evidence_grader": F.lit(graded), "used_corrective_retry": F.coalesce(F.col("rewrite_calls") > 0, F.lit(False)),
        **{c: kept(F.col(c)) for c in ("calculation", "answer_unit", "answer_scale", "executed_answer", "execution_error")}, **{c: F.lit(ms) for c, ms in times.items()},
        **{c: zero(c) for c in ("embedding_calls", "generation_calls", "rewrite_calls", "input_tokens", "output_tokens", "total_tokens")},
    }
    return d.select(*(values.get(c, F.col(c)).alias(c) for c in PREDICTION))


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(T.strip(c)) == "true", F.lit(False))


def split_ids(c: Column) -> Column:
    """The ids of a text, by white space; none in an empty one."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def answer_summary(p: DataFrame) -> DataFrame:
    """Rates over predictions without an error, and the rate of errors."""
    done = F.when(F.col("error").isNull() | (F.col("error") == ""), True)
    rate = lambda c: F.coalesce(F.avg(F.when(done, F.coalesce(c, F.lit(False)).cast("double"))), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(F.when(done, F.col(c).cast("double"))), F.lit(0.0)).alias(f"avg_{c}")
    return p.agg(
        F.count(F.lit(1)).alias("examples"), F.count(done).alias("completed"), rate(F.col("exact_match")).alias("exact_match"), rate(F.col("numerical_match")).alias("numerical_match"),
        rate(F.col("citation_valid")).alias("citation_validity"), rate(F.col("executed_answer").isNotNull()).alias("execution_success_rate"),
        rate(F.col("execution_error").isNotNull()).alias("execution_error_rate"), rate(F.col("insufficient_evidence")).alias("insufficient_evidence_rate"),
        (1 - F.coalesce(F.try_divide(F.count(done), F.count(F.lit(1))), F.lit(0.0))).alias("error_rate"),
        *map(mean, ("total_ms", "retrieval_ms", "generation_ms", "estimated_cost_usd", "embedding_calls", "generation_calls", "retrieved_chunks")),
    )


# ---------------------------------------------------------------- grader, failures


def grader_rows(grades: DataFrame, results: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Per graded question whether any and all of its gold evidence was retrieved."""
    m = retrieval_metrics(grades, results, chunks, gold, (1 << 30,))
    k = 1 << 30
    g = grades.join(m.select("query_id", F.col(f"hit_{k}").alias("hit"), F.col(f"recall_{k}").alias("recall")), "query_id")
    none = g.join(gold.select("query_id").distinct().withColumn("has_gold", F.lit(True)), "query_id", "left")
    return none.select(*grades.columns, (F.col("hit") > 0).alias("any_gold"), (F.col("has_gold").isNull() | (F.col("recall") >= 1)).alias("all_gold"))


def grader_summary(rows: DataFrame) -> DataFrame:
    rate = lambda c, n: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(n)
    s, a = F.col("sufficient"), F.col("any_gold")
    return rows.agg(
        F.count(F.lit(1)).alias("examples"), rate(s, "sufficient_rate"), rate(a, "any_gold_rate"), rate(F.col("all_gold"), "all_gold_rate"), rate(s & ~a, "false_sufficient_rate"), rate(~s & a, "false_insufficient_rate")
    )


def failures(predictions: DataFrame, examples: DataFrame, chunks: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Predictions of known examples with their class of failure and gold evidence.

    ``chunks`` has chunk_id, example_id, source_ids, one row per chunk_id.
    """
    gold = examples.select("example_id", F.array_sort(F.coalesce(F.map_keys("gold_evidence"), F.array().cast("array<string>"))).alias("gold_ids"))
    p = predictions.join(gold, "example_id")
    found = p.select(key, "example_id", "gold_ids", F.explode(F.array_distinct("retrieved_chunk_ids")).alias("chunk_id")).join(chunks.select("chunk_id", "example_id", "source_ids"), ["chunk_id", "example_id"])
    found = found.select(key, F.explode(F.array_intersect("source_ids", "gold_ids")).alias("source_id")).groupBy(key).agg(F.array_sort(F.collect_set("source_id")).alias("retrieved_gold_ids"))
    p = p.join(found, key, "left").withColumn("retrieved_gold_ids", F.coalesce("retrieved_gold_ids", F.array().cast("array<string>")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    predicted = F.coalesce("predicted_answer", F.lit(""))
    tests = [
        F.coalesce("error", F.lit("")) != "", yes("exact_match") | yes("numerical_match"), ~yes("citation_valid"), F.size("retrieved_gold_ids") == 0, F.size("retrieved_gold_ids") < F.size("gold_ids"),
        yes("insufficient_evidence") | F.lower(predicted).isin("", "none", "insufficient evidence"), F.lit(True),
    ]
    category = F.lit(None).cast("string")
    for name, test in reversed(list(zip(FAILURES, tests))):
        category = F.when(test, F.lit(name)).otherwise(category)
    return p.withColumn("missing_gold_ids", F.array_except("gold_ids", "retrieved_gold_ids")).withColumn("failure_category", category)
