"""Answers as data: evidence blocks, prompts, payload parsing, citations.

Cases: a payload without a JSON object has ``valid`` false and empty fields; members of
other types than expected are dropped or read as text; null lists are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import calculation

# Formats and texts.
ABSTENTION = "Insufficient evidence"
PROMPT = "Question:\n%s\n\nEvidence:\n%s\n\nAnswer with one JSON object with the members answer, citations (chunk_id, quote), calculation, calculation_steps (operation, arguments), answer_unit, answer_scale, insufficient_evidence."
REWRITE_PROMPT = "Rewrite the question as a short search query and answer with one JSON object with the member query.\n\nQuestion:\n%s"


def evidence_block(chunk: Column) -> Column:
    return F.concat(
        F.lit("[CHUNK "), chunk["chunk_id"], F.lit("]\ntype: "), chunk["chunk_type"], F.lit("\nsection: "), chunk["section"],
        F.lit("\nsource_ids: "), F.array_join(chunk["source_ids"], ", "), F.lit("\ncontent:\n"), F.coalesce(chunk["content"], F.lit("")),
    )


def evidence(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, evidence, retrieved): the blocks in order of rank, and the retrieved (chunk_id, source_ids)."""
    r = results.join(chunks, ["example_id", "pos"]).select("query_id", "rank", F.struct("chunk_id", "chunk_type", "section", "source_ids", "content").alias("c"))
    r = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("l"))
    return r.select(
        "query_id", F.array_join(F.transform("l", lambda x: evidence_block(x["c"])), "\n\n").alias("evidence"),
        F.transform("l", lambda x: F.struct(x["c"]["chunk_id"].alias("chunk_id"), x["c"]["source_ids"].alias("source_ids"))).alias("retrieved"),
    )


def prompt(question: Column, blocks: Column) -> Column:
    return F.format_string(PROMPT, question, blocks)


def rewrite_prompt(question: Column) -> Column:
    return F.format_string(REWRITE_PROMPT, question)


def json_object(text: Column) -> Column:
    """The JSON value in a text, code fences aside, else its part from the first { to the last }; a variant."""
    t = T.strip(text)
    fenced = T.strip(F.regexp_replace(T.strip(F.regexp_replace(t, r"^```(?:json)?", "")), r"```$", ""))
    t = F.when(t.startswith("```"), fenced).otherwise(t)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)))


def bare_chunk_id(c: Column) -> Column:
    t = T.strip(c)
    return F.when(t.startswith("CHUNK "), T.strip(F.substr(t, F.lit(7)))).otherwise(t)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _objects(v: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _arguments(step: Column) -> Column:
    """The arguments of a step; a text stands for its characters."""
    listed = F.try_variant_get(step, "$.arguments", "array<variant>")
    text = F.when(F.schema_of_variant(F.try_variant_get(step, "$.arguments", "variant")) == "STRING", F.try_variant_get(step, "$.arguments", "string"))
    letters = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("variant"))
    return F.coalesce(listed, letters, F.array().cast("array<variant>"))


def steps_text(steps: Column) -> Column:
    """Steps as JSON; empty without steps."""
    one = lambda s: F.concat(F.lit('{"operation": '), F.to_json(s["operation"].cast("variant")), F.lit(', "arguments": ['), F.array_join(F.transform(s["arguments"], lambda a: F.to_json(a)), ", "), F.lit("]}"))
    return F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit("["), F.array_join(F.transform(steps, one), ", "), F.lit("]")))


def with_usage(said: DataFrame) -> DataFrame:
    """Answers with the tokens that the service reports for each question; none are 0, a missing total is the sum."""
    for c in ("input_tokens", "output_tokens"):
        said = said.withColumn(c, F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in said.columns else F.lit(0).cast("long"))
    total = F.col("input_tokens") + F.col("output_tokens")
    return said.withColumn("total_tokens", F.coalesce(F.nullif(F.col("total_tokens").cast("long"), F.lit(0)), total) if "total_tokens" in said.columns else total)


def parse(text: Column) -> Column:
    """struct of an answer payload."""
    v = json_object(text)
    truth = F.try_variant_get(v, "$.insufficient_evidence", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.insufficient_evidence", "variant"))
    false = truth.isNull() | (truth == "") | ((kind != "STRING") & truth.isin("false", "0", "0.0", "[]", "{}"))
    return F.struct(
        F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("valid"),
        F.coalesce(_text(v, "$.answer"), F.lit("")).alias("answer"),
        F.transform(_objects(v, "$.citations"), lambda c: F.struct(bare_chunk_id(F.coalesce(_text(c, "$.chunk_id"), F.lit(""))).alias("chunk_id"), F.coalesce(_text(c, "$.quote"), F.lit("")).alias("quote"))).alias("citations"),
        _text(v, "$.calculation").alias("calculation"),
        F.transform(_objects(v, "$.calculation_steps"), lambda s: F.struct(F.coalesce(_text(s, "$.operation"), F.lit("")).alias("operation"), _arguments(s).alias("arguments"))).alias("steps"),
        _text(v, "$.answer_unit").alias("answer_unit"), _text(v, "$.answer_scale").alias("answer_scale"), (~false).alias("insufficient_evidence"),
    )


def canonical_citations(cited: Column, retrieved: Column) -> Column:
    """Cited ids; one that is the source id of exactly one retrieved chunk becomes that chunk's id."""
    ids = F.transform(retrieved, lambda r: r["chunk_id"])

    def one(c: Column) -> Column:
        owners = F.filter(retrieved, lambda r: F.array_contains(r["source_ids"], c))
        return F.when(~F.array_contains(ids, c) & (F.size(owners) == 1), F.get(owners, F.lit(0))["chunk_id"]).otherwise(c)

    return F.transform(cited, one)


def invalid_citations(cited: Column, retrieved: Column) -> Column:
    return F.array_except(cited, F.transform(retrieved, lambda r: r["chunk_id"]))


def finished(payloads: DataFrame) -> DataFrame:
    """Answers of (query_id, payload, retrieved): parsed, citations made canonical, program executed, citations checked."""
    p = payloads.withColumn("p", parse(F.col("payload"))).withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<struct<chunk_id:string,source_ids:array<string>>>")))
    p = p.withColumn("cited", canonical_citations(F.transform("p.citations", lambda c: c["chunk_id"]), F.col("retrieved")))
    runs = ~F.col("p.insufficient_evidence") & (F.size("p.steps") > 0)
    p = p.withColumn("x", F.when(runs, calculation.execute(F.col("p.steps"), F.col("p.answer_unit"), F.col("p.answer_scale"))))
    wrong = invalid_citations(F.col("cited"), F.col("retrieved"))
    done = F.col("x").isNotNull() & F.col("x.error").isNull()
    error = F.when(~F.col("p.valid"), "The payload holds no JSON object.").when(F.size(wrong) > 0, F.concat(F.lit("Citations are not among the retrieved chunks: "), F.array_join(wrong, ", ")))
    return p.select(
        "query_id", F.when(done, F.col("x.formatted")).otherwise(F.col("p.answer")).alias("answer"), F.col("cited"),
        F.zip_with("cited", "p.citations", lambda c, q: F.struct(c.alias("chunk_id"), q["quote"].alias("quote"))).alias("citations"), steps_text(F.col("p.steps")).alias("calculation_steps"),
        F.transform("retrieved", lambda r: r["chunk_id"]).alias("retrieved_chunk_ids"),
        F.when(done, F.coalesce("x.trace", "p.calculation")).otherwise(F.col("p.calculation")).alias("calculation"), F.col("p.insufficient_evidence").alias("insufficient_evidence"),
        F.col("p.answer_unit").alias("answer_unit"), F.col("p.answer_scale").alias("answer_scale"), F.when(done, F.col("x.formatted")).alias("executed_answer"), F.col("x.error").alias("execution_error"), error.alias("error"),
    )


def cost(input_tokens: Column, output_tokens: Column, input_price: float | None, output_price: float | None) -> Column:
    """Dollars by prices per million tokens; null unless both prices are known."""
    if input_price is None or output_price is None:
        return F.lit(None).cast("double")
    return input_tokens / 1_000_000 * input_price + output_tokens / 1_000_000 * output_price
