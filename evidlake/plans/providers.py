"""Services behind interfaces, with deterministic offline stand-ins.

A service is a function on a list of texts, called in Arrow batches on the executors
with retries; the stand-ins are expressions in the JVM.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import answers, dense
from ..session import materialize


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class Answerer(Protocol):
    def answer(self, asked: DataFrame) -> DataFrame:
        """Adds ``payload`` to (query_id, question, evidence, retrieved)."""


def service_key(variable: str) -> str:
    """The key of a service from the environment; an error without one, before any work begins."""
    key = os.environ.get(variable, "").strip()
    if not key:
        raise ValueError(f"{variable} is not set")
    return key


def with_retries(call: Callable[[list[str]], list], texts: list[str], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> list:
    """The service's results; waits 1, 2, 4, ... seconds between attempts."""
    for attempt in range(1, attempts + 1):
        try:
            return call(texts)
        except Exception:
            if attempt == attempts:
                raise
            wait(2 ** (attempt - 1))
    raise ValueError("attempts must be positive")


def batches_of(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


class HashedEmbedder:
    """Counts of tokens by hash."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, dense.hashed_embedding(F.col(text), self.dims))


class ServiceEmbedder:
    """Vectors from a service, ``batch`` texts a call; null texts have null vectors."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], batch: int = 32, attempts: int = 3) -> None:
        self.call, self.batch, self.attempts = call, batch, attempts

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                there = part[text].notna()
                vectors: list = []
                for texts in batches_of(part.loc[there, text].tolist(), self.batch):
                    vectors += with_retries(self.call, texts, self.attempts)
                column = pd.Series([None] * len(part), index=part.index, dtype=object)
                column[there] = pd.Series(vectors, index=part.index[there], dtype=object)
                yield part.assign(**{out: column})

        return materialize(df.mapInPandas(run, schema), "embedded")  # so that no text is sent twice


class TopChunkAnswerer:
    """Cites the best chunk and repeats its last number; abstains without evidence."""

    def answer(self, asked: DataFrame) -> DataFrame:
        top = F.get("retrieved", F.lit(0))["chunk_id"]
        body = F.regexp_extract("evidence", r"(?s)content:\n(.*?)(?:\n\n\[CHUNK |$)", 1)
        number = F.try_element_at(F.regexp_extract_all(body, F.lit(r"-?\$?\s?\d+(?:,\d{3})*(?:\.\d+)?%?"), F.lit(0)), F.lit(-1))
        found = F.to_json(F.struct(F.coalesce(number, F.lit("")).alias("answer"), F.array(F.struct(top.alias("chunk_id"), F.lit("").alias("quote"))).alias("citations"), F.lit(False).alias("insufficient_evidence")))
        none = F.to_json(F.struct(F.lit(answers.ABSTENTION).alias("answer"), F.lit(True).alias("insufficient_evidence")))
        return asked.withColumn("payload", F.when(top.isNotNull(), found).otherwise(none))


class ServiceAnswerer:
    """Payloads from a service, one prompt a text; it gives a payload, or a payload with its input, output and total tokens."""

    def __init__(self, call: Callable[[list[str]], list[str]], batch: int = 8, attempts: int = 3) -> None:
        self.call, self.batch, self.attempts = call, batch, attempts

    def answer(self, asked: DataFrame) -> DataFrame:
        call, batch, attempts = self.call, self.batch, self.attempts

        @F.pandas_udf("payload string, input_tokens long, output_tokens long, total_tokens long")
        def run(prompts: pd.Series) -> pd.DataFrame:
            out: list = []
            for texts in batches_of(prompts.tolist(), batch):
                out += with_retries(call, texts, attempts)
            rows = [(*x, None, None, None)[:4] if isinstance(x, tuple) else (x, None, None, None) for x in out]
            return pd.DataFrame(rows, columns=["payload", "input_tokens", "output_tokens", "total_tokens"]).astype({c: "Int64" for c in ("input_tokens", "output_tokens", "total_tokens")})

        said = asked.withColumn("said", run.asNondeterministic()(answers.prompt(F.col("question"), F.coalesce("evidence", F.lit("")))))
        said = materialize(said, "payloads")  # so that no prompt is sent twice
        return said.select(*asked.columns, "said.*")


def rewritten(df: DataFrame, call: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Adds ``query``: by the service where it answers with one, else by rules."""
    from ..operators import routing

    rule = routing.rewrite(F.coalesce("question", F.lit("")))
    if call is None:
        return df.withColumn("query", rule)

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        try:
            return pd.Series(with_retries(call, prompts.tolist()))
        except Exception:  # a failing service leaves it to the rules
            return pd.Series([None] * len(prompts), dtype=object)

    asked = materialize(df.withColumn("_said", run(answers.rewrite_prompt(F.coalesce("question", F.lit(""))))), "rewrites")  # so that no prompt is sent twice
    said = F.trim(F.try_variant_get(answers.json_object(F.col("_said")), "$.query", "string"))
    return asked.withColumn("query", F.coalesce(F.when(said != "", said), rule)).drop("_said")
