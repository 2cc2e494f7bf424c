"""Structure-aware chunking: reports to table-row and paragraph chunks.

One chunk per table row below the header and per paragraph that is not blank.
Blank paragraphs still use up a number. Chunks of an example are ordered:
paragraphs before the table, table rows, paragraphs after it; ``pos`` numbers
them in that order (with gaps where nothing was emitted), so (example_id, pos) is
a total order without a global sort. It is one narrow generator: no shuffle.

Cases: null arrays are empty ones; a table without rows or with a header only
gives no table chunks; cells beyond the header are dropped; a row shorter than the
header keeps the cells it has and is marked ``ragged``; null cells read as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def header_of(table: Column) -> Column:
    return F.get(table, F.lit(0))


def row_content(header: Column, row: Column) -> Column:
    """``table row. name: value; name: value``"""
    n = F.least(F.size(header), F.size(row))
    cells = F.zip_with(F.slice(header, 1, n), F.slice(row, 1, n), lambda h, v: F.concat(F.coalesce(h, F.lit("")), F.lit(": "), F.coalesce(v, F.lit(""))))
    return F.concat(F.lit("table row. "), F.array_join(cells, "; "))


def _rows(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def _paragraphs(array: Column, section: str, first: Column, offset: Column) -> Column:
    def chunk(p: Column, i: Column) -> Column:
        number = first + i
        return F.struct(
            (offset + i).alias("pos"), F.lit("text").alias("chunk_type"), F.lit(section).alias("section"), T.strip(F.coalesce(p, F.lit(""))).alias("content"), number.alias("number"),
            F.concat(F.lit("text_"), number.cast("string")).alias("source_id"), i.alias("row_index"), number.alias("text_index"), F.lit(None).cast("array<string>").alias("header"), F.lit(False).alias("ragged"),
        )

    return F.filter(F.transform(array, chunk), lambda c: c["content"] != "")


def chunks_of(pre: Column, table: Column, post: Column) -> Column:
    """Array of chunk structs of one report."""
    pre, post, table = _rows(pre), _rows(post), F.coalesce(table, F.array().cast("array<array<string>>"))
    header, zero = _rows(header_of(table)), F.lit(0)

    def row(cells: Column, i: Column) -> Column:
        cells, number = _rows(cells), i + 1
        return F.struct(
            (F.size(pre) + i).alias("pos"), F.lit("table").alias("chunk_type"), F.lit("table").alias("section"), row_content(header, cells).alias("content"), number.alias("number"),
            F.concat(F.lit("table_"), number.cast("string")).alias("source_id"), number.alias("row_index"), F.lit(None).cast("int").alias("text_index"), header.alias("header"), (F.size(cells) < F.size(header)).alias("ragged"),
        )

    body = F.when(F.size(table) > 1, F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(_paragraphs(pre, "pre_text", zero, zero), F.transform(body, row), _paragraphs(post, "post_text", F.size(pre), F.size(pre) + F.size(table)))


def chunks(examples: DataFrame) -> DataFrame:
    """Chunks of ``examples`` (example_id, document_id, pre_text, table_rows, post_text)."""
    out = examples.select("example_id", "document_id", F.inline(chunks_of(F.col("pre_text"), F.col("table_rows"), F.col("post_text"))))
    return out.select(
        F.concat_ws("::", "example_id", "section", F.col("number").cast("string")).alias("chunk_id"), "example_id", "document_id", "pos", "chunk_type", "section", "content",
        F.array("source_id").alias("source_ids"), "row_index", "text_index", "header", "ragged",
    )


def table_chunks(examples: DataFrame) -> DataFrame:
    return chunks(examples).where("section = 'table'")


def text_chunks(examples: DataFrame) -> DataFrame:
    return chunks(examples).where("section <> 'table'")


def last_delivered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with the same key the last by ``order``, nulls first (rows without a key are left out).

    An aggregate with partial results on the map side, so a key delivered very often moves one row a task.
    """
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_last")).select(key, "_last.*").select(*df.columns)


def gold_overlap(chunked: DataFrame, examples: DataFrame) -> DataFrame:
    """Per example: its chunks, and how many of them are gold evidence."""
    gold = examples.select("example_id", F.map_keys("gold_evidence").alias("gold"))
    both = gold.join(chunked.select("example_id", "source_ids"), "example_id", "left")
    is_gold = F.coalesce(F.arrays_overlap("source_ids", "gold"), F.lit(False))
    return both.groupBy("example_id").agg(F.count("source_ids").alias("chunks"), F.count_if(is_gold).alias("gold_chunks"))


def profile(examples: DataFrame) -> DataFrame:
    """Sizes of an example in one row."""
    return examples.select(
        "example_id", "document_id", "question", "answer", F.size(_rows(F.col("pre_text"))).alias("pre_paragraphs"), F.coalesce(F.size("table_rows"), F.lit(0)).alias("table_rows"),
        F.size(_rows(F.col("post_text"))).alias("post_paragraphs"), F.coalesce(F.size(F.map_keys("gold_evidence")), F.lit(0)).alias("gold_items"), "gold_program",
    )
