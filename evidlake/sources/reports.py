"""Raw report files: one JSON array of records, or a JSON record a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the shape of a record.
RECORD = (
    "struct<id:string,filename:string,pre_text:array<string>,table:array<array<string>>,post_text:array<string>,"
    "qa:struct<question:string,answer:string,gold_inds:map<string,string>,program:string,exe_ans:string,"
    "explanation:string,ann_table_rows:array<int>,ann_text_rows:array<int>>>"
)


def load_raw(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(ord, record) of a file or a folder; ``ord`` is the place: file, then place in the file.

    A file of lines is split by Spark, and lines that are no records are passed over; one array is
    read by one task, and a file that holds no array of records is an error.
    """
    file = F.col("_metadata.file_path").alias("file")
    if lines:
        at = F.struct(file, (F.col("_metadata.file_block_start").cast("decimal(38,0)") * (1 << 62) + F.monotonically_increasing_id()).alias("place"))
        return spark.read.text(path).select(at.alias("ord"), F.from_json("value", RECORD).alias("record")).where(F.col("record").isNotNull())
    read = F.from_json("value", f"array<{RECORD}>")
    read = F.when(read.isNull(), F.raise_error(F.concat(F.lit("no array of records in "), F.col("file")))).otherwise(read)
    rows = spark.read.text(path, wholetext=True).select(file, "value").select("file", F.posexplode(read).alias("place", "record"))
    return rows.select(F.struct("file", F.col("place").cast("decimal(38,0)").alias("place")).alias("ord"), "record")


def parse(raw: DataFrame) -> DataFrame:
    """Records as examples; records without id, filename, question or answer are refused."""
    r, qa = F.col("record"), F.col("record.qa")
    missing = r["id"].isNull() | r["filename"].isNull() | qa["question"].isNull() | qa["answer"].isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("record "), F.col("ord").cast("string"), F.lit(" lacks a required field")))).otherwise(r["id"])
    empty = F.array().cast("array<int>")
    return raw.select(
        "ord", checked.alias("example_id"), r["filename"].alias("document_id"), qa["question"].alias("question"), qa["answer"].alias("answer"), r["pre_text"].alias("pre_text"), r["table"].alias("table_rows"), r["post_text"].alias("post_text"),
        F.coalesce(qa["gold_inds"], F.create_map().cast("map<string,string>")).alias("gold_evidence"), qa["program"].alias("gold_program"),
        F.struct(
            qa["exe_ans"].alias("gold_numeric_answer"), qa["explanation"].alias("answer_explanation"),
            F.coalesce(qa["ann_table_rows"], empty).alias("annotated_table_rows"), F.coalesce(qa["ann_text_rows"], empty).alias("annotated_text_rows"),
        ).alias("metadata"),
    )


def load_examples(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Examples in the order of files, the first ``limit`` of them."""
    out = parse(load_raw(spark, path, lines))
    return out if limit is None else out.orderBy("ord").limit(limit)
