"""Queries of the training-data problems (p2, p5, p6, p7, p8) on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import leakage, ledger, mixture, neighbours, subjects

# ---------------------------------------------------------------- p2: duplicates hidden by formatting


def _chunk_rows(spark: SparkSession, root: str) -> DataFrame:
    return ledger.keyed_rows(table(spark, root, "chunks", "chunk_ord", "document_id", "content", "ingested_at"), "document_id", "content", "chunk_ord", "ingested_at")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows = _chunk_rows(spark, root)
    return ledger.membership(rows, ledger.build(rows).entries()).select(F.col("keep").alias("keep_ord"), F.col("copy").alias("copy_ord"))


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    """One row per record: its earliest row and the number of copies."""
    return ledger.build(_chunk_rows(spark, root)).entries().select(F.col("first").alias("keep_ord"), F.col("n").alias("copies"))


_P2_SQL_KEYS = r"""
marked as (
  select chunk_ord, lower(regexp_replace(document_id, '[^\p{L}\p{N}]+', '', 'g')) as doc, content is null as absent,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(content, '')),
      '\([\s\x{a0}]*(-?[\s\x{a0}]*\$?[\s\x{a0}]*-?\d[\d.,]*[\s\x{a0}]*%?)[\s\x{a0}]*\)', chr(57344) || '\1' || chr(57345), 'g'),
      '(^|[^\p{L}\p{N}])-(\$?[\s\x{a0}]*\.?\d)', '\1' || chr(57346) || '\2', 'g'),
      '(\d)\.(\d)', '\1' || chr(57347) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(57347) || '\2', 'g'),
      '(^|[^\p{L}\p{N}.])\.(\d)', '\1' || chr(57347) || '\2', 'g') as t
  from chunks where document_id is not null),
keyed as (
  select chunk_ord, doc, absent,
    case when regexp_matches(t, '^\W*table[\s\x{a0}]*row\b\W*?[.:]')
      then 'tablerow' || array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '^\W*table[\s\x{a0}]*row\b\W*?[.:]', ''), '[;|]'),
        lambda x: regexp_replace(x, '[^\p{L}\p{N}\p{M}%$\x{e000}-\x{e003}]+', '', 'g')), lambda x: x <> '')), chr(57348))
      else regexp_replace(t, '[^\p{L}\p{N}\p{M}%$\x{e000}-\x{e003}]+', '', 'g') end as c
  from marked),
records as (select doc, absent, c, min(chunk_ord) as keep_ord, count(*) as copies from keyed group by all)
"""

P2_SQL = {
    "p2_found": f"with {_P2_SQL_KEYS} select r.keep_ord, k.chunk_ord as copy_ord from keyed k join records r using (doc, absent, c) where k.chunk_ord <> r.keep_ord",
    "p2_records": f"with {_P2_SQL_KEYS} select keep_ord, copies from records",
}

# ---------------------------------------------------------------- p6: evaluation texts in training text


def p6_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_leaks(spark, root).select("doc_id", "item_id")

# ---------------------------------------------------------------- p8: subject areas


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents", "doc_id", "text")
    models = subjects.fit(documents, table(spark, root, "doc_labels", "doc_id", "subject"), table(spark, root, "subject_areas", "subject", "description"))
    return subjects.document_shares(documents, models)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return subjects.subjects_of(p8_shares(spark, root))


def p8_composition(spark: SparkSession, root: str) -> DataFrame:
    """The corpus by subject: documents, and their sentences of the subject."""
    shares = p8_shares(spark, root).where(F.col("share") >= subjects.SHARE)
    return shares.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.round(F.col("share") * F.col("sentences"))).cast("long").alias("sentences"))

# ---------------------------------------------------------------- p5: most similar vectors

DIMS, NEAREST, LEAST_COSINE = 96, 5, 0.84


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_vectors", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, root), DIMS, LEAST_COSINE, NEAREST).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))

def p5_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest of all vectors for every vector whose id is divisible by 100, however far they are."""
    v = _vectors(spark, root)
    n = neighbours.nearest(v, v.where(F.col("id") % 100 == 0), DIMS, NEAREST)
    return n.select(F.col("id").alias("vec_id"), "rank", F.col("near").alias("near_id"), F.round("cosine", 6).alias("cosine"))


# ---------------------------------------------------------------- p7: mixing sources


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, root, "documents", "doc_id", "source", "text"), table(spark, root, "mix_targets"))


def p7_mixture(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root)[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixture.shares(*_mix(spark, root))
