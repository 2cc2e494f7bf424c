"""References to records that do not exist (at the time of the reference).

Parent keys and child keys are united, tagged, in one long form and grouped by
parent table and key; a reference is kept where its group lacks a live parent.
As parents come and go, "lacks" is a question of time: within a key the rows
are swept in time order with a running count of live parents.

Skew: no group is ever a whole key. Groups are (table, key, day); the count with
which a day starts comes from a pre-aggregate by (table, key, day) - at most one
row per key and calendar day - over which the prefix sum runs. It joins the day's
rows as one more row of the long form, so nothing is joined and nothing is
broadcast: two shuffles. What one key is referred to within one day is the largest
group; its window is a running sum over sorted rows, which streams and spills.

Cases
* a null key, or a null time of a reference: no reference / cannot be judged,
  left out (a null key refers to nothing);
* a parent without ``valid_from`` never existed; ``valid_to`` null = for ever;
  a parent with ``valid_to <= valid_from`` never lived;
* a parent is live at ``valid_from`` and no more at ``valid_to``;
* repeated references (same field, key, time) count once; empty inputs give
  empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_GROUP = ("parent_table", "key")


def bare_id(c: Column) -> Column:
    """The id without outer whitespace, one outer pair of brackets and a leading word CHUNK."""

    def trimmed(x: Column) -> Column:
        return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def unboxed(x: Column) -> Column:
        return F.when(x.startswith("[") & x.endswith("]"), trimmed(F.substr(x, F.lit(2), F.length(x) - 2))).otherwise(x)

    inner = unboxed(trimmed(c))
    word = F.regexp_replace(inner, r"(?U)^CHUNK\s+", "")
    return F.when(word == inner, inner).otherwise(F.when(trimmed(c) == inner, unboxed(trimmed(word))).otherwise(trimmed(word)))


def parent_rows(df: DataFrame, table: str, key: str, valid_from: str, valid_to: str) -> DataFrame:
    """Changes (+1, -1) of the number of live parents, one per key and instant."""
    lives = F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_to) > F.col(valid_from)))
    ends = F.array(F.struct(F.col(valid_from).alias("at"), F.lit(1).alias("delta")), F.struct(F.col(valid_to).alias("at"), F.lit(-1).alias("delta")))
    return (
        df.where(F.col(key).isNotNull() & lives)
        .select(F.col(key).alias("key"), F.inline(ends))
        .where(F.col("at").isNotNull())
        .groupBy("key", "at")
        .agg(F.sum("delta").alias("delta"))
        .select(F.lit(table).alias("parent_table"), "key", "at", "delta")
    )


def child_rows(df: DataFrame, table: str, field: str, key: str, ref_key: str, at: str) -> DataFrame:
    """References of one field in the long form."""
    return df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.lit(table).alias("parent_table"),
        F.col(key).alias("key"),
        F.col(at).alias("at"),
        F.lit(field).alias("ref_field"),
        F.col(ref_key).cast("long").alias("ref_key"),
    )


def orphan_references(parents: DataFrame, children: DataFrame) -> DataFrame:
    """References without a live parent: parent_table, key, at, ref_field, ref_key, ever.

    ``ever`` tells whether the key had a parent at an earlier time (deleted) or
    had none yet (missing or late).
    """
    no = lambda kind: F.lit(None).cast(kind)
    long = parents.select(
        *_GROUP, "at", F.col("delta").cast("long").alias("delta"), F.greatest(F.col("delta"), F.lit(0)).cast("long").alias("born"), F.lit(0).alias("child"), no("string").alias("ref_field"), no("long").alias("ref_key")
    ).unionByName(children.distinct().select(*_GROUP, "at", F.lit(0).cast("long").alias("delta"), F.lit(0).cast("long").alias("born"), F.lit(1).alias("child"), "ref_field", "ref_key"))
    long = long.withColumn("day", F.col("at").cast("date"))

    before = Window.partitionBy(*_GROUP).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        long.groupBy(*_GROUP, "day")
        .agg(F.sum("delta").alias("delta"), F.sum("born").alias("born"), F.max("child").alias("child"))
        .select(*_GROUP, "day", F.sum("delta").over(before).alias("delta"), F.sum("born").over(before).alias("born"), "child")
        .where((F.col("child") == 1) & (F.col("born") > 0))
    )
    opening = carried.select(*_GROUP, F.col("day").cast(children.schema["at"].dataType).alias("at"), "delta", "born", F.lit(-1).alias("child"), no("string").alias("ref_field"), no("long").alias("ref_key"), "day")
    sweep = Window.partitionBy(*_GROUP, "day").orderBy("at", "child").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        long.unionByName(opening)
        .withColumn("live", F.sum("delta").over(sweep))
        .withColumn("ever", F.sum("born").over(sweep) > 0)
        .where((F.col("child") == 1) & (F.col("live") <= 0))
        .select(*_GROUP, "at", "ref_field", "ref_key", "ever")
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per parent table, referring field and month, told apart by ``ever``."""
    return (
        orphans.groupBy("parent_table", "ref_field", F.date_format("at", "yyyy-MM").alias("period"))
        .agg(F.count(F.lit(1)).alias("orphans"), F.count_if(F.col("ever")).alias("of_deleted"), F.count_if(~F.col("ever")).alias("of_missing"))
    )
