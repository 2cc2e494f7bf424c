"""Rank fusion, neighbour expansion, merging of two passes.

Results are rows (query_id, rank, score, example_id, pos). Order is always a column.
All operators are one aggregate or window by query; a query's results are at most
a few k, so none of these groups grows with the data.

Cases: no results stay no results; a chunk that comes twice counts at its best place;
ties keep the first list, then the earlier rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
DIGITS = 9
KEY = ["query_id", "example_id", "pos"]


def renumbered(df: DataFrame, *order, k: int | None = None) -> DataFrame:  # noqa: ANN002
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over the rankings; ties keep the order of first appearance."""
    lists = [r.select(*KEY, "rank", F.lit(i).alias("no")) for i, r in enumerate(rankings)]
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return fused_ranking(every, k, rrf_k)


def fused_ranking(every: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """The same for rankings in one table, told apart and ordered by ``no``."""
    fused = every.groupBy(*KEY).agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.min(F.struct("no", "rank")).alias("first"))
    return renumbered(fused, F.round("score", 12).desc(), "first", k=k).select("query_id", "rank", "score", "example_id", "pos")


def expand_with_neighbors(results: DataFrame, chunks: DataFrame, window: int, only: DataFrame | None = None) -> DataFrame:
    """Results, then for each in turn the chunks up to ``window`` rows before and after it in its section.

    A neighbour has the score of the first result beside it. ``chunks`` has
    example_id, pos, section, row_index. The range is an equi-join on shifted rows.
    With ``only`` (query_id) the results of other queries stay as they are.
    """
    if window <= 0:
        return results
    places = chunks.select("example_id", "pos", "section", "row_index")
    seeds = (results if only is None else results.join(only, "query_id", "left_semi")).join(places, ["example_id", "pos"])
    seeds = seeds.select("query_id", "example_id", "section", "row_index", "rank", "score")
    shifts = F.explode(F.array(*(F.lit(i) for i in range(-window, window + 1) if i)))
    around = seeds.select("query_id", "example_id", "section", F.col("rank").alias("seed"), "score", "row_index", shifts.alias("shift")).withColumn("row_index", F.col("row_index") + F.col("shift"))
    around = around.join(places, ["example_id", "section", "row_index"]).select(*KEY, F.struct(F.lit(1).alias("late"), F.col("seed").alias("seed"), F.col("shift").alias("shift"), "score").alias("at"))
    own = results.select(*KEY, F.struct(F.lit(0).alias("late"), F.col("rank").alias("seed"), F.lit(0).alias("shift"), "score").alias("at"))
    first = own.unionByName(around).groupBy(*KEY).agg(F.min("at").alias("at"))
    return renumbered(first, "at.late", "at.seed", "at.shift").select("query_id", "rank", F.col("at.score").alias("score"), "example_id", "pos")


def merge_results(primary: DataFrame, corrective: DataFrame, k: int) -> DataFrame:
    """Both passes; a chunk in both has its higher score at its first place; best k."""
    columns = [*KEY, "score", "rank"]
    return merged_ranking(primary.select(*columns, F.lit(0).alias("no")).unionByName(corrective.select(*columns, F.lit(1).alias("no"))), k)


def merged_ranking(both: DataFrame, k: int) -> DataFrame:
    """The same for passes in one table, told apart and ordered by ``no``."""
    one = both.groupBy(*KEY).agg(F.max("score").alias("score"), F.min(F.struct("no", "rank")).alias("at"))
    return renumbered(one, F.round("score", DIGITS).desc(), "at", k=k).select("query_id", "rank", "score", "example_id", "pos")
