"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are tokens of a public tokenizer. Documents are counted by source and exact
token length. A source's budget is its share of the total; it takes whole passes
over all its documents while they fit, and for what remains a selection by length:
the same part of every length up to a room of eight times the longest document, and
for the room a bounded-knapsack dynamic program over all documents left, which comes
as near to the budget from below as they can. A budget within the room is met as
nearly as any selection can; a larger one as nearly as any selection that keeps the
part taken before. Of each length the documents with the smallest seeded hashes are
taken, so equal seeds give equal mixtures.

Total: as given, or the largest at which every source that has tokens reaches its
share without a document being used more than ``max_repeats`` times. Sources
without tokens cannot reach any share; theirs is divided among the others in
proportion, and the report says so.

Distribution: texts are tokenized once and only (id, source, tokens) kept. The
program runs on one source's histogram - at most one row per distinct length. A
length that many documents share is split by hash into 1,024 parts, of which only
the one at the border is cut: what is taken of a length goes out with the lengths
(a broadcast of one row per source and length), documents are not shuffled but those
of border parts, which are ranked.

Cases: sources are compared in lower case with one underscore for any separators;
documents with a null source or one without a target take no part; a null or empty
text has no tokens and takes no part; a target with a null share, or with fewer
than one repeat, counts as zero; repeated target rows are not allowed (the first
by share counts); empty tables give an empty mixture; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PARTS = 1024
#: tokens that the dynamic program fits, unless eight times the longest document are fewer
WINDOW = 1 << 16
#: distinct lengths a source may have for its choices to be broadcast; beyond, they are joined
LENGTHS = 1 << 20

_ENCODERS: dict[int, object] = {}


def _encoder(ranks: bytes, pattern: str):  # noqa: ANN202
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a source and a text; written once."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long"), source_name(F.col("source")).alias("source"), "text")
    return materialize(rows.mapInArrow(count, "doc_id long, source string, tokens long"), "tokens")


def fit_lengths(lengths: dict[int, int], budget: int, window: int = WINDOW) -> dict[int, int]:
    """How many documents of each length to take, of ``lengths`` (length -> documents), for at most ``budget`` tokens."""
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return dict(lengths)
    room = min(budget, window, 8 * max(lengths))
    taken = {n: c * (budget - room) // total for n, c in lengths.items()}
    left = budget - sum(n * k for n, k in taken.items())
    for n in sorted(lengths, reverse=True):  # what rounding left beyond the room
        more = min(lengths[n] - taken[n], max(0, left - room) // n)
        taken[n] += more
        left -= more * n
    full, reach, steps = (1 << (left + 1)) - 1, 1, []
    for n in sorted(lengths):
        free, chunk = min(lengths[n] - taken[n], left // n), 1
        while free > 0 and not reach >> left & 1:
            chunk = min(chunk, free)
            steps.append((n, chunk, reach))
            reach |= reach << (n * chunk) & full
            free, chunk = free - chunk, chunk * 2
    at = reach.bit_length() - 1
    for n, chunk, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += chunk
            at -= n * chunk
    return taken


def budgets(available: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target: share, max_repeats, tokens, wanted_share (of what can be had), budget, total."""
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    t = t.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("share", "max_repeats")).alias("t")).select("source", F.coalesce("t.share", F.lit(0.0)).alias("share"), F.coalesce("t.max_repeats", F.lit(0)).alias("max_repeats"))
    t = t.join(available, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    usable = (F.col("tokens") > 0) & (F.col("share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy(F.lit(0))  # one row per target
    t = t.withColumn("wanted_share", F.when(usable, F.col("share") / F.sum(F.when(usable, F.col("share"))).over(every)).otherwise(0.0))
    most = F.floor(F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("wanted_share"))).over(every))
    t = t.withColumn("total", F.coalesce(most if total is None else F.lit(total), F.lit(0)).cast("long"))
    return t.withColumn("budget", F.least(F.round(F.col("wanted_share") * F.col("total")).cast("long"), F.col("max_repeats") * F.col("tokens")))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """(mixture, plan): doc_id, source, tokens, repeats of every document used; the rows of ``budgets``."""
    docs = token_counts(documents, vocabulary, pattern).where(F.col("tokens") > 0)
    hashed = docs.select("doc_id", "source", "tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    parts = materialize(hashed.groupBy("source", "tokens", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = parts.groupBy("source", "tokens").agg(F.sum("n").alias("n"))
    available = histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("documents"))
    plan = materialize(budgets(available, targets, total), "budgets")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        size = int((group["length"] * group["n"]).sum())
        passes, rest = divmod(int(group["budget"].iloc[0]), size)
        taken = fit_lengths(dict(zip(group["length"].tolist(), group["n"].tolist())), rest)
        return pd.DataFrame({"source": group["source"], "tokens": group["length"], "passes": passes, "take": [taken[n] for n in group["length"].tolist()]})

    wanted = histogram.withColumnRenamed("tokens", "length").join(plan.where(F.col("budget") > 0).select("source", "budget"), "source")
    chosen = wanted.groupBy("source").applyInPandas(choose, "source string, tokens long, passes long, take long")
    chosen = materialize(chosen, "chosen")
    # of each length, the part that holds the last document taken, and how many it gives; parts before it are taken whole
    upto = F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = parts.withColumn("upto", upto).join(chosen, ["source", "tokens"])
    border = F.min(F.when((F.col("upto") >= F.col("take")) & (F.col("take") > 0), F.struct("part", (F.col("take") - F.col("upto") + F.col("n")).alias("cut"), "n")))
    cuts = materialize(counted.groupBy("source", "tokens", "passes").agg(border.alias("b")).select("source", "tokens", "passes", F.coalesce("b.part", F.lit(-1)).alias("border"), F.coalesce("b.cut", F.lit(0)).alias("cut"), F.coalesce("b.n", F.lit(0)).alias("of")), "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= LENGTHS else cuts
    used = hashed.join(cuts, ["source", "tokens"])
    at_border = (F.col("part") == F.col("border")) & (F.col("cut") < F.col("of"))
    place = F.row_number().over(Window.partitionBy("source", "tokens").orderBy("h", "doc_id"))
    cut = used.where(at_border).withColumn("more", F.when(place <= F.col("cut"), 1).otherwise(0))
    whole = used.where(~at_border).withColumn("more", F.when(F.col("part") <= F.col("border"), 1).otherwise(0))
    used = cut.unionByName(whole).withColumn("repeats", F.col("passes") + F.col("more"))
    return used.where(F.col("repeats") > 0).select("doc_id", "source", "tokens", "repeats"), plan


def shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of every source."""
    used = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    out = plan.join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
    return out.select(
        "source", F.col("share").alias("target_share"), "max_repeats", F.col("documents").alias("available_documents"), F.col("tokens").alias("available_tokens"), "wanted_share", "budget",
        zero("used_documents").alias("used_documents"), zero("used_tokens").alias("used_tokens"), zero("most_repeats").alias("most_repeats"), (zero("used_tokens") / every).alias("actual_share"),
    )

