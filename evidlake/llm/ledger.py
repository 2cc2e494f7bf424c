"""Duplicates hidden by formatting differences, kept in an incremental ledger.

Every record gets a canonical key. The ledger is a folder that lasts: keys,
hash-bucketed and sorted by key, with the number of copies and the earliest
representative. A new batch is first aggregated (map-side partial counts, so a key
that holds a third of all rows shuffles one row per task) and then full-outer-joined
with the ledger bucket by bucket: the batch's aggregate is shuffled into the ledger's
buckets, the ledger is read where it lies and written where it was read, without
a shuffle. Counts are added, the smaller representative is kept.

A merge writes a new generation beside the old one; ``ledger.json`` names the valid
one and is replaced last, so a merge that dies leaves the ledger as it was.
``Ledger(spark, path)`` opens a ledger of an earlier session.

Membership (which row belongs to which record) joins the rows' keys with the
ledger. Keys with more than one in ``HOT_PART`` of all rows are fewer than
``HOT_PART``, so they are broadcast; all others are too small to skew a join.

Cases: rows with a null record id are left out; a null content is a value of its
own (equal only to null); empty contents of one record are copies; very long texts
are hashed in the JVM as a whole; repeated rows are copies; an empty input gives
an empty ledger; further columns are not touched.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, scratch_path, scratch_root

HOT_PART = 1000
#: Spark knows buckets of catalogued tables only; ledgers in use are catalogued here
DATABASE = "evidlake_ledgers"

# Private-use marks for content that looks like punctuation.
_OPEN, _CLOSE, _MINUS, _POINT, _CELL = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"


def letters_and_digits(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def canonical_content(c: Column) -> Column:
    """Content without letter case, whitespace and punctuation.

    Marks kept: decimal points, a minus directly before a number, parentheses around
    a number, % and $. In table rows the cells are sorted.
    """
    t = F.lower(c)
    t = F.regexp_replace(t, r"(?U)\(\s*(-?\s*\$?\s*-?\d[\d.,]*\s*%?)\s*\)", f"{_OPEN}$1{_CLOSE}")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])-(?=\$?(?U:\s)*\.?\d)", _MINUS)
    t = F.regexp_replace(t, r"(?<=\d)\.(?=\d)|(?<![\p{L}\p{N}.])\.(?=\d)", _POINT)
    strip = lambda x: F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}\p{{M}}%${_OPEN}{_CLOSE}{_MINUS}{_POINT}]+", "")
    head = r"(?U)^\W*table\s*row\b\W*?[.:]"
    cells = F.array_sort(F.filter(F.transform(F.split(F.regexp_replace(t, head, ""), r"[;|]"), strip), lambda x: x != ""))
    return F.when(t.rlike(head), F.concat(F.lit("tablerow" + _CELL), F.array_join(cells, _CELL))).otherwise(strip(t))


def canonical_key(*parts: Column) -> Column:
    """16 bytes for the canonical parts; null parts differ from empty ones."""
    marked = [F.coalesce(F.concat(F.lit("v"), p), F.lit("n")) for p in parts]
    return F.unhex(F.md5(F.concat_ws("\ue005", *marked)))


class Ledger:
    """Counts and earliest representatives by key, in the folder ``path`` (without one, for this session only)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = self._known()
        self.buckets = known["buckets"] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._table: str | None = None
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{scratch_root(spark)}/{DATABASE}'")  # holds no data: all tables lie elsewhere
        self._use(known["generation"] if known else None)

    def _known(self) -> dict | None:
        for name in ("ledger.json", "ledger.new"):  # the second where a merge died between its last two steps
            if self._fs.exists(self._at(f"{self.path}/{name}")):
                return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])
        return None

    def _use(self, generation: str | None) -> None:
        """Catalogue a generation; without one, an empty table."""
        self.close()
        name = f"{DATABASE}.g{uuid.uuid4().hex}"
        where = f"{self.path}/{generation or 'empty'}"
        self._fs.mkdirs(self._at(where))
        self.spark.sql(f"CREATE TABLE {name} (key BINARY, n BIGINT, first BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        self._table, self._generation = name, generation

    def merged(self, batch: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
        """The entries with the rows of a batch (columns ``key`` and ``order``) added."""
        new = batch.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("new_n"), F.min(order).alias("new_first"))
        usual = max(int(self.spark.conf.get(c, "1") or 1) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
        if self.buckets < usual:  # else Spark would rather shuffle both sides into its usual number of parts
            new = new.repartition(self.buckets, "key")
        both = self.entries().join(new, "key", "full_outer")
        return both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"), F.least("first", "new_first").alias("first"))

    def merge(self, batch: DataFrame, key: str = "key", order: str = "ord") -> None:
        """Adds the rows of a batch for good."""
        before, generation = self._generation, f"generation-{uuid.uuid4().hex}"
        name = f"{DATABASE}.w{uuid.uuid4().hex}"
        out = self.merged(batch, key, order)
        out.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{generation}").format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        self._name(generation)
        self._use(generation)
        if before:
            release(self.spark, f"{self.path}/{before}")

    def _name(self, generation: str) -> None:
        """Make a generation the valid one, in one step."""
        new, final = self._at(f"{self.path}/ledger.new"), self._at(f"{self.path}/ledger.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "generation": generation}).encode()))
        out.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        self._fs.rename(new, final)

    def entries(self) -> DataFrame:
        """(key, n, first), read by buckets."""
        if self._table is None:
            raise ValueError("the ledger is closed")
        return self.spark.table(self._table)

    def close(self) -> None:
        """Take the ledger out of the catalogue; its folder stays."""
        if self._table is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table}")
            self._table = None


def membership(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(keep, copy): the representative of each record of two or more, with each of its other rows."""
    many = ledger.where(F.col("n") > 1)
    total = ledger.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(total // HOT_PART, 10_000)
    hot = F.broadcast(many.where(F.col("n") > limit))
    pairs = rows.join(many.where(F.col("n") <= limit), "key").unionByName(rows.join(hot, "key"))
    return pairs.where(F.col("ord") != F.col("first")).select(F.col("first").alias("keep"), F.col("ord").alias("copy"))


def keyed_rows(df: DataFrame, record: str, content: str, order: str, arrived: str) -> DataFrame:
    """(ord, key, batch): canonical keys, computed once and written; ``batch`` is the year of arrival."""
    rows = df.where(F.col(record).isNotNull()).select(
        F.col(order).alias("ord"), canonical_key(letters_and_digits(F.col(record)), canonical_content(F.col(content))).alias("key"), F.coalesce(F.year(arrived), F.lit(0)).alias("batch")
    )
    return materialize(rows, "keyed", by="batch")


def build(rows: DataFrame, path: str | None = None) -> Ledger:
    """A ledger of all batches, in order of arrival; each merge reads its batch's folder only."""
    ledger = Ledger(rows.sparkSession, path)
    for (b,) in rows.select("batch").distinct().orderBy("batch").collect():  # years: a handful
        ledger.merge(rows.where(F.col("batch") == b))
    return ledger
