import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidlake.llm import ledger, problems

ROOT = "/root/testdata/sf0.001"
SCHEMA = "chunk_ord long, document_id string, content string, ingested_at timestamp, key string"


def key(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(ledger.canonical_content(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Net  Revenue, rose.", "net revenue rose", True), ("long-term", "Long term", True), ("$ 1,234.5", "$1234.5", True), ("$5", "5", False), ("5%", "5", False), ("1.5", "15", False), ("-5", "5", False), ("in -2009", "in 2009", False),
        ("( 107.2 )", "(107.2)", True), ("(107.2)", "107.2", False), ("(see note 6)", "see note 6", True), ("year-end 2009", "year end 2009", True), ("costs 458.", "costs 458", True), ("2008 , a", "2008, a", True), ("a b\n", "a b", True),
        ("table row. a: 1; b: 2", "Table Row: b: 2 | a: 1", True), ("table row. a: 1; b: 2", "TABLE ROW. b : 2 ;a: 1.", True), ("table row. a: 1; b: 2", "table row. a: 2; b: 1", False), ("table row. a: 1", "a: 1", False),
        ("a: 1; b: 2", "b: 2; a: 1", False), ("table row. a: —", "table row. a: n/a", False), ("-$857", "$857", False), ("", "...", True), ("table row. a: 1; a: 1", "table row. a: 1", False),
    ],
)
def test_canonical(spark, a, b, same):
    x, y = key(spark, a, b)
    assert (x == y) == same


def rows(spark, data):
    return ledger.keyed_rows(spark.createDataFrame([(*r, "clash") for r in data], SCHEMA), "document_id", "content", "chunk_ord", "ingested_at")


def test_cases(spark, day):
    data = [
        (5, "A/1", "x y", day(1)), (3, "a-1", "X, y", day(400)), (9, "a1", "xy", None), (4, "A/2", "x y", day(1)), (1, None, "x y", day(1)), (6, "b", None, day(1)), (7, "B", None, day(2)), (8, "b", "", day(2)), (10, "b", "?!", day(2)),
        (11, "c", "long " * 50_000, day(1)), (12, "C", "LONG " * 50_000, day(1)),
    ]
    r = rows(spark, data)
    got = {(x.keep, x.copy) for x in ledger.membership(r, ledger.build(r).entries()).collect()}
    assert got == {(3, 5), (3, 9), (6, 7), (8, 10), (11, 12)}


def test_empty(spark):
    r = rows(spark, [])
    book = ledger.build(r)
    assert book.entries().count() == 0 and ledger.membership(r, book.entries()).count() == 0


def test_batches_add_up_and_hot_group(spark, day, monkeypatch):
    data = [(i, "d", "same text" if i % 3 == 0 else f"text {i}", day(i % 900)) for i in range(3000)]
    r = rows(spark, data)
    one, many = ledger.Ledger(spark), ledger.build(r)
    one.merge(r)
    assert sorted(map(tuple, one.entries().collect())) == sorted(map(tuple, many.entries().collect()))
    pairs = ledger.membership(r, many.entries())
    assert pairs.count() == 999 and pairs.where("keep <> 0").count() == 0
    monkeypatch.setattr(ledger, "max", lambda a, b: 10, raising=False)  # as if the group were hot
    assert sorted(map(tuple, ledger.membership(r, many.entries()).collect())) == sorted(map(tuple, pairs.collect()))
    one.close(), many.close()
    with pytest.raises(ValueError):
        one.entries()


@pytest.mark.parametrize("buckets", [3, 4, 7])
def test_ledger_lasts_and_is_not_shuffled(spark, day, tmp_path, buckets):
    path = str(tmp_path / "book")
    first, second = rows(spark, [(5, "a", "x", day(1)), (6, "a", "X", day(1)), (7, "b", "y", day(1))]), rows(spark, [(2, "A", "x!", day(400)), (9, "c", "z", day(400))])
    ledger.Ledger(spark, path, buckets=buckets).merge(first)
    book = ledger.Ledger(spark, path)  # opened again, as by a later session
    assert book.buckets == buckets and book.entries().count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = book.merged(second)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above_ledger = plan[plan.index("SortMergeJoin") : plan.index("FileScan")]
    assert "Exchange" not in above_ledger and "Bucketed: true" in plan and f"SelectedBucketsCount: {buckets} out of {buckets}" in plan
    book.merge(second)
    again = ledger.Ledger(spark, path)
    assert sorted((r[0], r[1]) for r in again.entries().select("n", "first").collect()) == [(1, 7), (1, 9), (3, 2)]
    assert len([f for f in os.listdir(path) if f.startswith("generation-")]) == 1
    os.rename(f"{path}/ledger.json", f"{path}/ledger.new")  # a merge that died at its last step
    assert ledger.Ledger(spark, path).entries().count() == 3
    assert not [t for t in spark.catalog.listTables("default") if t.name.startswith("ledger")]


@pytest.mark.parametrize("name", sorted(problems.P2_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(ROOT):
        con.execute(f"create view {t.split('.')[0]} as select * from '{ROOT}/{t}'")
    df = entry.queries()[name](spark, ROOT)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({problems.P2_SQL[name]})").fetchall())
