import random

from pyspark.sql import functions as F

from evidlake.operators import orphans

CHUNKS = "chunk_id string, ingested_at timestamp, deleted_at timestamp, key string"
REFS = "parent_table string, key string, at timestamp, ref_field string, ref_key long"


def run(spark, chunks, refs):
    parents = orphans.parent_rows(spark.createDataFrame(chunks, CHUNKS), "chunks", "chunk_id", "ingested_at", "deleted_at")
    return orphans.orphan_references(parents, spark.createDataFrame([("chunks", *r) for r in refs], REFS))


def test_lives_and_ties(spark, day):
    chunks = [
        ("a", day(1), None, "x"), ("a", day(5), None, "x"),  # ingested again
        ("b", day(1), day(3), None),
        ("c", day(4), day(4), None), ("d", day(4), day(2), None), ("e", None, None, None), (None, day(1), None, None),
    ]
    refs = [("a", day(1), "f", 1), ("a", day(0), "f", 2), ("b", day(2), "f", 3), ("b", day(3), "f", 4), ("b", day(3), "f", 4), ("c", day(5), "f", 5), ("d", day(5), "g", 6), ("e", day(5), "g", 7), ("none", day(1), "g", 8)]
    got = {(r.ref_key, r.ever) for r in run(spark, chunks, refs).collect()}
    assert got == {(2, False), (4, True), (5, False), (6, False), (7, False), (8, False)}


def test_empty_tables(spark, day):
    assert run(spark, [], []).count() == 0
    assert run(spark, [], [("a", day(1), "f", 1)]).count() == 1
    assert run(spark, [("a", day(1), None, None)], []).count() == 0


def test_against_brute_force_with_a_hot_key(spark, day):
    rng = random.Random(5)
    keys = ["hot"] * 5 + list("abcdefgh")
    chunks = [(rng.choice(keys), day(rng.randrange(40)), day(rng.randrange(60)) if rng.random() < 0.6 else None, "") for _ in range(120)]
    refs = [(rng.choice([*keys, "zz"]), day(rng.randrange(70)), rng.choice("fg"), i) for i in range(600)]
    want = {i for k, t, _, i in refs if not any(c == k and s <= t and (e is None or e > t) for c, s, e, _ in chunks)}
    out = run(spark, chunks, refs)
    assert {r.ref_key for r in out.collect()} == want
    counts = orphans.orphan_counts(out).collect()
    assert sum(r.orphans for r in counts) == len(want) and all(r.orphans == r.of_deleted + r.of_missing for r in counts)


def test_bare_ids(spark):
    forms = {" a ": "a", "[a]": "a", "CHUNK a": "a", "[CHUNK a]": "a", "CHUNK [a]": "a", "a\t": "a", "CHUNKa": "CHUNKa", "[a": "[a", "chunk a": "chunk a", " a\n": "a"}
    df = spark.createDataFrame(list(forms.items()), "raw string, want string")
    assert df.where(orphans.bare_id(F.col("raw")) != F.col("want")).collect() == []
