import random

import pytest

from evidlake.llm import leakage, problems
from evidlake.sources.tables import table

ROOT = "/root/testdata/sf0.01"


def brute(docs, items, run=13):
    """Every run of every item looked up at every place."""
    where = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - run + 1):
            where.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t)] for k in range(len(w) - run + 1) for i in where.get(tuple(w[k : k + run]), ())}


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize(
    "text,want",
    [
        ("Net-Income: 5,3 É", ["net", "income", "5", "3", "é"]), ("opera-\nting", ["operating"]), ("opera­\nting x­y", ["operating", "xy"]), ("ﬁne ①", ["fine", "1"]), ("a​b⁠c", ["abc"]), ("STRASSE straße", ["strasse", "strasse"]),
        ("a_b", ["a", "b"]), ("", []), (None, []), ("- \n-", []), ("éa", ["éa"]), ("2009-\n10", ["200910"]), ("x -\ny", ["x", "y"]), ("adva-\r\nnced", ["advanced"]),
    ],
)
def test_words(text, want):
    assert leakage.words(text) == want


def test_against_brute_force_on_random_words(spark):
    rng = random.Random(1)
    vocabulary = "a b c d e".split()  # few words: long overlaps, many false starts
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 30)))) for i in range(20)]
    docs = [(d, " ".join(rng.choices(vocabulary + ["zz"], k=rng.randrange(0, 60)) + (leakage.words(rng.choice(items)[1])[rng.randrange(4) :] if d % 2 else []))) for d in range(80)]
    for run in (3, 5, 13):
        p = leakage.Patterns(items, run)
        assert {(d, i) for d, t in docs for i in p.find(leakage.words(t))} == brute(docs, items, run)
    d, i = frames(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, max_words=20).collect()} == brute(docs, items)  # in blocks


def test_cases(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    items = [(1, passage), (2, passage + " more"), (3, "too short"), (4, None), (5, ""), (None, passage)]
    docs = [(1, f"x {passage.upper()} y"), (2, " ".join(passage.split()[:12])), (3, " ".join(passage.split()[:13])), (4, None), (5, ""), (1, passage), (6, "long " * 300_000 + passage), (None, passage)]
    d, i = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): (r.runs, r.item_runs) for r in leakage.leaks(d, i).collect()}
    assert set(got) == {(a, b) for a in (1, 3, 6) for b in (1, 2)}
    assert got[1, 1] == (8, 8) and got[3, 1] == (1, 8) and got[6, 2] == (8, 9)
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_found_against_brute_force(spark):
    docs = [tuple(r) for r in table(spark, ROOT, "documents", "doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, ROOT, "eval_items", "item_id", "text").collect()]
    want = brute(docs, items)
    assert {tuple(r) for r in problems.p6_found(spark, ROOT).collect()} == want and len(want) > 20
