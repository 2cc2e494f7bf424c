import itertools
import random

import pytest

from evidlake.llm import mixture

TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, text string, tokens string"


@pytest.mark.parametrize("seed", range(8))
def test_fit_is_near_any_budget(seed):
    rng = random.Random(seed)
    lengths = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(5)}
    every = {sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*(range(c + 1) for c in lengths.values()))}
    for budget in (0, 1, 17, 50, sum(n * c for n, c in lengths.items()) // 2, 10**6):
        taken = mixture.fit_lengths(lengths, budget)
        total = sum(n * k for n, k in taken.items())
        assert all(0 <= taken[n] <= lengths[n] for n in lengths) and total <= budget
        assert min(budget, max(every)) - total <= max(lengths)  # the proportional start binds some lengths
        if budget >= max(every):
            assert total == max(every)


@pytest.mark.parametrize("seed", range(8))
def test_fit_is_exact_within_its_room(seed):
    rng = random.Random(seed)
    lengths = {rng.randrange(5, 60): rng.randrange(1, 7) for _ in range(4)}
    every = {sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*(range(c + 1) for c in lengths.values()))}
    for budget in range(0, 8 * max(lengths), 7):
        taken = mixture.fit_lengths(lengths, budget)
        assert sum(n * k for n, k in taken.items()) == max(x for x in every if x <= budget) and all(0 <= taken[n] <= lengths[n] for n in lengths)
    assert sum(n * k for n, k in mixture.fit_lengths({42: 9, 13: 6}, 310).items()) == 307


def test_large_histogram_is_met_exactly():
    lengths = {n: 1000 for n in range(50, 900, 7)}
    assert sum(n * k for n, k in mixture.fit_lengths(lengths, 12_345_678).items()) == 12_345_678


def test_mixture(spark):
    rng = random.Random(2)
    text = lambda k: " ".join(rng.choices("net revenue rose again in the year".split(), k=k))
    docs = [(i, "Big-Source" if i % 2 else "big source", text(rng.randrange(1, 40)), "x") for i in range(400)] + [(1000 + i, "small", text(20), "x") for i in range(5)]
    docs += [(2000, None, "a", ""), (2001, "unwanted", "a", ""), (2002, "small", None, ""), (2003, "small", "", "")]
    targets = [("big_source", 0.5, 1), ("Small", 0.4, 3), ("absent", 0.1, 2)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    m, plan = mixture.mix(d, t)
    rows = m.collect()
    by = {r.source: r for r in mixture.shares(m, plan).collect()}
    assert by["small"].most_repeats == 3 and by["small"].used_documents == 5 and by["absent"].actual_share == 0
    assert abs(by["big_source"].actual_share - 5 / 9) < 0.01 and by["big_source"].most_repeats == 1
    assert by["big_source"].used_tokens == by["big_source"].budget
    assert len({r.doc_id for r in rows}) == len(rows) and not {r.doc_id for r in rows} & {2000, 2001, 2002, 2003}
    assert sorted(map(tuple, mixture.mix(d, t)[0].collect())) == sorted(map(tuple, rows))  # the same seed
    assert {r.doc_id for r in mixture.mix(d, t, seed=8)[0].collect()} != {r.doc_id for r in rows}
    given = {r.source: r for r in mixture.shares(*mixture.mix(d, t, total=10**6)).collect()}
    assert given["small"].used_tokens == 3 * given["small"].available_tokens and given["big_source"].most_repeats == 1


def test_one_length_many_documents(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "'s' as source", "'one two three' as text")
    m, plan = mixture.mix(d, spark.createDataFrame([("s", 1.0, 2)], TARGETS), total=1000 * 3 + 1)
    s = mixture.shares(m, plan).first()
    assert (s.used_documents, s.used_tokens) == (1000, 3000)
    twice = mixture.shares(*mixture.mix(d, spark.createDataFrame([("s", 1.0, 2)], TARGETS), total=4000 * 3)).first()
    assert (twice.used_documents, twice.used_tokens, twice.most_repeats) == (3000, 12000, 2)


def test_empty(spark):
    d = spark.createDataFrame([], DOCS)
    m, plan = mixture.mix(d, spark.createDataFrame([("s", 1.0, 2)], TARGETS))
    assert m.count() == 0 and mixture.shares(m, plan).count() == 1
    m, plan = mixture.mix(spark.createDataFrame([(1, "s", "a", "")], DOCS), spark.createDataFrame([], TARGETS))
    assert m.count() == 0 and plan.count() == 0
