import random

import numpy as np
import pytest

from evidlake.llm import subjects

WORDS = {"tea": "kettle leaf cup brew pot", "rail": "train track signal depot engine", "wood": "oak plank saw mill pine", "sea": "tide wave reef gull surf", "art": "canvas easel paint frame sketch"}
FILL = "the board met again,we saw no change,figures follow in the note,costs were flat this year"
DOCS, LABELS, AREAS = "doc_id long, text string, subject string", "doc_id long, subject string, annotator string", "subject string, description string"


def corpus(seed, n):
    """Documents with the share of each subject's sentences, some labels wrong."""
    rng = random.Random(seed)
    docs, shares, labels = [], {}, []
    for d in range(n):
        main, other = rng.sample(list(WORDS), 2)
        k = rng.choice([0, 4, 6])
        kinds = [main] * k + [other] * (rng.choice([0, 0, 5]) if k else 0) + [""] * rng.randrange(3, 7)
        rng.shuffle(kinds)
        sents = [(" ".join(rng.choices(WORDS[s].split(), k=2)) + " " + rng.choice(["moved up", "went down", "stayed"]) if s else rng.choice(FILL.split(","))).capitalize() + f" {rng.randrange(9)}." for s in kinds]
        docs.append((d, "Notes 4\n" + " ".join(sents) + "\nrevenue | 5 | 6\n", None))
        shares[d] = {s: kinds.count(s) / len(kinds) for s in WORDS}
        named = [s for s in WORDS if shares[d][s] >= 0.25]
        if named:
            labels.append((d, rng.choice(named) if rng.random() > 0.05 else rng.choice(list(WORDS)), "a"))
    return docs, shares, labels


def test_held_out_accuracy(spark):
    docs, shares, labels = corpus(1, 900)
    known = [x for x in labels if x[0] < 600] + [(5, None, "a"), (None, "tea", "a"), (6, "unknown", "a"), (99_999, "tea", "a"), (7, " RAIL ", "b")]
    d = spark.createDataFrame(docs, DOCS)
    models = subjects.fit(d, spark.createDataFrame(known, LABELS), spark.createDataFrame([("tea", "kettle"), *((w, None) for w in WORDS if w != "tea"), (None, "x")], AREAS))
    found = {(r.doc_id, r.subject) for r in subjects.subjects_of(subjects.document_shares(d, models)).collect()}
    want = {(i, s) for i in range(600, 900) for s in WORDS if shares[i][s] >= 0.25}
    got = {x for x in found if x[0] >= 600}
    assert len(got & want) / len(want) > 0.95 and len(got - want) / len(got) < 0.05


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []), ("", []), ("Notes 12\nPage 4", []), ("One rose. Two fell 2.5%. And", ["One rose.", "Two fell 2.5%.", "And"]), ("revenue | 5 | 6\nOne rose.", ["One rose."]), ("revenue\t5\t6\nreturn ... 5 ... 6", []),
        ("The board of the group has met and\nagreed on it. Two.", ["The board of the group has met and agreed on it.", "Two."]), ("Überblick fiel. Äpfel stiegen.", ["Überblick fiel.", "Äpfel stiegen."]),
    ],
)
def test_sentences(text, want):
    assert subjects.sentences(text) == want


def test_empty_tables_and_texts(spark):
    none = spark.createDataFrame([], LABELS)
    areas = spark.createDataFrame([("tea", "kettle leaf cup"), ("rail", "train track")], AREAS)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Page 4", "x"), (4, "The kettle leaf cup rose. The board met.", "x"), (None, "The kettle.", "x")], DOCS)
    models = subjects.fit(docs, none, areas)
    assert {r.doc_id for r in subjects.document_shares(docs, models).collect()} <= {4}
    assert subjects.document_shares(docs.limit(0), models).count() == 0
    assert subjects.document_shares(docs, subjects.fit(docs, none, areas.limit(0))).count() == 0


def test_bounds_of_the_sample(spark):
    docs, _, labels = corpus(2, 60)
    d, l, a = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), spark.createDataFrame([("tea", ""), ("rail", "")], AREAS)
    assert len(subjects._training(d, l, a, 10, 10**9)[1]) == 10
    assert len(subjects._training(d, l, a, 100, 2000)[1]) < len(subjects._training(d, l, a, 100, 10**9)[1])


def test_fit_counts_every_sentence():
    k = 14
    names, seeds = [f"s{i}" for i in range(k)], [[f"seed{i}"] for i in range(k)]
    docs = [([["kettle", "leaf", "rose"], ["kettle", "fell"]], [0])] * 6 + [([["track", "signal"]], [1])] * 5 + [([["kettle", "rose"], ["costs", "fell"]], [])] * 40
    models = subjects.SubjectModels(names)
    models.fit(docs, seeds, 1)
    v = len(models.word)
    counts, total = np.zeros((v, k)), np.zeros(v)
    for sents, labels, seed in [(*d, None) for d in docs] + [([w], [], i) for i, w in enumerate(seeds)]:
        start = np.full(k + 1, 0.05 / (k + 1))
        start[labels] += 0.45 / max(1, len(labels))
        start[-1] += 0.5 if seed is None else 0
        if seed is not None:
            start[seed] = 1e3
        start /= start.sum()
        for w in (models.word[w] for sent in sents for w in sent):
            counts[w] += start[:k]
            total[w] += 1
    flat = [(models.word[w], i) for i, (sents, _) in enumerate(docs) for sent in sents for w in sent]
    tied = models._tied(np.array([w for w, _ in flat]), v, np.array([d for _, d in flat]), docs, k)
    for i, (w,) in enumerate(seeds):
        tied[models.word[w], i] = True
    ratio = np.where(tied, (counts + subjects.SHRINK) / (counts.sum(axis=0) * (total / total.sum())[:, None] + subjects.SHRINK), 1)
    assert tied[:, 0].sum() > 1
    assert models.table[-v:] == pytest.approx(models._gain(ratio), abs=1e-5)


def test_every_subject_counts(spark):
    areas = spark.range(10_020).selectExpr("concat('s', lpad(cast(id as string), 6, '0')) as subject", "'' as description")
    d, l = spark.createDataFrame([(1, "The kettle rose.", None)], DOCS), spark.createDataFrame([(1, "s010019", "a")], LABELS)
    names, docs, seeds = subjects._training(d, l, areas, 10, 10**9)
    assert len(names) == len(seeds) == 10_020 and [labels for _, labels in docs] == [[10_019]]
