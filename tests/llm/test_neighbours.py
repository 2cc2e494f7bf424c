import numpy as np
import pytest
from pyspark.sql import functions as F

from evidlake.llm import neighbours as nb
from evidlake.llm import problems
from evidlake.sources.tables import table


def brute(ids, x, cosine, k):
    """Pairs of at least ``cosine`` of which one is among the other's k nearest; ties to the smaller id."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(ids)):
        near = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near if s[i, j] >= cosine}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], "x") for i, v in rows], "id long, v array<float>, code string")


def clustered(rng, n, d=32):
    centres = rng.normal(size=(n // 6, d))
    return np.concatenate([rng.normal(size=(n // 2, d)), centres[rng.integers(0, len(centres), n - n // 2)] + 0.25 * rng.normal(size=(n - n // 2, d))])


def test_plan_reaches_the_recall():
    for n in (2, 1000, 10**6, 10**8, 10**9):
        x = nb.plan(n, 96, 0.84)
        p = np.arccos(0.84) / np.pi
        hit = (1 - p) ** x.lead * nb._within(x.s - x.lead, p, x.probe)
        assert x.s * x.tables <= 96 * x.rotations and 1 - (1 - hit) ** x.tables >= 0.97 and nb._within(192, p, x.radius) >= 0.999
        assert n / 2**x.lead <= nb.BLOCK


def test_tables_retrieve_every_code_within_the_radius_once():
    rng = np.random.default_rng(2)
    code = np.packbits(rng.integers(0, 2, (300, 64)), axis=1)
    code[150:] = code[:150]
    code[150:, 0] ^= 3
    ids, shape = rng.permutation(300).astype(np.int64), nb.Plan(8, 8, 1, 0, 2, 15)
    found = [(a, b) for t in range(8) for x, y in nb.pairs_of_block(ids, code, nb._substring(code, t, 8), t, shape, crowd=1) for a, b in zip(x.tolist(), y.tolist())]
    bits = np.unpackbits(code, axis=1)
    dist = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(300) for j in range(i) if dist[i, j] <= 15}
    assert len(found) == len(set(found)) and set(found) == want  # 15 = tables * (probe + 1) - 1


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_recall_and_blocks(spark, block):
    rng = np.random.default_rng(1)
    x = clustered(rng, 600)
    got = {(r.a, r.b) for r in nb.similar_pairs(frame(spark, enumerate(x)), 32, 0.84, 5, block=block).collect()}
    want = brute(list(range(600)), x.astype(np.float32).astype(float), 0.84, 5)
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 16))
    rows = [(i, base[0] * (1 + i)) for i in range(300)]  # one direction holds most rows
    rows += [(1000, base[1]), (1001, base[1]), (1002, base[1] + 0.02 * rng.normal(size=16)), (1003, base[2])]
    rows += [(2000, None), (2001, []), (2002, [0] * 16), (2003, [1] * 15), (2004, [None] + [1] * 15), (2005, [float("nan")] + [1] * 15), (2006, [float("inf")] + [1] * 15), (None, base[1])]
    got = {(r.a, r.b) for r in nb.similar_pairs(frame(spark, rows), 16, 0.84, 5).collect()}
    hot = {p for p in got if p[1] < 1000}
    assert hot == {(a, b) for b in range(300) for a in range(min(b, 5))} | {(a, b) for a in range(5) for b in range(a + 1, 6)}
    assert got - hot == {(1000, 1001), (1000, 1002), (1001, 1002)}
    assert nb.similar_pairs(frame(spark, []), 16, 0.84, 5).count() == 0


def test_recall_on_the_data(spark):
    root = "/root/testdata/sf0.01"
    rows = table(spark, root, "chunk_vectors", "vec_id", "embedding").where(nb.valid(F.col("embedding"), 96)).collect()
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), 0.84, 5)
    got = {tuple(r) for r in problems.p5_found(spark, root).collect()}
    assert len(want & got) >= 0.97 * len(want) and got <= want


def test_nearest_of_a_query_set(spark):
    rng = np.random.default_rng(7)
    x = clustered(rng, 400).astype(np.float32)
    v = frame(spark, [*enumerate(x), (500, x[0]), (600, None)]).repartition(3)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    unit = np.concatenate([unit, unit[:1]])
    ids = [*range(400), 500]
    for block in (2048, 4):
        got = {}
        for r in nb.nearest(v, v.where("id % 40 = 0"), 32, 5, block=block).collect():
            got.setdefault(r.id, []).append((r["rank"], r.near))
        s = np.round(unit @ unit.T, 9)
        hits = total = 0
        for i, q in enumerate(ids):
            if q % 40 == 0:
                want = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]
                hits, total = hits + len({ids[j] for j in want} & {n for _, n in got[q]}), total + 5
                assert [r for r, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert hits >= 0.95 * total
    assert nb.nearest(v, v.limit(0), 32, 5).count() == 0 and nb.nearest(v.limit(0), v, 32, 5).count() == 0


def test_nearest_recall_on_the_data(spark):
    root = "/root/testdata/sf0.01"
    rows = table(spark, root, "chunk_vectors", "vec_id", "embedding").where(nb.valid(F.col("embedding"), 96)).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in problems.p5_nearest(spark, root).collect():
        got.setdefault(r.vec_id, set()).add(r.near_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        s[i] = -2
        hits, total = hits + len(set(ids[np.argsort(-s)[:5]].tolist()) & got[ids[i]]), total + 5
    assert hits >= 0.9 * total


def test_crowds_are_scanned_instead_of_paired(spark):
    rng = np.random.default_rng(9)
    crowd = rng.normal(size=32) + 0.1 * rng.normal(size=(300, 32))  # a third or more of all, none equal
    x = np.concatenate([crowd, rng.normal(size=(100, 32))]).astype(np.float32)
    v = frame(spark, enumerate(x))
    codes = nb.coded(v, 32).select("id", "code")
    pairs = nb.hashed_pairs(codes, 32, nb.plan(400, 32, 0.84), crowd=3)
    assert pairs.where("b is not null").count() < 300 * 299 / 2 / 4 and pairs.where("b is null").select("a").distinct().count() >= 250
    got = {(r.a, r.b) for r in nb.similar_pairs(v, 32, 0.84, 5, crowd=3).collect()}
    want = brute(list(range(400)), x.astype(float), 0.84, 5)
    assert got == want


def test_a_part_of_near_directions_is_split(spark):
    rng = np.random.default_rng(12)
    near = rng.normal(size=32) + 0.15 * rng.normal(size=(200, 32))  # a third of all, none equal
    x = np.concatenate([near, clustered(rng, 400)]).astype(np.float32)
    v = frame(spark, enumerate(x))
    codes, shape = nb.coded(v, 32).select("id", "code"), nb.plan(600, 32, 0.84, block=64)
    depths = nb.split_parts(codes, shape, 64)
    assert depths and all(shape.lead < d <= nb.DEEPEST for d in depths.values())
    code = np.stack([np.frombuffer(r.code, dtype=np.uint8) for r in codes.collect()])
    for t in range(shape.tables):
        part, depth = nb._parts_of(code, t, shape, depths)
        assert all(n <= 64 or p >= 1 << nb.DEEPEST for p, n in zip(*np.unique(part, return_counts=True))) and (part >> depth == 1).all()
    got = {(r.a, r.b) for r in nb.similar_pairs(v, 32, 0.84, 5, block=64).collect()}
    want = brute(list(range(600)), x.astype(float), 0.84, 5)
    assert len(want & got) >= 0.9 * len(want)


def test_a_cosine_too_low_for_tables_is_refused():
    with pytest.raises(ValueError):
        nb.plan(10**6, 96, -1.0)
