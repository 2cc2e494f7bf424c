"""Most similar vectors for every vector by multi-index hashing.

Vectors get binary codes: signs after learned rotations (iterative quantisation,
fitted on a bounded sample). The first bits of a code are cut into substrings, each
with a table of its own. Two codes whose substrings all differ in more than
``probe`` places are more than ``tables * (probe + 1) - 1`` apart; so probing every
substring within ``probe`` places retrieves every code within that Hamming radius,
and most beyond. What the tables retrieve is checked by the distance of the whole
codes and then reranked by cosine of the floats. Substring length, number of tables and
probing radius follow from the number of vectors and the wanted recall at the
least cosine: the cheapest plan that reaches it (``plan``).

Distribution: a part holds the codes of one table whose leading bits agree, ``BLOCK``
on average. The plan counts what that agreement costs in recall, and asks for as many
tables as make up for it: one rule at every size, with at most ``TABLES`` tables while any
plan of so few reaches the recall, since every table moves a copy of the codes
(32 bytes for 96 numbers). Parts are counted before they are built; one with more than
``BLOCK`` codes (a cluster of near directions) is split by the next bits of the code as
often as it takes. Floats move once for the reranking.

Crowds: where a vector and its partner both have ``CROWD`` pairs in a task, their pair is not
emitted; such vectors get their lists from a scan of all codes in blocks of queries
(``nearest``), which moves k rows each. So no bucket makes all its pairs, and no list
lacks a vector for it.

Copies: vectors of one direction (equal to four decimals) are one class; only its
smallest id takes part in the search, and a class adds at most six ids to any
list, so a class that holds a third of all rows neither makes pairs of all its
members nor one large task.

Cases: embeddings that are null, of another length, all zero or with null, NaN or
infinite numbers are left out; ids are expected to be unique (the same id twice
counts as one vector of its class); ties go to the smaller id; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

SAMPLE = 10_000
ROTATIONS = 2
BLOCK = 1 << 21
TABLES = 24
#: bits that can tell parts of a table apart
DEEPEST = 60
#: pairs a vector may have in one task before it counts as crowded
CROWD = 64
HOT_PART = 1000


def valid(vector: Column, dims: int) -> Column:
    """Not null, of ``dims`` finite numbers, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) == dims) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


# ---------------------------------------------------------------- codes


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 20) -> np.ndarray:
    """A rotation that brings unit vectors near the corners of the cube (iterative quantisation)."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
        r = u @ vt
    return r


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dims).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rotation(vectors: DataFrame, dims: int, rotations: int = ROTATIONS, sample: int = SAMPLE) -> np.ndarray:
    """Rotations side by side, fitted on the ``sample`` vectors of the smallest hashes."""
    picked = vectors.orderBy(F.xxhash64("id")).limit(sample).toArrow()["v"].combine_chunks()
    x = _matrix(picked, dims) if len(picked) else np.zeros((0, dims))
    return np.concatenate([learn_rotation(x, seed) for seed in range(rotations)], axis=1)


def coded(vectors: DataFrame, dims: int, rotations: int = ROTATIONS, sample: int = SAMPLE) -> DataFrame:
    """(id, same, code) of ``vectors`` (id, v), written once; ``same`` is the class of one direction."""
    shared = vectors.sparkSession.sparkContext.broadcast(_rotation(vectors, dims, rotations, sample))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            bits = np.packbits(x @ rotation > 0, axis=1)
            rough = np.rint(x * 1e4).astype(np.int16)
            same = [hashlib.blake2b(row.tobytes(), digest_size=12).digest() for row in rough]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "same", "code"])

    return materialize(vectors.mapInArrow(encode, "id long, same binary, code binary"), "codes")


# ---------------------------------------------------------------- the plan


def _within(n: int, p: float, r: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(r, n) + 1))


@dataclass(frozen=True)
class Plan:
    """Substring bits, tables, places probed, leading bits that must agree, rotations, radius of the checked codes."""

    s: int
    tables: int
    probe: int
    lead: int
    rotations: int
    radius: int


def plan(n: int, dims: int, cosine: float, recall: float = 0.97, block: int = BLOCK, most: int = TABLES) -> Plan:
    """The cheapest tables with the wanted recall at ``cosine``; not more than ``most`` where so few can reach it.

    Parts of about ``block`` vectors are told apart by leading bits that must agree. A cosine
    so low that no tables reach the recall is an error: it needs a scan (``nearest``).
    """
    p = math.acos(cosine) / math.pi
    lead, radius = max(0, math.ceil(math.log2(max(n, 1) / block))), _radius(dims * ROTATIONS, p)
    plans: list[tuple[float, Plan]] = []
    for s in range(lead + 6, min(lead + 31, DEEPEST)):
        for probe in range(6):
            hit = (1 - p) ** lead * _within(s - lead, p, probe)
            if hit < 1e-9:
                continue
            tables = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1
            probes = sum(math.comb(s - lead, i) for i in range(probe + 1))
            rotations = max(ROTATIONS, math.ceil(tables * s / dims))
            # in checks of a pair: a probe is cheaper; a table moves a copy of the codes; a rotation is a matrix product
            cost = tables * (100 + probes * (0.25 + n / 2**s)) + 40 * rotations
            if probes <= 20_000 and tables <= 400:
                plans.append((cost, Plan(s, tables, probe, lead, rotations, radius)))
    if not plans:
        raise ValueError(f"no tables reach a recall of {recall} at the cosine {cosine}")
    few = [x for x in plans if x[1].tables <= most]
    return min(few or plans, key=lambda x: x[0])[1]


def _radius(bits: int, p: float) -> int:
    """Distance that all but one in a thousand pairs at the cosine keep."""
    return next(r for r in range(bits + 1) if _within(bits, p, r) >= 0.999)


# ---------------------------------------------------------------- the tables


def _bits(code: np.ndarray, table: int, s: int, count: int) -> np.ndarray:
    """``count`` bits of packed codes from bit ``table * s`` on, around the end, as numbers."""
    bits = np.unpackbits(code, axis=1)
    at = (table * s + np.arange(count)) % bits.shape[1]
    return bits[:, at] @ (1 << np.arange(count - 1, -1, -1, dtype=np.int64))


def _substring(code: np.ndarray, table: int, s: int) -> np.ndarray:
    """The substring of a table: its first ``s`` bits."""
    return _bits(code, table, s, s)


def _masks(s: int, probe: int) -> list[int]:
    return [sum(1 << b for b in which) for i in range(probe + 1) for which in itertools.combinations(range(s), i)]


def pairs_of_block(ids: np.ndarray, code: np.ndarray, keys: np.ndarray, table: int, shape: Plan, crowd: int = CROWD, crowded: list[np.ndarray] | None = None, free: int | None = None, split: dict[int, list[int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) that the table retrieves among these rows, within the radius of the checked codes.

    ``keys`` are the ``free`` last bits of the rows' substrings; the others agree. Pairs that an earlier table
    retrieves are passed over as far as the checked codes tell, but not where its part of that table is ``split`` (table ->
    parts). A pair both ends of which have ``crowd`` pairs already is passed over; its ends are added to ``crowded``.
    """
    s, probe, radius, free = shape.s, shape.probe, shape.radius, shape.s - shape.lead if free is None else free
    degree, step = np.zeros(len(ids), dtype=np.int64), max(64, crowd * crowd * 256)  # pairs are looked at in steps
    order = np.argsort(keys, kind="stable")  # neighbours in memory ask for and find neighbours
    ids, code, index = ids[order], code[order], keys[order]
    pad = (-code.shape[1]) % 8
    words = np.ascontiguousarray(np.pad(code, ((0, 0), (0, pad)))).view(np.uint64)
    front = words[:, 0].copy()
    ends = np.concatenate([[0], np.cumsum(np.bincount(index, minlength=1 << free))]) if 1 << free <= 8 * len(ids) + (1 << 16) else None
    earlier, whole = range(min(table, code.shape[1] * 8 // s)), s - shape.lead
    first_limit = radius * 64 / (code.shape[1] * 8) + 4 * math.sqrt(radius * 64 / (code.shape[1] * 8))
    for mask in _masks(free, probe):
        asked = np.arange(len(ids)) if not mask else np.flatnonzero((index >> (mask.bit_length() - 1)) & 1 == 0)
        want = index[asked] ^ mask
        if ends is None:
            begin = np.searchsorted(index, want, "left")
            count = np.searchsorted(index, want, "right") - begin
        else:
            begin = ends[want]
            count = ends[want + 1] - begin
        some = count > 0
        asked, begin, count = asked[some], begin[some], count[some]
        cuts = np.flatnonzero(np.diff(np.cumsum(count) // step)) + 1
        for a, b, c in zip(np.split(asked, cuts), np.split(begin, cuts), np.split(count, cuts)):
            for k in range(0, int(c.max(initial=0)), step) if len(a) == 1 else (0,):  # one crowded bucket in pieces
                part = np.minimum(c - k, step) if len(a) == 1 else c
                q = np.repeat(a, part)
                i = np.arange(len(q)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(b + k, part)
                near = np.bitwise_count(front[q] ^ front[i]) <= first_limit
                q, i = q[near], i[near]
                near = np.bitwise_count(words[q] ^ words[i]).sum(axis=1) <= radius
                near &= ids[q] < ids[i] if not mask else ids[q] != ids[i]
                q, i = q[near], i[near]
                for e in earlier:
                    one = _substring(code[q], e, s)
                    differ = one ^ _substring(code[i], e, s)
                    new = (np.bitwise_count(differ) > probe) | (differ >> whole > 0)
                    if split and e in split:
                        new |= np.isin((one >> whole) | (1 << shape.lead), split[e])
                    q, i = q[new], i[new]
                full = (degree[q] >= crowd) & (degree[i] >= crowd)
                if full.any() and crowded is not None:
                    crowded.append(np.unique(np.concatenate([ids[q[full]], ids[i[full]]])))
                    q, i = q[~full], i[~full]
                np.add.at(degree, q, 1)
                np.add.at(degree, i, 1)
                if len(q):
                    yield np.minimum(ids[q], ids[i]), np.maximum(ids[q], ids[i])


def _parts_of(code: np.ndarray, table: int, shape: Plan, depths: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """(part, depth) of every code in a table: the leading bits under a mark that tells how many they are.

    ``depths`` names, by table and part, the parts that are split and the number of bits that tell their own parts apart.
    """
    key = _bits(code, table, shape.s, DEEPEST)
    depth = np.full(len(code), shape.lead, dtype=np.int64)
    part = (key >> (DEEPEST - shape.lead)) | (1 << shape.lead)
    while depths:
        different, which = np.unique(part, return_inverse=True)  # few, as codes are many
        deeper = np.array([depths.get((table, p), 0) for p in different.tolist()], dtype=np.int64)[which]
        if not deeper.any():
            break
        depth = np.where(deeper, deeper, depth)
        part = np.where(deeper, (key >> (DEEPEST - depth)) | (np.int64(1) << depth), part)
    return part, depth


def _codes_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)


def split_parts(codes: DataFrame, shape: Plan, block: int) -> dict[tuple[int, int], int]:
    """The parts with more than ``block`` codes, with the bits that tell their own parts apart; counted until none is left
    that more bits could split. A table has fewer such parts than it has blocks."""
    depths: dict[tuple[int, int], int] = {}
    while True:
        known = dict(depths)

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    code = _codes_of(batch)
                    for t in range(shape.tables):
                        part, n = np.unique(_parts_of(code, t, shape, known)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t), pa.int32()), pa.array(part, pa.int64()), pa.array(n, pa.int64())], names=["t", "part", "n"])

        found = codes.select("id", "code").mapInArrow(count, "t int, part long, n long").groupBy("t", "part").agg(F.sum("n").alias("n"))
        heavy = [r for r in found.where((F.col("n") > block) & (F.col("part") < 1 << DEEPEST)).collect()]
        if not heavy:
            return depths
        for r in heavy:
            depth = r["part"].bit_length() - 1
            depths[r["t"], r["part"]] = min(DEEPEST, depth + max(1, math.ceil(math.log2(r["n"] / block))))


def hashed_pairs(codes: DataFrame, dims: int, shape: Plan, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of ``codes`` (id, code) that multi-index hashing retrieves.

    Rows with null b name ids in a crowd, whose pairs among each other are not all here.
    """
    tables, checked = shape.tables, dims * ROTATIONS // 8
    depths = split_parts(codes, shape, block)
    split: dict[int, list[int]] = {}
    for t, part in depths:
        split.setdefault(t, []).append(part)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes_of(batch)
            short = pa.array([c.tobytes() for c in code[:, :checked]], pa.binary())
            for t in range(tables):
                part, depth = _parts_of(code, t, shape, depths)
                rest = _substring(code, t, shape.s) & ((1 << np.maximum(shape.s - depth, 0)) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t), pa.int32()), pa.array(part, pa.int64()), pa.array(rest, pa.int32()), batch.column(0), short], names=["t", "part", "rest", "id", "code"])

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        code = np.frombuffer(b"".join(group["code"].to_pylist()), dtype=np.uint8).reshape(group.num_rows, -1)
        crowded: list[np.ndarray] = []
        free = max(shape.s - (group["part"][0].as_py().bit_length() - 1), 0)
        found = list(pairs_of_block(group["id"].to_numpy(), code, group["rest"].to_numpy().astype(np.int64), group["t"][0].as_py(), shape, crowd, crowded, free, split))
        none = [np.zeros(0, dtype=np.int64)]
        a, b, many = np.concatenate([x for x, _ in found] or none), np.concatenate([y for _, y in found] or none), np.unique(np.concatenate(crowded or none))
        return pa.table({"a": pa.array(np.concatenate([a, many]), pa.int64()), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(many), pa.int64())])})

    rows = codes.select("id", "code").mapInArrow(spread, "t int, part long, rest int, id long, code binary")
    parts = min(4 * ((tables << shape.lead) + len(depths)), max(40 * int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * tables))  # few parts share a task, which takes them in turn
    return rows.repartition(parts, "t", "part").groupBy("t", "part").applyInArrow(search, "a long, b long").distinct()


# ---------------------------------------------------------------- reranking and lists


def cosine_of(a: Column, b: Column) -> Column:
    d = lambda x: x.cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: d(p) * d(q)), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_pairs(vectors: DataFrame, dims: int, cosine: float, k: int, recall: float = 0.97, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b: pairs of at least ``cosine`` of which one is among the other's ``k`` nearest.

    ``vectors`` has id and v. ``recall`` is the expected share of the pairs exactly at
    ``cosine`` that come out; nearer pairs are lost more rarely.
    """
    shape = plan(max(vectors.count(), 2), dims, cosine, recall, block)
    vectors = vectors.where(F.col("id").isNotNull() & valid(F.col("v"), dims))
    codes = coded(vectors, dims, shape.rotations)
    classes = materialize(codes.groupBy("same").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"), F.min("code").alias("code")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = materialize(hashed_pairs(classes.select(F.col("rep").alias("id"), "code"), dims, shape, crowd, block), "pairs")
    left, right = vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    scored = pairs.where(F.col("b").isNotNull()).join(left, "a").join(right, "b").select("a", "b", cosine_of(F.col("va"), F.col("vb")).alias("cosine")).where(F.col("cosine") >= cosine)
    # vectors in a crowd get their lists from the scan, in blocks; only their k nearest move
    chosen = vectors.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    crowded = vectors.join(pairs.where(F.col("b").isNull()).select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    lists = nearest(chosen, crowded, dims, k, cosine, fill=False).where(F.col("cosine") >= cosine)
    scored = scored.unionByName(lists.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"), "cosine"))
    scored = materialize(scored.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "scored")

    # members of classes of copies; of each class its k + 1 smallest ids
    several = classes.where(F.col("n") > 1).select("same", "rep", "n")
    limit = max(total // HOT_PART, 10_000)
    usual, hot = several.where(F.col("n") <= limit), F.broadcast(several.where(F.col("n") > limit))
    ids = codes.select("same", "id")
    members = ids.join(usual, "same").unionByName(ids.join(hot, "same")).select("rep", "n", "id").distinct()
    members = materialize(members, "members")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    first = members.withColumn("place", place).where(F.col("place") <= k + 1)

    # lists of the representatives: copies come first, then the members of other classes by cosine
    edges = scored.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cosine").unionByName(scored.select(F.col("b").alias("rep"), F.col("a").alias("other"), "cosine"))
    sizes = several.select("rep", "n")
    edges = edges.join(sizes, "rep", "left").withColumn("n", F.coalesce("n", F.lit(1))).where(F.col("n") <= k)
    edges = edges.join(first.select(F.col("rep").alias("other"), F.col("id").alias("target")), "other", "left").withColumn("target", F.coalesce("target", "other"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "target"))
    listed = edges.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("rank") <= k + 1 - F.col("n")))
    listed = listed.join(first.select("rep", "id"), "rep", "left").select(F.coalesce("id", "rep").alias("x"), F.col("target").alias("y"), "cosine")

    # lists within a class: its k smallest other ids
    near = first.select("rep", F.col("id").alias("y"), F.col("n").alias("size"))
    inside = members.where(F.col("n") <= limit).select("rep", F.col("id").alias("x")).join(near.where(F.col("size") <= limit), "rep")
    inside = inside.unionByName(members.where(F.col("n") > limit).select("rep", F.col("id").alias("x")).join(F.broadcast(near.where(F.col("size") > limit)), "rep"))
    own = F.row_number().over(Window.partitionBy("x").orderBy("y"))
    inside = inside.where(F.col("x") != F.col("y")).withColumn("own", own).where(F.col("own") <= k).select("x", "y", F.lit(1.0).alias("cosine"))

    out = listed.unionByName(inside)
    return out.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("cosine").alias("cosine"))


# ---------------------------------------------------------------- nearest of a stated query set


def nearest(vectors: DataFrame, queries: DataFrame, dims: int, k: int, floor: float = 0.4, block: int = 2048, fill: bool = True) -> DataFrame:
    """(id, rank, near, cosine): the ``k`` nearest other vectors for a stated set of queries (id, v), against all rows.

    Here neighbours may be far, where a Hamming ball holds so many codes that probing
    would touch every bucket; so the codes themselves are scanned: queries in blocks of
    bounded size meet every Arrow batch, codes beyond the radius that all but one in a
    thousand pairs at cosine ``floor`` keep are passed over, the rest reranked by floats.
    With ``fill``, a query with fewer than ``k`` codes within the radius in a batch is compared
    with all of the batch, so lists are always full. Of a task's rows only the best ``k`` of a query move on.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("id").isNotNull() & valid(F.col("v"), dims))
    queries = queries.where(F.col("id").isNotNull() & valid(F.col("v"), dims))
    blocks = -(-queries.count() // max(1, int(block * 0.8)))
    rotation = _rotation(vectors, dims) if blocks else np.zeros((dims, 0))
    radius = _radius(dims * ROTATIONS, math.acos(floor) / math.pi)

    def words_of(x: np.ndarray) -> np.ndarray:
        bits = np.packbits(x @ rotation > 0, axis=1)
        return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, (-bits.shape[1]) % 8)))).view(np.uint64)

    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        q = _matrix(rows["v"].chunk(0), dims)
        shared = spark.sparkContext.broadcast((rows["id"].to_numpy(), q, words_of(q), rotation))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, codes, rotation = shared.value
            best = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in names]  # of all batches so far
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = _matrix(batch.column(1), dims), batch.column(0).to_numpy()
                bits = np.packbits(x @ rotation > 0, axis=1)
                words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, (-bits.shape[1]) % 8)))).view(np.uint64)
                for i, name in enumerate(names):
                    near, known = best[i]
                    rows = np.flatnonzero(np.bitwise_count(words ^ codes[i]).sum(axis=1) <= radius)
                    rows = rows if len(rows) + len(near) > k or not fill else np.arange(len(ids))
                    s = np.round(x[rows] @ q[i], 9)
                    good = (ids[rows] != name) & (s >= known[-1] if len(near) == k else True)
                    if not good.any():
                        continue
                    near, known = np.concatenate([near, ids[rows][good]]), np.concatenate([known, s[good]])
                    near, first = np.unique(near, return_index=True)  # the same id twice counts once
                    known = known[first]
                    top = np.lexsort((near, -known))[:k]
                    best[i] = near[top], known[top]
            sizes = [len(near) for near, _ in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, sizes), pa.int64()), pa.array(np.concatenate([x for x, _ in best]), pa.int64()), pa.array(np.concatenate([c for _, c in best]), pa.float64())], names=["id", "near", "cosine"]
            )

        part = vectors.select("id", "v").mapInArrow(scan, "id long, near long, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.select("id", F.col("id").alias("near"), F.lit(0.0).alias("cosine")).where(F.lit(False))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near"))
    return out.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "near", "cosine")
