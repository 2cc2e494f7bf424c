"""Quantities recorded in different units, decoded by a hidden Markov model.

A series is what one device (in the data an example, whose answers all state one
quantity) recorded in time, of one smooth underlying level. The hidden state of each
number is its unit, a kind (none, percent, dollars, shares) with a factor to the
common unit. Emission: the evidence for a unit - words and signs in the text, labels,
the question - costs ``hard`` where a state contradicts it, and where evidence is silent
any state but the plain number costs ``prior``. Transition: the jump of the log value
in common units between neighbours, squared over ``2 sigma^2``, at most ``cap``
(also the cost of kinds that conflict), plus ``switch`` where the unit changes.
Viterbi finds the cheapest sequence of units: where evidence is silent, a jump by a
factor of a thousand against the level is explained by a switch of unit.

Evidence is finite. A run of m contradicted states costs m ``hard`` and spares at most
m + 1 transitions, so with ``hard > 2 (cap + switch)`` stated units hold, and the
level decides where nothing is stated. And with ``prior > 2 switch`` a silent number that
agrees with a neighbour as a plain number stays one: any other factor would cost ``cap``
on that side, no less than it could spare on the other.

Series are array columns; they are decoded in Arrow batches, all series of the
same length at once. Build long series with ``bounded_series``, which cuts a hot
device into ranges of bounded length, and decode them with ``decode_ranges``: a
range's costs from every state to every state form a min-plus matrix, a stream
over a device's matrices gives the costs at which each range begins, and a stream
backwards the state in which it ends. Costs are whole multiples of 2^-20, so their
sums are exact and a device decoded in ranges has the states of the whole.

Cases: a null number is skipped (its state is null, neighbours are compared
across it); zero has no logarithm and costs no jump; empty and null series give
empty and null results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import materialize

KINDS = ("none", "percent", "dollars", "shares")
SCALES = (1.0, 1e3, 1e6, 1e9, 1e12)
STATES: list[tuple[str, float]] = [("none", f) for f in SCALES] + [("percent", f) for f in (1.0, 1e-2, 1e-4)] + [("dollars", f) for f in SCALES] + [("shares", f) for f in SCALES]

_KIND_NO = np.array([KINDS.index(k) for k, _ in STATES])
_LOG_F = np.array([math.log(f) for _, f in STATES])
_STATE_OF = {(k, round(math.log10(f))): i for i, (k, f) in enumerate(STATES)}
_JOIN = (_KIND_NO[:, None] == _KIND_NO[None, :]) | (_KIND_NO[:, None] == 0) | (_KIND_NO[None, :] == 0)


_GRID = 2.0**20


def _on_grid(cost: np.ndarray | float) -> np.ndarray:
    """Costs as whole multiples of 2^-20: sums below 2^33 are exact, in whatever order."""
    return np.rint(np.asarray(cost) * _GRID) / _GRID


_STEPS, _STEP_NO = np.unique(np.round(_LOG_F[:, None] - _LOG_F[None, :], 9), return_inverse=True)
#: row of the costs of a transition [from, to]: by step of the factor, after these one for kinds that conflict and one for the same state
_ROW = np.where(_JOIN, _STEP_NO.reshape(_JOIN.shape).T, len(_STEPS))
np.fill_diagonal(_ROW, len(_STEPS) + 1)


def _forward(values: np.ndarray, evidence: np.ndarray, cost: np.ndarray, last: np.ndarray, *, hard: float, prior: float, sigma: float, cap: float, switch: float, level: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(costs at the end (n, states), back pointers (t, states, n)) of series that begin with ``cost`` after the log value ``last``."""
    n, t = values.shape
    s, u = len(STATES), len(_STEPS)
    hard, prior, cap, switch = (_on_grid(x) for x in (hard, prior, cap, switch))
    back = np.zeros((t, s, n), dtype=np.int16)
    names, cost = np.arange(s)[:, None], np.ascontiguousarray(cost.T)
    silent = np.where(names == _STATE_OF["none", 0], 0.0, prior)
    move, best, arg = np.empty((u + 2, n)), np.empty((s, n)), np.empty((s, n), dtype=np.int16)
    for i in range(t):
        v, e = values[:, i], evidence[:, i]
        there = ~np.isnan(v)
        emit = np.where(e[None, :] < 0, silent, np.where(names == e[None, :], 0.0, hard))
        with np.errstate(divide="ignore", invalid="ignore"):
            lv = np.log(np.abs(v))
            jump = (lv - last)[None, :] + _STEPS[:, None]
            move[:u] = _on_grid(np.minimum(jump * jump / (2 * sigma * sigma), cap))
        move[u], move[u + 1] = cap, move[np.searchsorted(_STEPS, 0.0)]
        move[:, ~np.isfinite(lv - last)] = 0.0  # zero has no logarithm
        move[: u + 1] += switch
        move[: u + 1, np.isnan(last)] = np.inf  # the first one comes from nowhere
        best.fill(np.inf), arg.fill(0)
        for f in range(s):
            way = move[_ROW[f]] + cost[f]
            less = way < best
            np.copyto(best, way, where=less)
            np.copyto(arg, f, where=less)
        new = best + emit
        if level:  # only differences matter, and small numbers stay exact
            new = new - new.min(axis=0)
        back[i] = np.where(there, arg, names)
        cost = np.where(there, new, cost)
        last = np.where(there & np.isfinite(lv), lv, last)
    return cost.T, back


def _backward(values: np.ndarray, back: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states, the state before the first value) of series that end in the states ``at``."""
    n, t = values.shape
    states = np.full((n, t), -1, dtype=np.int32)
    for i in range(t - 1, -1, -1):
        states[:, i] = np.where(np.isnan(values[:, i]), -1, at)
        at = back[i, at, np.arange(n)]
    return states, at


def viterbi(values: np.ndarray, evidence: np.ndarray, *, hard: float, prior: float, sigma: float, cap: float, switch: float) -> np.ndarray:
    """States (n, t) of n series of length t; ``evidence`` holds the named state or -1; NaN values are passed over."""
    n = len(values)
    cost, back = _forward(values, evidence, np.zeros((n, len(STATES))), np.full(n, np.nan), hard=hard, prior=prior, sigma=sigma, cap=cap, switch=switch)
    return _backward(values, back, cost.argmin(axis=1))[0]


#: numbers decoded at once
_AT_ONCE = 1 << 15


def _states_of(values: pa.Array, evidence: pa.Array, par: dict[str, float]) -> pa.Array:
    """The states of list arrays of numbers and named states; series of about one length are padded and decoded together."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if not np.array_equal(sizes, evidence.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
        raise ValueError("numbers and evidence differ in length")
    flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    said = evidence.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    states = np.full(len(flat), -1, dtype=np.int32)
    step = 1 << np.maximum(np.floor(np.log2(np.maximum(sizes, 1))).astype(int) - 2, 0)  # widths rise by a quarter at most
    width = -(-sizes // step) * step
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) * w // _AT_ONCE)):
            place = (ends - sizes)[part, None] + np.arange(w)[None, :]
            there = np.arange(w)[None, :] < sizes[part, None]
            at = np.where(there, place, 0)
            found = viterbi(np.where(there, flat[at], np.nan), np.where(there, said[at], -1), **par)
            states[at[there]] = found[there]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    items = pa.array(states, pa.int32(), mask=states < 0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=values.is_null())


def decode(values: Column, evidence: Column, *, hard: float = 1e6, prior: float = 1e6, sigma: float = 0.25, cap: float = 40.0, switch: float = 1.0) -> Column:
    """array<int> of state numbers for the series in two array columns (numbers; named states or null)."""
    par = dict(hard=hard, prior=prior, sigma=sigma, cap=cap, switch=switch)

    @F.arrow_udf("array<int>")
    def run(v: pa.Array, e: pa.Array) -> pa.Array:
        return _states_of(v, e, par)

    return run.asNondeterministic()(values.cast("array<double>"), evidence.cast("array<int>"))  # so that it is evaluated once, not in every use


def _series(v: np.ndarray | list, e: np.ndarray | list) -> tuple[np.ndarray, np.ndarray]:
    return np.array(v, dtype=float).reshape(1, -1), np.array([-1 if z is None or z != z else int(z) for z in e], dtype=int).reshape(1, -1)


def _log_size(last: float | None) -> np.ndarray:
    return np.full(1, np.nan if last is None or last != last else np.log(np.abs(last)))


def decode_ranges(series: DataFrame, device: str, values: str, evidence: str, *, hard: float = 1e6, prior: float = 1e6, sigma: float = 0.25, cap: float = 40.0, switch: float = 1.0) -> DataFrame:
    """``series`` (device, part, hot, head, and two array columns) with ``states``, the states of each device decoded as one series.

    A part of a hot device is a range of it, in the order of ``part``. Ahead of the states of
    every range but a device's first stands ``before``, the state in which the range before ends.
    """
    par = dict(hard=hard, prior=prior, sigma=sigma, cap=cap, switch=switch)
    k = len(STATES)
    cold = series.where(~F.col("hot")).withColumn("before", F.lit(None).cast("int")).withColumn("states", decode(F.col(values), F.col(evidence), **par))
    hot = materialize(series.where("hot"), "ranges")
    if hot.isEmpty():
        return cold
    key = [device, "part"]
    sized = F.filter(F.col(values), lambda x: (F.abs(x) > 0) & (F.abs(x) < float("inf")))
    so_far = Window.partitionBy(device).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = hot.select(*key, F.try_element_at(sized, F.lit(-1)).alias("_own")).select(*key, F.last("_own", ignorenulls=True).over(so_far).alias("_last"))
    hot = hot.join(lasts, key)

    @F.pandas_udf("array<double>")
    def matrix(v: pd.Series, e: pd.Series, last: pd.Series) -> pd.Series:
        start = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
        out = []
        for x, y, z in zip(v, e, last):
            a, b = _series(x, y)
            out.append(_forward(a.repeat(k, 0), b.repeat(k, 0), start, _log_size(z).repeat(k), **par, level=False)[0].ravel())
        return pd.Series(out)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cost = None, np.zeros(k)
        for batch in batches:
            begin, end = [], []
            for d, m in zip(batch[device], batch["_matrix"]):
                if d != at:
                    at, cost = d, np.zeros(k)
                begin.append(cost)
                cost = (cost[:, None] + np.array(m).reshape(k, k)).min(axis=0)
                cost = cost - cost.min()
                end.append(int(cost.argmin()))
            yield batch[key].assign(_begin=begin, _best=end)

    def ordered(df: DataFrame, *order: Column) -> DataFrame:
        return df.repartition(device).sortWithinPartitions(device, *order)

    kind = series.schema[device].dataType.simpleString()
    name, part = f"`{device}` {kind}", f"`part` {series.schema['part'].dataType.simpleString()}"
    matrices = hot.select(*key, matrix.asNondeterministic()(values, evidence, "_last").alias("_matrix"))
    begun = ordered(matrices, F.col("part")).mapInPandas(forward, f"{name}, {part}, _begin array<double>, _best int")
    hot = materialize(hot.join(begun, key), "begun")

    @F.pandas_udf("array<int>")
    def entries(v: pd.Series, e: pd.Series, last: pd.Series, begin: pd.Series) -> pd.Series:
        out = []
        for x, y, z, c in zip(v, e, last, begin):
            a, b = _series(x, y)
            back = _forward(a, b, np.array(c).reshape(1, k), _log_size(z), **par)[1]
            out.append(_backward(a.repeat(k, 0), back.repeat(k, 2), np.arange(k))[1].tolist())
        return pd.Series(out)

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, 0
        for batch in batches:
            ends, befores = [], []
            for d, best, entry in zip(batch[device], batch["_best"], batch["_entry"]):
                if d != at:
                    at, state = d, int(best)
                ends.append(state)
                state = int(entry[state])
                befores.append(state)
            yield batch[key].assign(_end=ends, before=befores)

    entry = hot.select(*key, "_best", entries.asNondeterministic()(values, evidence, "_last", "_begin").alias("_entry"))
    ended = ordered(entry, F.col("part").desc()).mapInPandas(backward, f"{name}, {part}, _end int, before int")

    @F.pandas_udf("array<int>")
    def states(v: pd.Series, e: pd.Series, last: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for x, y, z, c, s in zip(v, e, last, begin, end):
            a, b = _series(x, y)
            back = _forward(a, b, np.array(c).reshape(1, k), _log_size(z), **par)[1]
            out.append([None if i < 0 else int(i) for i in _backward(a, back, np.array([s]))[0][0]])
        return pd.Series(out)

    done = hot.join(ended, key).withColumn("before", F.when(~F.col("head"), F.col("before")))
    done = done.withColumn("states", states.asNondeterministic()(values, evidence, "_last", "_begin", "_end"))
    return cold.unionByName(done.select(*cold.columns))


def state_no(kind: Column, factor: Column) -> Column:
    """The number of a state; null where kind and factor name none."""

    def of(power: Column) -> Column:
        out = F.lit(None).cast("int")
        for k in KINDS:
            first, step = _STATE_OF[k, 0], -2 if k == "percent" else 3
            places = [p for n, p in _STATE_OF if n == k]
            out = F.when(kind == k, F.when(power.isin(places), (first + power / step).cast("int"))).otherwise(out)
        return out

    return T.let(F.round(F.log10(factor)).cast("int"), of)


def state_kind(state: Column) -> Column:
    return F.get(F.array(*(F.lit(k) for k, _ in STATES)), state)


def state_factor(state: Column) -> Column:
    return F.get(F.array(*(F.lit(f) for _, f in STATES)), state)


# ---------------------------------------------------------------- evidence in texts

# Scale words, unit words and their regular forms.
SCALE_WORDS = (("thousands?|k", 1e3), ("millions?|mn|mm|m", 1e6), ("billions?|bn|b", 1e9), ("trillions?|tn", 1e12))
UNIT_WORDS = (
    (r"percentage[\s_-]*points?|pps?|ppts?", "percent", 1e-2),
    (r"basis[\s_-]*points?|bps?", "percent", 1e-4),
    (r"%|per[\s-]*cent(?:age)?|pct", "percent", 1e-2),
    (r"us\s*dollars?|dollars?|usd|us\$|\$", "dollars", None),
    (r"shares?", "shares", None),
)
_SCALE = "|".join(w for w, _ in SCALE_WORDS)
_UNIT = "|".join(w for w, _, _ in UNIT_WORDS)
AMOUNT = r"(\(?)\s*(-?)\s*(us\s*\$|usd|\$)?\s*(-?)\s*(\(?)\s*(\d[\d,]*(?:\.\d+)?|\.\d+)(.*)$"
AFTER = rf"^[\s-]*({_SCALE})?[\s.-]*(?:of\s+)?({_UNIT})?"
QUESTION = rf"\bin\s+({_SCALE})?\s*(?:of\s+)?({_UNIT})?\s*\)?\s*\?+\s*$"

# The same with a group for every scale and unit word and for a closing bracket further on, for one pass over a text.
_MARK = "\x01"
_EACH_SCALE, _EACH_UNIT = "|".join(f"({w})" for w, _ in SCALE_WORDS), "|".join(f"({w})" for w, _, _ in UNIT_WORDS)
_AMOUNT_PARTS = (
    r"^[\s\S]*?(\(?)\s*(-?)\s*(us\s*\$|usd|\$)?\s*(-?)\s*(\(?)\s*(\d[\d,]*(?:\.\d+)?|\.\d+)(?=[^)]*(\)?))"
    rf"(?:[\s-]*(?:{_EACH_SCALE})?[\s.-]*(?:of\s+)?(?:{_EACH_UNIT})?(?![a-z]))?[\s\S]*$"
)
_QUESTION_PARTS = rf"^[\s\S]*?\bin\s+(?:{_EACH_SCALE})?\s*(?:of\s+)?(?:{_EACH_UNIT})?\s*\)?\s*\?+\s*$"


def _parts(text: Column, pattern: str) -> Column:
    """The groups of a pattern that covers a text; an array of one element where it does not."""
    groups = re.compile(pattern).groups
    return F.split(F.regexp_replace(text, pattern, _MARK.join(f"${i + 1}" for i in range(groups))), _MARK)


def plain(text: Column) -> Column:
    """Lower case, one kind of minus, ordinary spaces."""
    return F.lower(F.translate(text, "−–‒ \n\r\x01", "---    "))


def _first_of(parts: Column, at: int, values: list) -> Column:
    """The value that belongs to the first group with a text, counted from the group ``at``; null without one."""
    out = F.lit(None)
    for i in reversed(range(len(values))):
        out = F.when(parts[at + i] != "", F.lit(values[i])).otherwise(out)
    return out


def _unit_of(parts: Column, at: int) -> Column:
    """struct(kind, factor) of the scale and unit words in groups from ``at`` on; a percentage has no scale."""
    unit = at + len(SCALE_WORDS)
    kind = _first_of(parts, unit, [k for _, k, _ in UNIT_WORDS]).cast("string")
    scale = _first_of(parts, at, [f for _, f in SCALE_WORDS])
    return F.struct(kind.alias("kind"), F.when(kind == "percent", _first_of(parts, unit, [f for _, _, f in UNIT_WORDS])).otherwise(scale).cast("double").alias("factor"))


def text_amount(text: Column) -> Column:
    """struct(number, kind, factor): the first number, its sign, and what the text says of its unit. One pass over the text."""

    def of(g: Column) -> Column:
        minus = (g[1] != "") | (g[3] != "") | (((g[0] != "") | (g[4] != "")) & (g[6] != ""))
        size = F.replace(g[5], F.lit(","), F.lit("")).try_cast("double")
        unit = _unit_of(g, 7)
        kind = F.coalesce(unit["kind"], F.when(g[2] != "", F.lit("dollars")))
        return F.when(F.size(g) > 1, F.struct(F.when(minus, -size).otherwise(size).alias("number"), kind.alias("kind"), unit["factor"].alias("factor")))

    return T.let(_parts(plain(text), _AMOUNT_PARTS), of)


def label_unit(label: Column) -> Column:
    """struct(kind, factor, share) of a unit label; ``share``: percent, where small numbers are fractions."""

    def of(t: Column) -> Column:
        kind = (
            F.when(t.rlike(r"percentage points?|basis points?|\bpps?\b|\bbps?\b|percent|%|\bpct\b"), "percent")
            .when(t.rlike(r"\$|usd|dollar"), "dollars")
            .when(t.rlike(r"\bshares?\b"), "shares")
        )
        points = F.when(t.rlike(r"basis points?|\bbps?\b"), 1e-4).when(t.rlike(r"percentage points?|\bpps?\b"), 1e-2)
        scale = F.when(t.contains("thousand"), 1e3).when(t.contains("million"), 1e6).when(t.contains("billion"), 1e9).when(t.contains("trillion"), 1e12)
        return T.let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "percent", points).otherwise(scale).alias("factor"), ((k == "percent") & points.isNull()).alias("share")))

    return T.let(F.regexp_replace(F.trim(plain(label)), r"[\s_-]+", " "), of)


def question_unit(question: Column) -> Column:
    """struct(kind, factor) of the unit named at the end of a question."""
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("factor"))
    return T.let(_parts(F.coalesce(plain(question), F.lit("")), _QUESTION_PARTS), lambda g: F.when(F.size(g) > 1, _unit_of(g, 0)).otherwise(none))


def evidence(amount: Column, question: Column, label: Column | None = None, scale: Column | None = None) -> Column:
    """Number of the state that the evidence names; null where it is silent.

    Words in the text hold; the label supplies what they leave open (a label of
    percent only for a bare number: of one if at most 1 in size and the scale is
    not raw); a number without either takes the unit of the question.
    """
    bare = amount["kind"].isNull() & amount["factor"].isNull()
    kind, factor, said = amount["kind"], amount["factor"], ~bare
    if label is not None:
        percent = bare & (label["kind"] == "percent")
        raw = F.coalesce(F.lower(F.trim(scale)) == "raw", F.lit(False))
        share = F.when((F.abs(amount["number"]) <= 1) & ~raw, 1.0).otherwise(1e-2)
        open_kind = F.when(amount["kind"].isNull() & (label["kind"] != "percent"), label["kind"])
        kind = F.when(percent, F.lit("percent")).otherwise(F.coalesce(amount["kind"], open_kind))
        open_factor = F.when(F.coalesce(amount["kind"] != "percent", F.lit(True)) & F.coalesce(label["kind"] != "percent", F.lit(True)), label["factor"])
        factor = F.when(percent, F.coalesce(label["factor"], share)).otherwise(F.coalesce(amount["factor"], open_factor))
        said = said | label["kind"].isNotNull() | label["factor"].isNotNull()
    kind = F.when(said, kind).otherwise(question["kind"])
    factor = F.when(said, factor).otherwise(question["factor"])
    return F.when(kind.isNotNull() | factor.isNotNull(), state_no(F.coalesce(kind, F.lit("none")), F.coalesce(factor, F.lit(1.0))))


def bounded_series(df: DataFrame, device: str, order: list[str], columns: list[str], per_series: int = 256) -> DataFrame:
    """(device, part, hot, head, items): the rows of a device in order, hot devices in ranges of at most ``per_series`` rows.

    The ranges of a device follow each other in the order of ``part``, from its ``head`` on. The counts are
    pre-aggregated; only devices that need more than one part are joined back. Their rows
    are sorted over the cluster and numbered, so that no array or task grows with a device.
    """
    rest = [c for c in columns if c not in order]
    df = materialize(df.select(device, *order, *rest), "rows")  # counted, then read twice
    counts = df.groupBy(device).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_series).select(device, F.lit(True).alias("hot"))
    df = df.join(counts, device, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    items = F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("items")
    cold = df.where(~F.col("hot")).groupBy(device, F.lit(0).cast("long").alias("part"), "hot").agg(items).withColumn("head", F.lit(True))
    hot = df.where("hot").orderBy(device, *order, *rest).withColumn("part", F.floor(F.monotonically_increasing_id() / per_series))
    hot = materialize(hot, "hot")
    heads = hot.groupBy(device).agg(F.min("part").alias("part")).withColumn("head", F.lit(True))
    hot = hot.groupBy(device, "part", "hot").agg(items).join(heads, [device, "part"], "left")
    return cold.unionByName(hot.withColumn("head", F.coalesce("head", F.lit(False))))
