"""Queries of the general data problems (p1, p3, p4) on the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nesting, orphans, units
from ..sources.tables import table

# ---------------------------------------------------------------- p1: orphan references


def _chunk_lives(spark: SparkSession, root: str) -> DataFrame:
    return orphans.parent_rows(table(spark, root, "chunks", "chunk_id", "ingested_at", "deleted_at"), "chunks", "chunk_id", "ingested_at", "deleted_at")


def _chunk_references(spark: SparkSession, root: str) -> DataFrame:
    pred = table(spark, root, "predictions", "prediction_id", "run_at", "retrieved_chunk_ids", "cited_chunk_ids")
    lists = F.explode(
        F.array(
            F.struct(F.lit("predictions.cited_chunk_ids").alias("field"), F.col("cited_chunk_ids").alias("ids")),
            F.struct(F.lit("predictions.retrieved_chunk_ids").alias("field"), F.col("retrieved_chunk_ids").alias("ids")),
        )
    )
    pred = pred.select("prediction_id", "run_at", lists.alias("l")).select("prediction_id", "run_at", "l.field", F.explode("l.ids").alias("id"))
    vec = table(spark, root, "chunk_vectors", "vec_id", "chunk_id", "embedded_at").select(
        F.col("vec_id").alias("prediction_id"), F.col("embedded_at").alias("run_at"), F.lit("chunk_vectors.chunk_id").alias("field"), F.col("chunk_id").alias("id")
    )
    refs = pred.unionByName(vec).where(F.col("id").rlike(r"(?U)\S"))
    return refs.where(F.col("run_at").isNotNull()).select(
        F.lit("chunks").alias("parent_table"), orphans.bare_id(F.col("id")).alias("key"), F.col("run_at").alias("at"), F.col("field").alias("ref_field"), F.col("prediction_id").alias("ref_key")
    )


def p1_orphans(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_references(_chunk_lives(spark, root), _chunk_references(spark, root))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_orphans(spark, root).select("ref_field", "ref_key", F.col("key").alias("chunk_id")).distinct()


def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_counts(p1_orphans(spark, root))


_P1_SQL_REFS = r"""
refs as (
  select 'predictions.cited_chunk_ids' as ref_field, prediction_id as ref_key, run_at as seen, unnest(cited_chunk_ids) as id from predictions
  union all
  select 'predictions.retrieved_chunk_ids', prediction_id, run_at, unnest(retrieved_chunk_ids) from predictions
  union all
  select 'chunk_vectors.chunk_id', vec_id, embedded_at, chunk_id from chunk_vectors),
bare as (
  select distinct ref_field, ref_key, seen,
    regexp_replace(regexp_replace(regexp_replace(id, '^\s*(?:\[\s*(.*?)\s*\])\s*$', '\1'), '^\s+|\s+$', '', 'g'), '^CHUNK\s+', '') as chunk_id
  from refs where id is not null and regexp_matches(id, '\S') and seen is not null),
orphan as (
  select b.*, exists (select 1 from chunks c where c.chunk_id = b.chunk_id and c.ingested_at <= b.seen and (c.deleted_at is null or c.deleted_at > c.ingested_at)) as ever
  from bare b
  where not exists (select 1 from chunks c where c.chunk_id = b.chunk_id and c.ingested_at <= b.seen and (c.deleted_at is null or c.deleted_at > b.seen)))
"""

P1_SQL = {
    "p1_found": f"with {_P1_SQL_REFS} select distinct ref_field, ref_key, chunk_id from orphan",
    "p1_counts": f"""with {_P1_SQL_REFS} select 'chunks' as parent_table, ref_field, strftime(seen, '%Y-%m') as period, count(*) as orphans,
  count(*) filter (where ever) as of_deleted, count(*) filter (where not ever) as of_missing from orphan group by all""",
}

# ---------------------------------------------------------------- p3: nested records

_ROOTS = ([], ["record"], ["*"], ["*", "record"])


def _under(*paths: list[str]) -> list[list[str]]:
    return [[*r, *p] for r in _ROOTS for p in paths]


REPORT_SPEC: nesting.Spec = {
    "record": _under([]),
    "qa": _under(["qa"], ["qa", "*"]),
    "row": _under(["table", "*"]),
    "cell": _under(["table", "*", "*"], ["table", "*", "cells", "*"]),
    "gold": _under(["qa", "gold_inds", "@"], ["qa", "gold_inds", "*"], ["qa", "*", "gold_inds", "@"], ["qa", "*", "gold_inds", "*"]),
    "ann_table_row": _under(*([*q, "ann_table_rows", *e] for q in (["qa"], ["qa", "*"]) for e in ([], ["*"]))),
    "ann_text_row": _under(*([*q, "ann_text_rows", *e] for q in (["qa"], ["qa", "*"]) for e in ([], ["*"]))),
}


_PARENTS: nesting.Carry = {"record": ("pre",), "qa": ("pre", "pos", "name"), "row": ("pre", "pos", "attrs")}


def _report_nodes(spark: SparkSession, root: str) -> DataFrame:
    nodes = nesting.interval_nodes(table(spark, root, "raw_records", "raw_id", "payload"), "raw_id", "payload", REPORT_SPEC, _PARENTS)
    # arrays stand at the paths of their elements' single form too: a question or annotation is an object or scalar
    is_object, is_value = F.col("attrs").isNotNull(), F.col("value").isNotNull()
    return nodes.where(
        ((F.col("node_type") == "record") & is_object)
        | ((F.col("node_type") == "qa") & is_object)
        | (F.col("node_type") == "row")
        | ((F.col("node_type") == "cell") & (is_value | is_object))
        | ((F.col("node_type") == "gold") & (F.col("name").isNotNull() | is_object | is_value))
        | (F.col("node_type").isin("ann_table_row", "ann_text_row") & is_value)
    )


def _question_no(name: str = "qa_name", pos: str = "qa_pos") -> Column:
    """A question held alone under its field has the number 0."""
    return F.when(F.col(name).isNull(), F.col(pos)).otherwise(F.lit(0))


def _gold_key() -> Column:
    return F.coalesce(F.col("name"), F.col("attrs")["ind"], F.col("value"))


def _ann_key() -> Column:
    return F.regexp_replace(F.col("value"), r"(?U)^\s+|\s+$", "")


def p3_records(spark: SparkSession, root: str) -> DataFrame:
    """Every record; an object that only wraps one under ``record``, without parts of its own, is none."""
    n = _report_nodes(spark, root).where((F.col("node_type") == "record") & ((F.col("inner") == 0) | (F.col("children") > 0)))
    return n.select(F.col("doc_id").alias("raw_id"), F.col("pre").alias("record_pre"), F.col("post").alias("record_post"), F.col("attrs")["id"].alias("example_id"), F.col("attrs")["filename"].alias("document_id"))


def p3_questions(spark: SparkSession, root: str) -> DataFrame:
    n, a = _report_nodes(spark, root).where("node_type = 'qa'"), F.col("attrs")
    return n.select(
        F.col("doc_id").alias("raw_id"), "record_pre", F.col("pre").alias("question_pre"), F.col("post").alias("question_post"), _question_no("name", "pos").alias("question_no"),
        a["question"].alias("question"), a["answer"].alias("answer"), a["program"].alias("program"), a["exe_ans"].alias("numeric_answer"), a["explanation"].alias("explanation"),
    )


def p3_cells(spark: SparkSession, root: str) -> DataFrame:
    n = _report_nodes(spark, root).where("node_type = 'cell'")
    return n.select(F.col("doc_id").alias("raw_id"), "record_pre", "row_pre", F.col("row_pos").alias("row_no"), F.col("row_attrs")["label"].alias("row_label"), F.col("pos").alias("cell_no"), "value")


def p3_evidence(spark: SparkSession, root: str) -> DataFrame:
    n = _report_nodes(spark, root).where("node_type = 'gold'")
    return n.select(
        F.col("doc_id").alias("raw_id"), F.col("qa_pre").alias("question_pre"), _question_no().alias("question_no"), _gold_key().alias("evidence_key"),
        F.coalesce(F.col("attrs")["text"], F.when(F.col("name").isNotNull(), F.col("value"))).alias("text"), F.col("attrs")["weight"].try_cast("double").alias("weight"),
    )


def p3_annotations(spark: SparkSession, root: str) -> DataFrame:
    n = _report_nodes(spark, root).where(F.col("node_type").isin("ann_table_row", "ann_text_row"))
    return n.select(F.col("doc_id").alias("raw_id"), F.col("qa_pre").alias("question_pre"), _question_no().alias("question_no"), F.col("node_type").alias("kind"), _ann_key().alias("row_no"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """All children in one table; the node table is computed once."""
    t = F.col("node_type")
    parent = F.when(t == "qa", F.lit(0)).when(t == "cell", F.col("row_pos")).otherwise(_question_no())
    key = F.when(t == "qa", _question_no("name", "pos").cast("string")).when(t == "cell", F.col("pos").cast("string")).when(t == "gold", _gold_key()).otherwise(_ann_key())
    n = _report_nodes(spark, root).where(t.isin("qa", "cell", "gold", "ann_table_row", "ann_text_row"))
    return n.select(F.col("doc_id").alias("raw_id"), t.alias("child"), parent.cast("int").alias("parent_no"), key.alias("child_key")).where(F.col("child_key").isNotNull()).distinct()


# ---------------------------------------------------------------- p4: units

#: tolerance of a match, relative to the gold value; the last digits belong to binary rounding
_TOLERANCE = 1e-3 * (1 + 1e-9)


def _amounts(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "predictions", "prediction_id", "example_id", "run_at", "question", "gold_answer", "predicted_answer", "answer_unit", "answer_scale")
    return p.select(
        "prediction_id", "example_id", "run_at", "answer_scale",
        units.text_amount(F.col("gold_answer")).alias("gold"), units.text_amount(F.col("predicted_answer")).alias("pred"),
        units.label_unit(F.col("answer_unit")).alias("label"), units.question_unit(F.col("question")).alias("asked"),
    )


#: costs of the model; ``hard > 2 (cap + switch)`` and ``prior > 2 switch`` (see units)
_COSTS = dict(hard=24.0, prior=3.0, sigma=0.25, cap=8.0, switch=1.0)


def _decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every prediction with a number in one of its answers: numbers, the states that the rules name, the states decoded.

    The device is the example: its answers, gold and predicted in turn, in order of time.
    A prediction without an example is a device of its own.
    """
    none = F.lit(0)
    a = _amounts(spark, root).select(
        "prediction_id", F.coalesce("example_id", F.concat(F.lit("prediction "), F.col("prediction_id").cast("string")), F.lit("")).alias("device"), "run_at",
        F.col("gold.number").alias("gold_number"), units.evidence(F.col("gold"), F.col("asked")).alias("gold_said"),
        F.col("pred.number").alias("pred_number"), units.evidence(F.col("pred"), F.col("asked"), F.col("label"), F.col("answer_scale")).alias("pred_said"),
    )
    s = units.bounded_series(a, "device", ["run_at", "prediction_id"], ["gold_number", "gold_said", "pred_number", "pred_said"])
    pairs = lambda what: F.flatten(F.transform("items", lambda x: F.array(x[f"gold_{what}"], x[f"pred_{what}"])))
    s = s.select("device", "part", "hot", "head", "items", pairs("number").alias("numbers"), pairs("said").alias("named"))
    s = units.decode_ranges(s, "device", "numbers", "named", **_COSTS).select(F.posexplode("items").alias("n", "i"), "states")
    out = [F.col("i.prediction_id").alias("prediction_id")]
    for k, side in enumerate(("gold", "pred")):
        out += [F.col(f"i.{side}_number").alias(f"{side}_number"), F.col(f"i.{side}_said").alias(f"{side}_said"), F.get("states", F.col("n") * 2 + k).alias(f"{side}_state")]
        out.append(F.when(F.col(f"i.{side}_number").isNotNull(), F.coalesce(f"i.{side}_said", none)).alias(f"{side}_ruled"))
    return s.select(*out).where(F.col("gold_number").isNotNull() | F.col("pred_number").isNotNull())


def p4_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Both answers of every prediction in common units; ``stated``: the unit is named, not decoded from the level."""
    out = [F.col("prediction_id")]
    for side in ("gold", "pred"):
        number, state = F.col(f"{side}_number"), F.col(f"{side}_state")
        out += [number.alias(f"{side}_number"), units.state_kind(state).alias(f"{side}_kind"), (number * units.state_factor(state)).alias(f"{side}_value"), F.when(number.isNotNull(), F.col(f"{side}_said").isNotNull()).alias(f"{side}_stated")]
    return _decoded(spark, root).select(*out)


def p4_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Predictions whose answers agree in the units decoded, but not as written."""
    side = lambda name: (units.state_kind(F.col(f"{name}_state")), F.col(f"{name}_number") * units.state_factor(F.col(f"{name}_state")))
    (gold_kind, gold), (pred_kind, pred) = side("gold"), side("pred")
    kinds = (gold_kind == pred_kind) | (gold_kind == "none") | (pred_kind == "none")
    near = F.abs(gold - pred) <= _TOLERANCE * F.abs(gold)
    apart = F.abs(F.col("gold_number") - F.col("pred_number")) > _TOLERANCE * F.abs("gold_number")
    return _decoded(spark, root).where(kinds & near & apart)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The candidates whose decoded units are those that the data's rules give.

    The rules leave a number without any unit plain; where the decoder read another
    unit from the level, the candidate is dropped. It misses none (see units).
    """
    licensed = (F.col("gold_state") == F.col("gold_ruled")) & (F.col("pred_state") == F.col("pred_ruled"))
    return p4_candidates(spark, root).where(licensed).select("prediction_id").distinct()


def p4_unit_switches(spark: SparkSession, root: str) -> DataFrame:
    """Units of the predicted answers decoded from the level alone where their texts are silent.

    The device is the example, its series the predicted answers in order of
    time, led by the gold answer; labels and questions are not used.
    ``switched``: the unit differs from the one before it.
    """
    a = _amounts(spark, root).where(F.col("pred").isNotNull() & F.col("gold").isNotNull() & F.col("example_id").isNotNull())
    a = a.select("example_id", "run_at", "prediction_id", F.col("pred.number").alias("number"), units.evidence(F.col("pred"), F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("factor"))).alias("said"),
                 F.col("gold.number").alias("lead"), units.evidence(F.col("gold"), F.col("asked")).alias("lead_said")).distinct()
    s = units.bounded_series(a, "example_id", ["run_at", "prediction_id", "number"], ["said", "lead", "lead_said"])
    i = F.col("items")
    led = lambda lead, own: F.when(F.col("head"), F.concat(F.array(i[0][lead]), i[own])).otherwise(i[own])
    s = s.select("example_id", "part", "hot", "head", "items", led("lead", "number").alias("numbers"), led("lead_said", "said").alias("named"))
    s = units.decode_ranges(s, "example_id", "numbers", "named", prior=3.0)
    s = s.withColumn("states", F.when(F.col("before").isNull(), F.col("states")).otherwise(F.concat(F.array("before"), "states")))
    s = s.select("example_id", F.posexplode("items").alias("n", "item"), "states")
    state, before = F.get("states", F.col("n") + 1), F.get("states", F.col("n"))
    return s.select(
        "example_id", F.col("item.prediction_id").alias("prediction_id"), F.col("item.number").alias("number"), F.col("item.said").isNotNull().alias("stated"),
        units.state_kind(state).alias("kind"), units.state_factor(state).alias("factor"), (F.col("item.number") * units.state_factor(state)).alias("value"),
        (state != before).alias("switched"),
    )


# ---------------------------------------------------------------- SQL of p3 and p4

_P3_SQL_NODES = r"""
r as (select raw_id, case when json_type(p, '$.record') = 'OBJECT' then p -> 'record' else p end as j from (select raw_id, try_cast(payload as json) as p from raw_records) where p is not null),
q as (select raw_id, 0 as no, j -> 'qa' as q from r where json_type(j, '$.qa') = 'OBJECT'
  union all select raw_id, i, json_extract(j, '$.qa[' || i || ']') from (select *, unnest(range(json_array_length(j, '$.qa')::bigint)) as i from r where json_type(j, '$.qa') = 'ARRAY')),
t as (select raw_id, i as no, json_extract(j, '$.table[' || i || ']') as row from (select *, unnest(range(json_array_length(j, '$.table')::bigint)) as i from r where json_type(j, '$.table') = 'ARRAY')),
c as (select raw_id, no, i, json_extract(cells, '$[' || i || ']') as cell from (select *, unnest(range(json_array_length(cells)::bigint)) as i from (select raw_id, no, case when json_type(row) = 'OBJECT' then row -> 'cells' else row end as cells from t) where json_type(cells) = 'ARRAY')),
g as (select raw_id, no, unnest(json_keys(q, '$.gold_inds')) as k from q where json_type(q, '$.gold_inds') = 'OBJECT'
  union all select raw_id, no, json_extract(q, '$.gold_inds[' || i || ']') ->> 'ind' from (select *, unnest(range(json_array_length(q, '$.gold_inds')::bigint)) as i from q where json_type(q, '$.gold_inds') = 'ARRAY')),
a as (select raw_id, no, f, json_extract_string(q, '$.' || f || 's') as v from q, (values ('ann_table_row'), ('ann_text_row')) w(f) where json_type(q, '$.' || f || 's') not in ('ARRAY', 'OBJECT', 'NULL')
  union all select raw_id, no, f, json_extract_string(q, '$.' || f || 's[' || i || ']') from (select *, unnest(range(json_array_length(q, '$.' || f || 's')::bigint)) as i from (select * from q, (values ('ann_table_row'), ('ann_text_row')) w(f) where json_type(q, '$.' || f || 's') = 'ARRAY')))
"""

# the same nodes with their numbers: the order of json_tree is that of a depth-first traversal
_P3_SQL_TREE = (
    _P3_SQL_NODES
    + r""",
b as (select raw_id, case when json_type(p, '$.record') = 'OBJECT' then '$.record' else '$' end as base, p from (select raw_id, try_cast(payload as json) as p from raw_records) where p is not null),
n as (select raw_id, base, row_number() over (partition by raw_id order by j.id) - 1 as pre, j.fullkey as path from b, json_tree(b.p) j),
rp as (select raw_id, min(pre) filter (where path = base) as record_pre, max(pre) filter (where path = base or starts_with(path, base || '.') or starts_with(path, base || '[')) as record_post from n group by raw_id),
qp as (select q.raw_id, no, q, min(pre) as question_pre, max(pre) as question_post from q join b using (raw_id) join n on n.raw_id = q.raw_id
    and (n.path in (n.base || '.qa', n.base || '.qa[' || no || ']') or starts_with(n.path, n.base || '.qa.') or starts_with(n.path, n.base || '.qa[' || no || '].') or starts_with(n.path, n.base || '.qa[' || no || ']['))
    and (json_type(b.p, n.base || '.qa') = 'OBJECT' or n.path <> n.base || '.qa') where json_type(q) = 'OBJECT' group by all)
"""
)

P3_SQL = {
    "p3_found": f"""with {_P3_SQL_NODES} select distinct raw_id, child, parent_no::int as parent_no, child_key from (
  select raw_id, 'qa' as child, 0 as parent_no, no::varchar as child_key from q where json_type(q) = 'OBJECT'
  union all select raw_id, 'cell', no, i::varchar from c where json_type(cell) <> 'NULL'
  union all select raw_id, 'gold', no, k from g where k is not null
  union all select raw_id, f, no, trim(v) from a where v is not null)""",
    "p3_records": f"with {_P3_SQL_TREE} select raw_id, record_pre, record_post, j ->> 'id' as example_id, j ->> 'filename' as document_id from r join rp using (raw_id) where json_type(j) = 'OBJECT'",
    "p3_questions": rf"""with {_P3_SQL_TREE} select raw_id, record_pre, question_pre, question_post, no::int as question_no, q ->> 'question' as question, q ->> 'answer' as answer, q ->> 'program' as program, case when json_type(q, '$.exe_ans') = 'DOUBLE' then regexp_replace(q ->> 'exe_ans', '\.0$', '') else q ->> 'exe_ans' end as numeric_answer, q ->> 'explanation' as explanation
  from qp join rp using (raw_id)""",
    "p3_cells": f"""with {_P3_SQL_TREE}, tp as (select t.raw_id, no, row, pre as row_pre from t join n on n.raw_id = t.raw_id and n.path = base || '.table[' || no || ']')
  select c.raw_id, record_pre, row_pre, c.no::int as row_no, case when json_type(row) = 'OBJECT' then row ->> 'label' end as row_label, i::int as cell_no, cell ->> '$' as value from c join tp using (raw_id, no) join rp on rp.raw_id = c.raw_id where json_type(cell) <> 'NULL'""",
    "p3_evidence": f"""with {_P3_SQL_TREE}, e as (
    select raw_id, no, question_pre, k as evidence_key, json_extract_string(q, '$.gold_inds."' || k || '"') as text, null::double as weight from (select *, unnest(json_keys(q, '$.gold_inds')) as k from qp where json_type(q, '$.gold_inds') = 'OBJECT')
    union all select raw_id, no, question_pre, g ->> 'ind', g ->> 'text', try_cast(g ->> 'weight' as double) from (select *, json_extract(q, '$.gold_inds[' || i || ']') as g from (select *, unnest(range(json_array_length(q, '$.gold_inds')::bigint)) as i from qp where json_type(q, '$.gold_inds') = 'ARRAY')) where json_type(g) = 'OBJECT')
  select raw_id, question_pre, no::int as question_no, evidence_key, text, weight from e""",
    "p3_annotations": f"with {_P3_SQL_TREE} select a.raw_id, question_pre, a.no::int as question_no, f as kind, trim(v) as row_no from a join qp using (raw_id, no) where v is not null",
}


def _amount_sql(text: str) -> str:
    """struct(number, kind, factor) of a text, with the same patterns."""
    t = f"lower(translate({text}, '−–‒' || chr(160) || chr(10) || chr(13), '---   '))"
    g = lambda i: f"regexp_extract({t}, '{units.AMOUNT}', {i})"
    word = lambda i: f"regexp_extract({g(7)}, '{units.AFTER}(?:[^a-z]|$)', {i})"
    kind = "case " + " ".join(f"when regexp_full_match({word(2)}, '{w}') then '{k}'" for w, k, _ in units.UNIT_WORDS) + f" when {g(3)} <> '' then 'dollars' end"
    points = "case " + " ".join(f"when regexp_full_match({word(2)}, '{w}') then {f}" for w, k, f in units.UNIT_WORDS if f) + " end"
    scale = "case " + " ".join(f"when regexp_full_match({word(1)}, '{w}') then {f}" for w, f in units.SCALE_WORDS) + " end"
    size = f"try_cast(replace({g(6)}, ',', '') as double)"
    minus = f"({g(2)} <> '' or {g(4)} <> '' or (({g(1)} <> '' or {g(5)} <> '') and contains({g(7)}, ')')))"
    return f"{{'number': case when {minus} then -{size} else {size} end, 'kind': {kind}, 'factor': case when ({kind}) = 'percent' then {points} else {scale} end}}"


def _p4_sql() -> str:
    q = "lower(translate(question, '−–‒' || chr(160) || chr(10) || chr(13), '---   '))"
    asked = lambda i: f"regexp_extract({q}, '{units.QUESTION}', {i})"
    ask_kind = "case " + " ".join(f"when regexp_full_match({asked(2)}, '{w}') then '{k}'" for w, k, _ in units.UNIT_WORDS) + " end"
    ask_factor = "case " + " ".join(f"when regexp_full_match({asked(2)}, '{w}') then {f}" for w, _, f in units.UNIT_WORDS if f) + " " + " ".join(f"when regexp_full_match({asked(1)}, '{w}') then {f}" for w, f in units.SCALE_WORDS) + " end"
    u = r"regexp_replace(trim(lower(answer_unit)), '[\s_-]+', ' ', 'g')"
    return rf"""with a as (select prediction_id, {_amount_sql('gold_answer')} as g, {_amount_sql('predicted_answer')} as p, {ask_kind} as qk, {ask_factor} as qf, lower(trim(coalesce(answer_scale, ''))) = 'raw' as raw,
    case when regexp_matches({u}, 'percentage points?|basis points?|\bpps?\b|\bbps?\b|percent|%|\bpct\b') then 'percent' when regexp_matches({u}, '\$|usd|dollar') then 'dollars' when regexp_matches({u}, '\bshares?\b') then 'shares' end as lk,
    case when regexp_matches({u}, 'basis points?|\bbps?\b') then 1e-4 when regexp_matches({u}, 'percentage points?|\bpps?\b') then 1e-2 end as lp,
    case when contains({u}, 'thousand') then 1e3 when contains({u}, 'million') then 1e6 when contains({u}, 'billion') then 1e9 when contains({u}, 'trillion') then 1e12 end as lf from predictions),
  b as (select *, p.kind is null and p.factor is null as bare, g.kind is null and g.factor is null as gbare from a where g.number is not null and p.number is not null),
  c as (select prediction_id, g.number as gn, p.number as pn,
    case when gbare then qk else g.kind end as gk, case when gbare then coalesce(qf, 1) else coalesce(g.factor, 1) end as gf,
    case when bare and lk = 'percent' then 'percent' when bare and lk is null and lf is null then qk else coalesce(p.kind, case when lk <> 'percent' then lk end) end as pk,
    case when bare and lk = 'percent' then coalesce(lp, case when abs(p.number) <= 1 and not raw then 1 else 1e-2 end) when bare and lk is null and lf is null then coalesce(qf, 1)
      when p.kind = 'percent' or lk = 'percent' then coalesce(p.factor, 1) else coalesce(p.factor, lf, 1) end as pf from b)
  select distinct prediction_id from c where (gk is null or pk is null or gk = pk) and abs(gn * gf - pn * pf) <= {_TOLERANCE} * abs(gn * gf) and abs(gn - pn) > {_TOLERANCE} * abs(gn)"""


P4_SQL = {"p4_found": _p4_sql()}
