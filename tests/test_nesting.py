import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidlake.operators import nesting
from evidlake.plans import problems

SPEC = {"doc": [[]], "item": [["items", "*"]], "tag": [["items", "*", "tags", "*"], ["items", "*", "tags"]], "extra": [["more", "@"]]}

CARRY = {"item": ("pre", "pos")}


def nodes(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id long, payload string, value string")
    return nesting.interval_nodes(df, "raw_id", "payload", SPEC, CARRY)


def test_intervals_nest(spark):
    p = json.dumps({"items": [{"n": 1, "tags": ["a", None]}, {"tags": "b"}, None], "more": {"k": 2.0, "l": [1]}})
    rows = nodes(spark, [p]).collect()
    by = {t: sorted((r for r in rows if r.node_type == t), key=lambda r: r.pre) for t in SPEC}
    assert len(by["doc"]) == 1 and by["doc"][0].pre == 0
    assert all(by["doc"][0].pre <= r.pre and r.post <= by["doc"][0].post for r in rows)
    assert [r.pos for r in by["item"]] == [0, 1, 2]
    assert [(r.name, r.value) for r in by["extra"]] == [("k", "2"), ("l", None)]
    assert sorted((r.item_pos, r.value) for r in by["tag"] if r.value is not None) == [(0, "a"), (1, "b")]


TREE = st.recursive(
    st.none() | st.integers(-9, 9) | st.text("ab", max_size=2),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", "c"]), inner, max_size=3), max_leaves=30,
)
ANYWHERE = {"a": [["*"] * i + [s] for i in range(3) for s in ("a", "@")] + [["@", "a"], ["@", "@", "a"], ["b", "*", "a"]], "b": [["b"], ["@", "b"], ["a", "b", "b"], ["*", "b"], ["@", "*"]]}


@given(TREE)
@settings(max_examples=200, deadline=None)
def test_parents_are_the_innermost_containing_intervals(document):
    rows = nesting.label(document, ANYWHERE, carry={"a": ("pre", "post"), "b": ("pre", "name")})
    spans = sorted((r[1], r[2]) for r in rows)
    assert all(a[1] < b[0] or a[1] >= b[1] for a, b in zip(spans, spans[1:]))  # apart or one inside the other
    for r in rows:
        inside = {k: [q for q in rows if q[0] == k and q[1] < r[1] and q[2] >= r[2]] for k in "ab"}
        a, b = (max(inside[k], key=lambda q: q[1], default=None) for k in "ab")
        assert r[10:] == ((a[1], a[2]) if a else (None, None)) + ((b[1], b[5]) if b else (None, None))
        assert r[8] == sum(q[0] == r[0] and q[7] is not None and q[1] > r[1] and q[2] <= r[2] for q in rows)


def test_nested_sibling_and_wrapped_records(spark, tmp_path):
    q = {"question": "what?", "gold_inds": {"table_1": "x"}}
    payload = {"id": "r", "record": {"id": "in", "qa": q}, "qa": q, "table": [["h"], ["x"]]}
    spark.createDataFrame([(1, json.dumps(payload)), (2, json.dumps([payload, {"record": payload}]))], "raw_id long, payload string").write.parquet(f"{tmp_path}/raw_records.parquet")
    records = {(r.raw_id, r.record_pre): r for r in problems.p3_records(spark, str(tmp_path)).collect()}
    assert sorted((k[0], r.example_id) for k, r in records.items()) == [(1, "in"), (1, "r"), (2, "in"), (2, "r"), (2, "r")]  # the path of a record's record's record is none
    for t in (problems.p3_questions, problems.p3_cells):
        assert all((r.raw_id, r.record_pre) in records for r in t(spark, str(tmp_path)).collect())
    asked = [records[r.raw_id, r.record_pre].example_id for r in problems.p3_questions(spark, str(tmp_path)).where("raw_id = 1").collect()]
    assert sorted(asked) == ["in", "r"]
    assert all(records[r.raw_id, r.record_pre].example_id == "r" for r in problems.p3_cells(spark, str(tmp_path)).where("raw_id = 1").collect())


@pytest.mark.parametrize("bad", [None, "", "{", '{"a": NaN}', "[1,]", "퟿{"])
def test_invalid_gives_nothing(spark, bad):
    assert nodes(spark, [bad]).count() == 0


def test_empty_table(spark):
    assert nodes(spark, []).count() == 0


def test_deep_nesting_is_parsed_without_recursion():
    deep = "[" * 200_000 + "1" + "]" * 200_000
    assert nesting.parse(deep)[0]
    assert nesting._parse_deep('{"a": [1, {"b": null}, []], "c": "x\\n"}') == {"a": [1, {"b": None}, []], "c": "x\n"}
    for bad in ('{"a" 1}', "[1 2]", "[1", "]", '{"a": 1,}', "[1] 2", ""):
        assert nesting._parse_deep(bad) is None


def test_last_of_repeated_fields_counts(spark):
    assert [r.value for r in nodes(spark, ['{"more": {"k": 1, "k": 2}}']).where("node_type = 'extra'").collect()] == ["2"]


def test_records_without_optional_fields_stay(spark, tmp_path):
    q = {"question": "what?"}
    payloads = [{"qa": q}, {"record": {"qa": q}}, {"id": "w", "record": {"id": "a", "qa": [q, q]}}, [{"qa": q}, {"record": {"filename": "f", "qa": q}}], {"id": "b", "record": "text", "qa": q}]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "raw_id long, payload string")
    df.write.parquet(f"{tmp_path}/raw_records.parquet")
    records = problems.p3_records(spark, str(tmp_path)).collect()
    assert sorted((r.raw_id, r.example_id or "", r.document_id or "") for r in records) == [(0, "", ""), (1, "", ""), (2, "a", ""), (3, "", ""), (3, "", "f"), (4, "b", "")]
    asked = {(r.raw_id, r.record_pre) for r in problems.p3_questions(spark, str(tmp_path)).collect()}
    assert asked == {(r.raw_id, r.record_pre) for r in records}
