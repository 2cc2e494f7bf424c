import json

import pytest
from pyspark.sql import functions as F

from evidlake.operators import answers, calculation, evaluation
from evidlake.sources import artifacts, reports


def run(spark, steps, unit=None, scale=None):
    text = steps if isinstance(steps, str) or steps is None else json.dumps([{"operation": o, "arguments": a} for o, a in steps])
    df = spark.createDataFrame([(text, unit, scale)], "s string, u string, c string")
    return df.select(calculation.execute(calculation.program(F.col("s")), F.col("u"), F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "steps,unit,scale,formatted",
    [
        ([("subtract", ["1654", "1251"]), ("add", [1654, "#0"])], None, None, "2057"), ([("divide", [1, 8])], "percent", "auto", "12.5%"), ([("divide", [1, 8])], "percent", "raw", "0.125%"),
        ([("divide", [3, 2])], "Percentage", None, "1.5%"), ([(" Divide ", ["(1,000)", "4"])], "dollars", None, "$-250"), ([("add", [1, 1]), ("multiply", ["#-1", "const_100"])], "shares", None, "200 shares"),
        ([("greater", [2, 1])], "percent", None, "yes"), ([("exp", [2, 10])], "million", None, "1024 million"), ([("add", [True, "const_m1"])], None, None, "2"), ([("add", [1e9, 0.12])], None, None, "1000000000.12" if False else "1000000000"),
        ([("multiply", [-1, 0])], "odd unit", "odd scale", "0"), ([("divide", [1, 3])], "billions", None, "0.33333 billion"),
    ],
)
def test_programs(spark, steps, unit, scale, formatted):
    x = run(spark, steps, unit, scale)
    assert (x.formatted, x.error) == (formatted, None)


@pytest.mark.parametrize(
    "steps,error,lines",
    [
        (None, "No calculation steps were provided.", 0), ("", "No calculation steps were provided.", 0), ("[]", "No calculation steps were provided.", 0), ("{broken", "No calculation steps were provided.", 0),
        ([("divide", [1, 0])], "Cannot divide by zero.", 0), ([("greater", [2, 1]), ("add", ["#0", 1])], "could not convert string to float: 'yes'", 1), ([("add", [1])], "add expects exactly two arguments.", 0),
        ([("add", [1, 2, 3])], "add expects exactly two arguments.", 0), ([("Root", [1, 2])], "Unsupported operation: Root", 0), ([("add", ["#3", 1])], "Step reference #3 does not exist.", 0), ([("add", [" ", 1])], "Empty calculation operand.", 0),
        ([("add", [1, 1]), ("add", ["none", 1]), ("add", [1, 1])], "Could not parse numeric operand: none", 1), ([("add", [None, 1])], "Could not parse numeric operand: None", 0), ([("exp", [-1, 0.5])], "Result is not a finite number.", 0),
    ],
)
def test_program_errors(spark, steps, error, lines):
    x = run(spark, steps)
    assert x.error == error and x.formatted is None and (x.trace or "").count("#0 = ") == bool(lines) and (x.trace is None) == (lines == 0)


def test_trace(spark):
    assert run(spark, [("subtract", ["1654", "1251"]), ("add", [1654, "#0"])]).trace == "#0 = subtract(1654, 1251) = 403\n#1 = add(1654, 403) = 2057"


@pytest.mark.parametrize("text,number", [("(1,234)", -1234.0), ("12%", 12.0), ("1e5", 1.0), ("m1", 1.0), ("$ -3.50", -3.5), ("-", None), ("", None), (None, None)])
def test_parse_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(calculation.parse_number(F.col("t"))).first()[0] == number


@pytest.mark.parametrize("v,text", [(2.675, "2.675"), (-0.0, "0"), (1234567890.12, "1234567890"), (0.000001, "0"), (1.999999, "2"), (-1.5, "-1.5"), (1e20, "100000000000000000000")])
def test_format_number(spark, v, text):
    assert spark.createDataFrame([(v,)], "v double").select(calculation.format_number(F.col("v"))).first()[0] == text


def parsed(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(answers.parse(F.col("t")).alias("p")).first().p


def test_payloads(spark):
    p = parsed(spark, 'Sure: {"answer": 5, "citations": [{"chunk_id": "CHUNK a ", "quote": null}, "x"], "calculation_steps": [{"operation": "add", "arguments": ["1", 2]}, 3], "insufficient_evidence": "false"} done')
    assert (p.valid, p.answer, [c.chunk_id for c in p.citations], len(p.steps), p.insufficient_evidence) == (True, "5", ["a"], 1, True)
    p = parsed(spark, '```json\n{"citations": null, "insufficient_evidence": 0}\n```')
    assert (p.valid, p.answer, p.citations, p.insufficient_evidence) == (True, "", [], False)
    for bad in ("none", "", None, "[1, 2]", "{broken"):
        assert not parsed(spark, bad).valid


def test_finished(spark):
    got = "array<struct<chunk_id:string,source_ids:array<string>>>"
    rows = [
        ("1", json.dumps({"answer": "x", "citations": [{"chunk_id": "table_1"}], "calculation_steps": [{"operation": "divide", "arguments": [1, 4]}], "answer_unit": "percent"}), [("E::table::1", ["table_1"])]),
        ("2", json.dumps({"answer": "x", "citations": [{"chunk_id": "other"}], "calculation_steps": [{"operation": "divide", "arguments": [1, 0]}]}), [("E::table::1", ["table_1"]), ("F::table::1", ["table_1"])]),
        ("3", None, None),
    ]
    a = {r.query_id: r for r in answers.finished(spark.createDataFrame(rows, f"query_id string, payload string, retrieved {got}")).collect()}
    assert (a["1"].answer, a["1"].cited, a["1"].error) == ("25%", ["E::table::1"], None)
    assert a["2"].answer == "x" and a["2"].execution_error == "Cannot divide by zero." and "other" in a["2"].error
    assert a["3"].error


def test_matches(spark):
    df = spark.createDataFrame([("14.1%", "14.11%", "0.1411"), ("5 %", "5", None), ("yes", "yes", "yes"), (None, "5", None), ("1,001", "1000", None), ("none", "", None)], "p string, g string, x string")
    r = df.select(evaluation.normalize_answer(F.col("p")).alias("n"), evaluation.exact_match(F.col("p"), F.col("g")).alias("e"), evaluation.numerical_match(F.col("p"), evaluation.gold_numbers(F.col("g"), F.col("x"))).alias("m"), evaluation.yes_no_gold(F.col("x")).alias("y")).collect()
    assert [x.n for x in r] == ["14.1", "5 ", "yes", None, "1001", "none"]
    assert [bool(x.e) for x in r] == [False, False, True, False, False, False]
    assert [bool(x.m) for x in r] == [True, True, False, False, True, False] and [x.y for x in r][2]


def test_metrics(spark):
    q = spark.createDataFrame([("E",), ("F",), ("G",)], "query_id string")
    chunks = spark.createDataFrame([("E", i, [f"text_{i}"]) for i in range(5)], "example_id string, pos int, source_ids array<string>")
    gold = spark.createDataFrame([("E", "E::text_1"), ("E", "E::table_9"), ("F", "F::text_0")], "query_id string, gold_id string")
    r = spark.createDataFrame([("E", 1, "E", 0), ("E", 2, "E", 1), ("F", 1, "E", 0)], "query_id string, rank int, example_id string, pos int")
    m = {x.query_id: x for x in evaluation.retrieval_metrics(q, r, chunks, gold).collect()}
    assert (m["E"].reciprocal_rank, m["E"].hit_1, m["E"].hit_3, m["E"].recall_3) == (0.5, 0.0, 1.0, 0.5)
    assert m["F"].reciprocal_rank == 0 and m["G"].recall_10 == 0
    s = evaluation.averages(evaluation.retrieval_metrics(q.limit(0), r, chunks, gold), ["hit_1"]).first()
    assert s.examples == 0 and s.hit_1 == 0.0
    assert all(x.recall_1 <= x.recall_3 <= x.recall_5 <= x.recall_10 for x in m.values())


def test_failure_classes(spark):
    ex = spark.createDataFrame([("E", {"table_1": "", "text_0": ""}), ("N", None)], "example_id string, gold_evidence map<string,string>")
    ch = spark.createDataFrame([("E::table::1", "E", ["table_1"]), ("E::pre_text::0", "E", ["text_0"]), ("X::table::1", "X", ["table_1"])], "chunk_id string, example_id string, source_ids array<string>")
    cols = "prediction_id long, example_id string, exact_match boolean, numerical_match boolean, citation_valid boolean, insufficient_evidence boolean, error string, predicted_answer string, retrieved_chunk_ids array<string>"
    both = ["E::table::1", "E::pre_text::0", None]
    rows = [
        (1, "E", True, False, True, False, "boom", "5", both), (2, "E", True, None, False, False, None, "5", both), (3, "E", False, False, False, False, "", "5", both), (4, "E", False, False, True, False, "", "5", ["X::table::1"]),
        (5, "E", False, False, True, False, "", "5", both[:1]), (6, "E", False, False, True, False, "", "None", both), (7, "E", False, False, True, False, "", "5", both), (8, "unknown", True, True, True, False, "", "5", both), (9, "N", False, False, True, False, "", None, None),
    ]
    got = {r.prediction_id: r.failure_category for r in evaluation.failures(spark.createDataFrame(rows, cols), ex, ch).collect()}
    assert got == {**{i + 1: c for i, c in enumerate(evaluation.FAILURES)}, 9: "retrieval_failure"}
    s = evaluation.answer_summary(spark.createDataFrame([], "error string, exact_match boolean, numerical_match boolean, citation_valid boolean, executed_answer string, execution_error string, insufficient_evidence boolean, total_ms double, retrieval_ms double, generation_ms double, estimated_cost_usd double, embedding_calls int, generation_calls int, retrieved_chunks int")).first()
    assert s.examples == 0 and s.error_rate == 1.0 and s.exact_match == 0.0


RECORD = {"id": "E", "filename": "f", "pre_text": ["a"], "table": [["h"], ["v"]], "post_text": [], "qa": {"question": "q", "answer": "a", "exe_ans": 0.03}}


def test_report_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([RECORD, {**RECORD, "id": "F"}]))
    (tmp_path / "l.json").write_text("\n".join(json.dumps({**RECORD, "id": i}) for i in "GHI"))
    df = reports.load_examples(spark, str(tmp_path / "a.json"))
    assert [(r.example_id, r.gold_evidence, r.metadata.gold_numeric_answer) for r in df.orderBy("ord").collect()] == [("E", {}, "0.03"), ("F", {}, "0.03")]
    assert reports.load_examples(spark, str(tmp_path / "a.json"), limit=1).count() == 1
    assert reports.load_examples(spark, str(tmp_path / "l.json"), limit=2, lines=True).count() == 2
    (tmp_path / "d").mkdir()
    for n, ids in (("1", "AB"), ("2", "CD")):
        (tmp_path / "d" / f"{n}.json").write_text(json.dumps([{**RECORD, "id": i} for i in ids]))
    assert sorted(r.example_id for r in reports.load_examples(spark, str(tmp_path / "d"), limit=3).collect()) == ["A", "B", "C"]
    (tmp_path / "n.json").write_text('[{"id": ')
    with pytest.raises(Exception, match="no array of records"):
        reports.load_examples(spark, str(tmp_path / "n.json")).collect()
    (tmp_path / "b.json").write_text(json.dumps([{**RECORD, "filename": None}]))
    with pytest.raises(Exception, match="lacks a required field"):
        reports.load_examples(spark, str(tmp_path / "b.json")).collect()


def test_artifacts(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y,\n\"z\"")], "chunk_id string, content string")
    path = str(tmp_path / "chunks")
    built = []
    for rebuild in (False, False, True):
        assert artifacts.ensure_chunks(spark, path, lambda: built.append(1) or chunks, rebuild).count() == 2
    assert len(built) == 2
    assert artifacts.ensure_chunks(spark, path, lambda: built.append(1) or chunks.limit(1), limit=1).count() == 1 and len(built) == 3
    assert artifacts.ensure_chunks(spark, path, lambda: built.append(1) or chunks, limit=1).count() == 1 and len(built) == 3
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    artifacts.save_vectors(v, str(tmp_path / "v"))
    artifacts.save_metadata(v, str(tmp_path / "m"), "hash", "cosine")
    m = artifacts.load_metadata(spark, str(tmp_path / "m"))
    assert (m.first().chunk_count, m.first().embedding_dimension) == (2, 2)
    artifacts.validate_alignment(chunks, artifacts.load_vectors(spark, str(tmp_path / "v")), m)
    for bad, text in ((v.limit(1), "vector count"), (v.withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))), "ids differ")):
        with pytest.raises(ValueError, match=text):
            artifacts.validate_alignment(chunks, bad)
    artifacts.save_csv(chunks, str(tmp_path / "csv"))
    assert {tuple(r) for r in artifacts.load_csv(spark, str(tmp_path / "csv")).collect()} == {tuple(r) for r in chunks.collect()}
    runs = spark.createDataFrame([("a", {"mrr": 0.5}), ("b", {"hit": 1.0})], "name string, metrics map<string,double>")
    artifacts.save_summary(runs, str(tmp_path / "s"))
    assert {r.name: (r.hit, r.mrr) for r in artifacts.load_csv(spark, str(tmp_path / "s")).collect()} == {"a": (None, "0.5"), "b": ("1.0", None)}
    artifacts.save_manifest(runs, str(tmp_path / "manifest"))


def test_string_arguments_quotes_and_steps(spark):
    payload = '{"answer": "x", "citations": [{"chunk_id": "table_1", "quote": "q1"}, {"chunk_id": "CHUNK a"}], "calculation_steps": [{"operation": "add", "arguments": "12"}, {"operation": "a\\"b"}]}'
    r = spark.createDataFrame([("q", payload, [("a", ["text_0"]), ("b", ["table_1"])])], "query_id string, payload string, retrieved array<struct<chunk_id:string,source_ids:array<string>>>")
    a = answers.finished(r).first()
    assert [(c.chunk_id, c.quote) for c in a.citations] == [("b", "q1"), ("a", "")] and a.retrieved_chunk_ids == ["a", "b"]
    assert a.calculation_steps == '[{"operation": "add", "arguments": ["1", "2"]}, {"operation": "a\\"b", "arguments": []}]'
    assert answers.finished(r.withColumn("payload", F.lit("{}"))).first().calculation_steps == ""
