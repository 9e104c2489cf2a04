"""Rule files and runs over several sheets."""

import json

import pytest
from pyspark.sql import functions as F

from recordgate.operators import rulefile, sheets
from recordgate.operators.rulefile import RuleFileError, parse
from recordgate.operators.sheets import Sheet
from recordgate.plans import sheet_queries


def faults(text):
    with pytest.raises(RuleFileError) as found:
        parse(text)
    return found.value.faults


def test_faults_are_told_by_line():
    text = """rules:
  a:
    type: NO_SUCH
  b:
    enabled: maybe
    type: REQUIRED_FIELDS
    fields: one
  c:
    type: ENUM_VALUES
    rules:
      f: {values: [x]}
  d:
    type: BUSINESS_LOGIC
    rules:
      - {name: n, field: f, pattern: "("}
      - {name: m, field: f}
      - {name: o, field: f, dataType: WRONG}
      - {name: p, field: f, customValidator: nobody}
  e:
    type: DUPLICATE_CHECK
    rules:
      - condition: "x > 3"
        businessKey: [k]
  g:
    fields: [x]
  b:
    type: DATE_FORMAT
    fields: [[x]]
"""
    said = faults(text)
    assert [n for n, _ in said] == [3, 11, 15, 16, 17, 18, 22, 25, 26, 28]
    assert "unknown type of rule: NO_SUCH" in said[0][1] and "twice" in said[8][1]
    assert faults("rules: [") and faults("") and faults("x: 1") and faults("rules:\n  a: {type: REQUIRED_FIELDS}")[0][0] == 2


def test_json_is_read_too_and_order_is_kept():
    text = json.dumps({"rules": {"z": {"type": "REQUIRED_FIELDS", "fields": ["a"], "enabled": False}, "a": {"type": "DATE_FORMAT", "fields": ["b"]}}})
    groups = parse(text)
    assert list(groups) == ["z", "a"] and not groups["z"].enabled and groups["a"].fields == ("b",)


def test_conditions():
    text = """rules:
  d:
    type: DUPLICATE_CHECK
    rules:
      - {condition: "kind IN (A, 'B b',\\"C\\")", businessKey: [k]}
      - {condition: kind = D e, businessKey: [k, l]}
      - {businessKey: [k]}
"""
    one, two, three = parse(text)["d"].duplicates
    assert one.condition == rulefile.Condition("kind", ("A", "B b", "C"))
    assert two.condition == rulefile.Condition("kind", ("D e",))
    assert three.condition == rulefile.Condition()


RULES = """rules:
  need: {type: REQUIRED_FIELDS, fields: [k]}
  day: {type: DATE_FORMAT, dateFormat: dd/MM/yyyy, fields: [d]}
  same:
    type: DUPLICATE_CHECK
    rules: [{condition: kind = A, businessKey: [k]}, {condition: "kind IN (B)", businessKey: [k, d]}]
  known:
    type: MASTER_REFERENCE
    references: [{field: k, masterTable: m, masterColumn: code, condition: on = true}]
"""


def test_a_run_isolates_sheets_and_counts_while_writing(spark, tmp_path):
    masters = {"m": spark.createDataFrame([("a", "true"), ("b", "true"), ("c", "false")], "code string, on string")}
    rows = spark.createDataFrame(
        [(2, "a", "01/02/2024", "A"), (3, "a", None, "A"), (4, "b", "31/02/2024", "B"), (5, "b", "31/02/2024", "B"), (6, " ", "2024-01-01", "C"), (7, "c", None, "C"), (8, "c", None, None), (9, None, None, "A"), (10, None, None, "A")],
        "row_num int, k string, d string, kind string",
    )
    other = spark.createDataFrame([(2, "x", 1.5)], "row_num int, k string, amount double")
    registry = [
        Sheet("two", 2, ("need",), "t2"), Sheet("one", 1, ("need", "day", "same", "known"), "t1"), Sheet("lacks", 3, ("day",), "t3"), Sheet("wrong", 4, ("nothing",), "t3"),
        Sheet("few", 5, ("need", "day"), "t1", most_errors=4), Sheet("off", 0, ("need",), "t1", enabled=False),
    ]
    inputs = {"one": rows, "two": other, "lacks": other, "wrong": rows, "few": rows, "off": rows, "other": rows}
    got = {r["sheet_name"]: r for r in sheets.run("J", registry, inputs, parse(RULES), masters, str(tmp_path)).collect()}
    assert {n: (r["place"], r["status"], r["ingested"], r["valid"], r["errors"], r["inserted"]) for n, r in got.items()} == {
        "one": (1, "COMPLETED", 9, 1, 8, 1), "two": (2, "COMPLETED", 1, 1, 0, 1), "lacks": (3, "FAILED", 0, 0, 0, 0), "wrong": (4, "FAILED", 0, 0, 0, 0), "few": (5, "FAILED", 9, 4, 5, 0),
    }
    assert "no column d" in got["lacks"]["message"] and "no rule group nothing" in got["wrong"]["message"]
    errors = spark.read.parquet(f"{tmp_path}/errors").where("sheet_name = 'one'")
    assert sorted((r["row_num"], r["error_no"], r["error_type"]) for r in errors.collect()) == sorted([
        (3, 0, "DUP_IN_FILE"), (4, 0, "INVALID_DATE"), (5, 0, "INVALID_DATE"), (5, 1, "DUP_IN_FILE"), (6, 0, "REQUIRED_MISSING"), (6, 1, "INVALID_DATE"),
        (7, 0, "REF_NOT_FOUND"), (8, 0, "REF_NOT_FOUND"), (9, 0, "REQUIRED_MISSING"), (10, 0, "REQUIRED_MISSING"), (10, 1, "DUP_IN_FILE"),
    ])
    assert [(r["row_num"], r["kind"], r["job_id"]) for r in spark.read.parquet(f"{tmp_path}/t1").collect()] == [(2, "A", "J")]
    assert spark.read.parquet(f"{tmp_path}/t2").columns == ["row_num", "k", "amount", "job_id", "sheet_name"]
    total = sheets.roll_up(spark.read.parquet(f"{tmp_path}/results")).first()
    assert (total["sheets"], total["successes"], total["failures"], total["total_inserted"], total["success_rate"]) == (5, 2, 3, 2, 40.0)


def test_no_sheet_can_be_run(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a")], "row_num int, k string")
    got = sheets.run("J", [Sheet("s", 1, ("nothing",), "t")], {"s": rows}, {}, {}, str(tmp_path)).collect()
    assert [r["status"] for r in got] == ["FAILED"]


def test_all_sheets_are_one_plan(spark, sf):
    """Rules of a file become columns of one scan of each sheet."""
    from recordgate.plans.registry import Source

    t = Source(spark, sf)
    made = sheets.rule_set(sheet_queries.REGISTRY[1], sheet_queries.groups(), t.stg_contract.columns)
    df = sheets.checked(t.stg_contract, made, {"m_unit": t.m_unit.withColumn("is_active", F.col("is_active").cast("string"))})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "PythonUDF" not in plan
