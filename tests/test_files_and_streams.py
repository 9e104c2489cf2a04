"""Queries without an SQL twin, readers and sinks on awkward files, invariants of the migration."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from recordgate.functions import dates, numbers, text
from recordgate.operators import apply, contract, rules
from recordgate.plans import ORACLE_SQL, QUERIES, registry, staging
from recordgate.sources import readers, sinks
from recordgate.streaming import stream


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_a_twin_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def values(spark, expression, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string")
    return [r.v for r in df.select("k", expression(F.col("c")).alias("v")).orderBy("k").collect()]


def test_scalars(spark):
    assert values(spark, dates.full_year, "11/15/25", "1/5/25", "12/31/99", "11-2025", None) == ["11/15/2025", "1/5/2025", "12/31/1999", "11-2025", None]
    assert values(spark, dates.two_forms, "31/02/2024", "29/02/2024", "2024-13-45", "2024-1-5") == [None, datetime.date(2024, 2, 29), None, None]
    assert values(spark, dates.to_date, "05/04/2024", "13/04/2024", "04/13/2024", "4/3/2024", "2024/01/02 10:11:12", "x") == [
        datetime.date(2024, 4, 5), datetime.date(2024, 4, 13), datetime.date(2024, 4, 13), datetime.date(2024, 4, 3), datetime.date(2024, 1, 2), None,
    ]
    assert values(spark, dates.named_month_date, "15-Nov-2025", "1-tháng mười hai-99", "3-sept-30", "31-feb-2024", "5-xx-2020") == [
        datetime.date(2025, 11, 15), datetime.date(1999, 12, 1), datetime.date(2030, 9, 3), None, None,
    ]
    assert values(spark, dates.from_serial, "1", "59", "61", "45000", "0", "3000000", "x") == [
        datetime.date(1900, 1, 1), datetime.date(1900, 2, 28), datetime.date(1900, 3, 1), datetime.date(2023, 3, 15), None, None, None,
    ]
    assert values(spark, numbers.to_whole, "12", "12.7", "-12.7", "1x", " 7 ", "") == [12, 12, -12, None, 7, None]
    assert values(spark, numbers.to_double, "12%", "1.5", "x%") == [0.12, 1.5, None]
    assert values(spark, text.identifier_text, "1.23E+11", "123.0", "0012", None) == ["123000000000", "123", "0012", None]
    assert values(spark, text.masked, "abcd", "abcde", None) == ["abcd", "ab*de", None]
    assert values(spark, text.plain_name, "Đường Số") == ["đuong so"]
    assert values(spark, text.normal_text, " \t a\u0001", "\n \r") == ["A", None]


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "a,b"), ("2", 'say "x"'), ("3", None), ("4", "  pad "), ("5", "x")]
    sinks.write_csv(spark.createDataFrame(rows, "id string, Note string"), str(tmp_path / "out"))
    good, bad = readers.read_delimited(spark, str(tmp_path / "out"), ["ID", "note", "absent"])
    got = {r.ID: (r.note, r.absent) for r in good.collect()}
    assert got == {"1": ("a,b", None), "2": ('say "x"', None), "3": (None, None), "4": ("pad", None), "5": ("x", None)}
    assert bad.count() == 0


def test_bad_lines_are_put_aside(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": "1"}\n\n{broken\n{"a": 2, "b": "x"}\n')
    good, bad = readers.read(spark, str(tmp_path / "in.jsonl"), ["a", "b"])
    assert sorted((r.a, r.b) for r in good.collect()) == [("1", None), ("2", "x")] and bad.count() == 1
    (tmp_path / "one.json").write_text('[{"a": "1"}, {"a": "2"}]')
    assert readers.read(spark, str(tmp_path / "one.json"), ["a"])[0].count() == 2
    with pytest.raises(ValueError, match="no reader"):
        readers.reader_for("x.unknown")


def test_a_second_run_inserts_nothing(spark, sf, tmp_path):
    t = registry.Source(spark, sf)
    rows = staging.accepted(t.stg_case).select(F.col("doc_type").alias("name"))
    new = apply.missing_members(rows, t.m_doc_type, ["name"])
    grown = apply.grown(t.m_doc_type, apply.with_surrogate(new, t.m_doc_type, ["name"]))
    assert new.count() == 1 and apply.missing_members(rows, grown, ["name"]).count() == 0
    facts = t.stg_contract.select("contract_no", "row_num")
    for _ in range(2):
        sinks.append_new(facts, str(tmp_path / "facts"), ["contract_no"])
    stored = spark.read.parquet(str(tmp_path / "facts"))
    assert stored.count() == facts.select("contract_no").distinct().count()


def test_valid_and_rejected_rows_add_up(spark, sf):
    t = registry.Source(spark, sf)
    checked = staging.checked_case(t)
    assert checked.count() == t.stg_case.where("parse_errors is null").count()
    assert checked.groupBy("row_num").count().where("count > 1").count() == 0
    assert checked.where("error_type is not null and error_field is null").count() == 0


def test_drop_job_leaves_other_jobs(spark, tmp_path):
    df = spark.createDataFrame([("J1", "s", 1), ("J2", "s", 2)], "job_id string, sheet_name string, n int")
    path = str(tmp_path / "staging")
    sinks.append_staging(df, path)
    sinks.drop_job(path, spark.read.parquet(path), "J1")
    assert [r.job_id for r in spark.read.parquet(path).collect()] == ["J2"]


def test_stream_gives_up_after_its_budget_and_resumes(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_name")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: stream.files(spark, str(tmp_path / "in"), rows.schema)

    def broken(df, number):
        raise ValueError("always")

    with pytest.raises(Exception, match="more than 1 batches failed"):
        stream.run_batches(source(), stream.tolerant(broken, str(tmp_path / "results"), 1), str(tmp_path / "cp1"))
    keep = lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))
    assert stream.run_batches(source(), keep, str(tmp_path / "cp2")) > 0
    assert stream.run_batches(source(), keep, str(tmp_path / "cp2")) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_fail_fast(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "n int")
    assert rules.over_budget(df, 10).first().over_budget is False
    with pytest.raises(Exception, match="too many errors"):
        rules.over_budget(df, 3, fail=True).collect()


def test_layout_and_titles():
    assert sinks.layout(600_000, 20)["text"] and sinks.layout(600_000, 20)["files"] == 6
    assert sinks.title("identityCard") == "Identity Card"


def test_staging_in_buckets_has_no_folder_for_each_job(spark, tmp_path):
    df = spark.range(3000).select(F.concat(F.lit("J"), F.col("id") % 900).alias("job_id"), F.when(F.col("id") % 2 == 0, "a").alias("sheet_name"), F.col("id").alias("n"))
    path = str(tmp_path / "staging")
    for _ in range(2):
        sinks.append_buckets(df, path, 4)
    assert len(list((tmp_path / "staging").iterdir())) <= 6 and len(spark.read.parquet(path).inputFiles()) <= 2 * (4 + 8)
    assert spark.read.parquet(path).drop("bucket").exceptAll(df.unionByName(df)).count() == 0 and spark.read.parquet(path).count() == 6000
    assert sorted(r.n for r in sinks.rows_of_job(spark, path, "J7", 4).collect()) == sorted([7, 907, 1807, 2707] * 2)
    assert len(sinks.rows_of_job(spark, path, "J7", 4).columns) == 3


def test_snk04_files_do_not_grow_with_jobs(spark, tmp_path, sf, monkeypatch):
    monkeypatch.setattr("recordgate.plans.file_queries.scratch", lambda t, name: str(tmp_path / name))
    assert QUERIES["SNK04"](spark, sf).count() > 100
    assert len(list((tmp_path / "snk04").glob("*=*"))) <= sinks.BUCKETS


def test_src04_writes_few_documents(spark, tmp_path, sf, monkeypatch):
    monkeypatch.setattr("recordgate.plans.file_queries.scratch", lambda t, name: str(tmp_path / name))
    assert QUERIES["SRC04"](spark, sf).count() == 25
    assert len(list((tmp_path / "src04").glob("part-*"))) == 1


def test_cells_are_not_dealt_by_column(spark):
    spec = spark.createDataFrame([("d", "a", 1, True, 2, None, "string"), ("d", "b", 2, False, None, "^x", "string")], contract.CONTRACT)
    rows = spark.range(100_000_000).select("id", F.lit(None).cast("string").alias("a"), F.lit("y").alias("b"))
    plan = contract.cell_errors(rows, spec, ["id"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(column" not in plan and "BroadcastHashJoin" in plan


def test_repeats_make_each_column_once(spark, sf):
    found = QUERIES["WIN02"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and found.count() > 0
