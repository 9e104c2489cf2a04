"""Error budgets, gates before files, and batches that are committed whole."""

import uuid

import pytest
from pyspark.sql import functions as F

from recordgate.operators import contract
from recordgate.plans.registry import Source
from recordgate.plans import migration
from recordgate.sources.transactions import Database
from recordgate.streaming import gate, stream
from recordgate.streaming.budget import ErrorBudget, StopAtBudget

ROWS = "id long, bad boolean"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder):
    errors = F.array_compact(F.array(F.when(F.col("bad"), F.struct(F.lit("BAD").alias("error_type")))))
    return stream.files(spark, f"{folder}/*", spark.createDataFrame([], ROWS).schema).withColumn("errors", errors)


def test_a_budget_stops_the_reading_and_holds_over_stops(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(6):
        put(spark, f"{folder}/in", f"f{k}", [(10 * k + i, i < 2) for i in range(5)])
    budget = ErrorBudget(spark, f"{folder}/budget", most=5, details=3)
    write = lambda df, n: df.write.mode("append").parquet(f"{folder}/out")
    assert not budget.run(source(spark, f"{folder}/in"), write, f"{folder}/checkpoint")
    assert (budget.spent(), budget.batches().count(), spark.read.parquet(f"{folder}/out").count()) == (6, 3, 15)
    assert len(spark.read.parquet(f"{folder}/out").inputFiles()) == 3
    assert spark.read.parquet(f"{folder}/budget/details").count() == 3
    # The batch that spent the budget is run again, counts once, and the stream stops before further files.
    assert not budget.run(source(spark, f"{folder}/in"), write, f"{folder}/checkpoint")
    assert (budget.spent(), budget.batches().count()) == (6, 3)
    wide = ErrorBudget(spark, f"{folder}/wide", most=12)
    assert wide.run(source(spark, f"{folder}/in"), lambda df, n: df.write.mode("append").parquet(f"{folder}/all"), f"{folder}/checkpoint-wide")
    assert (wide.spent(), spark.read.parquet(f"{folder}/all").count()) == (12, 30)


def test_a_listener_stops_a_sink_of_sparks_own(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(8):
        put(spark, f"{folder}/in", f"f{k}", [(10 * k + i, i == 0) for i in range(5)])
    watch = StopAtBudget(spark, f"errors_{uuid.uuid4().hex}", most=1)
    spark.streams.addListener(watch)
    try:
        rows = watch.watched(source(spark, f"{folder}/in")).drop("errors")
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="2 seconds").start()
        query.awaitTermination(60)
        stopped = not query.isActive
        query.stop()
    finally:
        spark.streams.removeListener(watch)
    assert stopped and watch.errors > 1
    assert 2 <= watch.batches < 8 and spark.read.parquet(f"{folder}/out").count() < 40


CONTRACT = [("s", "id", 1, True, None, r"^\d+$", "int"), ("s", "name", 2, True, 5, None, "string"), ("s", "note", 3, False, None, None, "string")]


def test_an_invalid_file_contributes_no_row(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.csv").write_text('id,name,note\n1,one,"a,b"\n2,two,\n')
    (folder / "other.csv").write_text("Name, ID\nthree,3\n")
    (folder / "lacks.csv").write_text("id,note\n4,x\n")
    (folder / "long.csv").write_text("id,name\n5,abcdef\n6,ok\n")
    (folder / "late.csv").write_text("id,name\n" + "".join(f"{100 + i},n\n" for i in range(20)) + "x,late\n")
    (folder / "early.csv").write_text("id,name\n7,n\nx,early\n")
    (folder / "empty.csv").write_text("")
    table = spark.createDataFrame(CONTRACT, contract.CONTRACT)
    work = gate.gated(table, "s", ["id", "name", "note"], lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "faults"), rows=10)
    assert gate.run(spark, str(folder), str(tmp_path / "checkpoint"), work) == 1
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(r[0], r[1], r[2]) for r in got if not (r[0] or "").startswith("1") or r[0] == "1"} == {("1", "one", "a,b"), ("2", "two", None), ("3", "three", None), ("x", "late", None)}
    assert len(got) == 24
    faults = {(r["file"].rsplit("/", 1)[-1], r["fault"], r["column"], r["row_num"]) for r in spark.read.parquet(str(tmp_path / "faults")).collect()}
    assert faults == {("lacks.csv", "MISSING_COLUMN", "name", None), ("long.csv", "FIELD_TOO_LONG", "name", 1), ("early.csv", "INVALID_PATTERN", "id", 2)}
    (folder / "more.csv").write_text("id,name\n8,eight\n")
    assert gate.run(spark, str(folder), str(tmp_path / "checkpoint"), work) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 25


def database(spark, kind=Database):
    return kind(spark, f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver")


class Killed(Database):
    """A job that ends after its rows are staged and before they are moved."""

    def _move(self, columns, staging, table, token):
        raise InterruptedError(token)


def test_a_batch_is_there_whole_and_once(spark):
    base = database(spark)
    rows = spark.range(100).selectExpr("id", "concat('n', id) as name").repartition(4)
    broken = rows.withColumn("name", F.when(F.col("id") == 63, F.raise_error(F.lit("broken row"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken row"):
        base.write(broken, "people", "job/1")
    assert base.read("people").count() == 0 and not base.committed("job/1")
    with pytest.raises(InterruptedError):
        Killed(spark, base.url, base.driver).write(rows, "people", "job/1")
    assert base.read("people").count() == 0
    assert base.write(rows, "people", "job/1") == 100
    assert base.write(rows, "people", "job/1") == 0  # replayed
    assert base.write(rows.where("id < 5"), "people", "job/2") == 5
    assert base.read("people").count() == 105


def test_other_batches_go_on_and_a_retry_inserts_the_rest(spark):
    base = database(spark)
    rows = spark.range(200).selectExpr("id", "concat('n', id) as name")
    broken = rows.withColumn("name", F.when(F.col("id") == 63, F.raise_error(F.lit("broken row"))).otherwise(F.col("name")))
    first = base.write_batches(broken, "people", "job", "id", 4).collect()
    assert sorted(r["status"] for r in first) == ["FAILED", "OK", "OK", "OK"]
    there = base.read("people")
    assert there.count() == sum(r["rows"] for r in first) < 200 and there.where("id = 63").count() == 0
    again = base.write_batches(rows, "people", "job", "id", 4).collect()
    assert sorted(r["status"] for r in again) == ["OK", "SKIPPED", "SKIPPED", "SKIPPED"]
    assert base.read("people").count() == base.read("people").distinct().count() == 200


def test_steps_are_counted_while_they_are_written(spark, sf, tmp_path):
    """The log of a migration is made without reading what its steps have written."""
    t = Source(spark, sf)
    log = sorted(map(tuple, migration.run(t, str(tmp_path)).collect()))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert log == sorted(map(tuple, migration.step_log(read("raw"), read("errors"), read("valid"), read("facts")).collect()))
