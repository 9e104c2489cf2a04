"""What lasts from batch to batch: state of streams, commits, indexes of keys; also after stops and kills."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordgate.operators.keyindex import KeyIndex
from recordgate.plans.batch_queries import _Stopped
from recordgate.sources.ledger import Ledger
from recordgate.streaming import stream, unique


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, n long")


def test_a_stream_knows_keys_after_a_stop(spark, tmp_path):
    folder = str(tmp_path)
    batches = [
        [(1, "a", 1), (2, "a", 2), (3, None, 3), (4, "b", 4), (5, "b", 0)],
        [(6, "a", 0), (7, "c", None), (8, "c", 9), (9, None, 1), (10, None, 1)],
        [(11, "c", 0), (12, "d", 1), (12, "d", 1)],
    ]
    taken = []
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = stream.files(spark, f"{folder}/in", events(spark, []).schema, files_per_batch=100)
        progress = unique.write_marked(unique.marked(source, ["k"], "n"), f"{folder}/out", f"{folder}/checkpoint")
        taken.append(sum(p["numInputRows"] for p in progress))
    # Rows with and without a whole key are two branches that read the batch, and never rows of another.
    assert all(len(rows) <= n <= 2 * len(rows) for n, rows in zip(taken, batches, strict=True))
    got = sorted((r["id"], r["accepted"]) for r in unique.read_marked(spark, f"{folder}/out").collect())
    assert got == sorted([(1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, False), (8, True), (9, True), (10, True), (11, False), (12, False), (12, True)])


def test_rows_that_cannot_be_accepted_do_not_go_to_the_state(spark, tmp_path, monkeypatch):
    """A key's repeats in a batch come out marked, whole and unchanged, though the state is asked for few rows."""
    folder = str(tmp_path)
    big = 1 << 60  # no float holds the ids
    rows = spark.range(20_000, numPartitions=2).select((F.col("id") + big).alias("id"), (F.col("id") % 7).cast("string").alias("k"), F.when(F.col("id") % 3 > 0, -F.col("id")).alias("n"), F.current_timestamp().alias("at"))
    rows = rows.unionByName(rows.limit(5).withColumn("k", F.lit(None).cast("string")))
    rows.write.parquet(f"{folder}/in")
    source = stream.files(spark, f"{folder}/in", rows.schema, files_per_batch=100)

    class Few(unique.FirstOfKey):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            if len(rows) > 100:
                raise ValueError(f"{len(rows)} rows of a key")
            return super().handleInputRows(key, iter(rows), timerValues)

    monkeypatch.setattr(unique, "FirstOfKey", Few)
    unique.write_marked(unique.marked(source, ["k"], "n"), f"{folder}/out", f"{folder}/checkpoint")
    got, there = unique.read_marked(spark, f"{folder}/out"), spark.read.parquet(f"{folder}/in")
    assert got.drop("accepted").exceptAll(there).isEmpty() and there.exceptAll(got.drop("accepted")).isEmpty()
    best = there.where("k is not null").groupBy("k").agg(F.min("n").alias("n"))
    assert sorted(map(tuple, got.where("accepted and k is not null").select("k", "n").collect())) == sorted(map(tuple, best.collect()))
    assert got.where("accepted and k is null").count() == 5


def test_of_a_batch_the_least_row_of_each_key_is_left():
    batch = pa.RecordBatch.from_pydict({"k": ["a", "b", "a", "b", "c"], "m": [1, 1, 1, 2, None], "n": [None, 2, 5, 1, None]})
    assert unique.least_of_keys(batch, ["k"], "n").to_pylist() == [False, False, True, True, True]
    assert unique.least_of_keys(batch.slice(0, 4), ["k", "m"], "n").to_pylist() == [False, True, True, True]
    nested = pa.RecordBatch.from_pydict({"k": [{"x": 1}, {"x": 1}], "n": [1, 2]})
    assert unique.least_of_keys(nested, ["k"], "n").to_pylist() == [True, True]


def ledger_rows(ledger):
    found = ledger.rows()
    return [] if found is None else sorted(map(tuple, found.select("id", "k", "n").collect()))


def test_a_commit_counts_when_the_ledger_names_it(spark, tmp_path):
    args = (spark, str(tmp_path / "t"), ("k",), 4)
    ledger, stopped = Ledger(*args), _Stopped(*args)
    assert ledger_rows(ledger) == []
    assert ledger.write(events(spark, [(1, "a", 2), (2, "a", 1), (3, None, 5), (4, None, 6)]), "j", 0, "n") == 2
    assert ledger_rows(ledger) == [(2, "a", 1), (3, None, 5)]
    with pytest.raises(InterruptedError):
        stopped.write(events(spark, [(5, "a", 1), (6, "x", 1), (7, "y", 1)]), "j", 1, "n")
    assert {r[1] for r in map(tuple, ledger.rows().select("id", "k").collect())} == {"a", None}
    # The next try has other rows: what the killed one left goes.
    assert ledger.write(events(spark, [(6, "x", 1), (8, "z", 1)]), "j", 1, "n") == 2
    assert ledger.write(events(spark, [(9, "w", 1)]), "j", 1, "n") == 0  # committed before
    assert ledger.write(events(spark, [(6, "x", 1), (10, "z", 9), (11, None, 1)]), "other", 1, "n") == 0
    assert {r["k"] for r in ledger.rows().collect()} == {"a", None, "x", "z"}
    assert ledger.rows().count() == 4
    assert {(r["job"], r["batch"], r["rows"]) for r in ledger.commits().collect()} == {("j", 0, 2), ("j", 1, 2), ("other", 1, 0)}


def test_only_touched_buckets_are_read(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"), ("k",), 16)
    ledger.write(events(spark, [(i, f"k{i}", i) for i in range(400)]), "j", 0)
    batch = events(spark, [(1000, "k7", 1)])
    touched = ledger.touched(batch)
    assert len(touched) == 1
    plan = ledger._committed(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and re.search(r"bucket#\d+ = ", plan)
    one, whole = ledger._committed(touched), ledger._committed()
    assert 0 < len(one.inputFiles()) and one.count() < whole.count() / 4


def index(spark, tmp_path, name, expected=2000):
    return KeyIndex(spark, f"{name}_{tmp_path.name.replace('-', '_')}", str(tmp_path / name), ("k", "n"), expected=expected, buckets=4)


def test_index_is_exact_and_its_filter_loses_nothing(spark, tmp_path):
    made = index(spark, tmp_path, "exact")
    made.add(events(spark, [(i, f"k{i}", i % 7) for i in range(1500)]))
    made.add(events(spark, [(i, f"k{i}", i % 7) for i in range(1400, 2000)] + [(1, None, 1), (2, "k", None)]))
    batch = events(spark, [(i, f"k{i}", i % 7 + (i % 5 == 0)) for i in range(4000)] + [(9001, None, 1), (9002, "k", None), (9003, "k1", 1), (9003, "k1", 1)])
    there = {i for i in range(2000) if i % 5}
    assert sorted(r["id"] for r in made.existing(batch).collect()) == sorted([*there, 9003, 9003])
    assert sorted(r["id"] for r in made.fresh(batch).collect()) == sorted([*({*range(4000)} - there), 9001, 9002])
    passed = {r["id"] for r in made.possible(batch).collect()}
    assert there <= passed
    assert len(passed - there) < 0.05 * 2400


def test_indexes_are_merged_and_attached(spark, tmp_path):
    one, other = index(spark, tmp_path, "one"), index(spark, tmp_path, "other")
    one.add(events(spark, [(i, f"k{i}", 0) for i in range(100)]))
    other.add(events(spark, [(i, f"k{i}", 0) for i in range(50, 200)]))
    one.merge(other)
    batch = events(spark, [(i, f"k{i}", 0) for i in range(400)])
    assert sorted(r["id"] for r in one.existing(batch).collect()) == list(range(200))
    for table in (one.keys_table, one.filter_table):
        spark.sql(f"DROP TABLE {table}")
    one.attach()
    assert sorted(r["id"] for r in one.existing(batch).collect()) == list(range(200))
    with pytest.raises(ValueError, match="one size"):
        one.merge(index(spark, tmp_path, "large", 10**9))


def test_keys_are_not_dealt_anew(spark, tmp_path):
    """The only exchanges of a batch's join are of the batch: keys and filter stay in their buckets."""
    made = index(spark, tmp_path, "plan")
    made.add(events(spark, [(i, f"k{i}", 0) for i in range(100)]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = events(spark, [(1, "k1", 0)]).where(F.col("id") > 0)
        plan = made.existing(batch)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2
        assert plan.count("Exchange hashpartitioning") == 2
        for scan in re.findall(r"FileScan parquet [^\n]*", plan):
            assert "Bucketed: true" in scan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
