"""A migration from end to end: ingest, check, part, apply, reconcile, and a log of its own steps.

Each step is written once and read by the next, and rows are counted while they are written: what a step
leaves is never read again for the log.  All jobs of a batch go through together, as partitions by job.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import sinks
from . import set_queries, staging  # noqa: F401  the views of set_queries are named in the twins
from .file_queries import scratch
from .registry import Source, query

#: Steps in their order; a step is complete if what it leaves adds up to what it was given.
STEPS = ("ingest", "read_errors", "row_errors", "valid", "facts")


def jobs_of(staged: DataFrame) -> list[str]:
    """Jobs of a batch, of which there are few."""
    return sorted(r[0] for r in staged.select("job_id").distinct().collect())


class _Counted:
    """Rows by job of what is written."""

    def __init__(self, jobs: list[str]):
        self.jobs, self.seen = jobs, Observation()

    def watch(self, df: DataFrame, condition: Column | None = None) -> DataFrame:
        """df with its rows (of the condition) counted as it is written."""
        holds = F.lit(True) if condition is None else condition
        return df.observe(self.seen, *[F.count_if((F.col("job_id") == job) & holds).alias(f"n{k}") for k, job in enumerate(self.jobs)])

    def rows(self) -> list[int]:
        got = self.seen.get
        return [got[f"n{k}"] for k in range(len(self.jobs))]


def run(t: Source, folder: str, sheet: str = "case") -> DataFrame:
    """Run the jobs in t.stg_case and store what comes of them in folder; gives the log: job_id, step, rows, status.

    folder gets raw (by job and sheet), checked (every row with its first error, or none), errors, valid and facts.
    A job whose parts do not add up to its rows is logged as FAILED at the step where they part.
    """
    spark, at = t.spark, lambda name: f"{folder}/{name}"
    jobs = jobs_of(t.stg_case)
    counted = {name: _Counted(jobs) for name in STEPS}
    raw = counted["ingest"].watch(t.stg_case.withColumn("sheet_name", F.lit(sheet)))
    sinks.append_staging(counted["read_errors"].watch(raw, F.col("parse_errors").isNotNull()), at("raw"))
    raw = spark.read.schema(raw.schema).parquet(at("raw"))
    checked = staging.checked(raw, t.m_warehouse, t.m_unit, t.m_doc_type, t.m_retention, staging.resolved_facts(t))
    checked.write.partitionBy("job_id").parquet(at("checked"))
    checked = spark.read.schema(checked.schema).parquet(at("checked"))
    errors = checked.where("error_type is not null").select("job_id", "row_num", "error_type", "error_field")
    counted["row_errors"].watch(errors).write.partitionBy("job_id").parquet(at("errors"))
    valid = staging.valid_rows(checked)
    counted["valid"].watch(valid).write.partitionBy("job_id").parquet(at("valid"))
    facts = staging.applied_facts(spark.read.schema(valid.schema).parquet(at("valid")), t)
    counted["facts"].watch(facts).write.partitionBy("job_id").parquet(at("facts"))
    rows = zip(jobs, *[counted[s].rows() for s in STEPS], strict=True)
    log = logged(spark.createDataFrame(list(rows), "job_id string, " + ", ".join(f"{s} long" for s in STEPS)))
    log.write.parquet(at("log"))
    return spark.read.schema(log.schema).parquet(at("log"))


def logged(by_job: DataFrame) -> DataFrame:
    """job_id and the rows of each step -> a row for each step, FAILED where parts do not add up."""
    parted = F.col("read_errors") + F.col("row_errors") + F.col("valid") == F.col("ingest")
    good = {"ingest": F.lit(True), "read_errors": F.lit(True), "row_errors": parted, "valid": parted, "facts": parted & (F.col("facts") <= F.col("valid"))}
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("rows"), F.when(good[s], "COMPLETED").otherwise("FAILED").alias("status")) for s in STEPS])
    return by_job.select("job_id", F.explode(steps).alias("s")).select("job_id", "s.*")


def step_log(raw: DataFrame, errors: DataFrame, valid: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of each step of each job, from what the steps left: for tables that were changed since they were written."""
    parts = zip(STEPS, (raw, raw.where("parse_errors is not null"), errors, valid, facts), strict=True)
    counted = [df.groupBy("job_id").agg(F.count("*").alias("rows")).withColumn("step", F.lit(name)) for name, df in parts]
    by_job = functools.reduce(DataFrame.unionByName, counted).groupBy("job_id").pivot("step", list(STEPS)).agg(F.sum("rows")).na.fill(0, list(STEPS))
    return logged(by_job)


_LOG = """SELECT job_id, step, CAST(n AS BIGINT) AS rows, 'COMPLETED' AS status FROM (
  SELECT job_id, 'ingest' AS step, count(*) AS n FROM stg_case GROUP BY job_id
  UNION ALL SELECT job_id, 'read_errors', count(parse_errors) FROM stg_case GROUP BY job_id
  UNION ALL SELECT job_id, 'row_errors', count(error_type) FROM case_checked GROUP BY job_id
  UNION ALL SELECT job_id, 'valid', count(*) FROM case_valid GROUP BY job_id
  UNION ALL SELECT job_id, 'facts', count(*) FROM case_applied JOIN case_valid USING (row_num) GROUP BY job_id)"""


@query("RUN01", _LOG)
def run01(t):
    return run(t, scratch(t, "run01"))


@query("RUN02", "SELECT job_id, step, rows, status FROM (" + _LOG + ") WHERE job_id <> 'JOB-2'")
def run02(t):
    """The same, then one job is cleared out: the other's rows and files stay as they are."""
    folder = scratch(t, "run02")
    run(t, folder)
    for name in ("raw", "checked", "errors", "valid", "facts"):
        sinks.drop_job(f"{folder}/{name}", t.spark.read.parquet(f"{folder}/{name}"), "JOB-2")
    return step_log(*(t.spark.read.parquet(f"{folder}/{name}") for name in ("raw", "errors", "valid", "facts")))
