"""Several sheets of a job in one run: a registry of sheets, each with its own columns and rule groups.

All sheets make one plan: each is checked by its own rules, then they are united under a sheet's name and written
once, by sheet.  Errors are one long table, valid rows go to each sheet's target, and all counts are
observed while rows are written, so nothing is read again to be counted.  A sheet that can't be checked or
has more errors than it may is FAILED and gives no rows; the others go on.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import rules
from .refs import with_presence
from .rulefile import Duplicate, Group, Reference

RESULTS = "job_id string, sheet_name string, place int, status string, message string, ingested long, valid long, errors long, inserted long"


@dataclass(frozen=True)
class Sheet:
    """name: of the sheet in the input; groups: names of rule groups; target: where valid rows go; most_errors: error rows it may have."""

    name: str
    order: int
    groups: tuple[str, ...]
    target: str
    enabled: bool = True
    most_errors: int = 10_000


@dataclass(frozen=True)
class RuleSet:
    """What the groups of one sheet ask for."""

    row: tuple[rules.Rule, ...]
    duplicates: tuple[Duplicate, ...]
    references: tuple[Reference, ...]


def chosen(registry: list[Sheet], present) -> list[Sheet]:
    """Enabled sheets that the input has, in their order."""
    return sorted((s for s in registry if s.enabled and s.name in present), key=lambda s: (s.order, s.name))


def rule_set(sheet: Sheet, groups: dict[str, Group], columns: list[str]) -> RuleSet:
    """Enabled groups of a sheet on its columns; a group or a field that is not there is a fault of the sheet."""
    lacking = [g for g in sheet.groups if g not in groups]
    own = [groups[g] for g in sheet.groups if g in groups and groups[g].enabled]
    unknown = sorted({f for g in own for f in g.fields} - set(columns))
    if lacking or unknown:
        raise LookupError("; ".join([*(f"no rule group {g}" for g in lacking), *(f"no column {f}" for f in unknown)]))
    return RuleSet(
        tuple(r(F.col) for g in own for r in g.row), tuple(d for g in own for d in g.duplicates), tuple(r for g in own for r in g.references)
    )


def _repeat_key(duplicates: tuple[Duplicate, ...], row: str) -> Column:
    """What a row must not share with an earlier one: the key of the first condition that holds; its own number if none does."""
    parts = lambda d, k: F.array(F.lit(str(k)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in d.key])
    none = F.array(F.lit("-"), F.col(row).cast("string"))
    return F.coalesce(*[F.when(d.condition.column(F.col), parts(d, k)) for k, d in enumerate(duplicates)], none)


def checked(rows: DataFrame, made: RuleSet, masters: dict[str, DataFrame], row: str = "row_num") -> DataFrame:
    """rows + errors: all errors of each row, by priority, then repeats (the first row of a key is none), then unknown references."""
    found = [rules.error_list(list(made.row))]
    if made.duplicates:
        rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(_repeat_key(made.duplicates, row)).orderBy(row)))
        repeat = rules.Rule("repeat", F.col("__place") > 1, "DUP_IN_FILE", "business_key", None, "an earlier row has the same key", "VAL008")
        found.append(rules.error_list([repeat]))
    for k, r in enumerate(made.references):
        known = masters[r.table].where(r.condition.column(F.col))
        rows = with_presence(rows, known, F.col(r.field).cast("string"), r.column, f"__known{k}")
        lacks = ~rules.is_blank(F.col(r.field)) & ~F.col(f"__known{k}")
        found.append(rules.error_list([rules.Rule("reference", lacks, "REF_NOT_FOUND", r.field, F.col(r.field), f"{r.field} is not in {r.table}", "VAL009")]))
    columns = [c for c in rows.columns if not c.startswith("__")]
    return rows.select(*columns, F.concat(*found).alias("errors"))


def _plans(spark: SparkSession, sheets: list[Sheet], inputs: dict[str, DataFrame], groups: dict[str, Group], masters: dict[str, DataFrame]):
    """(sheet, checked rows or None, message) each."""
    for sheet in sheets:
        try:
            df = inputs[sheet.name]
            plan = checked(df, rule_set(sheet, groups, df.columns), masters)
            plan.schema  # noqa: B018  a fault of the plan shows here
            yield sheet, plan, None
        except (LookupError, AnalysisException) as fault:
            yield sheet, None, str(fault).strip("'\"").splitlines()[0]


def run(job_id: str, registry: list[Sheet], inputs: dict[str, DataFrame], groups: dict[str, Group], masters: dict[str, DataFrame], folder: str) -> DataFrame:
    """Run a job's sheets; gives RESULTS, a row for each sheet taken.

    inputs: rows (row_num, ...) by sheet.  folder gets checked (by sheet, each row with its errors), errors (long, of all sheets),
    a table for each target, and results.  Sheets that are switched off, or that the registry does not know, are skipped.
    """
    spark = next(iter(inputs.values())).sparkSession if inputs else SparkSession.getActiveSession()
    plans = list(_plans(spark, chosen(registry, inputs), inputs, groups, masters))
    good = [(s, p) for s, p, _ in plans if p is not None]
    counts: dict = {}
    if good:
        # One plan for all sheets; the rows of each keep their own columns, which the others lack, in a struct under the sheet's number.
        tagged = [p.select(F.lit(s.name).alias("sheet_name"), "row_num", "errors", F.struct(*[c for c in p.columns if c != "errors"]).alias(f"s{k}")) for k, (s, p) in enumerate(good)]
        united = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        seen = Observation()
        of = lambda s, more=True: F.count_if((F.col("sheet_name") == s.name) & more)
        measures = [m for k, (s, _) in enumerate(good) for m in (of(s).alias(f"rows{k}"), of(s, F.size("errors") == 0).alias(f"valid{k}"))]
        united.observe(seen, *measures).write.partitionBy("sheet_name").parquet(f"{folder}/checked")
        counts = {s.name: (seen.get[f"rows{k}"], seen.get[f"valid{k}"]) for k, (s, _) in enumerate(good)}
        written = spark.read.schema(united.schema).parquet(f"{folder}/checked")
        long = rules.long_errors(written.where(F.size("errors") > 0).withColumn("job_id", F.lit(job_id)), F.col("errors"), "job_id", "sheet_name", "row_num")
        long.write.partitionBy("sheet_name").parquet(f"{folder}/errors")
    results = []
    for place, (sheet, plan, message) in enumerate(plans, 1):
        rows, valid = counts.get(sheet.name, (0, 0))
        inserted = 0
        if plan is not None and rows - valid > sheet.most_errors:
            message = f"more than {sheet.most_errors} rows with errors"
        elif plan is not None and valid:
            inserted = _insert(written, sheet, [s.name for s, _ in good].index(sheet.name), job_id, folder)
        results.append((job_id, sheet.name, place, "FAILED" if message else "COMPLETED", message, rows, valid, rows - valid, inserted))
    spark.createDataFrame(results, RESULTS).write.mode("append").parquet(f"{folder}/results")
    return spark.read.schema(RESULTS).parquet(f"{folder}/results").where(F.col("job_id") == job_id)


def _insert(written: DataFrame, sheet: Sheet, k: int, job_id: str, folder: str) -> int:
    """Valid rows of a sheet to its target, under the job and the sheet, so that a second run of the job replaces its own rows."""
    seen = Observation()
    rows = written.where((F.col("sheet_name") == sheet.name) & (F.size("errors") == 0)).select(f"s{k}.*")
    rows = rows.withColumns({"job_id": F.lit(job_id), "sheet_name": F.lit(sheet.name)}).observe(seen, F.count("*").alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", "sheet_name").parquet(f"{folder}/{sheet.target}")
    return seen.get["n"]


def roll_up(results: DataFrame) -> DataFrame:
    """Sheets, successes, failures and row sums of each job."""
    done = F.count_if(F.col("status") == "COMPLETED")
    sums = [F.sum(c).alias(f"total_{c}") for c in ("ingested", "valid", "errors", "inserted")]
    rate = F.round(done * 100.0 / F.count("*"), 6).alias("success_rate")
    return results.groupBy("job_id").agg(F.count("*").alias("sheets"), done.alias("successes"), F.count_if(F.col("status") == "FAILED").alias("failures"), *sums, rate)
