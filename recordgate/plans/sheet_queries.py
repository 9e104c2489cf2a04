"""Queries of a job with several sheets, checked by rules from a file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ..operators import rulefile, rules, sheets
from ..operators.sheets import Sheet
from .file_queries import scratch
from .registry import TWIN_VIEWS, Source, query

RULE_FILE = Path(__file__).parent / "rules" / "sheets.yml"
rulefile.VALIDATORS.update(
    permanent_never_destroyed=lambda of: (of("retention_class") == "permanent") & (F.year(of("destroy_on")) != 9999),
    balance_not_negative=lambda of: of("c_acctbal") < 0,
)

_CONTRACT = ("contract_required", "contract_enums", "contract_business", "contract_duplicates", "contract_masters")
REGISTRY = [
    Sheet("customer", 3, ("customer_required", "customer_enums", "customer_business"), "t_customer", most_errors=10**9),
    Sheet("contract", 1, _CONTRACT, "t_contract", most_errors=10**9),
    Sheet("case", 2, ("case_required", "case_dates", "case_business", "case_off"), "t_case", most_errors=10**9),
    Sheet("broken", 4, ("no_such_group",), "t_none"),
    Sheet("strict", 5, ("case_required", "case_dates"), "t_case", most_errors=3),
    Sheet("off", 6, ("case_required",), "t_none", enabled=False),
    Sheet("absent", 7, ("case_required",), "t_none"),
]


def groups() -> dict[str, rulefile.Group]:
    return rulefile.parse(RULE_FILE.read_text(encoding="utf-8"))


def run_sheets(t: Source, folder: str):
    inputs = {
        "contract": t.stg_contract, "case": t.stg_case, "customer": t.customer.withColumn("row_num", F.col("c_custkey") + 1),
        "broken": t.stg_case, "strict": t.stg_case, "off": t.stg_case, "unknown": t.stg_case,
    }
    return sheets.run("JOB-S", REGISTRY, inputs, groups(), {"m_unit": t.m_unit.withColumn("is_active", F.col("is_active").cast("string"))}, folder)


_BAD_DATE = "(trim(doc_date) <> '' AND (NOT regexp_full_match(trim(doc_date), '\\d{4}-\\d{2}-\\d{2}') OR TRY_CAST(trim(doc_date) AS DATE) IS NULL))"
_BLANK = "({0} IS NULL OR trim({0}) = '')"
_LAWS = {
    "contract": [
        ("contract_no IS NULL", "REQUIRED_MISSING", "contract_no"), ("unit_code IS NULL", "REQUIRED_MISSING", "unit_code"), ("disbursed_on IS NULL", "REQUIRED_MISSING", "disbursed_on"),
        ("doc_kind = 'ZZ'", "INVALID_ENUM", "doc_kind"), ("NOT regexp_full_match(contract_no, 'HD0[0-9]+')", "INVALID_PATTERN", "contract_no"),
        ("retention_class = 'permanent' AND year(destroy_on) <> 9999", "BUSINESS_RULE", "destroy_on"), ("place > 1", "DUP_IN_FILE", "business_key"),
        ("unit_code NOT IN (SELECT code FROM m_unit WHERE is_active)", "REF_NOT_FOUND", "unit_code"),
    ],
    "case": [
        (_BLANK.format("warehouse"), "REQUIRED_MISSING", "warehouse"), (_BLANK.format("unit_code"), "REQUIRED_MISSING", "unit_code"), (_BAD_DATE, "INVALID_DATE", "doc_date"),
        ("NOT regexp_full_match(quantity, '[1-9]\\d*')", "INVALID_NUMERIC", "quantity"),
    ],
    "customer": [("c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')", "INVALID_ENUM", "c_mktsegment"), ("c_acctbal < 0", "BUSINESS_RULE", "c_acctbal")],
}
_LAWS["strict"] = _LAWS["case"][:3]
_TABLES = {
    "contract": """(SELECT *, row_number() OVER (PARTITION BY CASE WHEN doc_kind IN ('LD', 'MD', 'HDHM', 'KSSV') THEN concat_ws('/', '1', customer_cif, doc_kind)
      WHEN doc_kind IN ('CC', 'TSBD') THEN concat_ws('/', '2', customer_cif, doc_kind, unit_code)
      WHEN doc_kind = 'TTK' THEN concat_ws('/', '3', customer_cif, doc_kind, unit_code, coalesce(CAST(disbursed_on AS VARCHAR), '-')) ELSE CAST(row_num AS VARCHAR) END ORDER BY row_num) AS place FROM stg_contract)""",
    "case": "stg_case", "strict": "stg_case", "customer": "(SELECT *, c_custkey + 1 AS row_num FROM customer)",
}
TWIN_VIEWS["sheet_errors"] = " UNION ALL ".join(
    f"SELECT '{s}' AS sheet_name, row_num, '{kind}' AS error_type, '{field}' AS error_field FROM {_TABLES[s]} WHERE {bad}" for s, laws in _LAWS.items() for bad, kind, field in laws
)
TWIN_VIEWS["sheet_counts"] = " UNION ALL ".join(
    f"SELECT '{s}' AS sheet_name, (SELECT count(*) FROM {table}) AS ingested, (SELECT count(DISTINCT row_num) FROM sheet_errors WHERE sheet_name = '{s}') AS errors" for s, table in _TABLES.items()
)
TWIN_VIEWS["sheet_results"] = """SELECT sheet_name, CASE sheet_name WHEN 'strict' THEN 'FAILED' ELSE 'COMPLETED' END AS status, ingested, ingested - errors AS valid, errors,
  CASE sheet_name WHEN 'strict' THEN 0 ELSE ingested - errors END AS inserted FROM sheet_counts UNION ALL SELECT 'broken', 'FAILED', 0, 0, 0, 0"""


@query("RUN03", """SELECT sheet_name, status, CAST(ingested AS BIGINT) AS ingested, CAST(valid AS BIGINT) AS valid, CAST(errors AS BIGINT) AS errors, CAST(inserted AS BIGINT) AS inserted FROM sheet_results""")
def run03(t):
    """Three sheets that pass, one with an unknown rule group and one with too many errors; a fourth is off, a fifth absent, a sixth not known."""
    return run_sheets(t, scratch(t, "run03")).select("sheet_name", "status", "ingested", "valid", "errors", "inserted")


@query("RUN04", """SELECT sheet_name, error_type, error_field, CAST(count(*) AS BIGINT) AS n FROM sheet_errors GROUP BY ALL""")
def run04(t):
    """Errors of all sheets of the run in one table, counted."""
    folder = scratch(t, "run04")
    run_sheets(t, folder)
    return t.spark.read.parquet(f"{folder}/errors").groupBy("sheet_name", "error_type", "error_field").agg(F.count("*").alias("n"))


@query("RUN05", """SELECT 'JOB-S' AS job_id, CAST(count(*) AS BIGINT) AS sheets, CAST(count(*) FILTER (status = 'COMPLETED') AS BIGINT) AS successes, CAST(count(*) FILTER (status = 'FAILED') AS BIGINT) AS failures,
  CAST(sum(ingested) AS BIGINT) AS total_ingested, CAST(sum(valid) AS BIGINT) AS total_valid, CAST(sum(errors) AS BIGINT) AS total_errors, CAST(sum(inserted) AS BIGINT) AS total_inserted,
  round(count(*) FILTER (status = 'COMPLETED') * 100.0 / count(*), 6) AS success_rate FROM sheet_results""")
def run05(t):
    return sheets.roll_up(run_sheets(t, scratch(t, "run05")))


@query("VAL36", "SELECT row_num, CAST(count(*) AS BIGINT) AS n FROM sheet_errors WHERE sheet_name = 'contract' AND error_type NOT IN ('DUP_IN_FILE', 'REF_NOT_FOUND') GROUP BY row_num")
def val36(t):
    """Row rules of one sheet as the file has them."""
    made = sheets.rule_set(REGISTRY[1], groups(), t.stg_contract.columns)
    return rules.long_errors(t.stg_contract, rules.error_list(list(made.row)), "row_num").groupBy("row_num").agg(F.count("*").alias("n"))
