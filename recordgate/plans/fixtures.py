"""Derived views over the given tables, in SQL text that Spark and DuckDB both take.

They give the tables the shapes of a migration (raw staging with faults, dimensions,
facts, job logs); every row comes from the given tables, so work grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {}

VIEWS["stg_case"] = """SELECT CASE WHEN o.o_orderkey % 5 = 4 THEN 'JOB-2' ELSE 'JOB-1' END AS job_id, CAST(o.o_orderkey + 2 AS INT) AS row_num,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 89 = 0 THEN '  '
       ELSE ' wh_' || CAST(c.c_nationkey % 8 AS STRING) || ' ' END AS warehouse,
  CASE WHEN o.o_orderkey % 83 = 0 THEN NULL ELSE 'dv' || lpad(CAST(c.c_nationkey AS STRING), 3, '0') END AS unit_code,
  o.o_orderpriority AS doc_type,
  CASE WHEN o.o_orderkey % 79 = 0 THEN 'not-a-date'
       WHEN o.o_orderkey % 3 = 0 THEN substr(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 9, 2) || '/' || substr(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 6, 2) || '/' || substr(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 1, 4)
       ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS doc_date,
  CASE WHEN o.o_orderkey % 73 = 0 THEN '0' WHEN o.o_orderkey % 71 = 0 THEN '1x'
       ELSE CAST(o.o_orderkey % 4 + 1 AS STRING) END AS quantity,
  CASE WHEN o.o_orderkey % 5 = 0 THEN '' ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS due_date,
  CASE WHEN o.o_orderkey % 7 = 0 THEN '' WHEN o.o_orderkey % 67 = 0 THEN '1990-01-01'
       ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS handover_date,
  'box' || lpad(CAST(o.o_custkey % 40 AS STRING), 4, '0') AS box_code,
  CAST(o.o_orderkey % 6 * 5 + 5 AS STRING) AS retention_years,
  'area_' || CAST(c.c_nationkey % 3 AS STRING) AS area,
  CAST(o.o_custkey % 40 % 5 + 1 AS STRING) AS shelf_row, CAST(o.o_custkey % 40 % 10 + 1 AS STRING) AS shelf_col,
  CASE o.o_orderstatus WHEN 'O' THEN 'in stock' WHEN 'F' THEN NULL ELSE 'moved out' END AS box_status,
  CASE WHEN o.o_orderkey % 101 = 0 THEN 'Conversion error: synthetic' END AS parse_errors
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

VIEWS["stg_contract"] = """SELECT 'JOB-1' AS job_id, 'contract' AS sheet_name, CAST(o.o_orderkey + 1 AS INT) AS row_num,
  'HD' || lpad(CAST(o.o_orderkey % 9000 AS STRING), 6, '0') AS contract_no,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'LD' WHEN 1 THEN 'MD' WHEN 2 THEN 'CC' WHEN 3 THEN 'TSBD'
       WHEN 4 THEN 'TTK' WHEN 5 THEN 'KSSV' WHEN 6 THEN 'HDHM' ELSE 'ZZ' END AS doc_kind,
  'CIF' || lpad(CAST(o.o_custkey AS STRING), 8, '0') AS customer_cif,
  'DV' || lpad(CAST(c.c_nationkey AS STRING), 3, '0') AS unit_code,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS disbursed_on,
  CASE WHEN o.o_orderkey % 2 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS due_on,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'permanent' WHEN 1 THEN 'short' WHEN 2 THEN 'medium' ELSE 'long' END AS retention_class,
  CASE WHEN o.o_orderkey % 2 = 0 AND o.o_orderkey % 37 <> 0 THEN DATE '9999-12-31' ELSE CAST(o.o_orderdate AS DATE) END AS destroy_on,
  c.c_name AS customer_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

VIEWS["m_warehouse"] = """SELECT DISTINCT CAST(n_nationkey % 8 + 1 AS INT) AS id, 'WH_' || CAST(n_nationkey % 8 AS STRING) AS code, (n_nationkey % 8) <> 5 AS is_active FROM nation WHERE n_nationkey % 8 <> 7"""
VIEWS["m_unit"] = """SELECT CAST(n_nationkey + 1 AS INT) AS id, 'DV' || lpad(CAST(n_nationkey AS STRING), 3, '0') AS code, n_name AS name,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'DV' || lpad(CAST(n_nationkey - n_nationkey % 5 AS STRING), 3, '0') END AS parent_code,
  n_nationkey % 11 <> 10 AS is_active FROM nation WHERE n_nationkey % 12 <> 11"""
VIEWS["m_doc_type"] = """SELECT DISTINCT CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) AS INT) AS id, upper(o_orderpriority) AS name, true AS is_active FROM orders WHERE o_orderpriority <> '5-LOW'"""
VIEWS["m_retention"] = """SELECT DISTINCT CAST(n_nationkey % 5 + 1 AS INT) AS id, CAST(n_nationkey % 5 * 5 + 5 AS INT) AS years, n_nationkey % 5 <> 3 AS is_active FROM nation"""
VIEWS["m_location"] = """SELECT DISTINCT CAST(n_nationkey % 3 * 5 + n_nationkey % 5 + 1 AS INT) AS id, 'AREA_' || CAST(n_nationkey % 3 AS STRING) AS area,
  CAST(n_nationkey % 5 + 1 AS STRING) AS shelf_row, CAST(n_nationkey % 5 + 1 AS STRING) AS shelf_col FROM nation"""
VIEWS["m_status"] = """SELECT DISTINCT CAST(1 AS INT) AS id, 'IN_STOCK' AS code, 'BOX' AS kind, 'IN STOCK' AS name FROM region"""
VIEWS["m_box"] = """SELECT DISTINCT CAST(c_custkey % 40 + 1 AS INT) AS id, 'BOX' || lpad(CAST(c_custkey % 40 AS STRING), 4, '0') AS code, c_custkey % 40 % 13 <> 12 AS is_active FROM customer WHERE c_custkey % 40 < 35"""
VIEWS["case_fact"] = """SELECT CAST(o.o_orderkey AS BIGINT) AS id, CAST(c.c_nationkey + 1 AS INT) AS unit_id, CAST(o.o_custkey % 40 + 1 AS INT) AS box_id,
  CAST(o.o_orderdate AS DATE) AS doc_date, CAST(CASE WHEN o.o_orderkey % 31 = 0 THEN 0 ELSE o.o_orderkey % 4 + 1 END AS INT) AS quantity,
  CAST(o.o_orderdate AS DATE) AS due_date, CASE WHEN o.o_orderkey % 67 = 0 THEN DATE '1990-01-01' ELSE CAST(o.o_orderdate AS DATE) END AS handover_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE (o.o_orderkey + 2) % 10 = 0"""

VIEWS["job_sheet_log"] = """SELECT 'J' || CAST(user_id AS STRING) AS job_id, 'S' || CAST(event_id AS STRING) AS sheet_name,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'VALIDATING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'PENDING' END AS status,
  CAST(event_id % 1000 AS BIGINT) AS total_rows, CAST(event_id % 1000 - event_id % 10 AS BIGINT) AS valid_rows, CAST(event_id % 10 AS BIGINT) AS error_rows,
  CAST(event_id % 101 AS DOUBLE) AS progress_percent, ts AS started_at, CAST(event_id % 900 + 1 AS BIGINT) AS duration_ms
FROM events"""
VIEWS["step_log"] = """SELECT 'J' || CAST(user_id AS STRING) AS job_id, CAST(event_id AS BIGINT) AS step_id,
  CASE event_id % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'dates' WHEN 2 THEN 'references' ELSE 'move_valid' END AS step,
  CASE event_id % 7 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'TIMEOUT' ELSE 'COMPLETED' END AS status,
  CAST(event_id % 1800 * 1000 AS BIGINT) AS duration_ms, CAST(event_id % 5000 AS BIGINT) AS affected_rows, ts AS started_at FROM events"""
VIEWS["cell_table"] = """SELECT DISTINCT 'R' || CAST(n_regionkey AS STRING) AS sheet, CAST(1 AS INT) AS row_no, CAST(1 AS INT) AS col, ' N_Key ' AS value FROM nation
UNION ALL SELECT DISTINCT 'R' || CAST(n_regionkey AS STRING), CAST(1 AS INT), CAST(2 AS INT), 'n_name' FROM nation
UNION ALL SELECT DISTINCT 'R' || CAST(n_regionkey AS STRING), CAST(1 AS INT), CAST(3 AS INT), 'Comment' FROM nation
UNION ALL SELECT 'R' || CAST(n_regionkey AS STRING), CAST(n_nationkey + 2 AS INT), CAST(1 AS INT), CAST(n_nationkey AS STRING) FROM nation
UNION ALL SELECT 'R' || CAST(n_regionkey AS STRING), CAST(n_nationkey + 2 AS INT), CAST(2 AS INT), n_name FROM nation
UNION ALL SELECT 'R' || CAST(n_regionkey AS STRING), CAST(n_nationkey + 2 AS INT), CAST(3 AS INT), CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE substr(n_name, 1, 3) END FROM nation"""
VIEWS["messy"] = """SELECT CAST(event_id AS BIGINT) AS id,
  CASE event_id % 16 WHEN 0 THEN ' 12.7 ' WHEN 1 THEN '-12.7' WHEN 2 THEN '12%' WHEN 3 THEN 'yes' WHEN 4 THEN 'OFF' WHEN 5 THEN '2024-02-29'
    WHEN 6 THEN '29/02/2024' WHEN 7 THEN '31/12/2023' WHEN 8 THEN '1.5E+11' WHEN 9 THEN '123456789.0' WHEN 10 THEN '1,234' WHEN 11 THEN '3/7/2021'
    WHEN 12 THEN '' WHEN 13 THEN NULL WHEN 14 THEN 'abc' ELSE CAST(event_id AS STRING) END AS raw,
  CASE event_id % 6 WHEN 0 THEN 'user' || CAST(user_id AS STRING) || '@mail.example' WHEN 1 THEN 'a.b@c.d' WHEN 2 THEN 'no at sign' WHEN 3 THEN NULL WHEN 4 THEN 'x@y.org' ELSE ' pad@mail.org ' END AS email,
  CASE event_id % 5 WHEN 0 THEN '0901 234 567' WHEN 1 THEN '12345' WHEN 2 THEN '(84) 90-123-4567' WHEN 3 THEN NULL ELSE '1234567890123456' END AS phone,
  CAST(event_id % 3000 AS STRING) AS serial, CAST(event_id % 12 + 1 AS STRING) || '/' || CAST(event_id % 28 + 1 AS STRING) || '/' || lpad(CAST(event_id % 100 AS STRING), 2, '0') AS short_date,
  CASE event_id % 4 WHEN 0 THEN 'clickCount' WHEN 1 THEN 'userIdentityCard' WHEN 2 THEN 'x' ELSE 'totalRows' END AS field_name,
  CASE event_id % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'z' ELSE 'AAA' END AS letters,
  CASE event_id % 3 WHEN 0 THEN 'Số Hợp Đồng' WHEN 1 THEN 'Mã đơn vị' ELSE 'Ngày giải ngân' END AS heading,
  event_type FROM events"""
VIEWS["user_role"] = """SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey AS BIGINT) AS role_id FROM orders"""
VIEWS["role_menu"] = """SELECT CAST(l_orderkey AS BIGINT) AS role_id, CAST(l_partkey AS BIGINT) AS menu_id FROM lineitem"""



def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or one of the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    # Tables go in by name as arguments of the statement, so no view of the session is touched.
    for table in used:
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """DuckDB text: sql with the views it needs before it."""
    known = VIEWS | (more or {})
    names = re.compile(r"\b(" + "|".join(known) + r")\b")
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in dict.fromkeys(names.findall(text)):
            if name not in needed:
                needed[name] = ""  # keeps a view from visiting itself
                visit(known[name])
                needed.pop(name)
                needed[name] = known[name]

    visit(sql)
    if not needed:
        return sql
    own = sql.removeprefix("WITH ")
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in needed.items()) + (", " if own != sql else "\n") + own
