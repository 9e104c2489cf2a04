"""Queries of sources in table form, joins, aggregations, windows, sorts, sets, apply, reconcile and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import apply, contract, dedupe, graph, refs, report
from . import staging
from .registry import TWIN_VIEWS, query

# Sources in table form

def _sheets(t):
    """Raw rows of two sheets with different columns, by name."""
    return {
        "case": t.stg_case.select("job_id", "row_num", F.upper("unit_code").alias("unit_code"), "box_code"),
        "contract": t.stg_contract.select("job_id", "row_num", "unit_code", "contract_no"),
    }


_BOTH = """SELECT 'case' AS sheet_name, job_id, row_num, upper(unit_code) AS unit_code, box_code, CAST(NULL AS VARCHAR) AS contract_no FROM stg_case
UNION ALL SELECT 'contract', job_id, row_num, unit_code, NULL, contract_no FROM stg_contract"""
TWIN_VIEWS["both_sheets"] = _BOTH


def both_sheets(t):
    frames = [df.withColumn("sheet_name", F.lit(name)) for name, df in _sheets(t).items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


@query("SRC07", "SELECT * FROM both_sheets")
def src07(t):
    return both_sheets(t)


@query("SRC08", "SELECT sheet_name, row_num FROM both_sheets WHERE sheet_name IN ('contract', 'other')")
def src08(t):
    return both_sheets(t).where(F.col("sheet_name").isin("contract", "other")).select("sheet_name", "row_num")


@query("SRC09", "SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS sheet, CAST(5 - r_regionkey AS INT) AS place FROM region WHERE r_regionkey <> 3 AND 'R' || CAST(r_regionkey AS VARCHAR) IN (SELECT sheet FROM cell_table)")
def src09(t):
    registry = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("sheet"), (F.col("r_regionkey") != 3).alias("enabled"), (5 - F.col("r_regionkey")).cast("int").alias("place"))
    present = t.cell_table.select("sheet").distinct()
    return registry.where("enabled").join(present, "sheet", "left_semi").orderBy("place", "sheet").select("sheet", "place")


@query("SRC10", """SELECT sheet, row_no, max(value) FILTER (col = 1) AS n_key, max(value) FILTER (col = 2) AS n_name, max(value) FILTER (col = 3) AS comment FROM cell_table WHERE row_no > 1 GROUP BY sheet, row_no""")
def src10(t):
    return contract.rows_from_cells(t.cell_table, ["N_Key", "n_name", "comment"])


@query("SRC11", "SELECT sheet, row_no, col, value FROM cell_table WHERE row_no > 3")
def src11(t):
    return t.cell_table.where("row_no > 3").select("sheet", "row_no", "col", "value")


@query("SRC12", "SELECT row_num FROM stg_case WHERE coalesce(nullif(trim(due_date), ''), nullif(trim(handover_date), '')) IS NOT NULL")
def src12(t):
    given = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("due_date", "handover_date")]
    return t.stg_case.where(F.coalesce(*given).isNotNull()).select("row_num")


@query("SRC15", "SELECT row_num, parse_errors IS NULL AS good FROM stg_case WHERE job_id = 'JOB-1'")
def src15(t):
    return t.stg_case.where("job_id = 'JOB-1'").orderBy("row_num").select("row_num", F.col("parse_errors").isNull().alias("good"))


@query("SNK07", "SELECT row_num, unit_code, error_type, error_field FROM case_checked WHERE error_type IS NOT NULL")
def snk07(t):
    return staging.checked_case(t).where("error_type is not null").orderBy("row_num").select("row_num", "unit_code", "error_type", "error_field")


@query("SNK08", "SELECT job_id, sheet_name FROM job_sheet_log WHERE job_id <> 'J7' OR status = 'FAILED'")
def snk08(t):
    return t.job_sheet_log.where("job_id <> 'J7' or status = 'FAILED'").select("job_id", "sheet_name")


# Joins

@query("JON01", "SELECT row_num FROM case_norm n WHERE NOT EXISTS (SELECT 1 FROM case_row_error e WHERE e.row_error IS NOT NULL AND e.job_id = n.job_id AND e.row_num = n.row_num)")
def jon01(t):
    rows = staging.accepted(t.stg_case)
    from ..operators import rules

    errors = rules.long_errors(rows, rules.error_list(staging.row_rules()), "job_id", "row_num").select("job_id", "row_num").distinct()
    return refs.not_in(rows, errors, ["job_id", "row_num"]).select("row_num")


@query("JON02", "SELECT c.row_num FROM stg_contract c LEFT JOIN (SELECT job_id, sheet_name, row_num FROM stg_contract WHERE disbursed_on IS NULL) e USING (job_id, sheet_name, row_num) WHERE c.disbursed_on IS NOT NULL")
def jon02(t):
    ids = ["job_id", "sheet_name", "row_num"]
    return refs.not_in(t.stg_contract, t.stg_contract.where("disbursed_on is null"), ids).select("row_num")


def missing_reference(name: str, column: str, master: str, master_key: str, key=None, sql_key: str | None = None):
    sql = f"SELECT row_num, {column} FROM case_norm n WHERE {sql_key or column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {master} m WHERE m.is_active AND m.{master_key} = {sql_key or column})"

    def f(t):
        rows = staging.accepted(t.stg_case)
        return refs.unresolved(rows, refs.active(getattr(t, master)), key() if key else F.col(column), master_key).select("row_num", column)

    query(name, sql)(f)


missing_reference("JON03", "warehouse", "m_warehouse", "code")
missing_reference("JON04", "unit_code", "m_unit", "code")
missing_reference("JON05", "doc_type", "m_doc_type", "name")
missing_reference("JON06", "retention_years", "m_retention", "years", lambda: F.col("retention_years").try_cast("int"), "TRY_CAST(retention_years AS INT)")


@query("JON07", "SELECT row_num FROM stg_contract WHERE unit_code IN (SELECT DISTINCT unit_code FROM stg_contract WHERE unit_code NOT IN (SELECT code FROM m_unit WHERE is_active))")
def jon07(t):
    keys_ = refs.unresolved_keys(t.stg_contract, refs.active(t.m_unit), "unit_code", "code")
    return t.stg_contract.join(keys_, "unit_code", "left_semi").select("row_num")


@query("JON08", """SELECT row_num FROM case_norm n WHERE EXISTS (SELECT 1 FROM fact_codes k WHERE k.unit_code = n.unit_code AND k.box_code = n.box_code
  AND k.doc_date = TRY_CAST(n.doc_date AS DATE) AND k.quantity = TRY_CAST(n.quantity AS INT))""")
def jon08(t):
    from ..functions import dates

    rows = staging.accepted(t.stg_case).select("row_num", "unit_code", "box_code", dates.two_forms(F.col("doc_date")).alias("doc_date"), F.col("quantity").try_cast("int").alias("quantity"))
    return refs.existing(rows, staging.resolved_facts(t), list(staging.KEY)).select("row_num")


@query("JON09", "SELECT row_num FROM stg_case WHERE upper(box_code) IN (SELECT code FROM m_box)")
def jon09(t):
    return t.stg_case.withColumn("code", F.upper("box_code")).join(t.m_box.select("code").distinct(), "code", "left_semi").select("row_num")


TWIN_VIEWS["case_applied"] = """SELECT v.row_num, w.id AS warehouse_id, u.id AS unit_id, d.id AS doc_type_id, r.id AS retention_id, b.id AS box_id, s.id AS status_id,
  v.doc_date, v.quantity FROM case_valid v JOIN m_warehouse w ON w.code = v.warehouse JOIN m_unit u ON u.code = v.unit_code JOIN m_doc_type d ON d.name = v.doc_type
  LEFT JOIN m_retention r ON r.years = v.retention_years LEFT JOIN m_box b ON b.code = v.box_code
  LEFT JOIN m_status s ON s.kind = 'BOX' AND s.code = upper(replace(coalesce(v.box_status, 'UNKNOWN'), ' ', '_'))"""
_APPLIED = ["row_num", "warehouse_id", "unit_id", "doc_type_id", "retention_id", "box_id", "status_id", "doc_date", "quantity"]


@query("JON10", "SELECT * FROM case_applied")
def jon10(t):
    return staging.applied_facts(staging.valid_rows(staging.checked_case(t)), t).select(*_APPLIED)


TWIN_VIEWS["box_resolved"] = """SELECT n.row_num, n.box_code, w.id AS warehouse_id, l.id AS location_id, s.id AS status_id
  FROM case_norm n JOIN m_warehouse w ON w.code = n.warehouse LEFT JOIN m_location l ON l.area = n.area AND l.shelf_row = n.shelf_row AND l.shelf_col = n.shelf_col
  LEFT JOIN m_status s ON s.kind = 'BOX' AND s.code = upper(replace(coalesce(n.box_status, 'UNKNOWN'), ' ', '_')) WHERE n.box_code IS NOT NULL"""


def box_resolved(t):
    from ..functions import text

    rows = staging.accepted(t.stg_case).where("box_code is not null").withColumn("status_code", text.code_from_name(F.col("box_status")))
    rows = apply.resolve(rows, t.m_warehouse, {"warehouse": "code"}, "warehouse_id")
    rows = apply.resolve(rows, t.m_location, {"area": "area", "shelf_row": "shelf_row", "shelf_col": "shelf_col"}, "location_id", "left")
    rows = apply.resolve(rows, t.m_status, {"status_code": "code"}, "status_id", "left", kind="BOX")
    return rows.select("row_num", "box_code", "warehouse_id", "location_id", "status_id")


@query("JON11", "SELECT * FROM box_resolved")
def jon11(t):
    return box_resolved(t)


@query("JON12", """SELECT k.id FROM fact_codes k WHERE EXISTS (SELECT 1 FROM case_norm n WHERE n.unit_code = k.unit_code AND n.box_code = k.box_code AND n.doc_date = CAST(k.doc_date AS VARCHAR) AND n.quantity = CAST(k.quantity AS VARCHAR))""")
def jon12(t):
    facts = staging.resolved_facts(t).withColumns({"doc_date": F.col("doc_date").cast("string"), "quantity": F.col("quantity").cast("string")})
    return refs.existing(facts, staging.accepted(t.stg_case), list(staging.KEY)).select("id")


@query("JON13", "SELECT k.id FROM fact_codes k WHERE EXISTS (SELECT 1 FROM case_norm n WHERE n.unit_code = k.unit_code AND n.box_code = k.box_code)")
def jon13(t):
    return refs.existing(staging.resolved_facts(t), staging.accepted(t.stg_case), ["unit_code", "box_code"]).select("id")


@query("JON14", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def jon14(t):
    wanted = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")).distinct()
    return t.customer.join(wanted, "c_nationkey", "left_semi").select("c_custkey")


@query("JON15", "SELECT DISTINCT u.user_id, m.menu_id FROM user_role u JOIN role_menu m ON u.role_id = m.role_id")
def jon15(t):
    return graph.two_hops(t.user_role, t.role_menu, "role_id", "user_id", "menu_id")


@query("JON16", "SELECT m.role_id, p.p_partkey AS menu_id, p.p_name FROM role_menu m JOIN part p ON p.p_partkey = m.menu_id")
def jon16(t):
    return graph.one_hop(t.role_menu, t.part.select(F.col("p_partkey").cast("bigint").alias("menu_id"), "p_name"), "menu_id").select("role_id", "menu_id", "p_name")


@query("JON17", "SELECT p_partkey, p_partkey % 10 = 0 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1) AS allowed FROM part")
def jon17(t):
    resources = t.part.select("p_partkey", (F.col("p_partkey") % 10 == 0).alias("is_public"))
    links = t.lineitem.where("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey"))
    return graph.allowed(resources, links, "p_partkey").select("p_partkey", "allowed")


@query("JON18", """WITH wanted AS (SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey + o_custkey % 3 AS BIGINT) AS role_id FROM orders),
ok AS (SELECT * FROM wanted WHERE user_id NOT IN (SELECT user_id FROM wanted WHERE role_id NOT IN (SELECT CAST(o_orderkey AS BIGINT) FROM orders)))
SELECT user_id, role_id FROM user_role UNION SELECT user_id, role_id FROM ok""")
def jon18(t):
    wanted = t.orders.select(F.col("o_custkey").cast("bigint").alias("user_id"), (F.col("o_orderkey") + F.col("o_custkey") % 3).cast("bigint").alias("role_id"))
    links, _ = graph.added(t.user_role, wanted, t.user_role, "role_id")
    return links


# Aggregations

@query("AGG01", "SELECT job_id, CAST(count(*) AS BIGINT) AS raw_rows, CAST(count(parse_errors) AS BIGINT) AS bad_rows FROM stg_case GROUP BY job_id")
def agg01(t):
    return t.stg_case.groupBy("job_id").agg(F.count("*").alias("raw_rows"), F.count("parse_errors").alias("bad_rows"))


@query("AGG02", "SELECT error_type, CAST(count(*) AS BIGINT) AS n FROM case_checked WHERE error_type IS NOT NULL GROUP BY error_type")
def agg02(t):
    return report.counts(staging.checked_case(t).where("error_type is not null"), "error_type")


@query("AGG03", "SELECT job_id, status, CAST(count(*) AS BIGINT) AS n FROM job_sheet_log GROUP BY job_id, status")
def agg03(t):
    return report.counts(t.job_sheet_log, "job_id", "status")


_SUMS = "CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(sum(valid_rows) AS BIGINT) AS valid_rows, CAST(sum(error_rows) AS BIGINT) AS error_rows"


def sums():
    return [F.sum(c).alias(c) for c in ("total_rows", "valid_rows", "error_rows")]


@query("AGG04", f"SELECT job_id, {_SUMS} FROM job_sheet_log GROUP BY job_id")
def agg04(t):
    return t.job_sheet_log.groupBy("job_id").agg(*sums())


@query("AGG05", "SELECT job_id, round(avg(progress_percent), 6) AS progress FROM job_sheet_log GROUP BY job_id")
def agg05(t):
    return t.job_sheet_log.groupBy("job_id").agg(F.round(F.avg("progress_percent"), 6).alias("progress"))


@query("AGG06", "SELECT job_id, bool_and(status IN ('COMPLETED','FAILED')) AS all_final FROM job_sheet_log GROUP BY job_id")
def agg06(t):
    return t.job_sheet_log.groupBy("job_id").agg(F.bool_and(F.col("status").isin(*report.FINAL)).alias("all_final"))


@query("AGG07", "SELECT CAST(count(*) - count(DISTINCT (unit_code, box_code, doc_date, quantity)) AS BIGINT) AS surplus FROM case_norm")
def agg07(t):
    return staging.accepted(t.stg_case).agg(dedupe.surplus(None, [F.col(k) for k in staging.KEY]))


@query("AGG08", "SELECT job_id, " + ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s.lower()}" for s in ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "TIMEOUT")) + " FROM step_log GROUP BY job_id")
def agg08(t):
    each = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "TIMEOUT")]
    return t.step_log.groupBy("job_id").agg(*each)


@query("AGG09", f"""SELECT job_id, CAST(count(*) AS BIGINT) AS sheets, CAST(count(*) FILTER (status = 'COMPLETED') AS BIGINT) AS successes, CAST(count(*) FILTER (status = 'FAILED') AS BIGINT) AS failures,
  {_SUMS}, round(count(*) FILTER (status = 'COMPLETED') * 100.0 / count(*), 6) AS success_rate FROM job_sheet_log GROUP BY job_id""")
def agg09(t):
    done = F.count_if(F.col("status") == "COMPLETED")
    return t.job_sheet_log.groupBy("job_id").agg(
        F.count("*").alias("sheets"), done.alias("successes"), F.count_if(F.col("status") == "FAILED").alias("failures"), *sums(),
        F.round(report.percent(done.cast("double"), F.count("*")), 6).alias("success_rate"),
    )


@query("AGG10", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (n = 0) AS BIGINT) AS valid, CAST(count(*) FILTER (n > 0) AS BIGINT) AS in_error, CAST(sum(n) AS BIGINT) AS errors,
  round(count(*) FILTER (n > 0) * 100.0 / count(*), 6) AS error_rate FROM (SELECT """ + " + ".join(f"CAST({c} IS NULL AS INT)" for c in staging.REQUIRED) + " AS n FROM case_norm)")
def agg10(t):
    from ..operators import rules

    n = F.size("errors")
    rows = staging.accepted(t.stg_case).select(rules.error_list(staging.required_rules()).alias("errors"))
    bad = F.count_if(n > 0)
    return rows.agg(F.count("*").alias("total"), F.count_if(n == 0).alias("valid"), bad.alias("in_error"), F.sum(n).alias("errors"),
                    F.round(report.percent(bad.cast("double"), F.count("*")), 6).alias("error_rate"))


@query("AGG11", "SELECT unit_id, box_id, doc_date, quantity, CAST(count(*) AS BIGINT) AS n FROM case_fact GROUP BY ALL")
def agg11(t):
    return report.counts(t.case_fact, "unit_id", "box_id", "doc_date", "quantity")


@query("AGG12", "SELECT sheet_name, CAST(count(*) AS BIGINT) AS n FROM both_sheets GROUP BY sheet_name")
def agg12(t):
    return report.counts(both_sheets(t), "sheet_name")


@query("AGG13", "SELECT 'case' AS name, CAST(count(*) AS BIGINT) AS n FROM stg_case UNION ALL SELECT 'contract', count(*) FROM stg_contract UNION ALL SELECT 'fact', count(*) FROM case_fact")
def agg13(t):
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("case", t.stg_case).unionByName(one("contract", t.stg_contract)).unionByName(one("fact", t.case_fact))


@query("AGG14", "SELECT job_id, status, CAST(sum(total_rows) AS BIGINT) AS total_rows FROM job_sheet_log GROUP BY job_id, status")
def agg14(t):
    by = report.counts_map(t.job_sheet_log, "job_id", "status", F.col("total_rows"))
    return by.select("job_id", F.explode("by_category").alias("status", "total_rows"))


@query("AGG15", "SELECT CAST(count(DISTINCT c_name) AS BIGINT) AS names, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS nations FROM customer")
def agg15(t):
    return t.customer.agg(F.count_distinct("c_name").alias("names"), F.count_distinct("c_nationkey").alias("nations"))


@query("AGG16", "SELECT contract_no, CAST(count(*) AS BIGINT) AS n FROM stg_contract GROUP BY contract_no HAVING count(*) > 1 ORDER BY n DESC, contract_no LIMIT 10")
def agg16(t):
    return report.counts(t.stg_contract, "contract_no").where("n > 1").orderBy(F.desc("n"), "contract_no").limit(10)


@query("AGG17", "SELECT error_type, error_field, CAST(count(*) AS BIGINT) AS n FROM case_checked WHERE error_type IS NOT NULL GROUP BY ALL ORDER BY n DESC, error_type, error_field LIMIT 20")
def agg17(t):
    rows = staging.checked_case(t).where("error_type is not null")
    return report.counts(rows, "error_type", "error_field").orderBy(F.desc("n"), "error_type", "error_field").limit(20)


# Windows

@query("WIN01", "SELECT row_num FROM case_ranked WHERE place > 1")
def win01(t):
    return staging.repeats(t.stg_case).select("row_num")


@query("WIN02", "SELECT row_num, 'duplicate of row ' || first_row AS message FROM case_ranked WHERE place > 1")
def win02(t):
    return staging.repeats(t.stg_case).select("row_num", F.concat(F.lit("duplicate of row "), F.col("first_row").cast("string")).alias("message"))


@query("WIN03", "SELECT row_num FROM (SELECT row_num, row_number() OVER (PARTITION BY contract_no, doc_kind, disbursed_on ORDER BY row_num) AS place FROM stg_contract) WHERE place > 1")
def win03(t):
    return dedupe.repeats(t.stg_contract, [F.col(c) for c in ("contract_no", "doc_kind", "disbursed_on")]).select("row_num")


_KIND_KEY = """contract_no, doc_kind, CASE WHEN doc_kind IN ('LD','MD','OD','HDHM','KSSV','TTK') THEN disbursed_on END,
  CASE WHEN doc_kind IN ('CC','TSBD','TTK') THEN customer_cif END, CASE WHEN doc_kind = 'TTK' THEN unit_code END"""


@query("WIN04", f"SELECT row_num, first_row FROM (SELECT row_num, row_number() OVER w AS place, first_value(row_num) OVER w AS first_row FROM stg_contract WINDOW w AS (PARTITION BY {_KIND_KEY} ORDER BY row_num)) WHERE place > 1")
def win04(t):
    parts = keys.contract_key_parts(*[F.col(c) for c in ("contract_no", "doc_kind", "disbursed_on", "customer_cif", "unit_code")])
    return dedupe.repeats(t.stg_contract, parts).select("row_num", "first_row")


@query("WIN05", "SELECT row_num FROM (SELECT row_num, row_number() OVER (PARTITION BY floor((row_num - 1) / 20000), contract_no ORDER BY row_num) AS place FROM stg_contract) WHERE place > 1")
def win05(t):
    return dedupe.repeats_in_range(t.stg_contract, [F.col("contract_no")], 20_000).select("row_num")


@query("WIN06", "SELECT row_num, previous_row FROM (SELECT row_num, lag(row_num) OVER (PARTITION BY contract_no ORDER BY row_num) AS previous_row FROM stg_contract WHERE trim(contract_no) <> '') WHERE previous_row IS NOT NULL")
def win06(t):
    return dedupe.previous_row(t.stg_contract, "contract_no").select("row_num", "previous_row")


@query("WIN07", "SELECT CAST(count(DISTINCT contract_no) AS BIGINT) AS first_seen, CAST(count(contract_no) - count(DISTINCT contract_no) AS BIGINT) AS repeated FROM stg_contract")
def win07(t):
    seen = F.count_distinct("contract_no")
    return t.stg_contract.agg(seen.alias("first_seen"), (F.count("contract_no") - seen).alias("repeated"))


@query("WIN08", "SELECT row_num, CAST(count(*) OVER (PARTITION BY contract_no) AS BIGINT) AS group_size, CAST(row_number() OVER (PARTITION BY contract_no ORDER BY row_num) AS INT) AS place FROM stg_contract")
def win08(t):
    return dedupe.group_size(t.stg_contract, [F.col("contract_no")]).select("row_num", "group_size", "place")


# Sorts and limits: reports of the first so many

@query("SRT01", "SELECT row_num, error_type FROM case_checked WHERE error_type IS NOT NULL ORDER BY row_num, error_type LIMIT 100")
def srt01(t):
    return staging.checked_case(t).where("error_type is not null").orderBy("row_num", "error_type").limit(100).select("row_num", "error_type")


@query("SRT02", "SELECT DISTINCT 'unit ' || unit_code AS missing FROM case_norm WHERE unit_code IS NOT NULL AND unit_code NOT IN (SELECT code FROM m_unit WHERE is_active) ORDER BY 1 LIMIT 10")
def srt02(t):
    gone = refs.unresolved_keys(staging.accepted(t.stg_case), refs.active(t.m_unit), "unit_code", "code")
    return gone.select(F.concat(F.lit("unit "), "unit_code").alias("missing")).orderBy("missing").limit(10)


@query("SRT03", "SELECT row_num, unit_code FROM stg_case ORDER BY row_num LIMIT 50 OFFSET 200")
def srt03(t):
    return t.stg_case.select("row_num", "unit_code").orderBy("row_num").offset(200).limit(50)


@query("SRT04", "SELECT error_type, row_num FROM (SELECT error_type, row_num, row_number() OVER (PARTITION BY error_type ORDER BY row_num) AS place FROM case_checked WHERE error_type IS NOT NULL) WHERE place <= 5")
def srt04(t):
    place = F.row_number().over(Window.partitionBy("error_type").orderBy("row_num"))
    return staging.checked_case(t).where("error_type is not null").withColumn("place", place).where("place <= 5").select("error_type", "row_num")


@query("SRT05", "SELECT arg_min(step, (-ms, step)) AS slowest, round(max(ms) * 100.0 / sum(ms), 6) AS share FROM (SELECT step, sum(duration_ms) AS ms FROM step_log GROUP BY step)")
def srt05(t):
    per_step = t.step_log.groupBy("step").agg(F.sum("duration_ms").alias("ms"))
    name, share = report.slowest(F.col("step"), F.col("ms"))
    return per_step.agg(name.alias("slowest"), F.round(share, 6).alias("share"))


@query("SRT06", "SELECT job_id, sheet_name FROM job_sheet_log")
def srt06(t):
    return t.job_sheet_log.orderBy(F.desc("started_at"), "sheet_name").select("job_id", "sheet_name")


# Sets

@query("SET01", "SELECT row_num, 'quantity' AS kind FROM stg_case WHERE quantity = '0' UNION ALL SELECT row_num, 'date' FROM stg_case WHERE doc_date = 'not-a-date'")
def set01(t):
    one = lambda cond, kind: t.stg_case.where(cond).select("row_num", F.lit(kind).alias("kind"))
    return one("quantity = '0'", "quantity").unionByName(one("doc_date = 'not-a-date'", "date"))


@query("SET02", "SELECT DISTINCT unit_code, area FROM case_norm")
def set02(t):
    return staging.accepted(t.stg_case).select("unit_code", "area").distinct()


@query("SET03", """SELECT job_id, row_num, error_type, min(error_field) AS error_field FROM (
  SELECT job_id, row_num, row_error AS error_type, row_field AS error_field FROM case_row_error WHERE row_error IS NOT NULL
  UNION ALL SELECT job_id, row_num, 'REQUIRED_MISSING', 'box_code_or_quantity' FROM case_norm WHERE box_code IS NULL OR quantity IS NULL
  UNION ALL SELECT job_id, row_num, 'REQUIRED_MISSING', 'unit_code' FROM case_norm WHERE unit_code IS NULL) GROUP BY ALL""")
def set03(t):
    from ..operators import rules

    e, rows = rules.first_error(staging.row_rules()), staging.accepted(t.stg_case)
    errors = rows.select("job_id", "row_num", e["error_type"].alias("error_type"), e["error_field"].alias("error_field")).where("error_type is not null")
    for condition, field in (("box_code is null or quantity is null", "box_code_or_quantity"), ("unit_code is null", "unit_code")):
        errors = errors.unionByName(rows.where(condition).select("job_id", "row_num", F.lit("REQUIRED_MISSING").alias("error_type"), F.lit(field).alias("error_field")))
    return dedupe.first_of_each(errors, ["job_id", "row_num", "error_type"], "error_field")


@query("SET04", "SELECT 'case' AS sheet_name, row_num FROM stg_case WHERE unit_code IS NULL UNION ALL SELECT 'contract', row_num FROM stg_contract WHERE disbursed_on IS NULL")
def set04(t):
    a = t.stg_case.where("unit_code is null").select(F.lit("case").alias("sheet_name"), "row_num")
    return a.unionByName(t.stg_contract.where("disbursed_on is null").select(F.lit("contract").alias("sheet_name"), "row_num"))


# Apply

def new_members(name: str, column: str, master: str, master_key: str, cast: str | None = None):
    expression = f"TRY_CAST({column} AS INT)" if cast else column
    sql = f"SELECT DISTINCT {expression} AS {master_key} FROM case_norm WHERE {expression} IS NOT NULL AND {expression} NOT IN (SELECT {master_key} FROM {master})"

    def f(t):
        value = F.col(column).try_cast(cast) if cast else F.col(column)
        rows = staging.accepted(t.stg_case).select(value.alias(master_key))
        return apply.missing_members(rows, getattr(t, master), [master_key])

    query(name, sql)(f)


new_members("APP01", "warehouse", "m_warehouse", "code")
new_members("APP02", "unit_code", "m_unit", "code")
new_members("APP05", "retention_years", "m_retention", "years", "int")


@query("APP03", "SELECT DISTINCT doc_type AS name, upper(replace(doc_type, ' ', '_')) AS code FROM case_norm WHERE doc_type IS NOT NULL AND doc_type NOT IN (SELECT name FROM m_doc_type)")
def app03(t):
    from ..functions import text

    rows = staging.accepted(t.stg_case).select(F.col("doc_type").alias("name"))
    return apply.missing_members(rows, t.m_doc_type, ["name"]).withColumn("code", text.code_from_name(F.col("name")))


@query("APP04", """WITH s AS (SELECT 'BOX' AS kind, box_status AS name FROM case_norm UNION ALL SELECT 'AREA', area FROM case_norm UNION ALL SELECT 'KIND', doc_type FROM case_norm),
c AS (SELECT upper(replace(coalesce(name, 'UNKNOWN'), ' ', '_')) AS code, kind, min(coalesce(name, 'UNKNOWN')) AS name FROM s GROUP BY 1, 2)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m_status m WHERE m.code = c.code AND m.kind = c.kind)""")
def app04(t):
    found = apply.statuses(staging.accepted(t.stg_case), {"BOX": "box_status", "AREA": "area", "KIND": "doc_type"})
    return found.join(t.m_status.select("code", "kind"), ["code", "kind"], "left_anti")


@query("APP06", "SELECT DISTINCT area, shelf_row, shelf_col FROM case_norm n WHERE area IS NOT NULL AND shelf_row IS NOT NULL AND shelf_col IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_location l WHERE l.area = n.area AND l.shelf_row = n.shelf_row AND l.shelf_col = n.shelf_col)")
def app06(t):
    return apply.missing_members(staging.accepted(t.stg_case), t.m_location, ["area", "shelf_row", "shelf_col"])


@query("APP07", "SELECT b.* FROM box_resolved b JOIN (SELECT box_code, min(row_num) AS row_num FROM box_resolved GROUP BY box_code) f USING (box_code, row_num) WHERE b.box_code NOT IN (SELECT code FROM m_box)")
def app07(t):
    return apply.new_boxes(box_resolved(t), t.m_box)


@query("APP08", "SELECT a.* FROM case_applied a WHERE NOT EXISTS (SELECT 1 FROM case_fact f WHERE f.unit_id IS NOT DISTINCT FROM a.unit_id AND f.box_id IS NOT DISTINCT FROM a.box_id AND f.doc_date IS NOT DISTINCT FROM a.doc_date AND f.quantity IS NOT DISTINCT FROM a.quantity)")
def app08(t):
    return apply.new_facts(jon10(t), t.case_fact, ["unit_id", "box_id", "doc_date", "quantity"])


@query("APP09", """SELECT 'unit' AS step, CAST(count(*) AS BIGINT) AS inserted FROM (SELECT DISTINCT unit_code FROM case_norm WHERE unit_code NOT IN (SELECT code FROM m_unit))
UNION ALL SELECT 'warehouse', count(*) FROM (SELECT DISTINCT warehouse FROM case_norm WHERE warehouse NOT IN (SELECT code FROM m_warehouse))
UNION ALL SELECT 'box', count(DISTINCT box_code) FROM box_resolved WHERE box_code NOT IN (SELECT code FROM m_box)
UNION ALL SELECT 'fact', count(*) FROM case_applied""")
def app09(t):
    rows = staging.accepted(t.stg_case)
    steps = [
        ("unit", apply.missing_members(rows.select(F.col("unit_code").alias("code")), t.m_unit, ["code"])),
        ("warehouse", apply.missing_members(rows.select(F.col("warehouse").alias("code")), t.m_warehouse, ["code"])),
        ("box", apply.new_boxes(box_resolved(t), t.m_box)),
        ("fact", jon10(t)),
    ]
    counted = [df.agg(F.count("*").alias("inserted")).select(F.lit(name).alias("step"), "inserted") for name, df in steps]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


@query("APP10", "SELECT DISTINCT contract_no FROM stg_contract WHERE contract_no NOT IN (SELECT 'HD' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer)")
def app10(t):
    master = t.customer.select(F.concat(F.lit("HD"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("contract_no"))
    return apply.missing_members(t.stg_contract, master, ["contract_no"])


@query("APP11", "SELECT code, CAST((SELECT max(id) FROM m_warehouse) + row_number() OVER (ORDER BY code) AS BIGINT) AS id FROM (SELECT DISTINCT warehouse AS code FROM case_norm WHERE warehouse NOT IN (SELECT code FROM m_warehouse))")
def app11(t):
    rows = staging.accepted(t.stg_case).select(F.col("warehouse").alias("code"))
    return apply.with_surrogate(apply.missing_members(rows, t.m_warehouse, ["code"]), t.m_warehouse, ["code"]).select("code", "id")


@query("APP12", "SELECT c_name, c_custkey IN (SELECT o_custkey FROM orders) AS rejected FROM customer")
def app12(t):
    taken = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    rejects = refs.existing(t.customer, taken, ["c_custkey"]).select("c_name", F.lit(True).alias("rejected"))
    return rejects.unionByName(refs.not_in(t.customer, taken, ["c_custkey"]).select("c_name", F.lit(False).alias("rejected")))


# Reconcile

TWIN_VIEWS["job_facts"] = "SELECT k.* FROM fact_codes k WHERE EXISTS (SELECT 1 FROM case_norm n WHERE n.unit_code = k.unit_code AND n.box_code = k.box_code)"


def job_facts(t):
    return refs.existing(staging.resolved_facts(t), staging.accepted(t.stg_case), ["unit_code", "box_code"])


def _two_counts(a, b, names):
    """Two counts in one row: a union of both, then one sum each."""
    zero = F.lit(0).cast("bigint")
    x = a.agg(F.count("*").alias(names[0])).select(names[0], zero.alias(names[1]))
    y = b.agg(F.count("*").alias(names[1])).select(zero.alias(names[0]), names[1])
    return x.unionByName(y).agg(*[F.sum(n).alias(n) for n in names])


@query("REC01", "SELECT v AS valid_rows, f AS inserted_rows, v = f AS consistent FROM (SELECT (SELECT CAST(count(*) AS BIGINT) FROM case_valid) AS v, (SELECT CAST(count(*) AS BIGINT) FROM job_facts) AS f)")
def rec01(t):
    both = _two_counts(staging.checked_case(t).where("error_type is null"), job_facts(t), ("valid_rows", "inserted_rows"))
    return both.withColumn("consistent", F.col("valid_rows") == F.col("inserted_rows"))


@query("REC02", "SELECT DISTINCT 'warehouse ' || warehouse AS missing FROM case_norm WHERE warehouse IS NOT NULL AND warehouse NOT IN (SELECT code FROM m_warehouse WHERE is_active) ORDER BY 1 LIMIT 10")
def rec02(t):
    gone = refs.unresolved_keys(staging.accepted(t.stg_case), refs.active(t.m_warehouse), "warehouse", "code")
    return gone.select(F.concat(F.lit("warehouse "), "warehouse").alias("missing")).orderBy("missing").limit(10)


@query("REC03", "SELECT CAST(count(*) - count(DISTINCT (unit_code, box_code, doc_date, quantity)) AS BIGINT) AS surplus FROM job_facts")
def rec03(t):
    return job_facts(t).agg(dedupe.surplus(None, [F.col(k) for k in staging.KEY]))


@query("REC04", "SELECT id FROM job_facts WHERE due_date > handover_date")
def rec04(t):
    return job_facts(t).where("due_date > handover_date").select("id")


@query("REC05", "SELECT id FROM job_facts WHERE quantity <= 0")
def rec05(t):
    return job_facts(t).where("quantity <= 0").select("id")


@query("REC06", """SELECT late = 0 AND zero = 0 AND surplus = 0 AS consistent, 'late: ' || late || '; quantity: ' || zero || '; surplus: ' || surplus AS report FROM (
  SELECT count(*) FILTER (due_date > handover_date) AS late, count(*) FILTER (quantity <= 0) AS zero, count(*) - count(DISTINCT (unit_code, box_code, doc_date, quantity)) AS surplus FROM job_facts)""")
def rec06(t):
    checks = job_facts(t).agg(
        F.count_if(F.col("due_date") > F.col("handover_date")).alias("late"), F.count_if(F.col("quantity") <= 0).alias("zero"),
        dedupe.surplus(None, [F.col(k) for k in staging.KEY]),
    )
    names = {"late": "late", "quantity": "zero", "surplus": "surplus"}
    text = F.concat_ws("; ", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in names.items()])
    return checks.select(((F.col("late") == 0) & (F.col("zero") == 0) & (F.col("surplus") == 0)).alias("consistent"), text.alias("report"))


@query("REC07", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(parse_errors) AS BIGINT) AS errors, CAST(count(*) - count(parse_errors) AS BIGINT) AS valid FROM stg_case")
def rec07(t):
    bad = F.count("parse_errors")
    return t.stg_case.agg(F.count("*").alias("total"), bad.alias("errors"), (F.count("*") - bad).alias("valid"))


@query("REC08", "SELECT (SELECT CAST(count(*) AS BIGINT) FROM case_valid) AS valid_rows, (SELECT CAST(count(*) AS BIGINT) FROM case_fact WHERE doc_date >= DATE '1997-01-01') AS new_facts")
def rec08(t):
    return _two_counts(staging.checked_case(t).where("error_type is null"), t.case_fact.where("doc_date >= date'1997-01-01'"), ("valid_rows", "new_facts"))


# Reports

_RATE = "CASE WHEN duration_ms > 0 THEN round(total_rows * 1000.0 / duration_ms, 6) ELSE 0.0 END"


@query("REP01", """SELECT j.job_id, CAST(count(*) AS BIGINT) AS sheets, CAST(sum(error_rows) AS BIGINT) AS error_rows, CAST(coalesce(max(f.n), 0) AS BIGINT) AS failed
  FROM job_sheet_log j LEFT JOIN (SELECT job_id, count(*) AS n FROM job_sheet_log WHERE status = 'FAILED' GROUP BY job_id) f ON f.job_id = j.job_id GROUP BY j.job_id""")
def rep01(t):
    jobs = t.job_sheet_log.groupBy("job_id").agg(F.count("*").alias("sheets"), F.sum("error_rows").alias("error_rows"))
    failed = report.counts(t.job_sheet_log.where("status = 'FAILED'"), "job_id", name="failed")
    return jobs.join(failed, "job_id", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))


@query("REP02", f"SELECT job_id, CAST(count(*) FILTER (status = 'COMPLETED') AS BIGINT) AS completed, {_SUMS}, round(avg(progress_percent), 6) AS progress FROM job_sheet_log GROUP BY job_id")
def rep02(t):
    return t.job_sheet_log.groupBy("job_id").agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"), *sums(), F.round(F.avg("progress_percent"), 6).alias("progress"))


@query("REP03", "SELECT job_id, sheet_name, status, duration_ms, CAST(epoch_us(started_at) // 1000 % 1000000 AS BIGINT) AS started_ms FROM job_sheet_log")
def rep03(t):
    return t.job_sheet_log.select("job_id", "sheet_name", "status", "duration_ms", (F.unix_millis(F.col("started_at").cast("timestamp")) % 1_000_000).alias("started_ms"))


@query("REP04", f"SELECT job_id, sheet_name, {_RATE} AS rows_per_s FROM job_sheet_log WHERE status = 'COMPLETED'")
def rep04(t):
    return t.job_sheet_log.where("status = 'COMPLETED'").select("job_id", "sheet_name", F.round(report.rate(F.col("total_rows"), F.col("duration_ms")), 6).alias("rows_per_s"))


@query("REP05", """SELECT job_id, CASE WHEN bool_or(status IN ('INGESTING','VALIDATING','INSERTING')) THEN 'STARTED' WHEN bool_and(status = 'COMPLETED') THEN 'COMPLETED'
  WHEN bool_or(status = 'FAILED') THEN 'COMPLETED_WITH_ERRORS' ELSE 'PENDING' END AS status FROM job_sheet_log GROUP BY job_id""")
def rep05(t):
    return t.job_sheet_log.groupBy("job_id").agg(report.overall_status(F.col("status")).alias("status"))


@query("REP06", "SELECT job_id, CAST(count(*) FILTER (status IN ('INGESTING','VALIDATING','INSERTING')) AS BIGINT) AS at_work, bool_and(status IN ('COMPLETED','FAILED')) AS complete FROM job_sheet_log GROUP BY job_id")
def rep06(t):
    s = F.col("status")
    return t.job_sheet_log.groupBy("job_id").agg(F.count_if(s.isin(*report.IN_PROGRESS)).alias("at_work"), F.bool_and(s.isin(*report.FINAL)).alias("complete"))


@query("REP07", "SELECT job_id, round(count(*) FILTER (status = 'COMPLETED') * 100.0 / count(*), 6) AS progress, min(step_id) FILTER (status = 'IN_PROGRESS') AS current_step FROM step_log GROUP BY job_id")
def rep07(t):
    done = F.count_if(F.col("status") == "COMPLETED").cast("double")
    current = F.min(F.when(F.col("status") == "IN_PROGRESS", F.col("step_id")))
    return t.step_log.groupBy("job_id").agg(F.round(report.percent(done, F.count("*")), 6).alias("progress"), current.alias("current_step"))


@query("REP08", "SELECT job_id, step_id FROM step_log WHERE duration_ms > CASE WHEN step = 'move_valid' THEN 900000 ELSE 300000 END")
def rep08(t):
    limit = F.when(F.col("step") == "move_valid", 15 * 60_000).otherwise(5 * 60_000)
    return t.step_log.where(F.col("duration_ms") > limit).select("job_id", "step_id")


@query("REP09", "SELECT job_id, step, CAST(sum(duration_ms) AS BIGINT) AS ms, round(CASE WHEN sum(duration_ms) > 0 THEN sum(affected_rows) * 1000.0 / sum(duration_ms) ELSE 0.0 END, 6) AS rows_per_s FROM step_log GROUP BY job_id, step")
def rep09(t):
    ms = F.sum("duration_ms")
    return t.step_log.groupBy("job_id", "step").agg(ms.alias("ms"), F.round(report.rate(F.sum("affected_rows"), ms), 6).alias("rows_per_s"))


@query("REP10", "SELECT job_id, arg_min(step_id, (-duration_ms, step_id)) AS bottleneck, CAST(sum(duration_ms) AS BIGINT) AS ms FROM step_log GROUP BY job_id")
def rep10(t):
    name, _ = report.slowest(F.col("step_id"), F.col("duration_ms"))
    return t.step_log.groupBy("job_id").agg(name.alias("bottleneck"), F.sum("duration_ms").alias("ms"))


_ERROR_RATE = "sum(error_rows) * 100.0 / sum(total_rows)"


@query("REP11", f"""SELECT job_id, CAST(count(*) FILTER (duration_ms > 500) AS BIGINT) AS slow, CAST(count(*) FILTER (duration_ms <= 800) AS BIGINT) AS within_sla, round(avg(duration_ms), 6) AS latency,
  round(CASE WHEN sum(total_rows) > 0 THEN {_ERROR_RATE} ELSE 0.0 END, 6) AS error_rate,
  CASE WHEN sum(total_rows) > 0 AND {_ERROR_RATE} > 10 THEN 'CRITICAL' WHEN sum(total_rows) > 0 AND {_ERROR_RATE} > 5 THEN 'WARNING' ELSE 'HEALTHY' END AS health FROM job_sheet_log GROUP BY job_id""")
def rep11(t):
    ms = F.col("duration_ms")
    error_rate = report.percent(F.sum("error_rows").cast("double"), F.sum("total_rows"))
    return t.job_sheet_log.groupBy("job_id").agg(
        F.count_if(ms > 500).alias("slow"), F.count_if(ms <= 800).alias("within_sla"), F.round(F.avg(ms), 6).alias("latency"),
        F.round(error_rate, 6).alias("error_rate"), report.health(error_rate).alias("health"),
    )


@query("REP12", f"""SELECT status, round(avg(total_rows), 6) AS rows_per_file, round(avg(duration_ms), 6) AS ms_per_file, round(sum(total_rows) * 1000.0 / sum(duration_ms), 6) < 1000 AS slow,
  {_ERROR_RATE} > 5 AS many_errors FROM job_sheet_log GROUP BY status""")
def rep12(t):
    return t.job_sheet_log.groupBy("status").agg(
        F.round(F.avg("total_rows"), 6).alias("rows_per_file"), F.round(F.avg("duration_ms"), 6).alias("ms_per_file"),
        (report.rate(F.sum("total_rows"), F.sum("duration_ms")) < 1000).alias("slow"),
        (report.percent(F.sum("error_rows").cast("double"), F.sum("total_rows")) > 5).alias("many_errors"),
    )


@query("REP13", """SELECT sheet_name, CASE WHEN total_rows > 0 THEN round(valid_rows * 100.0 / total_rows, 6) ELSE 0.0 END AS percent,
  CASE WHEN valid_rows > 0 THEN round((total_rows - valid_rows) * (duration_ms * 1.0 / valid_rows), 6) END AS remaining_ms FROM job_sheet_log""")
def rep13(t):
    left = F.when(F.col("valid_rows") > 0, F.round((F.col("total_rows") - F.col("valid_rows")) * (F.col("duration_ms") * 1.0 / F.col("valid_rows")), 6))
    return t.job_sheet_log.select("sheet_name", F.round(report.percent(F.col("valid_rows").cast("double"), F.col("total_rows")), 6).alias("percent"), left.alias("remaining_ms"))


@query("REP14", f"SELECT sheet_name, {_RATE} AS rows_per_s FROM job_sheet_log")
def rep14(t):
    return t.job_sheet_log.select("sheet_name", F.round(report.rate(F.col("total_rows"), F.col("duration_ms")), 6).alias("rows_per_s"))


@query("REP15", "SELECT CAST(count(*) FILTER (status NOT IN ('COMPLETED','FAILED')) AS BIGINT) AS active, CAST(count(*) FILTER (status = 'COMPLETED') AS BIGINT) AS completed, CAST(count(*) FILTER (status = 'FAILED') AS BIGINT) AS failed FROM job_sheet_log")
def rep15(t):
    s = F.col("status")
    return t.job_sheet_log.agg(F.count_if(~s.isin(*report.FINAL)).alias("active"), F.count_if(s == "COMPLETED").alias("completed"), F.count_if(s == "FAILED").alias("failed"))


@query("REP16", "SELECT sheet_name FROM job_sheet_log WHERE started_at < (SELECT max(started_at) FROM job_sheet_log) - INTERVAL 7 DAY")
def rep16(t):
    newest = t.job_sheet_log.agg(F.max("started_at")).scalar()
    return t.job_sheet_log.where(F.col("started_at") < newest - F.expr("interval 7 days")).select("sheet_name")
