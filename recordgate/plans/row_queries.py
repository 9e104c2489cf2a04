"""Queries of projections, filters, row rules, scalars and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, keys, numbers, text
from ..operators import contract, rules
from ..operators.rules import Rule
from . import staging
from .registry import query

ROW = ["job_id", "row_num"]

# Projections

_MAPPING = {"unit": "unit_code", "box": "box_code", "quantity_text": "quantity", "not_there": "absent_header"}


@query("PRJ01", "SELECT row_num, unit_code AS unit, box_code AS box, quantity AS quantity_text, CAST(NULL AS VARCHAR) AS not_there FROM stg_case")
def prj01(t):
    df = t.stg_case
    return df.select("row_num", *[(F.col(h) if h in df.columns else F.lit(None).cast("string")).alias(c) for c, h in _MAPPING.items()])


@query("PRJ02", """SELECT s.row_num, s.warehouse, nullif(upper(trim(s.warehouse)), '') AS warehouse_norm, s.unit_code, nullif(upper(trim(s.unit_code)), '') AS unit_code_norm,
  s.box_code, nullif(upper(trim(s.box_code)), '') AS box_code_norm FROM stg_case s""")
def prj02(t):
    names = ("warehouse", "unit_code", "box_code")
    return t.stg_case.select("row_num", *[c for n in names for c in (F.col(n), text.normal_text(F.col(n)).alias(f"{n}_norm"))])


@query("PRJ03", """SELECT job_id, sheet_name, row_num, contract_no, doc_kind, customer_cif, unit_code, disbursed_on,
  CASE WHEN doc_kind IN ('LD','MD','OD','HDHM','KSSV') THEN contract_no || '_' || doc_kind || '_' || coalesce(CAST(disbursed_on AS VARCHAR), '')
       WHEN doc_kind IN ('CC','TSBD') THEN contract_no || '_' || doc_kind || '_' || customer_cif
       WHEN doc_kind = 'TTK' THEN contract_no || '_' || doc_kind || '_' || customer_cif || '_' || unit_code || '_' || coalesce(CAST(disbursed_on AS VARCHAR), '')
       ELSE contract_no || '_' || doc_kind END AS business_key FROM stg_contract""")
def prj03(t):
    parts = [F.col(c) for c in ("contract_no", "doc_kind", "disbursed_on", "customer_cif", "unit_code")]
    return t.stg_contract.select(
        "job_id", "sheet_name", "row_num", "contract_no", "doc_kind", "customer_cif", "unit_code", "disbursed_on", keys.contract_key(*parts).alias("business_key")
    )


@query("PRJ04", "SELECT * FROM case_valid")
def prj04(t):
    return staging.valid_rows(staging.checked_case(t))


@query("PRJ05", f"""SELECT row_num, field, value FROM (SELECT row_num, CASE {' '.join(f"WHEN {c} IS NULL THEN '{c}'" for c in staging.REQUIRED)} END AS field, '' AS value FROM case_norm) WHERE field IS NOT NULL""")
def prj05(t):
    field, value = rules.first_field(staging.required_rules())
    return staging.accepted(t.stg_case).select("row_num", field.alias("field"), value.alias("value")).where("field is not null")


@query("PRJ06", "SELECT row_num, 'Row:' || row_num || '|MaDV:' || coalesce(unit_code, '') || '|MaThung:' || coalesce(box_code, '') AS original FROM stg_case")
def prj06(t):
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return t.stg_case.select("row_num", F.concat(F.lit("Row:"), part("row_num"), F.lit("|MaDV:"), part("unit_code"), F.lit("|MaThung:"), part("box_code")).alias("original"))


@query("PRJ07", """SELECT row_num, quantity, CASE WHEN quantity IS NOT NULL AND TRY_CAST(trim(quantity) AS INT) IS NULL THEN 'CONVERSION_ERROR' END AS error_code FROM stg_case""")
def prj07(t):
    q = F.col("quantity")
    return t.stg_case.select("row_num", "quantity", F.when(q.isNotNull() & numbers.to_whole(q).isNull(), "CONVERSION_ERROR").alias("error_code"))


# Filters

@query("FLT01", "SELECT row_num, contract_no FROM stg_contract WHERE job_id = 'JOB-1' AND sheet_name = 'contract'")
def flt01(t):
    return t.stg_contract.where("job_id = 'JOB-1' and sheet_name = 'contract'").select("row_num", "contract_no")


@query("FLT02", "SELECT row_num, unit_code FROM stg_case WHERE row_num BETWEEN 500 AND 5000")
def flt02(t):
    return t.stg_case.where(F.col("row_num").between(500, 5000)).select("row_num", "unit_code")


@query("FLT03", "SELECT row_num, CASE WHEN parse_errors IS NULL THEN 'good' ELSE 'bad' END AS side FROM stg_case")
def flt03(t):
    good = t.stg_case.where("parse_errors is null").select("row_num", F.lit("good").alias("side"))
    return good.unionByName(t.stg_case.where("parse_errors is not null").select("row_num", F.lit("bad").alias("side")))


@query("FLT04", "SELECT s.row_num FROM stg_case s WHERE upper(s.unit_code) IN (SELECT code FROM m_unit WHERE is_active)")
def flt04(t):
    units = t.m_unit.where("is_active").select(F.col("code"))
    return t.stg_case.withColumn("code", F.upper("unit_code")).join(units, "code", "left_semi").select("row_num")


@query("FLT05", "SELECT job_id, sheet_name, status FROM job_sheet_log WHERE status IN ('VALIDATING','PENDING') AND started_at >= TIMESTAMP '2024-01-02 00:00:00'")
def flt05(t):
    running = F.col("status").isin("VALIDATING", "PENDING") & (F.col("started_at") >= F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return t.job_sheet_log.where(running).orderBy(F.desc("started_at"), "sheet_name").select("job_id", "sheet_name", "status")


@query("FLT06", "SELECT row_num, error_field FROM case_checked WHERE error_type = 'INVALID_NUMERIC'")
def flt06(t):
    return staging.checked_case(t).where("error_type = 'INVALID_NUMERIC'").orderBy("row_num").select("row_num", "error_field")


@query("FLT07", "SELECT sheet_name, status IN ('INGESTING','VALIDATING','INSERTING') AS at_work, status NOT IN ('COMPLETED','FAILED') AS open FROM job_sheet_log")
def flt07(t):
    from ..operators.report import FINAL, IN_PROGRESS

    status = F.col("status")
    return t.job_sheet_log.select("sheet_name", status.isin(*IN_PROGRESS).alias("at_work"), (~status.isin(*FINAL)).alias("open"))


@query("FLT08", "SELECT code FROM m_unit WHERE parent_code IS NULL")
def flt08(t):
    from ..operators.graph import roots

    return roots(t.m_unit, "parent_code").select("code")


@query("FLT09", "SELECT f.id FROM fact_codes f WHERE f.unit_code = 'DV003' AND f.box_code = 'BOX0007'")
def flt09(t):
    return staging.resolved_facts(t).where("unit_code = 'DV003' and box_code = 'BOX0007'").select("id")


# Row rules

def long_sql(arms: list[tuple[str, str, str]], view: str = "case_norm") -> str:
    """UNION of (condition, type, field) over a twin view: every error of every row."""
    return " UNION ALL ".join(f"SELECT row_num, '{kind}' AS error_type, '{field}' AS error_field FROM {view} WHERE {cond}" for cond, kind, field in arms)


def every_error(df, made):
    return rules.long_errors(df, rules.error_list(made), "row_num").select("row_num", "error_type", "error_field")


_MISSING = [(f"{c} IS NULL", "REQUIRED_MISSING", c) for c in staging.REQUIRED]


@query("VAL01", f"SELECT row_num, CASE {' '.join(f"WHEN {c} IS NULL THEN '{c}'" for c in staging.REQUIRED)} END AS error_field FROM case_norm WHERE " + " OR ".join(f"{c} IS NULL" for c in staging.REQUIRED))
def val01(t):
    e = rules.first_error(staging.required_rules())
    return staging.accepted(t.stg_case).select("row_num", e["error_field"].alias("error_field")).where("error_field is not null")


@query("VAL02", long_sql(_MISSING))
def val02(t):
    return every_error(staging.accepted(t.stg_case), staging.required_rules())


@query("VAL03", " UNION ALL ".join(f"SELECT row_num, 'REQUIRED_{c.upper()}' AS error_code FROM case_norm WHERE {c} IS NULL" for c in staging.REQUIRED))
def val03(t):
    made = [Rule("required", rules.missing(F.col(c)), "REQUIRED", c, F.col(c), code=f"REQUIRED_{c.upper()}") for c in staging.REQUIRED]
    return rules.long_errors(staging.accepted(t.stg_case), rules.error_list(made), "row_num").select("row_num", "error_code")


@query("VAL04", "SELECT row_num, warehouse IS NULL AS missing_blank_allowed, warehouse IS NULL OR trim(warehouse) = '' AS missing FROM stg_case")
def val04(t):
    w = F.col("warehouse")
    return t.stg_case.select("row_num", rules.missing(w, True).alias("missing_blank_allowed"), rules.missing(w).alias("missing"))


@query("VAL05", "SELECT row_num, doc_date FROM stg_case WHERE trim(doc_date) <> '' AND NOT regexp_full_match(trim(doc_date), '\\d{4}-\\d{2}-\\d{2}')")
def val05(t):
    return t.stg_case.where(rules.bad_iso_date(F.col("doc_date"))).select("row_num", "doc_date")


@query("VAL06", f"SELECT row_num, doc_date FROM stg_case WHERE trim(doc_date) <> '' AND TRY_CAST({staging._iso('doc_date')} AS DATE) IS NULL")
def val06(t):
    return t.stg_case.where(rules.bad_two_form_date(F.col("doc_date"))).select("row_num", "doc_date")


@query("VAL07", long_sql([(staging._BAD_NUMBER.format(c), "INVALID_NUMERIC", c) for c in staging.NUMBERS]))
def val07(t):
    return every_error(staging.accepted(t.stg_case), staging.number_rules())


@query("VAL08", "SELECT c_custkey FROM customer WHERE trunc(c_acctbal) < 0")
def val08(t):
    whole = F.col("c_acctbal").cast("double").cast("int").cast("string")
    return t.customer.where(rules.negative(whole)).select("c_custkey")


@query("VAL09", "SELECT row_num, doc_kind FROM stg_contract WHERE doc_kind NOT IN ('LD','MD','CC','OD','TTK','HDHM','TSBD','KSSV')")
def val09(t):
    kinds = (*keys.LOAN_KINDS, *keys.CARD_KINDS, keys.SAVINGS_KIND)
    return t.stg_contract.where(rules.not_among(F.col("doc_kind"), kinds)).select("row_num", "doc_kind")


@query("VAL10", "SELECT row_num, box_code FROM stg_case WHERE NOT regexp_full_match(box_code, '[A-Z0-9_]+')")
def val10(t):
    return t.stg_case.where(rules.not_like(F.col("box_code"), r"^[A-Z0-9_]+\z")).select("row_num", "box_code")


@query("VAL11", long_sql([(staging._BAD_DATE.format(c), "INVALID_DATE", c) for c in staging.DATES]))
def val11(t):
    return every_error(staging.accepted(t.stg_case), staging.date_rules())


@query("VAL12", "SELECT id FROM messy WHERE TRY_CAST(trim(raw) AS DOUBLE) < 10 OR TRY_CAST(trim(raw) AS DOUBLE) > 5000")
def val12(t):
    return t.messy.where(rules.out_of_range(F.col("raw"), 10, 5000)).select("id")


@query("VAL13", "SELECT id FROM messy WHERE trim(email) <> '' AND NOT regexp_full_match(trim(email), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')")
def val13(t):
    names = [c for c in t.messy.columns if rules.is_email_name(c)]
    return t.messy.where(F.coalesce(*[F.when(rules.bad_email(F.col(c)), True) for c in names], F.lit(False))).select("id")


@query("VAL14", "SELECT id FROM messy WHERE trim(email) <> '' AND NOT regexp_full_match(trim(email), '[\\w.-]+@[\\w.-]+\\.[a-zA-Z]{2,}')")
def val14(t):
    return t.messy.where(rules.bad_email(F.col("email"), rules.LOOSE_EMAIL)).select("id")


@query("VAL15", "SELECT id FROM messy WHERE phone IS NOT NULL AND length(regexp_replace(phone, '[^0-9]', '', 'g')) NOT BETWEEN 10 AND 15")
def val15(t):
    return t.messy.where(rules.bad_phone(F.col("phone"))).select("id")


@query("VAL16", """SELECT id, coalesce(trim(raw) <> '' AND TRY_CAST(trim(raw) AS DOUBLE) IS NULL AND NOT regexp_full_match(trim(raw), '\\d+%'), false) AS not_double,
  coalesce(trim(raw) <> '' AND lower(trim(raw)) NOT IN ('true','yes','y','1','on','enabled','false','no','n','0','off','disabled'), false) AS not_boolean FROM messy""")
def val16(t):
    raw = F.col("raw")
    return t.messy.select("id", rules.not_convertible(raw, "double").alias("not_double"), rules.not_convertible(raw, "boolean").alias("not_boolean"))


@query("VAL17", "SELECT c_custkey, length(c_name) AS n FROM customer WHERE length(c_name) > 15")
def val17(t):
    return t.customer.where(rules.too_long(F.col("c_name"), 15)).select("c_custkey", F.length("c_name").alias("n"))


@query("VAL18", "SELECT id FROM messy WHERE length(trim(field_name)) < 2")
def val18(t):
    return t.messy.where(rules.too_short(F.col("field_name"), 2)).select("id")


@query("VAL19", f"SELECT row_num FROM stg_case WHERE TRY_CAST({staging._iso('handover_date')} AS DATE) < TRY_CAST({staging._iso('due_date')} AS DATE)")
def val19(t):
    return t.stg_case.where(dates.two_forms(F.col("handover_date")) < dates.two_forms(F.col("due_date"))).select("row_num")


_DESTROY = """CASE WHEN retention_class = 'permanent' OR disbursed_on IS NULL THEN DATE '9999-12-31'
  ELSE CAST(disbursed_on + CASE retention_class WHEN 'short' THEN INTERVAL 5 YEAR WHEN 'medium' THEN INTERVAL 10 YEAR ELSE INTERVAL 15 YEAR END AS DATE) END"""


@query("VAL20", f"SELECT row_num, destroy_on FROM stg_contract WHERE destroy_on <> {_DESTROY}")
def val20(t):
    return t.stg_contract.where(F.col("destroy_on") != dates.destruction_date(F.col("retention_class"), F.col("disbursed_on"))).select("row_num", "destroy_on")


@query("VAL21", "SELECT row_num FROM stg_contract WHERE retention_class = 'permanent' AND (destroy_on IS NULL OR year(destroy_on) <> 9999)")
def val21(t):
    return t.stg_contract.where((F.col("retention_class") == "permanent") & (F.col("destroy_on").isNull() | (F.year("destroy_on") != 9999))).select("row_num")


@query("VAL22", "SELECT row_num FROM stg_contract WHERE due_on IS NULL AND (destroy_on IS NULL OR year(destroy_on) <> 9999)")
def val22(t):
    return t.stg_contract.where(F.col("due_on").isNull() & (F.col("destroy_on").isNull() | (F.year("destroy_on") != 9999))).select("row_num")


@query("VAL23", "SELECT row_num FROM stg_case WHERE TRY_CAST(quantity AS INT) <= 0")
def val23(t):
    return t.stg_case.where(F.col("quantity").try_cast("int") <= 0).select("row_num")


@query("VAL24", "SELECT row_num FROM stg_contract WHERE doc_kind NOT IN ('LD','CC') OR retention_class <> 'permanent'")
def val24(t):
    return t.stg_contract.where(~F.col("doc_kind").isin("LD", "CC") | (F.col("retention_class") != "permanent")).select("row_num")


@query("VAL25", "SELECT row_num FROM stg_contract WHERE doc_kind <> 'KSSV' OR retention_class <> 'permanent' OR destroy_on <> DATE '9999-12-31'")
def val25(t):
    last = F.lit(dates.FOREVER).cast("date")
    return t.stg_contract.where((F.col("doc_kind") != "KSSV") | (F.col("retention_class") != "permanent") | (F.col("destroy_on") != last)).select("row_num")


@query("VAL26", "SELECT row_num FROM case_row_error WHERE row_error IS NOT NULL")
def val26(t):
    bad = F.lit(False)
    for r in staging.row_rules():
        bad = bad | F.coalesce(r.bad, F.lit(False))
    return staging.accepted(t.stg_case).where(bad).select("row_num")


_ALL = (
    _MISSING + [(staging._BAD_DATE.format(c), "INVALID_DATE", c) for c in staging.DATES]
    + [(staging._BAD_NUMBER.format(c), "INVALID_NUMERIC", c) for c in staging.NUMBERS]
)
_WORDS = {"REQUIRED_MISSING": "is required", "INVALID_DATE": "is not a date", "INVALID_NUMERIC": "is not a positive number"}


@query("VAL27", "SELECT row_num, nullif(array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{f} {_WORDS[k]}' END" for c, k, f in _ALL) + "] IF x IS NOT NULL], ', '), '') AS messages FROM case_norm")
def val27(t):
    return staging.accepted(t.stg_case).select("row_num", rules.message_text(rules.error_list(staging.row_rules())).alias("messages"))


@query("VAL28", long_sql(_ALL))
def val28(t):
    return every_error(staging.accepted(t.stg_case), list(reversed(staging.number_rules())) + staging.date_rules() + staging.required_rules())


@query("VAL29", "SELECT row_num, error_type, error_field FROM case_checked WHERE error_type IS NOT NULL")
def val29(t):
    return staging.checked_case(t).where("error_type is not null").select("row_num", "error_type", "error_field")


@query("VAL30", "SELECT row_num FROM stg_contract WHERE doc_kind IN ('LD','MD') AND disbursed_on IS NULL")
def val30(t):
    config = {"loans": {"type": "BUSINESS_LOGIC", "condition": "doc_kind IN ('LD', 'MD')", "bad": "disbursed_on is null", "field": "disbursed_on"}}
    return rules.long_errors(t.stg_contract, rules.error_list(rules.rules_from_config(config)), "row_num").select("row_num")


CONTRACT_RULES = {
    "required": {"type": "REQUIRED_FIELDS", "fields": ["contract_no", "unit_code", "disbursed_on"]},
    "kinds": {"type": "ENUM_VALUES", "values": {"doc_kind": [*keys.LOAN_KINDS, *keys.CARD_KINDS, keys.SAVINGS_KIND]}},
    "numbers": {"type": "PATTERN", "patterns": {"contract_no": r"^HD0\d+\z"}},
    "off": {"type": "REQUIRED_FIELDS", "fields": ["due_on"], "enabled": False},
    "permanent": {"type": "BUSINESS_LOGIC", "bad": "retention_class = 'permanent' and year(destroy_on) <> 9999", "field": "destroy_on"},
}


@query("VAL31", long_sql([
    ("disbursed_on IS NULL", "REQUIRED_MISSING", "disbursed_on"), ("doc_kind = 'ZZ'", "INVALID_ENUM", "doc_kind"),
    ("NOT regexp_full_match(contract_no, 'HD0\\d+')", "INVALID_PATTERN", "contract_no"),
    ("retention_class = 'permanent' AND year(destroy_on) <> 9999", "BUSINESS_RULE", "destroy_on")], "stg_contract"))
def val31(t):
    columns = {c: F.col(c).cast("string") for c in ("contract_no", "unit_code", "disbursed_on", "due_on", "doc_kind")}
    return every_error(t.stg_contract, rules.rules_from_config(CONTRACT_RULES, columns))


@query("VAL32", "SELECT row_num, 'ERROR' AS severity FROM stg_case WHERE unit_code IS NULL UNION ALL SELECT row_num, 'WARNING' FROM stg_case WHERE box_status IS NULL")
def val32(t):
    made = [
        Rule("unit", F.col("unit_code").isNull(), "REQUIRED_MISSING", "unit_code"),
        Rule("status", F.col("box_status").isNull(), "EMPTY", "box_status", severity="WARNING"),
    ]
    return rules.long_errors(t.stg_case, rules.error_list(made), "row_num").select("row_num", "severity")


@query("VAL33", "SELECT CAST(count(*) AS BIGINT) AS errors, count(*) > 1000 AS over_budget FROM case_checked WHERE error_type IS NOT NULL")
def val33(t):
    return rules.over_budget(staging.checked_case(t).where("error_type is not null"), 1000)


@query("VAL34", "SELECT job_id, CAST(count(*) AS BIGINT) AS n FROM job_sheet_log GROUP BY job_id HAVING count(*) > 10")
def val34(t):
    return t.job_sheet_log.groupBy("job_id").agg(F.count("*").alias("n")).where("n > 10")


@query("VAL35", "SELECT count(*) > 100 AS too_many, count(*) = 0 AS empty FROM (SELECT 1 FROM stg_case LIMIT 101)")
def val35(t):
    # The limit is the feature: reading stops once the row limit is known to be passed.
    return t.stg_case.select("row_num").limit(101).agg((F.count("*") > 100).alias("too_many"), (F.count("*") == 0).alias("empty"))


@query("VAL36", """SELECT doc_kind, CAST(count(*) * 12 AS BIGINT) AS cells, CASE WHEN count(*) * 12 > 2000000 THEN 'write as text' WHEN count(*) * 12 > 10000 THEN 'stream' ELSE 'whole' END AS advice FROM stg_contract GROUP BY doc_kind""")
def val36(t):
    cells = F.count("*") * len(t.stg_contract.columns)
    advice = F.when(cells > 2_000_000, "write as text").when(cells > 10_000, "stream").otherwise("whole")
    return t.stg_contract.groupBy("doc_kind").agg(cells.alias("cells"), advice.alias("advice"))


@query("VAL37", "SELECT code FROM m_unit WHERE code NOT IN (SELECT upper(unit_code) FROM stg_case WHERE unit_code IS NOT NULL AND row_num < 100)")
def val37(t):
    counted = t.stg_case.where("row_num < 100 and unit_code is not null").select(F.upper("unit_code").alias("code")).distinct()
    return t.m_unit.select("code").join(counted, "code", "left_anti")


# Scalars

def scalar(name: str, expression, sql: str, source: str = "messy", key: str = "id"):
    def f(t):
        return getattr(t, source).select(key, expression().alias("value"))

    query(name, f"SELECT {key}, {sql} AS value FROM {source}")(f)


_T = "trim(raw)"
_PARSED = (
    f"CASE WHEN regexp_full_match({_T}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST({_T} AS DATE) "
    f"WHEN regexp_full_match({_T}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(coalesce(CASE WHEN regexp_full_match({_T}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN try_strptime({_T}, '%d/%m/%Y') END, try_strptime({_T}, '%m/%d/%Y')) AS DATE) END"
)
scalar("SCA01", lambda: text.normal_text(F.col("raw")), "nullif(upper(trim(raw)), '')")
scalar("SCA02", lambda: text.blank_to_null(F.col("warehouse")), "nullif(trim(warehouse), '')", "stg_case", "row_num")
scalar("SCA03", lambda: dates.slashed_to_iso(F.col("doc_date")), "CASE WHEN regexp_full_match(trim(doc_date), '\\d{2}/\\d{2}/\\d{4}') THEN substr(trim(doc_date), 7, 4) || '-' || substr(trim(doc_date), 4, 2) || '-' || substr(trim(doc_date), 1, 2) ELSE trim(doc_date) END", "stg_case", "row_num")
scalar("SCA04", lambda: dates.iso_text(F.col("raw")), f"coalesce(CAST({_PARSED} AS VARCHAR), trim(raw))")
scalar("SCA05", lambda: numbers.number_text(F.col("raw")), "regexp_replace(trim(raw), '[,\\s]', '', 'g')")
scalar("SCA07", lambda: numbers.to_whole(F.col("raw")), f"CASE WHEN contains({_T}, '.') THEN TRY_CAST(trunc(TRY_CAST({_T} AS DOUBLE)) AS INT) WHEN regexp_full_match({_T}, '[+-]?\\d+') THEN TRY_CAST({_T} AS INT) END")
scalar("SCA08", lambda: F.round(numbers.to_double(F.col("raw")), 6), f"round(CASE WHEN ends_with({_T}, '%') THEN TRY_CAST(rtrim({_T}, '%') AS DOUBLE) / 100 ELSE TRY_CAST({_T} AS DOUBLE) END, 6)")
scalar("SCA09", lambda: F.round(numbers.to_decimal(F.col("raw")).cast("double"), 6), f"round(CASE WHEN ends_with({_T}, '%') THEN TRY_CAST(rtrim({_T}, '%') AS DOUBLE) / 100 ELSE TRY_CAST({_T} AS DOUBLE) END, 6)")
scalar("SCA10", lambda: numbers.to_boolean(F.col("raw")), f"CASE WHEN lower({_T}) IN ('true','yes','y','1','on','enabled') THEN true WHEN lower({_T}) IN ('false','no','n','0','off','disabled') THEN false END")
scalar("SCA11", lambda: dates.to_date(F.col("raw")), _PARSED)
scalar("SCA12", lambda: dates.to_timestamp(F.col("raw")).cast("timestamp_ntz"), f"CAST({_PARSED} AS TIMESTAMP)")
scalar("SCA14", lambda: F.col("raw").try_cast("double"), "TRY_CAST(raw AS DOUBLE)")
scalar("SCA15", lambda: dates.from_serial(F.col("serial")), "CASE WHEN CAST(serial AS INT) >= 1 THEN CAST(DATE '1899-12-30' + CAST(CASE WHEN CAST(serial AS INT) < 61 THEN CAST(serial AS INT) + 1 ELSE CAST(serial AS INT) END AS INTEGER) AS DATE) END")
scalar("SCA16", lambda: dates.full_year(F.col("short_date")), "regexp_replace(short_date, '/(\\d\\d)$', CASE WHEN CAST(right(short_date, 2) AS INT) <= 30 THEN '/20\\1' ELSE '/19\\1' END)")
scalar("SCA17", lambda: dates.named_month_date(F.concat(F.lit("7-"), F.element_at(F.array(*map(F.lit, ("Jan", "february", "Tháng 3", "Sept", "xx"))), (F.col("id") % 5 + 1).cast("int")), F.lit("-"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"))),
       "CASE WHEN id % 5 < 4 THEN make_date(CASE WHEN id % 100 <= 30 THEN 2000 ELSE 1900 END + id % 100, [1, 2, 3, 9][CAST(id % 5 + 1 AS INT)], 7) END")
scalar("SCA18", lambda: text.identifier_text(F.col("raw")), f"CASE WHEN {_T} = '1.5E+11' THEN '150000000000' WHEN regexp_full_match({_T}, '\\d+\\.0+') THEN regexp_replace({_T}, '\\.0+$', '') ELSE {_T} END")
scalar("SCA19", lambda: text.looks_like_identifier(F.col("raw")), f"regexp_full_match({_T}, '\\d{{9,15}}(\\.0+)?') OR regexp_full_match({_T}, '\\d+(\\.\\d+)?[eE]\\+?\\d+')")
scalar("SCA20", lambda: text.plain_name(F.col("heading")), "CASE id % 3 WHEN 0 THEN 'so hop đong' WHEN 1 THEN 'ma đon vi' ELSE 'ngay giai ngan' END")
scalar("SCA21", lambda: text.code_from_name(F.col("box_status")), "upper(replace(coalesce(box_status, 'UNKNOWN'), ' ', '_'))", "stg_case", "row_num")
scalar("SCA22", lambda: dates.two_forms(F.nullif(F.col("handover_date"), F.lit(""))), "TRY_CAST(nullif(handover_date, '') AS DATE)", "stg_case", "row_num")
scalar("SCA23", lambda: text.column_index(F.col("letters")), "CASE letters WHEN 'AB' THEN 27 WHEN 'z' THEN 25 ELSE 702 END")
scalar("SCA24", lambda: text.title_from_field(F.col("field_name")), "CASE field_name WHEN 'clickCount' THEN 'Click Count' WHEN 'userIdentityCard' THEN 'User Identity Card' WHEN 'x' THEN 'X' ELSE 'Total Rows' END")


@query("SCA06", f"SELECT row_num, {staging._iso('doc_date')} AS doc_date, nullif(regexp_replace(trim(quantity), '[,\\s]', '', 'g'), '') AS quantity, nullif(upper(trim(warehouse)), '') AS warehouse FROM stg_case")
def sca06(t):
    return staging.normalised(t.stg_case).select("row_num", "doc_date", "quantity", "warehouse")


@query("SCA13", "SELECT id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'VIEW' WHEN 'purchase' THEN 'Purchase' END AS value FROM messy")
def sca13(t):
    members = ("click", "VIEW", "Purchase")
    exact = F.create_map(*[F.lit(x) for m in members for x in (m, m)])
    folded = F.create_map(*[F.lit(x) for m in members for x in (m.lower(), m)])
    return t.messy.select("id", F.coalesce(F.try_element_at(exact, F.col("event_type")), F.try_element_at(folded, F.lower("event_type"))).alias("value"))


@query("DER01", "SELECT row_num, coalesce(unit_code, '') || '_' || coalesce(box_code, '') || '_' || coalesce(doc_date, '') || '_' || coalesce(quantity, '') AS business_key FROM case_norm")
def der01(t):
    return staging.accepted(t.stg_case).select("row_num", keys.joined_key(*[F.col(k) for k in staging.KEY]).alias("business_key"))


@query("DER02", """SELECT row_num, CASE WHEN doc_kind IN ('LD','MD','OD','HDHM','KSSV') THEN contract_no || '_' || doc_kind || '_' || coalesce(CAST(disbursed_on AS VARCHAR), '')
  WHEN doc_kind IN ('CC','TSBD') THEN contract_no || '_' || doc_kind || '_' || customer_cif
  WHEN doc_kind = 'TTK' THEN contract_no || '_' || doc_kind || '_' || customer_cif || '_' || unit_code || '_' || coalesce(CAST(disbursed_on AS VARCHAR), '')
  ELSE contract_no || '_' || doc_kind END AS business_key FROM stg_contract""")
def der02(t):
    return prj03(t).select("row_num", "business_key")


@query("DER03", "SELECT row_num, customer_cif || '_' || coalesce(CAST(disbursed_on AS VARCHAR), '') || '_' || doc_kind AS business_key FROM stg_contract")
def der03(t):
    return t.stg_contract.select("row_num", keys.joined_key(F.col("customer_cif"), F.col("disbursed_on"), F.col("doc_kind")).alias("business_key"))


@query("DER04", f"SELECT row_num, {_DESTROY} AS destroy_on FROM stg_contract")
def der04(t):
    return t.stg_contract.select("row_num", dates.destruction_date(F.col("retention_class"), F.col("disbursed_on")).alias("destroy_on"))


@query("DER05", "SELECT row_num, CASE WHEN length(customer_name) > 4 THEN left(customer_name, 2) || repeat('*', CAST(length(customer_name) - 4 AS INT)) || right(customer_name, 2) ELSE customer_name END AS customer_name FROM stg_contract")
def der05(t):
    return t.stg_contract.select("row_num", text.masked(F.col("customer_name")).alias("customer_name"))


@query("DER06", "SELECT row_num, retention_years || ' năm' AS description FROM stg_case")
def der06(t):
    return t.stg_case.select("row_num", F.concat("retention_years", F.lit(" năm")).alias("description"))


# Contracts: one dataset per region of the nations, one column per nation

_EXPECTED = "SELECT 'D' || CAST(n_regionkey AS STRING) AS dataset, n_name AS \"column\", CAST(n_nationkey AS INT) AS position, n_nationkey % 3 <> 0 AS required FROM nation"
_ACTUAL = "SELECT 'D' || CAST(n_regionkey AS STRING) AS dataset, CASE WHEN n_nationkey % 7 = 1 THEN 'X_' || n_name ELSE n_name END AS \"column\", CAST(CASE WHEN n_nationkey % 5 = 2 THEN 100 - n_nationkey ELSE n_nationkey END AS INT) AS position FROM nation"


def _tables(t):
    n = t.nation.withColumn("dataset", F.concat(F.lit("D"), F.col("n_regionkey").cast("string")))
    k = F.col("n_nationkey")
    expected = n.select("dataset", F.col("n_name").alias("column"), k.cast("int").alias("position"), (k % 3 != 0).alias("required"))
    name = F.when(k % 7 == 1, F.concat(F.lit("X_"), "n_name")).otherwise(F.col("n_name"))
    return expected, n.select("dataset", name.alias("column"), F.when(k % 5 == 2, 100 - k).otherwise(k).cast("int").alias("position"))


@query("CON01", f'WITH e AS ({_EXPECTED}), a AS ({_ACTUAL}) SELECT dataset, "column" FROM e WHERE required AND NOT EXISTS (SELECT 1 FROM a WHERE a.dataset = e.dataset AND a."column" = e."column")')
def con01(t):
    return contract.missing_columns(*_tables(t))


@query("CON02", f"""WITH e AS ({_EXPECTED}), a AS ({_ACTUAL}) SELECT * EXCLUDE b FROM (SELECT e.dataset, e."column", e.position AS expected, a.position AS found,
  lag(a.position) OVER (PARTITION BY e.dataset ORDER BY e.position) AS b FROM e JOIN a ON a.dataset = e.dataset AND a."column" = e."column") WHERE b > found""")
def con02(t):
    return contract.out_of_order(*_tables(t))


@query("CON03", f'WITH e AS ({_EXPECTED}), a AS ({_ACTUAL}) SELECT dataset, "column" FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE a.dataset = e.dataset AND a."column" = e."column")')
def con03(t):
    return contract.unexpected_columns(*_tables(t))


@query("CON04", """SELECT row_num, 'warehouse' AS "column", warehouse AS value, 'REQUIRED_MISSING' AS error_type FROM stg_case WHERE warehouse IS NULL OR trim(warehouse) = ''
UNION ALL SELECT row_num, 'unit_code', unit_code, 'REQUIRED_MISSING' FROM stg_case WHERE unit_code IS NULL
UNION ALL SELECT row_num, 'box_status', box_status, 'FIELD_TOO_LONG' FROM stg_case WHERE length(box_status) > 8
UNION ALL SELECT row_num, 'area', area, 'INVALID_PATTERN' FROM stg_case WHERE NOT regexp_matches(area, '^area_[01]$')
UNION ALL SELECT row_num, 'quantity', quantity, 'DATA_TYPE' FROM stg_case WHERE quantity = '1x'""")
def con04(t):
    spec = [("case", "warehouse", 1, True, None, None, "string"), ("case", "unit_code", 2, True, None, None, "string"), ("case", "box_status", 3, False, 8, None, "string"),
            ("case", "area", 4, False, None, "^area_[01]$", "string"), ("case", "quantity", 5, True, None, None, "int")]
    table = t.spark.createDataFrame(spec, contract.CONTRACT)
    return contract.cell_errors(t.stg_case, table, ["row_num"], [s[1] for s in spec])


@query("CON05", "SELECT CAST(count(DISTINCT sheet) AS BIGINT) AS sheets, CAST(count(DISTINCT (sheet, row_no)) FILTER (row_no > 1 AND value IS NOT NULL) AS BIGINT) AS data_rows FROM cell_table")
def con05(t):
    filled = F.when((F.col("row_no") > 1) & F.col("value").isNotNull(), F.struct("sheet", "row_no"))
    return t.cell_table.agg(F.count_distinct("sheet").alias("sheets"), F.count_distinct(filled).alias("data_rows"))


@query("CON06", "SELECT DISTINCT sheet, sheet IN ('R0', 'R2') AS allowed FROM cell_table")
def con06(t):
    return t.cell_table.select("sheet").distinct().withColumn("allowed", F.col("sheet").isin("R0", "R2"))


@query("CON07")
def con07(t):
    made = None
    for name in ("customer", "orders", "lineitem"):
        one = contract.contract_frame(t.spark, name, getattr(t, name).schema)
        made = one if made is None else made.unionByName(one)
    return made


@query("CON08", "SELECT n_nationkey, n_name FROM nation")
def con08(t):
    table = t.spark.createDataFrame([("nation", "n_nationkey", 1, True, None, None, "int"), ("nation", "n_name", 2, True, None, None, "string")], contract.CONTRACT)
    rows, _ = contract.read_if_valid(t.spark, lambda s, p: s.read.parquet(p), f"{t.folder}/nation.parquet", table, "nation")
    return rows.select("n_nationkey", "n_name")
