"""The flat migration: normalise, check, apply, reconcile (one plan each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import apply, dedupe, refs, rules
from ..operators.rules import Rule
from .registry import TWIN_VIEWS, Source

REQUIRED = ("warehouse", "unit_code", "doc_type", "doc_date", "quantity", "box_code", "retention_years")
DATES = ("doc_date", "due_date", "handover_date")
NUMBERS = ("quantity", "retention_years", "shelf_row", "shelf_col")
NAMES = ("warehouse", "unit_code", "doc_type", "box_code", "area", "box_status")
KEY = ("unit_code", "box_code", "doc_date", "quantity")


def normal_columns() -> dict[str, Column]:
    """Codes and names in upper case without outer blanks, dates as yyyy-MM-dd, numbers as digits; blank is null."""
    made = {c: text.normal_text(F.col(c)) for c in NAMES}
    made |= {c: F.nullif(dates.slashed_to_iso(F.col(c)), F.lit("")) for c in DATES}
    return made | {c: F.nullif(numbers.number_text(F.col(c)), F.lit("")) for c in NUMBERS}


def normalised(raw: DataFrame) -> DataFrame:
    return raw.withColumns(normal_columns())


def day(c: str) -> Column:
    """Date of a normalised column; null if it is none."""
    return F.when(F.col(c).rlike(dates.ISO), F.col(c).try_cast("date"))


def whole(c: str) -> Column:
    """Number of a normalised column of digits; null if it has others."""
    return F.when(F.col(c).rlike(r"^\d+\z"), F.col(c).try_cast("int"))


# Row rules are for normalised rows, in which blank is null and dates are of one form.

def required_rules(columns=REQUIRED) -> list[Rule]:
    return [Rule("required", F.col(c).isNull(), "REQUIRED_MISSING", c, F.col(c), f"{c} is required", "VAL001", rules.REQUIRED) for c in columns]


def date_rules(columns=DATES, made=day) -> list[Rule]:
    return [Rule("date", F.col(c).isNotNull() & made(c).isNull(), "INVALID_DATE", c, F.col(c), f"{c} is not a date", "VAL002", rules.DATE) for c in columns]


def number_rules(columns=NUMBERS, made=whole) -> list[Rule]:
    bad = lambda c: F.col(c).isNotNull() & ~F.coalesce(made(c) > 0, F.lit(False))
    return [Rule("numeric", bad(c), "INVALID_NUMERIC", c, F.col(c), f"{c} is not a positive number", "VAL004", rules.NUMERIC) for c in columns]


def row_rules(day_of=day, whole_of=whole) -> list[Rule]:
    return required_rules() + date_rules(made=day_of) + number_rules(made=whole_of)


def accepted(raw: DataFrame) -> DataFrame:
    """Normalised rows that were read without a conversion error."""
    return normalised(raw.where("parse_errors is null"))


def _numbered_rules() -> list[Rule]:
    """Row rules in order, on the columns that numbered() makes."""
    return rules.in_order(row_rules(lambda c: F.col(f"__day_{c}"), lambda c: F.col(f"__whole_{c}")))


def numbered(raw: DataFrame) -> DataFrame:
    """Normalised rows of raw that were read without an error + __alone, __n: the number of the first row rule broken, 0 for clean rows.

    Rows are dealt by their key before anything else is asked of them: that spreads a batch
    that came in one piece, and the window that looks for repeats needs the same dealing.  So only the key is normalised before
    that, the other columns after it, and days and numbers, which several rules read, are made once.
    Rows without a whole key are rejects, and are dealt by row number, which is __alone.
    """
    normal = normal_columns()
    rows = raw.where("parse_errors is null").withColumns({k: normal[k] for k in KEY})
    incomplete = F.greatest(*[F.col(k).isNull() for k in KEY])
    dealt = rows.withColumn("__alone", F.when(incomplete, F.col("row_num"))).repartition("job_id", *KEY, "__alone")
    dealt = dealt.withColumns({c: how for c, how in normal.items() if c not in KEY})
    typed = dealt.withColumns({f"__day_{c}": day(c) for c in DATES} | {f"__whole_{c}": whole(c) for c in NUMBERS})
    return typed.select(*dealt.columns, rules.first_number(_numbered_rules()).alias("__n"))


def repeats(raw: DataFrame) -> DataFrame:
    """row_num, first_row: clean rows of raw whose job and key a clean row of a lesser number has."""
    clean = F.col("__n") == 0
    first = numbered(raw).select("job_id", "row_num", *KEY, "__alone", "__n")
    marked = dedupe.mark_repeats(first, [F.col("job_id"), *[F.col(k) for k in KEY], F.col("__alone"), clean])
    return marked.where(clean & (F.col("place") > 1)).select("row_num", "first_row")


def checked(raw: DataFrame, warehouses: DataFrame, units: DataFrame, kinds: DataFrame, periods: DataFrame, facts: DataFrame) -> DataFrame:
    """Normalised rows of raw that were read without an error + error_type, error_field: the first error in order of the steps, null for valid rows.

    Rows come dealt by key and with the number of the rule they break, from numbered(); only clean ones can be the first of
    a key, so the window tells them apart; references and existing facts are left joins with a mark.
    One plan, one scan, one error a row.
    """
    made = _numbered_rules()
    first = numbered(raw)
    clean = F.col("__n") == 0
    marked = dedupe.mark_repeats(first, [F.col("job_id"), *[F.col(k) for k in KEY], F.col("__alone"), clean])
    marked = refs.with_presence(marked, refs.active(warehouses), F.col("warehouse"), "code", "__w")
    marked = refs.with_presence(marked, refs.active(units), F.col("unit_code"), "code", "__u")
    marked = refs.with_presence(marked, refs.active(kinds), F.col("doc_type"), "name", "__d")
    marked = refs.with_presence(marked, refs.active(periods), F.col("retention_years").try_cast("int"), "years", "__r")
    known = facts.select("unit_code", "box_code", F.col("doc_date").cast("string").alias("doc_date"), F.col("quantity").cast("string").alias("quantity"))
    marked = marked.join(known.distinct().withColumn("__f", F.lit(True)), list(KEY), "left")
    named = lambda texts: F.element_at(F.array(*map(F.lit, texts)), F.greatest(F.col("__n"), F.lit(1)))
    kind: Column = (
        F.when(~clean, named([r.error_type for r in made])).when(F.col("place") > 1, "DUP_IN_FILE")
        .when(~F.col("__w") | ~F.col("__u") | ~F.col("__d") | ~F.col("__r"), "REF_NOT_FOUND").when(F.col("__f"), "DUP_IN_DB")
    )
    field = (
        F.when(~clean, named([r.field for r in made])).when(F.col("place") > 1, "business_key").when(~F.col("__w"), "warehouse")
        .when(~F.col("__u"), "unit_code").when(~F.col("__d"), "doc_type").when(~F.col("__r"), "retention_years").when(F.col("__f"), "business_key")
    )
    return marked.select(*raw.columns, kind.alias("error_type"), field.alias("error_field"))


def resolved_facts(t: Source) -> DataFrame:
    return refs.resolved_facts(t.case_fact, t.m_unit, t.m_box)


def checked_case(t: Source) -> DataFrame:
    return checked(t.stg_case, t.m_warehouse, t.m_unit, t.m_doc_type, t.m_retention, resolved_facts(t))


def valid_rows(checked_rows: DataFrame) -> DataFrame:
    """Typed projection of the rows without an error."""
    return checked_rows.where("error_type is null").select(
        "job_id", "row_num", "warehouse", "unit_code", "doc_type", day("doc_date").alias("doc_date"), whole("quantity").alias("quantity"),
        day("due_date").alias("due_date"), day("handover_date").alias("handover_date"), "box_code", whole("retention_years").alias("retention_years"),
        "area", "shelf_row", "shelf_col", "box_status",
    )


def applied_facts(valid: DataFrame, t: Source) -> DataFrame:
    """Facts of valid rows with the ids of their dimensions; unit, warehouse and kind must be there, the rest may lack."""
    facts = apply.resolve(valid, t.m_warehouse, {"warehouse": "code"}, "warehouse_id")
    facts = apply.resolve(facts, t.m_unit, {"unit_code": "code"}, "unit_id")
    facts = apply.resolve(facts, t.m_doc_type, {"doc_type": "name"}, "doc_type_id")
    facts = apply.resolve(facts, t.m_retention, {"retention_years": "years"}, "retention_id", "left")
    facts = apply.resolve(facts, t.m_box, {"box_code": "code"}, "box_id", "left")
    facts = facts.withColumn("status_code", text.code_from_name(F.col("box_status")))
    return apply.resolve(facts, t.m_status, {"status_code": "code"}, "status_id", "left", kind="BOX")


def _iso(c: str) -> str:
    t = f"trim({c})"
    return f"nullif(CASE WHEN regexp_full_match({t}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN substr({t}, 7, 4) || '-' || substr({t}, 4, 2) || '-' || substr({t}, 1, 2) ELSE {t} END, '')"


_BAD_DATE = "({0} IS NOT NULL AND (NOT regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR TRY_CAST({0} AS DATE) IS NULL))"
_BAD_NUMBER = "({0} IS NOT NULL AND (NOT regexp_full_match({0}, '\\d+') OR coalesce(TRY_CAST({0} AS INT), 0) <= 0))"


def _ladder(value: str) -> str:
    """CASE arms in order of the row rules; value makes what an arm gives, from kind and column."""
    arms = [f"WHEN {c} IS NULL THEN " + value.format("REQUIRED_MISSING", c) for c in REQUIRED]
    arms += [f"WHEN {_BAD_DATE.format(c)} THEN " + value.format("INVALID_DATE", c) for c in DATES]
    arms += [f"WHEN {_BAD_NUMBER.format(c)} THEN " + value.format("INVALID_NUMERIC", c) for c in NUMBERS]
    return "CASE " + " ".join(arms) + " END"


TWIN_VIEWS["case_norm"] = (
    "SELECT job_id, row_num, parse_errors, "
    + ", ".join(f"nullif(upper(trim({c})), '') AS {c}" for c in NAMES) + ", "
    + ", ".join(f"{_iso(c)} AS {c}" for c in DATES) + ", "
    + ", ".join(f"nullif(regexp_replace(trim({c}), '[,\\s]', '', 'g'), '') AS {c}" for c in NUMBERS)
    + " FROM stg_case WHERE parse_errors IS NULL"
)
TWIN_VIEWS["case_row_error"] = f"SELECT *, {_ladder("'{0}'")} AS row_error, {_ladder("'{1}'")} AS row_field FROM case_norm"
TWIN_VIEWS["fact_codes"] = """SELECT f.*, u.code AS unit_code, b.code AS box_code FROM case_fact f JOIN m_unit u ON f.unit_id = u.id JOIN m_box b ON f.box_id = b.id"""
TWIN_VIEWS["case_ranked"] = """SELECT *, row_number() OVER (PARTITION BY job_id, unit_code, box_code, doc_date, quantity ORDER BY row_num) AS place,
  first_value(row_num) OVER (PARTITION BY job_id, unit_code, box_code, doc_date, quantity ORDER BY row_num) AS first_row FROM case_row_error WHERE row_error IS NULL"""
TWIN_VIEWS["case_checked"] = """SELECT * EXCLUDE (row_error, row_field), row_error AS error_type, row_field AS error_field FROM case_row_error WHERE row_error IS NOT NULL
UNION ALL BY NAME
SELECT * EXCLUDE (row_error, row_field, place, first_row, w, u, d, r, f),
  CASE WHEN place > 1 THEN 'DUP_IN_FILE' WHEN NOT (w AND u AND d AND r) THEN 'REF_NOT_FOUND' WHEN f THEN 'DUP_IN_DB' END AS error_type,
  CASE WHEN place > 1 THEN 'business_key' WHEN NOT w THEN 'warehouse' WHEN NOT u THEN 'unit_code' WHEN NOT d THEN 'doc_type' WHEN NOT r THEN 'retention_years' WHEN f THEN 'business_key' END AS error_field
FROM (SELECT *, EXISTS (SELECT 1 FROM m_warehouse m WHERE m.is_active AND m.code = warehouse) AS w, EXISTS (SELECT 1 FROM m_unit m WHERE m.is_active AND m.code = unit_code) AS u,
  EXISTS (SELECT 1 FROM m_doc_type m WHERE m.is_active AND m.name = doc_type) AS d, EXISTS (SELECT 1 FROM m_retention m WHERE m.is_active AND m.years = TRY_CAST(retention_years AS INT)) AS r,
  EXISTS (SELECT 1 FROM fact_codes k WHERE k.unit_code = c.unit_code AND k.box_code = c.box_code AND CAST(k.doc_date AS VARCHAR) = c.doc_date AND CAST(k.quantity AS VARCHAR) = c.quantity) AS f
  FROM case_ranked c)"""
TWIN_VIEWS["case_valid"] = """SELECT job_id, row_num, warehouse, unit_code, doc_type, TRY_CAST(doc_date AS DATE) AS doc_date, TRY_CAST(quantity AS INT) AS quantity,
  TRY_CAST(due_date AS DATE) AS due_date, TRY_CAST(handover_date AS DATE) AS handover_date, box_code, TRY_CAST(retention_years AS INT) AS retention_years,
  area, shelf_row, shelf_col, box_status FROM case_checked WHERE error_type IS NULL"""
