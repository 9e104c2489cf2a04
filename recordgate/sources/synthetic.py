"""Synthetic records at any count: every column from a hash of the row's number, unique ones by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words the records are made of.
FIRST = ("An", "Binh", "Chi", "Dung", "Giang", "Hoa", "Khanh", "Lan", "Minh", "Nga", "Phong", "Quang")
LAST = ("Nguyen", "Tran", "Le", "Pham", "Hoang", "Vu", "Dang", "Bui", "Do", "Ngo")
DEPARTMENTS = ("Finance", "Operations", "Risk", "Sales", "Support", "Technology")
ROLES = ("ADMIN", "AUDITOR", "CLERK", "MANAGER", "OWNER", "VIEWER")
ACTIONS = ("READ", "CREATE", "UPDATE", "DELETE", "EXPORT")
RESOURCES = ("USER", "ROLE", "CASE", "BOX", "UNIT", "REPORT")


def _hash(salt: str, modulus: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(modulus))


def _pick(words, salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (_hash(salt, len(words)) + 1).cast("int"))


def users(spark: SparkSession, n: int, today: str = "2025-01-01") -> DataFrame:
    """Unique id and 12-digit card, 18 to 65 years old, pay of 20 to 200 million in steps of 100 000, made in the last two years."""
    first, last = _pick(FIRST, "first"), _pick(LAST, "last")
    day = F.lit(today).cast("date")
    return spark.range(n).select(
        F.format_string("U%010d", "id").alias("id"), F.format_string("%012d", F.col("id") + 10**11).alias("identity_card"), first.alias("first_name"), last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), F.col("id").cast("string"), F.lit("@mail.example")).alias("email"),
        F.concat(F.lit("09"), F.lpad(_hash("phone", 10**8).cast("string"), 8, "0")).alias("phone"),
        F.date_sub(day, (18 * 366 + _hash("born", 46 * 365)).cast("int")).alias("birth_date"),
        ((_hash("pay", 1801) + 200) * 100_000).cast("double").alias("salary"), _pick(DEPARTMENTS, "department").alias("department"),
        F.date_sub(day, _hash("made", 730).cast("int")).cast("timestamp").alias("created_at"),
    )


def _named(words, n_words: int) -> Column:
    known = F.element_at(F.array(*map(F.lit, words)), (F.col("id") % n_words + 1).cast("int"))
    return F.when(F.col("id") < n_words, known).otherwise(F.concat(known, F.lit("_"), F.floor(F.col("id") / n_words).cast("string")))


def roles(spark: SparkSession, n: int) -> DataFrame:
    """Unique names: the list first, then the list with numbers."""
    return spark.range(n).select(F.format_string("R%06d", "id").alias("id"), _named(ROLES, len(ROLES)).alias("name"), (_hash("on", 10) > 0).alias("is_active"))


def permissions(spark: SparkSession, n: int) -> DataFrame:
    """Unique codes: every action on every resource, then these with numbers."""
    both = len(ACTIONS) * len(RESOURCES)
    place = F.col("id") % both
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (place % len(ACTIONS) + 1).cast("int"))
    resource = F.element_at(F.array(*map(F.lit, RESOURCES)), (F.floor(place / len(ACTIONS)) + 1).cast("int"))
    number = F.when(F.col("id") < both, "").otherwise(F.concat(F.lit("_"), F.floor(F.col("id") / both).cast("string")))
    return spark.range(n).select(F.format_string("P%06d", "id").alias("id"), F.concat(action, F.lit("_"), resource, number).alias("code"), action.alias("type"), resource.alias("resource"))


def cases(spark: SparkSession, n: int) -> DataFrame:
    """Rows of the flat schema, by arithmetic on the row's number."""
    i = F.col("id")
    start = F.lit("2024-01-01").cast("date")
    on = lambda days: F.date_format(F.date_add(start, (i % 3650).cast("int") + days), "yyyy-MM-dd")
    return spark.range(n).select(
        (i + 2).alias("row_num"), F.lit("KHO_HN").alias("warehouse"), F.format_string("DV%03d", i % 100 + 1).alias("unit_code"),
        F.concat(F.lit("LOAI_"), (i % 5 + 1).cast("string")).alias("doc_type"), on(0).alias("doc_date"), (i % 10 + 1).cast("string").alias("quantity"),
        on(30).alias("due_date"), on(32).alias("handover_date"), F.format_string("BOX%06d", i).alias("box_code"), (i % 10 + 5).cast("string").alias("retention_years"),
        F.when(i % 20 == 0, "YES").otherwise("NO").alias("lost"), F.concat(F.lit("KV_"), (i % 3 + 1).cast("string")).alias("area"),
        (i % 5 + 1).cast("string").alias("shelf_row"), (i % 10 + 1).cast("string").alias("shelf_col"), F.lit("STORED").alias("box_status"),
    )
