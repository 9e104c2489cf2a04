"""Row rules: conditions on columns that make entries of an error list.

A rule set is one projection: every rule gives a struct or null, so a scan with a
dozen rules costs one pass.  What needs other rows (duplicates, references) is in the
modules for these, and sees only rows that are clean so far.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import is_blank, trimmed

ERROR = "struct<error_type:string,error_field:string,error_value:string,error_message:string,error_code:string,severity:string>"
#: Order in which kinds of rules are asked.
REQUIRED, DATE, NUMERIC, ENUM, PATTERN, BUSINESS = 10, 20, 25, 30, 40, 50


@dataclass(frozen=True)
class Rule:
    """bad: condition for an error; null counts as no error.  field and value name what is wrong."""

    name: str
    bad: Column
    error_type: str
    field: str = ""
    value: Column | None = None
    message: str = ""
    code: str = ""
    priority: int = BUSINESS
    enabled: bool = True
    severity: str = "ERROR"

    def error(self) -> Column:
        value = F.lit(None).cast("string") if self.value is None else self.value.cast("string")
        texts = (self.error_type, self.field, self.message, self.code or self.error_type, self.severity)
        kind, field, message, code, severity = map(F.lit, texts)
        made = F.struct(
            kind.alias("error_type"), field.alias("error_field"), value.alias("error_value"), message.alias("error_message"),
            code.alias("error_code"), severity.alias("severity"),
        )
        return F.when(F.coalesce(self.bad, F.lit(False)), made)


def in_order(rules: list[Rule]) -> list[Rule]:
    return sorted((r for r in rules if r.enabled), key=lambda r: r.priority)


def error_list(rules: list[Rule]) -> Column:
    """All errors of a row, by priority."""
    ready = in_order(rules)
    return F.array_compact(F.array(*[r.error() for r in ready])) if ready else F.array().cast(f"array<{ERROR}>")


def first_error(rules: list[Rule]) -> Column:
    """The first error only: a row rejected by one step is not looked at by later ones."""
    return F.coalesce(*[r.error() for r in in_order(rules)]) if in_order(rules) else F.lit(None).cast(ERROR)


def first_number(ready: list[Rule]) -> Column:
    """Number, from 1, of the first rule in the list that a row breaks; 0 for none."""
    return F.coalesce(*[F.when(F.coalesce(r.bad, F.lit(False)), F.lit(k)) for k, r in enumerate(ready, 1)], F.lit(0))


def first_field(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and value of the first field that fails, in the order given."""
    bad = [F.coalesce(r.bad, F.lit(False)) for r in rules]
    return (
        F.coalesce(*[F.when(b, F.lit(r.field)) for b, r in zip(bad, rules, strict=True)]),
        F.coalesce(*[F.when(b, F.coalesce(r.value.cast("string"), F.lit(""))) for b, r in zip(bad, rules, strict=True)]),
    )


def long_errors(df: DataFrame, errors: Column, *keys: str) -> DataFrame:
    """A row per error, with its place in the row's list from 0."""
    return df.select(*keys, F.posexplode(errors).alias("error_no", "error")).select(*keys, "error_no", "error.*")


def message_text(errors: Column, part: str = "error_message") -> Column:
    """Messages (or codes) of a row joined by comma and blank; null if there are none."""
    return F.nullif(F.array_join(F.transform(errors, lambda e: e[part]), ", "), F.lit(""))


# Conditions; each is true for a value that breaks the rule.

def missing(c: Column, blank_allowed: bool = False) -> Column:
    return c.isNull() if blank_allowed else is_blank(c)


def bad_iso_date(c: Column, strict: bool = False) -> Column:
    """Given, and not yyyy-MM-dd; strict: nor a day that exists."""
    given = ~is_blank(c)
    wrong = ~trimmed(c).rlike(dates.ISO)
    return given & ((wrong | dates.two_forms(c).isNull()) if strict else wrong)


def bad_two_form_date(c: Column) -> Column:
    return ~is_blank(c) & dates.two_forms(c).isNull()


def not_positive_whole(c: Column) -> Column:
    return ~is_blank(c) & ~numbers.positive_whole(c)


def negative(c: Column) -> Column:
    return trimmed(c).try_cast("int") < 0


def not_among(c: Column, allowed) -> Column:
    return ~is_blank(c) & ~c.isin(*allowed)


def not_like(c: Column, pattern: str) -> Column:
    return ~is_blank(c) & ~c.rlike(pattern)


def out_of_range(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Numbers only; either bound may be open."""
    n = trimmed(c).try_cast("double")
    below = n < F.lit(float(low)) if low is not None else F.lit(False)
    above = n > F.lit(float(high)) if high is not None else F.lit(False)
    return below | above


# Forms of e-mail addresses, strict and loose.
STRICT_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
LOOSE_EMAIL = r"^[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}\z"


def bad_email(c: Column, pattern: str = STRICT_EMAIL) -> Column:
    return ~is_blank(c) & ~trimmed(c).rlike(pattern)


def is_email_name(column: str) -> bool:
    return any(part in column.lower() for part in ("email", "e_mail", "mail"))


def bad_phone(c: Column, fewest: int = 10, most: int = 15) -> Column:
    return ~is_blank(c) & ~F.length(F.regexp_replace(c, "[^0-9]", "")).between(fewest, most)


def too_long(c: Column, most: int) -> Column:
    return F.length(c) > most


def too_short(c: Column, fewest: int) -> Column:
    return F.length(trimmed(c)) < fewest


CONVERTERS: dict[str, Callable[[Column], Column]] = {
    "string": lambda c: c,
    "int": lambda c: numbers.to_whole(c, "int"),
    "long": lambda c: numbers.to_whole(c, "bigint"),
    "double": numbers.to_double,
    "float": lambda c: numbers.to_double(c).cast("float"),
    "decimal": numbers.to_decimal,
    "boolean": numbers.to_boolean,
    "date": dates.to_date,
    "timestamp": dates.to_timestamp,
}


def register_converter(name: str, convert: Callable[[Column], Column]) -> None:
    """A converter of the user's own: any function of a Column, a pandas UDF too."""
    CONVERTERS[name] = convert


def not_convertible(c: Column, kind: str) -> Column:
    return ~is_blank(c) & CONVERTERS[kind](c).isNull()


def rules_from_config(config: dict, columns: dict[str, Column] | None = None) -> list[Rule]:
    """Rules of one sheet from a mapping name -> {type, enabled, ...}, as a rule file holds it."""
    col = lambda name: (columns or {}).get(name, F.col(name))
    made: list[Rule] = []
    for name, part in config.items():
        on, kind = part.get("enabled", True), part["type"]
        if kind == "REQUIRED_FIELDS":
            made += [Rule(name, missing(col(f)), "REQUIRED_MISSING", f, col(f), f"{f} is required", "VAL001", REQUIRED, on) for f in part["fields"]]
        elif kind == "DATE_FORMAT":
            made += [Rule(name, bad_iso_date(col(f)), "INVALID_DATE", f, col(f), f"{f} is not a date", "VAL002", DATE, on) for f in part["fields"]]
        elif kind == "ENUM_VALUES":
            made += [
                Rule(name, not_among(col(f), v), "INVALID_ENUM", f, col(f), f"{f} is not an allowed value", "VAL003", ENUM, on)
                for f, v in part["values"].items()
            ]
        elif kind == "PATTERN":
            made += [Rule(name, not_like(col(f), p), "INVALID_PATTERN", f, col(f), f"{f} has a wrong form", "VAL007", PATTERN, on) for f, p in part["patterns"].items()]
        elif kind == "BUSINESS_LOGIC":
            when = F.expr(part["condition"]) if "condition" in part else F.lit(True)
            made.append(
                Rule(name, when & F.expr(part["bad"]), "BUSINESS_RULE", part["field"], col(part["field"]), part.get("message", name), "VAL006", BUSINESS, on)
            )
        else:
            raise ValueError(f"unknown type of rule: {kind}")
    return made


def over_budget(errors: DataFrame, most: int, fail: bool = False) -> DataFrame:
    """One row: errors counted, and whether they are over the budget; fail raises in the job instead."""
    counted = errors.agg(F.count("*").alias("errors"))
    over = F.col("errors") > most
    if fail:
        return counted.select("errors", F.when(over, F.raise_error(F.lit("too many errors")).cast("boolean")).otherwise(False).alias("over_budget"))
    return counted.select("errors", over.alias("over_budget"))
