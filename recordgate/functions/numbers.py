"""Numbers from text: what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Words for true and false.
TRUE_WORDS = ("true", "yes", "y", "1", "on", "enabled")
FALSE_WORDS = ("false", "no", "n", "0", "off", "disabled")


def number_text(c: Column) -> Column:
    """Without commas and blanks."""
    return F.regexp_replace(trimmed(c), r"[,\s]", "")


def to_whole(c: Column, kind: str = "int") -> Column:
    """12 -> 12, 12.7 -> 12."""
    t = trimmed(c)
    number = t.try_cast("double")
    toward_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(F.contains(t, F.lit(".")), toward_zero.try_cast(kind)).otherwise(t.try_cast(kind))


def to_double(c: Column) -> Column:
    """12.5 -> 12.5, 12% -> 0.12."""
    t = trimmed(c)
    percent = F.regexp_replace(t, r"%\z", "").try_cast("double") / 100
    return F.when(F.endswith(t, F.lit("%")), percent).otherwise(t.try_cast("double"))


def to_decimal(c: Column) -> Column:
    t = trimmed(c)
    kind = "decimal(38,18)"
    return F.when(F.endswith(t, F.lit("%")), (F.regexp_replace(t, r"%\z", "").try_cast(kind) / 100).cast(kind)).otherwise(t.try_cast(kind))


def to_boolean(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def positive_whole(c: Column) -> Column:
    """True for digits only with a value over 0; null for null."""
    t = trimmed(c)
    return t.rlike(r"^\d+\z") & F.coalesce(t.try_cast("int") > 0, F.lit(False))
