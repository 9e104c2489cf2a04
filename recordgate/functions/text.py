"""Text scalars: Column -> Column, null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters up to U+0020, which trimming takes off both ends.
WHITE = "".join(map(chr, range(33)))

# Accented letters of Vietnamese and the letters they stand on.  The letter
# with a stroke stays as it is: it is a letter of its own and has no accent to take away.
ACCENTS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ",
    "e": "èéẻẽẹêềếểễệ",
    "i": "ìíỉĩị",
    "o": "òóỏõọôồốổỗộơờớởỡợ",
    "u": "ùúủũụưừứửữự",
    "y": "ỳýỷỹỵ",
}


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def normal_text(c: Column) -> Column:
    """Trimmed, upper case, blank as null."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def is_blank(c: Column) -> Column:
    return blank_to_null(c).isNull()


def plain_name(c: Column) -> Column:
    """Lower case without accents."""
    marked = "".join(ACCENTS.values())
    plain = "".join(letter * len(marks) for letter, marks in ACCENTS.items())
    return F.translate(F.lower(c), marked, plain)


def code_from_name(c: Column, default: str = "UNKNOWN") -> Column:
    return F.upper(F.replace(F.coalesce(c, F.lit(default)), F.lit(" "), F.lit("_")))


def title_from_field(c: Column) -> Column:
    """camelCase -> Camel Case."""
    spaced = F.regexp_replace(c, r"([A-Z])", " $1")
    return F.ltrim(F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2))))


def column_index(c: Column) -> Column:
    """Spreadsheet column letters -> index from 0: A is 0, AB is 27."""
    letters = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def masked(c: Column) -> Column:
    """First two and last two characters of longer values, stars between; shorter ones as they are."""
    stars = F.repeat(F.lit("*"), F.length(c) - 4)
    return F.when(F.length(c) > 4, F.concat(F.left(c, F.lit(2)), stars, F.right(c, F.lit(2)))).otherwise(c)


def identifier_text(c: Column) -> Column:
    """Identifiers that a spreadsheet turned into numbers: 1.23E+11 -> digits, 123.0 -> 123."""
    t = trimmed(c)
    as_number = t.try_cast("double").try_cast("decimal(38,0)").cast("string")
    scientific = F.when(t.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+\z"), as_number)
    return F.coalesce(scientific, F.when(t.rlike(r"^\d+\.0+\z"), F.regexp_replace(t, r"\.0+\z", "")), t)


def looks_like_identifier(c: Column) -> Column:
    """9 to 15 digits, perhaps with .0, or a number in scientific form."""
    t = trimmed(c)
    return t.rlike(r"^\d{9,15}(\.0+)?\z") | t.rlike(r"^\d+(\.\d+)?[eE]\+?\d+\z")
