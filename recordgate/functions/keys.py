"""Business keys.  Parts that are null count as empty text; duplicates are found on the parts, not on the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of documents whose contract is a loan, a card, or a savings card.
LOAN_KINDS = ("LD", "MD", "OD", "HDHM", "KSSV", "Bao thanh toán", "Biên nhận thế chấp")
CARD_KINDS = ("CC", "TSBD")
SAVINGS_KIND = "TTK"


def joined_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def contract_key(contract: Column, kind: Column, disbursed: Column, customer: Column, unit: Column) -> Column:
    return (
        F.when(kind.isin(*LOAN_KINDS), joined_key(contract, kind, disbursed))
        .when(kind.isin(*CARD_KINDS), joined_key(contract, kind, customer))
        .when(kind == SAVINGS_KIND, joined_key(contract, kind, customer, unit, disbursed))
        .otherwise(joined_key(contract, kind))
    )


def contract_key_parts(contract: Column, kind: Column, disbursed: Column, customer: Column, unit: Column) -> list[Column]:
    """The same key as columns to partition by; parts that a kind does not use are null."""
    loan, card, savings = kind.isin(*LOAN_KINDS), kind.isin(*CARD_KINDS), kind == SAVINGS_KIND
    return [contract, kind, F.when(loan | savings, disbursed), F.when(card | savings, customer), F.when(savings, unit)]
