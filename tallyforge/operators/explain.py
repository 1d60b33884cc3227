"""Texts that people read about decisions and queue items. They are made of a decision's own fields and change nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X

#: Texts by status; fields stand in braces.
EXPLANATIONS = {
    "matched": "{settlement} was paid by {credit} with {received} ({confidence}): {rules}.",
    "matched_split": "{settlement} came in {n_credits} credits that add up to {expected}: {rules}.",
    "matched_merged": "{credit} paid {n_settlements} settlements at once: {rules}.",
    "matched_with_discrepancy": "{settlement} was due {expected} and {credit} brought {received}; {gap} is {label}: {rules}.",
    "duplicate_credit": "{credit} repeats a credit that is accounted for; have the bank take it back.",
    "ambiguous_abstain": "Nothing tells {names} apart; let a person ask the bank before one is taken.",
    "exception_missing_bank": "{settlement} over {expected} has not reached the bank.{nearest}",
    "exception_missing_settlement": "{credit} brought {received} and looks like a settlement, but none is known for it.",
    "non_settlement_credit": "Money from elsewhere, left out.",
    "out_of_scope": "Money going out, left out.",
}
#: A queue item's title and what to do about it, by status.
TITLES = {
    "exception_missing_bank": ("Settlement not in the bank", "Ask the processor for the transfer's trace"),
    "duplicate_credit": ("Credit posted again", "Ask the bank to take the second posting back"),
    "ambiguous_abstain": ("Several records fit", "Pick one after asking the bank"),
    "exception_missing_settlement": ("Credit without a settlement", "Find out who sent the money"),
    "exception_amount_mismatch": ("Paid another amount than ordered", "Charge or refund the difference"),
    "exception_duplicate_payment": ("Order paid more than once", "Refund the later payment"),
    "needs_review": ("Matched, but the difference is open", "Find what was deducted"),
    "exception_unpaid_order": ("Order without a payment", "Remind the customer or cancel"),
    "exception_payment_no_order": ("Payment for an unknown order", "Find the order or refund"),
}


def pieces(template: str) -> list[tuple[bool, str]]:
    """A template's parts in order, each with whether it is a field."""
    return [(k % 2 == 1, part) for k, part in enumerate(template.replace("}", "{").split("{")) if part]


def mapped(texts: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in texts.items() for x in kv))[key]


def attach(decisions: DataFrame) -> DataFrame:
    """Decisions of leg A with ``explanation``. Statuses without a text show their rules."""
    rupees = lambda c: F.coalesce(F.concat(F.lit("Rs "), X.rupees(F.col(c))), F.lit("?"))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    ids = F.filter(F.transform("candidates", lambda x: x["record_id"]), lambda x: x != "")
    best = F.get("candidates", F.lit(0))["record_id"]
    fields = {
        "settlement": first("settlement_ids"), "credit": first("bank_txn_ids"), "received": rupees("received_paise"), "expected": rupees("expected_paise"), "gap": rupees("discrepancy_paise"),
        "confidence": F.col("confidence"), "n_credits": F.size("bank_txn_ids").cast("string"), "n_settlements": F.size("settlement_ids").cast("string"), "names": F.array_join(ids, ", "),
        "label": F.array_join(F.transform("discrepancy_breakdown", lambda x: x["label"]), ", "), "rules": F.array_join(F.slice("rules", 1, 3), "; "),
        "nearest": F.when(F.coalesce(best, F.lit("")) != "", F.concat(F.lit(" Closest: "), best, F.lit("."))).otherwise(F.lit("")),
    }
    text = lambda t: F.concat(*(fields[p] if is_field else F.lit(p) for is_field, p in pieces(t)))
    told = reduce(lambda made, kv: made.when(F.col("status") == kv[0], text(kv[1])), EXPLANATIONS.items(), F.when(F.lit(False), F.lit("")))
    return decisions.withColumn("explanation", told.otherwise(F.concat("status", F.lit(": "), fields["rules"])))


def shown(items: DataFrame) -> DataFrame:
    """Items (status, evidence, maybe explanation) with title, suggested_action and detail: the explanation, else the first two rules."""
    told = F.coalesce(F.nullif("explanation", F.lit("")), F.array_join(F.slice("evidence", 1, 2), "; "))
    return items.withColumns({"title": mapped({k: v[0] for k, v in TITLES.items()}, F.col("status")), "suggested_action": mapped({k: v[1] for k, v in TITLES.items()}, F.col("status")), "detail": told}).drop("explanation")
