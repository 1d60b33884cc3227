"""Column expressions for money, dates, references and ids. Money is integer paise; no float or decimal ever holds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flat bank charge in paise, days in which a credit may follow its settlement, extra days for merged credits.
BANK_CHARGE, WINDOW_DAYS, MERGE_EXTRA_DAYS = 2950, 10, 3
#: Fewest characters of a reference token, and the texts that mark a credit as the processor's.
TOKEN_LENGTH = 10
MARKERS = r"RAZORPAY|RZPAY|RZP"
UTR_SHAPE = r"^[A-Z]{4}[0-9]{12}$"


def paise(text: Column) -> Column:
    """Rupee text such as ``1,52,340.50`` as paise; an error for anything else than a sign, digits and up to two decimals."""
    clean = F.trim(F.regexp_replace(text, r'["\s,]|Rs\.?', ""))
    sign = F.when(clean.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    digits = F.regexp_replace(clean, r"^[+-]", "")
    whole = F.split_part(digits, F.lit("."), F.lit(1)).cast("long")
    part = F.rpad(F.split_part(digits, F.lit("."), F.lit(2)), 2, "0").cast("long")
    return F.when(clean.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,2})?$"), sign * (whole * 100 + part)).otherwise(F.raise_error(F.concat(F.lit("not an amount: "), F.coalesce(text, F.lit("null")))).cast("long"))


def optional_paise(text: Column) -> Column:
    """As ``paise``; blank and null are 0."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank, F.lit(0).cast("long")).otherwise(paise(F.when(blank, F.lit("0")).otherwise(text)))


def rupees(amount: Column) -> Column:
    """Paise as text with lakh and crore grouping: 123456789 gives 12,34,567.89."""
    size = F.abs(amount)
    whole = F.regexp_replace(F.floor(size / 100).cast("string"), r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def gst_on_fee(fee: Column) -> Column:
    """18 % of one payment's fee, half up; fees are not negative."""
    return F.floor((fee * 18 + 50) / 100).cast("long")


def bank_date(text: Column) -> Column:
    return F.to_date(F.trim(text), "dd/MM/yyyy")


def iso_date(text: Column) -> Column:
    """The day of an ISO date or timestamp."""
    return F.to_date(F.substring(text, 1, 10))


def iso_timestamp(text: Column) -> Column:
    return F.to_timestamp_ntz(text)


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as ISO text; the session's time zone is UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def roll_off_sunday(day: Column) -> Column:
    return F.when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def canonical(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def is_utr_shaped(text: Column) -> Column:
    return text.rlike(UTR_SHAPE)


def tokens(*texts: Column) -> Column:
    """Distinct alphanumeric runs of at least ten characters, in order."""
    runs = [F.filter(F.split(F.upper(F.coalesce(t, F.lit(""))), "[^A-Z0-9]+"), lambda x: F.length(x) >= TOKEN_LENGTH) for t in texts]
    return F.array_distinct(F.concat(*runs))


def full_strip(*texts: Column) -> Column:
    """All texts without separators, joined without one: a reference may run across their border."""
    return F.concat(*(canonical(F.coalesce(t, F.lit(""))) for t in texts))


def near_utr(token: Column, utr: Column) -> Column:
    """Equal length and one substitution at most."""
    return (F.length(token) == F.length(utr)) & (F.levenshtein(token, utr) <= 1)


def fragment_of(token: Column, utr: Column) -> Column:
    return (F.length(token) >= TOKEN_LENGTH) & F.contains(utr, token)


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def in_window(created: Column, value_date: Column, days: int = WINDOW_DAYS) -> Column:
    return F.datediff(value_date, created).between(0, days)


def shaped(found: Column, *texts: Column) -> Column:
    """A credit that looks like the processor's: a marker in its texts, or a token of a reference's shape."""
    return F.upper(F.concat_ws(" ", *texts)).rlike(MARKERS) | F.exists(found, is_utr_shaped)


def one_percent(amount: Column) -> Column:
    return F.floor((amount + 50) / 100).cast("long")


def decompose(expected: Column, received: Column) -> Column:
    """What explains a shortfall: the flat charge first, else one percent of what was expected; null if neither."""
    gap = received - expected
    return F.when(gap == -BANK_CHARGE, F.lit("bank_charge")).when(gap == -one_percent(expected), F.lit("commission"))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+", " "))


def carries(canon: Column, raw: Column, settlement_id: Column, utr: Column, merchant: Column, n: int) -> Column:
    """A text names a settlement: by its id, its reference, n characters of its reference, or the merchant's name."""
    named = F.contains(F.upper(raw), F.upper(settlement_id)) | F.exists(grams(utr, n), lambda g: F.contains(canon, g))
    return named | (F.coalesce(F.length(merchant), F.lit(0)) > 0) & F.contains(F.upper(F.coalesce(collapse(raw), F.lit(""))), F.upper(F.coalesce(collapse(merchant), F.lit("-"))))


def item_id(source: Column, ids: Column) -> Column:
    """Twelve hex digits for a queue item; the status is no part of it, so an item survives a change of status."""
    return F.substring(F.sha1(F.concat_ws("|", source, F.array_join(F.array_sort(ids), "|")).cast("binary")), 1, 12)


def amount_cell(cell: Column) -> Column:
    """A statement's amount cell as struct<paise, side>: Cr or Dr at the end, parentheses as minus, commas and currency; null if
    it is no amount."""
    text = F.trim(F.regexp_replace(cell, r"(?i)₹|INR|Rs\.?|,", ""))
    side = F.upper(F.regexp_extract(text, r"(?i)\b(cr|dr)\.?$", 1))
    bare = F.trim(F.regexp_replace(text, r"(?i)\s*(cr|dr)\.?$", ""))
    inner = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    fits = inner.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,2})?$")
    return F.when(fits, F.struct(paise(F.when(fits, inner).otherwise(F.lit("0"))).alias("paise"), F.nullif(side, F.lit("")).alias("side")))


#: strptime's letters and what Java calls them.
STRPTIME = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss"}


def date_at(cell: Column, pattern: Column) -> Column:
    """A date cell read with a column of strptime patterns; null if it does not fit."""
    for python, java in STRPTIME.items():
        pattern = F.replace(pattern, F.lit(python), F.lit(java))
    return F.to_date(F.try_to_timestamp(F.trim(cell), pattern))


def date_cell(cell: Column, pattern: str) -> Column:
    """A date cell read with one strptime pattern."""
    return date_at(cell, F.lit(pattern))


def reference_at(narration: Column, delimiter: Column, index: Column, token: Column) -> Column:
    """The narration's part at ``index`` if the whole of it matches ``token``, else an empty text, as where ``token`` is empty."""
    part = F.trim(F.get(F.split(narration, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))), index))
    fits = F.coalesce((token != "") & F.rlike(part, F.concat(F.lit("^(?:"), token, F.lit(")$"))), F.lit(False))
    return F.when(fits, part).otherwise(F.lit(""))


def reference_of(narration: Column, delimiter: str, index: int, token: str) -> Column:
    """As ``reference_at``, with one recipe."""
    return reference_at(narration, F.lit(delimiter), F.lit(index), F.lit(token))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """The score interval of k successes in n as struct<lo, hi>; null for n = 0."""
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (mid - half) / (1 + zz / n)).alias("lo"), F.least(F.lit(1.0), (mid + half) / (1 + zz / n)).alias("hi")))


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a binary column, built from the SHA-256 of the JVM."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)
