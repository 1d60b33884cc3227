"""Money figures in free text, as an Arrow UDF: the rules look at letters on both sides in Unicode, which the JVM's patterns do not."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that make a number a date.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
#: Words that may touch a figure on its left and on its right.
CURRENCIES, SIDES = {"INR", "RS"}, {"DR", "CR"}
TOKEN = re.compile(r"(?P<number>[0-9][0-9,]*(?:\.[0-9]+)?)|(?P<word>(?:(?![0-9])\w)+)|(?P<mark>.)", re.S)
VALUE = re.compile(r"(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{2,3})+)(?:\.[0-9]{1,2})?")
SPAN = T.ArrayType(T.StructType([T.StructField("paise", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


class Tokens:
    """A text as numbers, words and single other characters."""

    def __init__(self, text: str):
        self.all = [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(text)]

    def at(self, i: int) -> tuple[str, str]:
        """Kind and text of a token; beyond the ends there is nothing."""
        return self.all[i][:2] if 0 <= i < len(self.all) else ("", "")

    def word(self, i: int, step: int) -> str:
        """A word in capitals, unless a number touches it on its far side."""
        kind, said = self.at(i)
        touching = self.at(i + step)[1][-1 if step < 0 else 0 :][:1]
        return said.upper() if kind == "word" and not touching.isdecimal() else ""

    def apart(self, i: int, step: int, touching: set[str]) -> bool:
        """Whether what stands beside a number on one side leaves it a figure: no word but some that may touch it, no percentage, no other
        number behind a separator, as in dates and times, and no month."""
        kind, said = self.at(i + step)
        if kind == "word":
            return self.word(i + step, step) in touching
        further = self.at(i + 2 * step)[1]
        if said and said in "/-.:" and further and further[0 if step > 0 else -1].isdecimal():
            return False
        j = i + step
        while self.at(j)[1] in (" ", "-"):
            j += step
        return self.word(j, step) not in MONTHS and not (step > 0 and said == "%")


def spans(text: str) -> list[tuple[int, int, int]]:
    """(paise, start, end) of the money figures of a text: ASCII digits, Indian or western groups, at most two decimals. Numbers in
    words, percentages, dates and times are none; a currency before or Dr, Cr, ``/-`` behind may touch the figure."""
    tokens, found = Tokens(text), []
    for i, (kind, said, start) in enumerate(tokens.all):
        number = said.rstrip(",")
        ends = number != said  # a comma parts it from what follows
        if kind == "number" and VALUE.fullmatch(number) and tokens.apart(i, -1, CURRENCIES) and (ends or tokens.apart(i, 1, SIDES)):
            whole, _, part = number.replace(",", "").partition(".")
            found.append((int(whole) * 100 + int(part.ljust(2, "0") or 0), start, start + len(number)))
    return found


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def quoted(source: str | None, quote: str | None, paise: int) -> bool:
    """Whether some place at which the source holds the quote covers a figure of the source that is worth ``paise``. White space counts
    as one blank."""
    text, part = squeeze(source), squeeze(quote)
    places = [m.start() for m in re.finditer(f"(?={re.escape(part)})", text)] if part else []
    figures = [(first, last) for value, first, last in spans(text) if value == paise] if places else []
    return any(p <= first and last <= p + len(part) for p in places for first, last in figures)


@F.pandas_udf(SPAN)
def money_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield some.map(lambda t: [{"paise": v, "first": a, "last": b} for v, a, b in spans(squeeze(t))])


@F.pandas_udf(T.BooleanType())
def figure_in_quote(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for source, quote, paise in rows:
        yield pd.Series([quoted(s, q, int(p)) for s, q, p in zip(source, quote, paise, strict=True)])
