"""Quantities in text, their daily rates, and whether a supplier can fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilograms of a unit, days of a period.
UNIT_KG = {
    "kg": 1, "kgs": 1, "kilo": 1, "kilos": 1, "kilogram": 1, "kilograms": 1, "quintal": 100, "quintals": 100, "qtl": 100,
    "ton": 1000, "tons": 1000, "tonne": 1000, "tonnes": 1000, "mt": 1000,
}
PERIOD_DAYS = {"day": 1, "daily": 1, "week": 7, "weekly": 7, "fortnight": 14, "month": 30, "monthly": 30, "quarter": 91, "year": 365, "annum": 365, "yearly": 365, "annual": 365}
#: Characters of the same sentence that may stand between a quantity and its period.
PERIOD_REACH = 40


def _words(values: dict[str, int]) -> str:
    return "(" + "|".join(sorted(values, key=lambda w: (-len(w), w))) + ")"


#: A quantity is a number and a unit; its period is looked up in what follows, up to the next quantity.
AMOUNT = rf"(?i)(?<![0-9.,])([0-9][0-9,]*(?:\.[0-9]+)?)\s*{_words(UNIT_KG)}\b"
PERIOD = rf"(?i)^([^\n.]{{0,{PERIOD_REACH}}}?(?:\bper|\bevery|/)\s*{_words(PERIOD_DAYS)})\b"


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]), key)


def find_quantities(c: Column) -> Column:
    """array<struct<kg, phrase, kg_per_day>>: each distinct phrase once, largest first, equal ones in the order of the text."""
    part = lambda i: F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(i))
    pieces = F.split(c, AMOUNT, -1)
    after = F.slice(pieces, 2, F.size(pieces))
    zipped = F.arrays_zip(part(0).alias("amount"), part(1).alias("number"), part(2).alias("unit"), after.alias("after"))

    def read(m: Column, i: Column) -> Column:
        kg = F.replace(m["number"], F.lit(","), F.lit("")).cast("double") * _lookup(UNIT_KG, F.lower(m["unit"]))
        days = _lookup(PERIOD_DAYS, F.lower(F.regexp_extract(m["after"], PERIOD, 2)))
        phrase = F.trim(F.regexp_replace(F.concat(m["amount"], F.regexp_extract(m["after"], PERIOD, 1)), r"\s+", " "))
        return F.struct((-kg).alias("order"), i.alias("place"), phrase.alias("phrase"), kg.alias("kg"), (kg / days).alias("kg_per_day"))

    found = F.filter(F.transform(zipped, read), lambda q: q["kg"] > 0)
    phrases = F.transform(found, lambda q: q["phrase"])
    once = F.filter(found, lambda q, i: F.array_position(phrases, q["phrase"]) == i + 1)
    return F.transform(F.array_sort(once), lambda q: F.struct(q["kg"].alias("kg"), q["phrase"].alias("phrase"), q["kg_per_day"].alias("kg_per_day")))


def best_quantity(c: Column) -> Column:
    return F.get(find_quantities(c), F.lit(0))


def quantity_fit(kg: Column, kg_per_day: Column, headline: Column, least: float, most: float, most_headline: float) -> Column:
    """within, small, over or unstated, by the daily rate, or the bare total where no period is given."""
    rate = F.coalesce(kg_per_day, kg)
    ceiling = F.when(headline, F.lit(most_headline)).otherwise(F.lit(most))
    return F.when(rate.isNull() | (rate <= 0), "unstated").when(rate < least, "small").when(rate > ceiling, "over").otherwise("within")


def cost_inr(tokens_in: Column, tokens_out: Column, usd_in: Column, usd_out: Column, rate: float) -> Column:
    """Cost of a call in rupees, prices in dollars a million tokens, rounded up to four decimals."""
    micro = F.ceil((tokens_in * usd_in + tokens_out * usd_out) * rate / 1_000_000 * 10_000)
    return (micro / 10_000).cast("decimal(18,4)")


#: White space by Java's patterns, and by those of SQL (RE2), to which a vertical tab is none.
BLANKS, SQL_BLANKS = " \n\t\r\x0b\f", " \n\t\r\f"


def _dense_length(c: Column, blanks: str = BLANKS) -> Column:
    """Characters that are no white space; single signs are taken out without a pattern."""
    for blank in blanks:
        c = F.replace(c, F.lit(blank), F.lit(""))
    return F.length(c)


def readable_ratio(c: Column, blanks: str = BLANKS, none: Column | float = 0.0) -> Column:
    """Share of letters, digits and common signs among characters that are not white space; `none` where there are no such characters, or no text."""
    dense = _dense_length(c, blanks)
    odd = F.length(F.regexp_replace(c, rf"[A-Za-z0-9.,;:()/&%'\"+@#*?!\[\]{blanks}-]++", ""))  # readable text is one match
    return F.coalesce(F.try_divide(dense - odd, dense), F.lit(none))


def is_readable(c: Column, ratio: float = 0.85, least_chars: int = 40, least_words: int = 8, blanks: str = BLANKS) -> Column:
    """Enough characters, a readable share of them, and enough words, which are looked for no further than that."""
    word = "(?<![A-Za-z0-9_])[A-Za-z]{3,}+(?![A-Za-z0-9_])"
    return (_dense_length(c, blanks) >= least_chars) & (readable_ratio(c, blanks) >= ratio) & c.rlike(rf"(?s)\A(?>.*?{word}){{{least_words}}}")
