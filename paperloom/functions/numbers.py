"""Amounts, rates, currencies and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits

# Fixed values.
CURRENCIES = {"$": "USD", "US$": "USD", "€": "EUR", "EUR": "EUR", "EURO": "EUR", "TND": "TND", "DT": "TND", "DINAR": "TND", "GBP": "GBP", "£": "GBP", "DOLLAR": "USD"}
MONTHS = {
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def amount(c: Column) -> Column:
    """An amount of either notation as DECIMAL(18,3); null if it is none.

    The right-most of two kinds of marks is the decimal one; of one kind that
    repeats, only the last; a single comma is decimal.
    """
    kept = F.regexp_replace(ascii_digits(c), r"[^0-9,.\-]", "")
    sign, bare = F.when(kept.startswith("-"), "-").otherwise(""), F.regexp_replace(kept, "^[-+]+", "")
    dots, commas = _count(bare, "."), _count(bare, ",")
    dot_last = F.length(bare) - F.locate(".", F.reverse(bare))
    comma_last = F.length(bare) - F.locate(",", F.reverse(bare))
    nothing = F.lit("")

    def last_kept(mark: str) -> Column:
        head = F.replace(F.regexp_replace(bare, f"\\{mark}[^{mark}]*$", ""), F.lit(mark), nothing)
        return F.concat(head, F.lit("."), F.substring_index(bare, mark, -1))

    plain = (
        F.when((dots > 1) & (commas == 0), last_kept("."))
        .when((commas > 1) & (dots == 0), last_kept(","))
        .when((commas > 0) & (dots > 0), F.when(comma_last > dot_last, F.replace(F.replace(bare, F.lit("."), nothing), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), nothing)))
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    )
    shape = plain.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(shape, F.concat(sign, plain).try_cast("decimal(18,3)"))


def last_number(c: Column) -> Column:
    """The last number of a text; parentheses around it make it negative."""
    found = F.element_at(F.regexp_extract_all(c, F.lit(r"-?[0-9][0-9., ]*"), F.lit(0)), -1)
    value = amount(F.replace(found, F.lit(" "), F.lit("")))
    return F.when(F.trim(c).rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)


def confidence(c: Column) -> Column:
    """Within [0, 1] at three digits; no value and NaN are null."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)).cast("decimal(9,6)").cast("decimal(9,3)"))


def amounts_equal(a: Column, b: Column, least: str = "0.02", rate: str = "0.005") -> Column:
    """Within an absolute or a relative tolerance."""
    apart = F.abs(a - b)
    return (apart <= F.lit(least).cast("decimal(6,3)")) | (apart <= F.abs(b) * F.lit(rate).cast("decimal(6,4)"))


def currency(c: Column) -> Column:
    text = F.upper(F.trim(c))
    table = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return F.when(text != "", F.coalesce(F.element_at(table, text), F.substring(text, 1, 3)))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def day_first(c: Column) -> Column:
    """A date: year first, else day first with digits or a month's name."""
    c = F.lower(ascii_digits(c))
    iso = F.regexp_extract(c, r"\b([0-9]{4})[/.\-]([0-9]{1,2})[/.\-]([0-9]{1,2})\b", 0)
    dmy = F.regexp_extract(c, r"\b([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})\b", 0)
    named = r"\b([0-9]{1,2})\s+(" + "|".join(MONTHS) + r")\s+([0-9]{4})\b"
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    by_name = F.concat_ws("-", F.regexp_extract(c, named, 3), F.element_at(months, F.regexp_extract(c, named, 2)).cast("string"), F.regexp_extract(c, named, 1))
    return (
        F.when(iso != "", F.try_to_date(F.regexp_replace(iso, "[/.]", "-"), "yyyy-M-d"))
        .when(dmy != "", F.try_to_date(F.regexp_replace(dmy, "[/.]", "-"), "d-M-yyyy"))
        .when(c.rlike(named), F.try_to_date(by_name, "yyyy-M-d"))
    )


def possible_dates(c: Column) -> Column:
    """The dates that d/m/y text can mean, month first and day first."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.try_to_date(c, "M/d/yyyy"), F.try_to_date(c, "d/M/yyyy")))))


def benchmark_amount(c: Column) -> Column:
    """An amount of a label: of both marks the right-most is decimal, a comma
    alone is; repeated marks make it none. Not rounded."""
    kept = F.regexp_replace(c, r"[^0-9,.\-]", "")
    both = F.contains(kept, F.lit(",")) & F.contains(kept, F.lit("."))
    comma_last = F.length(F.substring_index(kept, ",", -1)) < F.length(F.substring_index(kept, ".", -1))
    plain = F.when(both & comma_last, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(kept, F.lit(","), F.lit(""))).otherwise(F.replace(kept, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(r"^-?[0-9]+\.?[0-9]*$"), plain.try_cast("double"))


def cell_number(c: Column) -> Column:
    """The last money token of a cell."""
    return amount(F.get(F.reverse(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]{1,3})?"), F.lit(0))), F.lit(0)))


def money_or_number(c: Column) -> Column:
    """The first number; none if there are two letters or more and no mark of
    money."""
    many = F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 2
    money = c.rlike(r"[$€£]|[0-9][.,][0-9]{2}")
    return F.when(~many | money, amount(F.get(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), F.lit(0))))


def float_or_none(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def numbers_match(a: Column, b: Column) -> Column:
    """1 if two numbers differ by a hundredth or half a percent at most."""
    return (F.abs(a - b) <= F.greatest(F.lit(0.01), F.abs(b) * 0.005)).cast("int")


def month_first(c: Column) -> Column:
    """A date, month first if that is possible, else day first."""
    return F.coalesce(F.try_to_date(c, "M/d/yyyy"), F.try_to_date(c, "d/M/yyyy"), F.try_to_date(c, "yyyy-M-d"))


def in_context(c: Column, context: Column) -> Column:
    """A d/m or m/d date: month first only beside an English label without a
    French one."""
    low = F.lower(context)
    english = low.rlike("invoice date|issued|issue date|date of issue|bill date|due date|payment due")
    french = low.rlike("date facture|facture|echeance|emission|emise|emis|commande|livraison")
    both = c.rlike(r"^(?:0?[1-9]|1[0-2])[/.-](?:0?[1-9]|1[0-2])[/.-][0-9]{4}$")
    return F.when(both & english & ~french, F.try_to_date(F.regexp_replace(c, "[.-]", "/"), "M/d/yyyy")).otherwise(day_first(c))
