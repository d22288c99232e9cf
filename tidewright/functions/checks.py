"""Checksums, dates and telephone numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, to_ascii

# fixed values
MONTHS = {
    "01": "janvier|janv|january|jan", "02": "fevrier|fevr|fev|february|feb", "03": "mars|march|mar", "04": "avril|avr|april|apr",
    "05": "mai|may", "06": "juin|june|jun", "07": "juillet|juil|july|jul", "08": "aout|august|aug", "09": "septembre|sept|september|sep",
    "10": "octobre|october|oct", "11": "novembre|november|nov", "12": "decembre|december|dec",
}
FIRST_YEAR, LAST_YEAR = 1870, 2120
# end of fixed values


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\s.-]", "")


def _luhn(c: Column | str, n: int) -> Column:
    d = digits(c)
    return F.when(d.rlike(f"^[0-9]{{{n}}}$") & F.call_function("luhn_check", d), d)


def siren(c: Column | str) -> Column:
    """The compact number if it is valid, else null."""
    return _luhn(c, 9)


def siret(c: Column | str) -> Column:
    return _luhn(c, 14)


def nir(c: Column | str) -> Column:
    """13 digits (2A and 2B stand for 19 and 18) and a key: 97 less the remainder of 97."""
    d = F.upper(digits(c))
    number = F.replace(F.replace(F.substring(d, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    ok = d.rlike(r"^[12][0-9]{4}[0-9][0-9AB][0-9]{8}$")
    return F.when(ok, F.when((97 - F.pmod(number.try_cast("bigint"), F.lit(97))) == F.substring(d, 14, 2).try_cast("bigint"), d))


def nif(c: Column | str) -> Column:
    """13 digits whose last three are the first ten modulo 511."""
    d = digits(c)
    return F.when(d.rlike("^[0-3][0-9]{12}$"), F.when(F.pmod(F.substring(d, 1, 10).try_cast("bigint"), F.lit(511)) == F.substring(d, 11, 3).try_cast("bigint"), d))


def tva(c: Column | str) -> Column:
    """FR, a key of two digits and a valid company number: key = (12 + 3 * (number mod 97)) mod 97."""
    d = F.regexp_replace(F.upper(digits(c)), "^FR", "")
    number = F.substring(d, 3, 9)
    ok = d.rlike("^[0-9]{11}$") & F.call_function("luhn_check", number)
    return F.when(ok, F.when(F.pmod(12 + 3 * F.pmod(number.try_cast("bigint"), F.lit(97)), F.lit(97)) == F.substring(d, 1, 2).try_cast("bigint"), d))


def phone(c: Column | str) -> Column:
    """French numbers in international form `+33 1 23 45 67 89`, others with a + as they are; else null."""
    d = F.regexp_replace(col(c), r"[\s.()/-]", "")
    national = F.coalesce(F.nullif(F.regexp_extract(d, r"^(?:\+33|0033)0?([1-9][0-9]{8})$", 1), F.lit("")), F.nullif(F.regexp_extract(d, r"^0([1-9][0-9]{8})$", 1), F.lit("")))
    parts = [F.substring(national, 1, 1), *[F.substring(national, i, 2) for i in (2, 4, 6, 8)]]
    return F.coalesce(F.when(national.isNotNull(), F.concat_ws(" ", F.lit("+33"), *parts)), F.when(d.rlike(r"^\+[1-9][0-9]{7,14}$"), d))


def phone_score(c: Column | str) -> Column:
    d = F.regexp_replace(col(c), r"[\s.()/-]", "")
    return F.when(phone(c).isNotNull(), 100).when(d.rlike("^[0-9]{8,15}$"), 75).otherwise(5)


def date(c: Column | str) -> Column:
    """`dd/MM/yyyy`, `MM/yyyy` or `yyyy` by what the value names, in French or English order; null for values of
    digits only and years outside 1870 to 2120."""
    s = F.lower(to_ascii(F.trim(col(c))))
    for number, names in MONTHS.items():
        s = F.regexp_replace(s, rf"\b({names})\b\.?", number)
    s = F.regexp_replace(F.regexp_replace(s, r"(?<=[0-9])(er|st|nd|rd|th)\b", ""), r"[\s,.-]+", "/")
    day_first, year_first, month_only = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(t.*|/[0-9].*)?$", r"^([0-9]{1,2})/([0-9]{4})$"

    def part(x: Column, *found: tuple[str, int]) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(x, p, g), F.lit("")) for p, g in found]).cast("int")

    def parts(x: Column) -> Column:
        return F.struct(part(x, (day_first, 3), (year_first, 1), (month_only, 2)).alias("y"), part(x, (day_first, 2), (year_first, 2), (month_only, 1)).alias("m"), part(x, (day_first, 1), (year_first, 3)).alias("d"))

    def shown(p: Column) -> Column:
        swap = (p["m"] > 12) & (p["d"] <= 12)
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        m, d = F.when(swap, p["d"]).otherwise(p["m"]), F.when(swap, p["m"]).otherwise(p["d"])
        ok = p["y"].between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12)
        full = F.concat_ws("/", two(d), two(m), p["y"].cast("string"))
        return F.when(ok & d.isNotNull() & F.try_to_timestamp(full, F.lit("dd/MM/yyyy")).isNotNull(), full).when(ok & d.isNull(), F.concat_ws("/", two(m), p["y"].cast("string")))

    # each step is bound once: as plain nesting the text would be rewritten for every part
    bound = F.transform(F.transform(F.array(s), parts), shown)
    return F.when(~F.coalesce(col(c).rlike("^[0-9]+$"), F.lit(True)), F.get(bound, F.lit(0)))


def year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"\b((?:19|20)[0-9]{2})\b", 1), F.lit(""))
