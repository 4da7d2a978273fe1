"""Checks of candidate strings as column expressions: null or empty strings are never valid.

Lengths are in UTF-8 bytes where they bound whole strings; digits and letters are ASCII unless said otherwise.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import IBANS, NOT_CITIES, NOT_NAMES, STATES, STREETS
from .text import ascii_lower, let, trimmed

#: Years that a date may lie ahead.
YEARS_AHEAD = 15


def as_of_year(now: float | None = None) -> int:
    """The year by the clock, with years of 365 days. Bound once when a query is planned."""
    return 1970 + int((time.time() if now is None else now) // 86_400) // 365


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _any(words) -> str:
    return "|".join(words)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != "")


def email(c: Column) -> Column:
    return _yes(c.rlike(r"(?s)^.+@[^@]+\.(?:[A-Z]{2,24}|[A-Za-z][a-z]{1,23})$"))


def ssn(c: Column) -> Column:
    return _yes(_digits(c).rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))


def luhn(c: Column) -> Column:
    return _yes(let(_digits(c), lambda d: d.rlike(r"^(?!([0-9])\1+$)[0-9]{13,19}$") & F.call_function("luhn_check", d)))


def iban(c: Column) -> Column:
    listed = _any(f"{k}[0-9]{{2}}{v}" for k, v in IBANS.items())
    shape = rf"^(?=.{{15,34}}$)(?:{listed}|(?!{_any(IBANS)})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+)$"

    def step(rest: Column, ch: Column) -> Column:
        return let(F.ascii(ch), lambda code: F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97)

    def check(s: Column) -> Column:
        turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
        # the case decides the order: the sum is taken of strings of the right shape only
        return F.when(s.rlike(shape), F.aggregate(F.split(turned, ""), F.lit(0), step) == 1).otherwise(False)

    return _yes(let(F.upper(F.regexp_replace(c, r"(?U)\s+", "")), check))


def aba(c: Column) -> Column:
    def check(d: Column) -> Column:
        at = lambda i: F.ascii(F.substr(d, F.lit(i), F.lit(1))) - 48
        total = 3 * (at(1) + at(4) + at(7)) + 7 * (at(2) + at(5) + at(8)) + at(3) + at(6) + at(9)
        return (F.length(d) == 9) & let(total, lambda n: (n != 0) & (n % 10 == 0))

    return _yes(let(_digits(c), check))


def _dotted_phone(t: Column) -> Column:
    def check(groups: Column) -> Column:
        n = F.size(groups)

        def ok(g: Column, i: Column) -> Column:
            return let(F.regexp_replace(g, "[- ()]", ""), lambda bare: bare.rlike("^[0-9]+$") & (F.length(bare) <= F.when((i == 0) & ((n != 3) | (bare == g)), 3).otherwise(4)))

        return n.isin(3, 4) & F.forall(F.transform(groups, ok), lambda x: x)

    return let(F.split(t, r"\.", -1), check)


def phone(c: Column) -> Column:
    def check(x: Column) -> Column:
        t, d = x.t, x.d
        n = F.length(d)
        signed = t.contains("+")
        no_phone = t.rlike(r"(?U)^(?:\d{3}-\d{2}-\d{4}|\d{2}-\d{7})$") | (t.contains(".") & ~signed & ~_dotted_phone(t))
        account = ~signed & ~t.contains("(") & t.rlike(r"(?U)^(?:[0-9]{4}\s+){2,}[0-9]{2}$")
        spaced = t.rlike(r"(?U)^[0-9]{1,4}(?:\s+[0-9]{1,4}){1,3}$") | t.rlike(r"(?iU)^(?:[0-9]{1,4}\s+){1,3}(?:x[0-9]+|ext[0-9]+)$")
        grouped = signed | t.contains("(") | t.contains("-") | spaced | ((n == 10) & (d >= "2")) | d.rlike("^1[2-9][0-9]{9}$")
        return n.between(7, 15) & ~no_phone & ~account & grouped & ~d.rlike(r"^([0-9])\1*$")

    return _yes(let(trimmed(c), lambda t: let(F.struct(t.alias("t"), _digits(t).alias("d")), check)))


def ipv4(c: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return _yes(c.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _day_exists(day: Column, month: Column, year: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & day.between(1, 31) & (day <= last)


_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def date(year_now: int | None = None) -> Callable[[Column], Column]:
    last_year = (as_of_year() if year_now is None else year_now) + YEARS_AHEAD
    in_range = lambda year: year.between(1900, last_year)
    parted = r"^([0-9]{1,9})([/.-])([0-9]{1,9})\2([0-9]{1,9})$"
    named = r"(?U)^([A-Za-z]+)\.*\s+([0-9]{1,9}),*\s+([0-9]{1,9})$"

    def parted_ok(t: Column) -> Column:
        a, b, z = (F.regexp_extract(t, parted, i) for i in (1, 3, 4))
        parts = F.struct(F.length(a).alias("na"), F.length(z).alias("nz"), *(_number(p).alias(k) for p, k in ((a, "x"), (b, "y"), (z, "w"))))

        def check(v: Column) -> Column:
            year = F.when(v.nz == 4, v.w).when((v.nz == 2) & (v.w <= 35), 2000 + v.w).when(v.nz == 2, 1900 + v.w)
            either = let(year, lambda y: (v.x <= 31) & (v.y <= 31) & in_range(y) & (_day_exists(v.x, v.y, y) | _day_exists(v.y, v.x, y)))
            return F.when(v.na == 4, in_range(v.x) & _day_exists(v.w, v.y, v.x)).otherwise(either)

        return let(parts, check)

    def glued_ok(t: Column) -> Column:
        parts = F.struct(*(_number(F.substr(t, F.lit(i), F.lit(k))).alias(n) for i, k, n in ((1, 2, "x"), (3, 2, "y"), (5, 4, "w"))))
        return let(parts, lambda v: in_range(v.w) & (_day_exists(v.x, v.y, v.w) | _day_exists(v.y, v.x, v.w)))

    def named_ok(t: Column) -> Column:
        def month(name: Column) -> Column:
            return F.when(name.rlike(f"^(?:{_MONTHS})$"), (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substr(name, F.lit(1), F.lit(3))) + 2) / 3).cast("int")

        m = let(ascii_lower(F.regexp_extract(t, named, 1)), month)
        parts = F.struct(m.alias("y"), _number(F.regexp_extract(t, named, 2)).alias("x"), _number(F.regexp_extract(t, named, 3)).alias("w"))
        return let(parts, lambda v: in_range(v.w) & _day_exists(v.x, v.y, v.w))

    def check(t: Column) -> Column:
        return F.when(t.rlike(parted), parted_ok(t)).when(t.rlike("^[0-9]{8}$"), glued_ok(t)).when(t.rlike(named), named_ok(t)).otherwise(False)

    return lambda c: _yes(let(trimmed(c), check))


_AGE = "(?:[1-9][0-9]?|1[01][0-9]|120)"


def age_years_old(c: Column) -> Column:
    return _yes(trimmed(c).rlike(rf"(?i)^{_AGE}-years?-old$"))


def age_aged(c: Column) -> Column:
    return _yes(trimmed(c).rlike(rf"(?U)^(?i:aged)\s*{_AGE}$"))


def age_labeled(c: Column) -> Column:
    return _yes(trimmed(c).rlike(rf"(?U)^(?i:age)\s*:\s*{_AGE}$"))


def age_number(c: Column) -> Column:
    return _yes(trimmed(c).rlike(rf"^{_AGE}$"))


def zip_code(c: Column) -> Column:
    return _yes(trimmed(c).rlike("^(?!00000)[0-9]{5}$"))


def street(c: Column) -> Column:
    suffix = rf"(?U)(?:^|\s)(?i:{_any(STREETS)}),*(?:\s|$)"
    return _yes(let(trimmed(c), lambda t: F.octet_length(t).between(8, 80) & t.rlike("^[0-9]{1,6}(?![0-9])") & t.rlike(suffix)))


NAME_LABEL = r"^(?i:(?:(?:patient|doctor) )?name ?:|dr\.)"


def without_label(c: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(c), NAME_LABEL, ""))


def name_word(c: Column) -> Column:
    shape = r"^(?=.{2,24}$)[A-Z](?:['-]*[a-z]|['-]+[A-Z])*$"
    return c.rlike(shape) & ~c.isin(*NOT_NAMES)


def name_parts(t: Column) -> Column:
    """Words of a spaced name, else the parts that start with a capital."""
    return F.when(t.contains(" "), split_words(t)).otherwise(F.regexp_extract_all(t, F.lit(r"(?s)[A-Z][^A-Z]*|^[^A-Z]+"), F.lit(0)))


def leading_names(parts: Column) -> Column:
    """How many parts stay when those at the end that are no names go, two at least."""
    last = F.array_max(F.transform(parts, lambda w, i: F.when(name_word(w), i + 1).otherwise(0)))
    return F.least(F.greatest(last, F.lit(2)), F.size(parts))


def person_name(c: Column) -> Column:
    """Two to four name words, spaced or run together, after labels and before words that are no names."""

    def check(parts: Column) -> Column:
        return let(leading_names(parts), lambda kept: kept.between(2, 4) & F.forall(F.slice(parts, F.lit(1), F.greatest(kept, F.lit(0))), name_word))

    return _yes(F.octet_length(trimmed(c)).between(4, 80) & let(without_label(c), lambda t: let(name_parts(t), check)))


def name_before_date(c: Column) -> Column:
    return _yes(let(split_words(without_label(c)), lambda parts: F.size(parts).between(1, 4) & F.forall(parts, name_word)))


def organisation(c: Column) -> Column:
    def check(t: Column) -> Column:
        named = t.rlike(r"(?is) (?:inc\.?|llc|ltd\.?)$") | t.rlike("(?i)institute|hospital| medical center| clinic")
        return F.octet_length(t).between(8, 120) & named & let(split_words(t), lambda words: (F.size(words) >= 2) & F.exists(words, lambda w: w.rlike("^[A-Z]")))

    return _yes(let(trimmed(c), check))


def city(c: Column) -> Column:
    """One to four city words; a state of one word may follow."""
    one_word = [s for s in STATES if " " not in s]

    def check(words: Column) -> Column:
        n = F.size(words)
        kept = F.when((n >= 2) & F.element_at(words, -1).isin(*one_word), F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(words)
        clean = F.transform(kept, lambda w: F.regexp_replace(w, "[,.]+$", ""))
        return F.when(n > 0, let(clean, lambda k: F.size(k).between(1, 4) & F.forall(k, lambda w: w.rlike("^[A-Z][a-z]+$") & ~w.isin(*NOT_CITIES))))

    return _yes(let(split_words(c), check))


def hospital(c: Column) -> Column:
    return _yes(trimmed(c).rlike("^(?i:HOSP)[0-9]{6,12}$"))


def provider(c: Column) -> Column:
    return _yes(trimmed(c).rlike("^(?i:DR)[0-9]{3,8}[A-Za-z]?$"))


def by_name(year_now: int | None = None) -> dict[str, Callable[[Column], Column]]:
    """Validators by the names that the catalog uses."""
    return {
        "email": email, "ssn": ssn, "luhn": luhn, "iban": iban, "aba": aba, "phone": phone, "ipv4": ipv4, "date": date(year_now),
        "age-years-old": age_years_old, "age-aged": age_aged, "age-labeled": age_labeled, "zip": zip_code, "street": street,
        "name": person_name, "name-before-date": name_before_date, "org": organisation, "city": city, "hospital": hospital, "provider": provider,
    }
