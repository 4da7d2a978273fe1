"""Sanitisers: from a raw match to the string that is reported, as column expressions; null drops the candidate.

Each returns the string and, where it is known exactly, how many characters went from the front, else null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validators as V
from .catalog import NAME_ENDS, STATES
from .text import let, trimmed

Cleaned = tuple[Column, Column | None]


def email(raw: Column) -> Cleaned:
    """The domain's last label is cut to its lower-case run, or else to six letters; a field label glued in front goes."""
    local, host, tail = (F.regexp_extract(raw, r"(?s)^(.*)@(.*)\.([A-Za-z]+)$", i) for i in (1, 2, 3))
    kept = F.regexp_replace(local, r"^(?=[A-Z])(?i:contact|email|e-mail|mail|tel|phone|call)(?=[a-z].{2})", "")
    top = let(F.regexp_extract(tail, "^[a-z]{2,24}", 0), lambda lower: F.when(lower != "", lower).otherwise(F.regexp_extract(tail, "^[A-Za-z]{2,6}", 0)))
    return let(top, lambda t: F.when(t != "", F.concat(kept, F.lit("@"), host, F.lit("."), t))), F.length(local) - F.length(kept)


def iban(raw: Column) -> Cleaned:
    """The longest valid beginning of 15 characters or more."""

    def longest(t: Column) -> Column:
        ends = F.filter(F.sequence(F.greatest(F.length(t), F.lit(15)), F.lit(15), F.lit(-1)), lambda n: (n <= F.length(t)) & V.iban(F.substr(t, F.lit(1), n)))
        return trimmed(F.substr(t, F.lit(1), F.get(ends, F.lit(0))))

    return let(F.substr(F.regexp_replace(raw, r"[^A-Za-z0-9 \t\n\f\r]", ""), F.lit(1), F.lit(42)), longest), None


def ssn(raw: Column) -> Cleaned:
    return let(F.regexp_replace(raw, "[^0-9-]", ""), lambda t: F.when(V.ssn(t), F.regexp_replace(t, "-+$", ""))), None


def age(raw: Column) -> Cleaned:
    t = F.regexp_replace(raw, "^[^A-Za-z]+", "")
    return t, F.length(raw) - F.length(t)


def phone(raw: Column) -> Cleaned:
    return F.translate(raw, "\n\r", ""), None


def _name_without_end(c: Column) -> Column:
    """A name without the words after it that are no part of it.

    The longest beginning of three words or more that is a name and doesn't end in a word like "Date"; else the first two
    words if they are a name; else the first word, unless it is such a word itself.
    """
    ends = lambda w: (F.octet_length(w) <= 2) | F.lower(w).isin(*NAME_ENDS)

    def cut(words: Column) -> Column:
        n = F.size(words)
        joined = lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")
        long_ = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.when((k > 2) & ~ends(F.get(words, k - 1)) & V.person_name(joined(k)), k)))
        short = F.when((n >= 2) & V.person_name(joined(F.lit(2))), joined(F.lit(2)))
        one = F.get(words, F.lit(0))
        return F.coalesce(let(long_, lambda k: F.when(k.isNotNull(), joined(k))), short, F.when((n >= 1) & ~ends(one), one), F.lit(""))

    return let(V.split_words(c), cut)


def born_on(raw: Column) -> Cleaned:
    name = trimmed(F.regexp_replace(trimmed(raw), r"(?s)(?:,|born on).*$", ""))
    return let(name, lambda t: F.when(F.size(V.split_words(t)) >= 2, _name_without_end(t))), None


def before_date(raw: Column) -> Cleaned:
    name = F.regexp_extract(trimmed(raw), r"(?U)^(.*\S)\s+\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$", 1)
    return let(name, lambda t: F.when(t != "", _name_without_end(t))), None


def _labeled(raw: Column) -> Column:
    label = r"^(?i:(?:(?:patient|doctor) )?name ?:)"
    return let(trimmed(raw), lambda t: F.when(t.rlike(label), F.nullif(trimmed(F.regexp_replace(t, label, "")), F.lit(""))))


def labeled(raw: Column) -> Cleaned:
    return let(_labeled(raw), lambda rest: F.when(rest.isNotNull(), _name_without_end(rest))), None


def glued(raw: Column) -> Cleaned:
    """A name run together, without the parts after it that are no names."""

    def whole(kept: Column) -> Column:
        return F.when((F.size(kept) >= 2) & F.forall(kept, V.name_word), F.array_join(kept, ""))

    def cut(rest: Column) -> Column:
        name = let(F.when(~rest.contains(" "), V.name_parts(rest)), lambda parts: let(F.slice(parts, F.lit(1), F.greatest(V.leading_names(parts), F.lit(0))), whole))
        return F.when(rest.isNotNull(), let(F.coalesce(name, rest), _name_without_end))

    return let(_labeled(raw), cut), None


def title(raw: Column) -> Cleaned:
    return _name_without_end(F.regexp_replace(raw, r"^Dr[. ]", "")), None


def city(raw: Column) -> Cleaned:
    """Without the state, which has to be in its usual case."""

    def cut(t: Column) -> Column:
        rest = trimmed(F.regexp_replace(trimmed(F.regexp_replace(t, rf"(?:{'|'.join(STATES)})$", "")), "[,.]+$", ""))
        return let(rest, lambda r: F.when((r != t) & (F.octet_length(r) >= 3), r).otherwise(raw))

    return let(trimmed(raw), cut), None


BY_NAME: dict[str, Callable[[Column], Cleaned]] = {
    "email": email, "iban": iban, "ssn": ssn, "age": age, "phone": phone, "born-on": born_on, "before-date": before_date,
    "labeled": labeled, "glued": glued, "title": title, "city": city,
}
