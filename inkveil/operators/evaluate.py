"""Evaluation of found strings against a list of true ones, by document and over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, loose_ascii, trimmed

FORMS = "plain string, loose string, age string"


def forms(c: Column) -> Column:
    """What two strings are compared by: the plain and the loose form, and the years of an age."""
    plain = F.lower(trimmed(F.regexp_replace(c, r"(?U)\s+", " ")))

    def of(p: Column) -> Column:
        age = F.regexp_extract(p, r"^(?:age\s*:\s*(\d{1,3})|aged\s+(\d{1,3})|(\d{1,3})-year-old|(\d{1,3}))$", 0)
        return F.struct(p.alias("plain"), loose_ascii(c).alias("loose"), F.regexp_extract(age, r"\d{1,3}", 0).alias("age"))

    return let(plain, of)


def same(a: Column, b: Column) -> Column:
    """Whether one form holds the other, or both are the same age; an empty string is like nothing."""
    held = lambda x, y: (x != "") & (y != "") & (x.contains(y) | y.contains(x))
    return F.coalesce((a.plain != "") & (b.plain != "") & (held(a.plain, b.plain) | held(a.loose, b.loose) | ((a.age != "") & (a.age == b.age))), F.lit(False))


def per_document(found: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, truths, hits, found, false_hits, recall, precision; found and truth have key and text.

    A true string is hit by any found one; a found string that hits none is false, as often as it occurs. Both lists of a
    document meet as arrays: their product is never made into rows. Empty denominators give 1.
    """
    f = found.groupBy(key).agg(F.collect_list(forms(F.col("text"))).alias("f"))
    t = truth.select(key, "text").distinct().groupBy(key).agg(F.collect_list(forms(F.col("text"))).alias("t"))
    none = F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':') for x in FORMS.split(', '))}>>")
    j = f.join(t, key, "full").select(key, F.coalesce("f", none).alias("f"), F.coalesce("t", none).alias("t"))
    hits = F.size(F.filter("t", lambda g: F.exists("f", lambda x: same(x, g))))
    wrong = F.size(F.filter("f", lambda x: ~F.exists("t", lambda g: same(x, g))))
    counted = j.select(key, F.size("t").alias("truths"), hits.alias("hits"), F.size("f").alias("found"), wrong.alias("false_hits"))
    return counted.select("*", *_rates(F.col("hits"), F.col("truths"), F.col("found") - F.col("false_hits"), F.col("found")))


def _rates(hits: Column, truths: Column, right: Column, found: Column) -> tuple[Column, Column]:
    return F.when(truths == 0, 1.0).otherwise(hits / truths).alias("recall"), F.when(found == 0, 1.0).otherwise(right / found).alias("precision")


def micro(documents: DataFrame) -> DataFrame:
    """One row over all documents of per_document."""
    s = documents.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("truths", "hits", "found", "false_hits")))
    return s.select("*", *_rates(F.col("hits"), F.col("truths"), F.col("found") - F.col("false_hits"), F.col("found")))


def rough_type(c: Column) -> Column:
    """A coarse kind of a true string, by its shape."""

    def of(t: Column) -> Column:
        digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
        return (
            F.when(t.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(t.rlike(r"^(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}-\d{2}-\d{2})$"), "date")
            .when(t.rlike(r"(?i)^HOSP\d+$"), "hosp_id")
            .when(t.rlike(r"(?i)^DR\d+[A-Z]?$"), "dr_id")
            .when(t.rlike(r"(?i)^\d{1,3}-year-old$"), "age_phrase")
            .when(t.rlike(r"^(?:0{0,2}[1-9]|0?[1-9]\d|1[01]\d|120)$"), "age_num")
            .when(t.rlike(r"^\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}$") | (t.startswith("+") & (digits >= 10)), "phone_or_id")
            .when(t.rlike("[A-Za-z]"), "name_or_org_text")
            .otherwise("other")
        )

    return let(trimmed(c), of)
