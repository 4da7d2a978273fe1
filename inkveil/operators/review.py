"""From detection to regions that are masked: layers of text, searched and manual regions, findings, and what has to hold before masking.

What can fail is a DataFrame of the offending rows; require() turns one that isn't empty into an error, so that nothing is
exported by mistake. Null texts count as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import loose_text, needs_ocr, normalize_text, settled
from . import findings
from .detect import MATCH, DetectOptions, with_matches
from .geometry import RECT, locate
from .mask import masked, occurrences

#: Characters of a row of a text without geometry: a place there is a rectangle one high, so that findings hold it exactly.
ROW = 100_000


class Refused(ValueError):
    """Something that would leave a secret in the output, or mask nothing."""


def require(offending: DataFrame, what: str) -> None:
    rows = offending.limit(5).collect()
    if rows:
        raise Refused(f"{what}: {', '.join(str(r[0]) for r in rows)}")


# --- detection on more than one text of a page ---


def union_matches(*matches: Column) -> Column:
    """Matches of several detectors by start, in the detectors' order where they start together; none is dropped."""
    ranked = F.transform(F.concat(*matches), lambda m, i: F.struct(m.start.alias("a"), i.alias("b"), m.alias("m")))
    return F.transform(F.array_sort(ranked), lambda r: r.m)


def best_by_text(*layers: Column) -> Column:
    """Of matches with the same text the most confident, then the longest, then that of the first layer; by text."""
    ranked = F.concat(*(_ranked(layer, k) for k, layer in enumerate(layers)))
    ordered = F.array_sort(ranked)
    first = F.filter(F.transform(ordered, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: (y.i == 0) | (F.get(ordered, y.i - 1).text != y.x.text))
    return F.transform(first, lambda y: y.x.m)


def _ranked(layer: Column, k: int) -> Column:
    sane = lambda c: F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(c)
    return F.transform(layer, lambda m: F.struct(m.text.alias("text"), (-sane(m.confidence)).alias("c"), (m.start - m.end).alias("n"), F.lit(k).alias("k"), m.alias("m")))


def with_layered_matches(pages: DataFrame, opts: DetectOptions | None = None, texts: tuple[str, ...] = ("spaced", "text"), name: str = "matches") -> DataFrame:
    """pages with the matches of several texts of a page, one for each text found."""
    out = pages
    for i, t in enumerate(texts):
        out = with_matches(out, opts, t, f"{name}_{i}_")
    layers = [F.col(f"{name}_{i}_") for i in range(len(texts))]
    return settled(out.withColumn(name, best_by_text(*layers)), name).drop(*(f"{name}_{i}_" for i in range(len(texts))))


# --- layers of text ---


def chosen_layers(pages: DataFrame, mode: str, native: str = "text", recognised: str = "recognised", least: float = 0.45) -> DataFrame:
    """pages with the names of the layers that are searched: off native, force recognised, on both, auto both where the native text is poor."""
    poor = needs_ocr(mode, F.coalesce(F.col(native), F.lit("")), least)
    both = F.array(F.lit(native), F.lit(recognised))
    if mode == "force":
        return pages.withColumn("layers", F.array(F.lit(recognised)))
    return pages.withColumn("layers", F.when(poor, both).otherwise(F.array(F.lit(native))))


def still_unmapped(unmapped: DataFrame, mapped: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index"), text: str = "text") -> DataFrame:
    """Unmapped matches whose loose text no other layer has mapped on the page."""
    there = mapped.select(*keys, loose_text(F.col(text)).alias("loose_")).distinct()
    return unmapped.withColumn("loose_", loose_text(F.col(text))).join(there, [*keys, "loose_"], "left_anti").drop("loose_")


def truth_hits(text: Column, truths: Column) -> Column:
    """array of struct(text, hit): which of the distinct true strings a page's text holds, in loose form or with white space runs as one."""
    def of(forms: Column) -> Column:
        def hit(t: Column) -> Column:
            loose, spaced = loose_text(t), normalize_text(t)
            return ((loose != "") & forms.loose.contains(loose)) | ((spaced != "") & forms.spaced.contains(spaced))

        return F.transform(F.array_distinct(truths), lambda t: F.struct(t.alias("text"), hit(t).alias("hit")))

    t = F.coalesce(text, F.lit(""))
    bound = F.array(F.struct(loose_text(t).alias("loose"), normalize_text(t).alias("spaced")))
    return F.get(F.transform(bound, of), F.lit(0))


# --- regions that people ask for ---


def search_matches(text: Column, texts: tuple[str, ...]) -> Column:
    """array<MATCH> of all places of the strings, overlapping ones too, as custom matches of full confidence."""
    whole = F.coalesce(text, F.lit(""))
    before = lambda at: F.octet_length(F.substr(whole, F.lit(1), at))

    def of(t: str) -> Column:
        return F.transform(
            occurrences(whole, F.lit(t)),
            lambda o: F.struct(
                before(o.char_start).alias("start"), (before(o.char_start) + len(t.encode())).alias("end"), o.char_start.alias("char_start"), o.char_end.alias("char_end"),
                F.lit(t).alias("text"), F.lit("custom").alias("category"), F.lit(1.0).cast("float").alias("confidence"), F.lit("search").alias("detector_id"), F.lit("search").alias("source"),
            ),
        )

    return union_matches(F.array().cast(f"array<{MATCH}>"), *(of(t).cast(f"array<{MATCH}>") for t in texts))


def search_regions(pages: DataFrame, texts: tuple[str, ...], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and REGION for each place of the strings in the pages' glyphs, in the spaced text and in the raw one."""

    @F.pandas_udf(f"array<struct<text:string,rects:array<{RECT}>>>")
    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            hits = [{"text": x, "start": None, "end": None} for x in dict.fromkeys(texts) if x]
            found = [r for h in hits for r in locate(t or "", [] if s is None else list(s), [h])[0]]
            out.append([{"text": r["text"], "rects": [dict(zip("xywh", map(float, x), strict=True)) for x in r["rects"]]} for r in found])
        return pd.Series(out)

    rows = pages.select(*keys, "page_index", F.explode(run(F.coalesce("text", F.lit("")), "spans")).alias("r_"))
    return rows.select(*keys, *_region(F.col("page_index"), F.col("r_.rects"), F.col("r_.text"), "search"))


def _region(page: Column, rects: Column, text: Column, source: str) -> list[Column]:
    return [page.alias("page_index"), rects.alias("rects"), text.alias("source_text"), F.lit("custom").alias("category"), F.lit(1.0).cast("float").alias("confidence"), F.lit(True).alias("included"), F.lit(source).alias("source")]


def manual_regions(spark: SparkSession, regions: list[tuple], key: str = "doc_id string") -> DataFrame:
    """Regions of (key, page_index, (x, y, w, h), label)."""
    for _, page, (x, y, w, h), _ in regions:
        if page < 0 or not (w > 0 and h > 0 and all(abs(v) <= 1e6 for v in (x, y, w, h))):
            raise Refused(f"no valid rectangle: {(page, x, y, w, h)}")
    rows = spark.createDataFrame([(k, p, [r], label) for k, p, r, label in regions], f"{key}, page int, rects array<{RECT}>, label string")
    return rows.select(key.split()[0], *_region(F.col("page"), F.col("rects"), F.col("label"), "manual"))


def missing_texts(documents: DataFrame, regions: DataFrame, texts: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """text, key: requested strings that lie nowhere in a document."""
    wanted = documents.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, texts)).cast("array<string>")).alias("text"))
    return wanted.join(regions.select(key, F.col("source_text").alias("text")), [key, "text"], "left_anti").select("text", key)


def unmapped_matches(mapped: DataFrame) -> DataFrame:
    """text first, of matches that have no place on their page."""
    return mapped.where("unmapped").select("text", *(c for c in mapped.columns if c != "text"))


def without_regions(documents: DataFrame, regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of which nothing would be masked."""
    return documents.select(key).join(regions.where("included").select(key), key, "left_anti")


# --- findings back to regions ---


def regions_of(reviewed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and REGION of the items of sound findings files (column findings, JSON); unmapped items have no region."""
    items = reviewed.where(F.size(findings.errors(F.col("findings"))) == 0).select(*keys, F.explode_outer(findings.parse(F.col("findings"))["items"]).alias("i"))
    items = items.where(F.col("i").isNotNull() & ~F.coalesce(F.col("i.unmapped"), F.lit(False)))
    return items.select(*keys, F.col("i.page").alias("page_index"), F.col("i.rects").alias("rects"), F.col("i.text").alias("source_text"), F.col("i.category").alias("category"), F.col("i.confidence").alias("confidence"), F.col("i.included").alias("included"), F.col("i.source").alias("source"))


def text_rects(start: Column, end: Column) -> Column:
    """The rectangle of characters of a text without geometry."""
    return F.array(F.struct((start % ROW).cast("float").alias("x"), F.floor(start / ROW).cast("float").alias("y"), (end - start).cast("float").alias("w"), F.lit(1.0).cast("float").alias("h")))


def text_findings(documents: DataFrame, opts: DetectOptions | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, findings of text documents (doc_id, text), for review."""
    found = with_matches(documents.select("doc_id", "text"), opts)
    found = found.select("doc_id", F.explode_outer(union_matches(F.col("matches"), search_matches(F.col("text"), texts))).alias("m")).where(F.col("m").isNotNull())
    rows = found.select("doc_id", F.lit(0).alias("page_index"), "m.start", "m.text", "m.category", "m.confidence", "m.source", "m.detector_id", text_rects(F.col("m.char_start"), F.col("m.char_end")).alias("rects"), F.lit(False).alias("unmapped"))
    return findings.build(rows, documents.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content")))


def redact_reviewed(documents: DataFrame, reviewed: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, matches, masked, checks of text documents by reviewed findings (doc_id, findings), and by strings.

    Refuses files with errors or made for other texts, documents without a file, strings that lie nowhere in a document that
    has a file, and documents of which nothing would be masked.
    """
    from .verify import text_removal

    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = d.join(reviewed.select("doc_id", "findings"), "doc_id", "full")
    require(both.where(F.col("findings").isNull() | F.col("text").isNull()).select("doc_id"), "documents without findings, or findings without document")
    require(reviewed.select(findings.errors(F.col("findings")).alias("e"), "doc_id").where(F.size("e") > 0), "findings with errors")
    require(both.where(findings.is_stale(F.col("findings"), F.col("text"))).select("doc_id"), "findings of other texts")
    searched = both.select("doc_id", search_matches(F.col("text"), texts).alias("s"))
    places = searched.select("doc_id", F.explode_outer(F.transform("s", lambda m: m.text)).alias("source_text")).where(F.col("source_text").isNotNull())
    require(missing_texts(d, places, texts), "strings that lie nowhere")
    regions = regions_of(reviewed)
    asked = places.select("doc_id", F.lit(True).alias("included"))
    require(without_regions(d, regions.select("doc_id", "included").unionByName(asked)), "documents of which nothing would be masked")
    chosen = regions.where("included").select("doc_id", F.explode("rects").alias("r"), "category", "confidence", "source_text", "source")
    start = (F.col("r.y") * ROW + F.col("r.x")).cast("int")
    spans = chosen.groupBy("doc_id").agg(F.collect_list(F.struct(start.alias("char_start"), (start + F.col("r.w").cast("int")).alias("char_end"), F.col("source_text").alias("text"), "category", "confidence", "source")).alias("matches"))
    out = d.join(spans, "doc_id", "left")
    asked = F.transform(search_matches(F.col("text"), texts), lambda m: F.struct(m.char_start.alias("char_start"), m.char_end.alias("char_end"), m.text.alias("text"), m.category.alias("category"), m.confidence.alias("confidence"), m.source.alias("source")))
    kind = "array<struct<char_start:int,char_end:int,text:string,category:string,confidence:float,source:string>>"
    out = out.withColumn("matches", F.array_sort(F.concat(F.coalesce("matches", F.array().cast(kind)), asked.cast(kind))))
    out = out.withColumn("masked", masked(F.col("text"), F.col("matches")))
    secrets = F.array_distinct(F.transform("matches", lambda m: m.text))
    return settled(out.withColumn("checks", F.array(text_removal(secrets, F.col("masked")))), "matches", "masked", "checks")
