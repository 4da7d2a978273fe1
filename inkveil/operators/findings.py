"""Findings: the file that people review between detection and masking, and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import GROUPS
from .verify import has_other_fields

VERSION = 1
RECT = "struct<x:float,y:float,w:float,h:float>"
ITEM = f"struct<id:string,page:int,text:string,category:string,confidence:float,source:string,rects:array<{RECT}>,included:boolean,unmapped:boolean,detector_id:string>"
SCHEMA = f"version int, source struct<path:string,sha256:string>, items array<{ITEM}>"
SOURCES = ("regex", "manual", "search")


def build(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, findings (JSON): items numbered from 1, mapped ones first; unmapped ones are shown but not included.

    matches: doc_id, page_index, start, text, category, confidence, source, detector_id, rects, unmapped.
    documents: doc_id, path, content. Documents without matches get a file without items.
    """
    order = Window.partitionBy("doc_id").orderBy("unmapped", "page_index", "start", "category", "text")
    sane = F.when(F.isnan("confidence"), F.lit(0.0).cast("float")).otherwise(F.col("confidence"))
    item = F.struct(
        F.col("n").cast("string").alias("id"), F.col("page_index").alias("page"), "text", "category", sane.alias("confidence"), "source",
        F.coalesce("rects", F.array().cast(f"array<{RECT}>")).alias("rects"), (~F.col("unmapped")).alias("included"), "unmapped", "detector_id",
    )
    numbered = matches.withColumn("n", F.row_number().over(order))
    items = numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", item.alias("item")))).alias("items"))
    whole = documents.join(items, "doc_id", "left")
    listed = F.coalesce(F.transform("items", lambda x: x["item"]), F.array().cast(f"array<{ITEM}>"))
    return whole.select("doc_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.struct("path", F.sha2("content", 256).alias("sha256")).alias("source"), listed.alias("items"))).alias("findings"))


def parse(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


def item_errors(i: Column) -> Column:
    """Codes of what is wrong with one item."""
    bad = lambda c: F.coalesce(c, F.lit(True))
    rects_ok = F.forall(i["rects"], lambda r: (r.w > 0) & (r.h > 0) & F.forall(F.array(r.x, r.y, r.w, r.h), lambda v: ~F.isnan(v) & (F.abs(v) <= 1e6)))
    unmapped = F.coalesce(i["unmapped"], F.lit(False))
    found = [
        ("id", bad(i["id"] == "")),
        ("confidence", bad(~i["confidence"].between(0, 1))),
        ("category", bad(~i["category"].isin(*GROUPS))),
        ("source", bad(~i["source"].isin(*SOURCES))),
        ("unmapped-included", unmapped & bad(i["included"])),
        ("unmapped-rects", unmapped & bad(F.size(i["rects"]) > 0)),
        ("included-without-rects", ~unmapped & bad(i["included"]) & bad(F.size(i["rects"]) == 0)),
        ("rects", bad(~rects_ok)),
    ]
    return F.array_compact(F.array(*(F.when(b, F.lit(code)) for code, b in found)))


def _unknown(json: Column) -> Column:
    """Whether there are unknown fields at any level."""
    parts = F.from_json(json, "source string, items array<string>")
    rects = lambda i: F.coalesce(F.from_json(i, "rects array<string>").rects, F.array().cast("array<string>"))
    fields = ("id", "page", "text", "category", "confidence", "source", "rects", "included", "unmapped", "detector_id")
    items = F.exists(parts["items"], lambda i: has_other_fields(i, fields) | F.exists(rects(i), lambda r: has_other_fields(r, ("x", "y", "w", "h"))))
    return has_other_fields(json, ("version", "source", "items")) | has_other_fields(parts.source, ("path", "sha256")) | F.coalesce(items, F.lit(False))


def errors(json: Column) -> Column:
    """Codes of what is wrong with a findings file; empty for a sound one."""
    f = parse(json)
    keys = F.json_object_keys(json)
    found = [
        ("not-json", F.coalesce(f.isNull() | keys.isNull(), F.lit(True))),
        ("unknown-field", keys.isNull() | _unknown(json)),
        ("version", F.coalesce(f.version != VERSION, F.lit(True))),
        ("duplicate-id", F.coalesce(F.size(F.array_distinct(F.transform(f["items"], lambda i: i["id"]))) < F.size(f["items"]), F.lit(True))),
    ]
    whole = F.array_compact(F.array(*(F.when(b, F.lit(code)) for code, b in found)))
    return F.concat(whole, F.coalesce(F.array_distinct(F.flatten(F.transform(f["items"], item_errors))), F.array().cast("array<string>")))


def is_stale(json: Column, content: Column) -> Column:
    """Whether the file was made for other content; the case of the hash doesn't matter."""
    return F.coalesce(F.lower(F.get_json_object(json, "$.source.sha256")) != F.sha2(content, 256), F.lit(True))
