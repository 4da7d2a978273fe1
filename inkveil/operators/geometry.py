"""Geometry of pages: text with inferred spaces, rectangles of matches, and the union of native and recognised regions.

A page is a row (keys, text, spans), spans array<struct<start, end, text, rect, ink_w>> in reading order, offsets in
UTF-8 bytes. Work that goes through a page's glyphs in order runs in Arrow batches, a page at a time.
"""

from __future__ import annotations

import bisect
import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECT = "struct<x:float,y:float,w:float,h:float>"
SPAN = f"struct<start:int,end:int,text:string,rect:{RECT},ink_w:float>"
REGION = f"page_index int, rects array<{RECT}>, source_text string, category string, confidence float, included boolean, source string"
#: Gaps inside words that the typical gap is taken of, its bounds and start, and how much wider a space is.
_GAPS, _LEAST, _MOST, _START, _SPACE = 64, 3.0, 20.0, 6.0, 1.55


def valid(r) -> bool:
    return all(math.isfinite(v) and abs(v) <= 1e6 for v in r) and r[2] > 0 and r[3] > 0


def same_line(a, b) -> bool:
    return abs(a[1] - b[1]) < 0.6 * max(min(a[3], b[3]), 4.0)


class _Typical:
    """Median of the last gaps."""

    def __init__(self):
        self.order, self.sorted = deque(), []

    def add(self, gap: float) -> None:
        if len(self.order) == _GAPS:
            self.sorted.pop(bisect.bisect_left(self.sorted, self.order.popleft()))
        self.order.append(gap)
        bisect.insort(self.sorted, gap)

    def value(self) -> float:
        if not self.sorted:
            return _START
        n = len(self.sorted)
        middle = (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2
        return min(max(middle, _LEAST), _MOST)


def spaced(spans: list[dict]) -> tuple[str, list[int]]:
    """Text with spaces where gaps are wide and line ends where lines change; for each byte its span, or -1."""
    out, owner, typical = [], [], _Typical()
    for i, s in enumerate(spans):
        r = _rect(s["rect"])
        if i:
            p = spans[i - 1]
            q = _rect(p["rect"])
            gap = r[0] - (q[0] + (q[2] if p["ink_w"] is None else p["ink_w"]))
            mark = ""
            if not same_line(q, r):
                mark = "\n"
            elif math.isfinite(gap) and gap > 0:
                if gap > typical.value() * _SPACE:
                    mark = " "
                else:
                    typical.add(gap)
            out.append(mark)
            owner += [-1] * len(mark)
        out.append(s["text"])
        owner += [i] * len(s["text"].encode())
    return "".join(out), owner


def _rect(r) -> tuple:
    return (r["x"], r["y"], r["w"], r["h"]) if isinstance(r, dict) else tuple(r)


def merge(rects: list[tuple]) -> list[tuple]:
    """Valid rectangles from top to bottom, neighbours on a line joined where the gap is no more than half the narrower one, or 4."""
    out: list[tuple] = []
    for r in sorted(filter(valid, rects), key=lambda r: (r[1], r[0])):
        if out and same_line(out[-1], r) and r[0] - (out[-1][0] + out[-1][2]) <= max(0.5 * min(out[-1][2], r[2]), 4.0):
            a = out[-1]
            x, y = min(a[0], r[0]), min(a[1], r[1])
            out[-1] = (x, y, max(a[0] + a[2], r[0] + r[2]) - x, max(a[1] + a[3], r[1] + r[3]) - y)
        else:
            out.append(r)
    return out


def fingerprint(rects: list[tuple]) -> tuple:
    return tuple(sorted(tuple(round(v * 100) for v in r) for r in rects))


def _places(text: bytes, needle: bytes):
    """All places, overlapping ones too, at the first bytes of characters."""
    at = text.find(needle)
    while at >= 0:
        yield at, at + len(needle)
        at = text.find(needle, at + 1)


def _raw_rects(spans: list[dict], start: int, end: int, needle: bytes) -> list[tuple]:
    """Rectangles of the spans in a range of the raw text, if their text there is the needle."""
    got, rects = b"", []
    for s in spans:
        data = s["text"].encode()
        if s["end"] > start and s["start"] < end and data and valid(_rect(s["rect"])):
            got += data[max(start - s["start"], 0) : max(end - s["start"], 0)]
            rects.append(_rect(s["rect"]))
    return merge(rects) if got == needle else []


def locate(text: str, spans: list[dict], hits: list[dict]) -> tuple[list[dict], list[dict]]:
    """Regions of hits (start, end, text, ...), one for each place where a hit's text is, and the hits that are nowhere.

    A text is looked for once: at the hit's own offsets, then in the spaced text, then in the raw one.
    """
    loose, owner = spaced(spans)
    raw, loose_bytes = text.encode(), loose.encode()
    regions, nowhere, seen, done = [], [], set(), set()
    for h in hits:
        if h["text"] in done or not h["text"]:
            continue
        done.add(h["text"])
        needle = h["text"].encode()
        found = [_raw_rects(spans, h["start"], h["end"], needle)] if h.get("start") is not None else []
        for a, b in _places(loose_bytes, needle):
            ids = dict.fromkeys(i for i in owner[a:b] if i >= 0)
            found.append(merge([_rect(spans[i]["rect"]) for i in ids]))
        found += [_raw_rects(spans, a, b, needle) for a, b in _places(raw, needle)]
        found = [r for r in found if r]
        for rects in found:
            key = fingerprint(rects)
            if key not in seen:
                seen.add(key)
                regions.append(h | {"rects": rects})
        if not found:
            nowhere.append(h)
    return regions, nowhere


def contains(outer: list[tuple], inner: list[tuple], slack: float = 0.5) -> bool:
    """Whether each inner rectangle lies in an outer one."""
    holds = lambda a, b: a[0] - slack <= b[0] and a[1] - slack <= b[1] and b[0] + b[2] <= a[0] + a[2] + slack and b[1] + b[3] <= a[1] + a[3] + slack
    return bool(inner) and all(any(holds(a, b) for a in outer) for b in inner)


def overlap(a: list[tuple], b: list[tuple]) -> bool:
    return any(min(x[0] + x[2], y[0] + y[2]) > max(x[0], y[0]) and min(x[1] + x[3], y[1] + y[3]) > max(x[1], y[1]) for x in a for y in b)


def _loose(s: str) -> str:
    return "".join(ch for ch in s if ch.isalnum()).lower()


def alike(a: str, b: str) -> bool:
    x, y = _loose(a), _loose(b)
    return bool(x and y) and (x in y or y in x)


def union(native: list[dict], recognised: list[dict]) -> list[dict]:
    """Regions of one page from both layers, without those that others cover; no covered ink is lost.

    By confidence, then area, then native first: a region that a kept one covers goes; one that covers a kept one takes its
    place; one that overlaps a kept one is joined to it. Kept ones that a grown one covers go too.
    """
    score = lambda r: r["confidence"] if r["confidence"] is not None and math.isfinite(r["confidence"]) else -math.inf
    ranked = sorted([*((r, 0) for r in native), *((r, 1) for r in recognised)], key=lambda x: (-score(x[0]), -sum(w * h for *_, w, h in x[0]["rects"]), x[1]))
    kept: list[dict] = []
    for r, _ in ranked:
        near = [k for k in kept if alike(k["source_text"], r["source_text"])]
        hit = next((k for k in near if contains(k["rects"], r["rects"]) or overlap(k["rects"], r["rects"])), None)
        if hit is None:
            kept.append(dict(r))
        elif not contains(hit["rects"], r["rects"]):
            hit["rects"] = list(r["rects"]) if contains(r["rects"], hit["rects"]) else [*hit["rects"], *r["rects"]]
            kept = [k for k in kept if k is hit or not (alike(hit["source_text"], k["source_text"]) and contains(hit["rects"], k["rects"]))]
    return kept


# --- the same over DataFrames ---


def with_spaced_text(pages: DataFrame, name: str = "spaced") -> DataFrame:
    """pages with the spaced text; null spans count as none."""
    @F.pandas_udf("string")
    def run(spans: pd.Series) -> pd.Series:
        return pd.Series([spaced([] if s is None else list(s))[0] for s in spans])

    return pages.withColumn(name, run("spans"))


def map_matches(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index"), matches: str = "matches") -> DataFrame:
    """A row for each region, and for each match that lies nowhere (rects empty, unmapped true)."""
    found = f"array<struct<text:string,category:string,confidence:float,detector_id:string,source:string,start:int,rects:array<{RECT}>,unmapped:boolean>>"

    @F.pandas_udf(found)
    def run(text: pd.Series, spans: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for t, s, h in zip(text, spans, hits, strict=True):
            regions, nowhere = locate(t or "", [] if s is None else list(s), [] if h is None else list(h))
            shape = lambda m, r, u: {k: m[k] for k in ("text", "category", "confidence", "detector_id", "source", "start")} | {"rects": [dict(zip("xywh", map(float, x), strict=True)) for x in r], "unmapped": u}
            out.append([shape(m, m["rects"], False) for m in regions] + [shape(m, [], True) for m in nowhere])
        return pd.Series(out)

    return pages.select(*keys, F.explode(run("text", "spans", matches)).alias("r_")).select(*keys, "r_.*")


def union_regions(native: DataFrame, recognised: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Regions of both layers, united page by page.

    A page's regions come together in one shuffle, in the order of their rows, and many pages make an Arrow batch.
    """
    fields = [f for f in StructType.fromDDL(REGION) if f.name != "page_index"]
    of = f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in fields)}>"
    by = [*keys, "page_index"]

    def layer(df: DataFrame, number: int) -> DataFrame:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
        return df.select(*keys, F.col("page_index").cast("int").alias("page_index"), F.struct(F.lit(number).alias("layer"), F.monotonically_increasing_id().alias("row"), *columns).alias("r_"))

    @F.pandas_udf(f"array<{of}>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for regions in pages:
            sides: tuple[list, list] = ([], [])
            for r in regions:
                sides[r["layer"]].append({f.name: r[f.name] for f in fields} | {"rects": [_rect(x) for x in r["rects"]]})
            out.append([r | {"rects": [dict(zip("xywh", map(float, x), strict=True)) for x in r["rects"]]} for r in union(*sides)])
        return pd.Series(out)

    pages = layer(native, 0).unionByName(layer(recognised, 1)).groupBy(*by).agg(F.sort_array(F.collect_list("r_")).alias("r_"))
    united = pages.select(*by, F.explode_outer(run("r_")).alias("r_")).where("r_ is not null").select(*by, "r_.*")
    return united.select(*keys, *StructType.fromDDL(REGION).names)
