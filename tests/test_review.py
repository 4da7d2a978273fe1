"""Layers, regions, findings back to masks, glyphs, rasters and file information."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions.catalog import BY_ID
from inkveil.operators import glyphs, mask, raster, review, verify
from inkveil.operators.detect import DetectOptions
from inkveil.operators.geometry import RECT, SPAN
from inkveil.sources import pages

EMAIL = DetectOptions(patterns=(BY_ID["email"],))


def test_layers_and_best_by_text(spark):
    rows = [(1, "mail jane@example.com", "mailjane@ example.com"), (2, None, "a@b.com"), (3, "a@b.com a@b.com", "a@b.com"), (4, None, None)]
    found = review.with_layered_matches(spark.createDataFrame(rows, "doc_id int, spaced string, text string"), EMAIL).collect()
    assert {r.doc_id: [(m.text, m.start) for m in r.matches] for r in found} == {1: [("jane@example.com", 5)], 2: [("a@b.com", 0)], 3: [("a@b.com", 0)], 4: []}
    match = lambda text, conf, start, end, det: f"named_struct('start', {start}, 'end', {end}, 'text', '{text}', 'confidence', float('{conf}'), 'detector_id', '{det}')"
    a, b = (F.expr(f"array({', '.join(x)})") for x in ([match("x", 0.5, 0, 3, "a"), match("y", "nan", 4, 5, "a")], [match("x", 0.9, 9, 10, "b"), match("y", 0.1, 1, 2, "b"), match("z", 0.2, 1, 2, "b")]))
    row = spark.range(1).select(review.best_by_text(a, b).alias("best"), review.union_matches(a, b).alias("all")).first()
    assert [(m.text, m.detector_id) for m in row.best] == [("x", "b"), ("y", "b"), ("z", "b")]
    assert [(m.text, m.start) for m in row["all"]] == [("x", 0), ("y", 1), ("z", 1), ("y", 4), ("x", 9)]


def test_search_and_guards(spark):
    d = spark.createDataFrame([(1, "é aaa aaa"), (2, "none"), (3, None)], "doc_id int, text string")
    found = d.select("doc_id", review.search_matches(F.col("text"), ("aa", "é")).alias("m")).collect()
    assert {r.doc_id: [(m.start, m.end, m.char_start, m.text) for m in r.m] for r in found} == {1: [(0, 2, 0, "é"), (3, 5, 2, "aa"), (4, 6, 3, "aa"), (7, 9, 6, "aa"), (8, 10, 7, "aa")], 2: [], 3: []}
    places = spark.createDataFrame([(1, "aa", True)], "doc_id int, source_text string, included boolean")
    assert [(r.text, r.doc_id) for r in review.missing_texts(d, places, ("aa",)).orderBy("doc_id").collect()] == [("aa", 2), ("aa", 3)]
    with pytest.raises(review.Refused, match="nowhere: aa, aa"):
        review.require(review.missing_texts(d, places, ("aa",)), "nowhere")
    review.require(review.missing_texts(d.where("doc_id = 1"), places, ("aa",)), "nowhere")
    assert sorted(r.doc_id for r in review.without_regions(d, places).collect()) == [2, 3]
    mapped = spark.createDataFrame([("a", False), ("b", True)], "text string, unmapped boolean")
    with pytest.raises(review.Refused):
        review.require(review.unmapped_matches(mapped), "unmapped")
    for bad in ((1, 0, (0.0, 0.0, 0.0, 1.0), "x"), (1, -1, (0.0, 0.0, 1.0, 1.0), "x"), (1, 0, (float("nan"), 0.0, 1.0, 1.0), "x")):
        with pytest.raises(review.Refused):
            review.manual_regions(spark, [bad], "doc_id int")
    r = review.manual_regions(spark, [(1, 2, (1.0, 2.0, 3.0, 4.0), "label")], "doc_id int").first()
    assert (r.category, r.confidence, r.source, r.included, r.page_index) == ("custom", 1.0, "manual", True, 2)


def test_reviewed_redaction_fails_closed(spark):
    long = "x" * 250_001 + " a@b.com"  # a place beyond a row of characters
    d = spark.createDataFrame([(1, "mail a@b.com é"), (2, long)], "doc_id int, text string")
    f = review.text_findings(d, EMAIL).cache()
    out = {r.doc_id: r for r in review.redact_reviewed(d, f, ("a",)).collect()}
    assert out[1].masked == "m█il ███████ é" and out[2].masked == "x" * 250_001 + " " + "█" * 7
    assert not out[1].checks[0].passed or "a" not in out[1].masked  # forms under four bytes aren't looked for
    out = {r.doc_id: r for r in review.redact_reviewed(d, f).collect()}
    assert all(r.checks[0].passed for r in out.values()) and [m.text for m in out[1].matches] == ["a@b.com"]
    edit = lambda g: spark.createDataFrame([(r.doc_id, json.dumps(g(json.loads(r.findings)))) for r in f.collect()], "doc_id int, findings string")
    excluded = edit(lambda j: j | {"items": [i | {"included": False} for i in j["items"]]})
    unknown = edit(lambda j: j | {"items": [i | {"bogus": 1} for i in j["items"]]})
    for bad, why in ((excluded, "nothing would be masked"), (unknown, "errors"), (f.where("doc_id = 1"), "without"), (f.withColumn("doc_id", 3 - F.col("doc_id")), "other texts")):
        with pytest.raises(review.Refused, match=why):
            review.redact_reviewed(d, bad)
    with pytest.raises(review.Refused, match="nowhere"):
        review.redact_reviewed(d, f, ("mail",))
    assert review.redact_reviewed(d, excluded, ("a@b",)).where("instr(masked, 'a@b') > 0").count() == 0


def test_glyphs(spark):
    g = lambda seq, text, mode, at, x, y=0.0, w=4.0, h=10.0, page=0: ("d", page, seq, text, mode, [1.0, at], x, y, w, h)
    rows = [
        g(0, "J", "fill", 0.0, 0.0), g(1, "J", "stroke", 0.0, 0.0), g(2, "é", "fill", 8.0, 8.0), g(3, "é", "fill", 8.0, 8.0),  # a second fill is a glyph
        g(4, "x", "fill", 9.0, 30.0), g(5, "y", "fill", 10.0, 31.0, 20.0), g(6, "z", "fill", 1.0, 0.0, 20.0, 0.0), g(0, "p", "fill", 0.0, 0.0, page=1), g(1, "q", "fill", 0.0, 4.0, h=0.0, page=1),
    ]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, seq int, text string, mode string, transform array<double>, x double, y double, w double, h double")
    out = {r.page_index: r for r in glyphs.collected(df).collect()}
    assert out[0].text == "Jééxy" and out[1].text == "p"
    assert [(s.start, s.end, s.text, s.rect.w, s.ink_w) for s in out[0].spans] == [(0, 1, "J", 8.0, 4.0), (1, 3, "é", 4.0, 4.0), (3, 5, "é", 22.0, 4.0), (5, 6, "x", 4.0, 4.0), (6, 7, "y", 4.0, 4.0)]
    assert glyphs.collected(df.limit(0)).count() == 0


def test_rasters(spark):
    white = np.full((30, 60, 4), 255, dtype=np.uint8)
    schema = "doc_id int, page_index int, width int, height int, scale double, pixels binary"
    rasters = spark.createDataFrame([(i, 0, 60, 30, 1.0, white.tobytes()) for i in (1, 2)], schema)
    region = lambda d, rect, included=True: (d, 0, [rect], "secret", "person", 0.9, included, "regex")
    kind = f"doc_id int, page_index int, rects array<{RECT}>, source_text string, category string, confidence float, included boolean, source string"
    regions = spark.createDataFrame([region(1, (10.0, 10.0, 20.0, 8.0)), region(2, (10.0, 10.0, 5.0, 5.0), False)], kind)
    done = raster.painted(rasters, regions)
    image = {r.doc_id: np.frombuffer(bytes(r.pixels), np.uint8).reshape(30, 60, 4) for r in done.collect()}
    assert (image[2] == 255).all() and (image[1][10:18, 10:30, :3] == 0).all() and image[1][29, 59, 0] == 255
    passed = lambda r, g: {x.doc_id: x.check.passed for x in raster.pixel_removal(r, g).collect()}
    assert passed(done, regions) == {1: True, 2: True} and passed(rasters, regions) == {1: False, 2: True}
    assert passed(done.where("doc_id = 2"), regions) == {1: False, 2: True}
    off = spark.createDataFrame([region(1, (500.0, 10.0, 5.0, 5.0))], kind)
    assert passed(done, off)[1] is False
    with pytest.raises(Exception, match="off the page"):
        raster.painted(rasters, off).collect()
    clear = spark.createDataFrame([(1, 0, 60, 30, 1.0, (white * 0).tobytes())], schema)
    with pytest.raises(Exception, match="opaque"):
        raster.painted(clear, regions).collect()
    guard = lambda w, h, s: spark.range(1).select(raster.size_error(F.lit(w), F.lit(h), F.lit(s)).alias("e")).first().e
    assert [guard(*x) for x in ((612.0, 792.0, 2.0), (612.0, 792.0, float("inf")), (612.0, 0.0, 1.0), (1.0, 700.0, 100.0), (2000.0, 2000.0, 6.0))] == [None, "scale", "page", "side", "pixels"]


def test_preparation():
    image = np.zeros((4, 4, 4), np.uint8)
    image[...] = (120, 130, 140, 255)
    image[0, 0, :3], image[3, 3, :3] = 40, 200
    gray = mask.grayscale(image)
    assert gray[1, 1] == (120 * 299 + 130 * 587 + 140 * 114) // 1000
    low = mask.stretch(gray, 2, 98)
    # 2 percent of 16 pixels is less than one, which the value 0 reaches; 98 percent is 15, which the gray of most reaches
    assert gray[1, 1] == 128 and low[0, 0] == 80 and low[1, 1] == low[3, 3] == 255
    assert (mask.stretch(np.full((20, 20), 7, np.uint8)) == 7).all() and mask.sharpen(np.full((2, 2), 7, np.uint8)).tolist() == [[7, 7], [7, 7]]
    dot = np.zeros((3, 3), np.uint8)
    dot[1, 1] = 80
    assert mask.sharpen(dot)[1, 1] == 100 and mask.sharpen(dot)[0, 0] == 0


def test_file_information(spark):
    snap = verify.metadata_snapshot
    assert snap(b"<</Title (Patient Jane \\(Doe\\)) /Author (B\\157b)>>") == {"title": "Patient Jane (Doe)", "author": "Bob"}
    assert snap(b"/Title <FEFF00e9> /Subject <00410042004300>")["title"] == "é"
    assert snap(b"/Subject <004100420043>")["subject"] == "ABC" and snap(b"/Keywords (\xff\xfeA\x00)")["keywords"] == "A"
    assert snap(b"/Title (\xe9)")["title"] == "�" and snap(b"/Title ()") == {"title": ""} and snap(b"/Title ( )")["title"].strip() == ""
    assert snap(b"<<>> stream\n/Title (no)endstream (/Title (no)) % /Title (no)\n/Tit#6ce (yes)") == {"title": "yes"}
    clean = lambda b: dict((c[0], c[1]) for c in verify.check_pdf(b, []))["metadata-clean"]
    assert not clean(b"<</Title (Patient Jane Doe) /Author (Bob)>>") and clean(b"<</Title ( ) /Producer (tool)>>") and clean(b"")
    assert verify.is_encrypted(b"trailer <</Encrypt 3 0 R>>") and not verify.is_encrypted(b"(/Encrypt)")
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.7\n/Title (x)")), ("b", bytearray(b"%PDF-1.7\n/Encrypt 1 0 R")), ("c", bytearray(b"text"))], "path string, content binary")
    assert {r.path: r.error for r in pages.opened(files).collect()} == {"a": None, "b": "encrypted", "c": "not-pdf"}


def test_recognised_lines(spark):
    word = lambda t: (t, (1.0, 2.0, 3.0, 4.0))
    lines = spark.createDataFrame([("d", 0, 1, [word("é"), word("b")]), ("d", 0, 0, [word("x")]), ("d", 0, 2, [word("cc")])], f"doc_id string, page_index int, line int, words array<struct<text:string,rect:{RECT}>>")
    (r,) = pages.recognised_text(lines).collect()
    assert r.text == "é b cc" and [(s.start, s.end, s.text) for s in r.spans] == [(0, 2, "é"), (3, 4, "b"), (5, 7, "cc")]
    assert pages.recognised_text(lines).schema["spans"].dataType.simpleString() == spark.createDataFrame([], f"spans array<{SPAN}>").schema["spans"].dataType.simpleString()
