"""Text forms, masking, verification, findings, geometry, evaluation, streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.functions.catalog import BY_ID
from inkveil.operators import evaluate, findings, geometry, mask, verify
from inkveil.operators.detect import DetectOptions
from inkveil.plans.pipeline import certificates, redact


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_text_forms(spark):
    s = "  Jane  DOE É "
    assert one(spark, T.normalize_text(F.col("s")), s=s) == "jane doe É"
    assert one(spark, T.compact_text(F.col("s")), s=s) == "janedoeÉ"
    assert one(spark, T.loose_text(F.col("s")), s="Jäne-Doe 1") == "jänedoe1"
    assert one(spark, T.loose_ascii(F.col("s")), s="Jäne-Doe 1") == "jnedoe1"
    assert one(spark, T.similar(F.col("a"), F.col("b")), a="Jane Doe", b="JANEDOE x")
    assert not one(spark, T.similar(F.col("a"), F.col("b")), a="", b="x")


def test_layer_quality(spark):
    score = lambda s: one(spark, T.layer_quality(F.col("s")), s=s)
    assert (score("").score, score("").reasons) == (0.0, ["empty"])
    word = "abc "
    assert score(word * 3).score == pytest.approx(0.55) and score(word * 6).score == pytest.approx(0.8) and score(word * 20).score == 1.0
    assert score("x" * 200).reasons == ["no-word-breaks", "long-unbroken-run"]
    assert score("漢" * 200).score == 1.0
    assert "mojibake" in score("Ã© Â½ " * 30).reasons
    assert one(spark, T.needs_ocr("auto", F.col("s")), s="short") and not one(spark, T.needs_ocr("off", F.col("s")), s="")
    wins = lambda a, b: one(spark, T.retry_wins(F.col("a"), F.col("b")), a=a, b=b)
    assert (wins("a" * 10, "a" * 14), wins("a" * 10, "a" * 15), wins("", "..."), wins("", "a")) == (False, True, False, True)


def test_masking(spark):
    spans = F.array(*(F.struct(F.lit(a).alias("char_start"), F.lit(b).alias("char_end")) for a, b in ((6, 8), (0, 2), (1, 4))))
    assert one(spark, mask.masked(F.col("s"), spans), s="éabcdefgh") == "████de██h"
    assert one(spark, mask.masked(F.col("s"), spans, F.lit("[X]")), s="éabcdefgh") == "[X]de[X]h"
    got = one(spark, mask.occurrences(F.col("s"), F.lit("aa")), s="aaa b")
    assert [(r.char_start, r.char_end) for r in got] == [(0, 2), (1, 3)]
    assert one(spark, mask.occurrences(F.col("s"), F.lit("")), s="aaa") == []


def test_pixels():
    white = np.full((40, 60, 4), 255, dtype=np.uint8)
    out = mask.paint(white, [(5, 5, 10, 5)], 2.0)
    assert mask.is_black(out, (5, 5, 10, 5), 2.0) and not mask.is_black(white, (5, 5, 10, 5), 2.0)
    assert (white == 255).all() and (out[10:20, 10:30, :3] == 0).all()
    with pytest.raises(ValueError):
        mask.is_black(out, (500, 5, 10, 5), 2.0)
    with pytest.raises(ValueError):
        mask.paint(white, [(0, 0, float("nan"), 1)], 1.0)
    with pytest.raises(ValueError):
        mask.opaque_rgb(white * 0)
    gray = mask.grayscale(out)
    assert gray.shape == (40, 60) and mask.stretch(gray).max() == 255 and mask.sharpen(gray).shape == gray.shape


def test_padded_rects(spark):
    for h, tall, wide in ((4, 4, 9), (10, 5.5, 14.25), (20, 7, 21)):
        x, y, w, b = (one(spark, c) for c in mask.padded_rect(F.lit(10.0), F.lit(10.0), F.lit(30.0), F.lit(float(h))))
        assert (w - 30, b - h) == (wide, tall)
    assert one(spark, mask.iou((F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)), (F.lit(5.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)))) == pytest.approx(1 / 3)


def test_redact_verify_certify(spark):
    docs = spark.createDataFrame([(1, "mail jane@example.com twice jane@example.com"), (2, "clean"), (3, None)], "doc_id int, text string")
    r = redact(docs, DetectOptions(patterns=(BY_ID["email"],)), extra=("twice",))
    rows = {x.doc_id: x for x in r.collect()}
    assert rows[1].masked == "mail ████████████████ █████ ████████████████" and rows[2].masked == "clean"
    assert all(x.checks[0].passed for x in rows.values())
    c = certificates(r).collect()
    assert [x.doc_id for x in c] == [1] and "jane" not in c[0].certificate
    errors = lambda s: one(spark, verify.certificate_errors(F.col("s")), s=s)
    assert errors(c[0].certificate) == []
    sound = json.loads(c[0].certificate)
    for change, code in (({"format": "x"}, "format"), ({"extra": 1}, "unknown-field"), ({"tool": sound["tool"] | {"x": 1}}, "unknown-field"), ({"redactions": [sound["redactions"][0] | {"text": "jane"}]}, "unknown-field"), ({"createdAt": "now"}, "created-at"), ({"verification": {"passed": False, "checks": []}}, "verification"), ({"output": {"sha256": "zz", "pageCount": 1}}, "hash")):
        assert code in errors(json.dumps(sound | change))
    assert "not-json" in errors("[")
    assert one(spark, verify.certificate_matches(F.col("s"), F.lit(rows[1].masked)), s=c[0].certificate)
    failed = r.withColumn("checks", F.transform("checks", lambda k: F.struct(k.id.alias("id"), F.lit(False).alias("passed"), k.detail.alias("detail"))))
    assert certificates(failed).count() == 0


def test_masks_and_places_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([0, 1, 5, 300, 9000])))
        spans = [(a, a + k) for a, k in ((rng.randrange(len(text) + 1), rng.choice([1, 2, 30])) for _ in range(rng.choice([0, 1, 2, 400]))) if a + k <= len(text)]
        rows.append((i, text, spans))
    df = spark.createDataFrame([*rows, (-1, None, [])], "id int, t string, s array<struct<char_start:int,char_end:int>>")
    out = {r.id: r for r in df.select("id", mask.masked(F.col("t"), F.col("s")).alias("m"), mask.masked(F.col("t"), F.col("s"), F.lit("<>")).alias("k"), *(mask.occurrences(F.col("t"), F.lit(x)).alias(n) for n, x in (("aa", "aa"), ("e", r"\E"), ("smile", "😀")))).collect()}
    assert out[-1].m is None and out[-1].aa == []
    for i, text, spans in rows:
        chars = list(text)
        for a, b in spans:
            chars[a:b] = mask.BLOCK * (b - a)
        assert out[i].m == "".join(chars)
        groups: list = []
        for a, b in sorted(spans):
            if groups and a <= groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], b)
            else:
                groups.append([a, b])
        ends = [0, *(b for _, b in groups)]
        assert out[i].k == "".join(text[e:a] + "<>" for e, (a, _) in zip(ends, groups, strict=False)) + text[ends[-1] :]
        for got, x in ((out[i].aa, "aa"), (out[i].e, r"\E"), (out[i].smile, "😀")):
            assert [tuple(g) for g in got] == [(j, j + len(x)) for j in range(len(text)) if text.startswith(x, j)]


def test_text_removal(spark):
    outs = spark.createDataFrame([(1, "has 123-45-6789"), (2, "J a n e"), (3, None)], "doc_id int, masked string")
    secrets = spark.createDataFrame([(1, "1 2 3"), (2, "JANE"), (3, "gone")], "doc_id int, secret string")
    assert {r.doc_id: r.passed for r in verify.verify_text(outs, secrets).collect()} == {1: True, 2: False, 3: True}


def test_pdf_bytes():
    names = verify.scan_pdf(b"/Annots (a \\) /Annots (x)) /AnnotsX 1 /Foo/Annots 2 % /Annots\n<2F416E>")[1]
    assert names.count(b"/Annots") == 2
    data = b"1 0 obj <</Length 9>>\nstream\r\nsecret123\nendstream endobj (secret9) /Prev 3 stream secret"
    blank, names, _ = verify.scan_pdf(data)
    assert len(blank) == len(data) and b"secret123" not in blank and b"secret9" in blank and b"/Prev" in names
    checks = {c[0]: c[1] for c in verify.check_pdf(data, [b"secret123"])}
    assert checks == {"metadata-clean": True, "annotations-removed": True, "raw-byte-scan": True, "full-save": False}
    assert not dict((c[0], c[1]) for c in verify.check_pdf(data, [b"sec ret9"]))["raw-byte-scan"]
    assert not dict((c[0], c[1]) for c in verify.check_pdf(b"/Meta#64ata 1", []))["metadata-clean"]


def test_findings(spark):
    rect = [(1.0, 2.0, 3.0, 4.0)]
    matches = spark.createDataFrame(
        [(1, 0, 5, "b", "ssn", 0.9, "regex", "regex:x", [], True), (1, 0, 9, "a", "person", 0.5, "search", None, rect, False), (1, 0, 2, "c", "email", float("nan"), "regex", "regex:y", rect, False)],
        f"doc_id int, page_index int, start int, text string, category string, confidence float, source string, detector_id string, rects array<{findings.RECT}>, unmapped boolean",
    )
    docs = spark.createDataFrame([(1, "p", "content"), (2, "q", "other")], "doc_id int, path string, content string")
    built = {r.doc_id: json.loads(r.findings) for r in findings.build(matches, docs).collect()}
    assert [(i["id"], i["text"], i["included"], i["confidence"]) for i in built[1]["items"]] == [("1", "c", True, 0.0), ("2", "a", True, 0.5), ("3", "b", False, 0.9)]
    assert built[2]["items"] == []
    errors = lambda f: one(spark, findings.errors(F.col("s")), s=json.dumps(f))
    assert errors(built[1]) == []
    item = built[1]["items"][0]
    for change, code in (({"id": ""}, "id"), ({"bogus": 1}, "unknown-field"), ({"rects": [{"x": 0, "y": 0, "w": 1, "h": 1, "z": 1}]}, "unknown-field"), ({"confidence": 2}, "confidence"), ({"category": "?"}, "category"), ({"source": "?"}, "source"), ({"rects": []}, "included-without-rects"), ({"unmapped": True}, "unmapped-included"), ({"rects": [{"x": 0, "y": 0, "w": 0, "h": 1}]}, "rects")):
        assert code in errors(built[1] | {"items": [item | change]})
    assert "duplicate-id" in errors(built[1] | {"items": [item, item]}) and "version" in errors(built[1] | {"version": 2})
    assert not one(spark, findings.is_stale(F.col("s"), F.lit("content")), s=json.dumps(built[1])) and one(spark, findings.is_stale(F.col("s"), F.lit("x")), s=json.dumps(built[1]))


def _line(text, x=0.0, y=0.0, gap_at=()):
    spans, at = [], 0
    for i, ch in enumerate(text):
        x += 12.0 if i in gap_at else 0.0
        n = len(ch.encode())
        spans.append({"start": at, "end": at + n, "text": ch, "rect": {"x": x, "y": y, "w": 8.0, "h": 10.0}, "ink_w": 7.0})
        at, x = at + n, x + 8.0
    return spans


def test_spaced_text_and_mapping(spark):
    spans = _line("JohnSmith", gap_at=(4,))
    text, owner = geometry.spaced(spans)
    assert text == "John Smith" and owner[4] == -1 and owner[5] == 4
    regions, nowhere = geometry.locate("JohnSmith", spans, [{"text": "John Smith", "start": 0, "end": 9}, {"text": "nope", "start": 0, "end": 4}, {"text": "John Smith", "start": 1, "end": 3}])
    assert len(regions) == 1 and [h["text"] for h in nowhere] == ["nope"]
    two = _line("é") + [s | {"rect": s["rect"] | {"y": 50.0}} for s in _line("é")]
    for i, s in enumerate(two):
        s["start"], s["end"] = 2 * i, 2 * i + 2
    assert geometry.spaced(two)[0] == "é\né"
    assert len(geometry.locate("éé", two, [{"text": "é", "start": 0, "end": 2}])[0]) == 2
    assert geometry.merge([(0, 0, 400, 10), (420, 0, 8, 10)]) == [(0, 0, 400, 10), (420, 0, 8, 10)]
    assert geometry.merge([(0, 0, 400, 10), (402, 0, 8, 10), (0, 0, 0, 1)]) == [(0, 0, 410, 10)]
    typical = geometry._Typical()
    for v in range(64):
        typical.add(float(v) / 10)
    assert typical.value() == pytest.approx(3.15)
    typical.add(6.4)
    assert typical.value() == pytest.approx(3.25)
    pages = spark.createDataFrame([("d", 0, "JohnSmith", spans), ("e", 0, None, None)], f"doc_id string, page_index int, text string, spans array<{geometry.SPAN}>")
    assert [r.spaced for r in geometry.with_spaced_text(pages).orderBy("doc_id").collect()] == ["John Smith", ""]
    hit = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("John").alias("text"), F.lit("person").alias("category"), F.lit(0.9).cast("float").alias("confidence"), F.lit("regex:x").alias("detector_id"), F.lit("regex").alias("source")))
    mapped = geometry.map_matches(pages.withColumn("matches", hit)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.unmapped, len(r.rects)) for r in mapped] == [("d", False, 1), ("e", True, 0)]


def test_union_regions():
    r = lambda x, y, w, h, c, t="same": {"rects": [(x, y, w, h)], "source_text": t, "confidence": c}
    u = geometry.union
    assert [k["confidence"] for k in u([r(10, 10, 40, 12, 0.9)], [r(11, 10, 40, 12, 0.7)])] == [0.9]
    assert len(u([r(10, 10, 40, 12, 0.9)], [r(200, 200, 40, 12, 0.8, "other")])) == 2
    assert u([r(10, 10, 40, 12, 0.8)], [r(10.5, 10, 40, 12, 0.8)])[0]["rects"][0][0] == 10
    wide = u([r(10, 10, 100, 20, 0.7)], [r(10, 10, 60, 20, 0.95)])
    assert len(wide) == 1 and wide[0]["confidence"] == 0.95 and wide[0]["rects"] == [(10, 10, 100, 20)]
    assert u([r(10, 10, 100, 20, 0.7)], [r(12, 11, 40, 12, 0.9)])[0]["rects"][0][0] == 10
    assert len(u([r(10, 10, 40, 12, 0.8)], [r(200, 200, 40, 12, 0.9)])) == 2
    assert len(u([r(0, 0, 50, 20, 0.9), r(80, 0, 20, 20, 0.8)], [r(40, 0, 60, 20, 0.7)])) == 1


def test_union_of_layers_page_by_page(spark):
    """Pages of one layer, null keys, and ties, which the first row of a layer wins."""
    r = lambda doc, page, x, w, c, source: (doc, page, [{"x": float(x), "y": 0.0, "w": float(w), "h": 10.0}], "same", "person", c, True, source)
    schema = f"doc_id string, {geometry.REGION}"
    native = spark.createDataFrame([r("a", 0, 0, 50, 0.9, "n1"), r("a", 0, 10, 50, 0.9, "n2"), r(None, 0, 0, 9, None, "n3"), r("b", 1, 0, 9, 0.5, "n4")], schema).coalesce(1)
    seen = spark.createDataFrame([r("a", 0, 5, 20, 0.9, "o1"), r("b", 0, 0, 9, 0.5, "o2"), r("b", 1, 100, 9, 0.5, "o3")], schema).coalesce(1)
    got = geometry.union_regions(native, seen)
    assert got.schema.simpleString() == native.schema.simpleString()
    assert sorted((str(g.doc_id), g.page_index, g.source, [(q.x, q.w) for q in g.rects]) for g in got.collect()) == [
        ("None", 0, "n3", [(0, 9)]), ("a", 0, "n1", [(0, 50), (10, 50)]), ("b", 0, "o2", [(0, 9)]), ("b", 1, "n4", [(0, 9)]), ("b", 1, "o3", [(100, 9)]),
    ]
    assert geometry.union_regions(native.limit(0), seen.limit(0)).count() == 0


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, "Kimberly Lawrence"), (1, "56-year-old"), (1, "missing"), (2, "x")], "doc_id int, text string")
    found = spark.createDataFrame([(1, "KimberlyLawrence"), (1, "Age: 56"), (1, "junk"), (1, "junk"), (3, "")], "doc_id int, text string")
    got = {r.doc_id: (r.truths, r.hits, r.found, r.false_hits) for r in evaluate.per_document(found, truth).collect()}
    assert got == {1: (3, 2, 4, 2), 2: (1, 0, 0, 0), 3: (0, 0, 1, 1)}
    m = evaluate.micro(evaluate.per_document(found, truth)).first()
    assert (m.recall, m.precision) == (0.5, 0.4)
    empty = evaluate.micro(evaluate.per_document(found.limit(0), truth.limit(0))).first()
    assert (empty.recall, empty.precision) == (1.0, 1.0)
    kinds = {"123-45-6789": "ssn", "1/2/20": "date", "HOSP1": "hosp_id", "120": "age_num", "121": "other", "+1234567890": "phone_or_id", "Acme": "name_or_org_text"}
    for s, kind in kinds.items():
        assert one(spark, evaluate.rough_type(F.col("s")), s=s) == kind


def test_stream_equals_batch(spark, tmp_path):
    from inkveil.operators.detect import detect
    from inkveil.streaming.detect import read_documents, write_matches

    docs = spark.createDataFrame([(i, f"mail user{i}@example.com" if i % 2 else None) for i in range(20)], "doc_id int, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    opts = DetectOptions(patterns=(BY_ID["email"],))
    query = write_matches(read_documents(spark, f"{tmp_path}/docs", 1), f"{tmp_path}/out", f"{tmp_path}/check", opts)
    assert query.awaitTermination(120)
    key = lambda df: sorted((r.doc_id, r.text, r.start) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(detect(docs, opts))


def test_sources(spark, tmp_path):
    from inkveil.sources import pages

    (tmp_path / "a.pdf").write_bytes(b"x secret1 /Annots")
    files = pages.files(spark, str(tmp_path), "*.pdf")
    secrets = files.select("path", F.lit("secret1").alias("secret"))
    checks = {c.id: c.passed for c in pages.check_files(files, secrets).first().checks}
    assert checks["raw-byte-scan"] is False and checks["annotations-removed"] is False and checks["full-save"] is True
    assert pages.layer_lengths(pages.text_pages(spark.createDataFrame([(1, "é1")], "doc_id int, text string"))).first().chars == 2
    lines = spark.createDataFrame([("d", 0, 1, [("b", None)]), ("d", 0, 0, [("a", None), ("c", None)]), ("d", 0, 2, [("dd", None)])], f"doc_id string, page_index int, line int, words array<struct<text:string,rect:{geometry.RECT}>>")
    assert pages.recognised_text(lines).first().text == "a c dd"
    pages.write_json(spark.createDataFrame([('{"version":1}',)], "j string"), "j", f"{tmp_path}/f")
    assert "not-json" not in pages.read_findings(spark, f"{tmp_path}/f").first().errors
