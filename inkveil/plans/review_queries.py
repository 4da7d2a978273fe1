"""Queries of pages, layers, regions, findings, rasters and files, and their SQL; pages are built from key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalog import BY_ID
from ..operators import findings, glyphs, raster, review, verify
from ..operators.detect import DetectOptions, detect
from ..operators.geometry import RECT, SPAN, map_matches, union_regions
from ..sources import pages as pages_
from .registry import _ITEM, _QUALITY, YEAR, _of, _query, _read


def _customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr("c_custkey", *columns)


# --- patterns on planted strings: (pattern, text, what is found or null); k is the key ---

_Z = lambda x, n: f"lpad(CAST({x} AS varchar({n})), {n}, '0')"
PLANTED = (
    ("ssn-dashed", f"concat('ssn ', {_Z('c_custkey % 900', 3)}, '-', {_Z('c_custkey % 100', 2)}, '-', {_Z('c_custkey * 7 % 10000', 4)})", "CASE WHEN c_custkey % 900 NOT IN (0, 666) AND c_custkey % 100 <> 0 AND c_custkey * 7 % 10000 <> 0 THEN right(t, 11) END"),
    ("phone-intl", f"concat('phone +1 ', {_Z('200 + c_custkey % 700', 3)}, ' 555 ', {_Z('c_custkey % 10000', 4)})", "substr(t, 7)"),
    ("us-phone-bare", f"concat('call ', {_Z('200 + c_custkey % 700', 3)}, {_Z('200 + c_custkey % 300', 3)}, {_Z('c_custkey % 10000', 4)})", "right(t, 10)"),
    ("date-ocr-glued", f"concat('dob ', {_Z('1 + c_custkey % 28', 2)}, {_Z('1 + c_custkey % 15', 2)}, CAST(1950 + c_custkey % 60 AS varchar(4)))", "CASE WHEN c_custkey % 15 < 12 OR c_custkey % 28 < 12 THEN right(t, 8) END"),
    ("us-passport", f"concat('passport X', {_Z('c_custkey', 8)})", "right(t, 9)"),
    ("hospital-id", f"concat('record hosp', {_Z('c_custkey', 10)}, '.')", "substr(t, 8, 14)"),
    ("provider-id", f"concat('seen by DR', {_Z('c_custkey', 6)}, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE '' END, ' today')", "substr(t, 9, CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE 8 END)"),
    ("age-aged", "concat('a woman Aged ', CAST(c_custkey % 150 AS varchar(4)), ' years')", "CASE WHEN c_custkey % 150 BETWEEN 1 AND 120 THEN concat('Aged ', CAST(c_custkey % 150 AS varchar(4))) END"),
    ("age-labeled", "concat('(AGE : ', CAST(c_custkey % 150 AS varchar(4)), ')')", "CASE WHEN c_custkey % 150 BETWEEN 1 AND 120 THEN concat('AGE : ', CAST(c_custkey % 150 AS varchar(4))) END"),
    ("person-born-on", "concat('patient ', CASE WHEN c_custkey % 2 = 0 THEN 'Kimberly' ELSE 'Monday' END, ' Lawrence, born on 24/05/1977')", "CASE WHEN c_custkey % 2 = 0 THEN 'Kimberly Lawrence' END"),
    ("person-before-date", f"concat('name Lisa Chung ', {_Z('1 + c_custkey % 28', 2)}, '/05/1977 born')", "'Lisa Chung'"),
    ("org-corporate", "concat('the Acme Health ', CASE WHEN c_custkey % 2 = 0 THEN 'Clinic Inc' ELSE 'clinic Inc' END, ' paid')", "CASE WHEN c_custkey % 2 = 0 THEN 'Acme Health Clinic Inc' END"),
    ("person-patient-name", "concat('Patient Name: Lisa Chung', CASE WHEN c_custkey % 2 = 0 THEN ' Contact' ELSE ',' END)", "'Lisa Chung'"),
    ("country-us", "concat('address: ', CASE WHEN c_custkey % 2 = 0 THEN 'UNITED STATES' ELSE 'United Stateside' END)", "CASE WHEN c_custkey % 2 = 0 THEN 'UNITED STATES' END"),
    ("iban", "concat('iban ', CASE WHEN c_custkey % 2 = 0 THEN 'DE89 3704 0044 0532 0130 00' ELSE 'FR1420041010050500013M02606' END, '.')", "substr(t, 6, 27)"),
)


@_query("detect_planted", " UNION ALL ".join(f"SELECT c_custkey, '{p}' AS pattern, {found} AS text, CAST(instr(t, {found}) - 1 AS int) AS start FROM (SELECT c_custkey, {text} AS t FROM customer) WHERE {found} IS NOT NULL" for p, text, found in PLANTED))
def detect_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen patterns, each on strings that it finds and on some that its validator refuses."""
    out = None
    for p, text, _ in PLANTED:
        found = detect(_customers(spark, sf_dir, f"{text} AS t"), _of(p), keys=("c_custkey",), text="t").select("c_custkey", F.lit(p).alias("pattern"), "text", "start")
        out = found if out is None else out.unionByName(found)
    return out


@_query("detect_planted_whole", " UNION ALL ".join(f"SELECT doc_id, '{p}' AS planted, {found} AS text FROM (SELECT doc_id, c_custkey, {text} AS t FROM (SELECT doc_id, doc_id AS c_custkey FROM documents)) WHERE {found} IS NOT NULL" for p, text, found in PLANTED if p in ("us-passport", "hospital-id", "person-born-on", "country-us")))
def detect_planted_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog over whole documents with planted strings behind them: what was planted is found at its place."""
    d = _read(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id AS c_custkey", "coalesce(text, '') AS text")
    planted = [(p, text) for p, text, _ in PLANTED if p in ("us-passport", "hospital-id", "person-born-on", "country-us")]
    out = None
    for p, text in planted:
        rows = d.selectExpr("doc_id", "octet_length(text) + 3 AS front", f"concat(text, ' | ', {text}) AS t")
        found = detect(rows, DetectOptions(as_of_year=YEAR), keys=("doc_id", "front"), text="t").where((F.col("start") >= F.col("front")) & (F.col("detector_id") == f"regex:{p}"))
        found = found.select("doc_id", F.lit(p).alias("planted"), "text")
        out = found if out is None else out.unionByName(found)
    return out


# --- layers ---

_LAYERS = "concat('mail user', CAST(c_custkey AS varchar(9)), '@example.com') AS spaced", "concat(CASE WHEN c_custkey % 2 = 0 THEN 'mail ' ELSE 'mail' END, 'user', CAST(c_custkey AS varchar(9)), CASE WHEN c_custkey % 3 = 0 THEN '@example.comSSN' ELSE '@ example.com' END) AS text"


@_query("layered_detection", """
WITH t AS (SELECT c_custkey, 'user' || c_custkey || '@example.com' AS a FROM customer)
SELECT c_custkey, a AS text, 5 AS start FROM t UNION ALL SELECT c_custkey, 'mail' || a, 0 FROM t WHERE c_custkey % 6 = 3""")
def layered_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the spaced and of the raw text, one for each text; addresses that one of them splits or glues are found."""
    m = review.with_layered_matches(_customers(spark, sf_dir, *_LAYERS), _of("email"))
    return m.select("c_custkey", F.explode("matches").alias("m")).select("c_custkey", "m.text", "m.start")


@_query("detector_union", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'phone,date' ELSE 'date,phone' END AS categories FROM orders")
def detector_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'phone 4155550132 date 2024-05-06' ELSE 'date 2024-05-06 phone 4155550132' END AS text")
    from ..operators.detect import with_matches

    both = with_matches(with_matches(rows, _of("date"), name="a"), _of("us-phone-bare"), name="b")
    return both.select("o_orderkey", F.array_join(F.transform(review.union_matches(F.col("a"), F.col("b")), lambda m: m.category), ",").alias("categories"))


@_query("layer_choice", _QUALITY + "SELECT doc_id, CASE WHEN n < 32 OR score <= 0.45 THEN 'text,recognised' ELSE 'text' END AS auto, 'text' AS off, 'text,recognised' AS both_, 'recognised' AS force FROM g")
def layer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    for mode, name in (("auto", "auto"), ("off", "off"), ("on", "both_"), ("force", "force")):
        d = review.chosen_layers(d, mode).withColumn(name, F.array_join("layers", ",")).drop("layers")
    return d.drop("text")


@_query("retry_choice", """
WITH p AS (SELECT c_custkey, repeat('a', (c_custkey % 7)::int) || repeat('-', (c_custkey % 3)::int) AS a, repeat('b', (c_custkey % 11)::int) || repeat('.', (c_custkey % 2)::int) AS b FROM customer),
s AS (SELECT *, length(a) AS n, length(b) AS m, CASE WHEN a = '' THEN 0 ELSE (c_custkey % 7) / length(a) END AS qa, CASE WHEN b = '' THEN 0 ELSE (c_custkey % 11) / length(b) END AS qb FROM p)
SELECT c_custkey, qb > 0 AND (qb > qa OR (qb = qa AND m > n)) AND m >= greatest(n + ceil(n / 2), 1) AS second FROM s""")
def retry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir, "concat(repeat('a', cast(c_custkey % 7 AS int)), repeat('-', cast(c_custkey % 3 AS int))) AS a", "concat(repeat('b', cast(c_custkey % 11 AS int)), repeat('.', cast(c_custkey % 2 AS int))) AS b")
    return c.select("c_custkey", T.retry_wins(F.col("a"), F.col("b")).alias("second"))


@_query("truth_hits", "SELECT c_custkey, n, CASE WHEN n = 1 THEN true WHEN n = 2 THEN c_custkey % 2 = 0 ELSE false END AS hit FROM customer, (VALUES (1), (2), (3)) v(n)")
def truth_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir, "concat('x ', upper(c_name), CASE WHEN c_custkey % 2 = 0 THEN '  (+)  (-)' ELSE '' END) AS page", "array(c_name, '(+) (-)', 'no such', c_name) AS truths")
    return c.select("c_custkey", F.posexplode(review.truth_hits(F.col("page"), F.col("truths")))).select("c_custkey", (F.col("pos") + 1).alias("n"), "col.hit")


@_query("unmapped_relaxation", "SELECT c_custkey AS doc_id, c_name AS text FROM customer WHERE c_custkey % 3 = 0")
def unmapped_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmapped matches that the other layer maps, in other case and spacing, don't fail the run."""
    c = _customers(spark, sf_dir, "c_name").selectExpr("c_custkey AS doc_id", "0 AS page_index", "c_name AS text")
    return review.still_unmapped(c, c.where("doc_id % 3 <> 0").withColumn("text", F.concat(F.lit(" "), F.upper("text")))).select("doc_id", "text")


# --- glyphs: each order's lines are glyphs of a page ---

_GLYPHS = ("l_orderkey AS doc_id", "0 AS page_index", "l_linenumber AS seq", "substr('abé', cast(l_partkey % 3 AS int) + 1, 1) AS text", "CASE WHEN l_linenumber % 2 = 0 THEN 'stroke' ELSE 'fill' END AS mode", "array(cast(l_suppkey % 2 AS double)) AS transform",
           "cast(l_linenumber * 9 + l_suppkey % 2 * 40 AS double) AS x", "cast(l_suppkey % 3 * 5 AS double) AS y", "cast(l_partkey % 4 AS double) AS w", "10.0D AS h")
#: One line of each number; some orders have lines with one number twice.
_ONE_LINE = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2"
_SQL_GLYPHS = f"g AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, substr('abé', CAST(l_partkey % 3 AS int) + 1, 1) AS text, CASE WHEN l_linenumber % 2 = 0 THEN 'stroke' ELSE 'fill' END AS mode, l_suppkey % 2 AS t, l_linenumber * 9 + l_suppkey % 2 * 40 AS x, l_suppkey % 3 * 5 AS y, l_partkey % 4 AS w, 10 AS h FROM ({_ONE_LINE}))"
_SQL_KEPT = f"""{_SQL_GLYPHS}, r AS (SELECT *, CASE WHEN lag(text) OVER p = text AND lag(t) OVER p = t THEN 0 ELSE 1 END AS new FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM r), k AS (SELECT * FROM s QUALIFY mode = first_value(mode) OVER (PARTITION BY doc_id, run ORDER BY seq))"""


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return lines.selectExpr(*_GLYPHS)


@_query("second_draws", f"WITH {_SQL_KEPT} SELECT doc_id, seq, mode FROM k")
def second_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.without_second_draws(_glyphs(spark, sf_dir)).select("doc_id", "seq", "mode")


_SQL_ADVANCED = f"""{_SQL_KEPT}, a AS (SELECT *, lead(x) OVER p - x AS way, abs(lead(y) OVER p - y) < 6 AS line FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY seq)),
v AS (SELECT doc_id, seq, text, x, y, w AS ink, CASE WHEN line AND way > 0.2 AND way < 30 THEN way ELSE w END AS w FROM a)"""


@_query("glyph_advances", f"WITH {_SQL_ADVANCED} SELECT doc_id, seq, CAST(ink AS int) AS ink, CAST(w AS int) AS w FROM v")
def glyph_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = glyphs.with_advances(glyphs.without_second_draws(_glyphs(spark, sf_dir)))
    return g.select("doc_id", "seq", F.col("ink_w").cast("int").alias("ink"), F.col("w").cast("int").alias("w"))


@_query("collected_text", f"""WITH {_SQL_ADVANCED}
SELECT doc_id, string_agg(text, '' ORDER BY seq) AS text, CAST(count(*) AS int) AS spans, CAST(sum(strlen(text)) AS int) AS bytes, CAST(sum(greatest(w, 0.5) * 2) AS int) AS halves FROM v WHERE w <> 0 GROUP BY 1""")
def collected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = glyphs.collected(_glyphs(spark, sf_dir))
    halves = F.aggregate("spans", F.lit(0.0), lambda a, s: a + 2 * s.rect.w.cast("double")).cast("int")
    return c.select("doc_id", "text", F.size("spans").alias("spans"), F.element_at("spans", -1).end.alias("bytes"), halves.alias("halves"))


# --- pages of glyphs in a line, eight points each ---

_SPANS = "transform(sequence(1, length(text)), i -> named_struct('start', i - 1, 'end', i, 'text', substr(text, i, 1), 'rect', named_struct('x', cast(8 * (i - 1) AS float), 'y', 0.0F, 'w', 8.0F, 'h', 10.0F), 'ink_w', 8.0F))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir, "c_name").selectExpr("c_custkey AS doc_id", "0 AS page_index", "c_name AS text")
    return c.selectExpr("*", f"CAST({_SPANS} AS array<{SPAN}>) AS spans")


@_query("search_regions", """
WITH p AS (SELECT c_custkey AS doc_id, unnest(list_filter(range(1, length(c_name) + 1), lambda i: substr(c_name, i, 2) = '00')) AS i FROM customer)
SELECT doc_id, 0 AS page_index, CAST(8 * (i - 1) AS int) AS x, 16 AS w, '00' AS source_text, 'search' AS source FROM p
UNION ALL SELECT c_custkey, 0, 0, 72, 'Customer#', 'search' FROM customer""")
def search_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review.search_regions(_lines(spark, sf_dir), ("00", "Customer#", "zzz"))
    return r.select("doc_id", "page_index", F.col("rects")[0].x.cast("int").alias("x"), F.col("rects")[0].w.cast("int").alias("w"), "source_text", "source")


@_query("mapped_matches", """
SELECT c_custkey AS doc_id, 'Customer' AS text, false AS unmapped, 0 AS x, 64 AS w FROM customer UNION ALL SELECT c_custkey, 'gone', true, NULL, NULL FROM customer""")
def mapped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda t: f"named_struct('start', 0, 'end', {len(t)}, 'text', '{t}', 'category', 'person', 'confidence', 0.9F, 'detector_id', 'd', 'source', 'regex')"
    m = map_matches(_lines(spark, sf_dir).withColumn("matches", F.expr(f"array({hit('Customer')}, {hit('gone')})")))
    first = F.get("rects", F.lit(0))
    return m.select("doc_id", "text", "unmapped", first.x.cast("int").alias("x"), first.w.cast("int").alias("w"))


@_query("missing_texts", "SELECT c_custkey AS doc_id, 'zzz' AS text FROM customer UNION ALL SELECT c_custkey, '7' FROM customer WHERE NOT contains(c_name, '7')")
def missing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, texts = _lines(spark, sf_dir), ("Customer#", "7", "zzz")
    return review.missing_texts(pages, review.search_regions(pages, texts), texts).select("doc_id", "text")


@_query("search_matches", "SELECT doc_id, CAST(length(text) - length(replace(text, 'q', '')) AS int) AS n, CAST(CASE WHEN contains(text, 'q') THEN octet_length(encode(split_part(text, 'q', 1))) END AS int) AS first FROM documents")
def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _read(spark, sf_dir, "documents").select("doc_id", review.search_matches(F.col("text"), ("q",)).alias("m"))
    return m.select("doc_id", F.size("m").alias("n"), F.get("m", F.lit(0)).start.alias("first"))


@_query("findings_regions", """
SELECT c_custkey AS doc_id, 0 AS page_index, 'x' AS source_text, CASE WHEN c_custkey % 3 = 0 THEN 'ssn' ELSE 'person' END AS category, true AS included, 'regex' AS source, 3 AS w
FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 <> 1 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""")
def findings_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review.regions_of(_customers(spark, sf_dir, f"{_ITEM} AS findings").withColumnRenamed("c_custkey", "doc_id"))
    return r.select("doc_id", "page_index", "source_text", "category", "included", "source", F.col("rects")[0].w.cast("int").alias("w"))


_NESTED = """concat('{"version":1,"source":{"sha256":"ab"', CASE WHEN c_custkey % 2 = 0 THEN ',"bogus":1' ELSE '' END, '},"items":[{"id":"', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ' ' END, '","page":0,"text":"x","category":"ssn","confidence":0.5,"source":"regex","rects":[{"x":1,"y":2,"w":3,"h":4', CASE WHEN c_custkey % 3 = 0 THEN ',"z":5' ELSE '' END, '}],"included":true', CASE WHEN c_custkey % 5 = 0 THEN ',"why":""' ELSE '' END, '}]}')"""


@_query("findings_strict", "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'unknown-field' END, CASE WHEN c_custkey % 7 = 0 THEN 'id' END) AS errors FROM customer")
def findings_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown fields are refused at every level."""
    return _customers(spark, sf_dir, f"{_NESTED} AS j").select("c_custkey", F.array_join(findings.errors(F.col("j")), ",").alias("errors"))


@_query("stale_findings", "SELECT c_custkey, c_custkey % 2 = 0 AS stale FROM customer")
def stale_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.concat(F.lit('{"source":{"sha256":"'), F.when(F.col("c_custkey") % 3 == 0, F.upper(F.sha2("made_for", 256))).otherwise(F.sha2("made_for", 256)), F.lit('"}}'))
    c = _customers(spark, sf_dir, "c_name", "concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END) AS made_for")
    return c.select("c_custkey", findings.is_stale(j, F.col("c_name")).alias("stale"))


@_query("zero_region_guard", "SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 3 <> 1")
def zero_region_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without regions, or with excluded ones only."""
    d = _customers(spark, sf_dir).withColumnRenamed("c_custkey", "doc_id")
    return review.without_regions(d, d.where("doc_id % 3 > 0").withColumn("included", F.col("doc_id") % 3 == 1))


@_query("reviewed_redaction", """
SELECT c_custkey AS doc_id, 'mail ' || CASE WHEN c_custkey % 2 = 0 THEN repeat('█', length('user' || c_custkey || '@example.com')) ELSE 'user' || c_custkey || '@example.com' END || ' é ' || repeat('█', 12) AS masked, true AS passed FROM customer""")
def reviewed_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found, reviewed (addresses of odd keys are let through), and masked by the findings."""
    d = _customers(spark, sf_dir).selectExpr("c_custkey AS doc_id", "concat('mail user', CAST(c_custkey AS varchar(9)), '@example.com é 192.168.1.10') AS text")
    f = review.text_findings(d, _of("email", "ipv4"))
    odd = F.regexp_replace("findings", r'("category":"email".*?"included":)true', "$1false")
    f = f.withColumn("findings", F.when(F.col("doc_id") % 2 == 1, odd).otherwise(F.col("findings")))
    return review.redact_reviewed(d, f).select("doc_id", "masked", F.forall("checks", lambda c: c.passed).alias("passed"))


@_query("manual_regions", "SELECT * FROM (VALUES (1, 0, 10, 'a'), (2, 3, 20, 'b')) v(doc_id, page_index, x, source_text)")
def manual_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review.manual_regions(spark, [(1, 0, (10.0, 1.0, 2.0, 3.0), "a"), (2, 3, (20.0, 1.0, 2.0, 3.0), "b")], "doc_id int")
    return r.select("doc_id", "page_index", F.col("rects")[0].x.cast("int").alias("x"), "source_text")


@_query("united_layers", """
WITH o AS (SELECT c_custkey, c_custkey % 3 AS k FROM customer)
SELECT c_custkey AS doc_id, n, CAST(CASE WHEN k = 0 THEN 40 WHEN k = 1 THEN 100 ELSE 40 END AS int) AS w FROM o, (VALUES (1), (2)) v(n) WHERE n = 1 OR k = 2""")
def united_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region inside the other layer's goes, one around it takes its place, one elsewhere stays."""
    o = _customers(spark, sf_dir).selectExpr("c_custkey AS doc_id", "c_custkey % 3 AS k")

    def side(x: str, w: str, confidence: float) -> DataFrame:
        rect = F.expr(f"array(named_struct('x', cast({x} AS float), 'y', 10.0F, 'w', cast({w} AS float), 'h', 12.0F))")
        return o.select("doc_id", F.lit(0).alias("page_index"), rect.alias("rects"), F.lit("same text").alias("source_text"), F.lit("person").alias("category"), F.lit(confidence).cast("float").alias("confidence"), F.lit(True).alias("included"), F.lit("regex").alias("source"))

    from pyspark.sql import Window

    u = union_regions(side("10", "40", 0.9), side("CASE WHEN k = 0 THEN 12 WHEN k = 1 THEN 0 ELSE 300 END", "CASE WHEN k = 0 THEN 20 WHEN k = 1 THEN 100 ELSE 40 END", 0.8))
    return u.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("rects")[0].x)).alias("n"), F.col("rects")[0].w.cast("int").alias("w"))


# --- rasters: a page of 60 by 30 pixels for each supplier ---


def _rasters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS doc_id")
    rasters = s.selectExpr("doc_id", "0 AS page_index", "60 AS width", "30 AS height", "1.0D AS scale", f"unhex(repeat('FFFFFFFF', {60 * 30})) AS pixels")
    rect = F.expr("array(named_struct('x', cast(10 + doc_id % 60 AS float), 'y', 10.0F, 'w', 20.0F, 'h', 8.0F))")
    regions = s.select("doc_id", F.lit(0).alias("page_index"), rect.alias("rects"), (F.col("doc_id") % 4 != 0).alias("included")).where("doc_id % 60 < 45")
    return rasters, regions


_BLACK = """
WITH r AS (SELECT s_suppkey AS doc_id, s_suppkey % 60 < 45 AND s_suppkey % 4 <> 0 AS marked, 10 + s_suppkey % 60 - 1.5 - 3.0 AS x, 20 + 3 + 9.0 AS w, 10 - 1.5 - 2.0 AS y, 8 + 3 + 2.0 AS h FROM supplier)
SELECT doc_id, CAST(CASE WHEN marked THEN (least(ceil(x + w), 60) - greatest(floor(x), 0)) * (least(ceil(y + h), 30) - greatest(floor(y), 0)) ELSE 0 END AS int) AS black FROM r"""


@_query("painted_regions", _BLACK)
def painted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that are black after painting."""
    done = raster.painted(*_rasters(spark, sf_dir))
    return done.select("doc_id", ((F.lit(60 * 30 * 8) - F.length(F.regexp_replace(F.hex("pixels"), "000000FF", ""))) / 8).cast("int").alias("black"))


@_query("pixel_removal", "SELECT s_suppkey AS doc_id, s_suppkey % 60 >= 45 OR s_suppkey % 4 = 0 OR s_suppkey % 2 = 1 AS passed FROM supplier")
def pixel_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of odd keys are painted, the others aren't."""
    rasters, regions = _rasters(spark, sf_dir)
    done = raster.painted(rasters.where("doc_id % 2 = 1"), regions).unionByName(rasters.where("doc_id % 2 = 0"))
    return raster.pixel_removal(done, regions).select("doc_id", "check.passed")


@_query("render_guards", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'scale' WHEN c_custkey % 7 = 0 THEN 'page' WHEN c_custkey % 100 > 65535 / 792.0 THEN 'side' WHEN 612.0 * 792 * (c_custkey % 100) * (c_custkey % 100) > 100000000 THEN 'pixels' END AS error FROM customer""")
def render_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir, "CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN double('nan') ELSE 0.0D END ELSE cast(c_custkey % 100 AS double) END AS s", "CASE WHEN c_custkey % 7 = 0 THEN 0.0D ELSE 612.0D END AS w")
    return c.select("c_custkey", raster.size_error(F.col("w"), F.lit(792.0), F.col("s")).alias("error"))


@_query("pixels_to_points", "SELECT c_custkey, CAST((c_custkey % 50) * 100 / 2.5 AS int) AS x, 4 AS w FROM customer")
def pixels_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir, "named_struct('x', cast(c_custkey % 50 * 100 AS float), 'y', 0.0F, 'w', 10.0F, 'h', 1.0F) AS r")
    p = raster.to_points(F.col("r"), F.lit(2.5))
    return c.select("c_custkey", p.x.cast("int").alias("x"), p.w.cast("int").alias("w"))


# --- recognised lines: the words of each order's priority and customer ---


@_query("recognised_text", """
SELECT o_orderkey AS doc_id, o_orderpriority || ' ' || o_custkey || ' é ' || o_orderstatus AS text, CAST(length(o_orderpriority) + 1 AS int) AS second, CAST(length(o_orderpriority) + length(o_custkey::varchar) + 6 AS int) AS bytes FROM orders""")
def recognised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines joined with their offsets; lines of a character are noise."""
    word = lambda c: f"named_struct('text', {c}, 'rect', cast(null AS {RECT}))"
    o = _read(spark, sf_dir, "orders")
    lines = None
    for i, words in enumerate((["o_orderpriority", "cast(o_custkey AS string)"], ["'x'"], ["'é'", "o_orderstatus"])):
        part = o.selectExpr("o_orderkey AS doc_id", "0 AS page_index", f"{i} AS line", f"array({', '.join(map(word, words))}) AS words")
        lines = part if lines is None else lines.unionByName(part)
    t = pages_.recognised_text(lines)
    return t.select("doc_id", "text", F.col("spans")[1].start.alias("second"), F.element_at("spans", -1).end.alias("bytes"))


# --- files ---

_FILE = "concat('%PDF-1.7\n', CASE WHEN c_custkey % 5 = 0 THEN '/Encrypt 3 0 R ' ELSE '' END, '<</Title (', CASE WHEN c_custkey % 2 = 0 THEN concat('Patient ', c_name) ELSE '  ' END, ') /Producer (tool)>> ', CASE WHEN c_custkey % 3 = 0 THEN '/Annots [] ' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN '/Prev 1 ' ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE concat('<<>> stream\n', c_name, 'endstream') END)"


@_query("file_checks", """
SELECT c_custkey, c_custkey % 2 = 1 AS clean, c_custkey % 3 <> 0 AS annotations, c_custkey % 2 = 1 AND c_custkey % 4 <> 0 AS bytes_, c_custkey % 7 <> 0 AS saved FROM customer""")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on bytes: information strings, annotations, secrets outside streams, full saves."""
    c = _customers(spark, sf_dir, "c_name", f"cast({_FILE} AS binary) AS content", "cast(c_custkey AS string) AS path")
    done = pages_.check_files(c, c.select("path", F.col("c_name").alias("secret")))
    passed = F.map_from_entries(F.transform("checks", lambda k: F.struct(k.id, k.passed)))
    return done.select(F.col("path").cast("bigint").alias("c_custkey"), *(passed[k].alias(n) for k, n in (("metadata-clean", "clean"), ("annotations-removed", "annotations"), ("raw-byte-scan", "bytes_"), ("full-save", "saved"))))


@_query("opened_files", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'not-pdf' WHEN c_custkey % 5 = 0 THEN 'encrypted' END AS error, CASE WHEN c_custkey % 2 = 0 THEN 'Patient ' || c_name ELSE '  ' END AS title FROM customer")
def opened_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir, f"cast(CASE WHEN c_custkey % 9 = 0 THEN substr({_FILE}, 2) ELSE {_FILE} END AS binary) AS content")
    return pages_.opened(c).select("c_custkey", "error", F.col("info")["title"].alias("title"))


@_query("secret_sets", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n, c_custkey % 3 <> 0 AS passed FROM customer")
def secret_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of the included regions, and whether they are gone from the outputs."""
    c = _customers(spark, sf_dir, "c_name")
    region = lambda cond, text: c.where(cond).select("c_custkey", text.alias("source_text"), F.lit(True).alias("included"))
    regions = region("true", F.col("c_name")).unionByName(region("true", F.col("c_name"))).unionByName(region("c_custkey % 2 = 0", F.lit("other secret")))
    regions = regions.unionByName(c.select("c_custkey", F.lit("excluded").alias("source_text"), F.lit(False).alias("included")))
    secrets = verify.secrets_of(regions, ("c_custkey",))
    outputs = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("excluded, "), F.upper("c_name"))).otherwise(F.lit("excluded")).alias("masked"))
    done = verify.verify_text(outputs, secrets, "c_custkey")
    return done.join(secrets.groupBy("c_custkey").agg(F.count("*").cast("int").alias("n")), "c_custkey").select("c_custkey", "n", "passed")
