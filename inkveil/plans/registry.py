"""Queries of the engine, by name, and their SQL.

Queries named valid_* and others build their strings from key columns, for the text tables hold few of them; the
same expressions are written in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validators as V
from ..functions.catalog import BY_ID
from ..operators import evaluate, findings, geometry, mask, verify
from ..operators.detect import DetectOptions, detect, with_matches
from .pipeline import certificates, redact

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Date horizons of queries are those of this year.
YEAR = 2026


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by category and detector over whole documents."""
    found = detect(_read(spark, sf_dir, "documents"), DetectOptions(as_of_year=YEAR))
    return found.groupBy("category", "detector_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


# The patterns that occur in the documents up to sf0.1, written out; the others have queries on planted strings. In larger
# tables others occur too (README), and the query has rows that this SQL hasn't.
_FLAGSHIP = r"""
WITH e AS (SELECT doc_id, 'email' AS category, 'regex:email' AS detector_id, s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}')) AS s FROM documents)),
i AS (SELECT doc_id, 'ip-address', 'regex:ipv4', s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS s FROM documents)
  WHERE len(list_filter(string_split(s, '.'), lambda p: CAST(p AS int) > 255 OR (length(p) > 1 AND starts_with(p, '0')))) = 0),
c AS (SELECT doc_id, s, list_reverse(list_transform(regexp_extract_all(s, '\d'), lambda x: CAST(x AS int))) AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d[ \-]?){12,18}\d\b')) AS s FROM documents)),
d AS (SELECT doc_id, 'credit-card', 'regex:credit-card', s FROM c WHERE len(list_distinct(r)) > 1 AND list_sum(list_transform(r, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0)
SELECT category, detector_id, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (FROM e UNION ALL FROM i UNION ALL FROM d) GROUP BY ALL"""
QUERIES["detect_by_category"] = flagship
ORACLES["detect_by_category"] = _FLAGSHIP


# --- validators ---


def _valid(name: str, table: str, key: str, build: str, check: Callable[[Column], Column], oracle: str) -> None:
    """A query of key, s, ok: a string that build makes, and whether it is valid. oracle is a condition on s."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, table).selectExpr(key, f"{build} AS s").select(key, "s", check(F.col("s")).alias("ok"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH t AS (SELECT {key}, {build} AS s FROM {table}) SELECT {key}, s, COALESCE({oracle}, false) AS ok FROM t"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS varchar({n})), {n}, '0')"


_valid(
    "valid_ssn", "orders", "o_orderkey", f"concat({_pad('o_orderkey % 1000', 3)}, '-', {_pad('o_custkey % 100', 2)}, '-', {_pad('(o_orderkey * 7) % 10000', 4)})", V.ssn,
    "substr(s, 1, 3) NOT IN ('000', '666') AND substr(s, 1, 1) <> '9' AND substr(s, 5, 2) <> '00' AND substr(s, 8, 4) <> '0000'",
)
_D = lambda i: f"CAST(substr(s, {i}, 1) AS int)"
_valid(
    "valid_routing", "orders", "o_orderkey", f"concat({_pad('o_orderkey % 100000', 5)}, {_pad('o_custkey % 10000', 4)})", V.aba,
    f"s <> '000000000' AND (3 * ({_D(1)} + {_D(4)} + {_D(7)}) + 7 * ({_D(2)} + {_D(5)} + {_D(8)}) + {_D(3)} + {_D(6)} + {_D(9)}) % 10 = 0",
)
_LUHN = " + ".join(f"CASE WHEN {_D(i)} * 2 > 9 THEN {_D(i)} * 2 - 9 ELSE {_D(i)} * 2 END" if i % 2 else _D(i) for i in range(1, 17))
_valid("valid_card", "orders", "o_orderkey", f"concat('4111', {_pad('o_orderkey % 1000000', 6)}, {_pad('(o_custkey * 31) % 1000000', 6)})", V.luhn, f"({_LUHN}) % 10 = 0")
_valid(
    "valid_iban", "orders", "o_orderkey", f"concat('GB', {_pad('o_orderkey % 100', 2)}, 'WEST', {_pad('o_custkey % 1000000', 14)})", V.iban,
    "CAST(concat('32142829', substr(s, 9, 14), '1611', substr(s, 3, 2)) AS decimal(38, 0)) % 97 = 1",
)
_valid(
    "valid_ipv4", "orders", "o_orderkey", "concat(CAST(o_orderkey % 300 AS varchar(5)), '.', CAST(o_custkey % 270 AS varchar(5)), '.', substr('00107', CAST(o_orderkey % 4 AS int) + 1, 2), '.9')", V.ipv4,
    "o_orderkey % 300 <= 255 AND split_part(s, '.', 2) IN (SELECT CAST(i AS varchar) FROM range(256) r(i)) AND split_part(s, '.', 3) = '10'",
)
_valid("valid_zip", "customer", "c_custkey", f"{_pad('c_custkey % 3 * c_custkey', 5)}", V.zip_code, "s <> '00000'")
_valid("valid_hospital", "customer", "c_custkey", "concat(CASE WHEN c_custkey % 5 = 0 THEN 'HOS' ELSE 'hosp' END, substr('1234567890123456', 1, CAST(c_custkey % 16 AS int)))", V.hospital, "c_custkey % 5 <> 0 AND length(s) BETWEEN 10 AND 16")
_valid("valid_provider", "customer", "c_custkey", "concat('DR', substr('123456789012', 1, CAST(c_custkey % 12 AS int)), CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE '' END)", V.provider, "c_custkey % 12 BETWEEN 3 AND 8")
_valid("valid_age", "customer", "c_custkey", "concat(CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE '' END, CAST(c_custkey % 150 AS varchar(5)), '-YEAR-old')", V.age_years_old, "c_custkey % 7 <> 0 AND c_custkey % 150 BETWEEN 1 AND 120")
_valid(
    "valid_date", "orders", "o_orderkey", f"concat({_pad('o_orderkey % 34', 2)}, '/', {_pad('o_custkey % 14', 2)}, '/', CAST(1890 + o_orderkey % 170 AS varchar(5)))", V.date(YEAR),
    f"CAST(substr(s, 7, 4) AS int) BETWEEN 1900 AND {YEAR + V.YEARS_AHEAD} AND (try_strptime(s, '%d/%m/%Y') IS NOT NULL OR try_strptime(s, '%m/%d/%Y') IS NOT NULL)",
)
_valid(
    "valid_phone", "orders", "o_orderkey", f"concat(CASE CAST(o_orderkey % 4 AS int) WHEN 0 THEN '+1 ' WHEN 1 THEN '(' ELSE '' END, {_pad('o_custkey % 1000', 3)}, CASE WHEN o_orderkey % 4 = 1 THEN ') ' WHEN o_orderkey % 4 = 2 THEN '.' ELSE '' END, {_pad('o_orderkey % 10000', 7)})", V.phone,
    "CASE CAST(o_orderkey % 4 AS int) WHEN 0 THEN true WHEN 1 THEN NOT regexp_matches(regexp_replace(s, '[^0-9]', '', 'g'), '^0+$') WHEN 2 THEN false ELSE substr(s, 1, 1) >= '2' END",
)
_valid(
    "valid_email", "customer", "c_custkey", "concat(CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lower(substr(c_name, 1, 4)) END, '@example', CASE CAST(c_custkey % 4 AS int) WHEN 0 THEN '.com' WHEN 1 THEN '.IO' WHEN 2 THEN '.cOm' ELSE '' END)", V.email,
    "c_custkey % 9 <> 0 AND c_custkey % 4 IN (0, 1)",
)


# --- normal forms ---


def _form(name: str, f: Callable[[Column], Column], oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        form = f(F.col("text"))
        return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(form, 256).alias("form_sha256"), F.length(form).cast("bigint").alias("chars"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH t AS (SELECT doc_id, {oracle} AS f FROM documents) SELECT doc_id, sha256(f) AS form_sha256, CAST(length(f) AS bigint) AS chars FROM t"


_SPACE = r"[\s\x0b\x{85}\p{Z}]+"
_LOW = f"'{T.UPPER}', '{T.LOWER}'"
_form("normalize_text", T.normalize_text, f"translate(trim(regexp_replace(text, '{_SPACE}', ' ', 'g')), {_LOW})")
_form("compact_text", T.compact_text, f"translate(regexp_replace(text, '{_SPACE}', '', 'g'), {_LOW})")
_form("loose_text", T.loose_text, r"lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))")
_form("loose_ascii", T.loose_ascii, "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')")

_QUALITY = rf"""
WITH d AS (SELECT doc_id, text, CAST(length(text) AS double) AS n FROM documents),
c AS (SELECT doc_id, text, n, greatest(n, 1) AS m,
  length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
  length(regexp_replace(text, '[^\s\x0b\x{{85}}\p{{Z}}]', '', 'g')) AS spaces,
  length(regexp_replace(text, '[^\x{{80}}-\x{{24F}}\x{{300}}-\x{{36F}}]', '', 'g')) AS broken,
  length(regexp_replace(text, '[^\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{FFFD}}]', '', 'g')) AS bad,
  regexp_split_to_array(text, '{_SPACE}') AS words FROM d),
e AS (SELECT *, letters / m AS lr, (letters + digits) / m AS ar, spaces / m AS sr, broken / m AS br, list_max(list_transform(words, lambda w: length(w))) AS run,
  len(list_filter(words, lambda w: length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 2 AND 2 * length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) > length(w))) AS wl FROM c),
f AS (SELECT *, CASE WHEN sr < 0.02 AND n > 40 THEN 0.25 * least((n - 40) / 40, 1) * (1 - sr / 0.02) ELSE 0 END AS unbroken FROM e),
g AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE greatest(0, 1
  - CASE WHEN n < 12 THEN 0.65 - 0.2 * n / 12 WHEN n < 24 THEN 0.45 - 0.25 * (n - 12) / 12 WHEN n < 80 THEN 0.2 * (1 - (n - 24) / 56) ELSE 0 END
  - CASE WHEN lr < 0.15 THEN 0.4 - 0.25 * lr / 0.15 WHEN lr < 0.35 THEN 0.15 * (1 - (lr - 0.15) / 0.2) WHEN ar < 0.4 THEN 0.2 * (1 - ar / 0.4) ELSE 0 END
  - CASE WHEN br > 0.2 THEN 0.35 * least((br - 0.2) / 0.3, 1) ELSE 0 END - 0.3 * bad / m - unbroken
  - CASE WHEN unbroken = 0 AND wl < 3 AND n > 60 THEN 0.25 * least((n - 60) / 60, 1) * (1 - wl / 3.0) ELSE 0 END
  - CASE WHEN run > 80 THEN 0.2 * least((run - 80) / 80.0, 1) ELSE 0 END) END AS score FROM f)
"""


@_query("text_quality", _QUALITY + "SELECT doc_id, CAST(round(score * 1000) AS bigint) AS score_thousandths FROM g")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.layer_quality(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", q.alias("q")).select("doc_id", F.round(F.col("q.score") * 1000).cast("bigint").alias("score_thousandths"))


@_query("ocr_decision", _QUALITY + "SELECT doc_id, n < 32 OR score <= 0.45 AS auto, false AS off, true AS force FROM g")
def ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", T.needs_ocr("auto", t).alias("auto"), T.needs_ocr("off", t).alias("off"), T.needs_ocr("force", t).alias("force"))


# --- detection ---


def _of(*ids: str, **options) -> DetectOptions:
    return DetectOptions(as_of_year=YEAR, patterns=tuple(BY_ID[i] for i in ids), **options)


@_query("detect_email", rf"""
WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{BY_ID['email'].regex}')) AS s FROM documents),
c AS (SELECT doc_id, regexp_extract(s, '^(.*\.)[A-Za-z]+$', 1) AS head, regexp_extract(s, '\.([A-Za-z]+)$', 1) AS tail FROM f)
SELECT doc_id, head || CASE WHEN regexp_matches(tail, '^[a-z][a-z]') THEN regexp_extract(tail, '^[a-z]+') ELSE substr(tail, 1, 6) END AS text, count(*) AS n FROM c GROUP BY ALL""")
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_read(spark, sf_dir, "documents"), _of("email")).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@_query("detect_ipv4", r"""
WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS s FROM documents)
SELECT doc_id, s AS text, count(*) AS n FROM f WHERE len(list_filter(string_split(s, '.'), lambda p: CAST(p AS int) > 255 OR (length(p) > 1 AND starts_with(p, '0')))) = 0 GROUP BY ALL""")
def detect_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_read(spark, sf_dir, "documents"), _of("ipv4")).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@_query("detect_card", r"""
WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d[ \-]?){12,18}\d\b')) AS s FROM documents),
d AS (SELECT doc_id, s, list_reverse(list_transform(regexp_extract_all(s, '\d'), lambda x: CAST(x AS int))) AS r FROM f)
SELECT doc_id, s AS text, count(*) AS n FROM d
WHERE len(list_distinct(r)) > 1 AND list_sum(list_transform(r, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0 GROUP BY ALL""")
def detect_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_read(spark, sf_dir, "documents"), _of("credit-card")).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


_NINE = f"concat(CASE CAST(o_custkey % 3 AS int) WHEN 0 THEN 'routing ' WHEN 1 THEN 'ssn: ' ELSE 'number ' END, {_pad('o_orderkey % 100000', 5)}, {_pad('o_custkey % 10000', 4)})"
_NINE_OK = (
    "substr(s, 1, 3) NOT IN ('000', '666') AND substr(s, 1, 1) <> '9' AND substr(s, 4, 2) <> '00' AND substr(s, 6, 4) <> '0000' AS ssn_ok, "
    + ORACLES["valid_routing"].split("COALESCE(")[1].split(", false)")[0] + " AS aba_ok"
)


def _nine(spark: SparkSession, sf_dir: str, opts: DetectOptions) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_NINE} AS text")
    return detect(rows, opts, keys=("o_orderkey",)).select("o_orderkey", "start", "text", "category", F.round(F.col("confidence") * 1000).cast("int").alias("confidence"))


@_query("context_boost", f"""
WITH t AS (SELECT o_orderkey, o_custkey % 3 AS k, right({_NINE}, 9) AS s FROM orders), c AS (SELECT o_orderkey, k, s, {_NINE_OK} FROM t)
SELECT o_orderkey, CASE k WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 7 END AS start, s AS text, CASE k WHEN 0 THEN 'routing-number' ELSE 'ssn' END AS category, 500 AS confidence
FROM c WHERE (k = 0 AND aba_ok) OR (k = 1 AND ssn_ok)""")
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak patterns are kept only near a keyword."""
    return _nine(spark, sf_dir, _of("ssn-contiguous", "us-aba-routing"))


@_query("aggressive", f"""
WITH t AS (SELECT o_orderkey, o_custkey % 3 AS k, right({_NINE}, 9) AS s FROM orders), c AS (SELECT o_orderkey, k, s, {_NINE_OK} FROM t),
r AS (SELECT o_orderkey, CASE k WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 7 END AS start, s AS text, ssn_ok, aba_ok, CASE WHEN k = 1 THEN 500 ELSE 380 END AS sc, CASE WHEN k = 0 THEN 500 ELSE 380 END AS ac FROM c WHERE ssn_ok OR aba_ok)
SELECT o_orderkey, start, text, CASE WHEN ssn_ok AND (NOT aba_ok OR sc >= ac) THEN 'ssn' ELSE 'routing-number' END AS category, CASE WHEN ssn_ok AND (NOT aba_ok OR sc >= ac) THEN sc ELSE ac END AS confidence FROM r""")
def aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak patterns are kept without a keyword; of a social security and a routing number on one span one stays."""
    return _nine(spark, sf_dir, _of("ssn-contiguous", "us-aba-routing", aggressive=True))


@_query("category_filter", f"""
WITH t AS (SELECT o_orderkey, o_custkey % 3 AS k, right({_NINE}, 9) AS s FROM orders), c AS (SELECT o_orderkey, k, s, {_NINE_OK} FROM t)
SELECT o_orderkey, 8 AS start, s AS text, 'routing-number' AS category, 500 AS confidence FROM c WHERE k = 0 AND aba_ok""")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(spark, sf_dir, _of("ssn-contiguous", "us-aba-routing", categories=("financial",)))


_BORN = "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'dob ' ELSE 'date ' END, CAST(1900 + o_orderkey % 100 AS varchar(5)), '-', lpad(CAST(1 + o_custkey % 12 AS varchar(2)), 2, '0'), '-15')"


@_query("birth_over_date", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'date-of-birth' ELSE 'date' END AS category, right({_BORN}, 10) AS text,
  CASE WHEN o_orderkey % 2 = 0 THEN 350 ELSE 500 END AS confidence FROM orders""")
def birth_over_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_BORN} AS text")
    return detect(rows, _of("date", "date-of-birth"), keys=("o_orderkey",)).select("o_orderkey", "category", "text", F.round(F.col("confidence") * 1000).cast("int").alias("confidence"))


_PERSON = "concat(CASE CAST(c_custkey % 4 AS int) WHEN 0 THEN 'Name: Lisa Chung Date' WHEN 1 THEN 'Name: LisaChungDoctor' WHEN 2 THEN 'Dr. Lisa Chung' ELSE 'Dr. Lisa' END, '; age ', CAST(c_custkey % 200 AS varchar(4)), '-year-old')"


@_query("detect_person", """
SELECT c_custkey, 'person' AS category, CASE c_custkey % 4 WHEN 1 THEN 'LisaChung' ELSE 'Lisa Chung' END AS text FROM customer WHERE c_custkey % 4 < 3
UNION ALL SELECT c_custkey, 'other', (c_custkey % 200)::varchar || '-year-old' FROM customer WHERE c_custkey % 200 BETWEEN 1 AND 120""")
def detect_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PERSON} AS text")
    return detect(rows, _of("person-labeled-spaced", "person-labeled-glued", "person-dr-title", "age-years-old"), keys=("c_custkey",)).select("c_custkey", "category", "text")


_PLACE = "concat('address ', CAST(c_custkey % 1000 AS varchar(4)), ' Oak Street, Spring', CASE WHEN c_custkey % 2 = 0 THEN 'field' ELSE ' Meeting' END, ', Texas ', lpad(CAST(c_custkey * 7 % 100000 AS varchar(5)), 5, '0'))"


@_query("detect_place", f"""
SELECT c_custkey, (c_custkey % 1000)::varchar || ' Oak Street' AS text FROM customer
UNION ALL SELECT c_custkey, 'Springfield' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'Texas' FROM customer
UNION ALL SELECT c_custkey, right({_PLACE}, 5) FROM customer WHERE c_custkey * 7 % 100000 <> 0""")
def detect_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an address overlap and are all kept."""
    rows = _read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PLACE} AS text")
    return detect(rows, _of("us-street-address", "us-city-before-state", "us-state", "us-zip"), keys=("c_custkey",)).select("c_custkey", "text")


@_query("detect_all_pages")
def detect_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_read(spark, sf_dir, "pages"), DetectOptions(as_of_year=YEAR, aggressive=True), keys=("page_id",), text="html").drop("source")


# --- masking, verification, review ---


@_query("mask_literal", "SELECT doc_id, sha256(replace(text, 'the', '███')) AS masked_sha256, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS int) AS n FROM documents")
def mask_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", mask.occurrences(F.col("text"), F.lit("the")))
    return d.select("doc_id", F.sha2(mask.masked(F.col("text"), F.col("spans")), 256).alias("masked_sha256"), F.size("spans").alias("n"))


@_query("occurrences", "SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS int) AS n FROM documents")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(mask.occurrences(F.col("text"), F.lit("e"))).alias("n"))


@_query("redact_verify")
def redact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents masked by the whole catalog and verified: passed where no found string is left."""
    r = redact(_read(spark, sf_dir, "documents"), DetectOptions(as_of_year=YEAR))
    return r.select("doc_id", F.size("matches").alias("n"), F.sha2("masked", 256).alias("masked_sha256"), F.forall("checks", lambda c: c.passed).alias("passed"))


@_query("text_removal", """
SELECT c_custkey, c_custkey % 3 <> 0 AND (c_custkey % 2 = 0 OR c_custkey % 5 = 0) AS there FROM customer""")
def text_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in other case and spacing are found; other texts and short secrets aren't."""
    c = _read(spark, sf_dir, "customer")
    out = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x  "), F.upper("c_name"), F.lit(" y"))).when(F.col("c_custkey") % 5 == 0, F.concat_ws(" ", F.split("c_name", ""))).otherwise(F.lit("nothing"))
    secret = F.when(F.col("c_custkey") % 3 == 0, F.lit("1 2")).otherwise(F.col("c_name"))
    return c.select("c_custkey", verify.still_there(secret, out).alias("there"))


@_query("certificate_hashes", """
WITH f AS (SELECT DISTINCT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(text, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b'), lambda s: len(list_filter(string_split(s, '.'), lambda p: CAST(p AS int) > 255 OR (length(p) > 1 AND starts_with(p, '0')))) = 0)) > 0)
SELECT doc_id, sha256(text) AS input_sha256, 0 AS errors FROM documents WHERE doc_id IN (SELECT doc_id FROM f)""".replace("\\\\", "\\"))
def certificate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = certificates(redact(_read(spark, sf_dir, "documents"), _of("ipv4")))
    return c.select("doc_id", F.get_json_object("certificate", "$.input.sha256").alias("input_sha256"), F.size(verify.certificate_errors(F.col("certificate"))).alias("errors"))


_ITEM = """concat('{"version":', CASE WHEN c_custkey % 11 = 0 THEN '2' ELSE '1' END, ',"source":{"sha256":"ab"},"items":[{"id":"1","page":0,"text":"x","category":"', CASE WHEN c_custkey % 3 = 0 THEN 'ssn' WHEN c_custkey % 3 = 1 THEN 'nope' ELSE 'person' END, '","confidence":', CASE WHEN c_custkey % 4 = 0 THEN '1.5' ELSE '0.5' END, ',"source":"regex","rects":[', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '{"x":1,"y":2,"w":3,"h":4}' END, '],"included":true}]', CASE WHEN c_custkey % 7 = 0 THEN ',"extra":1' ELSE '' END, '}')"""


@_query("findings_errors", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'unknown-field' END, CASE WHEN c_custkey % 11 = 0 THEN 'version' END, CASE WHEN c_custkey % 4 = 0 THEN 'confidence' END,
  CASE WHEN c_custkey % 3 = 1 THEN 'category' END, CASE WHEN c_custkey % 5 = 0 THEN 'included-without-rects' END) AS errors FROM customer""")
def findings_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ITEM} AS j")
    return c.select("c_custkey", F.array_join(findings.errors(F.col("j")), ",").alias("errors"))


# --- geometry ---

_RECTS = "CAST(l_quantity AS double) AS x1, CAST(l_linenumber AS double) AS y1, CAST(10 + l_quantity AS double) AS w1, CAST(2 + l_partkey % 30 AS double) AS h1, CAST(l_suppkey % 60 AS double) AS x2, CAST(l_linenumber + l_partkey % 5 AS double) AS y2, 25.0D AS w2, 12.0D AS h2"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_RECTS.split(", "))


_SQL_RECTS = _RECTS.replace("25.0D", "25.0::double").replace("12.0D", "12.0::double")


@_query("rect_iou", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_SQL_RECTS} FROM lineitem),
i AS (SELECT *, greatest(least(x1 + w1, x2 + w2) - greatest(x1, x2), 0) * greatest(least(y1 + h1, y2 + h2) - greatest(y1, y2), 0) AS both_ FROM r)
SELECT l_orderkey, l_linenumber, CAST(round(both_ / (w1 * h1 + w2 * h2 - both_) * 10000) AS bigint) AS iou, count(*) AS n FROM i GROUP BY ALL""")
def rect_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("x1", "y1", "w1", "h1", "x2", "y2", "w2", "h2")]
    r = _rects(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(mask.iou(tuple(c[:4]), tuple(c[4:])) * 10000).cast("bigint").alias("iou"))
    return r.groupBy("l_orderkey", "l_linenumber", "iou").agg(F.count("*").alias("n"))


@_query("padded_pixels", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_SQL_RECTS} FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, x1 - 1.5 - least(greatest(0.75 * h1, 4), 12) / 2 AS x, w1 + 3 + 1.5 * least(greatest(0.75 * h1, 4), 12) AS w,
  y1 - 1.5 - least(greatest(0.25 * h1, 1), 4) AS y, h1 + 3 + least(greatest(0.25 * h1, 1), 4) AS h FROM r)
SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor(x * 2), 0), 100) AS bigint) AS x0, CAST(least(greatest(ceil((x + w) * 2), 0), 100) AS bigint) AS x_end,
  CAST(least(greatest(floor(y * 2), 0), 60) AS bigint) AS y0, CAST(least(greatest(ceil((y + h) * 2), 0), 60) AS bigint) AS y_end, count(*) AS n FROM p GROUP BY ALL""")
def padded_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = mask.padded_rect(*(F.col(c) for c in ("x1", "y1", "w1", "h1")))
    (x0, x1), (y0, y1) = mask.pixel_range(x, w, 2.0, F.lit(100)), mask.pixel_range(y, h, 2.0, F.lit(60))
    r = _rects(spark, sf_dir).select("l_orderkey", "l_linenumber", *(c.cast("bigint").alias(n) for c, n in ((x0, "x0"), (x1, "x_end"), (y0, "y0"), (y1, "y_end"))))
    return r.groupBy(*r.columns).agg(F.count("*").alias("n"))


@_query("same_line", f"""
WITH r AS (SELECT l_orderkey, {_SQL_RECTS} FROM lineitem)
SELECT l_orderkey, count(*) AS n, CAST(sum(CASE WHEN abs(y1 - y2) < 0.6 * greatest(least(h1, h2), 4) THEN 1 ELSE 0 END) AS bigint) AS on_line FROM r GROUP BY 1""")
def same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = mask.same_line(*(F.col(c) for c in ("y1", "h1", "y2", "h2")))
    return _rects(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(on.cast("int")).alias("on_line"))


@_query("union_regions")
def union_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of two layers by order, united page by page."""
    r = _rects(spark, sf_dir)
    side = lambda k, conf: r.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.array(F.struct(*(F.col(f"{c}{k}").cast("float").alias(c) for c in "xywh"))).alias("rects"), F.lit("same text").alias("source_text"), F.lit("person").alias("category"), F.lit(conf).cast("float").alias("confidence"), F.lit(True).alias("included"), F.lit("regex").alias("source"))
    return geometry.union_regions(side(1, 0.8), side(2, 0.9)).select("doc_id", F.size("rects").alias("n"))


# --- evaluation ---

_TRUTH = "SELECT c_custkey AS doc_id, 'Jane Doe ' || c_custkey AS text FROM customer UNION ALL SELECT c_custkey, (c_custkey % 90 + 10)::varchar FROM customer"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id")
    truth = c.selectExpr("doc_id", "concat('Jane Doe ', doc_id) AS text").unionByName(c.selectExpr("doc_id", "CAST(doc_id % 90 + 10 AS string) AS text"))
    found = c.where("doc_id % 3 <> 0").selectExpr("doc_id", "concat('JANEDOE', doc_id) AS text").unionByName(c.where("doc_id % 4 = 0").selectExpr("doc_id", "concat('Age: ', doc_id % 90 + 10) AS text"))
    found = found.unionByName(c.where("doc_id % 5 = 0").selectExpr("doc_id", "'zzz' AS text"))
    return evaluate.per_document(found, truth)


_PER_DOC = """
WITH d AS (SELECT c_custkey AS doc_id, c_custkey % 3 <> 0 AS a, c_custkey % 4 = 0 AS b, c_custkey % 5 = 0 AS z, contains(c_custkey::varchar, (c_custkey % 90 + 10)::varchar) AS inside FROM customer),
e AS (SELECT doc_id, 2 AS truths, a::int + (b OR (a AND inside))::int AS hits, a::int + b::int + z::int AS found, z::int AS false_hits FROM d)
"""


@_query("evaluate_documents", _PER_DOC + "SELECT doc_id, truths, hits, found, false_hits FROM e")
def evaluate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("doc_id", "truths", "hits", "found", "false_hits")


@_query("evaluate_micro", _PER_DOC + "SELECT CAST(round(sum(hits) / sum(truths) * 10000) AS bigint) AS recall, CAST(round((sum(found) - sum(false_hits)) / sum(found) * 10000) AS bigint) AS \"precision\" FROM e")
def evaluate_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.micro(_evaluated(spark, sf_dir))
    return m.select(*(F.round(F.col(c) * 10000).cast("bigint").alias(c) for c in ("recall", "precision")))


@_query("rough_type", """
SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'ssn' WHEN 1 THEN 'date' WHEN 2 THEN 'hosp_id' WHEN 3 THEN 'dr_id' WHEN 4 THEN 'age_phrase' WHEN 5 THEN CASE WHEN c_custkey % 200 BETWEEN 1 AND 120 THEN 'age_num' ELSE 'other' END
  WHEN 6 THEN 'phone_or_id' WHEN 7 THEN 'name_or_org_text' ELSE 'other' END AS kind FROM customer""")
def rough_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("""CASE c_custkey % 9 WHEN 0 THEN '123-45-6789' WHEN 1 THEN '1/2/2020' WHEN 2 THEN 'hosp1' WHEN 3 THEN 'DR12b' WHEN 4 THEN '46-Year-old' WHEN 5 THEN cast(c_custkey % 200 AS string)
      WHEN 6 THEN '(415) 555-0132' WHEN 7 THEN c_name ELSE '--' END""")
    return _read(spark, sf_dir, "customer").select("c_custkey", evaluate.rough_type(s).alias("kind"))


@_query("matches_per_page")
def matches_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with the number of matches, those without too."""
    c = _read(spark, sf_dir, "conversations")
    return with_matches(c, DetectOptions(as_of_year=YEAR)).select("conv_id", "turn", F.size("matches").alias("n"))
