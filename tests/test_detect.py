"""Detection on strings whose matches are known."""

import pytest
from pyspark.sql import functions as F

from inkveil.functions.catalog import BY_ID, PATTERNS
from inkveil.operators.detect import MARK, STAND_IN, DetectOptions, candidates, detect, with_matches
from inkveil.plans.pipeline import certificates, redact

CASES = [
    ("", []),
    (" \n\t", []),
    ("DOB: 24/05/1977", [("date-of-birth", "24/05/1977")]),
    ("Expires 24/05/2025", [("date", "24/05/2025")]),
    ("DOB: 1951-09-03", [("date-of-birth", "1951-09-03")]),
    ("Call 555-121\n23 today", [("phone", "555-12123")]),
    ("Contact jane.doe@example.comSSN 123-45-6789", [("email", "jane.doe@example.com"), ("ssn", "123-45-6789")]),
    ("Contactjane.doe@example.com", [("email", "jane.doe@example.com")]),
    ("Contact contact123@example.com and mailbox42@x.com", [("email", "contact123@example.com"), ("email", "mailbox42@x.com")]),
    ("Kimberly Lawrence, born on 24/05/1977", [("person", "Kimberly Lawrence"), ("date-of-birth", "24/05/1977")]),
    ("IBAN GB82 WEST 1234 5698 7654 32Notes", [("iban", "GB82 WEST 1234 5698 7654 32")]),
    ("New Amandafort. Wyoming United States- 97375", [("other", "New Amandafort"), ("other", "Wyoming"), ("other", "97375")]),
    ("SSN: 100010013  routing number", [("ssn", "100010013")]),
    ("phone" + "漢字" * 5 + "555-1212", [("phone", "555-1212")]),
    ("漢漢 555-1212 phone", [("phone", "555-1212")]),
    ("Page: 46 then Age: 46", [("other", "Age: 46")]),
    ("HOSP1234567890123 ADR1234", [("national-id", "DR1234")]),
    ("update 24/05/2025", []),
    ("Dr. Smith", []),
    ("Dr. John Smith MD", [("person", "John Smith")]),
    ("Name: CherylBlankenshipDoctor", [("person", "CherylBlankenship")]),
    ("Patient Name: Lisa Chung Contact", [("person", "Lisa Chung")]),
    ("Smith 24/05/1977 dob", [("person", "Smith"), ("date-of-birth", "24/05/1977")]),
    ("New Meeting, Texas address", [("other", "Texas")]),
    ("card 4111 1111 1111 1111 and 4111 1111 1111 1112", [("credit-card", "4111 1111 1111 1111")]),
    ("host 192.168.1.10 and 192.168.001.1", [("ip-address", "192.168.1.10")]),
    ("Acme Health Clinic Inc", [("other", "Acme Health Clinic Inc")]),
    ("passport X12345678", [("passport", "X12345678")]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "kept") for i, (t, _) in enumerate(CASES)] + [(1000, None, "kept")]
    pages = spark.createDataFrame(rows, "doc_id int, text string, matches_raw string").coalesce(1)
    return {r.doc_id: r for r in with_matches(pages, DetectOptions(as_of_year=2026)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_known_matches(found, i):
    text, want = CASES[i]
    got = found[i].matches
    # the order of starts
    assert [(m.category, m.text) for m in got] == want
    for m in got:
        whole = text.encode()[m.start : m.end].decode()
        assert whole == text[m.char_start : m.char_end]
        assert whole == m.text or whole.replace("\n", "") == m.text


def test_null_text_and_other_columns(found):
    assert found[1000].matches == [] and found[1000].text is None and found[0].matches_raw == "kept"


def test_options(spark):
    pages = spark.createDataFrame([(1, "123456789 and jane@example.com, 24/05/1977")], "doc_id int, text string")
    run = lambda **o: {(r.category, round(r.confidence, 2)) for r in detect(pages, DetectOptions(as_of_year=2026, patterns=tuple(BY_ID[i] for i in ("email", "ssn-contiguous", "date", "date-of-birth")), **o)).collect()}
    assert run() == {("email", 0.95)}
    # a bare date is a birth date too, which replaces it on the same span
    assert run(aggressive=True) == {("email", 0.95), ("ssn", 0.38), ("date-of-birth", 0.23)}
    assert run(aggressive=True, categories=("identity",)) == {("ssn", 0.38)}
    assert run(min_confidence=float("nan")) == {("email", 0.95)}
    assert run(categories=("phone",)) == set()
    with pytest.raises(ValueError):
        DetectOptions(categories=("nothing",))


def test_catalog():
    import re

    assert len({p.id for p in PATTERNS}) == len(PATTERNS) == 30
    floor = DetectOptions().floor
    alone = {p.id for p in PATTERNS if p.base >= floor}
    assert len(alone) == 17 and all(p.keywords and re.compile(p.regex) for p in PATTERNS)


def test_empty_table(spark):
    assert detect(spark.createDataFrame([], "doc_id int, text string"), DetectOptions(patterns=(BY_ID["email"],))).count() == 0


def test_plan_holds_each_search_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    pages = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    found = detect(pages, DetectOptions(as_of_year=2026))
    masked = redact(pages, DetectOptions(as_of_year=2026), ("x",))
    for df in (found, found.where("category = 'email'"), masked, masked.where("size(matches) > 0"), certificates(masked)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for p in PATTERNS:
            if p.id not in ("ssn-contiguous", "us-aba-routing", "date", "date-of-birth"):
                assert plan.count(f"U){p.search or p.regex}, ") == 1, p.id


def test_marks_and_places(spark):
    text = f"{MARK}é jane@example.com {MARK}{STAND_IN} bob@example.org"
    (row,) = with_matches(spark.createDataFrame([(text,)], "text string"), DetectOptions(patterns=(BY_ID["email"],))).collect()
    assert [(m.char_start, m.char_end, m.text) for m in row.matches] == [(3, 19, "jane@example.com"), (23, 38, "bob@example.org")]
    assert all(text.encode()[m.start : m.end].decode() == m.text for m in row.matches)


def test_many_matches_in_one_text(spark):
    n = 3000
    (row,) = spark.createDataFrame([("é a@b.com " * n,)], "text string").select(F.size(candidates("text", r"[a-z]@b\.com")).alias("n"), F.element_at(candidates("text", r"[a-z]@b\.com"), -1).alias("last")).collect()
    assert (row.n, row.last.chars, row.last.bytes) == (n, 10 * (n - 1) + 2, 11 * (n - 1) + 3)


def test_searches_find_what_patterns_say(spark):
    """An address may begin where the one before it ends; a long run of characters takes no longer than others."""
    import re

    texts = ["a@b.com", "x.y@z.org,a@b.co", "a@b." + "c" * 30 + "@d.com e@f.com", "@a@b.com", "a@b@c.de", "é@x.com jé@x.com", ".@x.com", "x" * 300_000 + " a@b.com"]
    p = BY_ID["email"]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", candidates("t", "(?U)" + p.search).alias("c")).collect()
    for r in found[:-1]:
        assert [m.raw for m in r.c] == re.findall(p.regex, texts[r.i])
    assert [m.raw for m in found[-1].c] == ["a@b.com"]
