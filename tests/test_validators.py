import pytest
from pyspark.sql import functions as F

from inkveil.functions import validators as V

VECTORS = {
    "luhn": (["4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005"], ["4111 1111 1111 1112", "0000000000000000", "411111111111", ""]),
    "iban": (["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "gb82west12345698765432"], ["GB82 WEST 1234 5698 7654 33", "GB82", "DE8937040044053201300", "XX00", ""]),
    "ssn": (["123-45-6789", "123456789"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "12345678", ""]),
    "email": (["a@b.co", "jane@x.IO", "j@x.Com"], ["a@b", "@b.co", "a@b.cOm", "a@b.c", "a@.com1", ""]),
    "phone": (["+1 415-555-0132", "415.555.0132", "1 415 555 0132", "415 555 0132 x123", "(415) 5550132", "4155550132", "14155550132"], ["123-45-6789", "12-3456789", "7421.15", "1234 5698 7654 32", "1111111", "555-5555-555", "0155550132", "1234567", ""]),
    "aba": (["021000021", "011401533"], ["021000022", "000000000", "12345678", ""]),
    "ipv4": (["0.0.0.0", "255.255.255.255", "192.168.1.1"], ["256.1.1.1", "1.1.1", "01.1.1.1", "1.1.1.1.1", ""]),
    "date": (["24/05/1977", "05-24-1977", "1951-09-03", "2024/02/29", "09031951", "Feb 28, 2024", "Sept. 3 2024", "December 5, 2024", "1/2/35", "15/01/2040"], ["32/01/2020", "15/09/023", "05/06/2077", "00/00/2000", "2023-02-29", "Feb 30, 2024", "13/13/2000", "1/2-2020", "Foo 3 2024", "99999999", ""]),
    "age-years-old": (["46-year-old", "1-YEARS-old", "120-year-old"], ["0-year-old", "121-year-old", "05-year-old", "46-yearold"]),
    "age-aged": (["aged 56", "Aged 1"], ["aged 0", "aged", "aged 121"]),
    "age-labeled": (["Age: 46", "age:12", "AGE : 7"], ["Age 46", "Age: 0", "Page: 46"]),
    "zip": (["12345", " 90210 "], ["00000", "1234", "123456", "1234a"]),
    "street": (["742 Evergreen Street", "12 Oak Rd, Apt", "1 Some Villages"], ["Evergreen Street", "123 Record", "12345678 Oak Street", "1 St", "123 Forroad"]),
    "name": (["Kimberly Lawrence", "James James Choi", "KimberlyLawrence", "Name: Jane Doe", "Dr. Jane Doe", "Mary O'Brien", "Jean-Luc Picard", "Susan Frances Martin Date"], ["Kimberly", "Patient Name", "jane doe", "Blood Pressure", "Mary O'", "A B C D E F", ""]),
    "name-before-date": (["Smith", "Jane Doe"], ["Patient", "A B C D E", ""]),
    "org": (["Acme Health Inc", "General Hospital", "Foo Bar LLC"], ["Acme Health", "inc", "Hospital", ""]),
    "city": (["Springfield", "New Amandafort", "Springfield, Illinois"], ["Meeting", "new york", "Page Texas", "A", ""]),
    "hospital": (["HOSP26508961", "hosp123456"], ["HOSP12345", "HOSP1234567890123", "HOSP12345a"]),
    "provider": (["DR14144B", "DR4509A", "dr123"], ["DR12", "DR123456789", "DR123AB", "DR"]),
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, check in V.by_name(2026).items():
        yes, no = VECTORS[name]
        df = spark.createDataFrame([(s,) for s in [*yes, *no, None]], "s string").coalesce(1)
        out[name] = {r.s: r.ok for r in df.select("s", check(F.col("s")).alias("ok")).collect()}
    return out


@pytest.mark.parametrize("name", VECTORS)
def test_vectors(results, name):
    yes, no = VECTORS[name]
    got = results[name]
    assert [s for s in yes if not got[s]] == [] and [s for s in [*no, None] if got[s]] == []


def test_year_of_the_clock():
    assert V.as_of_year(0) == 1970 and V.as_of_year(86_400 * 365 * 56) == 2026
