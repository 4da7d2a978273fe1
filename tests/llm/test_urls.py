import pytest

from inkveil.llm import urls

SCHEMA = "page_id bigint, url string, html string, host string"
ROWS = [
    (1, "http://WWW.Example.com/en/a?x#y", None, "z"),
    (2, "http://a.example.com/en/a", None, None),
    (3, "http://a.www.example.com/en/", None, None),
    (4, "http://other.net/es/q", None, None),
    (5, "http://other.org/es/q", None, None),  # listed: its path is blocked on .net
    (6, "http://other.org/zz", None, None),
    (7, None, None, None),
    (8, "no scheme", None, None),
    (9, "http://com/", None, None),
    (10, "http://notcom", None, None),
    (11, "x://é.NET/fr/É?", None, None),
    (4, "http://other.net/es/q", None, None),
    (None, "http://?a", None, None),
]


def _judged(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op6_url_filter_cascade(spark, str(tmp_path)).collect()}


def test_rules_and_list(spark, tmp_path):
    assert _judged(spark, tmp_path, ROWS) == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        2: ("a.example.com", "/en/a", "example.com/en/", "block"),
        3: ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        4: ("other.net", "/es/q", "net/es/", "block"),
        5: ("other.org", "/es/q", None, "block"),
        6: ("other.org", "/zz", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("com", "/", "com/", "allow"),
        10: ("notcom", "", None, "allow"),
        11: ("é.net", "/fr/É", "net/fr/", "block"),
        None: ("", "", None, "allow"),
    }


def test_empty(spark, tmp_path):
    assert _judged(spark, tmp_path, []) == {}


@pytest.mark.parametrize("shard_keys", [urls.SHARD_KEYS, 700])
def test_cascade_is_exact_over_its_universe(spark, shard_keys):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = universe.where("substr(key, -1) in ('3', '7')")
    cascade = urls.Cascade(listed, universe, error=0.1, shard_keys=shard_keys)
    assert len(cascade.levels) > 2 and cascade.shards == (1 if shard_keys > 4000 else 6)
    # a frequent key, repeated rows, nulls
    asked = universe.selectExpr("key", "1 as words").union(universe.selectExpr("'k3'", "2")).union(universe.limit(5).selectExpr("cast(null as string)", "3"))
    got = cascade.flag(asked, "key", "listed")
    assert got.columns == ["key", "words", "listed"] and got.count() == 40_005
    assert got.where("listed <> coalesce(substr(key, -1) in ('3', '7'), false)").count() == 0
    nothing = urls.Cascade(listed.limit(0), universe)
    assert nothing.flag(universe, "key", "listed").where("listed").count() == 0


def test_rules_of_equal_length(spark):
    rules = (("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "b.com", "/"))
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://c.b.com/" + "y" * 100_000)], "page_id bigint, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()} == {1: ("a.com/x", "block"), 2: ("b.com/", "block")}
