import pytest

from inkveil.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row int"


def _rows():
    out, i = [], 0
    for source, docs, words in (("b", 30, 50), ("a", 4, 11), (None, 20, 7), ("é", 3, 900), ("c", 5, 0), ("z", 40, 33)):
        for k in range(docs):
            out.append((i, " \t".join(["w"] * (words + (k % 3 if words else 0))) if words else None, "", source, 0, "s", 1))
            i += 1
    return out


@pytest.mark.parametrize("block", [16, 256, 5000])
def test_targets_are_met(spark, docs_dir, block):
    rows = _rows()
    docs = spark.read.parquet(docs_dir(rows, DOCS) + "/documents.parquet")
    got = mixing.taken(docs, block).collect()
    sizes = {r[0]: len((r[1] or "").split()) for r in rows}
    assert {r.doc_id: r["size"] for r in got} == sizes and len(got) == len(rows)
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + sizes[r[0]]
    target, took = mixing.brute_targets(by), dict.fromkeys(by, 0)
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r["size"]
        took[r.source] += r.taken
    assert all(abs(took[s] - target[s]) < 1.001 for s in by)
    again = mixing.taken(docs.repartition(7), block).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_schedule_has_low_discrepancy(spark, docs_dir):
    rows = [(i, "w " * 100, "", f"s{i % 3}", 0, "", 0) for i in range(600)]
    sizes, sources, _ = mixing.plan(spark.read.parquet(docs_dir(rows, DOCS) + "/documents.parquet"))
    got = mixing.schedule(sources, 60_000, 20).orderBy("slot").collect()
    share = {r.sid: r.target / 60_000 for r in sources.collect()}
    seen = dict.fromkeys(share, 0)
    for n, r in enumerate(got, 1):
        assert r["rank"] == seen[r.sid] and r["first"] == 20 * r["rank"]
        seen[r.sid] += 1
        assert all(abs(seen[s] - share[s] * n) < 8 for s in share)


def test_repeated_ids_empty_and_wordless(spark, docs_dir):
    rows = [(1, "a b", "", "s", 0, "", 0), (1, "a b c", "", "s", 0, "", 0), (None, "d", "", "s", 0, "", 0)]
    got = mixing.op10_source_mixing(spark, docs_dir(rows, DOCS)).collect()
    assert sorted((r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 6, 6.0, 1), (2, 6, 6.0, 2), (3, 6, 6.0, 3)]
    assert mixing.op10_source_mixing(spark, docs_dir([], DOCS)).count() == 0
    got = mixing.op10_source_mixing(spark, docs_dir([(1, " ", "", "s", 0, "", 0)], DOCS)).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)]
