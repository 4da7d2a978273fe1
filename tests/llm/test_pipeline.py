import random

import corpus_pipeline
from inkveil.llm import mixing


def test_stages_in_order(spark, docs_dir):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "and", "reader", "light", "story", "began", "house", "river", "slow"]) + rng.choice(["", "", "s", "ing"])
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        text = " ".join(word() for _ in range(60)) + "." if good else "BUY!!! *** NOW $$$ " * rng.randrange(5, 15) + str(i)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(300 + i, rows[1][1], "en", "s0", 0) for i in range(5)]
    rows.append((400, rows[2][1] + " password=hunter2hunter2", "en", "s0", 0))
    rows.append((401, " ".join(word() for _ in range(60)) + " token = abcdef123456", "en", "s0", 0))
    path = docs_dir(rows, labels=(labels, "doc_id bigint, quality int, toxic int"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        seen.append((name, before, [(r.doc_id, r.text) for r in docs.collect()]))
    good = {r[0] for r in rows if r[0] % 4 or r[0] >= 300}
    assert {d for d, _ in seen[0][2]} == good
    assert {1} | good - {300 + i for i in range(5)} >= {d for d, _ in seen[1][2]}
    assert not {300, 301, 302, 303, 304, 400} & {d for d, _ in seen[1][2]}
    assert dict(seen[2][2])[401].endswith(" [assign]") and len(seen[2][2]) == len(seen[1][2])
    sizes = {d: len(t.split()) for d, t in seen[2][2]}
    assert {d for d, _ in seen[3][2]} <= set(sizes)
    final = corpus_pipeline.run(spark, path)
    assert all(r.round_trip for r in final.collect())
    assert sorted(r.doc_id for r in final.collect()) == sorted(d for d, _ in seen[3][2])


def test_mix_comes_near_targets(spark, docs_dir):
    rows = [(i, "w " * (10 + i % 5), "en", f"s{i % 6}", 0) for i in range(1200)] + [(5000, None, "en", "s1", 0), (5001, "", None, None, 0)]
    docs = spark.read.parquet(docs_dir(rows) + "/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    took: dict = {}
    for r in out.collect():
        took[r.source] = took.get(r.source, 0) + len((r.text or "").split())
    by: dict = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + len((r[1] or "").split())
    for s, t in mixing.brute_targets(by).items():
        assert abs(took.get(s, 0) - t) <= 0.1 * t + 20
    assert {5000, 5001} <= {r.doc_id for r in out.collect()}


def test_stages_on_edge_cases(spark, docs_dir):
    """Nulls in any column, repeated rows, a very long text, clashing columns, and an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component bigint, spans string, blob string, class string, slot int"
    extra = (0.5, 7, "s", "b", "c", 3)
    labels = ([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    rows = [(i, f"the story of the house number {i} began by the river", "en", "a", 9, *extra) for i in range(20)]
    rows += [(None, None, None, None, None, *[None] * 6), (None, "", "en", None, 0, *extra), (3, rows[3][1], "en", "a", 9, *extra), (50, "slow light " * 40_000 + "password=hunter2hunter2", "en", "b", 1, *extra), (51, " ", "en", "b", 1, *extra)]
    for given in (rows, []):
        path = docs_dir(given, schema, labels=labels)
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns, name
            got = out.collect()
            if not given:
                assert got == [], name
            kept = {r.doc_id for r in got}
            assert kept <= {r[0] for r in given}, name
            if name.startswith("MinHash"):
                # the repeated row goes, rows without words stay
                assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, [r[0] for r in given if r is not rows[22]]))
            if name.startswith("secret") and given:
                assert len(got) == len(given) and {r.doc_id: r.text for r in got}[50] == "slow light " * 40_000 + "[assign]"
            if name.startswith("mixing") and given:
                assert {None, 51} <= kept
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == len(given)
