import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.llm import lm

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, held_out int"


def _rows():
    rng = random.Random(8)
    words = ["the", "The", "cat", "sat", "é", "É", "on", "mat."] + [f"w{i}" for i in range(300)]
    weights = [50 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 80]))) for _ in range(200)]
    return [(i, t, "", "", 0, "", 0) for i, t in enumerate([*texts, None, "", " \n", "unseen only", "the cat " * 20_000, texts[3], texts[3]])]


@pytest.mark.parametrize(("batch", "shard"), [(2_000_000, 8_000_000), (3_000, 10_000)])
def test_scores_match_brute_force(spark, docs_dir, monkeypatch, batch, shard):
    rows = _rows()
    want = lm.brute([r[:2] for r in rows])
    monkeypatch.setattr(lm, "SHARD", shard)
    monkeypatch.setattr(lm, "BATCH", batch)
    got = lm.op9_ngram_trie_scores(spark, docs_dir(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base, full = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6, rel=1e-9)
        # a code is off by half a step at most, and two counts have codes
        assert abs(r.score - full) <= n * np.log10(total) / 254 + 1e-6


def test_no_training_rows_nulls_and_empty(spark, docs_dir):
    assert lm.op9_ngram_trie_scores(spark, docs_dir([], DOCS)).count() == 0
    got = lm.op9_ngram_trie_scores(spark, docs_dir([(None, "a b", "", "", 0, "", 0)], DOCS)).collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(None, True, 3, 0, 0)]
    got = lm.op9_ngram_trie_scores(spark, docs_dir([(1, "a b", "", "", 0, "", 0), (1, "a b", "", "", 0, "", 0)], DOCS)).collect()
    assert len(got) == 2 and got[0].train_tokens == 6 and got[0][2:] == got[1][2:]


def test_counts_of_one_are_kept_and_probabilities_add_up(spark):
    learnt = [(1, "a b c"), (2, "a b d"), (3, "x y")]
    asked = [(10 + i, f"a b {w}") for i, w in enumerate(["a", "b", "c", "d", "x", "y"])]
    docs = spark.createDataFrame([*learnt, *asked, (30, "a b")], "doc_id bigint, text string")
    out, stats = lm.learn_and_score(docs, F.col("doc_id") < 10)
    assert stats == {"tokens": 11, "rows": 3, "words": 7}
    want = lm.brute([*((d, t) for d, t in learnt)])  # none of 1, 2, 3 is held out
    got = {r.doc_id: r.score for r in out.collect()}
    assert not any(w[0] for w in want.values())
    for d, _ in learnt:
        assert got[d] == pytest.approx(want[d][5], abs=0.02)
    assert got[12] > got[14] + 0.3


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 64, 1000, 70_000):
        for top in (1, 7, 10**6):
            values = rng.integers(0, top, n).cumsum()
            assert (lm.EliasFano.read(*lm.EliasFano.build(values).values()) == values).all()


def test_packing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 400):
        columns = [rng.integers(0, 5, n), rng.integers(0, 9, n), rng.integers(0, 2**40, n)]
        order = np.lexsort(columns[::-1])
        columns = [x[order] for x in columns]
        steps = lm.unpack(lm.pack(**dict(zip("abc", lm._steps(*columns), strict=True))))
        assert all((x == y).all() for x, y in zip(lm._unsteps(*steps.values()), columns, strict=True))
    odd = {"x": np.array([-5, 2**62]), "y": np.zeros(0, np.uint8), "z": np.array([255, 256])}
    assert all((lm.unpack(lm.pack(**odd))[k] == v).all() for k, v in odd.items())


def test_trie():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (50, 4), (5000, 60), (3000, 2**40)):
        pairs, c2 = lm._added([rng.integers(0, top, n) for _ in range(2)], rng.integers(0, 3, n))
        triples, c3 = lm._added([rng.integers(0, top, n) for _ in range(3)], rng.integers(0, 3, n))
        k2, k3 = (np.minimum(c, 255).astype(np.uint8) for c in (c2, c3))
        trie = lm.Trie(lm.Trie.build(pairs, k2, triples, k3))
        assert (trie.pairs(*pairs) == k2).all() and (trie.triples(*triples) == k3).all()
        there2, there3 = set(zip(*pairs, strict=True)), set(zip(*triples, strict=True))
        ask = [rng.integers(0, top + 2, 2000) for _ in range(3)]
        assert [x > 0 for x in trie.pairs(*ask[:2])] == [p in there2 for p in zip(*ask[:2], strict=True)]
        assert [x > 0 for x in trie.triples(*ask)] == [p in there3 for p in zip(*ask, strict=True)]


def test_listed_words_are_those_of_tokens():
    texts = ["", None, " ", "A b\tb\n", "  \x0b\x0cÀ É\u00a0x \x1cy\r\nz\x1fz ", "a" * 70_000, "\u2003 \x00 \x85", "İ K ſ", "b A"]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["left out", *texts], kind).slice(1)
        words, place, lengths = lm.listed(column)
        assert len(set(words)) == len(words)
        ends = lengths.cumsum().tolist()
        assert [[words[i] for i in place[e - n : e]] for e, n in zip(ends, lengths, strict=True)] == [lm.tokens(t) for t in texts]
    words, place, lengths = lm.listed(pa.array([], pa.string()))
    assert len(place) == len(lengths) == 0


def test_steps_in_runs():
    rng = np.random.default_rng(3)
    starts = np.array([0, 0, 40, 41, 41, 300, 300])  # with empty runs, the last at the end
    columns = [rng.integers(0, 4, 300), rng.integers(0, 6, 300), rng.integers(0, 2**40, 300)]
    order = np.concatenate([a + np.lexsort([x[a:b] for x in columns[::-1]]) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    columns = [x[order] for x in columns]
    steps = lm._steps(*columns, starts=starts)
    assert all(x.min() >= 0 for x in steps)
    assert all((x == y).all() for x, y in zip(lm._unsteps(*steps, starts=starts), columns, strict=True))


@pytest.mark.parametrize("top", [6, 2**30])
def test_each_gram_is_searched_once_and_in_order(monkeypatch, top):
    rng = np.random.default_rng(4)
    asked = {"pairs": [], "triples": []}
    for name, calls in asked.items():
        search = getattr(lm.Trie, name)
        monkeypatch.setattr(lm.Trie, name, lambda self, *x, search=search, calls=calls: calls.append(list(zip(*(c.tolist() for c in x), strict=True))) or search(self, *x))
    values = rng.integers(0, top, 6)
    messages, counts = [], {}
    for size in (30, 0, 50, 1):
        rows = [sorted({tuple(r) for r in rng.choice(values, (size, k)).tolist()}) for k in (2, 3)]
        n = [rng.integers(0, 3, len(r)) for r in rows]
        for r, m in zip(rows, n, strict=True):
            for x, c in zip(r, m.tolist(), strict=True):
                counts[x] = counts.get(x, 0) + c
        (a, b), (ta, tb, tc) = (lm._steps(*np.array(r, dtype=np.int64).reshape(len(r), k).T) for r, k in zip(rows, (2, 3), strict=True))
        messages.append((rows, lm.pack(a=a, b=b, n=n[0], ta=ta, tb=tb, tc=tc, tn=n[1])))
    got = list(lm._answers([d for _, d in messages], 1000))
    want = [[lm.codes(np.array([counts[x] for x in r], dtype=np.int64), 1000).tolist() for r in rows] for rows, _ in messages]
    assert [[x.tolist() for x in two_three] for two_three in got] == want
    # however many messages ask for it, an n-gram is looked up once, in the order of the trie
    for k, calls in zip((2, 3), asked.values(), strict=True):
        assert calls == [sorted(x for x in counts if len(x) == k)]


@pytest.mark.parametrize(("bundle", "most"), [(1_000_000, 3), (1_000, 200)])
def test_bundles_of_batches(spark, docs_dir, monkeypatch, bundle, most):
    rows = [r for r in _rows() if len(r[1] or "") < 1_000]
    want = lm.brute([r[:2] for r in rows])
    for name, value in (("BATCH", 500), ("BUNDLE", bundle), ("SHARD", 10_000)):
        monkeypatch.setattr(lm, name, value)
    folder = docs_dir(rows, DOCS)
    # a few short rows fill an Arrow batch, and a bundle takes many of those
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.read.parquet(folder + "/documents.parquet").selectExpr("doc_id as id", "doc_id % 2 = 0 as train", "text").coalesce(3)
        sent = lm._tokenised(docs, 4).select("bundle", "shard").collect()
        got = {r.doc_id: r for r in lm.op9_ngram_trie_scores(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # rows for shards are as many as bundles times shards at most, however many batches there are
    assert len({r.bundle for r in sent}) <= most and len(sent) <= 5 * len({r.bundle for r in sent})
    assert len(got) == len(rows)
    for d, (held, n, known, total, base, full) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6, rel=1e-9)
        assert abs(r.score - full) <= n * np.log10(total) / 254 + 1e-6


@pytest.mark.parametrize(("tasks", "most", "partitions"), [(32, 3, 108), (1, 80, 108), (1500, 2, 6300), (200_000, 1, 400_000)])
def test_bundles_are_spread_evenly(spark, tasks, most, partitions):
    bundles = spark.range(tasks * most).selectExpr(f"shiftleft(id div {most}, 32) + id % {most} as bundle")
    got = bundles.groupBy(lm._spread(F.col("bundle"), most, partitions).alias("p")).count().agg(F.max("count"), F.min("p"), F.max("p")).first()
    # a hash of as many bundles puts 3 and more into a partition
    assert got[0] <= 2 and 0 <= got[1] <= got[2] < partitions
