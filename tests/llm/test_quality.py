import zlib

import numpy as np
import pytest

from inkveil.llm import quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, y int"
LABELS = "doc_id bigint, quality int, toxic int"


def _rows(n):
    good = "the quick brown fox jumps over the lazy dog and runs home."
    return [(i, (f"{good} {i} " * 5) if i % 3 else f"BUY!!! {i} *** NOW " * 9, "en", "s", 1, "x", 0) for i in range(n)]


def test_held_out_accuracy_and_edge_rows(spark, docs_dir):
    rows = _rows(300) + [(1000, None, None, None, None, None, None), (1001, "", None, None, None, None, None), (None, "x", None, None, None, None, None), (5, "dup", None, None, None, None, None)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (7777, 1, 1)]
    got = quality.op3_quality_classifier(spark, docs_dir(rows, DOCS, labels=(labels, LABELS))).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert next(r for r in got if r.doc_id is None).held_out
    held = [r for r in got if r.held_out and (r.doc_id or 1000) < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95


def test_no_labels_and_one_class(spark, docs_dir):
    got = quality.op3_quality_classifier(spark, docs_dir(_rows(9), DOCS, labels=([], LABELS))).collect()
    assert {r.score for r in got} == {0.5}
    got = quality.op3_quality_classifier(spark, docs_dir(_rows(9), DOCS, labels=([(i, 1, 0) for i in range(9)], LABELS))).collect()
    assert all(r.score > 0.9 for r in got)
    assert quality.op3_quality_classifier(spark, docs_dir([], DOCS, labels=([], LABELS))).count() == 0


def test_filter_keeps_columns(spark, docs_dir):
    path = docs_dir(_rows(60), DOCS, labels=([(i, int(i % 3 > 0), 0) for i in range(60)], LABELS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = quality.filter_quality(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 3}


def test_trees_walk_like_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.NAMES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = quality.train(x, y, trees=20)

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.above, forest.value, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > t[i] else 1)
            total += v[i - len(f)]
        return 1 / (1 + np.exp(-total))

    assert forest.score(x[:40]) == pytest.approx([walk(r) for r in x[:40]])
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "\n\n", "x", "é", "\0", "a " * 100_000):
        assert len(quality.statistics(t)) == len(quality.NAMES) and np.isfinite(quality.statistics(t)).all()


def test_first_split_and_leaves_match_exhaustive_search():
    """Of all features and all quantile cuts, the root takes the one of the greatest Newton gain; leaves hold Newton steps."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, size=(300, 5)).astype(float)
    y = (x[:, 2] + rng.normal(0, 4, 300) > 14).astype(float)
    forest = quality.train(x, y, trees=1, depth=1, bins=16, rate=0.5)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    best = (-1.0, 0, 0.0)
    for j in range(5):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 16)[1:-1])):
            left = x[:, j] <= cut
            if 8 <= left.sum() <= 292:
                gain = sum(g[side].sum() ** 2 / (h[side].sum() + 1) for side in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut)
    assert (forest.feature[0, 0], forest.above[0, 0]) == best[1:] and best[1] == 2
    left = x[:, 2] <= best[2]
    assert forest.value[0] == pytest.approx([0.5 * g[side].sum() / (h[side].sum() + 1) for side in (left, ~left)])


def test_statistics_match_brute_force():
    import math
    import zlib

    text = "Été NOW!! the the cat\nsat 42 %% on,\n\nit. x"
    got = dict(zip(quality.NAMES, quality.statistics(text), strict=True))
    data, words = text.encode(), text.encode().split()
    n, size = len(words), len(text.encode())
    of = lambda f: sum(map(f, data)) / size
    pairs = list(zip(words, words[1:], strict=False))
    want = {
        "log_bytes": math.log1p(size), "log_words": math.log1p(n), "word_length": sum(map(len, words)) / n, "upper": of(lambda c: 65 <= c <= 90), "lower": of(lambda c: 97 <= c <= 122),
        "digit": of(lambda c: 48 <= c <= 57), "space": of(lambda c: c == 32), "newline": of(lambda c: c == 10), "non_ascii": of(lambda c: c > 127), "symbol": data.count(b"%") / size,
        "punctuation": of(lambda c: chr(c) in ".,!"), "control": 0.0, "entropy": -sum(data.count(c) / size * math.log2(data.count(c) / size) for c in set(data)),
        "unique_words": len(set(words)) / n, "top_word": 2 / n, "repeats": 1 / n, "unique_pairs": len(set(pairs)) / n, "unique_lines": 1.0, "line_words": n / 3, "sentence_words": n / 3,
        "ended_words": 3 / n, "symbol_words": 1 / n, "shouted_words": sum(w.isupper() for w in words) / n, "compression": len(zlib.compress(data, 1)) / size, "longest_word": 5.0,
        "short_words": sum(len(w) <= 3 for w in words) / n,
    }
    assert got == pytest.approx(want)


def test_repeated_ids_are_one_sample_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(200)] + [(i, "good words here") for i in range(2, 30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id bigint, quality int")
    forest = quality.fit(docs, labels, 10)
    again = quality.fit(docs.repartition(5), labels, 10)
    assert (forest.value == again.value).all() and forest.base == again.base
