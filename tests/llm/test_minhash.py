import random

import numpy as np

from inkveil.llm import graph, minhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, class string, component int"


def _near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def _rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4)))
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d", "A B\tC D", "a b c d e"]
    base = [word() for _ in range(150)]
    texts += [_near(rng, base, rng.randrange(0, 9)) for _ in range(120)]  # a chain-rich group around the threshold
    texts += [" ".join(base)] * 30
    for _ in range(30):
        own = [word() for _ in range(rng.choice([5, 20, 60, 200]))]
        texts += [" ".join(own), _near(rng, own, 1), _near(rng, own, 2)]
        texts.append(" ".join(passage + [word() for _ in range(rng.choice([2, 8, 30]))]))
    rng.shuffle(texts)
    return [(i * 3 + 1, t, "", "", 0, "", 0) for i, t in enumerate(texts)]


def test_components_match_brute_force(spark, docs_dir):
    rows = _rows()
    path = docs_dir(rows, DOCS)
    want = minhash.brute([r[:2] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op1_minhash_components(spark, path).collect()} == want
    docs = spark.read.parquet(f"{path}/documents.parquet")
    in_blocks = minhash.group(docs, block=7).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in in_blocks} == {d: w[:2] for d, w in want.items()}


def test_null_and_repeated_ids(spark, docs_dir):
    rows = [(None, "a b c d e", "", "", 0, "", 0), (7, "a b c d e", "", "", 0, "", 0), (7, "a b c d e", "", "", 0, "", 0), (8, "", "", "", 0, "", 0), (None, None, "", "", 0, "", 0), (7, "other text of that id", "", "", 0, "", 0)]
    path = docs_dir(rows, DOCS)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.op1_minhash_components(spark, path).collect())
    assert got == sorted([("None", 2, "7", False), ("7", 2, "7", True), ("7", 2, "7", True), ("8", 0, "8", True), ("None", 0, "None", True), ("7", 2, "7", True)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("7", "a b c d e"), ("8", ""), ("None", "None"), ("7", "other text of that id")])
    assert minhash.op1_minhash_components(spark, docs_dir([], DOCS)).count() == 0
    assert minhash.one_of_each(spark.read.parquet(docs_dir([], DOCS) + "/documents.parquet")).count() == 0


def test_one_of_each_component_stays(spark, docs_dir):
    rows = _rows()
    docs = spark.read.parquet(docs_dir(rows, DOCS) + "/documents.parquet")
    want = {d for d, (_, _, kept) in minhash.brute([r[:2] for r in rows]).items() if kept}
    got = [r.doc_id for r in minhash.one_of_each(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 400)]
    links = chain + star + [(-9, 150), (1000, 1001), (7, 7)]
    rng.shuffle(links)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: -9 for i in [-9, *range(100, 161)]} | {i: 5 for i in [5, *range(200, 400)]} | {1000: 1000, 1001: 1000}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_near_the_threshold_are_found(spark):
    """Recall of links of similarity 0.8 to 0.85, by brute force: a pair is missed with a chance of 3 in 100,000 at most."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [f"w{rng.random()}" for _ in range(400)]
        other = list(words)
        for at in rng.sample(range(10, 390, 5), rng.choice([9, 10, 11, 12])):
            other[at] = f"x{rng.random()}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = minhash.brute_pairs(rows)
    linked = [i for i in range(400) if want[i] >= 0.8]
    assert 200 < len(linked) < 380 and max(want.values()) < 0.85
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for errors in (minhash.ERRORS, float("inf")):
        got = {r.doc_id: r.component_id for r in minhash.group(docs, errors=errors).collect()}
        assert [i for i in range(400) if got[2 * i + 1] == 2 * i] == linked


def test_texts_with_one_common_passage_are_not_compared(spark, monkeypatch):
    """Compared rows grow with the texts, not with their square."""
    passage = " ".join(f"p{i}" for i in range(100))
    compared = []
    across = minhash._across

    def counted(lists, *rest):
        compared.append(lists.count())
        return across(lists, *rest)

    monkeypatch.setattr(minhash, "_across", counted)
    for n in (300, 600):
        docs = spark.createDataFrame([(i, passage + " " + " ".join(f"{i}w{j}" for j in range(60))) for i in range(n)], "doc_id bigint, text string")
        assert minhash.group(docs, block=64).where("component_id <> doc_id").count() == 0
    assert compared[1] <= 2 * compared[0] + 64


def test_merging_counts_all_collisions():
    """Against the comparison of all signatures: few values, so that lists are long; one block and two; every threshold."""
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 4, (90, minhash.COORDINATES)).astype(np.uint32)
    sig[40:60] = sig[5]  # ties: the same row often
    sig[60] = rng.integers(10, 99, minhash.COORDINATES)  # without company
    whole = np.arange(90)
    for matches in (1, 2, 9, 16, 32):
        for left, right in ((whole, whole), (whole[:50], whole[50:]), (whole[50:], whole[:50])):
            got = {(int(i), int(j)) for i, at in minhash._merge(sig, left, right, matches) for j in at}
            assert got == {(i, j) for i in left.tolist() for j in right.tolist() if i != j and (sig[i] == sig[j]).sum() >= matches}


def test_sets_that_share_a_name_stay_apart(spark):
    rows = [(i, 0, 5, 77, c, b"s", b"k") for i, c in ((1, 1), (2, 1), (3, 2))]
    base = spark.createDataFrame([*rows, (4, 0, 0, None, None, None, None)], minhash._BASE)
    renamed, classes = minhash._classes(minhash.materialize(base))
    names = {r.doc_id: r["class"] for r in renamed.collect()}
    assert names[1] == names[2] != names[3] and names[4] is None and classes.count() == 2
