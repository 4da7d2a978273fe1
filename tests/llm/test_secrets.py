import hashlib
import random

from pyspark.sql import functions as F

from inkveil.llm import secrets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string, spans string"


def _texts():
    rng = random.Random(5)
    bits = ["password", "TOKEN", "api_key", "secret", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "漢", "\n", "ghp_" + "a" * 30, "x", "-----BEGIN RSA PRIVATE KEY-----", "ſecret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return [*texts, None, "", "token=token:abcdefgh", "token:ab secret:abcdefgh", "é token = 'abcdef'", "z " * 50_000 + "password=hunter22", texts[0], texts[0]]


def test_matches_brute_force(spark, docs_dir):
    texts = _texts()
    rows = [(i, t, None, None, None, "b", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in secrets.op4_secret_ledger(spark, docs_dir(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        base, every = secrets.brute(t)
        assert got[i].spans == ",".join(every)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x.startswith(k + ":") for x in base) for k in secrets.BASE]
    assert secrets.op4_secret_ledger(spark, docs_dir([], DOCS)).count() == 0


def test_only_unseen_pairs_are_scanned(spark, docs_dir, monkeypatch):
    rows = [(i, f"password=abc{i % 4}xyz ghp_{'z' * 30}", None, None, None, "b", "s") for i in range(20)]
    docs = spark.read.parquet(docs_dir(rows, DOCS) + "/documents.parquet")
    first = docs.where("doc_id % 4 < 3")
    ledger = secrets.materialize(secrets.scan(first, rule_version=1))
    assert ledger.count() == 3
    assert [r.text[:16] for r in secrets.unseen(docs, ledger, 1).collect()] == ["password=abc3xyz"]
    assert sorted((r.text[:12], r.versions) for r in secrets.unseen(docs, ledger).collect()) == [("password=abc", [1, 2])] + [("password=abc", [2])] * 3
    # a seen pair keeps its entry: it isn't scanned again
    marked = ledger.withColumn("spans", F.transform("spans", lambda x: x.withField("kind", F.lit("old"))))
    whole = secrets.materialize(secrets.scan(docs, marked))
    assert whole.count() == 8 and secrets.unseen(docs, whole).count() == 0
    for most in (secrets.MOST_HITS, 1):
        monkeypatch.setattr(secrets, "MOST_HITS", most)
        found = {r.doc_id: [x.kind for x in r.found] for r in secrets.findings(docs, whole, name="found").collect()}
        assert found == {i: ["old" if i % 4 < 3 else "assign", "token"] for i in range(20)}
        assert all(len(r.found) == 1 for r in secrets.findings(docs, whole, 1, "found").collect())


def test_redaction_keeps_columns(spark, docs_dir):
    texts = ["é password=abcdef0123456789abcdef0123 tail", "clean", None, "", "deadbeefdeadbeefdeadbeef"]
    docs = spark.read.parquet(docs_dir([(i, t, "l", "s", 1, "b", "x") for i, t in enumerate(texts)], DOCS) + "/documents.parquet")
    out = secrets.without_secrets(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "é [assign] tail", 1: "clean", 2: None, 3: "", 4: "[hex]"}
