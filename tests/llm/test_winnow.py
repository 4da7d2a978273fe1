import hashlib
import random

from pyspark.sql import functions as F

from inkveil.llm import winnow

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, tail int"


def _texts():
    rng = random.Random(9)
    words = ["a", "Be", "cé", "d", "漢字", "e.", "F", "g"]
    texts = [rng.choice([" ", "  ", "\n\t"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 12, 13, 60, 400]))) for _ in range(60)]
    return [*texts, None, "", " \n", "same words " * 30, "same words " * 30, "w" * 5000, " ".join(map(str, range(5000)))]


def _run(spark, docs_dir, rows):
    return winnow.op2_winnowing_fingerprints(spark, docs_dir(rows, DOCS)).collect()


def test_edited_texts_and_likeness(spark, docs_dir):
    rows = [(i * 97 % 7919 - 400, t, "", "", None, "x", 1) for i, t in enumerate(_texts())]
    got = {r.doc_id: r for r in _run(spark, docs_dir, rows)}
    assert len(got) == len(rows)
    fp = lambda s: {x.split(":")[0] for x in s.split(",") if x}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ordered = sorted((r[0] for r in rows), reverse=True)
    for d, n, edited in winnow.brute([r[:2] for r in rows]):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jac(fp(r.fingerprint), fp(r.edited_fingerprint))) < 1e-12
        following = got[ordered[(ordered.index(d) + 1) % len(ordered)]]
        assert abs(r.near_next - jac(fp(r.fingerprint), fp(following.fingerprint))) < 1e-12
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", set()).add(got[r[0]].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_choice_is_rightmost_least(spark):
    text = [(i, t) for i, t in enumerate(_texts()) if t]
    df = winnow.add_fingerprint(spark.createDataFrame(text, "i int, t string"), "t", "fp")
    tokens = F.regexp_extract_all(F.lower("t"), F.lit(winnow._TOKEN), F.lit(0))
    df = df.select("i", winnow.written("fp").alias("fp"), F.transform(tokens, lambda x: F.xxhash64(x)).alias("h"))
    mixed = {}
    turn = lambda h, by: (h << by | h >> (64 - by)) % 2**64
    rolled = {}
    for r in df.collect():
        h = [x % 2**64 for x in r.h]
        out = []
        for p in range(max(len(h) - winnow.GRAM + 1, min(len(h), 1))):
            run = h[p : p + winnow.GRAM]
            x = 0
            for j, v in enumerate(run):
                x ^= turn(v, len(run) - 1 - j)
            out.append(x - 2**64 if x >= 2**63 else x)
        rolled[r.i] = (out, r.fp)
    every = sorted({x for out, _ in rolled.values() for x in out})
    for r in spark.createDataFrame([(x,) for x in every], "x bigint").select("x", F.xxhash64("x").alias("m")).collect():
        mixed[r.x] = (r.m % 2**64) >> 32
    for out, fp in rolled.values():
        hashed = [mixed[x] for x in out]
        assert fp == ",".join(f"{hashed[p]:x}:{p}" for p in winnow.brute_places(hashed))


def test_texts_without_spaces_and_long_words(spark):
    rng = random.Random(4)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))
    junk = "".join(rng.choice("abcdef0123456789") for _ in range(3000))
    rows = [(0, text), (1, text[:250] + "abc"), (2, junk), (3, junk[:2500] + "z" * 200)]
    df = winnow.add_fingerprint(spark.createDataFrame(rows, "i int, t string"), "t", "fp").select("i", winnow.hashes("fp").alias("h"))
    got = {r.i: set(r.h) for r in df.collect()}
    assert all(len(got[a] & got[b]) > 0.6 * len(got[a] | got[b]) and len(got[a]) > 20 for a, b in ((0, 1), (2, 3)))


def test_neighbours_of_scattered_ids(spark):
    rng = random.Random(6)
    for ids in ([rng.randrange(-(2**63), 2**63) for _ in range(300)], [rng.randrange(2**40) for _ in range(300)], list(range(3000, 3700)), [5]):
        buckets = sorted({i >> winnow._SPAN for i in ids}, reverse=True)
        docs = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
        levels = winnow._levels(docs)
        assert max(0, (buckets[0] - buckets[-1]).bit_length() - 10 * (levels + 1)) == 0
        got = {r.bucket: r.following for r in winnow._next_bucket(docs.select(winnow._bucket(F.col("doc_id")).alias("bucket")).distinct(), levels).collect()}
        assert got == dict(zip(buckets, [*buckets[1:], buckets[0]], strict=True))


def test_shared_runs_are_found(spark):
    rng = random.Random(2)
    run = [f"s{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1)]
    texts = [(i, " ".join([f"p{rng.random()}" for _ in range(rng.randrange(30))] + run + [f"q{rng.random()}" for _ in range(rng.randrange(30))])) for i in range(30)]
    df = winnow.add_fingerprint(spark.createDataFrame(texts, "i int, t string"), "t", "fp").select(winnow.hashes("fp").alias("h"))
    sets = [set(r.h) for r in df.collect()]
    assert set.intersection(*sets)


def test_null_repeated_single_and_empty(spark, docs_dir):
    assert _run(spark, docs_dir, []) == []
    one = _run(spark, docs_dir, [(7, "abc def", "", "", 1, "", 0)])[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    got = _run(spark, docs_dir, [(None, "abcdef", "", "", 1, "", 0), (5, "xyz", "", "", 1, "", 0), (5, "xyy", "", "", 1, "", 0)])
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(t).hexdigest() for t in (b"xyx", b"xya", b"abcdxy"))
