"""MinHash near-duplicates by an inverted join of signature coordinates.

Rows with equal shingle sets form a class first. A class has COORDINATES MinHash values; each (coordinate, value) is
a token. Two classes of similarity 0.8 share at least MATCHES of their tokens (all but 3 in 100,000 pairs just at 0.8,
fewer above), so they share one of the COORDINATES - MATCHES + 1 rarest tokens of either: only those are posted, and
tokens of one class are not. Long lists of common shingles are skipped that way.

A class is named by 64 bits of its set's hash; sets that share a name but not a second hash get names of their own, so that 128
bits would have to agree for two sets to be taken for one.

In a list, all members are paired with the least first; collisions over whole signatures are counted, pairs with
MATCHES or more are confirmed on full shingle sets, and components are formed. Lists whose members lie in more than
one component are then searched, in blocks, for pairs across components, each in the first list that it shares. There
members are posted under all their tokens, and collisions are counted by merging a member's lists: the MATCHES - 1 longest of
them are skipped, for whoever collides often enough is in one of the others, and are only looked into for members found in
those; members with company in fewer than MATCHES lists are skipped. Pairs
with MATCHES or more whose sketches allow the similarity are confirmed in turn. Links inside a component don't change
it, so nothing is lost, and a group of n copies costs about n pairs and not n * n. Lists of more than a block are thinned
first: a class that has over a fifth of its shingles to itself among all members of such lists is like none of them. So texts
that share a long passage and nothing else are not compared, however many they are.

An infinite `errors` confirms every pair with `matches` equal places, whatever its sketches say.

Edge cases: null text counts as empty; texts without words have no shingles and link with nothing; texts of fewer
words than a shingle are one shingle; whole texts are read, whatever their length, and their sets are held in memory one at
a time, or two to confirm a link; a similarity of just 0.8 links; repeated rows are rows of one class; a null doc_id is linked like others, and
the least doc_id of a component is that of those that aren't null; an empty table gives an empty result; further
columns are kept by one_of_each and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize, release, table
from .graph import components

COORDINATES, MATCHES = 32, 16
WORDS = 4
#: Similarity in hundredths.
LEAST = 80
#: Least hashes of a set by which pairs across components are screened before they are confirmed, and the standard
#: errors that an estimate may lie below the similarity; sets of no more shingles are compared exactly.
SKETCH, ERRORS = 256, 5
#: Members of a list that are compared at once.
BLOCK = 512
#: Rows of texts or signatures that an Arrow batch holds at most.
BATCH_ROWS = 2_000
#: Keys (16 bytes each) that a broadcast holds at most; beyond, the join is a shuffled one.
MOST_KEYS = 2_000_000

_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    """Hashes of words; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; ASCII letters in lower case, words parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    m = min(k, len(w))
    h = np.full(len(w) - m + 1, m, dtype=np.uint64)
    for i in range(m):
        h = h * _P1 + w[i : len(w) - m + 1 + i]
        h ^= h >> np.uint64(29)
    h *= _P2
    h ^= h >> np.uint64(32)
    h *= _P3
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES MinHash values of 32 bits of a set that isn't empty."""
    least = np.full(COORDINATES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, ((s[i : i + 2048, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    return (least >> np.uint64(16)).astype(np.uint32)


def sketch(s: np.ndarray) -> np.ndarray:
    """The upper halves of a set's SKETCH least hashes: of a small set all, of others a uniform sample."""
    return (s[:SKETCH] >> np.uint64(32)).astype(np.uint32)


_BASE = "doc_id bigint, content bigint, n_shingles bigint, class bigint, check bigint, signature binary, sketch binary"


def _content(text: Column) -> Column:
    """Names a row's text; rows with the same doc_id and text are the same to us."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            n, cls, check, sig, least = [], [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                check.append(xxhash.xxh3_64_intdigest(s.tobytes(), 1) - 2**63 if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
                least.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(sig, pa.binary()), pa.array(least, pa.binary())],
                names=["doc_id", "content", "n_shingles", "class", "check", "signature", "sketch"],
            )
        release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _content(F.col("text")).alias("content"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BASE)


def _count_matches(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `matches` places, and whose sizes allow the similarity."""
    s = classes.select("class", "n_shingles", "signature")
    p = pairs.join(s.toDF("b", "nb", "sb"), "b").join(s.toDF("a", "na", "sa"), "a")
    p = p.where(100 * F.least("na", "nb") >= LEAST * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return p.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Pairs come sorted by a, whose set is kept between rows."""

    def run(batches):
        last, have = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, have = a, shingles(ta.as_py(), k)
                other = shingles(tb.as_py(), k)
                both = len(np.intersect1d(have, other, assume_unique=True))
                keep.append(100 * both >= LEAST * (len(have) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    p = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return p.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _alike(mine: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, errors: float) -> tuple[np.ndarray, np.ndarray]:
    """For a sketch against rows of sketches (padded with _PAD): whether the similarity is possible, and known exactly.

    Below the least of the sketches' ends, where they are cut, both are complete, so the share of common hashes there is
    that of a uniform sample of the union.
    """
    end = np.where(sizes > SKETCH, others[:, -1], _PAD - 1)
    if size > SKETCH:
        end = np.minimum(end, mine[-1])
    at = np.minimum(np.searchsorted(mine, others), len(mine) - 1)
    inside = others <= end[:, None]
    both = ((mine[at] == others) & inside).sum(axis=1)
    union = np.searchsorted(mine, end, side="right") + inside.sum(axis=1) - both
    exact = (sizes <= SKETCH) & (size <= SKETCH)
    if errors == np.inf:
        return ~exact | (100 * both >= union * LEAST), exact
    whole = (sizes + size) / (1 + LEAST / 100)
    spread = np.sqrt(LEAST / 100 * (1 - LEAST / 100) / union * np.clip(1 - union / whole, 0, 1))
    return 100 * both >= union * np.where(exact, LEAST, LEAST - 100 * errors * spread - 1e-9), exact


_PAD = 2**32


def _merge(sig: np.ndarray, left: np.ndarray, right: np.ndarray, matches: int):
    """(i, rows of right that collide with row i in `matches` places or more) for the rows i of left that have any but i itself.

    right's rows are posted under each coordinate-value pair. Of the lists in which a row has company, the `matches` - 1 longest
    are skipped: a row that collides often enough is in one of the others, which are merged, and only rows found there are
    looked up in the skipped ones. A row with fewer lists than `matches` is skipped itself.
    """
    posted = np.argsort(sig[right], axis=0, kind="stable").T.copy()
    values = np.take_along_axis(sig[right].T, posted, axis=1)
    lo, hi = (np.stack([np.searchsorted(v, s, side) for v, s in zip(values, sig[left].T, strict=True)], axis=1) for side in ("left", "right"))
    company = hi - lo - np.isin(left, right)[:, None]
    for row in np.flatnonzero((company > 0).sum(axis=1) >= matches).tolist():
        i = left[row]
        held = np.flatnonzero(company[row])
        held = held[np.argsort(company[row, held], kind="stable")]
        short, skipped = held[: len(held) - matches + 1], held[len(held) - matches + 1 :]
        counts = np.bincount(np.concatenate([posted[c, lo[row, c] : hi[row, c]] for c in short.tolist()]), minlength=len(right))
        found = np.flatnonzero(counts)
        at = right[found]
        often = counts[found] + (sig[at][:, skipped] == sig[i, skipped]).sum(axis=1) >= matches
        at = at[often & (at != i)]
        if len(at):
            yield i, at


def _across(lists: DataFrame, matches: int, block: int, errors: float) -> DataFrame:
    """Pairs of different components that share a list, `matches` places and enough of their sketches.

    lists: token, posted (bits of the coordinates that a class is posted under), class, component, n, signature, sketch. A
    list is dealt into blocks, and each pair of blocks is merged apart from the others.
    """
    sizes = lists.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("members") / block).alias("blocks"))
    dealt = lists.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "posted", "class", "component", "n", "signature", "sketch")
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def compare(token, rows):
        own, posted, cls, comp, n = (np.array([r[k] for r in rows]) for k in range(5))
        sig = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint32).reshape(-1, COORDINATES)
        least = [np.frombuffer(r[6], dtype=np.uint32).astype(np.int64) for r in rows]
        padded = np.full((len(rows), min(SKETCH, max(map(len, least)))), _PAD, dtype=np.int64)
        for i, x in enumerate(least):
            padded[i, : len(x)] = x
        under = (posted[:, None] >> np.arange(COORDINATES)) & 1 == 1
        joined: dict = {}  # components that exact comparisons have linked here

        def root(c):
            while c in joined:
                c = joined[c]
            return c

        first = own == own.min()
        one_block = bool(first.all())
        left, right = (np.arange(len(rows)),) * 2 if one_block else (np.flatnonzero(first), np.flatnonzero(~first))
        for i, at in _merge(sig, left, right, matches):
            if one_block:
                at = at[at > i]
            at = at[(comp[at] != comp[i]) & (100 * np.minimum(n[at], n[i]) >= LEAST * np.maximum(n[at], n[i]))]
            # a pair is looked at in the first of the lists that it shares
            at = at[((sig[at] == sig[i]) & under[at] & under[i]).argmax(axis=1) == token >> 32]
            if not len(at):
                continue
            like, exact = _alike(least[i], n[i], padded[at], n[at], errors)
            for k, sure in zip(at[like].tolist(), exact[like].tolist(), strict=True):
                a, b = root(comp[i]), root(comp[k])
                if a != b:
                    if sure:
                        joined[max(a, b)] = min(a, b)
                    yield min(cls[i], cls[k]), max(cls[i], cls[k])

    def run(batches):
        key, rows = None, []

        def done(key, rows):
            found = list(compare(key[0], rows)) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(map(int, x)), pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for k, row in zip(zip(*cols[:3], strict=True), zip(*cols[3:], strict=True), strict=True):
                if k != key:
                    yield from done(key, rows)
                    key, rows = k, []
                rows.append(row)
        yield from done(key, rows)
        release()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_KEYS else df


def _classes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """base, and its classes: class, doc_id and content of one row, n_shingles, signature, sketch."""
    while True:
        same = base.where("class is not null").groupBy("class").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "content")).alias("c"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"),
            (F.min("check") < F.max("check")).alias("mixed"),
        )
        same = materialize(same.select("class", F.col("c.doc_id").alias("doc_id"), F.col("c.content").alias("content"), "n_shingles", "signature", "sketch", "mixed"))
        mixed = same.where("mixed").select("class", "mixed")
        n = mixed.count()
        if not n:
            return base, same.drop("mixed")
        marked = base.join(_few(mixed, n), "class", "left")
        renamed = materialize(marked.withColumn("class", F.when(F.col("mixed"), F.xxhash64("class", "check")).otherwise(F.col("class"))).select(*base.columns))
        discard(base, same)
        base = renamed


def _thinned(lists: DataFrame, docs: DataFrame, classes: DataFrame, k: int, block: int) -> DataFrame:
    """lists (token, posted, class, component) without members of long lists that can't be like any other of those."""
    long = materialize(lists.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where((F.col("n") > block) & (F.col("lo") != F.col("hi"))).select("token"))
    n = long.count()
    if not n:
        return lists
    hot = lists.join(_few(long, n), "token", "left_semi")
    crowd = hot.select("class").distinct()

    def run(batches):
        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(t.as_py(), k).view(np.int64)
                for at in range(0, len(s), 50_000):
                    part = pa.array(s[at : at + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c)), part], names=["class", "shingle"])
        release()

    held = _texts_of(docs, classes, crowd).mapInArrow(run, "class bigint, shingle bigint")
    own = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1").groupBy("class").agg(F.count("*").alias("own"))
    apart = materialize(own.join(classes.select("class", "n_shingles"), "class").where(100 * (F.col("n_shingles") - F.col("own")) < LEAST * F.col("n_shingles")).select("class"))
    return lists.join(_few(long, n), "token", "left_anti").unionByName(hot.join(_few(apart, apart.count()), "class", "left_anti"))


def group(docs: DataFrame, k: int = WORDS, block: int = BLOCK, matches: int = MATCHES, errors: float = ERRORS) -> DataFrame:
    """doc_id, content, n_shingles, component (a long, null without shingles), component_id, confirmed_links (of its class, not all it has)."""
    # all that runs in Python is written before this returns
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _group(docs, k, block, matches, errors)


def _group(docs: DataFrame, k: int, block: int, matches: int, errors: float) -> DataFrame:
    base, classes = _classes(materialize(_sketch(docs, k)))
    tokens = _tokens(classes)
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    kept = COORDINATES - matches + 1
    ordered = tokens.join(shared, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).where(F.size("t") >= matches)
    # tokens of one class alone are the rarest, and fill the prefix first
    prefix = F.slice("t", 1, F.lit(kept - COORDINATES) + F.size("t"))
    posted = F.aggregate(prefix, F.lit(0).cast("bigint"), lambda a, t: a + F.pow(F.lit(2), F.floor(t.token / 2**32)).cast("bigint"))
    posts = materialize(ordered.select("class", posted.alias("posted"), F.explode(prefix).alias("t")).select(F.col("t.token").alias("token"), "posted", "class"))
    hubs = posts.groupBy("token").agg(F.min("class").alias("a"))
    stars = posts.join(hubs, "token").where("class <> a").select("a", F.col("class").alias("b")).distinct()
    first = materialize(_count_matches(stars, classes, matches))
    texts = materialize(_texts(docs, classes, first))
    links = materialize(_confirm(first, texts, k))
    labels = materialize(components(links))
    placed = materialize(posts.join(labels.withColumnRenamed("id", "class"), "class", "left").select("token", "posted", "class", F.coalesce("component", "class").alias("component")))
    lists = _thinned(placed, docs, classes, k, block).join(classes.select("class", F.col("n_shingles").alias("n"), "signature", "sketch"), "class")
    second = materialize(_across(lists, matches, block, errors).join(first, ["a", "b"], "left_anti").join(first.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more_texts = materialize(_texts(docs, classes, second))
        links = materialize(links.unionByName(_confirm(second, more_texts, k)))
        labels = materialize(components(links))
        discard(more_texts)
    discard(texts, posts, placed, second, first)
    degree = links.select("a", "b").unionByName(links.select("b", "a").toDF("a", "b")).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "class")
    of = classes.select("class", "doc_id").join(labels.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
    of = of.select("class", "doc_id", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0)).alias("confirmed_links"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = of.drop("doc_id").join(least, "component")
    out = base.select("doc_id", "content", "n_shingles", "class").join(of, "class", "left")
    return out.select("doc_id", "content", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("confirmed_links", F.lit(0)).alias("confirmed_links"))


def _tokens(classes: DataFrame) -> DataFrame:
    """class, token: a row for each coordinate."""
    digits = F.hex("signature")
    value = lambda i: F.conv(F.substr(digits, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint") + i.cast("bigint") * 2**32
    return classes.select("class", F.explode(F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), value)).alias("token"))


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """class, text of the classes in pairs."""
    return _texts_of(docs, classes, pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct())


def _texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """class, text of the classes in ids."""
    wanted = materialize(classes.select("class", F.col("doc_id").alias("d2"), F.col("content").alias("c2")).join(ids, "class"))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _content(F.col("text")).alias("content"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = d.join(_few(wanted, wanted.count()), (F.col("content") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("d2")))
    # rows may repeat
    return found.select("class", "text").dropDuplicates(["class"])


def one_of_each(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """docs with one row of each component, that of the least doc_id; rows without shingles all stay. Columns unchanged."""
    g = group(docs, k)
    rows = g.groupBy("doc_id", "content").agg(F.count("*").alias("times"), F.first("component").alias("component"))
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "content")
    best = rows.where("component is not null").groupBy("component").agg(F.min(rank).alias("best"))
    marked = rows.join(best, "component", "left")
    mine = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.content") == F.col("content"))
    state = materialize(marked.where(F.col("component").isNotNull() & (~mine | (F.col("times") > 1))).select(F.col("doc_id").alias("d2"), F.col("content").alias("c2"), mine.alias("stays")))
    keyed = docs.withColumn("c1_", _content(F.col("text")))
    same = (F.col("c1_") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("d2"))
    n = state.count()
    clean = keyed.join(_few(state, n), same, "left_anti").select(*docs.columns)
    repeated = state.where("stays")
    if repeated.isEmpty():
        return clean
    once = keyed.join(_few(repeated, n), same).dropDuplicates(["d2", "c2"]).select(*docs.columns)
    return clean.unionByName(once)


def op1_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = group(table(spark, sf_dir, "documents"))
    return g.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "confirmed_links")


def _sets(rows: list[tuple]) -> dict:
    import re

    sets = {}
    for d, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + WORDS]) for i in range(max(len(w) - WORDS + 1, 1))} if w else set()
    return sets


def brute_pairs(rows: list[tuple]) -> dict:
    """i to the similarity of the texts 2i and 2i + 1."""
    sets = _sets(rows)
    return {i: len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(len(rows) // 2)}


def brute(rows: list[tuple]) -> dict:
    """doc_id to (n_shingles, component_id, kept) from rows (doc_id, text) with distinct ids."""
    sets = _sets(rows)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= LEAST * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= LEAST * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
