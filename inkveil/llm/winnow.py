"""Document fingerprints by winnowing, in column expressions alone.

Tokens are words in lower case, cut after LONGEST characters; a character of a script without spaces is a token of its own. Each
token is hashed once, and the hash of a run of GRAM tokens is the rolling cyclic polynomial of theirs: the exclusive or of
the tokens' hashes, each turned by its distance from the run's end. Runs of one, two and four tokens are joined to runs of GRAM,
so that no run is hashed anew. Of each WINDOW consecutive hashes the least is chosen, the rightmost
one on a tie, and kept with its position. Two texts that share GRAM + WINDOW - 1 consecutive tokens share a fingerprint
of them. Hash and position are packed into one long, hash first, so that the least long is the choice; minima over
windows come from three halving steps and not from a scan of each window.

Edge cases: null text counts as empty, and a text without words has no fingerprint; fewer tokens than GRAM are one run, so a
text below GRAM + WINDOW tokens has one fingerprint; whole texts are read, whatever their length;
fewer hashes than WINDOW are one window; two texts without fingerprints are alike (1.0), one without and one with are
not (0.0). Rows are ordered by descending doc_id, null ones last, and by text where ids repeat; the row after the last
is the first, so a single row follows itself. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

GRAM = 5
#: Characters of a token at most.
LONGEST = 16
#: Scripts that are written without spaces.
_SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_TOKEN = rf"[{_SPACELESS}]|[^ \t-\r{_SPACELESS}]{{1,{LONGEST}}}"
#: A power of two.
WINDOW = 8
_PLACES = 2**31 - 1
#: Bits of the ids of a bucket; within a bucket rows are sorted together. Null ids are in the lowest bucket.
_SPAN = 8
_LOWEST = -(2**63)


def _shifted(c: str, by: int) -> Column:
    return F.slice(c, by + 1, F.size(c))


def _turned(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(64 - by)))


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with an array of longs: the chosen hashes (upper 32 bits) and their places, in the order of places.

    Each step is a projection of its own, for otherwise the arrays would be computed anew wherever they are named.
    """
    rest = df.columns
    w, g = f"{name}_w", f"{name}_g"
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_TOKEN), F.lit(0))
    df = df.withColumn(w, F.transform(tokens, lambda x: F.xxhash64(x)))
    # runs of 1, 2 and 4 tokens make one of GRAM, or of all tokens where there are fewer
    two, four, runs = f"{name}_2", f"{name}_4", f"{name}_5"
    df = df.withColumn(two, F.zip_with(w, _shifted(w, 1), lambda a, b: _turned(a, 1).bitwiseXOR(b)))
    df = df.withColumn(four, F.zip_with(two, _shifted(two, 2), lambda a, b: _turned(a, 2).bitwiseXOR(b)))
    df = df.withColumn(runs, F.zip_with(four, _shifted(w, 4), lambda a, b: _turned(a, 1).bitwiseXOR(b)))
    short = F.aggregate(F.slice(w, F.lit(1), F.lit(GRAM)), F.lit(0).cast("bigint"), lambda a, x: _turned(a, 1).bitwiseXOR(x))
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - (GRAM - 1), F.lit(1)))
    hashed = F.when(F.size(w) < GRAM, F.array(short)).otherwise(F.slice(runs, F.lit(1), F.size(at)))
    packed = F.zip_with(hashed, at, lambda h, i: F.shiftleft(F.call_function("shiftrightunsigned", F.xxhash64(h), F.lit(32)), 31).bitwiseOR(F.lit(_PLACES) - i))
    df = df.withColumn(g, F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(packed)).drop(w, two, four, runs)
    count = f"{name}_n"
    df = df.withColumn(count, F.size(g))
    step = 1
    while step < WINDOW:
        df = df.withColumn(g, F.zip_with(g, _shifted(g, step), lambda a, b: F.least(a, b)))
        step *= 2
    windows = F.greatest(F.col(count) - (WINDOW - 1), F.least(F.col(count), F.lit(1)))
    return df.withColumn(name, F.array_distinct(F.slice(g, F.lit(1), windows))).select(*rest, name)


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def written(fingerprint: str) -> Column:
    """hash:place, comma-joined; hashes in hexadecimal, places from 0."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(_PLACES - 1) - x.bitwiseAND(F.lit(_PLACES))).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def _bucket(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id.cast("bigint"), _SPAN), F.lit(_LOWEST))


#: Bits of the buckets' numbers in a group of buckets.
_GROUP = 10


def _levels(docs: DataFrame) -> int:
    """How often buckets have to be grouped until at most 2^_GROUP groups are left, by the range of the ids."""
    low, high = docs.agg(F.min(_bucket(F.col("doc_id"))), F.max(_bucket(F.col("doc_id")))).first()
    bits = 0 if low is None else (high - low).bit_length()
    return max(0, -(-bits // _GROUP) - 1)


def _next_bucket(buckets: DataFrame, levels: int) -> DataFrame:
    """bucket, following: the next lower one; of the lowest, the highest. Sorted in groups, then over the groups' ends.

    After `levels` groupings the ends of at most 2^_GROUP + 1 groups are left, whatever the ids: only those meet in one task.
    """
    down = F.col("bucket").desc()
    if not levels:
        ring = F.first("bucket").over(Window.orderBy(down).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return buckets.select("bucket", F.coalesce(F.lead("bucket").over(Window.orderBy(down)), ring).alias("following"))
    over = Window.partitionBy("group").orderBy(down)
    b = buckets.withColumn("group", F.shiftright("bucket", _GROUP))
    b = b.select("group", "bucket", F.lead("bucket").over(over).alias("inside"), F.first("bucket").over(over).alias("head"))
    heads = b.where("inside is null").select(F.col("group").alias("bucket"), "head")
    order = _next_bucket(heads.select("bucket"), levels - 1).select(F.col("bucket").alias("group"), F.col("following").alias("g3"))
    ends = order.join(heads.select(F.col("bucket").alias("g3"), F.col("head").alias("beyond")), "g3").select("group", "beyond")
    return b.join(ends, "group").select("bucket", F.coalesce("inside", "beyond").alias("following"))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, place (in the bucket), doc_id, text, next_text, tail (the last of its bucket), beyond (the fingerprint of the next bucket's first text).

    Rows are shuffled once, into buckets of neighbouring ids; the join and the windows after it keep that partitioning, and
    only each bucket's first text is moved again.
    """
    d = docs.select(_bucket(F.col("doc_id")).alias("bucket"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    over = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    a = d.select("*", F.lead("text").over(over).alias("next_text"), F.row_number().over(over).alias("place"))
    heads = add_fingerprint(a.where("place = 1").select(F.col("bucket").alias("following"), F.col("text").alias("head_text")), "head_text", "beyond")
    order = _next_bucket(docs.select(_bucket(F.col("doc_id")).alias("bucket")).distinct(), _levels(docs))
    joined = a.join(order.join(heads, "following").select("bucket", "head_text", "beyond"), "bucket")
    return joined.select("bucket", "place", "doc_id", "text", F.coalesce("next_text", "head_text").alias("next_text"), F.col("next_text").isNull().alias("tail"), "beyond")


def op2_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))).drop("next_text")
    d = add_fingerprint(add_fingerprint(d, "text", "fp"), "edited", "fe")
    d = d.select(
        "bucket", "place", "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "tail",
        written("fp").alias("fingerprint"), written("fe").alias("edited_fingerprint"), hashes("fp").alias("h"), hashes("fe").alias("he"),
        F.transform("beyond", lambda x: F.shiftright(x, 31)).alias("hb"),
    )
    over = Window.partitionBy("bucket").orderBy("place")
    d = d.withColumn("hn", F.when(F.col("tail"), F.array_distinct("hb")).otherwise(F.lead("h").over(over)))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("h", "he").alias("near_edited"), likeness("h", "hn").alias("near_next"))


def brute(rows: list[tuple]) -> list[tuple]:
    """From rows (doc_id, text) with distinct ids: doc_id, n_chars, edited text."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        m = len(t) // 3
        out.append((d, len(t), t[: len(t) - m] + nxt[:m]))
    return out


def brute_places(hashed: list[int]) -> list[int]:
    """Places that winnowing chooses among hashes, window by window."""
    out: list[int] = []
    for i in range(max(len(hashed) - WINDOW + 1, min(len(hashed), 1))):
        window = hashed[i : i + WINDOW]
        place = i + max(j for j, h in enumerate(window) if h == min(window))
        if not out or out[-1] != place:
            out.append(place)
    return out
