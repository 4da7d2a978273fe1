"""Mixing sources to target weights by a low-discrepancy schedule.

Target words of a source are weight shares of all words, held to REPEATS times the source's own. A schedule has a
slot for each block of equal length: points of a golden-ratio sequence are mapped through the cumulative targets to
sources, and a source's slots are ranked. The documents of a source, shuffled by a hash, form a stream of words that
repeats; slot r of the source takes words r * block to (r + 1) * block of it. Slots beyond the source's target are
cut off, and missing ones are appended, so that each source's words are its target's whole part.

Prefix sums are taken within hash buckets first, so that a source with most of the rows is summed in many tasks.
Edge cases: null or empty text has size 0 and takes nothing; a null source is the last source; repeated doc_ids are
rows of their own; a table without words has targets 0; an empty table gives an empty result; further columns are
ignored by the query and kept by mix(). Ties: of sources whose limits per weight are equal the first comes first, which changes no
target; of documents with equal hashes the one of the least doc_id, then size, then place in the table. Whole texts are
counted, whatever their length, and a text's words may be spread over many slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 256
SEED = 20
#: Rows of a bucket, about, and slots of a segment. Parts are many, so that those of a source with most rows spread evenly.
_BUCKET_ROWS, _SEGMENT = 512, 65_536
#: Cells of the unit interval by which points find their source.
_CELLS = 4096
#: A golden-ratio step of 2 ** 31: 0.618... * 2 ** 31, odd.
_STEP, _RING = 1327217885, 2**31


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sid, source, source_size, target, low, high: targets in words, and each source's interval of the unit interval.

    Sharing the excess again until no source is above its limit gives min(limit, level * weight) for the level at which
    all targets sum to all words: the largest of the levels that hold if just the sources with the least limit per weight
    are at their limits. The windows here run over one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)).withColumn("limit", repeats * F.col("source_size"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before, on = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(on)).withColumn("level", F.max("level").over(everything))
    s = s.withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
    s = s.withColumn("all", F.sum("target").over(everything))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    # rounding may leave the last interval's end below 1
    last = F.max(F.when(F.col("target") > 0, F.col("sid"))).over(everything)
    s = s.withColumn("high", F.when(F.col("sid") >= last, 1.0).when(F.col("all") > 0, F.sum("target").over(upto) / F.col("all")).otherwise(0.0))
    return s.select("sid", "source", "source_size", "target", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)).alias("low"), "high")


def _running(df: DataFrame, keys: list[str], part: Column, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows before by keys, part, order: sums of parts first, then within parts."""
    df = df.withColumn("part_", part).withColumn("value_", value)
    sums = df.groupBy(*keys, "part_").agg(F.sum("value_").alias("sum_"))
    earlier = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "part_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("offset_"))
    inside = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("inside_", F.coalesce(F.sum("value_").over(inside), F.lit(0))).join(offsets, [*keys, "part_"])
    return out.withColumn(name, F.col("offset_") + F.col("inside_")).drop("part_", "value_", "offset_", "inside_")


def schedule(sources: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """slot, sid, rank, first (word of the repeated stream), length."""
    spark = sources.sparkSession
    slots = -(-total // block)
    point = (F.col("id") % _RING * _STEP + _RING // 2) % _RING / F.lit(float(_RING))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * _CELLS))
    cells = sources.where("high > low").select("sid", "low", "high", "target", F.explode(F.sequence(F.floor(F.col("low") * _CELLS), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1)))).alias("cell"))
    found = points.join(cells, "cell").where("x >= low and x < high")
    ranked = _running(found.select("slot", "sid", "target"), ["sid"], F.floor(F.col("slot") / _SEGMENT), ["slot"], F.lit(1), "rank")
    whole = F.floor("target").cast("bigint")
    kept = ranked.where(F.col("rank") * block < whole).select("slot", "sid", "rank", "target")
    have = ranked.groupBy("sid").agg(F.max("rank").alias("top"))
    missing = sources.join(have, "sid", "left").select("sid", "target", (F.coalesce("top", F.lit(-1)) + 1).alias("next"), F.ceil(F.floor("target") / block).alias("need")).where("next < need")
    more = missing.select(F.explode(F.sequence("next", F.col("need") - 1)).alias("rank"), "sid", "target")
    more = more.select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank", "target")
    return kept.unionByName(more).select("slot", "sid", "rank", (F.col("rank") * block).alias("first"), F.least(F.lit(block), whole - F.col("rank") * block).alias("length"))


def _clip(df: DataFrame, start: str, end: str, block: int, low: str, high: str) -> DataFrame:
    """A row for each block-long cell of the stream that start to end touches, with what lies in it."""
    df = df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(end) - 1) / block))))
    return df.withColumn(low, F.greatest(F.col(start), F.col("cell") * block)).withColumn(high, F.least(F.col(end), (F.col("cell") + 1) * block))


def mixture(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, row, from_word, words: the parts of documents that slots take. sizes has row, doc_id, source, size."""
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = min(max(math.ceil(math.log2(max(n, 1) / _BUCKET_ROWS + 1)), 4), 24)
    ids = sources.select(F.col("source").alias("s2"), "sid", "source_size")
    d = sizes.where("size > 0")
    d = d.join(ids, d.source.eqNullSafe(ids.s2)).withColumn("shuffled", F.xxhash64(F.col("doc_id"), F.lit(SEED)))
    d = _running(d.select("row", "doc_id", "sid", "size", "shuffled"), ["sid"], F.call_function("shiftrightunsigned", F.col("shuffled"), F.lit(64 - bits)), ["shuffled", "doc_id", "size", "row"], F.col("size"), "start")
    d = _clip(d.withColumn("end", F.col("start") + F.col("size")), "start", "end", block, "d0", "d1").select("sid", "cell", "row", "start", "d0", "d1")
    slots = schedule(sources, total, block).join(sources.select("sid", "source_size"), "sid")
    rounds = F.sequence(F.floor(F.col("first") / F.col("source_size")), F.floor((F.col("first") + F.col("length") - 1) / F.col("source_size")))
    t = slots.withColumn("round", F.explode(rounds))
    begin = F.col("round") * F.col("source_size")
    t = t.withColumn("a", F.greatest(F.col("first"), begin) - begin).withColumn("b", F.least(F.col("first") + F.col("length"), begin + F.col("source_size")) - begin)
    t = _clip(t, "a", "b", block, "t0", "t1").select("slot", "sid", "cell", "t0", "t1")
    low, high = F.greatest("d0", "t0"), F.least("d1", "t1")
    return d.join(t, ["sid", "cell"]).where(high > low).select("slot", "row", (low - F.col("start")).alias("from_word"), (high - low).alias("words"))


def plan(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sizes (row, doc_id, source, size), targets, mixture."""
    sizes = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    sizes = materialize(sizes.withColumn("row", F.monotonically_increasing_id()))
    sources = materialize(targets(sizes))
    return sizes, sources, mixture(sizes, sources, block)


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; a row for each row of docs."""
    return _taken(*plan(docs, block))


def _taken(sizes: DataFrame, sources: DataFrame, parts: DataFrame) -> DataFrame:
    took = parts.groupBy("row").agg(F.sum("words").alias("taken"))
    ids = sources.select(F.col("source").alias("s2"), "source_size", "target")
    out = sizes.join(ids, sizes.source.eqNullSafe(ids.s2)).join(took, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).drop("source")


def brute_targets(by_source: dict) -> dict:
    """Source to target, by sharing the excess again until no source is above its limit."""
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    total, limited = sum(by_source.values()), set()
    while True:
        free = [s for s in order if s not in limited]
        rest = total - sum(REPEATS * by_source[s] for s in limited)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > REPEATS * by_source[s]}
        if not over:
            return {s: share.get(s, REPEATS * by_source[s]) for s in order}
        limited |= over


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them: a row for each whole time that a document is taken, and one for a rest of half a document or more.

    Rows that the mix doesn't take go; rows without words, which take no part in it, stay once. Columns unchanged.
    """
    sizes, sources, parts = plan(docs, block)
    t = _taken(sizes, sources, parts).where("size > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    # rows alike in these share what they take
    t = t.select(F.col("doc_id").alias("d2"), F.col("source").alias("s2"), F.col("size").alias("z2"), F.floor((2 * F.col("taken") / F.col("rows") + F.col("size")) / (2 * F.col("size"))).cast("int").alias("times"))
    t = materialize(t)
    discard(sizes, sources)
    keyed = docs.withColumn("z1_", size_of(F.col("text")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("d2")) & F.col("source").cast("string").eqNullSafe(F.col("s2")) & (F.col("z1_") == F.col("z2"))
    joined = keyed.join(t, same, "left")
    times = F.when(F.col("z1_") == 0, 1).otherwise(F.coalesce("times", F.lit(0)))
    return joined.where(times > 0).withColumn("copy_", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
