"""URL filters: longest-suffix rules, and exact set membership by a cascade of Bloom filters.

Level 1 of a cascade encodes the listed keys; level 2 those keys of the universe that level 1 takes for listed;
level 3 the listed keys that level 2 takes for unlisted; and so on, until a level errs on no key. Over the universe
a probe is then exact. A level is an array of 64-bit words for each shard of keys. A list of one shard is probed by
scalar subqueries, without any join; with more, keys are dealt by shard and meet their shard's one row of words, so that
no task and not the driver holds more than a shard (about 1 MB for each level), whatever the list's size. A shard's
keys are dealt to SALTS tasks, so that a frequent key doesn't meet one task.

Edge cases: a url that is null or lacks "://" has an empty host and path; a null key is in no list; repeated keys
count once; an empty list or universe gives a cascade that holds nothing; of rules of equal length that fit, the one whose text and
then verdict is greatest wins; whole urls are read, whatever their length; rows keep their multiplicity and further
columns with other names are kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import ascii_lower, discard, materialize, table

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share of false positives of each level.
ERROR = 0.02
#: Keys of a shard, about: a level has 1 MB for a million.
SHARD_KEYS = 1_000_000
#: Tasks that a shard's probes are dealt to.
SALTS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits))


class Cascade:
    """Membership in `listed`, exact for every key of `universe`. Both have one column, key."""

    def __init__(self, listed: DataFrame, universe: DataFrame, error: float = ERROR, shard_keys: int = SHARD_KEYS):
        self.listed = materialize(listed.where("key is not null").distinct())
        n = self.listed.count()
        self.shards = max(1, math.ceil(n / shard_keys))
        self.levels: list[tuple[int, int, DataFrame]] = []  # bits of a shard, probes, rows of (shard, words)
        others = materialize(universe.where("key is not null").distinct().join(self.listed, "key", "left_anti"))
        mine = self.listed
        while n:
            self.levels.append(self._level(mine, n, error))
            wrong = materialize(self._probed(others, "key", [len(self.levels) - 1], "wrong_").where("wrong_").select("key"))
            if others is not self.listed:
                discard(others)
            mine, others = wrong, mine
            n = mine.count()
        for df in (mine, others):
            if df is not self.listed:
                discard(df)

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards))

    def _level(self, keys: DataFrame, n: int, error: float) -> tuple[int, int, DataFrame]:
        words = max(1, math.ceil(n / self.shards * -math.log(error) / math.log(2) ** 2 / 64))
        bits, probes = 64 * words, max(1, round(-math.log2(error)))
        at = F.explode(F.array(*self._positions(F.col("key"), len(self.levels), bits, probes))).alias("at")
        set_ = keys.select(self._shard(F.col("key")).alias("shard"), at).groupBy("shard", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        ids = keys.sparkSession.range(self.shards * words).select(F.floor(F.col("id") / words).alias("shard"), F.pmod("id", F.lit(words)).alias("word"))
        whole = ids.join(set_, ["shard", "word"], "left")
        rows = whole.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("words"))
        return bits, probes, materialize(rows.select("shard", F.col("words.bits").alias("words")))

    @staticmethod
    def _positions(key: Column, level: int, bits: int, probes: int) -> list[Column]:
        first, step = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
        return [(first + j * step) % bits for j in range(probes)]

    def _has(self, level: int, key: Column, words: Column) -> Column:
        bits, probes, _ = self.levels[level]
        hit = [F.call_function("shiftrightunsigned", F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for at in self._positions(key, level, bits, probes)]
        return reduce(Column.__and__, hit)

    def _probed(self, df: DataFrame, key: str, levels: list[int], name: str) -> DataFrame:
        """df with a boolean column: what a walk down the levels says of the key."""

        def walk(words: list[Column]) -> Column:
            # an even level that lacks a key says that it isn't listed, an odd one that it is
            out = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                out = F.when(~self._has(levels[i], F.col(key), words[i]), F.lit(i % 2 == 1)).otherwise(out)
            return F.coalesce(F.col(key).isNotNull() & out, F.lit(False))

        if self.shards == 1:
            return df.withColumn(name, walk([self.levels[i][2].select("words").scalar() for i in levels]))
        salt = F.pmod(F.xxhash64(*(F.col(f.name) for f in df.schema if isinstance(f.dataType, AtomicType))), F.lit(SALTS))
        out = df.withColumn("shard_", self._shard(F.col(key))).withColumn("salt_", salt)
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt_")
        for i in levels:
            out = out.join(self.levels[i][2].select(F.col("shard").alias("shard_"), salts, F.col("words").alias(f"words{i}_")).hint("merge"), ["shard_", "salt_"], "left")
        return out.withColumn(name, walk([F.col(f"words{i}_") for i in levels])).select(*df.columns, name)

    def flag(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a boolean column: whether its key, one of the universe, is listed."""
        return self._probed(df, key, list(range(len(self.levels))), name)

    def discard(self) -> None:
        discard(self.listed, *(x[2] for x in self.levels))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. Where no rule fits, a page is blocked if its path is listed: if a rule blocks the same path on another host."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("won", longest_rule(F.col("host"), F.col("path"), rules))
    paths = seen.select(F.col("path").alias("key"), F.col("won.verdict").alias("verdict"))
    cascade = Cascade(paths.where("verdict = 'block'").select("key"), paths.select("key"))
    flagged = cascade.flag(seen, "path", "listed")
    return flagged.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op6_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT page_id, host, path,
  CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN path IN (SELECT path FROM q WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')) THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""
