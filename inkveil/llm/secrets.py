"""Secret scans over an incremental ledger of blobs.

Versions of texts are named by the SHA-256 of their content. A rule belongs to the rule version that brought it, and a ledger
has an entry for each pair of blob and rule version: the spans that the rules of that version found. A scan looks at each
blob once, and only for the rule versions that the blob has no entry for; findings are joined back to all rows that hold
the blob. The ledger's findings are broadcast up to MOST_HITS blobs; beyond, rows and findings are dealt by blob and salt,
so that copies of one text, with findings or without, don't meet in one task.

Edge cases: null text counts as empty; equal texts share one blob and one scan, whatever their number; whole texts are
scanned, and time is linear in a text's length and findings; spans that start together are in the order of RULES; rows and
further columns of the input are kept; an empty table gives an empty result and ledger; offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from inkveil.functions.text import settled
from inkveil.operators.detect import candidates

from .common import discard, materialize, table

#: kind, pattern, group whose length counts, least length, rule version. The first three are the base kinds.
RULES = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 1),
    ("hex", r"[0-9a-f]+", 0, 24, 1),
    ("token", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ)[A-Za-z0-9_.-]+", 0, 24, 2),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 2),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = 2
#: Blobs with findings that a broadcast holds at most, a few hundred bytes each; salts of a blob beyond.
MOST_HITS, SALTS = 200_000, 16
#: Every finding of every rule needs a match of this.
_NEEDED = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|-----BEGIN "

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version int, spans {SPAN}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _spans(text: str, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches that are long enough; what fails still uses up its text."""
    long = F.filter(candidates(text, pattern), lambda m: F.length(F.regexp_extract(m.raw, pattern, group)) >= least)
    return F.transform(long, lambda m: F.struct(m.chars.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m.chars + F.length(m.raw)).alias("end")))


def _found(text: str, rule_version: int) -> Column:
    """The spans of a version's rules, sorted by start, then kind in the order of RULES; null text isn't scanned."""
    rules = [_spans(text, i, *rule) for i, (*rule, version) in enumerate(RULES) if version == rule_version]
    none = F.array().cast(SPAN)
    return F.when(F.col(text).rlike(_NEEDED), F.array_sort(F.concat(none, *rules))).otherwise(none).cast(SPAN)


def unseen(docs: DataFrame, ledger: DataFrame | None, rule_version: int = RULE_VERSION) -> DataFrame:
    """blob, text, versions: each content once, with the rule versions up to the given one that it has no entry for."""
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*map(F.lit, range(1, rule_version + 1)))
    if ledger is None:
        return blobs.withColumn("versions", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<int>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", missing.alias("versions")).where(F.size("versions") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger with entries for all contents of docs and all rule versions up to the given one."""
    new = unseen(docs, ledger, rule_version)
    entry = lambda v: F.when(F.array_contains("versions", v), F.struct(F.lit(v).alias("rule_version"), _found("text", v).alias("spans")))
    new = settled(new.select("blob", F.array_compact(F.array(*map(entry, range(1, rule_version + 1)))).alias("entries")), "entries")
    new = new.select("blob", F.explode("entries").alias("e")).select("blob", "e.rule_version", "e.spans")
    return new if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(new)


def findings(docs: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION, name: str = "spans") -> DataFrame:
    """docs with the spans of their contents, by the rules of all versions up to the given one."""
    hits = ledger.where((F.col("rule_version") <= rule_version) & (F.size("spans") > 0)).groupBy(F.col("blob").alias("blob_")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(name))
    keyed = docs.withColumn("key_", blob_of(F.col("text")))
    if hits.count() <= MOST_HITS:
        out = keyed.join(F.broadcast(hits), F.col("key_") == F.col("blob_"), "left")
    else:
        plain = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType)]
        salted = keyed.withColumn("salt_", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
        spread = hits.withColumn("salt2_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        out = salted.join(spread, (F.col("key_") == F.col("blob_")) & (F.col("salt_") == F.col("salt2_")), "left").drop("salt_", "salt2_")
    return out.drop("key_", "blob_").withColumn(name, F.coalesce(name, F.array().cast(SPAN)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def without_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs with each secret replaced by [kind]; overlapping spans are replaced together, named by the first. Columns unchanged."""
    entries = materialize(scan(docs, ledger))
    marked = findings(docs, entries, name="spans_")
    merged = F.aggregate(
        "spans_",
        F.array().cast(SPAN),
        lambda a, s: F.when((F.size(a) > 0) & (s.start < F.element_at(a, -1).end), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1).start.alias("start"), F.element_at(a, -1)["rank"].alias("rank"), F.element_at(a, -1).kind.alias("kind"), F.greatest(F.element_at(a, -1).end, s.end).alias("end"))))).otherwise(F.concat(a, F.array(s))),
    )
    redacted = F.aggregate(
        merged,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a.out, F.substr("text", a["at"] + 1, s.start - a["at"]), F.lit("["), s.kind, F.lit("]")).alias("out"), s.end.alias("at")),
        lambda a: F.concat(a.out, F.substr("text", a["at"] + 1, F.length("text"))),
    )
    return marked.withColumn("text", F.when(F.size("spans_") > 0, redacted).otherwise(F.col("text"))).select(*docs.columns)


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the corpus's history: an earlier snapshot, half of the contents by their hash, under the first rule version;
    then all documents under the present one, of which only unseen pairs are scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = materialize(scan(docs.where(F.substring(blob_of(F.col("text")), 1, 1) < "8"), rule_version=1))
    ledger = materialize(scan(docs, earlier))
    discard(earlier)
    out = findings(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def brute(text: str | None) -> tuple[list, list]:
    """Base spans and all spans as kind:start:end, by Python's re."""
    import re

    found = []
    for rank, (kind, pattern, group, least, _) in enumerate(RULES):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    found.sort()
    return [x[2] for x in found if x[1] < 3], [x[2] for x in found]
