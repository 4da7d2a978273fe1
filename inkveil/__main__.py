"""Command line over Parquet documents (doc_id, text): detect, review, redact by reviewed findings, run, verify.

Exit codes: 0 well, 1 a check failed or the work was refused, 2 wrong use. A refused or failed run leaves no output.
"""

from __future__ import annotations

import argparse
import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.catalog import GROUPS
from .operators.detect import DetectOptions, detect
from .operators.review import Refused, redact_reviewed, require, text_findings
from .operators.verify import certificate_matches, sha256_hex, verify_text
from .plans.pipeline import certificates, redact


def number(low: float = -math.inf, high: float = math.inf, above: bool = False):
    """A parser of finite numbers in bounds; the lower one excluded if above."""

    def parse(value: str) -> float:
        x = float(value)
        if not (math.isfinite(x) and low <= x <= high and not (above and x == low)):
            raise argparse.ArgumentTypeError(f"a finite number {'above' if above else 'from'} {low}{'' if math.isinf(high) else f' to {high}'} is wanted, not {value!r}")
        return x

    return parse


share, scale, pad = number(0, 1), number(0, above=True), number(0)


def rectangle(value: str) -> tuple[int, tuple[float, float, float, float]]:
    """PAGE:X,Y,W,H."""
    page, colon, rest = value.partition(":")
    try:
        x, y, w, h = (float(v) for v in rest.split(","))
        if not (colon and page.isdecimal() and w > 0 and h > 0 and all(abs(v) <= 1e6 for v in (x, y, w, h))):
            raise ValueError
    except ValueError:
        raise argparse.ArgumentTypeError(f"PAGE:X,Y,W,H with finite numbers and an area is wanted, not {value!r}") from None
    return int(page), (x, y, w, h)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkveil")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("detect", "matches"), ("review", "findings files (doc_id, findings)"), ("run", "masked documents and certificates"), ("redact", "the same by reviewed findings")):
        c = sub.add_parser(name, help=help_)
        c.add_argument("input")
        c.add_argument("output")
        if name == "redact":
            c.add_argument("--findings", required=True, help="Parquet with doc_id and findings")
        else:
            c.add_argument("--min-confidence", type=share, default=0.35)
            c.add_argument("--categories", nargs="*", choices=sorted(GROUPS))
            c.add_argument("--aggressive", action="store_true")
        if name != "detect":
            c.add_argument("--text", action="append", default=[], help="a string to mask wherever it is")
    v = sub.add_parser("verify")
    v.add_argument("output", help="documents with doc_id and masked")
    v.add_argument("--string", action="append", default=[])
    v.add_argument("--certificates")
    return p


def canonical(spark: SparkSession, path: str) -> str:
    """A path as its file system names it: without dots and doubled slashes, with the scheme, and links of local files resolved."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(p).toUri().normalize()
    if uri.getScheme() == "file":
        return "file:" + jvm.java.io.File(uri.getPath()).getCanonicalPath()
    return uri.toString().rstrip("/")


def _written(out: DataFrame, path: str) -> int:
    """Write masked documents and their certificates; read both again, for a certificate holds for what is stored."""
    spark = out.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out.write.parquet(f"{path}/documents")
        done = spark.read.parquet(f"{path}/documents")
        require(done.where(~F.forall("checks", lambda c: c.passed)).select("doc_id"), "documents that failed a check")
        require(done.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated doc_id")
        certificates(done).write.parquet(f"{path}/certificates")
        stored = spark.read.parquet(f"{path}/certificates").join(spark.read.parquet(f"{path}/documents"), "doc_id")
        require(stored.where(~certificate_matches(F.col("certificate"), F.col("masked"))).select("doc_id"), "stored documents that differ from their certificates")
    except Refused:
        fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs, True)
        raise
    return 0


def _verify(spark: SparkSession, args: argparse.Namespace) -> int:
    out = spark.read.parquet(args.output).select("doc_id", "masked")
    secrets = out.select("doc_id", F.explode(F.array(*map(F.lit, args.string)).cast("array<string>")).alias("secret"))
    failed = verify_text(out, secrets).where("not passed").count()
    if args.certificates:
        # an output without certificate fails as one whose certificate differs, and so does a certificate without output
        given = spark.read.parquet(args.certificates).select(F.col("doc_id").alias("of_"), "certificate")
        joined = out.join(given, F.col("doc_id") == F.col("of_"), "full")
        failed += joined.where(F.col("of_").isNull() | F.col("doc_id").isNull() | ~F.coalesce(certificate_matches(F.col("certificate"), F.col("masked")), F.lit(False))).count()
    return int(failed > 0)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "verify":
        return _verify(spark, args)
    taken = [args.input, *([args.findings] if args.command == "redact" else [])]
    if canonical(spark, args.output) in [canonical(spark, t) for t in taken]:
        print("the output would take the input's place", file=sys.stderr)
        return 2
    documents = spark.read.parquet(args.input)
    try:
        if args.command == "redact":
            return _written(redact_reviewed(documents, spark.read.parquet(args.findings), tuple(args.text)), args.output)
        opts = DetectOptions(args.min_confidence, tuple(args.categories) if args.categories else None, args.aggressive)
        if args.command == "detect":
            detect(documents, opts).write.parquet(args.output)
            return 0
        if args.command == "review":
            text_findings(documents, opts, tuple(args.text)).write.parquet(args.output)
            return 0
        for t in args.text:
            require(documents.agg(F.max(F.coalesce(F.col("text").contains(t), F.lit(False))).alias("there")).where("not coalesce(there, false)").select(sha256_hex(F.lit(t))), "strings that lie nowhere, by their SHA-256")
        return _written(redact(documents, opts, tuple(args.text)), args.output)
    except Refused as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
