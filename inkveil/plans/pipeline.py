"""The whole run: detect, mask, verify, certify; what can't be verified gets no certificate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled
from ..operators.detect import DetectOptions, with_matches
from ..operators.mask import masked
from ..operators.review import search_matches, union_matches
from ..operators.verify import certify, text_removal


def redact(documents: DataFrame, opts: DetectOptions | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, matches, masked, checks of text documents, in one projection.

    extra: strings that are masked wherever they occur, besides what is detected; they are matches too.
    """
    found = with_matches(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), opts)
    out = found.withColumn("matches", union_matches(F.col("matches"), search_matches(F.col("text"), extra))) if extra else found
    out = settled(out, "matches") if extra else out
    out = out.withColumn("masked", masked(F.col("text"), F.col("matches")))
    secrets = F.array_distinct(F.transform("matches", lambda m: m.text))
    return settled(out.withColumn("checks", F.array(text_removal(secrets, F.col("masked")))), "masked", "checks")


def certificates(redacted: DataFrame) -> DataFrame:
    """doc_id, certificate of the documents that have something masked and passed."""
    rows = redacted.where(F.size("matches") > 0).select(
        "doc_id", F.col("text").alias("input"), F.col("masked").alias("output"), F.lit(1).alias("input_pages"), F.lit(1).alias("output_pages"),
        F.transform("matches", lambda m: F.struct(F.lit(0).alias("page_index"), m.category.alias("category"), m.confidence.cast("double").alias("confidence"), m.text.alias("text"))).alias("redactions"), "checks",
    )
    return certify(rows)
