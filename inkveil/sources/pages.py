"""Sources and sinks: pages, files, findings and certificates.

Parsing a PDF and recognising characters are contracts: whoever has a parser gives rows of PAGE. What needs no parser
is here: raw files with their hashes, text documents as pages of one, JSON in and out.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import settled, sums_before
from ..operators import findings as findings_
from ..operators.geometry import SPAN
from ..operators.verify import certificate_errors, check_pdf, is_encrypted, metadata_snapshot

PAGE = f"doc_id string, page_index int, text string, spans array<{SPAN}>, width float, height float"


class PageSource(Protocol):
    """What a parser or a recogniser provides."""

    def pages(self, spark: SparkSession, path: str) -> DataFrame:
        """Rows of PAGE; one for each page of each file."""
        ...


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content, sha256 of raw files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def opened(files_: DataFrame) -> DataFrame:
    """files with error ("encrypted", "not-pdf" or null) and the information strings; what has an error is not to be read on."""

    @F.pandas_udf("struct<error:string,info:map<string,string>>")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for b in content:
            error = "not-pdf" if b"%PDF-" not in b[:1024] else "encrypted" if is_encrypted(b) else None
            rows.append((error, metadata_snapshot(b)))
        return pd.DataFrame(rows, columns=["error", "info"])

    return files_.withColumn("o_", run("content")).select(*files_.columns, "o_.error", "o_.info")


def text_pages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without geometry as one page each."""
    return documents.select(F.col(key).cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.col(text).alias("text"), F.array().cast(f"array<{SPAN}>").alias("spans"), F.lit(0.0).cast("float").alias("width"), F.lit(0.0).cast("float").alias("height"))


def layer_lengths(pages: DataFrame) -> DataFrame:
    """doc_id, chars: code points of all pages."""
    return pages.groupBy("doc_id").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"))


def recognised_text(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, text, spans of recognised lines (doc_id, page_index, line, words array<struct<text, rect>>).

    Words and lines are joined by one space; lines of one character or less are noise and dropped. Each word is a span.
    """
    loud = lines.where(F.char_length(F.array_join(F.transform("words", lambda w: w.text), " ")) > 1)
    pages = loud.groupBy("doc_id", "page_index").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", "words"))), lambda x: x.words)).alias("words"))
    pages = settled(pages.withColumn("at_", sums_before(F.transform("words", lambda w: F.octet_length(w.text) + 1))), "at_")
    span = F.zip_with("words", "at_", lambda w, at: F.struct(at.alias("start"), (at + F.octet_length(w.text)).alias("end"), w.text.alias("text"), w.rect.alias("rect"), F.lit(None).cast("float").alias("ink_w")))
    return pages.select("doc_id", "page_index", F.array_join(F.transform("words", lambda w: w.text), " ").alias("text"), span.cast(f"array<{SPAN}>").alias("spans"))


def write_json(df: DataFrame, column: str, path: str) -> None:
    """One JSON document a line, in as many files as there are tasks."""
    df.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """json, findings, errors: files with errors are kept, with their codes."""
    raw = spark.read.text(path).withColumnRenamed("value", "json")
    return raw.select("json", findings_.parse(F.col("json")).alias("findings"), findings_.errors(F.col("json")).alias("errors"))


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).withColumnRenamed("value", "json")
    return raw.select("json", certificate_errors(F.col("json")).alias("errors"))


def check_files(files_: DataFrame, secrets: DataFrame) -> DataFrame:
    """path, checks of raw files against secrets (path, secret), in Arrow batches; the byte scan has no column form."""
    @F.pandas_udf("array<struct<id:string,passed:boolean,detail:string>>")
    def run(content: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("id", "passed", "detail"), c, strict=True)) for c in check_pdf(b, [s.encode() for s in n])] for b, n in zip(content, needles, strict=True)])

    grouped = secrets.groupBy("path").agg(F.collect_set("secret").alias("s_"))
    joined = files_.select("path", "content").join(grouped, "path", "left")
    return joined.select("path", run("content", F.coalesce("s_", F.array().cast("array<string>"))).alias("checks"))
