import argparse
import os

import pytest
from pyspark.sql import functions as F

from inkveil.__main__ import main, pad, rectangle, scale, share


def test_detect_run_verify(spark, tmp_path):
    spark.createDataFrame([(1, "mail jane@example.com"), (2, "clean")], "doc_id int, text string").write.parquet(f"{tmp_path}/in")
    assert main(["detect", f"{tmp_path}/in", f"{tmp_path}/found", "--categories", "email"]) == 0
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/found").collect()] == ["jane@example.com"]
    assert main(["run", f"{tmp_path}/in", f"{tmp_path}/out", "--categories", "contact", "--text", "clean"]) == 0
    assert sorted(r.masked for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()) == ["mail ████████████████", "█████"]
    assert main(["verify", f"{tmp_path}/out/documents", "--string", "jane@example.com"]) == 0
    assert main(["verify", f"{tmp_path}/out/documents", "--string", "mail"]) == 1
    certified = spark.read.parquet(f"{tmp_path}/out/certificates")
    assert sorted(r.doc_id for r in certified.collect()) == [1, 2]
    assert main(["verify", f"{tmp_path}/out/documents", "--certificates", f"{tmp_path}/out/certificates"]) == 0
    # an output without certificate fails, and so does a certificate without output
    certified.where("doc_id = 1").write.parquet(f"{tmp_path}/one")
    assert main(["verify", f"{tmp_path}/out/documents", "--certificates", f"{tmp_path}/one"]) == 1
    spark.read.parquet(f"{tmp_path}/out/documents").where("doc_id = 1").write.parquet(f"{tmp_path}/first")
    assert main(["verify", f"{tmp_path}/first", "--certificates", f"{tmp_path}/out/certificates"]) == 1
    assert main(["verify", f"{tmp_path}/out/documents", "--string", "nothing"]) == 0
    assert main(["run", f"{tmp_path}/in", f"{tmp_path}/none", "--text", "not there"]) == 1 and not os.path.exists(f"{tmp_path}/none")


def test_output_may_not_take_the_inputs_place(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "doc_id int, text string").write.parquet(f"{tmp_path}/in")
    os.symlink(f"{tmp_path}/in", f"{tmp_path}/link")
    for other in (f"{tmp_path}/in", f"{tmp_path}/in/", f"file://{tmp_path}/in", f"{tmp_path}/a/../in", f"{tmp_path}/link"):
        assert main(["run", f"{tmp_path}/in", other]) == 2
    assert spark.read.parquet(f"{tmp_path}/in").count() == 1


def test_review_and_redact(spark, tmp_path):
    spark.createDataFrame([(1, "mail jane@example.com and é bob@example.org"), (2, "host 192.168.1.10")], "doc_id int, text string").write.parquet(f"{tmp_path}/in")
    assert main(["review", f"{tmp_path}/in", f"{tmp_path}/found"]) == 0
    edited = spark.read.parquet(f"{tmp_path}/found").withColumn("findings", F.regexp_replace("findings", r'("text":"bob.*?"included":)true', "$1false"))
    edited.write.parquet(f"{tmp_path}/edited")
    assert main(["redact", f"{tmp_path}/in", f"{tmp_path}/out", "--findings", f"{tmp_path}/edited"]) == 0
    masked = {r.doc_id: r.masked for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()}
    assert masked == {1: "mail ████████████████ and é bob@example.org", 2: "host ████████████"}
    assert main(["verify", f"{tmp_path}/out/documents", "--certificates", f"{tmp_path}/out/certificates"]) == 0
    # a string that isn't in every document is refused, and so are findings of other texts
    assert main(["redact", f"{tmp_path}/in", f"{tmp_path}/x", "--findings", f"{tmp_path}/edited", "--text", "mail"]) == 1
    spark.read.parquet(f"{tmp_path}/in").withColumn("text", F.concat("text", F.lit("!"))).write.parquet(f"{tmp_path}/changed")
    assert main(["redact", f"{tmp_path}/changed", f"{tmp_path}/x", "--findings", f"{tmp_path}/edited"]) == 1
    assert main(["redact", f"{tmp_path}/in", f"{tmp_path}/edited", "--findings", f"{tmp_path}/edited"]) == 2
    assert not os.path.exists(f"{tmp_path}/x")


def test_values():
    assert rectangle("2:1,-2.5,3,4") == (2, (1.0, -2.5, 3.0, 4.0))
    assert (share("0"), share("1"), scale("0.1"), pad("0")) == (0, 1, 0.1, 0)
    for parse, bad in ((share, "1.01"), (share, "nan"), (scale, "0"), (scale, "inf"), (pad, "-1"), (pad, "x"), *((rectangle, r) for r in ("1,2,3,4", "1:1,2,3", "1:1,2,0,4", "x:1,2,3,4", "-1:1,2,3,4", "1:1,2,3,nan", "1:2000000,1,1,1"))):
        with pytest.raises((argparse.ArgumentTypeError, ValueError)):
            parse(bad)
