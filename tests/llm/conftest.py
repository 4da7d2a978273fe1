import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_dir(spark, tmp_path):
    """Writes a documents table, and others by name, and gives the folder."""

    def write(rows, schema=DOCS, **others):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, (r, s) in others.items():
            spark.createDataFrame(r, s).repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
