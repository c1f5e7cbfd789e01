import pytest


@pytest.fixture
def frames(spark, tmp_path):
    """Write tables as a folder of parquet files, as the queries read them."""

    def put(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put
