import pytest
from pyspark.sql import functions as F

from lexigraph import storage


def test_small_is_checked(spark):
    df = spark.range(100)
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString() or "hint" in x._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(storage.small(df)) and not hinted(storage.small(df, rows=99))
    kept = storage.staged(df, "t")
    assert storage.bytes_of(df) is None and storage.bytes_of(kept) > 100
    assert hinted(storage.small(kept)) and not hinted(storage.small(kept, limit=100))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)


def test_staged(spark):
    df = storage.staged(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 10 and "staged" in df.inputFiles()[0]
    assert storage.shared_dir(spark) in df.inputFiles()[0] or storage.shared_dir(spark).replace("file://", "file:///") in df.inputFiles()[0]


def test_small_tables_are_spread(spark, sf):
    df = storage.read_table(spark, f"{sf}/documents.parquet")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = df.where("doc_id > 5").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:bigint>" in plan
