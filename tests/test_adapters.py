"""Tables of documents as caption tables."""

from pyspark.sql import functions as F

from subweave.sources.adapters import cues_from_documents, events_from_documents


def test_partitions_grow_with_the_text(spark, tmp_path):
    docs = spark.range(24).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a few words here\n"), 60_000).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cues = cues_from_documents(spark, str(tmp_path))
    assert cues.rdd.getNumPartitions() == 12  # of 2,097,152 characters
    assert events_from_documents(spark, str(tmp_path)).rdd.getNumPartitions() == 12
    assert cues.count() == 24 * 60_000


def test_no_text_at_all(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert cues_from_documents(spark, str(tmp_path)).count() == 0
