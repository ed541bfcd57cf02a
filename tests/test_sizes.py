from pyspark.sql import functions as F

from boxledger.session import FILE_FACTOR, cut, real_sizes


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    """Repeated values: less than a MB on disk, 4,000,000 rows in memory."""
    real_sizes(spark)
    assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == FILE_FACTOR
    rows = cut(spark.range(4_000_000).select((F.col("id") % 4_000).alias("k"), F.lit("one long text that all rows have").alias("v")))
    plan = rows.join(rows.withColumnRenamed("v", "u"), "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
