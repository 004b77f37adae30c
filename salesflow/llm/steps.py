"""Between the steps of a long job."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from salesflow.session import discard


def tidy(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove written tables, and let Spark remove the shuffle files of steps that are over.

    The scheduler holds on to the last job it ran, so an empty one comes before the collection.
    """
    discard(*tables)
    gc.collect()
    spark.range(12, numPartitions=12).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()
