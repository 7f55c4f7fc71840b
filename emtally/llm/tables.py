"""Written tables in the folder that driver and executors share, and batches to Python workers."""

from pyspark.sql import SparkSession

from emtally.sources.shared import bucketed, new_path, shared_dir, written

__all__ = ["bucketed", "new_path", "shared_dir", "small_batches", "written"]

#: Bytes of rows sent to a Python worker at once. Texts are long: by rows alone a batch would have no bound.
BATCH = "2m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
