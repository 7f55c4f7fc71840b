"""Written tables in the folder that driver and executors share."""

import atexit
import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a new temporary one if all of Spark runs on
    this machine, and an error on a cluster, whose machines share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _database(spark: SparkSession) -> str:
    """A database of this application for the names of bucketed tables. It is dropped, names and all, when Python ends or by
    ``drop_names``; the files are in the shared folder."""
    name = "emtally_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    if name not in _databases:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_dir(spark)}/{name}'")
        _databases[name] = spark
    return name


def drop_names(spark: SparkSession | None = None) -> None:
    """Drops the databases of names (of one session's application, or all): a lasting catalog keeps none. What was made of
    them can't be read any more by name."""
    for name, of in list(_databases.items()):
        if spark is None or of.sparkContext.applicationId == spark.sparkContext.applicationId:
            del _databases[name]
            if of.sparkContext._jsc is not None:  # the application still runs
                with contextlib.suppress(Py4JNetworkError, ConnectionError):  # but its JVM may have been ended
                    of.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


_databases: dict[str, SparkSession] = {}
atexit.register(drop_names)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: its lineage is cut, a lost executor
    costs nothing, and Spark knows no partitioning of it (so that it may split skewed joins on it). Columns ``by`` have a
    folder for each value: a filter on them reads no others."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str, placed: bool = False) -> DataFrame:
    """``df`` as a table written to the shared folder in sorted buckets of ``keys`` and read again: what groups or joins by
    ``keys`` (or a window over them) shuffles nothing, also after broadcast joins and explodes. ``placed`` says that equal
    keys are in one partition already, as after an aggregate or a join by them: then the write shuffles nothing either."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name)
    table = f"{_database(spark)}.{path.rpartition('/')[2].replace('-', '_')}"
    (df if placed else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)
