"""Session helpers.

Nothing here pins a machine-local path: staged tables go to the folder that the session names in
``spark.checkpoint.dir`` and, where it is unset, to the session's warehouse.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, shuffle_partitions: int | None = None, app: str = "barcheck") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """All instants are read and printed in UTC; exchange-local dates are always converted explicitly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: the one named in ``spark.checkpoint.dir``, else one under the session's warehouse.

    A warehouse that nobody configured is a folder of the driver's machine. It serves a local session; on a cluster the
    executors would each write to their own disk, so it is refused there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} is a folder of this machine")
        folder = f"{warehouse}/_staged"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written once as a table in the shared folder, a part for each value of ``by``, and read back.

    A relation that several branches of a plan use is then computed once, survives lost executors, keeps column pruning
    and has exact sizes for join planning. The file system removes the folder when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barcheck-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
