"""Session set-up and the storage every operator shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "openweave", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library assumes; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark, "_openweave_dir", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="openweave-")
            spark._openweave_dir = where
    return where.rstrip("/")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and nothing is computed twice.
    The files are removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/openweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
