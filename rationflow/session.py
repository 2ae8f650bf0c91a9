"""Session and lineage helpers.

The engine never assumes a machine-local scratch folder: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (unit tests, a
laptop) do we create a private temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


_TABLES: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "rationflow") -> SparkSession:
    """Session tuned for the engine: AQE on (runtime broadcast conversion,
    skew-join splitting, partition coalescing), UTC, no web UI."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # partition sizing: ~128 MB scan splits and shuffle partitions that
        # AQE coalesces/splits toward 128 MB, so tasks fit executor memory
        # at any scale without hand-tuning the partition count per run
        .config("spark.sql.files.maxPartitionBytes", str(128 << 20))
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(128 << 20))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RATIONFLOW_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only when
    the cluster did not name one (tests and local runs)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        # Unset: tests and local runs only.  Executors of a cluster could not
        # read a folder of the driver's machine.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="rationflow-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def new_table(spark: SparkSession, name: str) -> str:
    """Path for a new table in the shared folder; `release_tables` removes them."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}_{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage at files every executor reads."""
    path, schema = new_table(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system (none if it does not exist)."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def rename_path(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not exist yet: True for the one caller
    that makes it, however many try."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark.sparkContext._jvm
    try:
        if fs.getUri().getScheme() == "file":
            none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
            jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0)), none)
        else:
            fs.create(p, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
            return False
        raise
    return True


def release_tables(spark: SparkSession) -> None:
    """Delete the tables this process has written through `new_table`; call it
    when no result that reads them is needed any more."""
    while _TABLES:
        fs, p = _fs(spark, _TABLES.pop())
        fs.delete(p, True)
