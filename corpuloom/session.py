"""Session helpers: building a session, shipping the package, shared scratch tables."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(app: str = "corpuloom", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Functions of importable modules are pickled by reference, so Python workers must be
    able to import the package wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"{root.name}/{path.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="corpuloom-ship-")
    target = os.path.join(folder, f"{root.name}_pkg.zip")
    Path(target).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and everything runs
    in one process (tests on one machine) a temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        base = tempfile.mkdtemp(prefix="corpuloom-shared-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/corpuloom-{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, *parts: str) -> DataFrame:
        """A table in buckets of a key (and folders of ``parts``), which joins another one of as many buckets without a shuffle.

        It has a name in the session's catalog until it is dropped."""
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{self.root}/{name}").bucketBy(buckets, key)
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(self._named(name))
        return self.spark.table(self._named(name))

    def _named(self, name: str) -> str:
        return re.sub(r"\W", "_", f"{self.root.rsplit('/', 1)[1]}_{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more and let Spark clean their shuffle files."""
        jvm = self.spark._jvm
        for name in names:
            if self.spark.catalog.tableExists(self._named(name)):
                self.spark.sql(f"DROP TABLE {self._named(name)}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SMALL_BYTES = 256 << 20


def spread(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A small input dealt over all cores: a file of one row group would be read, and then worked on, by one task.

    Inputs above ``most`` bytes by the optimizer's estimate have tasks enough and are left alone, so what this
    shuffles is bounded.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


TASK_BYTES = 1 << 20


def dealt(df: DataFrame, task: int = TASK_BYTES, keys: tuple[str, ...] = ()) -> DataFrame:
    """An input dealt over tasks of about ``task`` bytes by the optimizer's estimate (compressed columns), and over all cores.

    For work that is heavy per byte: a task's share stays the same however large the input, or its row groups, are.
    With ``keys`` rows of the same keys meet in a task, one after the other.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task) if size < 1 << 60 else 1)  # beyond it the size isn't known
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys) if keys else df.repartition(tasks)
