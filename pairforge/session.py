"""Sessions, input tables and tables in the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairforge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; their Python need not have it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="pairforge-")
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "pairforge"), "zip", root, "pairforge"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Input table `name` of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where it is unset and all is local.

    On a cluster a folder of one machine would lose what the others wrote, so there it is an error not to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pairforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor only costs the tasks it ran.

    `drop` removes tables as soon as they are used up; those that the returned DataFrame still reads go when the
    application ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{job}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def path(self, name: str) -> str:
        """A new path in the shared folder; what lies there goes when the application ends."""
        self._count += 1
        if self._count == 1:
            fs, base = self._at(self.base)
            fs.mkdirs(base)
            fs.deleteOnExit(base)
        return f"{self.base}/{self._count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def drop_all(self) -> None:
        """Delete all tables saved here."""
        fs, base = self._at(self.base)
        fs.delete(base, True)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete saved tables."""
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                fs, target = self._at(path)
                fs.delete(target, True)


def default_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
