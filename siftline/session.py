"""Session helpers: table access, lineage cuts in the shared folder, partition sizing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python workers can
    import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_siftline_shipped", None):
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="siftline-")) / "siftline_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._siftline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: a scan of at most so many bytes for each core may have too few splits, as files are hardly split below this
SMALL_SCAN = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its files are so small that a scan may
    have fewer: at most ``SMALL_SCAN`` bytes for each core are shuffled. Larger tables are split by the scan
    itself. Only the sizes of files are looked at; nothing runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size <= SMALL_SCAN * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in ``spark.checkpoint.dir``; only in
    local mode (tests), where one machine is all there is, a folder is taken where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"siftline-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _home(spark: SparkSession) -> str:
    """The application's folder, which is removed when it ends."""
    home = f"{shared_dir(spark)}/siftline/{spark.sparkContext.applicationId}"
    sc = spark.sparkContext
    if getattr(sc, "_siftline_home", None) != home:
        p = sc._jvm.org.apache.hadoop.fs.Path(home)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._siftline_home = home
    return home


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Removes every cut of this application; results that were not read yet are lost."""
    _delete(spark, _home(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder among the application's tables."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


class Cut:
    """A DataFrame written once to the shared folder, so that a lost executor never
    forces the work before it to run again. ``drop`` removes the files."""

    def __init__(self, df: DataFrame, name: str = "cut"):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return Cut(df, name).df
