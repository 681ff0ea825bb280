"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and ``bench.py`` use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spandrel")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset (a local session) a temporary folder is made and set on the context.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spandrel-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spandrel-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.clear)  # results are read lazily, so what is left goes when the driver ends

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """``df`` written and read back."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        writer = df.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def clear(self) -> None:
        """Delete everything that was kept, if the session still lives."""
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session has ended
            pass

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in kept:
            at = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            at.getFileSystem(hadoop).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, whose rows take workers long, over all cores: a scan of fewer splits than cores is spread out.

    Only small inputs have so few splits, so what is shuffled stays below one split a core; larger ones are read as
    they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
