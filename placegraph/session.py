"""Session helpers: settings, lineage cuts that survive executor loss, run metrics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "placegraph") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read from ``spark.checkpoint.dir``. Where it is unset a folder of our own is made,
    for a local master only: on a cluster a machine-local folder would be lost with its host.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="placegraph-")
    return _LOCAL[app]


def run_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are; :func:`clear_run` removes them."""
    return f"{checkpoint_root(spark).rstrip('/')}/placegraph/{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` to the application's run folder and read it back, in one job.

    Iterative operators call this once per round: the lineage is cut at a table
    that outlives any executor, the optimizer gets true sizes for the next join,
    and the loop's stop condition comes from metrics observed during the write
    instead of from a second job.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    metrics = metrics or {"rows": F.count(F.lit(1))}
    watch = Observation(f"m{uuid.uuid4().hex[:8]}")
    df.observe(watch, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(watch.get)


def discard(df: DataFrame) -> None:
    """Delete the files of a superseded materialised table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/placegraph/" in str(path.toString()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
