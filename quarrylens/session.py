"""Session and table helpers shared by the queries."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (a small zip through Spark's own file server), once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "quarrylens_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark touches the path, so any store that Spark reads will do."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[str] = []
LOCAL_CHECKPOINTS = "/tmp/quarrylens-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, with Spark's checkpoint folder set from it; a folder of our own only in local mode where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where or LOCAL_CHECKPOINTS)
    return where or LOCAL_CHECKPOINTS


def scratch(spark: SparkSession, df: DataFrame, what: str, **options: str) -> DataFrame:
    """df written (with options of the writer) as a table in the shared folder and read back: cuts the lineage and survives lost executors.

    Results that are read later depend on it, so it stays until drop_scratch."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _scratch.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Deletes this program's scratch tables, by Spark's own file systems, once no result needs them any more; returns how many."""
    n = len(_scratch)
    while _scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def local_session(app: str = "quarrylens", cores: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
