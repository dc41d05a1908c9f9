"""Sessions and shared storage."""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lamina", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans expect: adaptive execution, UTC, Arrow."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/lamina-shared-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tasks(spark: SparkSession, rows: int, most: int = 2**19) -> int:
    """Into how many tasks to deal rows, so that none holds more than about `most`; a few rows do not take all cores. Adaptive execution goes by bytes, which compress."""
    return max(math.ceil(rows / most), min(spark.sparkContext.defaultParallelism, math.ceil(16 * rows / most)), 1)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned in this block delete their shuffle files when they end; not for a DataFrame that is run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        before = spark.conf.get(name)
        spark.conf.set(name, "true")
    except Exception:  # a setting of newer releases only
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder, so loops do not grow their lineage and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made; only for those whose rows have all gone into another written table."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._lamina_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
