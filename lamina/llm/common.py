"""What the text operators share: sessions, shared storage, Arrow batches and text rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most; with texts of up to some 100 KB a batch stays below 100 MB even at its worst.
BATCH_ROWS = 1000
#: Characters of text that a Python step works on at once.
CHUNK_CHARS = 4_000_000

#: Words as the contracts define them: maximal runs of anything but ASCII white space.
WORD = re.compile("[^\x20\x09-\x0d]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Sets bounded Arrow batches and lets executors import this package wherever the driver found it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    with contextlib.suppress(Exception):  # a setting of newer releases only
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    root = Path(__file__).resolve().parents[2]
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":")]
    if str(root) not in paths and not getattr(spark.sparkContext, "_lamina_shipped", False):
        folder = tempfile.mkdtemp(prefix="lamina-src-")
        with zipfile.ZipFile(f"{folder}/lamina_src.zip", "w") as z:
            for p in sorted(root.glob("lamina/**/*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(f"{folder}/lamina_src.zip")
        spark.sparkContext._lamina_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that lies in fewer splits than there are cores is dealt out to all of them, as the work on a row is far more than its way."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of this machine where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/lamina-shared-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The paths in the shared folder that this process has given out.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Deletes at its end all that was made in the shared folder meanwhile, but tables of written() that the function it gives was called with."""
    mark, kept = len(_MADE), []
    try:
        yield lambda df: kept.append(df._lamina_path)
    finally:
        for path in _MADE[mark:]:
            if path not in kept:
                _delete(spark, path)
        _MADE[mark:] = kept


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


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives any lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def _freed() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives memory back to the system at the end of each task: idle workers of one step do not burden the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _freed()

    return task


def columns_of(df: DataFrame, names: list[str] | None = None) -> list:
    """The columns of df (all, or those named), whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kept: int | None = None) -> DataFrame:
    """mapInArrow for functions that give back the columns that they get (the first `kept` of them), whatever characters their names have."""
    names = df.columns
    plain = df.toDF(*(f"_{i}" for i in range(len(names))))
    out = plain.select(*plain.columns[:kept])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(names) for x in batches):
            yield b.rename_columns([f"_{i}" for i in range(b.num_columns)])

    return plain.mapInArrow(released(renamed), out.schema).toDF(*names[:kept])


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made; only for those whose rows have all gone into another written table."""
    for t in tables:
        _delete(t.sparkSession, t._lamina_path)


def chunks(values: list, limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of a list of texts with about `limit` characters each; one text is never split."""
    start, size = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(values):
        yield slice(start, len(values))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs a function over the column text, a bounded chunk at a time.

    make() is called once in each task and returns a function from a list of texts (None where null) to the new columns.
    The result has the columns in `keep` and then the new ones, whose names and types are in `schema`."""
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]
    shape = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in chunks(texts):
                new = work(texts[s])
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(x if isinstance(x := new[n], pa.Array) else pa.array(x) for n in names)], names=[*keep, *names]
                )

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(released(run), shape)


def crc_mod(n: int):
    """crc32 of the doc_id as text, modulo n; null where doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string")) % n
