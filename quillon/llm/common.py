"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: The white space of the word rule `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that a lost executor loses no lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return df.checkpoint(eager=True)


def cut_and_clean(spark: SparkSession, plan: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` of what ``plan`` builds; Spark removes its shuffle files once it is written, for nothing reads them any more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return cut(plan())
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def gathered(df: DataFrame, task_bytes: int = 4 << 20) -> DataFrame:
    """``cut`` whose shuffle files go at once, read again by as many tasks as its bytes ask for, at least one a core; else a small result costs every later step a task for each of its partitions."""
    out = cut_and_clean(df.sparkSession, lambda: df.select("*"))
    sc, rdd = df.sparkSession.sparkContext, out._jdf.queryExecution().analyzed().rdd()
    path = sc._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = max(sc.defaultParallelism, -(-size // task_bytes))
    return out.coalesce(tasks) if tasks < rdd.getNumPartitions() else out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column, n: int = 5):
    """crc32 of the id's text modulo ``n``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased: just what these bytes methods do."""
    return text.lower().split() if text else []


def binaries(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except OSError:
        return lambda _: 0


def release() -> None:
    """Give this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the Python worker gives its free memory back; workers outlive their tasks."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``step`` to each Arrow batch; narrow, so a lost task is simply run again."""

    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out

    return df.mapInArrow(tidy(run), schema)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns under fixed names, so that extra or clashing ones are no concern."""
    return df.select(*[df[f"`{name}`"].alias(new) for new, name in columns.items()])
