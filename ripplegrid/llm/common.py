"""What the operators of this subpackage share: tables, the shared folder, batches bounded in characters."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import glob
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a worker handles at a time; a longer text is handled alone.
BATCH_CHARS = 1 << 19
#: Rows of text that a worker gets at a time.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only on a local master, as in tests, a temporary folder stands in where that setting is missing.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or _OWN.get(context.applicationId)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ripplegrid-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        context.setCheckpointDir(base)
        _OWN[context.applicationId] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: How to drop the tables that modules keep in a worker, by name.
HELD: dict[str, Callable[[], None]] = {}
_OWN: dict[str, str] = {}
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def written(df: DataFrame, path: str | None = None, mode: str = "error") -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts the lineage, survives lost executors. erased() deletes them. With mode append they are added to what is in path."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode(mode).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    driver_trimmed(spark)
    return out


#: Has Spark delete a plan's shuffle files when it ends, instead of once the driver's JVM happens to collect it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, path: str | None = None, mode: str = "error") -> DataFrame:
    """written(), after which the plan's shuffle files are gone too: for plans whose shuffles take much disk. The session's setting is as before afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, path, mode)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def erased(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lets Python workers and the readers of files hold at most BATCH_ROWS texts at a time, unless the session asks for fewer: for queries and jobs, which own their session. Operators leave it alone; Spark's own bound, in bytes, holds for workers in any case."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


#: Rows up to which what is left out of a table is sent to every task (16 MB).
BROADCAST_ROWS = 1_000_000


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def without(docs: DataFrame, rows: DataFrame, key: str, tag: Column) -> DataFrame:
    """docs less the rows whose key and tag, a hash of what else tells them apart, are in rows (k, t). Up to BROADCAST_ROWS of them go to every task, and no text is shuffled; beyond that, rows are matched by shuffle."""
    gone = written(rows.select("k", "t").distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(few, docs[key].eqNullSafe(few["k"]) & (tag == few["t"]), "left_anti")


def released(batches: Iterable, using: str = "words") -> Iterator:
    """The batches, for work that uses one of the tables in HELD. Workers live on between tasks: so they drop the other tables first, and after each batch give unused memory back to the system."""
    one_thread()
    for name, drop in HELD.items():
        if name != using:
            drop()
    for batch in batches:
        yield batch
        del batch
        trimmed()


@functools.cache
def one_thread() -> None:
    """Has numpy's matrix products use one thread in this process, as every task has a core: more of them spin while they wait for each other. Without OpenBLAS nothing happens."""
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def trimmed() -> None:
    """Gives memory that this process doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def driver_trimmed(spark: SparkSession) -> None:
    """Gives memory that the driver doesn't use back to the system: Python's, and what compilers and ended threads left in the JVM's native heap. A JVM that has no such command is left alone."""
    trimmed()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # The server's own class is hidden, so its method is called by the interface's description.
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    given[0], given[1] = command, "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)


def executors_trimmed(spark: SparkSession) -> None:
    """Has every executor's JVM collect its garbage and give back the heap that it doesn't need, by as many tasks as there are cores: else the heap that one stage grew is held beside the next one's Python workers."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone; a null text counts as empty."""
    return docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def runs(texts: Iterable[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds (from, to) of consecutive texts that together have at most `most` characters, or are one text."""
    begin = size = at = 0
    for at, text in enumerate(texts):  # noqa: B007
        if size and size + len(text) > most:
            yield begin, at
            begin, size = at, 0
        size += len(text)
        at += 1
    if at > begin:
        yield begin, at
