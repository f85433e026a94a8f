"""Helpers that the corpus operators share: scratch tables, size checks, word patterns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.sources.scratch import scratch_dir, written

#: A word: a run of characters other than ASCII white space. Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table that has been counted may be broadcast.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's scratch tables, which driver and executors share; see drop_scratch()."""
    return scratch_dir(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage as checkpoint() does, without computing the last stage twice. A lost
    executor costs the tasks it ran, not what was written.
    """
    return written(df, name)


def store_bytes(folder: str, name: str, data: bytes) -> None:
    """A file in folder, a URI. It is written under another name and renamed, so that none is ever half there."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    hidden = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(data)
    store.move(hidden, f"{path}/{name}")


def load_bytes(file: str) -> bytes:
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_stream(path) as f:
        return f.read()


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows it to be small; otherwise as it is, for a shuffle join.

    df should be a scan of a written table, which makes the count cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back_memory() -> None:
    """Memory that this worker has freed goes back to the system: Arrow's, and the C heap's with glibc."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, where stages follow one another: a worker lives on, and would keep what it took for a task
    beside the JVM, the other workers and what the next stage takes."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        yield from run(batches)
        give_back_memory()

    return tidied


def driver_gives_back(spark: SparkSession) -> None:
    """Memory that the driver no longer uses goes back to the system: its Python's, the JVM's heap and its C heap.

    A plan of many jobs otherwise leaves some 200 MB of the JVM's compiler and threads beside its heap. JVMs
    without the command for the C heap, other than OpenJDK's on Linux, keep that part.
    """
    gc.collect()
    give_back_memory()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    java, named = jvm.java.lang, jvm.java.lang.Class.forName
    try:  # by reflection, as the server's own class is not public
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = array(java.Class, commands.getClass(), named("java.lang.String"), named("[Ljava.lang.Object;"), named("[Ljava.lang.String;"))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(java.Object, commands, "systemTrimNativeHeap", array(java.Object), array(java.String)))
    except Py4JError:
        pass


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identifies a row by id and text, never null; rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("")))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
