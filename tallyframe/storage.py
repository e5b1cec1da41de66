"""The folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Of the driver's largest heap; once more is in use, a written step is followed by a collection.
HEAP_SHARE = 0.25


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. In local mode, where it is unset, a folder of our own is set; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/tallyframe-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyframe-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _trim(spark: SparkSession) -> None:
    """Have the C library of the driver's JVM return freed memory to the system; an error where the JVM has no such command."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    # the server's own class is not open to reflection, its interface is
    types, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = jvm.java.lang.Class.forName(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)


def release(spark: SparkSession) -> bool:
    """Collect the driver's heap and give freed memory back, where more than HEAP_SHARE of the heap is in use; whether it was so.

    Plans of steps that are over let the heap grow, and the C library keeps what Spark's many short-lived threads have
    freed. A JVM that cannot trim keeps the latter.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() <= HEAP_SHARE * runtime.maxMemory():
        return False
    gc.collect()  # else references from Python keep plans alive
    spark._jvm.java.lang.System.gc()
    with suppress(Py4JError):
        _trim(spark)
    return True


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that the application has staged. Results that were not written elsewhere go, too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
