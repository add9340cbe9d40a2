"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or the warehouse if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Have the executors' Python find this package, as ``--py-files`` does, where it isn't installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # on the driver, which serves it
        with zipfile.ZipFile(path, "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark


#: Seconds between two releases of the driver's memory by ``written``.
RELEASE_EVERY = 10
_released = float("-inf")


def release_driver_memory(spark: SparkSession) -> None:
    """Give memory that the driver no longer needs back to the system.

    A garbage collection lets Spark drop what finished plans leave (broadcasts, shuffle files, generated classes), and the heap
    shrinks to what is used. What Java allocates outside its heap, as its compiler does for each method, stays with the C
    library when it is freed, until that is trimmed. Java before 17.0.9 and other C libraries cannot; there only the heap shrinks.
    """
    global _released
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        connection = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection")  # the server's own class isn't public
        invoke = next(m for m in connection.getMethods() if m.getName() == "invoke")
        call = gateway.new_array(jvm.Object, 4)  # name, command, no arguments, no types
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, call)
    except Py4JError:
        pass
    _released = time.monotonic()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    With ``path`` it is added to what lies there. The plan behind it is done with, so the driver gives back its memory
    now and then.
    """
    spark, path = df.sparkSession, path or shared_folder(df.sparkSession)
    df.write.mode("append").parquet(path)
    if time.monotonic() - _released > RELEASE_EVERY:
        release_driver_memory(spark)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def finite(vector: Column) -> Column:
    """Neither null nor empty nor holding null or non-finite components."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def usual_width(rows: DataFrame, vector: str) -> int | None:
    """The length that most vectors have, the smaller of equally usual ones; None without rows."""
    most = rows.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").first()
    return most.width if most else None
