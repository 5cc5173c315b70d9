"""Table access, shared folders and column conventions of the operators."""

from __future__ import annotations

import gc
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: A word: a run of bytes other than 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or our own where it is unset on one machine.

    On a cluster without that setting this is an error: a folder of each machine's own would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame, part: str = "") -> None:
    """Delete a table that ``stored`` wrote, or a part of it (``column=value``)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for file in df.inputFiles()[:1]:
        path = hadoop.Path(file)
        while path is not None and not path.getParent().getName() == "tessera":
            path = path.getParent()
        if path is not None:
            path = hadoop.Path(path, part) if part else path
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and broadcasts that nothing refers to any more.

    Its cleaner follows the driver's garbage collector, which may not run for long where the driver does little.
    Then what the driver has freed outside its heap goes back to the system.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Give freed native memory of the driver's JVM back to the system; false where the JVM has no command for it.

    Compilers, class loaders and hundreds of short-lived threads leave it in the allocator's pools, which keep it.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    # By reflection on the interface: the class of the bean server is not open to calls.
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def crc_mod(key: str | Column, modulus: int) -> Column:
    """crc32(key as text) mod ``modulus``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
