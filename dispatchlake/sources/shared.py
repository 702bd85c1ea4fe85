"""Tables in the folder that all machines share, where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the session names none and has no other machines."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _fallback[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The files outlive any executor, so what follows never recomputes what came before; the folder is
    deleted when the driver's JVM ends. Shuffle files of what was cut off are of no more use; a collection of
    the driver's garbage lets Spark's cleaner delete them now.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    append(df, path)
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add the rows of ``df`` to the table in ``path``, a folder in the shared one that is deleted as :func:`cut`'s are."""
    context = df.sparkSession.sparkContext
    df.write.mode("append").option("compression", "zstd").parquet(path)
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    context._jvm.System.gc()


def uncut(df: DataFrame) -> None:
    """Delete the table that :func:`cut` wrote, once nothing will read it again."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
