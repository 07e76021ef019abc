"""Session helpers: a local session for tests and benches, and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomgraph")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: The folder of this application's cuts, by application id.
_folders: dict[str, str] = {}


def _fs(spark: SparkSession, folder: str):
    """The Hadoop file system and path of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def cut_folder(spark: SparkSession) -> str:
    """The folder that holds this application's cuts, below the folder that the cluster shares.

    Only a local session that names no folder gets one of its own. What is in it goes when the
    application ends.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
        folder = f"{named.rstrip('/')}/cuts-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        fs, path = _fs(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[sc.applicationId] = folder
    return _folders[sc.applicationId]


#: Spark deletes the shuffle files of a statement as soon as it ends where this is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    The copy survives the loss of executors, and the plan over it knows its true size. A checkpoint
    would keep the size estimated for the plan before it, which multiplies with every join of a
    loop until the driver spends its time and memory on the digits. Loops call this once a round.
    The shuffle files behind it go at once: nothing reads them after the copy.
    """
    spark = df.sparkSession
    folder = f"{cut_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "lz4").parquet(folder)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(folder)
    back._cut_folder = folder
    return back


def together(*cuts: DataFrame) -> DataFrame:
    """The rows of all ``cuts`` (of one schema) as a single scan over their files."""
    spark = cuts[0].sparkSession
    return spark.read.schema(cuts[0].schema).parquet(*[df._cut_folder for df in cuts])


def release(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more, as a loop does with its earlier rounds."""
    for df in cuts:
        folder = df.__dict__.pop("_cut_folder", None)
        if folder is not None:
            fs, path = _fs(df.sparkSession, folder)
            fs.delete(path, True)


__all__ = ["cut", "cut_folder", "local_session", "release", "together"]
