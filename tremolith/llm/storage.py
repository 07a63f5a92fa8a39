"""Intermediate tables in the folder that driver and executors share.

Long lineages are cut by writing a Parquet table under ``spark.checkpoint.dir``
and reading it back: a lost executor then re-reads a file, never a lost block.
Where a local session names no such folder (tests, notebooks) one is made once per
Spark application; on a cluster a missing folder is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, as a path Spark can write to."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tremolith-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tremolith-{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_parts(df: DataFrame, tag: str, by: str, rows: int) -> list[DataFrame]:
    """Write ``df`` by the few values of a column and return the written rows, without it,
    as tables to be worked on in turn: of one value each, or of several while that
    makes some ``rows`` rows.  Rows of one value are in one table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.partitionBy(by).option("compression", "zstd").parquet(path)
    whole, reader = spark.read.schema(df.schema).parquet(path), spark.read.schema(df.drop(by).schema)
    folders = sorted({f.rsplit("/", 1)[0] for f in whole.inputFiles()})
    if not folders:
        return [whole.drop(by)]
    turns = min(len(folders), 1 + whole.count() // rows)
    return [reader.parquet(*folders[k::turns]) for k in range(turns)]


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tremolith-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of steps that are over: it
    does so once the driver's garbage is collected, which a loop of many small jobs
    otherwise puts off until the driver's heap has grown to its limit."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one small file through Hadoop's file systems; returns ``path``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
