"""Shared scratch tables: how a plan is cut without losing it when executors go away.

A cut is a Parquet table in the folder that the cluster names in ``spark.checkpoint.dir``.
Unlike an RDD checkpoint it keeps columns prunable and its file sizes feed Catalyst's
broadcast decision.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; a local one is made only for an unset local-mode session."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="rowkeel-")
    spark.conf.set(_SETTING, made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/rowkeel/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "cut", path: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str = "cut", path: str | None = None, **metrics) -> tuple[DataFrame, dict]:
    """:func:`stage` that also returns ``rows`` and further aggregates taken during the write."""
    seen = Observation()
    named = [F.count(F.lit(1)).alias("rows")] + [c.alias(n) for n, c in metrics.items()]
    out = stage(df.observe(seen, *named), label, path)
    return out, seen.get


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Spark's own storage layer, for small control files."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace one small control file; readers see the old or the new text, never a part."""
    fs, p = hadoop_path(spark, path)
    jvm = spark._jvm
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    flags = spark.sparkContext._gateway.new_array(rename, 1)
    flags[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(tmp, p, flags)


#: File systems whose files become visible whole, when they are closed.
_OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn", "obs"}


def write_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create one small control file with its whole text; False, and nothing changed, where the file is there already.

    Of several writers exactly one gets True. Local files are linked into place and those of HDFS renamed without overwriting, which both
    fail on an existing name. Object stores are asked to create without overwriting; there this is as safe as the store's own
    conditional write (S3A: ``fs.s3a.create.conditional.enabled``, on by default since Hadoop 3.4.2).
    """
    fs, p = hadoop_path(spark, path)
    jvm = spark._jvm
    scheme = fs.getUri().getScheme()
    fs.mkdirs(p.getParent())
    if scheme in _OBJECT_STORES:
        return _created(fs, p, text)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    if not _created(fs, tmp, text):
        raise RuntimeError(f"{tmp} exists already")
    try:
        if scheme == "file":
            files, local = jvm.java.nio.file.Files, lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
            files.createLink(local(fs.makeQualified(p)), local(fs.makeQualified(tmp)))
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            flags = spark.sparkContext._gateway.new_array(rename, 1)
            flags[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, p, flags)
        return True
    except Py4JJavaError as failed:
        if _exists_already(failed):
            return False
        raise
    finally:
        if fs.exists(tmp):
            fs.delete(tmp, False)


def _created(fs, p, text: str) -> bool:
    try:
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
    except Py4JJavaError as failed:
        if _exists_already(failed):
            return False
        raise
    return True


def _exists_already(failed: Py4JJavaError) -> bool:
    """FileAlreadyExistsException of Java or Hadoop, as itself or as a cause."""
    cause = failed.java_exception
    while cause is not None:
        if cause.getClass().getSimpleName() == "FileAlreadyExistsException":
            return True
        cause = cause.getCause()
    return False


def names_in(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """``(name, time)`` of what a folder holds, the time of its last change in milliseconds; none where it is absent."""
    fs, p = hadoop_path(spark, folder)
    if not fs.exists(p):
        return []
    return sorted((f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def read_small_text(spark: SparkSession, path: str) -> str:
    """Read one small control file whole (``wholetext``), never table data."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return rows[0][0] if rows else ""
