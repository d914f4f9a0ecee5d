"""Small files through Spark's file system: the driver's records beside tables, on any path that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    p, fs = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file."""
    p, fs = _open(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def claim(spark: SparkSession, draft: str, path: str) -> bool:
    """Rename a finished draft to a name that nobody may have yet; False if somebody has. Readers see the whole file or none."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(draft), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path), how)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.delete(p, True)
