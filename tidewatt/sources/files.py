"""Small files through Spark's own file systems, so that a store may lie on any of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.errors import StorageFault


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def free_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getStatus(p).getRemaining()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def make(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not be there yet; False if it is."""
    fs, p = _fs(spark, path)
    try:
        stream = fs.create(p, False)
    except Exception as error:  # the JVM's FileAlreadyExistsException, by whichever file system
        if "exist" in str(error).lower():
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename: readers see the whole file or none. Never replaces a file."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    create_text(spark, temporary, text)
    fs, source = _fs(spark, temporary)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, False)
        raise StorageFault(f"{path} has been published by another writer")


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise StorageFault(f"{source} cannot become {target}")


def copy(spark: SparkSession, source: str, target: str) -> None:
    a, p = _fs(spark, source)
    b, q = _fs(spark, target)
    b.mkdirs(q.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration()):
        raise StorageFault(f"{source} cannot be copied to {target}")


def digest(spark: SparkSession, root: str) -> DataFrame:
    """(path below ``root``, length, sha256) of all data files, read on the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    qualified = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    return found.select(F.element_at(F.split(F.col("path"), qualified + "/", 2), -1).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, root: str) -> str:
    """One digest of a tree: files by path. XOR of row digests, so nothing is gathered."""
    row = digest(spark, root).agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "sha256"))).first()
    return f"{row[0]}:{row[1] or 0}"
