"""Files through Hadoop's file systems, so that a path may lie on a disk, HDFS or an object store."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all it holds; one that isn't there is no error."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the names, sizes and times of files and of folders' files; a path that isn't there counts as absent."""
    h = hashlib.sha256()
    for path in sorted(paths):
        fs, p = _at(spark, path)
        if not fs.exists(p):
            h.update(f"{path} absent\n".encode())
            continue
        files = fs.listFiles(p, True)
        seen = []
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}\n")
        h.update("".join(sorted(seen)).encode())
    return h.hexdigest()[:24]
