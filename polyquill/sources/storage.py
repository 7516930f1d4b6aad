"""Small files and folders on whatever file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _at(spark, path)
    return bool(system.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    system, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(p)) if system.exists(p) else []


def remove(spark: SparkSession, path: str) -> bool:
    system, p = _at(spark, path)
    return bool(system.delete(p, True))


def rename(spark: SparkSession, source: str, target: str) -> None:
    system, p = _at(spark, source)
    if not system.rename(p, _at(spark, target)[1]):
        raise OSError(f"{source} can't become {target}")


def read_text(spark: SparkSession, path: str) -> str:
    system, p = _at(spark, path)
    stream = system.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole file or none: it is written aside and renamed."""
    system, p = _at(spark, path)
    aside = f"{path}.new"
    out = system.create(_at(spark, aside)[1], True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(p):
        system.delete(p, False)
    rename(spark, aside, path)


def described(spark: SparkSession, paths: list[str]) -> list[list]:
    """Path, bytes and time of change of files."""
    out = []
    for path in sorted(paths):
        system, p = _at(spark, path)
        f = system.getFileStatus(p)
        out.append([path, int(f.getLen()), int(f.getModificationTime())])
    return out
