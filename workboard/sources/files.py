"""Small files (commit records, manifests) in a shared folder, through Hadoop's file systems.

A record is written in full under a name of its own and then renamed: a reader sees all of
it or nothing, and a writer that dies leaves no record behind, at most a ``.part`` file.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class FileExists(RuntimeError):
    """There is a file of that name already."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(_conf(spark))


def _is(e: Py4JJavaError, name: str) -> bool:
    return name in str(e.java_exception.getClass().getName()) or name in str(e.java_exception)


def write_record(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Write ``text`` as the file ``path``; FileExists if there is one and ``replace`` is false."""
    jvm, fs = spark._jvm, _fs(spark, path)
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    out = fs.create(_path(spark, part), False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    target = fs.makeQualified(_path(spark, path))
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), _conf(spark)).rename(
            fs.makeQualified(_path(spark, part)), target, how)
    except Py4JJavaError as e:
        fs.delete(_path(spark, part), False)
        if _is(e, "FileAlreadyExistsException"):
            raise FileExists(path) from e
        raise


def read_record(spark: SparkSession, path: str) -> str | None:
    """The text of a file; None if there is none."""
    try:
        stream = _fs(spark, path).open(_path(spark, path))
    except Py4JJavaError as e:
        if _is(e, "FileNotFoundException"):
            return None
        raise
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder, without hidden ones, and when each was last changed (ms); empty if there is no folder."""
    try:
        found = _fs(spark, folder).listStatus(_path(spark, folder))
    except Py4JJavaError as e:
        if _is(e, "FileNotFoundException"):
            return {}
        raise
    return {s.getPath().getName(): s.getModificationTime() for s in found if not s.getPath().getName().startswith((".", "_"))}


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of this library's own; a missing one is no matter."""
    _fs(spark, path).delete(_path(spark, path), True)


def set_times(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Give the named files of a folder times of change a second apart, in the order of the list, up to now."""
    fs, now = _fs(spark, folder), int(time.time()) * 1000
    for k, name in enumerate(names):
        fs.setTimes(_path(spark, f"{folder}/{name}"), now - 1000 * (len(names) - 1 - k), -1)
