"""Numbered commits: small JSON files below a folder, each created once.

A commit is written beside its place and then moved there (linked, in a POSIX folder) without overwriting, so of several writers
one gets a number and the others see that it is taken. This needs a file system whose move is atomic, as HDFS's.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path object, so that any folder Spark can write to can hold commits."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def entries_below(spark: SparkSession, folder: str) -> dict[str, dt.datetime]:
    """Names directly below a folder with their times of change; none where there is no folder."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return {}
    found = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)}
    return {name: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc) for name, ms in found.items() if not name.startswith((".", "_"))}


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole; False, and nothing changed, if it is there already."""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    jvm = spark._jvm
    fs.mkdirs(where.getParent())
    # where the folder really is, whatever view of it the path names
    folder = fs.resolvePath(where.getParent())
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    where, beside = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in (where.getName(), f".{where.getName()}.{uuid.uuid4().hex}"))
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            # a move on a POSIX folder would replace the file; a link does not
            paths = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(paths.get(where.toUri()), paths.get(beside.toUri()))
        else:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
            files.rename(beside, where, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getSimpleName().startswith("FileAlreadyExists"):
            raise
        return False
    finally:
        fs.delete(beside, False)
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class CommitLog:
    """The commits below a folder, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(name[:12]) for name in entries_below(self.spark, self.folder))

    def read(self, number: int) -> dict:
        return json.loads(read_text(self.spark, self._file(number)))

    def last(self) -> tuple[int, dict]:
        """Number and content of the last commit; (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def append(self, content: dict, number: int) -> bool:
        """Take this number; False if another writer has it, or has had it and it is forgotten by now."""
        if (self.numbers() or [0])[-1] >= number:
            return False
        return create_once(self.spark, self._file(number), json.dumps(content))

    def add(self, content: dict) -> int:
        """Take the next free number."""
        number = (self.numbers() or [0])[-1] + 1
        while not self.append(content, number):
            number += 1
        return number

    def forget(self, numbers: Iterable[int]) -> None:
        """Remove commits; the last one stays, since numbers go on from it."""
        last = (self.numbers() or [0])[-1]
        for number in numbers:
            if number != last:
                remove(self.spark, self._file(number))


def take_ids(spark: SparkSession, folder: str, n: int, start: int = 1) -> int:
    """The first of n numbers that no other caller gets: one commit reserves a block of them."""
    log = CommitLog(spark, folder)
    while True:
        number, content = log.last()
        first = content.get("next", start)
        if log.append({"next": first + n}, number + 1):
            log.forget(m for m in log.numbers() if m <= number - 10)
            return first
