"""Numbered commits in a folder, without clocks.

A commit is a small text under the next free number. The file is created exclusively:
of two writers that want one number, one gets it and the other takes the next. The
largest number counts, so the last commit wins whatever the writers' clocks say.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DIGITS = 12
# The scheme of folders that the driver has mounted.
MOUNTED = "file"


class Folder:
    """Files of the driver in a shared folder, by any path that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, under: str = "") -> list[str]:
        at = self._at(f"{self.path}/{under}" if under else self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def create(self, name: str, text: str) -> bool:
        """Make a new file; False if there is one of that name."""
        path = f"{self.path}/{name}"
        if self._fs.getUri().getScheme() == MOUNTED:
            return _link_new(unquote(urlparse(path).path) if ":" in path else path, text)
        try:
            stream = self._fs.create(self._at(path), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        stream.write(text.encode())
        stream.close()
        return True


def _link_new(path: str, text: str) -> bool:
    """On a mounted folder: a finished file gets its name, unless it is taken."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with open(draft, "x", encoding="utf-8") as file:
        file.write(text)
    try:
        os.link(draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def _numbers(folder: Folder) -> list[int]:
    return sorted(int(n) for n in folder.names("versions") if n.isdigit())


def commit(spark: SparkSession, path: str, text: str) -> int:
    """Store ``text`` as the next version of ``path`` and return its number."""
    folder = Folder(spark, path)
    number = max(_numbers(folder), default=0) + 1
    while not folder.create(f"versions/{number:0{DIGITS}d}", text):
        number += 1
    return number


def latest(spark: SparkSession, path: str) -> str | None:
    """The text of the last version. One without text was never finished."""
    folder = Folder(spark, path)
    for number in reversed(_numbers(folder)):
        if text := folder.text(f"versions/{number:0{DIGITS}d}"):
            return text
    return None


def prune(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Remove all but the last ``keep`` finished versions; return the texts that no kept one has."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    folder = Folder(spark, path)
    texts = {n: folder.text(f"versions/{n:0{DIGITS}d}") for n in _numbers(folder)}
    finished = [n for n, text in texts.items() if text]
    kept = set(finished[-keep:])
    old = [n for n in texts if n not in kept and n < max(kept, default=0)]
    for n in old:
        folder.remove(f"versions/{n:0{DIGITS}d}")
    return sorted({texts[n] for n in old} - {texts[n] for n in kept} - {""})
