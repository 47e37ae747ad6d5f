"""File operations on any store that Spark reads, through its own file systems."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = False) -> bool:
        """Write beside and rename, so readers see all or nothing; False if the file is there and not to be replaced."""
        fs, p = self._at(path)
        if not replace and fs.exists(p):
            return False
        # Of several writers of one name, only one renames; the dot keeps listings clean.
        temp = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if replace:
            return self._replace(fs, temp, p)
        if fs.makeQualified(p).toUri().getScheme() == "file":
            # A rename replaces a local file that another writer has just put there; a link does not.
            try:
                os.link(temp.toUri().getPath(), p.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                fs.delete(temp, False)
            return True
        if fs.exists(p) or not fs.rename(temp, p):
            fs.delete(temp, False)
            return False
        return True

    def _replace(self, fs, temp, p) -> bool:
        """Rename over what is there in one step, so that a reader always finds one of the two."""
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        qualified = fs.makeQualified(p)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self._conf).rename(fs.makeQualified(temp), qualified, over)
        return True

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        fs, p = self._at(path)
        return max(0.0, time.time() - fs.getFileStatus(p).getModificationTime() / 1000)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to_fs, to = self._at(target)
        if not to_fs.exists(to):
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, to, False, self._conf)
