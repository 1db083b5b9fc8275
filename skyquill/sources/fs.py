"""The Hadoop file system of a path: local disks and object stores alike."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class FileSystem:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, relative: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}" if relative else self.root)

    def exists(self, relative: str) -> bool:
        return self.fs.exists(self.path(relative))

    def names(self, relative: str) -> list[str]:
        at = self.path(relative)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def files(self, relative: str = "") -> list[tuple[str, int, int]]:
        """(path below the root, bytes, modified ms) of all files, whole folders deep."""
        top, out = self.path(relative), []
        if not self.fs.exists(top):
            return out
        base = self.fs.makeQualified(self.path("")).toUri().getPath().rstrip("/") + "/"
        walk = self.fs.listFiles(top, True)
        while walk.hasNext():
            s = walk.next()
            out.append((s.getPath().toUri().getPath().removeprefix(base), s.getLen(), s.getModificationTime()))
        return out

    def read(self, relative: str) -> str:
        stream = self.fs.open(self.path(relative))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, relative: str, text: str, overwrite: bool = False) -> bool:
        """False if the file is there: of several writers of one name, one succeeds.

        The text is written aside and moved, so no reader sees a part of it. Where a move can replace a file (some stores), the name is
        taken first by an exclusive creation; a reader that meets a file without its last line end knows that it is not whole.
        """
        target = self.path(relative)
        if not overwrite and self.fs.exists(target):
            return False
        aside = self.path(f"{relative.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        context = self.jvm.org.apache.hadoop.fs.FileContext
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if overwrite else self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(aside), self.fs.makeQualified(target), options)
            return True
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            if "UnsupportedFileSystem" not in str(error):
                raise
        finally:
            self.fs.delete(aside, False)
        return self._create_in_place(target, text, overwrite)

    def _create_in_place(self, target, text: str, overwrite: bool) -> bool:
        try:
            stream = self.fs.create(target, overwrite)
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def move(self, source: str, target: str) -> None:
        to = self.path(target)
        self.fs.mkdirs(to.getParent())
        if not self.fs.rename(self.path(source), to):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, relative: str) -> bool:
        return self.fs.delete(self.path(relative), True)
