"""Numbered pointer files, each of which is created once, whole, and only if its number is free."""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Pointers:
    """A folder of pointers. Its file system must have a rename that fails if the target exists (as HDFS), or be local."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self._path("")):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if n.isdigit())

    def read(self, n: int) -> dict | None:
        """What pointer n says; None if there is no such pointer."""
        try:
            stream = self.fs.open(self._path(str(n)))
        except Py4JJavaError as problem:
            if "FileNotFound" in str(problem.java_exception):
                return None
            raise
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, n: int, content: dict) -> bool:
        """Create pointer n; False if there is one. It is written beside and then takes the name, so that it is never seen in part."""
        beside = self._path(f"_{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            return self._take(beside, self._path(str(n)))
        finally:
            self.fs.delete(beside, False)

    def _take(self, beside, at) -> bool:
        if self.fs.getUri().getScheme() == "file":
            # a link fails if the name is taken; a local rename would replace it
            try:
                os.link(*(urllib.parse.unquote(p.toUri().getRawPath()) for p in (beside, at)))
            except FileExistsError:
                return False
            return True
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(beside, at, none)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in str(problem.java_exception):
                return False
            raise
        return True

    def drop(self, n: int) -> None:
        self.fs.delete(self._path(str(n)), False)
