"""Numbered JSON files in a folder that are created whole and once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """The files v1, v2, ... of a folder that driver and executors share; the last is the one in force."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self._conf)

    def path(self, name: str = ""):
        return self._path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, folder=None) -> list[str]:
        """What a folder holds, by default this one; nothing if it is not there."""
        folder = folder or self.path()
        return [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.names() if n.startswith("v") and n.endswith(".json"))

    def read(self, number: int | None = None) -> dict | None:
        """The file of a number, by default the last; null before the first."""
        if number is None:
            number = max(self.numbers(), default=None)
            if number is None:
                return None
        stream = self.fs.open(self.path(f"v{number:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, number: int, content: dict) -> bool:
        """Creates the file whole or, if the number is taken, not at all."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        target, draft = self.path(f"v{number:010d}.json"), self.path(f".{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def delete(self, number: int) -> None:
        self.fs.delete(self.path(f"v{number:010d}.json"), False)
