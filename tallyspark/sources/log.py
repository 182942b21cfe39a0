"""A log of numbered entries in a shared folder, one order for all writers."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass
class NumberedLog:
    """``log/<n>.json`` under a folder on a file system with an atomic rename (HDFS), or on a local one in tests.

    An entry exists once its file has been put under the next number, which fails where that number is taken.
    """

    spark: SparkSession
    root: str
    entries: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._jvm = self.spark.sparkContext._jvm
        self._conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        for folder in ("log", "staged", "bodies"):
            self._fs.mkdirs(self._path(folder))

    def _path(self, at: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}".rstrip("/"))

    def read(self) -> list[dict]:
        """All entries, those not read before being added; they never change."""
        while self._fs.exists(at := self._path(f"log/{len(self.entries):08d}.json")):
            stream = self._fs.open(at)
            try:
                self.entries.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return self.entries

    def put(self, entry: dict) -> bool:
        """Add an entry after those that have been read. False where another writer has been first."""
        staged, target = self._path(f"staged/{uuid.uuid4().hex}.json"), self._path(f"log/{len(self.entries):08d}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename may replace; a hard link never does
                nio = self._jvm.java.nio.file
                nio.Files.createLink(*(nio.Paths.get(self._jvm.java.net.URI(f"file://{p.toUri().getPath()}")) for p in (target, staged)))
                self._fs.delete(staged, False)
            else:
                rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                none = self.spark.sparkContext._gateway.new_array(rename, 1)
                none[0] = rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self._conf).rename(staged, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(staged, False)
            return False
        self.entries.append(entry)
        return True
