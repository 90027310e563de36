"""A folder of numbered commits: each is a JSON file that may not exist yet, put in place whole by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Readers see the last commit or the one before; of two writers of a version one is told that it came too late."""

    def __init__(self, spark: SparkSession, path: str, folders: tuple[str, ...] = ()) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self._conf)
        for folder in ("commits", *folders):
            self.fs.mkdirs(self.at(folder))

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder)))

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("commits") if n[:-5].isdigit())

    def entry(self, version: int) -> dict:
        stream = self.fs.open(self.at(f"commits/{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def head(self, empty: dict) -> dict:
        """The last commit, or ``empty`` as version 0."""
        found = self.versions()
        return self.entry(found[-1]) if found else {"version": 0, **empty}

    def put(self, entry: dict) -> bool:
        """Make ``entry`` the commit of its version; False if there is one already."""
        name, made = self.at(f"commits/{entry['version']:08d}.json"), self.at(f"commits/.{uuid.uuid4().hex}")
        stream = self.fs.create(made, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(self.at("").toUri(), self._conf).rename(made, name, none)
            return True
        except Exception as e:
            self.fs.delete(made, False)
            if self.fs.exists(name):
                return False
            raise e

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
