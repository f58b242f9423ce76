"""Tables that are written once and read again, in the folder the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once: what is built on it reads a table instead. The table goes with the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


class Versions:
    """Folders below ``root``, of which markers say which are whole and which is the newest.

    A version is written in a folder of its own; then an empty marker, named
    by its number and folder, appears in one step. Readers take the marker of
    the greatest number, the greater folder name of two writers that raced, so
    they see one whole version at any moment; clocks play no part.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _markers(self) -> list[tuple[int, str]]:
        at = self.path(f"{self.root}/markers")
        if not self.system.exists(at):
            return []
        names = [f.getPath().getName() for f in self.system.listStatus(at)]
        return sorted((int(n), name) for n, _, name in (x.partition("-") for x in names))

    def folder(self, name: str) -> str:
        return f"{self.root}/versions/{name}"

    def current(self) -> str | None:
        """The newest whole version's name; None if there is none."""
        markers = self._markers()
        return markers[-1][1] if markers else None

    def publish(self, write) -> str:
        """Let ``write`` fill a new folder, then make it the newest. If it fails, nothing changes."""
        name = uuid.uuid4().hex
        write(self.folder(name))
        number = max((n for n, _ in self._markers()), default=0) + 1
        self.system.createNewFile(self.path(f"{self.root}/markers/{number:019d}-{name}"))
        return name

    def forget(self, keep: int) -> None:
        """Delete all but the newest ``keep`` versions, markers first; their readers must have ended."""
        for number, name in self._markers()[: -max(1, keep)]:
            self.system.delete(self.path(f"{self.root}/markers/{number:019d}-{name}"), False)
            self.system.delete(self.path(self.folder(name)), True)
