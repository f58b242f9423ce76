"""Reading a project's folders in parallel: what the sources of all languages share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSourceReader, InputPartition


class Folder(InputPartition):
    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files = folder, files


class FolderReader(DataSourceReader):
    """A folder a partition. ``enter`` and ``wanted`` choose folders and files by name; ``scan`` gives a file's rows as dicts.

    A file that cannot be read, or not be scanned, gives one row of kind ``error``.
    """

    def __init__(self, root: str, fields: dict[str, str], enter: Callable, wanted: Callable, scan: Callable):
        self.root, self.fields, self.enter, self.wanted, self.scan = root, fields, enter, wanted, scan

    def partitions(self) -> list[InputPartition]:
        out = []
        for at, folders, files in os.walk(self.root):
            folders[:] = sorted(d for d in folders if self.enter(d))
            if own := sorted(f for f in files if self.wanted(f)):
                out.append(Folder(os.path.relpath(at, self.root).replace(os.sep, "/"), own))
        return out or [Folder(".", [])]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for name in partition.files:
            base = {"folder": partition.folder, "file": name if partition.folder == "." else f"{partition.folder}/{name}"}
            try:
                with open(os.path.join(self.root, base["file"]), "rb") as f:
                    found = list(self.scan(partition.folder, base["file"], f.read()))
            except Exception as e:
                found = [{"kind": "error", "text": f"{type(e).__name__}: {e}"}]
            for row in found:
                yield tuple((base | row).get(k) for k in self.fields)
