"""Stored tables in versions: a replace is seen whole or not at all.

Below a table's folder, each load writes a folder of its own, ``version-<id>``.
When it is complete, one small file in ``_pointers`` names it; the highest
number is the current version. The file is written aside and renamed to a
number that must not exist yet, so that of two loads that end together one takes
the next number, and nobody reads half a pointer. A load that fails or is killed
leaves a folder without a pointer: readers never see it, and a later load
removes it. The version before the current one stays for readers that have
begun.

Everything goes through the file system that Spark uses for the folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

POINTERS, PREFIX = "_pointers", "version-"
#: Versions that stay, the current one among them; seconds after which a folder without a pointer counts as left over.
KEPT, GRACE = 2, 24 * 3600.0


class Versions:
    """The versions of one stored table."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self.root = root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._hadoop, self._conf = hadoop, spark._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(self.root).getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _listed(self, *parts: str) -> list[tuple[str, float]]:
        """Names and times of change, in seconds, of what lies in a folder; none if it is absent."""
        path = self._path(*parts) if parts else self._hadoop.Path(self.root)
        if not self._fs.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(path)]

    def _numbers(self) -> list[int]:
        return sorted(int(name) for name, _ in self._listed(POINTERS) if name.isdigit())

    def _read(self, number: int) -> dict[str, Any]:
        stream = self._fs.open(self._path(POINTERS, f"{number:010d}"))
        try:
            return json.loads(self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict[str, Any] | None:
        """What the current pointer tells: the folder's name, and what the load said of it."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else None

    def folder(self) -> str | None:
        """The folder of the current version."""
        now = self.current()
        return None if now is None else f"{self.root}/{now['folder']}"

    def replace(self, write: Callable[[str], dict[str, Any] | None]) -> str:
        """Let ``write`` fill a new folder, then make that the current version; returns its path."""
        name = f"{PREFIX}{uuid.uuid4().hex}"
        told = write(f"{self.root}/{name}") or {}
        self._point({"folder": name, **told})
        self.clean()
        return f"{self.root}/{name}"

    def _point(self, told: dict[str, Any]) -> None:
        aside = self._path(POINTERS, f".{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        # No option to overwrite: the rename fails if another load took the number.
        none = self._spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        for _ in range(100):
            number = (self._numbers() or [0])[-1] + 1
            try:
                context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(POINTERS, f"{number:010d}")), none)
                return
            except Exception as error:
                if "FileAlreadyExistsException" not in str(error):
                    raise
        raise RuntimeError(f"no free version of {self.root}")

    def clean(self, kept: int = KEPT, grace: float = GRACE) -> list[str]:
        """Remove old versions and left-over folders; returns what was removed.

        Folders that no pointer names may belong to a load under way, and stay
        until they are older than ``grace`` seconds. What lay in the table's
        folder before it had versions goes with the first of them.
        """
        numbers = self._numbers()
        named = {n: self._read(n)["folder"] for n in numbers}
        stays = {named[n] for n in numbers[-kept:]}
        gone = []
        for name, changed in self._listed():
            if name == POINTERS or name in stays:
                continue
            if name in named.values() or not name.startswith(PREFIX) or time.time() - changed >= grace:
                self._fs.delete(self._path(name), True)
                gone.append(name)
        # Last, so that a pointer never outlives its folder unnoticed by a second clean-up.
        for n in numbers[:-kept]:
            self._fs.delete(self._path(POINTERS, f"{n:010d}"), False)
        return gone


def resolved(spark: SparkSession, path: str) -> str:
    """The folder of the current version of a table, or the path itself if it has no versions."""
    return Versions(spark, path).folder() or path


def removed(spark: SparkSession, path: str) -> bool:
    """Remove a folder that this library wrote; whether it was there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
