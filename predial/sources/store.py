"""A versioned store of tables: readers see whole versions only, and a writer that dies leaves the last one in place.

Each version is a folder of its own with a Parquet table per name, written first. A small commit file with the version's
number then makes it the latest; it is created only where none of that number exists, so of two writers one fails. What
has no commit, or a torn one, is never read and goes at the next clean-up.
"""

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import shared_folder


class Store:
    """Tables under ``root``; ``Store.scratch(spark)`` takes a new folder in spark.checkpoint.dir."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def scratch(cls, spark: SparkSession) -> "Store":
        return cls(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [f.getPath().getName() for f in self.files.listStatus(where)] if self.files.exists(where) else []

    def _read_commit(self, name: str) -> dict | None:
        stream = self.files.open(self._path(f"commits/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None  # torn: its writer died
        finally:
            stream.close()

    def commits(self) -> dict[int, dict]:
        """All versions by number: folder, tables, epoch and counts."""
        found = {int(n[:-5]): self._read_commit(n) for n in self._names("commits") if re.fullmatch(r"\d+\.json", n)}
        return {n: c for n, c in sorted(found.items()) if c}

    def write(self, tables: dict[str, DataFrame], epoch: int | None = None, counts: dict | None = None) -> int:
        """Write the tables as a new version and make it the latest; the number of the version.

        With an ``epoch`` that some version has already nothing is written. ``counts`` are kept with the version.
        """
        before = self.commits()
        if epoch is not None and (done := [n for n, c in before.items() if c["epoch"] == epoch]):
            return done[-1]
        number = max([int(n[:-5]) for n in self._names("commits") if re.fullmatch(r"\d+\.json", n)], default=0) + 1
        folder = f"version-{number}-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{self.root}/{folder}/{name}")
        self.commit(number, {"folder": folder, "tables": sorted(tables), "epoch": epoch, "counts": counts or {}})
        return number

    def commit(self, number: int, entry: dict) -> None:
        out = self.files.create(self._path(f"commits/{number}.json"), False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of the latest version, or of the given one."""
        found = self.commits()
        if not found:
            raise ValueError(f"no version in {self.root}")
        entry = found[max(found) if version is None else version]
        return self.spark.read.parquet(f"{self.root}/{entry['folder']}/{table}")

    def clean(self, keep: int = 2) -> list[str]:
        """Delete all versions but the last ``keep``, and what dead writers left; the deleted folders."""
        found = self.commits()
        stay = {c["folder"] for c in list(found.values())[-keep:]}
        gone = [n for n in self._names("") if n.startswith("version-") and n not in stay]
        for n in list(found)[:-keep]:
            self.files.delete(self._path(f"commits/{n}.json"), False)
        for name in gone:
            self.files.delete(self._path(name), True)
        return gone
