"""Snapshots of a table in parts: a small file says in which version each part lies, and counts once it stands there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """The snapshots of a table below path, whose parts are folders v=<version>/<column>=<value>."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path, column

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def numbers(self) -> list[int]:
        fs, at = self._at(f"{self.path}/_snapshots")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def where(self, number: int | None = None) -> dict[str, int]:
        """The version of each part, of a snapshot or the newest; none where there is none."""
        number = max(self.numbers(), default=None) if number is None else number
        if number is None:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/_snapshots/{number}.json", wholetext=True).collect()))

    def read(self, where: dict[str, int] | None = None) -> DataFrame | None:
        """Rows of some parts, with their part; of the newest snapshot's if none are named. None where there is none."""
        where = self.where() if where is None else where
        out = None
        for v in sorted(set(where.values())):
            own = [f"{self.path}/v={v}/{self.column}={b}" for b, at in where.items() if at == v]
            rows = self.spark.read.option("basePath", f"{self.path}/v={v}").parquet(*own)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def exists(self, version: int, value: str) -> bool:
        fs, at = self._at(f"{self.path}/v={version}/{self.column}={value}")
        return fs.exists(at)

    def commit(self, number: int, where: dict[str, int]) -> None:
        """Writes beside the place and moves it there: the file is whole or not there, and only one writer gets a number."""
        fs, at = self._at(f"{self.path}/_snapshots/{number}.json")
        draft = self._at(f"{self.path}/_snapshots/{number}.json.draft")[1]
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(where).encode()))
        out.close()
        if not fs.rename(draft, at):
            raise OSError(f"{at} is there already")

    def prune(self, kept: list[int]) -> None:
        """Removes other snapshots than kept, and parts that none of those names."""
        fs, root = self._at(self.path)
        named = {(v, b) for n in kept for b, v in self.where(n).items()}
        for n in set(self.numbers()) - set(kept):
            fs.delete(self._at(f"{self.path}/_snapshots/{n}.json")[1], False)
        prefix = f"{self.column}="
        for version in fs.listStatus(root):
            name = version.getPath().getName()
            if not name.startswith("v="):
                continue
            for part in fs.listStatus(version.getPath()):
                value = part.getPath().getName()
                if value.startswith(prefix) and (int(name[2:]), value.removeprefix(prefix)) not in named:
                    fs.delete(part.getPath(), True)
            if not any(v == int(name[2:]) for v, _ in named):
                fs.delete(version.getPath(), True)
