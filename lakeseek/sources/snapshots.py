"""Snapshots of a set of tables: numbered versions, each committed by one small file that appears last.

Data files are written first, under names of their own, and never changed. A version is a JSON file that lists what
belongs to it; it is written beside its place and then renamed, so that a reader sees it whole or not at all. Readers
stay with the version they began with. A run that is tried again finds its first commit by its id and does nothing;
two runs that began from one version can't both commit. What no kept version lists is removed by ``clean``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


@dataclass
class Log:
    """The versions under ``path``/versions, in any file system that Spark reaches."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        return home.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def names(self, folder: str) -> list[str]:
        """Names of the files and folders in ``path``/``folder``."""
        fs, at = self._fs()
        home = at(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(home)) if fs.exists(home) else []

    def make(self, folder: str) -> None:
        fs, at = self._fs()
        fs.mkdirs(at(f"{self.path}/{folder}"))

    def remove(self, folder: str) -> None:
        fs, at = self._fs()
        fs.delete(at(f"{self.path}/{folder}"), True)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("versions") if n.endswith(".json")]

    def state(self, version: int | None = None) -> dict:
        """A version's state with ``version`` and ``run``; the latest one if none is named; version 0 is empty."""
        found = self.numbers()
        number = version if version is not None else max(found, default=0)
        if number == 0:
            return {"version": 0, "run": None}
        text = self.spark.read.text(f"{self.path}/versions/{number:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def run(self, run: str) -> dict | None:
        """The version that the run of this id has committed."""
        fs, at = self._fs()
        if not fs.exists(at(f"{self.path}/runs/{run}.json")):
            # the index of runs is written after the version: a run that ended between the two is found in the versions
            last = self.state()
            return last if last["run"] == run else None
        return json.loads(self.spark.read.text(f"{self.path}/runs/{run}.json", wholetext=True).first()[0])

    def _put(self, name: str, text: str) -> None:
        fs, at = self._fs()
        side = at(f"{self.path}/side-{uuid.uuid4().hex}")
        out = fs.create(side, True)
        out.write(bytearray(text.encode()))
        out.close()
        goal = at(f"{self.path}/{name}")
        fs.mkdirs(goal.getParent())
        if fs.exists(goal) or not fs.rename(side, goal):
            fs.delete(side, False)
            raise Conflict(name)

    def commit(self, base: int, run: str, state: dict) -> dict:
        """The version after ``base``; fails if there is one already."""
        told = state | {"version": base + 1, "run": run}
        text = json.dumps(told)
        if max(self.numbers(), default=0) != base:
            raise Conflict(f"version {base} is not the latest one")
        self._put(f"versions/{base + 1:08d}.json", text)
        self._put(f"runs/{run}.json", text)
        return told


def save(log: Log, run: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]) -> dict:
    """Commit ``tables`` (name, rows) together as a new version; tables that aren't named stay as they are.

    Rows may be a function of the tables that stand before them, as this run has written them: what is made from a table
    reads it back instead of making it again.

    All of them are written before the version appears, so no reader ever meets a new registry with an old manifest.
    """
    done = log.run(run)
    if done is not None:
        return done
    base = log.state()
    held = dict(base.get("tables", {}))
    written: dict[str, DataFrame] = {}
    for name, given in tables.items():
        place = f"data/{name}-{uuid.uuid4().hex}"
        rows = given(written) if callable(given) else given
        rows.write.parquet(f"{log.path}/{place}")
        written[name] = log.spark.read.schema(rows.schema).parquet(f"{log.path}/{place}")
        held[name] = {"place": place, "schema": rows.schema.json()}
    return log.commit(base["version"], run, {k: v for k, v in base.items() if k not in ("version", "run")} | {"tables": held})


def load(log: Log, name: str, version: int | None = None) -> DataFrame:
    """The table ``name`` of a version. The plan holds the version's own files: later commits don't change it."""
    from pyspark.sql.types import StructType

    held = log.state(version)["tables"][name]
    return log.spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(f"{log.path}/{held['place']}")


def clean(log: Log, keep: int = 2) -> list[str]:
    """Remove the data that none of the last ``keep`` versions lists, and what killed runs have left. Returns the names removed.

    To be called while no run is under way: a run's files belong to no version until it commits.
    """
    numbers = sorted(log.numbers())[-keep:]
    wanted = {t["place"].split("/")[1] for n in numbers for t in log.state(n).get("tables", {}).values()}
    gone = [f"data/{n}" for n in log.names("data") if n not in wanted] + [n for n in log.names("") if n.startswith("side-")]
    for name in gone:
        log.remove(name)
    for n in log.numbers():
        if n not in numbers:
            log.remove(f"versions/{n:08d}.json")
    return gone
