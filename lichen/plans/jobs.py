"""What runs when: settings, stages that resume, a queue of uploads, and whether there is anything to do.

State is small JSON text kept by Spark in a folder, a version a change, so any store it reaches will do.
"""

from __future__ import annotations

import json
import os
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_known: dict[str, type] = {}
_made: dict[str, Any] = {}


def settings(name: str) -> Callable[[type], type]:
    """Registers a dataclass of settings under a name."""

    def add(kind: type) -> type:
        _known[name] = kind
        return kind

    return add


def load(name: str) -> Any:
    """The one instance of the settings of a name. Whole numbers, texts and decimals can be set by environment variables of their
    names in capitals, tuples of texts by a list with commas."""
    if name not in _made:
        kind = _known[name]
        types, given = get_type_hints(kind), {}
        for f in fields(kind):
            text = os.environ.get(f.name.upper())
            if text is None:
                continue
            if types[f.name] in (int, float, str):
                given[f.name] = types[f.name](text)
            elif types[f.name] == tuple[str, ...]:
                given[f.name] = tuple(p.strip() for p in text.split(",") if p.strip())
        _made[name] = kind(**given)
    return _made[name]


def forget() -> None:
    """The next ``load`` reads the environment again."""
    _made.clear()


class State:
    """A JSON value in a folder. Writing adds a version, so readers see a whole one; older ones go later."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._fs_path):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path)]
        done = lambda n: self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(n for n in found if n.startswith("version=") and done(n))

    def read(self) -> dict:
        versions = self._versions()
        return json.loads(self.spark.read.text(f"{self.folder}/{versions[-1]}", wholetext=True).first()[0]) if versions else {}

    def write(self, value: dict) -> None:
        versions = self._versions()
        n = int(versions[-1].split("=")[1]) + 1 if versions else 0
        self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.text(f"{self.folder}/version={n:08d}")
        for old in versions[:-1]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}"), True)


def run_stages(state: State, stages: Sequence[tuple[str, Callable[[], None]]], start: str | None = None, skip: Sequence[str] = (), now: Callable[[], float] = time.time) -> list[str]:
    """Runs named stages in order and returns those run. A run that was broken off is noted and resumed after its last whole stage; ``start``
    begins at a stage instead; an error is noted and raised."""
    before = state.read()
    resumes = before.get("status") in ("running", "error")
    done = {n for n, s in before.get("stages", {}).items() if s.get("status") == "done"} if resumes else set()
    order = [n for n, _ in stages]
    if start is not None:
        done = set(order[: order.index(start)])
    value = {"status": "running", "started": before.get("started") if resumes else now(), "resumed": resumes, "stages": before.get("stages", {}) if resumes else {}}
    state.write(value)
    ran = []
    for name, f in stages:
        if name in done or name in skip:
            continue
        value["stages"][name] = {"status": "running", "started": now()}
        state.write(value)
        try:
            f()
        except Exception as e:
            value |= {"status": "error", "error": {"stage": name, "message": str(e)}, "finished": now()}
            state.write(value)
            raise
        value["stages"][name] |= {"status": "done", "finished": now()}
        state.write(value)
        ran.append(name)
    state.write(value | {"status": "done", "finished": now()})
    return ran


def nothing_new(before: dict, ends: dict[str, float], hour: float) -> bool:
    """A finished run saw the same ends of the sources in the same hour."""
    return before.get("status") == "done" and before.get("ends") == ends and before.get("hour") == hour


def needed_chunks(index: DataFrame, ends: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(variable, number, frontier) of the chunk files that an advance touches, from an index (variable, source, number, start, end):
    those that hold the newest step and, for each window of hours, the step that leaves it. Files of whole years are kept
    already. The newest chunk is rewritten in place, so it is marked. ``ends`` is (variable, ts)."""
    at = ends.select("variable", F.col("ts").alias("newest"), F.explode(F.array(F.col("ts"), *(F.col("ts") - h * 3600 for h in windows))).alias("t"))
    hit = at.join(index, "variable").where("t BETWEEN start AND `end` AND source <> 'year'")
    return hit.groupBy("variable", "number").agg(F.max(F.col("t") == F.col("newest")).alias("frontier"))


def unneeded_chunks(kept: DataFrame, needed: DataFrame) -> DataFrame:
    """Files kept (variable, number) that nothing needs any more."""
    return kept.join(needed, ["variable", "number"], "left_anti")


def refresh(spark: SparkSession, *paths: str) -> str:
    """Drops what Spark remembers of tables that were replaced, and returns a new tag for those who keep results."""
    for p in paths:
        spark.catalog.refreshByPath(p)
    return f"{time.time_ns():x}"


@dataclass
class Job:
    rows: DataFrame
    status: str = "queued"
    result: str | None = None
    error: str | None = None
    finished: float | None = None


@dataclass
class Queue:
    """Uploads, one after the other: queued, processing, done or error; finished ones are forgotten after ``keep`` seconds."""

    work: Callable[[DataFrame], str]
    most: int = 20
    keep: float = 3600.0
    now: Callable[[], float] = time.monotonic
    jobs: OrderedDict[str, Job] = field(default_factory=OrderedDict)

    def add(self, name: str, rows: DataFrame) -> None:
        if sum(j.status == "queued" for j in self.jobs.values()) >= self.most:
            raise ValueError("too many uploads wait")
        self.jobs[name] = Job(rows)

    def step(self) -> str | None:
        """Works on the oldest that waits; its name, or None."""
        name = next((n for n, j in self.jobs.items() if j.status == "queued"), None)
        if name is None:
            return None
        job = self.jobs[name]
        job.status = "processing"
        try:
            job.result, job.status = self.work(job.rows), "done"
        except Exception as e:  # noqa: BLE001
            job.error, job.status = str(e), "error"
        job.finished = self.now()
        return name

    def forget(self) -> list[str]:
        old = [n for n, j in self.jobs.items() if j.finished is not None and self.now() - j.finished > self.keep]
        for n in old:
            del self.jobs[n]
        return old
