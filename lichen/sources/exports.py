"""Exports of other services: which are due, what archives and databases hold, and grids of arrays.

Requests go out from elsewhere: these functions decide from the answers, and read what was landed in a shared folder.
"""

from __future__ import annotations

import csv
import io
import sqlite3
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States of an export that can't be used any more.
DEAD = ("FAILED", "KILLED", "CANCELLED")


def last_finished(history: DataFrame) -> DataFrame:
    """(stamp) of the first run, by ``place``, that ended normally and says when; no row if none did."""
    done = history.where((F.col("finish_reason") == "NORMAL") & (F.coalesce("finished", F.lit("")) != ""))
    return done.orderBy("place").limit(1).select(F.col("finished").alias("stamp"))


def due(kept: DataFrame, stamp: Column) -> DataFrame:
    """(export) of the kept (export, stamp) that are of another run than ``stamp``."""
    return kept.where(~F.col("stamp").eqNullSafe(stamp)).select("export")


def reusable(requests: DataFrame, form: str, roots: Sequence[str], checklist: str, located: bool) -> DataFrame:
    """(key) of the request to wait for rather than make again, from requests (place, key, status, form, roots, checklist,
    located) with the newest first: the same content, not dead; one that is ready comes before one in preparation."""
    same = (F.col("form") == form) & (F.array_sort("roots") == F.lit(sorted(roots))) & (F.col("checklist") == checklist) & (F.col("located") == F.lit(located))
    usable = requests.where(same & ~F.col("status").isin(*DEAD))
    return usable.orderBy(F.col("status") != "SUCCEEDED", "place").limit(1).select("key")


def opens(content: bytes, member: str) -> bool:
    """An archive is whole: its member can be opened and read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
            while f.read(1 << 20):
                pass
        return True
    except (zipfile.BadZipFile, KeyError, EOFError, OSError):
        return False


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of archives; one is held whole, so they are at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_rows(spark: SparkSession, path: str, begins: str, columns: list[str], separator: str = ",") -> DataFrame:
    """(file, row, columns as text) of every member whose name begins so and ends in .csv; ``row`` counts within the member. Members
    are read as a stream, a few thousand rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if n.startswith(begins) and n.endswith(".csv")):
                        with io.TextIOWrapper(z.open(member), encoding="utf-8", newline="") as f:
                            batch: list[tuple] = []
                            for i, r in enumerate(csv.DictReader(f, delimiter=separator)):
                                batch.append((member, i, *(r.get(c) for c in columns)))
                                if len(batch) == 4096:
                                    yield pd.DataFrame(batch, columns=["file", "row", *columns])
                                    batch = []
                            if batch:
                                yield pd.DataFrame(batch, columns=["file", "row", *columns])

    return archives(spark, path).select("content").mapInPandas(run, "file string, row long, " + ", ".join(f"`{c}` string" for c in columns))


def english_names(rows: DataFrame) -> DataFrame:
    """(id, names): a taxon's distinct English names in the order they are met, from (file, row, id, vernacularName, language)."""
    t = rows.select("file", "row", F.trim("id").alias("id"), F.trim("vernacularName").alias("name"), F.lower(F.trim("language")).alias("language"))
    t = t.where("id <> '' AND name <> '' AND language IN ('en', 'eng')")
    once = t.groupBy("id", "name").agg(F.min(F.struct("file", "row")).alias("at"))
    return once.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("n")).select("id", F.transform("n", lambda x: x["name"]).alias("names"))


def place_table(path: str, level: int) -> str:
    """The feature table of a geographic database that names the places of a level."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        tables = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features'")]
        for t in tables:
            if {f"GID_{level}", f"NAME_{level}"} <= {r[1] for r in db.execute(f'PRAGMA table_info("{t}")')}:
                return t
    raise ValueError(f"no table names places of level {level}")


def places(spark: SparkSession, path: str, level: int, names: dict[str, str] | None = None, parts: int = 8) -> DataFrame:
    """(gid, name) of the distinct places of a level; ``names`` replaces names by gid. The file is sent to the executors once, and
    each task reads a range of row numbers; geometries stay where they are."""
    table = place_table(path, level)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        last = db.execute(f'SELECT coalesce(max(rowid), 0) FROM "{table}"').fetchone()[0]
    spark.sparkContext.addFile(path)
    file = path.rsplit("/", 1)[-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"]:
                with sqlite3.connect(f"file:{SparkFiles.get(file)}?mode=ro", uri=True) as db:
                    found = db.execute(f'SELECT "GID_{level}", "NAME_{level}" FROM "{table}" WHERE rowid > ? AND rowid <= ?', (int(k) * last // parts, (int(k) + 1) * last // parts))
                    while rows := found.fetchmany(4096):
                        yield pd.DataFrame(rows, columns=["gid", "name"])

    rows = spark.range(0, parts, 1, parts).mapInPandas(run, "gid string, name string").distinct()
    if not names:
        return rows
    own = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return rows.select("gid", F.coalesce(own[F.col("gid")], F.col("name")).alias("name")).distinct()


def grids(spark: SparkSession, path: str, first: Column | None = None) -> DataFrame:
    """(path, row, col, step, value) of arrays (row, col, step) in .npy files, without what isn't finite. A file is a chunk of a few
    hundred megabytes at most, and a task yields a row of its grid at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                for i in range(a.shape[0]):
                    good = np.isfinite(a[i])
                    col, step = np.nonzero(good)
                    yield pd.DataFrame({"path": name, "row": np.full(len(col), i), "col": col, "step": step, "value": a[i][good].astype(float)})

    out = archives(spark, path).mapInPandas(run, "path string, row long, col long, step long, value double")
    return out if first is None else out.withColumn("step", F.col("step") + first)


def first_existing(base: str, extra: Sequence[str], name: str, there: Sequence[str]) -> str:
    """Where a layer's file lies: in the base folder, else the first of the extra ones that has it, else the base's place for it."""
    candidates = [f"{d.rstrip('/')}/{name}" for d in (base, *extra)]
    return next((c for c in candidates if c in set(there)), candidates[0])
