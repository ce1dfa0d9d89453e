"""Tables in the folder that driver and executors share, and connected components on them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lichen.sources.session import ship

__all__ = ["again", "components", "drop", "plain", "reading", "scratch", "shared_dir", "ship", "stored"]

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a temporary folder on one machine (tests), and an error on
    a cluster, whose executors would not share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="lichen-")
    return f"file://{own}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here, so a lost
    executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = reading(spark, path, df.schema)
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but those whose names begin with one of ``keep``."""
    token = _made.set([])
    try:
        yield
    finally:
        made, outer = _made.get(), token.old_value
        _made.reset(token)
        kept = [t for t in made if keep and t.stored_at.rsplit("/", 1)[-1].startswith(keep)]
        safe = {t.stored_at for t in kept}
        drop(*(t for t in made if t.stored_at not in safe))
        if isinstance(outer, list):
            outer.extend(kept)


def reading(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def again(table: DataFrame) -> DataFrame:
    """The same stored table as a source of its own, so that both can meet in one plan without ambiguous columns."""
    return reading(table.sparkSession, table.stored_at, table.schema)


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text only: further columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each keeps the components, halves the depth of chains, and
    needs two aggregations and two joins. The edges of every round are a table in the shared folder. Nodes
    without edges are not in the result; null ends and loops are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        next_e = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a node whose least neighbour isn't its only one keeps its own edge as well: the first branch has it, for v = m
        next_e = stored(next_e.where("u <> v").distinct(), "edges")
        drop(e)
        e = next_e
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
