"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents stand in a shuffled order (by a hash) and form one stream of words, read up to twice and cut into
blocks of equal size. Slot i of the schedule is the golden-ratio point frac(i * phi), mapped through the cumulative
target weights to a source; the slot's rank among its source's slots is the block it takes. So a source gives as many
blocks as the points of the sequence that fall into its share, and each block stands at its point's slot. ``apply`` gives
the readings in the order of their slots.

The schedule has at most ``SLOTS`` slots at any size of the input: a block is the mix's words divided by that, rounded
up. The golden ratio's discrepancy keeps a source within a few blocks (a few in a million of the mix) of its target; what a
source cannot give, because its stream has ended, is not taken. No document passes twice its size.

Prefix sums over documents are taken in two steps over blocks of the hash range, at most ``DOC_PARTS`` a source; a source
with a third of all rows is never in one task. What is sorted in one task is a row per source, per slot, or per block of a source.

Defined cases: null text has size 0; a source without words has target 0; null is a source of its own, the last one;
an empty table gives no rows; further columns are ignored by ``mix`` and kept by ``apply``; repeated rows are
documents of their own, ordered after one another.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lichen.llm._shared import stored

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
SLOTS = 1 << 20
DOC_BLOCK, DOC_PARTS = 4096, 1 << 16
PHI = (math.sqrt(5) - 1) / 2
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, n, source_size, sid, target) from (source, n, source_size), one row a source.

    A target is its weight times a common level, stopped at ``most`` times the size. With sources ordered by
    most * size / weight, those up to some place are stopped; the level shares the rest by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("sid", (F.row_number().over(order) - 1).cast("long"))
    w = w.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    by = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    w = w.withColumn("cap", F.col("source_size") * float(most))
    all_rows = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns({"total": F.sum("source_size").over(all_rows) * share, "stopped": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "free": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))})
    # the level if all before this source are stopped, and no other: it rises up to the true one and falls after it
    level = F.greatest((F.col("total") - F.col("stopped")) / F.col("free"), F.lit(0.0))
    w = w.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("cap"), level)).over(all_rows))
    return w.select("source", "n", "source_size", "sid", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def schedule(per_source: DataFrame, most_slots: int = SLOTS) -> tuple[DataFrame, int]:
    """((sid, rank, slot), words of a block): the source of every slot, and the slot's rank among its source's slots."""
    spark = per_source.sparkSession
    by = Window.orderBy("sid")
    share = F.sum("target").over(by.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shares = per_source.where("target > 0").select("sid", "target", share.alias("to"))
    shares = stored(shares.withColumn("from", F.coalesce(F.lag("to").over(by), F.lit(0.0))), "shares")
    total = shares.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, math.ceil(total / most_slots))
    # a range join with a row a source; the weights are cut into 1024 cells to make it an equal one
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * 1024), F.least(F.floor(F.col("to") * 1024), F.lit(1023)))))
    points = spark.range(math.ceil(total / block)).select(F.col("id").alias("slot"), (F.col("id") * PHI - F.floor(F.col("id") * PHI)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * 1024))
    hit = points.join(cells, "cell").where("x >= `from` AND x < `to`")
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1
    return stored(hit.select("sid", "slot", rank.cast("long").alias("rank")), "schedule"), block


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, most_slots: int = SLOTS) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken, first_slot): one row a row of docs; ``row`` tells equal ones apart if
    given, first_slot is the slot in which its first reading starts, null if none does."""
    return placed(docs, weights, share, most, most_slots).withColumn("first_slot", F.element_at("starts", 1)["slot"]).drop("sid", "starts")


def placed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, most_slots: int = SLOTS) -> DataFrame:
    """As ``mix``, with sid and starts: for each pass, the slot of the block in which that reading starts and the place of its
    first word in the source's stream, null if it isn't read."""
    has_row = "_row" in docs.columns
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"), *([F.col("_row").alias("row")] if has_row else [F.lit(0).cast("long").alias("row")]))
    d = stored(d, "sizes")
    per_source = stored(targets(d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, share, most), "targets")
    slots, block = schedule(per_source, most_slots)

    # documents of a source in hash order: blocks of the hash range, ranked inside, moved by the sizes before
    src = F.broadcast(per_source) if per_source.limit(20_001).count() <= 20_000 else per_source
    d = d.join(src, d["source"].eqNullSafe(per_source["source"]), "left").select("doc_id", "row", "size", "tie", "sid", "n", "source_size", "target")
    key = F.xxhash64(F.lit("mix"), "doc_id", "tie")  # of the contents: row numbers may differ between runs
    d = d.withColumn("key", key).withColumn("part", F.shiftrightunsigned("key", 32) * F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / DOC_BLOCK), F.lit(DOC_PARTS))) / F.lit(2**32))
    d = d.withColumn("part", F.floor("part").cast("long"))
    inside = d.withColumn("o", F.coalesce(F.sum("size").over(Window.partitionBy("sid", "part").orderBy("key", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = d.groupBy("sid", "part").agg(F.sum("size").alias("c"))
    before = before.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = inside.join(before.drop("c"), ["sid", "part"]).withColumn("o", F.col("o") + F.col("before")).drop("before", "part", "key", "tie")
    at = stored(at.withColumn("uid", F.monotonically_increasing_id()), "places")

    spans = at.where("size > 0").select("uid", "sid", "o", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    spans = spans.select("uid", "sid", "pass", (F.col("o") + F.col("pass") * F.col("source_size")).alias("a"), (F.col("o") + F.col("size") + F.col("pass") * F.col("source_size")).alias("b"))
    blocks = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    overlap = F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)
    # as wide as SLOTS: too much to be broadcast, whatever its file's size says
    taken = blocks.join(slots.hint("merge"), ["sid", "rank"]).groupBy("uid").agg(
        F.sum(overlap).cast("long").alias("taken"),
        F.array(*(F.min(F.when((F.col("pass") == p) & (F.col("a") >= F.col("rank") * block), F.struct("slot", F.col("a").alias("word")))) for p in range(most))).alias("starts"),
    )
    return at.join(taken, "uid", "left").select("doc_id", "row", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "sid", "starts")


def apply(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus, with the columns of docs: a row for each reading of a document, whole but for the one document
    of a source where its words end; texts not taken go. Rows are in the order of the schedule: a reading stands at the
    slot of the block in which it starts. n_chars, if there, follows the text."""
    keyed = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "numbered")
    flat = keyed.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"), F.col("_doc.text").alias("text"), "_row")
    taken = placed(flat, **options).where("taken > 0").select(F.col("row").alias("_row"), "size", "taken", "sid", "starts")
    j = keyed.join(taken, "_row").withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    start = F.element_at("starts", (F.col("_pass") + 1).cast("int"))
    j = j.orderBy(start["slot"], "sid", start["word"])
    own = F.least("size", F.col("taken") - F.col("_pass") * F.col("size"))
    # words and the white space before them; only a cut text is taken apart
    cut = F.array_join(F.slice(F.regexp_extract_all("_doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), own.cast("int")), "")
    text = F.when(own < F.col("size"), cut).otherwise(F.col("_doc.text"))
    j = j.withColumn("_text", text)
    pick = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return j.select(*(pick.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix, and the slot at which it does so first."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("row")
