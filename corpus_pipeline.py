"""A training corpus from documents: one stage after the other, each one's table the next one's input.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last one returns the pieces of
the packed sequences (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A document that the mix reads twice
is packed twice, under the same doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.llm import line_dedup, minhash_dedup, mixing, packing, toxicity
from lichen.llm._shared import drop, scratch, ship, stored
from lichen.llm._tokens import word_path


def _quoted(docs: DataFrame) -> list[str]:
    """The columns of docs, whatever their names hold."""
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under a half stay; a model is learned from the labelled ones of these documents."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go; n_chars follows the text."""
    ship(spark)
    out = line_dedup.dedup_lines(docs).select(_quoted(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, the one with the smallest doc_id. Near is a similarity of 0.8
    of five-word shingles. Documents without an id stay."""
    ship(spark)
    gone = stored(minhash_dedup.near_duplicates(docs, k=5, percent=80), "near").where("NOT kept").select(F.col("doc_id").alias("_gone"), F.lit(0).cast("long").alias("_none")).distinct()
    # rows without an id match nothing; their texts deal them over the tasks
    none = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(F.lit(0).cast("long"))
    return docs.join(gone.hint("shuffle_hash"), (docs["doc_id"].cast("long") == gone["_gone"]) & (none == gone["_none"]), "left_anti").select(_quoted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each reading of a document."""
    ship(spark)
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their places."""
    ship(spark)
    return packing.pack(docs, word_path(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # tested against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table in the shared folder, read by the next and then deleted."""
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, f) in enumerate(STAGES[:-1]):
        with scratch(f"stage-{i}-"):  # what a stage stores on its way goes with it
            docs = stored(f(spark, docs, sf_dir), f"stage-{i}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
