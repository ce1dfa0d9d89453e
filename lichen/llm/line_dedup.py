"""Line deduplication through a sharded minimal perfect hash.

Every line's key is hashed to 128 bits. Each distinct line hash is dealt, with the number of different documents that hold
it, into a shard, and a shard becomes one row of arrays: the bit levels of a minimal perfect hash over its keys (every level
keeps the keys that are alone in their place), and, at a key's number, 16 bits of fingerprint and its document count;
for frequent keys, in the order of their numbers, the largest doc_id. Documents send line hashes, never lines, to
the shard's arrays: a probe computes a number, compares the fingerprint, reads the count and decides. What comes back is only
what is to be dropped. A shard with many probes is probed in as many parts as it needs, each with a copy of its arrays; the
other shards are sent once.

Defined cases: null or empty text is one empty line; a null doc_id counts as one document, smaller than all others; rows
with the same doc_id are one document where documents are counted, and each is a row of the result that loses the same lines;
an empty table gives no rows; further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lichen.llm._shared import drop, plain, stored
from lichen.llm._words import mix, slices

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS, PROBE_ROWS = 100_000, 200_000
_STRIP = b" \t\n\x0b\x0c\r"


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower: A-Z only


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t, h1, h2) for each different long key of each row; t is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, own_hash = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            for a, b in slices(batch.column(1), 8 << 20):
                keys: list[bytes] = []
                counts = []
                for text in texts[a:b].to_pylist():
                    own = {k for k in map(_key, text.split(b"\n")) if _long(k, min_chars)}
                    keys += own
                    counts.append(len(own))
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype(np.int64).reshape(-1, 2)
                row = pa.array(np.repeat(np.arange(b - a), counts))
                yield pa.RecordBatch.from_arrays([ids[a:b].take(row), own_hash[a:b].take(row), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "t", "h1", "h2"])

    return plain(docs).withColumn("t", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, h1 long, h2 long")


def perfect_hash(keys: np.ndarray) -> tuple[bytes, list[int], np.ndarray]:
    """(bits of all levels, bits of each, number of each key): a minimal perfect hash of distinct uint64 keys."""
    levels, sizes = [], []
    number = np.zeros(len(keys), np.int64)
    left, base = np.arange(len(keys)), 0
    while len(left):
        size = -(-max(64, 2 * len(left)) // 8) * 8
        at = (mix(keys[left] + np.uint64(len(sizes) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        good = alone[at]
        number[left[good]] = base + rank[at[good]]
        base += int(good.sum())
        levels.append(np.packbits(alone).tobytes())
        sizes.append(size)
        left = left[~good]
    return b"".join(levels), sizes, number


def numbers(bits: bytes, sizes: list[int], keys: np.ndarray) -> np.ndarray:
    """The number of each key under a perfect hash, -1 where no level has it; a foreign key may get any number."""
    out = np.full(len(keys), -1, np.int64)
    left, base, start = np.arange(len(keys)), 0, 0
    for level, size in enumerate(sizes):
        alone = np.unpackbits(np.frombuffer(bits, np.uint8, size // 8, start)).astype(bool)
        at = (mix(keys[left] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)
        good = alone[at]
        rank = np.cumsum(alone)
        out[left[good]] = base + rank[at[good]] - 1
        base += int(rank[-1])
        left, start = left[~good], start + size // 8
        if not len(left):
            break
    return out


_INDEX = "shard long, bits binary, sizes array<long>, fingerprints binary, counts binary, last binary"


def _mixed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the hash, fingerprints): equal first halves are told apart by the second, both go in as one mixed key."""
    h2 = table.column("h2").to_numpy().view(np.uint64)
    return mix(table.column("h1").to_numpy().view(np.uint64) ^ mix(h2)), (h2 >> np.uint64(48)).astype(np.uint16)


def _build(table: pa.Table, min_docs: int) -> pa.Table:
    """One shard's arrays from its distinct (h1, h2, n, last)."""
    keys, prints = _mixed(table)
    bits, sizes, number = perfect_hash(keys)
    fingerprints, counts, last = np.empty(len(keys), np.uint16), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
    fingerprints[number] = prints
    counts[number] = np.minimum(table.column("n").to_numpy(), 2**32 - 1)
    last[number] = table.column("last").to_numpy()
    arrays = [fingerprints.tobytes(), counts.tobytes(), last[counts >= min_docs].tobytes()]
    return pa.table([pa.array(table.column("shard").to_pylist()[:1], pa.int64()), pa.array([bits]), pa.array([sizes], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in arrays)], ["shard", "bits", "sizes", "fingerprints", "counts", "last"])


_NONE = -(2**63)


def _probe(lines: pa.Table, index: pa.Table, min_docs: int) -> pa.Table:
    """The lines that a document loses, decided by the arrays of the lines' shard."""
    out = lines.select(["doc_id", "t", "h1", "h2"])
    if not len(index) or not len(lines):
        return out.slice(0, 0)
    row = {n: index.column(n)[0].as_py() for n in ("bits", "sizes", "fingerprints", "counts", "last")}
    keys, prints = _mixed(lines)
    at = numbers(row["bits"], row["sizes"], keys)
    often = np.frombuffer(row["counts"], np.uint32) >= min_docs
    known = at >= 0
    known[known] = np.frombuffer(row["fingerprints"], np.uint16)[at[known]] == prints[known]
    known[known] = often[at[known]]
    place = np.cumsum(often) - 1
    doc = lines.column("doc_id").fill_null(_NONE).to_numpy()
    known[known] = np.frombuffer(row["last"], np.int64)[place[at[known]]] != doc[known]
    return out.filter(pa.array(known))


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, t, h1, h2) of the keys that a document's text, of hash t, loses."""
    lines = stored(line_hashes(docs, min_chars), "lines")
    held = F.coalesce("doc_id", F.lit(_NONE))
    distinct = stored(lines.groupBy("h1", "h2").agg(F.count_distinct(held).alias("n"), F.max(held).alias("last")), "distinct")
    shards = max(1, -(-distinct.count() // SHARD_KEYS))
    shard = F.pmod(F.col("h1"), F.lit(shards).cast("long")).alias("shard")
    index = stored(distinct.select(shard, "h1", "h2", "n", "last").groupBy("shard").applyInArrow(lambda table: _build(table, min_docs), _INDEX), "index")
    drop(distinct)
    # only a shard that many lines probe gets more parts; a row a shard, broadcast while there are few
    parts = stored(lines.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / PROBE_ROWS).cast("int").alias("parts")), "parts")
    known = F.broadcast(parts) if shards <= 100_000 else parts
    copies = index.join(known, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    sent = lines.withColumn("shard", shard).join(known, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "t"), F.col("parts")).cast("int")).drop("parts")
    return sent.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(lambda a, b: _probe(a, b, min_docs), "doc_id long, t long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines left in ``text``; n_lines and n_dropped come after the columns of docs."""
    # by document and text, not by document alone: rows of one doc_id, or without one, need not meet in one task
    lost = drops(docs, min_chars, min_docs).groupBy(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.col("t").alias("of")).agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    others = [f for f in docs.schema.fields if f.name != "text"]
    row = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)])
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    packed = docs.select(F.struct(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(others))).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = packed.join(lost.hint("shuffle_hash"), (F.col("doc") == F.col("id")) & (F.xxhash64("text") == F.col("of")), "left")
    joined = joined.select("row", "text", F.col("lost.h1").alias("h1"), F.col("lost.h2").alias("h2"))
    schema = T.StructType([T.StructField("row", row), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out, total, gone = [], [], []
            for text, h1, h2 in zip(texts.to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n, k = text.count(b"\n") + 1, 0
                if h1:
                    want = set(zip(h1, h2, strict=True))
                    kept = []
                    for line in text.split(b"\n"):
                        key = _key(line)
                        if _long(key, min_chars):
                            d = xxhash.xxh3_128_digest(key)
                            if (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) in want:
                                k += 1
                                continue
                        kept.append(line)
                    text = b"\n".join(kept)  # noqa: PLW2901
                out.append(text)
                total.append(n)
                gone.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    done = joined.mapInArrow(run, schema)
    names = iter(range(len(others)))
    back = [F.col("text") if f.name == "text" else F.col(f"row.c{next(names)}").alias(f.name) for f in docs.schema.fields]
    return done.select(*back, "n_lines", "n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines dropped, and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, o.k IS NOT NULL AND l.doc_id <> o.last AS gone FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
