"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

The folder holds two Parquet tables, so that any store Spark reaches can hold it and the committer keeps half-written
files out:
- ``vocabulary``: rank -> id, the most frequent id has rank 0 (ties: smaller id first);
- ``shards``: blocks in ascending doc_id order. A block has the doc_ids and counts of its documents, control bytes (four
  two-bit byte counts each, lowest bits first) and data bytes (each rank in 1 to 4 bytes, lowest first).
Reading looks control bytes up in a table of 256 rows, sums the byte counts, and gathers the bytes with numpy.

Defined cases: null text is empty; an empty text has its end id only; null doc_ids come first; rows that repeat are
stored once each, next to one another; an empty table gives empty tables; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lichen.llm._shared import plain, shared_dir, stored
from lichen.llm._tokens import word_ids, word_path
from lichen.llm._words import slices

END_ID = 1
SHARD_IDS, BLOCK_IDS = 4_000_000, 500_000
_COUNT = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of uint32 numbers."""
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = n - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    bytes4 = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), bytes4[np.arange(4) < n[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers of ``pack_ranks``."""
    n = _COUNT[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    start = np.cumsum(n, dtype=np.int64) - n
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(n > k)
        if not len(at):
            break
        out[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, n, ids) for documents and, after those of a task, (token, count) for its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        kind = "<u2" if max(coder.size, end_id + 1) <= 1 << 16 else "<u4"
        counts = np.zeros(max(coder.size, end_id + 1), np.int64)
        names = ["doc_id", "n", "ids", "token", "count"]
        for batch in batches:
            for a, b in slices(batch.column(1), 8 << 20):
                ids, first = coder.encode(batch.column(1)[a:b])
                counts += np.bincount(ids, minlength=len(counts))
                raw, w = ids.astype(kind).tobytes(), int(kind[2])
                end = np.array([end_id], kind).tobytes()
                own = [raw[w * x : w * y] + end for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                counts[end_id] += b - a
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(first) + 1), pa.array(own, pa.binary()), none.cast(pa.int32()), none], names)
        seen = np.flatnonzero(counts)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen, pa.int32()), pa.array(counts[seen])], names)

    return plain(docs).mapInArrow(run, "doc_id long, n long, ids binary, token int, count long")


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encodes every text once, then writes the files; what the driver sees is a row for each id of the vocabulary."""
    spark = docs.sparkSession
    rows = stored(_encoded(docs, path, end_id), "ids")
    counts = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
    found = sorted(((r["token"], r["count"]) for r in counts.collect()), key=lambda r: (-r[1], r[0]))
    vocabulary = [(rank, token, count) for rank, (token, count) in enumerate(found)]
    spark.createDataFrame(vocabulary, "rank int, id int, count long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    rank_of = np.zeros(1 + max((v[1] for v in vocabulary), default=0), np.uint32)
    for rank, token, _ in vocabulary:
        rank_of[token] = rank
    sent = spark.sparkContext.broadcast(rank_of)
    shards = max(1, -(-sum(v[2] for v in vocabulary) // SHARD_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        own: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ranks = np.concatenate(own)
            control, data = pack_ranks(ranks)
            values = [[shard], [block], [len(ranks)], [list(ids)], [[len(x) for x in own]], [control], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["shard", "block", "n_ids", "doc_ids", "counts", "control", "data"])

        for b in batches:
            for doc, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own.append(sent.value[np.frombuffer(raw, f"<u{len(raw) // n}")])
                ids.append(doc)
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
                    ids, own, size, block = [], [], 0, block + 1
        if own:
            yield flush()

    # the row's number in the stored table tells equal rows apart: many with one doc_id are cut like any others
    docs_only = rows.where("token IS NULL").select("doc_id", "n", "ids").withColumns({"h": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    ordered = docs_only.repartitionByRange(shards, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "n", "ids")
    ordered.mapInArrow(run, "shard int, block int, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary").write.parquet(f"{folder}/shards")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, with_ids, ids) of every document in the files."""
    words = sorted(spark.read.parquet(f"{folder}/vocabulary").select("rank", "id").collect())
    sent = spark.sparkContext.broadcast(np.array([r["id"] for r in words], np.uint32))
    blocks = spark.read.parquet(f"{folder}/shards")
    by = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("shard", "block", "n_ids")
    totals = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # a row a shard in one task; documents of a shard never meet those of another
    totals = totals.withColumn("shard_start", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begin = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(by), F.lit(0))).join(totals, "shard").select("shard", "block", (F.col("shard_start") + F.col("inner")).alias("begin"))
    more = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                shard, block, total, docs, counts, control, data = (c[i].as_py() for c in b.columns)
                ids = sent.value[unpack_ranks(control, data, total)].astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e]) for n, e in zip(counts, ends.tolist(), strict=True)]
                n = len(docs)
                arrays = [pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - counts), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["shard", "block", "doc_id", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    columns = blocks.select("shard", "block", "n_ids", "doc_ids", "counts", "control", "data")
    rows = columns.mapInArrow(run, "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long" + more)
    return rows.join(begin, ["shard", "block"]).select("doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files to the shared folder, reads them back, and returns what was read."""
    folder = f"{shared_dir(spark)}/idfiles-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, word_path())
    return read_ids(spark, folder, with_ids=False)
