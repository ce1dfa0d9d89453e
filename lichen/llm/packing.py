"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are integers up to the capacity, so the whole problem is a table of at most ``capacity`` counts. Sums of one,
two and three lengths are looked up by the gap they fill exactly and consumed as often as the counts allow; what
no combination fills exactly is packed best fit. Every pattern uses up at least one length, so there are never more
than about ``2 * capacity`` patterns: the driver holds those and no row. Pieces find their place by rank: the rank of a
piece among those of its length is a prefix sum over bounded blocks, and its sequence and offset follow from the
pattern that serves this rank.

Defined cases: null text is empty; an empty text, or one without tokens, still has its end id and so one piece; rows
that repeat, doc_id included, are packed once each; a null doc_id stays null; an empty table gives no rows; other
columns than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lichen.llm._shared import plain, stored
from lichen.llm._tokens import word_ids, word_path
from lichen.llm._words import slices

CAPACITY = 2048
END_ID = 0
BLOCK, BLOCKS = 512, 1 << 16


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Texts as token pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, with_ids, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, 8 << 20):
                ids, first = coder.encode(texts[a:b])
                first = first.tolist()
                rows: list[list] = [[], [], [], [], [], []]
                for k, doc in enumerate(batch.column(0)[a:b].to_pylist()):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    for i, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        for column, x in zip(rows, (doc, i, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None), strict=True):
                            column.append(x)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(x, t) for x, t in zip(rows, types, strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = np.concatenate(rows[5]).astype(np.int32)
                    ends = np.cumsum([0, *rows[3]]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return plain(docs).mapInArrow(run, schema)


def _pair(have: np.ndarray, gap: int, least: int = 1) -> tuple[int, int] | None:
    """Two lengths at hand that add up to gap, the larger as large as can be; twice the same needs two of it."""
    a = np.arange(gap - least, (gap + 1) // 2 - 1, -1)
    a = a[a >= least]
    if not len(a):
        return None
    b = gap - a
    good = (have[a] > 0) & (have[b] > 0) & ((a != b) | (have[a] > 1))
    at = int(good.argmax())
    return (int(a[at]), int(b[at])) if good[at] else None


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences) that use up ``counts``: single, pair and triple
    complements first, from the longest length down, then best fit for what is left."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    out: list[tuple[list[int], int]] = []

    def take(parts: list[int]) -> None:
        used = np.bincount(parts, minlength=capacity + 1)
        at = np.flatnonzero(used)
        times = int((have[at] // used[at]).min())
        have[at] -= times * used[at]
        out.append((parts, times))

    if have[capacity]:
        take([capacity])
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        have_one = lambda parts: all(have[p] >= parts.count(p) for p in parts)
        while have[length]:
            if have_one([length, gap]):
                take([length, gap])
                continue
            have[length] -= 1  # the one to complete
            found = _pair(have, gap)
            third = None
            if found is None:
                for c in np.flatnonzero(have[: gap - 1])[::-1].tolist() if gap > 2 else []:
                    have[c] -= 1
                    pair = _pair(have, gap - c)
                    have[c] += 1
                    if pair:
                        third = [c, *pair]
                        break
            have[length] += 1
            if found is None and third is None:
                break
            take([length, *(found or third)])
    while have.any():
        left, parts = have.copy(), []
        room = capacity
        while room > 0 and (fits := np.flatnonzero(left[: room + 1])).size:
            parts.append(int(fits[-1]))
            left[parts[-1]] -= 1
            room -= parts[-1]
        take(parts)
    return out


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """A rank from 0 within ``key``, in no fixed order. No window or task holds more than a block's rows of one
    key: rows are dealt into at most ``BLOCKS`` blocks by a hash, ranked there, and moved by a prefix sum over the blocks'
    sizes. The hash has the number of the row, ``_row``, so rows with one doc_id, or equal ones, are dealt as others."""
    blocks = F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.greatest(F.lit(1), F.least(F.ceil(F.col("_n") / BLOCK), F.lit(BLOCKS))).cast("long"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    cut = df.join(F.broadcast(sizes), key).withColumn("_block", blocks).drop("_n")
    inside = cut.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_block").orderBy("_row")) - 1)
    per_block = cut.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = per_block.withColumn("_before", F.sum("_c").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(before.drop("_c"), [key, "_block"]).withColumn("_rank", F.col("_r") + F.coalesce("_before", F.lit(0))).drop("_r", "_before", "_block", "_row")


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    The table of lengths that reaches the driver has at most ``capacity`` rows, and the pattern table that is
    broadcast about 6 * capacity.
    """
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count(F.lit(1))).collect()}
    found = patterns(counts, capacity)
    served: dict[int, int] = {}
    slots, first = [], 0
    for lengths, times in found:
        offset = 0
        each: dict[int, list[int]] = {}
        for x in lengths:
            each.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in each.items():
            slots.append((x, served.get(x, 0), len(offsets), first, offsets))
            served[x] = served.get(x, 0) + len(offsets) * times
        first += times
    by: dict[int, tuple] = {}
    for x, rank, per, base, offsets in slots:
        by.setdefault(x, []).append((rank, per, base, offsets))
    table = spark.sparkContext.broadcast({x: (np.array([s[0] for s in v]), np.array([s[1] for s in v]), np.array([s[2] for s in v]), [np.array(s[3]) for s in v]) for x, v in by.items()})
    ranked = _ranked(parts if "_row" in parts.columns else parts.withColumn("_row", F.monotonically_increasing_id()), "length")
    parts = parts.drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                starts, per, base, offsets = table.value[int(length[rows[0]])]
                at = np.searchsorted(starts, rank[rows], "right") - 1
                inner = rank[rows] - starts[at]
                sequence[rows] = base[at] + inner // per[at]
                offset[rows] = [offsets[a][i] for a, i in zip(at.tolist(), (inner % per[at]).tolist(), strict=True)]
            keep = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.select(*parts.columns, "_rank").mapInArrow(run, f"{columns}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """All documents packed: one row a piece, with its place and, with_ids, its ids; ``sequences`` joins them."""
    return place(stored(pieces(docs, path, capacity, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence; a sequence has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; the check sums are taken where the ids are made, so ids need not be shuffled."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_path(), with_ids=False)
