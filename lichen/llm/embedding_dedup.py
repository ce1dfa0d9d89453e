"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Every vector belongs to the cell of its most similar centre. Links across cells are not lost: a vector also visits each
lower-numbered cell A in which a partner can lie. A partner x in A has <x, cA - cC> >= 0 for all centres C, and is within
the angle of the threshold; so the visitor y needs <y, cA - cC> >= -sin(angle) * |cA - cC| for all C, which is tested.
Cells are cut into blocks, and the visitors of a block, if it has any, into chunks; a task multiplies one block with one chunk
and returns numbers of links and a local component, never pairs. A block is sent once for each chunk of its own visitors.
The components of the whole are joined from those.

Equal vectors are compared once, with their number. Only the centres, at most ``CENTRES``, are learned from a sample (bounded, by hash). How many
cells are visited depends on the data: few where vectors cluster; for unrelated directions it nears all of them, and
the work nears that of blocked all-pairs products. It is exact in either case.

Defined cases: vectors null, empty, zero or with null or non-finite components link with nothing and are kept; a null
vec_id has no component (null), no links, and is kept; vectors of different lengths do not link; repeated rows
with one vec_id count each as a link; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.llm._shared import again, components, drop, stored
from lichen.llm._words import Pair
from lichen.llm.vectors import classes, matrix, vectors

THRESHOLD = 0.9
SAMPLE, ROUNDS, CENTRES = 8192, 12, 1024
BLOCK, CHUNK, SLAB = 4096, 16_384, 1024


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # first by the largest component: squares neither overflow nor vanish
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def centres(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of spherical k-means; it starts from rows spread over v."""
    c = v[np.linspace(0, len(v) - 1, min(k, len(v))).astype(int)].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        norm = np.sqrt((sums**2).sum(1))
        full = norm > 1e-12
        c[full] = sums[full] / norm[full, None]
    return c


def visits(v: np.ndarray, c: np.ndarray, threshold: float) -> Pair:
    """(cell of each row, a mask of the lower-numbered cells that it visits)."""
    s = v @ c.T
    home = s.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
    slack = math.sqrt(max(0.0, 1 - threshold**2)) * apart + 1e-9
    # the row's own cell rules out most others; only what is left is held against all centres
    mask = (s - s[np.arange(len(s)), home][:, None] >= -slack[home]) & (np.arange(len(c)) < home[:, None])
    row, cell = np.nonzero(mask)
    for a in range(0, len(row), SLAB):
        r, own = row[a : a + SLAB], cell[a : a + SLAB]
        mask[r, own] = (s[r, own][:, None] - s[r] >= -slack[own]).all(1)
    return home, mask


def block_links(h: np.ndarray, hn: np.ndarray, hid: np.ndarray, v: np.ndarray, vn: np.ndarray, vid: np.ndarray, threshold: float, inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, local root) of the rows of block h and visitors v that link; inner: h's own pairs as well."""
    both, n, ids = (np.concatenate([h, v]), np.concatenate([hn, vn]), np.concatenate([hid, vid])) if inner else (v, vn, vid)
    links_h, links_v = np.zeros(len(h), np.int64), np.zeros(len(both), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(both), SLAB):
        near = both[a : a + SLAB] @ h.T >= threshold
        if inner:
            own = np.arange(a, min(a + SLAB, len(h)))
            near[own - a, own] = False
        r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if len(r):
            kept.append((r + a, c, near[np.ix_(r, c)]))
            # h's own pairs stand in both halves of the product, so each side is counted in its own row
            links_v[r + a] += kept[-1][2] @ hn[c]
            side = (r + a >= len(h)) if inner else np.ones(len(r), bool)
            links_h[c] += n[r + a][side] @ kept[-1][2][side]
    # local components: the smallest id spreads over the links until nothing changes
    root_h, root_v = hid.copy(), ids.copy()
    changed = bool(kept)
    big = np.iinfo(np.int64).max
    while changed:
        before = root_h.sum(), root_v.sum()
        for r, c, near in kept:
            root_v[r] = np.minimum(root_v[r], np.where(near, root_h[c], big).min(1))
            root_h[c] = np.minimum(root_h[c], np.where(near, root_v[r][:, None], big).min(0))
        if inner:
            root_h = root_v[: len(h)] = np.minimum(root_h, root_v[: len(h)])
            root_h = root_h.copy()
        changed = before != (root_h.sum(), root_v.sum())
    if inner:
        links_v[: len(h)] += links_h
        return ids, links_v, root_v
    return np.concatenate([hid, ids]), np.concatenate([links_h, links_v]), np.concatenate([root_h, root_v])


def near_vectors(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a row of df."""
    spark = df.sparkSession
    rows = vectors(df)
    distinct = stored(classes(rows).select("rep", "n", "v", F.size("v").alias("d")), "vectors")
    counts = {r["d"]: r["count"] for r in distinct.groupBy("d").count().collect()}
    learned, first = {}, 0
    for d, n in sorted(counts.items()):
        got = distinct.where(F.col("d") == d).orderBy(F.xxhash64("rep", F.lit("centre")), "rep").limit(SAMPLE).select("v").toArrow()
        c = centres(unit(matrix(got.column("v"))), min(CENTRES, max(1, round(math.sqrt(n) / 16))))
        learned[d] = (c, first)
        first += len(c)
    sent = spark.sparkContext.broadcast(learned)
    kind = distinct.schema["v"].dataType.simpleString()

    def assign(batches):  # noqa: ANN001, ANN202
        for b in batches:
            d = b.column(3).to_numpy()
            for each in np.unique(d).tolist():
                own = b.filter(pa.array(d == each))
                c, base = sent.value[each]
                home, mask = visits(unit(matrix(own.column(2))), c, threshold)
                to = [(np.flatnonzero(m) + base).tolist() for m in mask]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(home + base, pa.int32()), pa.array(to, pa.list_(pa.int32()))], ["rep", "n", "v", "cell", "visits"])

    cells = stored(distinct.select("rep", "n", "v", "d").mapInArrow(assign, f"rep long, n long, v {kind}, cell int, visits array<int>"), "cells")
    size = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    size = F.broadcast(stored(size, "blocks"))  # a row a cell: CENTRES for each length of vectors
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    other = again(cells)
    later = other.join(size, "cell").withColumn("block", block).where("block + 1 < blocks").select("cell", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), "rep", "n", "v")
    guests = other.select(F.explode("visits").alias("cell"), "rep", "n", "v").join(size, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "n", "v")
    visitors = later.unionByName(guests)
    chunks = stored(visitors.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "chunks")
    sent_to = lambda rows: rows.join(chunks, ["cell", "block"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    left = sent_to(cells.join(size, "cell").select("cell", block, "rep", "n", "v")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = sent_to(visitors).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int")).drop("chunks")

    def compare(key: tuple, home: pa.Table, other: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], pa.int64()) for n in ("rep", "links", "root")})
        if not len(home):
            return none
        get = lambda t: (unit(matrix(t.column("v"))) if len(t) else np.empty((0, len(home.column("v")[0]))), t.column("n").to_numpy().astype(np.int64), t.column("rep").to_numpy().astype(np.int64))
        ids, links, root = block_links(*get(home), *get(other), threshold, key[2].as_py() == 0)
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some], "root": root[some]})

    found = left.groupBy("cell", "block", "chunk").cogroup(right.groupBy("cell", "block", "chunk")).applyInArrow(compare, "rep long, links long, root long")
    found = stored(found, "links")
    drop(cells)
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = distinct.join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    whole = whole.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    by_id = rows.join(whole, "v").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("c").alias("c")).withColumnRenamed("vec_id", "id")
    out = df.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_id, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors with a cosine of 0.9 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS len FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.len > 0 AND b.len > 0 AND list_inner_product(a.v, b.v) >= 0.9 * a.len * b.len),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
k AS (SELECT x, count(*) AS k FROM links GROUP BY x)
SELECT e.vec_id, coalesce(k.k, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM e JOIN c ON e.vec_id = c.x LEFT JOIN k ON e.vec_id = k.x
"""
