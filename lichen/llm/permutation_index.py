"""Approximate nearest neighbours by a permutation index.

A vector is represented by its pivots in order of nearness, the first ``prefix`` of them. The index is built once, as a stored
table with a row a shard: the shard's vectors and its pivot inverted files (for each pivot, the vectors that have it
and the place it has with each). A query walks the files of its own ``asked_prefix`` nearest pivots, and no others, which sums the footrule distance
to the posted vectors; the nearest ``share`` of the shard, and no fewer than the results wanted, is reranked by the exact inner product, and so is every vector
whose footrule is within a quarter of the largest possible, so that near copies of a query, however many, are all told
apart exactly. Shards are merged. They are cut by a hash of the vector, so a group of near copies is dealt evenly. Equal vectors
are indexed once, with as many of their smallest ids as a result can hold. Small tables take the same way.

Inner products are made distances by one more component, sqrt(M**2 - |v|**2) for vectors, 0 for queries (scaled to
length M, the largest norm): then the pivots see the norms as well. For unit vectors it is 0.

Bounds: ``pivots`` vectors are taken from a sample of eight times as many, by hash, near copies of a pivot left out (the
index holds every row). Work is in proportion to vectors times queries; a query touches ``asked_prefix / pivots`` of the postings.
Recall against brute force is in the README and tested.

Defined cases: vectors null, empty, zero, or with null or non-finite components, and rows with a null vec_id, take no part;
vectors of different lengths are no candidates for each other; with fewer candidates than k all are returned; an
empty table gives no rows; repeated rows with one vec_id are one candidate; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lichen.llm._shared import again, stored
from lichen.llm._words import Pair
from lichen.llm.vectors import classes, matrix, vectors

PIVOTS, PREFIX, ASKED, SHARE, CLOSE = 512, 64, 32, 0.25, 0.75
SHARD, QUERIES = 8192, 4096


def lift(v: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(longest**2 - (v**2).sum(1), 0))[:, None]])


def permutations(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first."""
    near = v @ pivots.T
    if prefix < near.shape[1]:
        first = np.sort(np.argpartition(-near, prefix - 1, axis=1)[:, :prefix], axis=1)
        near = np.take_along_axis(near, first, 1)
        return np.take_along_axis(first, np.argsort(-near, axis=1, kind="stable"), 1)
    return np.argsort(-near, axis=1, kind="stable")


def files(own: np.ndarray, n_pivots: int) -> np.ndarray:
    """The inverted files of permutations, a row a pivot: for each vector its place with the pivot, prefix if it has none.
    With an eighth of the entries filled that is as small as lists of (member, place), and quicker to walk."""
    n, prefix = own.shape
    out = np.full((n_pivots, n), prefix, np.int8)
    out[own.ravel(), np.repeat(np.arange(n), prefix)] = np.tile(np.arange(prefix, dtype=np.int8), n)
    return out


def spread(v: np.ndarray, n: int, most: float = 0.8) -> np.ndarray:
    """The first n rows that are not near copies of an earlier one; a group of copies gives one pivot. If that leaves
    too few, others fill up."""
    u = v / np.sqrt((v**2).sum(1, keepdims=True))
    chosen: list[int] = []
    rest: list[int] = []
    for i in range(len(u)):
        (rest if chosen and (u[chosen] @ u[i]).max() > most else chosen).append(i)
        if len(chosen) == n:
            break
    return v[(chosen + rest)[:n]]


def search(q: np.ndarray, asked: np.ndarray, v: np.ndarray, posted: np.ndarray, k: int, prefix: int, share: float, close: float = CLOSE) -> Pair:
    """(numbers of the k rows of v found for each row of q, their inner products), best first; -1 for none."""
    most = min(len(v), max(k, int(np.ceil(share * len(v)))))
    posted = posted.astype(np.int16)
    # the footrule over the query's pivots; one that a vector doesn't have stands at the end of the prefix
    enough = (1 - close) * (prefix - np.arange(asked.shape[1])).sum()
    found, scores = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    each, places = np.empty(len(v), np.int16), list(np.arange(asked.shape[1], dtype=np.int16))
    for i, own in enumerate(asked.tolist()):
        far = np.zeros(len(v), np.int16)
        for place, p in zip(places, own, strict=True):
            np.subtract(posted[p], place, out=each)
            far += np.absolute(each, out=each)
        at = np.flatnonzero(far <= max(np.partition(far, most - 1)[most - 1], enough))
        exact = v.take(at, 0) @ q[i]
        best = np.argpartition(-exact, k - 1)[:k] if k < len(at) else np.arange(len(at))
        # all that tie with the last one, so that the smaller ids can be chosen
        best = np.flatnonzero(exact >= exact[best].min())
        best = best[np.lexsort((at[best], -exact[best]))][:k]
        found[i, : len(best)], scores[i, : len(best)] = at[best], exact[best]
    return found, scores


_INDEX = "d int, shard long, reps array<long>, ids array<array<long>>, vectors binary, files binary"


def nearest(df: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, asked_prefix: int = ASKED, share: float = SHARE, shard_size: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query holds for, its k nearest of all other rows."""
    rows = vectors(df)
    distinct = classes(rows, k + 1).withColumn("d", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    distinct = stored(distinct, "vectors")
    spark = df.sparkSession
    sizes = {r["d"]: (r["n"], r["longest"]) for r in distinct.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}
    chosen = {}
    for d, (_, longest) in sizes.items():
        got = distinct.where(F.col("d") == d).orderBy(F.xxhash64("rep", F.lit("pivot")), "rep").limit(8 * pivots).select("v").toArrow()
        chosen[d] = (lift(spread(matrix(got.column("v")), pivots), longest), longest)
    sent = spark.sparkContext.broadcast(chosen)
    shards = max([1, *(-(-n // shard_size) for n, _ in sizes.values())])
    asked = stored(rows.where(is_query).distinct().join(distinct.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    wanted = again(distinct).join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v", "d")
    blocks = max(1, -(-wanted.count() // QUERIES))

    def build(table: pa.Table) -> pa.Table:
        """A shard of the index."""
        table = table.sort_by("rep")
        d = table.column("d")[0].as_py()
        pivot, longest = sent.value[d]
        v = matrix(table.column("v"))
        posted = files(permutations(lift(v, longest), pivot, min(prefix, len(pivot))), len(pivot))
        one = lambda x, t: pa.array([x], t)
        return pa.table([one(d, pa.int32()), one(table.column("shard")[0].as_py(), pa.int64()), one(table.column("rep").to_pylist(), pa.list_(pa.int64())), one(table.column("ids").to_pylist(), pa.list_(pa.list_(pa.int64()))), one(v.tobytes(), pa.binary()), one(posted.tobytes(), pa.binary())], ["d", "shard", "reps", "ids", "vectors", "files"])

    sharded = distinct.select("rep", "ids", "v", "d", F.pmod(F.xxhash64("rep"), F.lit(shards).cast("long")).alias("shard"))
    index = stored(sharded.groupBy("d", "shard").applyInArrow(build, _INDEX), "index")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = wanted.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int")).join(again(index).select("d", "shard"), "d")

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"rep": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.nulls(0, pa.float64())})
        if not len(index) or not len(queries):
            return none
        row = {n: index.column(n)[0] for n in ("d", "vectors", "files")}
        d = row["d"].as_py()
        pivot, longest = sent.value[d]
        v = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, d)
        posted = np.frombuffer(row["files"].as_py(), np.int8).reshape(len(pivot), -1)
        q = matrix(queries.column("v"))
        scaled = np.hstack([q * (longest / np.sqrt((q**2).sum(1)))[:, None], np.zeros((len(q), 1))])
        found, scores = search(q, permutations(scaled, pivot, min(asked_prefix, len(pivot))), v, posted, min(k + 1, len(v)), min(prefix, len(pivot)), share)
        ids = index.column("ids")[0].as_py()
        out: list[tuple] = []
        for rep, at, s in zip(queries.column("rep").to_pylist(), found.tolist(), scores.tolist(), strict=True):
            own = sorted((-x, i) for a, x in zip(at, s, strict=True) if a >= 0 for i in ids[a])[: k + 1]
            out += [(rep, i, -x) for x, i in own]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["rep", "vec_id", "score"])

    hits = left.groupBy("d", "shard", "block").cogroup(right.groupBy("d", "shard", "block")).applyInArrow(run, "rep long, vec_id long, score double")
    best = lambda key: Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    merged = hits.withColumn("r", F.row_number().over(best("rep"))).where(F.col("r") <= k + 1).drop("r")
    out = asked.join(merged, "rep").where("vec_id <> query_id").withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, by inner product."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
