"""Near-duplicate documents by min-max hashing of word shingles, every link confirmed on full sets.

Each permutation gives two values, its minimum and its maximum, so half the hash evaluations fill the signature. Bands
of six values find a pair at similarity 0.8 with probability 1 - (1 - 0.8**6)**40, a miss in about 2e5 pairs, and
fewer above it. Documents with the same words are one class from the start, and only its smallest doc_id goes on.

Documents that share a band's bucket are candidates, and all comparisons are of full sets. First each is compared with the
smallest of its buckets, which costs as many sets as documents have buckets' smallest, and for a group of near copies, however
large, finds nearly all its links. Buckets whose other members these links bring together are settled. The rest of them make
candidate groups, in which every document outside the heaviest part linked so far is compared with all others: two
documents of that part are linked already. Groups beyond a block's size are cut into blocks, so a comparison's
memory is bounded; their cost is the product of what is outside that part and the whole, and not the square of the whole.
A posting list of shingles counts the intersections of a document with all others at once, and what comes back is a
spanning forest of links, never pairs. No bucket, group or partner is capped.

Defined cases: null or empty text, or white space only, has no shingles and links with nothing; fewer words than a
shingle has are one shingle; a null doc_id has its shingle count, no component (null) and is kept; rows with the same
doc_id are one document, which has the links of all its texts, in whatever order the rows stand; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.llm._shared import components, drop, plain, stored
from lichen.llm._words import mix, slices, weights, words

SHINGLE, PERCENT = 5, 80
ROWS, BANDS = 6, 40
BLOCK_SHINGLES, STAR_SHINGLES = 500_000, 100_000
SALTS, HOT = 64, 1_000
ASKS, LISTED = 1, 2
_random = np.random.Generator(np.random.PCG64(5_077))
_STEP = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ADD = _random.integers(1, 2**63, 256, dtype=np.uint64)


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(each text's distinct shingle hashes in ascending order, two content hashes of its words)."""
    h, _, _, first, _ = words(texts, lower=True)
    n = len(first) - 1
    count = np.diff(first)
    key1, key2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return [np.empty(0, np.uint64)] * n, key1, key2
    place = np.arange(len(h)) - np.repeat(first[:-1], count)
    w = weights(int(place.max()) + 1)[place]
    key1[some] = mix(np.add.reduceat(h * w, first[some]) + count[some].astype(np.uint64))
    key2[some] = mix(np.add.reduceat(h * mix(w), first[some]) ^ count[some].astype(np.uint64))
    rows = max(0, len(h) - k + 1)
    s = np.zeros(rows, np.uint64)
    for i in range(k):
        s += h[i : i + rows] * _STEP[i]
    s = mix(s)
    out = []
    for a, c, whole in zip(first[:-1].tolist(), count.tolist(), key1.tolist(), strict=True):
        out.append(np.unique(s[a : a + c - k + 1]) if c >= k else np.array([whole] if c else [], np.uint64))
    return out, key1, key2


def bands(sets: list[np.ndarray], rows: int = ROWS, n_bands: int = BANDS) -> np.ndarray:
    """(documents, bands): one 64-bit value a band, made of ``rows`` minima and maxima of as many permutations."""
    n = len(sets)
    out = np.zeros((n, n_bands), np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    flat = np.concatenate([sets[i] for i in some])
    start = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
    n_perm = rows * n_bands // 2
    low, high = np.empty((n_perm, len(some)), np.uint64), np.empty((n_perm, len(some)), np.uint64)
    x = np.empty_like(flat)
    for p in range(n_perm):
        np.multiply(flat, _MULTIPLY[p], out=x)
        x += _ADD[p]
        low[p], high[p] = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
    values = np.concatenate([low, high])  # a band takes values of different permutations
    band = np.zeros((len(some), n_bands), np.uint64)
    for b in range(n_bands):
        v = np.full(len(some), b + 1, np.uint64)
        for r in range(rows):
            v = mix(v + values[b * rows + r])
        band[:, b] = v
    out[some] = band
    return out


def signatures(docs: DataFrame, k: int = SHINGLE, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands) a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets, key1, key2 = shingles(batch.column(1)[a:b], k)
                flat = bands(sets, rows, n_bands).reshape(-1).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n_bands), pa.int32()), pa.array(flat))
                arrays = [batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), listed]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return plain(docs).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, key, s): each text's content hash and its distinct shingle hashes, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets, key, _ = shingles(batch.column(1)[a:b], k)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(key.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "key", "s"])

    return plain(docs).mapInArrow(run, "doc_id long, key long, s binary")


def _forest(ids: list[int], sets: list[np.ndarray], asks: np.ndarray, listed: np.ndarray, percent: int, root: dict[int, int]) -> None:
    """Joins in ``root`` the ids of linked sets: each that asks with all that are listed."""

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(size)])
    keep = listed[owner]
    order = np.argsort(number[keep], kind="stable")
    posting = owner[keep][order]
    first = np.searchsorted(number[keep][order], np.arange(len(values) + 1))
    roots = len({top(i) for i in ids})
    for x in np.flatnonzero(asks).tolist():
        if roots == 1:
            break
        own = number[cut[x] : cut[x + 1]]
        a, n = first[own], first[own + 1] - first[own]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.bincount(posting[at], minlength=len(sets))
        linked = np.flatnonzero((100 * both >= percent * (size[x] + size - both)) & (both > 0) & listed)
        for y in linked.tolist():
            p, q = top(ids[x]), top(ids[y])
            if p != q:
                root[max(p, q)] = min(p, q)
                roots -= 1


def _outside(size: list[int], known: list[int]) -> np.ndarray:
    """Which sets lie outside the heaviest part (the smallest of equals)."""
    weight: Counter[int] = Counter()
    for n, c in zip(size, known, strict=True):
        weight[c] += n
    major = min(weight, key=lambda c: (-weight[c], c))
    return np.array([c != major for c in known])


def _compared(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within each g of each task (task, i, j), from rows (g, doc_id, known, role, s). ``known`` is the part a document
    is linked to already; one with role ASKS is compared with those LISTED, and without roles all outside the heaviest
    part with all."""

    def link(table: pa.Table) -> pa.Table:
        by: dict[int, list[int]] = defaultdict(list)
        for k, g in enumerate(table.column("g").to_pylist()):
            by[g].append(k)
        doc, known, role = (table.column(c).to_pylist() for c in ("doc_id", "known", "role"))
        raw = table.column("s").to_pylist()
        root: dict[int, int] = {}
        for d, c in zip(doc, known, strict=True):
            root.setdefault(c, c)
            root.setdefault(d, c)
        before = dict(root)
        for rows in by.values():
            sets = [np.frombuffer(raw[k], np.uint64) for k in rows]
            if role[rows[0]]:
                asks, listed = (np.array([role[k] == r for k in rows]) for r in (ASKS, LISTED))
            else:
                asks, listed = _outside([len(s) for s in sets], [known[k] for k in rows]), np.ones(len(rows), bool)
            if asks.any() and listed.any():
                _forest([doc[k] for k in rows], sets, asks, listed, percent, root)
        pairs = [(x, r) for x, r in root.items() if x != r and before[x] != r]
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return tasks.select("task", "i", "j", "g", "doc_id", "known", "role", "s").groupBy("task", "i", "j").applyInArrow(link, "a long, b long")


def _cut(held: DataFrame, large: DataFrame, role: Column, block: int) -> tuple[DataFrame, DataFrame]:
    """(tasks of groups that fit in a block, dealt together; rows of those in ``large``, by g, with its columns).

    ``large`` has a row for a block's worth of shingles at most, and is met in SALTS parts, so no task holds a group."""
    tasks = max(1, -(-(held.agg(F.sum("n")).first()[0] or 0) // block))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    wide = large.withColumn("salt", salts).withColumnRenamed("g", "_g")
    at = held.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    at = at.join(wide, (at["g"] == wide["_g"]) & (at["_salt"] == wide["salt"]), "left").drop("_g", "_salt", "salt")
    whole = at.where("blocks IS NULL").select(F.pmod(F.xxhash64("g"), F.lit(tasks)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "g", "doc_id", "known", role.alias("role"), "s")
    return whole, at.where("blocks IS NOT NULL")


def _dealt(n: str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _blocks(weight: Column, block: int) -> Column:
    return F.ceil(weight / block).cast("int")


def _by_star(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of documents with the smallest of their buckets, (least, rep)."""
    pairs = stars.unionByName(stars.select("least", F.col("least").alias("rep")).distinct())
    held = pairs.join(sets, pairs["rep"] == sets["doc_id"]).select(F.col("least").alias("g"), "doc_id", F.col("doc_id").alias("known"), "n", "s")
    held = stored(held, "held")
    large = held.groupBy("g").agg(_blocks(F.sum("n"), STAR_SHINGLES).alias("blocks")).where("blocks > 1")
    asks = F.col("doc_id") == F.col("g")
    whole, cut = _cut(held, large, F.when(asks, ASKS).otherwise(LISTED), STAR_SHINGLES)
    parts = [cut.where(asks).withColumn("i", _each("blocks")).withColumn("role", F.lit(ASKS)), cut.where(~asks).withColumn("i", _dealt("blocks")).withColumn("role", F.lit(LISTED))]
    for p in parts:
        whole = whole.unionByName(p.select(F.col("g").alias("task"), "i", F.lit(-1).alias("j"), "g", "doc_id", "known", "role", "s"))
    return _compared(whole, percent)


def _by_group(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of what lies outside the heaviest part of each group with all of it; groups: (g, node, known)."""
    held = groups.join(sets, groups["node"] == sets["doc_id"]).select("g", "doc_id", "known", "n", "s")
    held = stored(held, "held")
    part = held.groupBy("g", "known").agg(F.sum("n").alias("w"))
    of = part.groupBy("g").agg(F.sum("w").alias("all"), F.max("w").alias("most"), F.max_by("known", F.struct("w", -F.col("known"))).alias("major"))
    large = of.select("g", "major", _blocks(F.col("all"), BLOCK_SHINGLES).alias("blocks"), _blocks(F.col("all") - F.col("most"), BLOCK_SHINGLES).alias("asked")).where("blocks > 1")
    whole, cut = _cut(held, large, F.lit(0), BLOCK_SHINGLES)
    cut = cut.where("asked > 0")
    parts = [cut.where("known <> major").withColumn("i", _dealt("asked")).withColumn("j", _each("blocks")).withColumn("role", F.lit(ASKS)), cut.withColumn("j", _dealt("blocks")).withColumn("i", _each("asked")).withColumn("role", F.lit(LISTED))]
    for p in parts:
        whole = whole.unionByName(p.select(F.col("g").alias("task"), "i", "j", "g", "doc_id", "known", "role", "s"))
    return _compared(whole, percent)


def _told(sig: DataFrame, whole: DataFrame) -> DataFrame:
    """sig with class_component, that of its class (null without an id or shingles). Classes of more than HOT copies are met in SALTS
    parts; then the others by class. Rows that have theirs, or get none, are dealt by document in that second step."""
    live = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    hot = whole.where(F.col("copies") > HOT).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"), F.col("component_id").alias("hot"))
    rows = sig.select("doc_id", "n_shingles", F.when(live, F.col("k1")).otherwise(F.xxhash64("doc_id", "k1")).alias("k1"), "k2", live.alias("live"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.join(hot, (rows["k1"] == hot["h1"]) & (rows["k2"] == hot["h2"]) & (rows["salt"] == hot["part"]) & rows["live"], "left")
    open_ = F.col("live") & F.col("hot").isNull()
    rows = rows.select("doc_id", "n_shingles", "hot", F.when(open_, F.col("k1")).otherwise(F.xxhash64("doc_id", "k1")).alias("c1"), F.col("k2").alias("c2"), open_.alias("open"))
    rest = whole.where(F.col("copies") <= HOT)
    both = rows.join(rest, (rows["c1"] == rest["k1"]) & (rows["c2"] == rest["k2"]) & rows["open"], "left")
    return both.select("doc_id", "n_shingles", F.coalesce("hot", "component_id").alias("class_component"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a row of docs."""
    sig = stored(signatures(docs, k, rows, n_bands), "signatures")
    alive = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = alive.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = alive.join(classes, [alive["k1"] == classes["k1"], alive["k2"] == classes["k2"], alive["doc_id"] == classes["rep"]], "left_semi").dropDuplicates(["k1", "k2"])
    posted = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("key"))
    first = posted.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = stored(posted.join(first, "key"), "members")

    ids = members.select(F.col("rep").alias("id")).distinct()
    texts = plain(docs)
    # rows of a document meet in this join, so repeated ones go without another shuffle
    texts = texts.join(ids.hint("shuffle_hash"), texts["doc_id"] == ids["id"], "left_semi").dropDuplicates(["doc_id", "text"])
    sets = stored(shingle_sets(texts, k).withColumn("n", (F.length("s") / 8).cast("long")), "sets")

    others = members.where("least < rep")
    stars = stored(others.select("least", "rep").distinct(), "stars")
    verified = stored(components(_by_star(stars, sets, percent)), "verified")
    # what is left: buckets whose members, but for the smallest, aren't in one part
    at = others.join(verified, others["rep"] == verified["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("known"))
    unsettled = at.groupBy("key").agg(F.min("rep").alias("next"), F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("key", "next")
    groups = components(at.join(unsettled, "key").select(F.col("next").alias("a"), F.col("rep").alias("b")))
    known = groups.join(verified.withColumnRenamed("component", "part"), "node", "left")
    links = _by_group(known.select(F.col("component").alias("g"), "node", F.coalesce("part", "node").alias("known")), sets, percent)
    links = links.unionByName(verified.select(F.col("node").alias("a"), F.col("component").alias("b")))
    # a document with several texts joins the classes of all of them
    several = alive.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select(F.col("doc_id").alias("id"))
    texts_of = alive.join(several, alive["doc_id"] == several["id"], "left_semi").select("doc_id", "k1", "k2")
    own = texts_of.join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = stored(components(links.unionByName(own)), "components")
    drop(members, sets, stars, verified)
    whole = classes.join(parts, classes["rep"] == parts["node"], "left").select("k1", "k2", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = _told(sig, whole).select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their distinct four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least_of ON x = doc_id
"""
