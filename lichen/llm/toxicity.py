"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and unlabelled ones: labelled rows drawn without looking at their labels. Features are words
(letter runs, A-Z lower-cased) and word beginnings of 4 to 6 bytes, those whose document rates differ most between the
two, and by no less than four standard errors. A linear model in numpy
minimises the class-prior-corrected risk  prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])  with logistic
loss l; where the second part turns negative, the step goes against it, as in the non-negative estimator.

What is sampled: only the rows to learn from, at most ``positives`` and ``unlabelled`` of the labelled rows outside the
held-out fold, by a hash of doc_id. Every text is scored whole.

Defined cases: null or empty text has no words and gets the score of the bias; a null doc_id is in no fold, is never
learned from and is scored; labels that are null are left out, and a document with several is toxic if one of them says so;
of a document with several texts the one with the smallest hash is learned from, and each is scored; without toxic or
unlabelled rows every score is 0; repeated rows are scored alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.llm._shared import plain, stored
from lichen.llm._words import Pair, mix, slices, words

POSITIVES, UNLABELLED, FEATURES, STEPS = 4000, 8000, 2000, 300
ERRORS = 4.0
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # uint64, ascending
    weights: np.ndarray
    bias: float
    prior: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(texts: pa.Array) -> Pair:
    """(hashes, number of the text of each): the words of the texts, and the beginnings of longer ones."""
    h, starts, ends, first, data = words(texts, lower=True, letters=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    hashes, docs = [h], [doc]
    for n in (4, 5, 6):
        longer = np.flatnonzero(ends - starts > n)
        x = np.full(len(longer), n, np.uint64)
        for i in range(n):
            x = (x << np.uint64(8)) | _LOWER[data[starts[longer] + i]]
        hashes.append(mix(x))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


def _present(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, words): the distinct word hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                h, doc = features(batch.column(2)[a:b])
                order = np.argsort(doc, kind="stable")
                h, cuts = h[order].view(np.int64), np.searchsorted(doc[order], np.arange(1, b - a))
                own = [np.unique(x) for x in np.split(h, cuts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(own, pa.list_(pa.int64()))], ["doc_id", "kind", "words"])

    return docs.mapInArrow(run, "doc_id long, kind int, words array<long>")


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, n_features: int, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the non-negative risk's minimiser, by Adam over all rows; rows hold feature numbers."""
    size = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), size)
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.bincount(doc, w[at], len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_minus = np.logaddexp(0, g)
        negative = loss_minus[~positive].mean() - prior * loss_minus[positive].mean()
        up = np.where(positive, -prior * s / n_p, s / n_u)  # gradient of the corrected negative part
        pull = np.where(positive, prior * (s - 1) / n_p, 0)
        d = pull + up if negative >= 0 else -up
        grad = np.append(np.bincount(at, d[doc], n_features), d.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, n_features: int = FEATURES) -> Model:
    """A model from labelled rows outside the held-out fold. The samples and the feature table are bounded by the
    parameters, and so is all that the driver holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    none = Model(np.empty(0, np.uint64), np.empty(0), -np.inf, 0.0)
    if not toxic or toxic == total:
        return none
    pick = lambda d, n, kind: d.select("id").orderBy(F.xxhash64("id", F.lit(kind)), "id").limit(n).withColumn("kind", F.lit(kind))
    sample = pick(known.where("toxic = 1"), positives, 1).unionByName(pick(known, unlabelled, 0))
    texts = plain(docs)
    # one text a document: what is gathered below has no more rows than the sample
    chosen = texts.join(F.broadcast(sample), texts["doc_id"] == sample["id"]).groupBy("doc_id", "kind").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    seen = stored(_present(chosen), "toxic-words")
    n = {r["kind"]: r["count"] for r in seen.groupBy("kind").count().collect()}
    if len(n) < 2:
        return none
    rates = seen.select("kind", F.explode("words").alias("h")).groupBy("h").agg(F.sum("kind").alias("p"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    p, u = F.col("p") / n[1], (F.col("n") - F.col("p")) / n[0]
    spread = F.sqrt((F.col("n") / (n[0] + n[1])) * (1 / n[0] + 1 / n[1]))
    top = [r["h"] for r in rates.select("h", (F.abs(p - u) / spread).alias("z")).where(F.col("z") >= ERRORS).orderBy(F.desc("z"), "h").limit(n_features).collect()]
    order = sorted(top, key=lambda x: x % 2**64)
    place = F.broadcast(docs.sparkSession.createDataFrame([(h, i) for i, h in enumerate(order)], "h long, at int"))
    # a row of at most n_features numbers for each of the sampled texts
    hits = seen.withColumn("uid", F.monotonically_increasing_id()).select("uid", "kind", F.explode_outer("words").alias("h")).join(place, "h", "left")
    got = hits.groupBy("uid", "kind").agg(F.array_sort(F.collect_list("at")).alias("at")).orderBy("uid").collect()
    prior = min(0.9, max(1e-3, toxic / total))
    w, bias = fit([np.array(r["at"], np.int64) for r in got], np.array([r["kind"] == 1 for r in got]), prior, len(order))
    return Model(np.array(order, np.int64).view(np.uint64), w, bias, prior)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of the text column: the score, from 0 to 1, of each whole text."""
    coarse = np.zeros(1 << 16, bool)
    coarse[(model.hashes >> np.uint64(48)).astype(np.int64)] = True
    sent = spark.sparkContext.broadcast((model, coarse))

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        model, coarse = sent.value
        out = [np.empty(0)]
        for a, b in slices(texts):
            h, doc = features(texts[a:b])
            near = np.flatnonzero(coarse[(h >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(model.hashes, h[near])
            at[at == len(model.hashes)] = 0
            hit = model.hashes[at] == h[near] if len(model.hashes) else np.zeros(len(at), bool)
            both = np.unique(doc[near[hit]] * (len(model.hashes) + 1) + at[hit])  # a feature counts once a text
            doc, at = np.divmod(both, len(model.hashes) + 1)
            g = np.bincount(doc, model.weights[at], b - a) + model.bias
            with np.errstate(over="ignore"):
                out.append(1 / (1 + np.exp(-g)))
        return pa.array(np.concatenate(out))

    return lambda text: score_of(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    return plain(docs).select("doc_id", scorer(docs.sparkSession, model)(F.col("text")).alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
