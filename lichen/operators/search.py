"""Name search by token sets."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lichen.functions import text


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best similarity of the shared tokens, and of each side's sorted tokens with them in front."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    ratio = lambda p, q: 100 * difflib.SequenceMatcher(None, p, q).ratio() if p or q else 0.0
    return max(ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0, ratio(one, two))


def _begins(token: str) -> Callable[[Column], Column]:
    return lambda x: x.startswith(token)


def fuzzy_top(names: DataFrame, query: str, n: int | None = 20) -> DataFrame:
    """(taxon_key, name, score): the best name of each key. Every token of the query must begin some token of the name, which
    plain expressions test first, so that only those reach Python; 20 more for the same name, 2 less for each extra
    token, and a floor of 70 (60 for several tokens). Without n all of them, in no order."""
    q = " ".join(query.lower().replace("_", " ").split())
    tokens = q.split()
    if not tokens:
        return names.limit(0).select("taxon_key", "name", F.lit(0.0).alias("score"))
    rows = names.withColumn("_n", text.normalized(F.col("name")))
    for t in tokens:
        rows = rows.where(F.exists(F.split("_n", " "), _begins(t)))

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        return found.map(lambda x: token_set_ratio(q, x) + (20 if x == q else 0) - 2 * max(0, len(x.split()) - len(tokens)))

    best = rows.withColumn("score", score("_n")).where(F.col("score") >= (70 if len(tokens) == 1 else 60))
    each = best.groupBy("taxon_key").agg(F.max_by("name", F.struct("score", F.col("name"))).alias("name"), F.max("score").alias("score"))
    return each if n is None else each.orderBy(F.desc("score"), "taxon_key").limit(n)


def text_page(names: DataFrame, query: str, offset: int, limit: int) -> DataFrame:
    """A page of taxa in the order of their score."""
    found = fuzzy_top(names, query, offset + limit)
    return found.orderBy(F.desc("score"), "taxon_key").offset(offset).limit(limit)


def ranked_text_page(names: DataFrame, values: DataFrame, query: str, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """A page of all taxa found, ordered by a metric's value; they have no position, as they are no population."""
    order = F.desc("value") if descending else F.asc("value")
    return values.join(fuzzy_top(names, query, None).select("taxon_key"), "taxon_key").orderBy(order, "taxon_key").offset(offset).limit(limit)
