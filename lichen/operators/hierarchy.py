"""Trees given by materialised paths of Name_key segments; several roots are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segment_key(segment: Column) -> Column:
    return F.element_at(F.split(segment, "_"), -1)


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), each node its own ancestor at 0. A path names all ancestors, so this explodes
    paths: no recursion, no join, no shuffle."""
    parts = F.split("path", "/")
    at = nodes.select(F.col("taxon_key").alias("descendant"), F.size(parts).alias("n"), F.posexplode(parts).alias("i", "segment"))
    return at.select(segment_key(F.col("segment")).alias("ancestor"), "descendant", (F.col("n") - 1 - F.col("i")).alias("distance"))


def parents(nodes: DataFrame) -> DataFrame:
    """(taxon_key, parent_key): null for roots."""
    parts = F.split("path", "/")
    return nodes.select("taxon_key", F.when(F.size(parts) > 1, segment_key(F.element_at(parts, -2))).alias("parent_key"))


def subtree(nodes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Nodes at or under any of the paths; a prefix ends at a segment's end."""
    return nodes.where(F.lit(False) if not prefixes else _any([(F.col("path") == p) | F.col("path").startswith(p + "/") for p in prefixes]))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def request_scope(nodes: DataFrame, path: str, rank: str) -> DataFrame:
    """The keys a request covers: a species with what is under it, a lower leaf alone, a higher rank without itself."""
    if rank == "SPECIES":
        return subtree(nodes, [path]).select("taxon_key")
    if rank in ("SUBSPECIES", "VARIETY", "FORM"):
        return nodes.where(F.col("path") == path).select("taxon_key")
    return nodes.where(F.col("path").startswith(path + "/")).select("taxon_key")


def ancestor_names(nodes: DataFrame) -> DataFrame:
    """(taxon_key, chain): names from the root to the parent."""
    parts = F.split("path", "/")
    names = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.regexp_replace(s, "_[^_]*$", ""))
    return nodes.select("taxon_key", F.array_join(names, " > ").alias("chain"))


def roll_up(facts: DataFrame, tree: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Sums of ``amount`` by ancestor and ``by``. Facts are summed by taxon first, so the closure multiplies sums."""
    own = facts.groupBy("taxon_key", *by).agg(F.sum(amount).alias("s"))
    return own.join(tree, own["taxon_key"] == tree["descendant"]).groupBy("ancestor", *by).agg(F.sum("s").alias(amount))


def propagate_up(nodes: DataFrame, tree: DataFrame, value: str) -> DataFrame:
    """(taxon_key, value): a node's own value, else that of the nearest, then smallest, descendant that has one."""
    have = tree.join(nodes.select(F.col("taxon_key").alias("descendant"), F.col(value).alias("v")).where("v IS NOT NULL"), "descendant")
    return have.groupBy(F.col("ancestor").alias("taxon_key")).agg(F.min_by("v", F.struct("distance", "descendant")).alias(value))


def agreed_parent(ids: DataFrame, parents_of_ids: DataFrame) -> DataFrame:
    """(parent_key, inferred): the one outer parent on which all children with an outer id agree."""
    joined = ids.where("outer_id IS NOT NULL").join(parents_of_ids, "outer_id").where("outer_parent IS NOT NULL")
    agg = joined.groupBy("parent_key").agg(F.count_distinct("outer_parent").alias("n"), F.min("outer_parent").alias("inferred"))
    return agg.where("n = 1").select("parent_key", "inferred")


def fetch_plan(sizes: DataFrame, most: int) -> DataFrame:
    """(taxon_key, n): the subtrees to ask a paged service for, from (taxon_key, parent_key, n): the highest that have at most
    ``most`` results, and, where nothing is below them, larger ones. Empty ones need no request."""
    up = sizes.select(F.col("taxon_key").alias("_up"), F.col("n").alias("_n"))
    j = sizes.where("n > 0").join(up, F.col("parent_key") == F.col("_up"), "left").where(F.col("_n").isNull() | (F.col("_n") > most))
    inner = sizes.select(F.col("parent_key").alias("_inner")).where("_inner IS NOT NULL").distinct()
    leaf = j.where(F.col("n") > most).join(inner, F.col("taxon_key") == F.col("_inner"), "left_anti")
    return j.where(F.col("n") <= most).select("taxon_key", "n").unionByName(leaf.select("taxon_key", "n"))
