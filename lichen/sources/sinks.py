"""Writers. Spark's committer renames finished files into place, so readers see whole tables or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_taxon(df: DataFrame, path: str, files: int, key: str = "taxon_key", then: tuple[str, ...] = ()) -> None:
    """A table in ranges of the key, sorted inside: row groups then hold few keys and scans of one skip the rest."""
    df.repartitionByRange(files, key, *then).sortWithinPartitions(key, *then).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


def catalog_index(df: DataFrame, path: str, files: int) -> None:
    """(catalog_number, taxon_key, lat, lon) in ranges of catalog_number: one number is looked up in one row group."""
    by_taxon(df.select("catalog_number", "taxon_key", "lat", "lon"), path, files, "catalog_number")


def of_one(parts: dict[str, DataFrame], path: str, key: str = "taxon_key") -> None:
    """The statistics of one taxon or upload, a table a kind, without the key."""
    for kind, df in parts.items():
        df.drop(key).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{kind}")


def rankings(df: DataFrame, path: str, files: int) -> None:
    """Both layouts: by taxon and variable, and by the ancestor's ranked list."""
    by_taxon(df, f"{path}/by_taxon", files, "taxon_key", ("variable",))
    by_taxon(df, f"{path}/by_context", files, "ancestor", ("rank", "variable", "metric", "position"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """By name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def location_taxa(counts: DataFrame, path: str, files: int) -> None:
    """(scope, gid, taxon_key, n) of positive counts, sorted."""
    rows = counts.where(F.col("n") > 0)
    rows.repartitionByRange(files, "scope", "gid", "taxon_key").sortWithinPartitions("scope", "gid", "taxon_key").write.mode("overwrite").parquet(path)


def merged(base: DataFrame, batches: list[DataFrame], layers: list[str], temporal: list[str], keep: list[str], path: str, files: int) -> None:
    """Staged batches of layer values written into a table: the last batch that has a value wins, stale columns go, and the
    table is in ranges of taxon_key. ``path`` is not where ``base`` is read from."""
    from lichen.operators import incremental

    out = base.drop(*incremental.stale_columns(base.columns, keep, layers, temporal))
    for b in batches:
        out = incremental.coalesce_merge(out, b, layers)
    by_taxon(out, path, files)


def archive(tables: dict[str, DataFrame], folder: str, with_csv: bool = False) -> None:
    """Each table as snappy Parquet in a folder of its own under ``folder``, and as headed text if asked for. Arrays are
    JSON in the text form. Zipping is left to whoever serves the folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/{name}.parquet")
        if with_csv:
            flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
            df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def summaries(parts: dict[str, list[DataFrame]], path: str, files: int) -> None:
    """Each kind of statistics, its levels put together by name, in ranges of taxon_key. A mode that is null throughout is
    a double all the same."""
    for kind, levels in parts.items():
        df = union_all(levels)
        if "mode" in df.columns:
            df = df.withColumn("mode", F.col("mode").cast("double"))
        by_taxon(df, f"{path}/{kind}", files)
