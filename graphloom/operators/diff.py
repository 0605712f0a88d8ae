"""Snapshot comparison: files, symbols, dependencies, findings by natural keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """`path`, `status` (added, removed, modified, moved), `old_path`. Tables have `path` and `hash`.

    A removed and an added file with one hash are a move; the k-th of one with the k-th of the other by path.
    """
    both = base.select("path", F.col("hash").alias("h0")).join(head.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    nth = Window.partitionBy("hash").orderBy("path")
    gone = both.where("h1 is null").select(F.col("h0").alias("hash"), "path").withColumn("k", F.row_number().over(nth)).withColumnRenamed("path", "old_path")
    new = both.where("h0 is null").select(F.col("h1").alias("hash"), "path").withColumn("k", F.row_number().over(nth))
    paired = new.join(gone, ["hash", "k"], "full_outer")
    status = F.when(F.col("path").isNull(), "removed").when(F.col("old_path").isNull(), "added").otherwise("moved")
    moved = paired.select(F.coalesce("path", "old_path").alias("path"), status.alias("status"), F.when(status == "moved", F.col("old_path")).alias("old_path"))
    changed = both.where("h0 <> h1").select("path", F.lit("modified").alias("status"), F.lit(None).cast("string").alias("old_path"))
    return moved.unionByName(changed)


def pair_symbols(base: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("path", "container", "name", "kind")) -> DataFrame:
    """Symbols of two snapshots paired by key and ordinal: keys, `ordinal`, `status`, `base_id`, `head_id`.

    The k-th of equal keys by start line pairs with the k-th. Null containers match each other.
    """
    nth = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]).orderBy("start_line", "id")

    def numbered(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(k) for k in keys], F.row_number().over(nth).alias("ordinal"), F.col("id").alias(f"{side}_id"), F.col("hash").alias(f"{side}_hash"))

    both = numbered(base, "base").join(numbered(head, "head"), [*keys, "ordinal"], "full_outer")
    status = F.when(F.col("base_id").isNull(), "added").when(F.col("head_id").isNull(), "removed").when(F.col("base_hash") != F.col("head_hash"), "modified").otherwise("same")
    return both.select(*[F.nullif(F.col(k), F.lit("\u0000")).alias(k) for k in keys], "ordinal", status.alias("status"), "base_id", "head_id")


def diff_weights(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed weights of two snapshots that differ: keys, `status`, `before`, `after`."""
    both = base.select(*keys, F.col("weight").alias("before")).join(head.select(*keys, F.col("weight").alias("after")), keys, "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return both.where("before is null or after is null or before <> after").select(*keys, status.alias("status"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def diff_keys(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one snapshot has and the other has not: keys, `status`."""
    a, b = base.select(*keys).distinct(), head.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("status", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("status", F.lit("removed")))
