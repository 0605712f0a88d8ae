"""Totals, rollups over the directory tree, scope graphs and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import ancestors


def index_totals(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of counts; `resolved` imports are those neither external nor unresolved."""
    f = files.agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"))
    s = symbols.agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))
    i = imports.agg(F.count("*").alias("imports"), F.count_if(F.col("confidence") == "external").alias("external"), F.count_if(F.col("confidence") == "unresolved").alias("unresolved"))
    c = calls.agg(F.count("*").alias("calls"), F.count_if(F.col("resolution") == "exact").alias("exact_calls"))
    one = f.crossJoin(s).crossJoin(i).crossJoin(c)  # four single rows
    return one.withColumn("resolved", F.col("imports") - F.col("external") - F.col("unresolved"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files, lines and share of all lines by language, without assets."""
    by = files.where("role <> 'asset'").groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    total = by.agg(F.greatest(F.sum("loc"), F.lit(1)).alias("t"))
    return by.crossJoin(F.broadcast(total)).select("language", "files", "loc", (F.col("loc") / F.col("t")).alias("share"))  # one row


def package_totals(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Source files, lines and complexity of each package, also of those without any."""
    own = files.where("role = 'source'").groupBy("package").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return packages.join(own, packages.name == own.package, "left").select("name", zero("files"), zero("loc"), zero("complexity"))


def directory_totals(files: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Sums over all files below each directory, `parent` and `depth` included; only files of `roles`, if given.

    Files are first summed by their own directory, so few rows are exploded to ancestors.
    """
    own = files if roles is None else files.where(F.col("role").isin(roles))
    flat = own.groupBy("dir_path").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"))
    up = flat.select(F.explode(ancestors(F.col("dir_path"), include_self=True)).alias("path"), "files", "loc", "complexity")
    out = up.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("files", "loc", "complexity")])
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(".")
    return out.select("path", parent.alias("parent"), F.size(parts).alias("depth"), "files", "loc", "complexity")


def tree_level(directories: DataFrame, parent: str) -> DataFrame:
    """The directories below `parent` with their heat: lines as a share of the largest sibling's."""
    heat = F.col("loc") / F.greatest(F.max("loc").over(Window.partitionBy("parent")), F.lit(1))
    return directories.where(F.col("parent") == parent).withColumn("heat", heat).select("path", "files", "loc", "complexity", "heat")


def scope_graph(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The largest `limit` - 1 nodes (by loc, then id) and `agg:` for the rest with summed metrics; edges are merged to these.

    `nodes` has id, loc, complexity; `edges` has src, dst, weight. Edges within the aggregate are dropped.
    """
    # A global top-k by sort and limit keeps a bounded number of rows a task, unlike a window over everything.
    top = nodes.orderBy(F.desc("loc"), "id").limit(limit - 1).select("id").withColumn("kept", F.lit(True))
    name = nodes.join(F.broadcast(top), "id", "left").select("id", "loc", "complexity", F.when(F.col("kept"), F.col("id").cast("string")).otherwise("agg:").alias("node"))
    shown = name.groupBy("node").agg(F.count("*").alias("members"), F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"))
    key = name.select("id", "node")
    merged = edges.join(key.toDF("src", "a"), "src").join(key.toDF("dst", "b"), "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
    return shown, merged


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`id`, `n_in`, `n_out` (distinct neighbours) of all nodes."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    by = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(by, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group, with `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def occurrence(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """`occurrence`: the number of a row among those with equal keys."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def containing(inner: DataFrame, outer: DataFrame, group: str) -> DataFrame:
    """`inner_id`, `outer_id`: the tightest interval of the same group that holds a place.

    `inner` has id, `group`, at; `outer` has id, `group`, lo, hi. Ties go to the smaller outer id.
    """
    o = outer.select(group, F.col("id").alias("outer_id"), "lo", "hi")
    hit = inner.select(group, F.col("id").alias("inner_id"), "at").join(o, group).where("at between lo and hi")
    return hit.groupBy("inner_id").agg(F.min_by("outer_id", F.struct(F.col("hi") - F.col("lo"), "outer_id")).alias("outer_id"))


def next_at(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """As-of join forward: `left_id` and the `right_id` at the first place not before it (`at`) among equal keys.

    Both sides are merged into one ordered window, so no pairs are made.
    """
    both = left.select(*keys, "at", F.col("id").alias("left_id"), F.lit(None).cast(right.schema["id"].dataType).alias("right_id"), F.lit(0).alias("side"))
    both = both.unionByName(right.select(*keys, "at", F.lit(None).cast(left.schema["id"].dataType).alias("left_id"), F.col("id").alias("right_id"), F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("side"), F.desc("right_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("right_id", F.last("right_id", ignorenulls=True).over(w)).where("side = 0").select("left_id", "right_id")
