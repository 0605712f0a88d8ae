"""Boundaries between modules: usage, public API, dependencies with samples, lookups, behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import fixpoint


def boundary_usage(calls: DataFrame, symbols: DataFrame, inside: DataFrame, outside: DataFrame) -> DataFrame:
    """`symbol_id`, `calls`, `callers`: symbols of the files `inside` that files `outside` (file_id each) call.

    A call outside any function counts its file as the caller.
    """
    own = symbols.join(inside.select("file_id"), "file_id", "left_semi").select(F.col("id").alias("target_symbol_id"))
    used = calls.join(outside.select("file_id"), "file_id", "left_semi").join(own, "target_symbol_id", "left_semi")
    caller = F.coalesce("caller_symbol_id", -F.col("file_id"))
    return used.groupBy(F.col("target_symbol_id").alias("symbol_id")).agg(F.count("*").alias("calls"), F.count_distinct(caller).alias("callers"))


def module_usage(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """`package`, `symbol_id`, `calls`, `callers`: `boundary_usage` of every package of `files` (id, package) at once, seen from all others."""
    home = files.select(F.col("id").alias("file_id"), "package")
    own = symbols.select(F.col("id").alias("target_symbol_id"), "file_id").join(home, "file_id").drop("file_id")
    used = calls.where("target_symbol_id is not null").join(home.withColumnRenamed("package", "from_package"), "file_id").join(own, "target_symbol_id")
    caller = F.coalesce("caller_symbol_id", -F.col("file_id"))
    return used.where("from_package <> package").groupBy("package", F.col("target_symbol_id").alias("symbol_id")).agg(F.count("*").alias("calls"), F.count_distinct(caller).alias("callers"))


def module_api(calls: DataFrame, symbols: DataFrame, files: DataFrame, limit: int = 12) -> DataFrame:
    """`package`, `symbol_id`, `callers`, `rank`: the symbols of each package that most outside functions call."""
    own = symbols.join(files.select(F.col("id").alias("file_id"), "package"), "file_id").select(F.col("id").alias("target_symbol_id"), "package")
    home = files.select(F.col("id").alias("file_id"), F.col("package").alias("from_package"))
    used = calls.where("target_symbol_id is not null").join(home, "file_id").join(own, "target_symbol_id").where("from_package <> package")
    by = used.groupBy("package", F.col("target_symbol_id").alias("symbol_id")).agg(F.count_distinct("caller_symbol_id").alias("callers"))
    order = Window.partitionBy("package").orderBy(F.desc("callers"), "symbol_id")
    return by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def module_dependencies(edges: DataFrame, files: DataFrame, samples: int = 3) -> DataFrame:
    """`src`, `dst`, `weight`, `samples`: package dependencies with their heaviest file pairs (ties by path)."""
    own = files.select("id", "package", "path")
    pairs = edges.join(own.toDF("src", "p1", "f1"), "src").join(own.toDF("dst", "p2", "f2"), "dst").where("p1 <> p2")
    total = pairs.groupBy("p1", "p2").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("p1", "p2").orderBy(F.desc("weight"), "f1", "f2")
    best = pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= samples)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(">", "f1", "f2").alias("s")))), lambda x: x.s), ";")
    best = best.groupBy("p1", "p2").agg(text.alias("samples"))
    return total.join(best, ["p1", "p2"]).select(F.col("p1").alias("src"), F.col("p2").alias("dst"), "weight", "samples")


def public_api_files(entries: DataFrame, re_exports: DataFrame) -> DataFrame:
    """`file_id` of the entry files and all that they re-export, however far (`re_exports`: file_id, target_file_id)."""
    step = re_exports.select(F.col("file_id").alias("a"), F.col("target_file_id").alias("b")).where("b is not null").distinct()
    grow = lambda new: new.join(step, new.file_id == step.a).select(F.col("b").alias("file_id"))
    return fixpoint(entries.select("file_id"), grow, ["file_id"])


def forwarders(edges: DataFrame, symbols: DataFrame, max_lines: int = 6, max_complexity: int = 1) -> DataFrame:
    """`symbol_id`, `target_id` of short simple functions that call exactly one other."""
    small = symbols.where((F.col("complexity") <= max_complexity) & (F.col("end_line") - F.col("start_line") < max_lines)).select(F.col("id").alias("src"))
    one = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("target_id")).where("n = 1")
    return one.join(small, "src", "left_semi").select(F.col("src").alias("symbol_id"), "target_id")


def behaviour_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """`symbol_id`, `added`, `removed`: how many callees (symbol_id, callee) a function has gained and lost."""
    a, b = base.select("symbol_id", "callee").distinct(), head.select("symbol_id", "callee").distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["symbol_id", "callee"], "full_outer").where("x is null or y is null")
    return both.groupBy("symbol_id").agg(F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("removed"))


def lookup(text: str, packages: DataFrame, files: DataFrame, symbols: DataFrame, limit: int = 12) -> DataFrame:
    """`tier`, `kind`, `ref` of what a text names: package, directory, file, file suffix, symbol; the first tier that has any."""
    tiers = (
        packages.where(F.col("name") == text).select(F.lit(1).alias("tier"), F.lit("package").alias("kind"), F.col("name").alias("ref")),
        files.where(F.col("dir_path") == text).select(F.lit(2), F.lit("directory"), "dir_path").distinct(),
        files.where(F.col("path") == text).select(F.lit(3), F.lit("file"), "path"),
        files.where(F.col("path").endswith("/" + text)).select(F.lit(4), F.lit("file"), "path"),
        symbols.where(F.col("name") == text).select(F.lit(5), F.lit("symbol"), F.col("id").cast("string")),
    )
    out = tiers[0]
    for t in tiers[1:]:
        out = out.union(t)
    best = out.agg(F.min("tier").alias("best"))  # one row
    return out.join(F.broadcast(best), F.col("tier") == F.col("best")).orderBy("ref").limit(limit).select("tier", "kind", "ref")


def rank_entries(entries: DataFrame) -> DataFrame:
    """Entries in display order: walkable first, by kind, by reach, by label. `position` is counted within each kind.

    A position over all entries would need one task; the kinds are five, and `place` orders them.
    """
    place = F.when(F.col("kind") == "http", 0).when(F.col("kind") == "cli", 1).when(F.col("kind") == "main", 2).when(F.col("kind") == "public-api", 3).otherwise(4)
    return entries.withColumn("place", place).orderBy(F.col("symbol_id").isNull(), "place", F.desc("reach_files"), F.desc("reach_symbols"), "label")
