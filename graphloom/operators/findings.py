"""Findings: duplicates, oversized code, rule violations, layering, unapproved dependencies, bypasses, coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import longest_owner, matches_any


def duplicates(symbols: DataFrame, min_complexity: int = 2, min_lines: int = 3) -> DataFrame:
    """Functions with one shape in several files: `shape`, `members`, `files`, `severity` (high if all share a name)."""
    own = symbols.where((F.col("complexity") >= min_complexity) & (F.col("end_line") - F.col("start_line") + 1 >= min_lines))
    out = own.groupBy("shape").agg(F.count("*").alias("members"), F.count_distinct("file_id").alias("files"), F.min("name").alias("low"), F.max("name").alias("high"))
    return out.where("members >= 2 and files >= 2").select("shape", "members", "files", F.when(F.col("low") == F.col("high"), "high").otherwise("low").alias("severity"))


def oversized_functions(symbols: DataFrame) -> DataFrame:
    """Complexity from 25, or from 10 over 200 lines; twice either limit is medium, else low."""
    lines = F.col("end_line") - F.col("start_line") + 1
    out = symbols.where("kind in ('function', 'method')").withColumn("lines", lines)
    out = out.where("complexity >= 25 or (lines >= 200 and complexity >= 10)")
    return out.select("id", "complexity", "lines", F.when((F.col("complexity") >= 50) | (F.col("lines") >= 400), "medium").otherwise("low").alias("severity"))


def oversized_files(files: DataFrame, symbols: DataFrame, min_loc: int = 1000, min_complexity: int = 100) -> DataFrame:
    """Source files with many lines and much complexity: the sums of their functions, and how many these are."""
    sums = symbols.groupBy("file_id").agg(F.sum("complexity").alias("complexity"), F.count("*").alias("functions"))
    out = files.where(F.col("role") == "source").where(F.col("loc") >= min_loc).join(sums, files.id == sums.file_id)
    return out.where(sums.complexity >= min_complexity).select(files.id, "loc", sums.complexity.alias("complexity"), "functions")


def violations(imports: DataFrame, files: DataFrame, rules: list[dict]) -> DataFrame:
    """`rule`, `file_id`, `n`: imports from a path that matches `from` to one that matches `disallow` and not `allow`.

    Type-only imports count only with `include_type_only`. The rules are a short list of patterns, so the imports are
    read once and each is tested against every rule.
    """
    own = files.where("role = 'source'")
    a = own.select(F.col("id").alias("file_id"), F.col("path").alias("p1"))
    b = files.select(F.col("id").alias("target_file_id"), F.col("path").alias("p2"))
    pairs = imports.join(a, "file_id").join(b, "target_file_id")

    def broken(r: dict) -> Column:
        hit = matches_any(F.col("p1"), r["from"]) & matches_any(F.col("p2"), r["disallow"]) & ~matches_any(F.col("p2"), r.get("allow", []))
        return F.when(hit if r.get("include_type_only") else hit & ~F.col("is_type_only"), F.lit(r["name"]))

    each = pairs.select("file_id", F.explode(F.array_compact(F.array(*[broken(r) for r in rules]))).alias("rule"))
    return each.groupBy("rule", "file_id").agg(F.count("*").alias("n"))


def layering(imports: DataFrame, files: DataFrame, layers: DataFrame) -> DataFrame:
    """Runtime imports between source files from a lower layer to an upper one, counted by pair of layers.

    `layers` has `member` (a directory) and `ordinal` (0 is the top); the longest member that holds a path decides.
    """
    own = longest_owner(files.where("role = 'source'").select("id", "path"), "path", layers, "member", "ordinal").where("ordinal is not null")
    a = own.select(F.col("id").alias("file_id"), F.col("ordinal").alias("from_layer"))
    b = own.select(F.col("id").alias("target_file_id"), F.col("ordinal").alias("to_layer"))
    out = imports.where("not is_type_only").join(a, "file_id").join(b, "target_file_id").where("from_layer > to_layer")
    return out.groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


def unapproved(dependencies: DataFrame, lock: DataFrame) -> DataFrame:
    """Package dependencies (`src`, `dst`) that a lock does not list."""
    return dependencies.select("src", "dst", "weight").join(lock.select("src", "dst"), ["src", "dst"], "left_anti")


def bypasses(imports: DataFrame, files: DataFrame, entry_files: DataFrame) -> DataFrame:
    """Runtime imports from another package into a file that is not an entry of its own, where the package has entries."""
    a = files.where("role = 'source'").select(F.col("id").alias("file_id"), F.col("package").alias("p1"))
    b = files.select(F.col("id").alias("target_file_id"), F.col("package").alias("p2"))
    has = entry_files.join(files.select("id", "package"), "id").select(F.col("package").alias("p2")).distinct()
    out = imports.where("not is_type_only").join(a, "file_id").join(b, "target_file_id").where("p1 <> p2").join(has, "p2", "left_semi")
    out = out.join(entry_files.select(F.col("id").alias("target_file_id")), "target_file_id", "left_anti")
    return out.groupBy(F.col("p1").alias("src"), F.col("p2").alias("dst")).agg(F.count("*").alias("n"), F.count_distinct("target_file_id").alias("files"))


def coupling(pairs: DataFrame, history: DataFrame, commits: int, edges: DataFrame, min_together: int = 4, min_lift: float = 2.0) -> DataFrame:
    """Pairs that change together without an import between them, direct or over one file: `a`, `b`, `together`, `lift`."""
    own = history.select("file_id", "commits")
    lift = F.col("together") * F.lit(commits) / (F.col("ca") * F.col("cb"))
    out = pairs.where(F.col("together") >= min_together).join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b").withColumn("lift", lift).where(F.col("lift") >= min_lift)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = out.join(both.toDF("a", "b"), ["a", "b"], "left_anti")
    # Only neighbours of the few pairs left are expanded, not all two-step paths.
    via = out.select("a", "b").join(both.toDF("a", "x"), "a").join(both.toDF("x", "b"), ["x", "b"]).select("a", "b").distinct()
    return out.join(via, ["a", "b"], "left_anti").select("a", "b", "together", "lift")
