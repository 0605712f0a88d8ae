"""Reach over the call graph: I/O, entries, tests, impact of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import bfs

SURE = ("exact", "likely")

#: The order in which API and receiver names decide a call's kind of I/O.
IO_PATTERNS = (
    ("database", r"(?i)(?:sql|query|prisma|mongo|redis|knex|sequelize|cursor|session\.execute)"),
    ("filesystem", r"(?i)(?:\bfs\b|readfile|writefile|\bopen\b|path\.|os\.remove|shutil)"),
    ("process", r"(?i)(?:spawn|exec\b|subprocess|child_process|popen)"),
    ("message-queue", r"(?i)(?:kafka|amqp|rabbit|publish|subscribe|\bsqs\b)"),
    ("network", r"(?i)(?:fetch|axios|http|requests\.|socket|grpc)"),
)


def classify_io(callee: Column) -> Column:
    """The kind of I/O of a call by its name and receiver, or null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(IO_PATTERNS):
        out = F.when(callee.rlike(pattern), kind).otherwise(out)
    return out


def io_reach(edges: DataFrame, io_sites: DataFrame, max_depth: int = 10) -> DataFrame:
    """`symbol_id`, `kind`, `depth`: the least number of sure calls from a symbol to one that does I/O of a kind."""
    sure = edges.where(F.col("confidence").isin(*SURE))
    seeds = io_sites.select(F.col("kind").alias("seed"), F.col("symbol_id").alias("node"))
    return bfs(sure, seeds, max_depth, reverse=True).select(F.col("node").alias("symbol_id"), F.col("seed").alias("kind"), "depth")


def entry_reach(edges: DataFrame, entries: DataFrame, symbols: DataFrame, max_depth: int, cap: int = 999) -> DataFrame:
    """`entry_id`, `reach_symbols` (shown up to `cap`) and `reach_files` (others than the entry's own)."""
    seeds = entries.select(F.col("entry_id").alias("seed"), F.col("symbol_id").alias("node"))
    reached = bfs(edges.where(F.col("confidence").isin(*SURE)), seeds, max_depth)
    own = symbols.select(F.col("id").alias("node"), "file_id")
    home = entries.join(own.withColumnRenamed("node", "symbol_id"), "symbol_id").select(F.col("entry_id").alias("seed"), F.col("file_id").alias("home"))
    out = reached.where("depth > 0").join(own, "node").join(home, "seed").groupBy("seed").agg(
        F.least(F.count("*"), F.lit(cap)).alias("reach_symbols"), F.count_distinct(F.when(F.col("file_id") != F.col("home"), F.col("file_id"))).alias("reach_files")
    )
    return out.withColumnRenamed("seed", "entry_id")


def test_coverage(edges: DataFrame, cases: DataFrame, sources: DataFrame, max_depth: int = 4, nearest: int = 6) -> DataFrame:
    """`symbol_id`, `tests`, `direct`, `nearest` (ids of the nearest cases, by depth and id, comma-joined)."""
    seeds = cases.select(F.col("case_id").alias("seed"), F.col("case_id").alias("node"))
    hit = bfs(edges, seeds, max_depth).where("depth > 0").join(sources.select(F.col("id").alias("node")), "node", "left_semi")
    near = hit.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("depth", "seed"))).where(F.col("k") <= nearest)
    near = near.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "seed"))).alias("x"))  # at most `nearest` rows
    counts = hit.groupBy("node").agg(F.count("*").alias("tests"), F.count_if(F.col("depth") == 1).alias("direct"))
    names = F.array_join(F.transform("x", lambda x: x.seed.cast("string")), ",")
    return counts.join(near, "node").select(F.col("node").alias("symbol_id"), "tests", "direct", names.alias("nearest"))


def impact(edges: DataFrame, changed: DataFrame, max_depth: int = 6) -> DataFrame:
    """`symbol_id`, `depth`, `changes`: symbols that reach a changed one by calls, the least depth, how many changes."""
    seeds = changed.select(F.col("symbol_id").alias("seed"), F.col("symbol_id").alias("node"))
    back = bfs(edges, seeds, max_depth, reverse=True).where("depth > 0")
    return back.groupBy(F.col("node").alias("symbol_id")).agg(F.min("depth").alias("depth"), F.count("*").alias("changes"))
