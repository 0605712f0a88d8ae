"""Change history: per-file counts, commits of a set of files, pairs that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_history(commits: DataFrame, commit_files: DataFrame, as_of: Column, recent_days: int = 90) -> DataFrame:
    """`file_id`, `commits`, `recent` (within `recent_days` of `as_of`), `last_at`, `authors`, `ai_commits`."""
    recent = (F.col("made_at") >= as_of - F.expr(f"interval {int(recent_days)} days")).cast("int")
    return commit_files.join(commits, "commit_id").groupBy("file_id").agg(
        F.count("*").alias("commits"), F.sum(recent).alias("recent"), F.max("made_at").alias("last_at"), F.count_distinct("author").alias("authors"), F.sum(F.col("ai").cast("int")).alias("ai_commits")
    )


def co_changes(commit_files: DataFrame, min_files: int = 2, max_files: int = 30, min_together: int = 3, min_share: float = 0.5) -> DataFrame:
    """`a`, `b`, `together` for pairs of files (a < b) that commits of 2 to 30 files change together.

    Larger commits say nothing about pairs, by definition of the measure; the bound also keeps a commit's pairs few.
    The pairs of a commit come from its sorted list of files, so no self-join is shuffled.
    """
    lists = commit_files.groupBy("commit_id").agg(F.array_sort(F.collect_set("file_id")).alias("f")).where(F.size("f").between(min_files, max_files))
    each = lists.select("f", F.posexplode("f").alias("i", "a")).select("a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b"))
    together = each.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= min_together)
    own = commit_files.select("commit_id", "file_id").distinct().groupBy("file_id").agg(F.count("*").alias("n"))
    out = together.join(own.toDF("a", "na"), "a").join(own.toDF("b", "nb"), "b")
    return out.where(F.col("together") >= min_share * F.least("na", "nb")).select("a", "b", "together")


def module_commit_counts(commits: DataFrame, commit_files: DataFrame, files: DataFrame, recent_days: int = 90) -> DataFrame:
    """`package`, `commits`, `recent`, `ai_commits`: `commit_counts` of every package of `files` (file_id, package) at once.

    A commit counts once a package, however many of its files it touches; recent is seen from the last commit of all.
    A package without commits has no row.
    """
    touched = commit_files.join(files.select("file_id", "package"), "file_id").select("package", "commit_id").distinct()
    last = commits.agg(F.max("made_at").alias("last"))  # one row
    recent = (F.col("made_at") >= F.col("last") - F.expr(f"interval {int(recent_days)} days")).cast("int")
    own = touched.join(commits.crossJoin(F.broadcast(last)), "commit_id")
    return own.groupBy("package").agg(F.count("*").alias("commits"), F.coalesce(F.sum(recent), F.lit(0)).alias("recent"), F.coalesce(F.sum(F.col("ai").cast("int")), F.lit(0)).alias("ai_commits"))


def commit_counts(commits: DataFrame, commit_files: DataFrame, files: DataFrame, as_of: Column, recent_days: int = 90) -> DataFrame:
    """One row: distinct commits, recent ones and assisted ones that touch any of `files` (file_id)."""
    own = commits.join(commit_files.join(files.select("file_id"), "file_id", "left_semi"), "commit_id", "left_semi")
    recent = (F.col("made_at") >= as_of - F.expr(f"interval {int(recent_days)} days")).cast("int")
    return own.agg(F.count("*").alias("commits"), F.coalesce(F.sum(recent), F.lit(0)).alias("recent"), F.coalesce(F.sum(F.col("ai").cast("int")), F.lit(0)).alias("ai_commits"))
