"""Graph traversals as loops of joins: breadth-first search, fixpoints, shortest paths.

A step joins the frontier with the edges and removes what was seen by an anti-join. The seen set is cut from its
lineage by `kept`, which survives lost executors. The driver only learns whether a frontier is empty.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ready(spark: SparkSession) -> None:
    """checkpoint() needs a folder: the cluster's `spark.checkpoint.dir`, or a temporary one where none is set."""
    sc = spark.sparkContext
    if not sc.master.startswith("local") and not sc.getConf().get("spark.checkpoint.dir"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-graphloom-"))


#: With it the shuffle files of a step go when the step has ended, else when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """`df`, written once as Parquet to the checkpoint folder.

    Its files are compressed, those of its shuffles go at once, and a plan that reads it knows its size. After `checkpoint()`
    a plan counts the estimate of the plan before, a product over all joins, which a loop grows to millions of digits.
    """
    spark = df.sparkSession
    _ready(spark)
    path, before = f"{spark.sparkContext.getCheckpointDir()}/graphloom-{uuid.uuid4().hex}", spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of kept frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(*facts: DataFrame) -> list[DataFrame]:
    """The facts, each computed once and kept in the checkpoint folder, for operators that read them many times."""
    return [kept(f) for f in facts]


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """`seed`, `node`, `depth` (least) for all nodes within `max_depth` steps of each seed, seeds included at 0.

    `edges` has `src` and `dst`, `seeds` has `seed` and `node` (many nodes may share a seed: a multi-source search).
    """
    _ready(edges.sparkSession)
    step = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")
    # Once for all steps: the edges may be a long plan of their own.
    step = kept(step.where("src is not null and dst is not null").distinct())
    seen = kept(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, max_depth + 1):
        new = frontier.join(step, frontier.node == step.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = kept(new.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def fixpoint(start: DataFrame, grow, keys: list[str], max_rounds: int = 64) -> DataFrame:
    """`start` and all that `grow` derives from it, until nothing new comes. `grow` maps the newest rows to candidates."""
    _ready(start.sparkSession)
    seen = kept(start.dropDuplicates(keys))
    frontier = seen
    for _ in range(max_rounds):
        frontier = kept(grow(frontier).dropDuplicates(keys).join(seen, keys, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 8) -> DataFrame:
    """`hop`, `node` of one shortest path from a source to a target (column `node` each); empty if there is none.

    Of several the path with the smallest node at each hop from the target backwards.
    """
    _ready(edges.sparkSession)
    edges = edges.select("src", "dst").where("src is not null and dst is not null").checkpoint()
    level = sources.select("node").distinct().withColumns({"hop": F.lit(0), "parent": F.lit(None).cast(edges.schema["src"].dataType)}).checkpoint()
    seen, ends = level, targets.select("node").distinct()
    for hop in range(1, max_hops + 1):
        if not level.join(ends, "node", "left_semi").isEmpty() or level.isEmpty():
            break
        new = level.select("node").join(edges.select(F.col("src").alias("node"), "dst"), "node")
        new = new.groupBy(F.col("dst").alias("to")).agg(F.min("node").alias("parent"))
        level = new.join(seen.select(F.col("node").alias("to")), "to", "left_anti").select(F.col("to").alias("node"), F.lit(hop).alias("hop"), "parent").checkpoint()
        seen = seen.unionByName(level)
    hit = seen.join(ends, "node", "left_semi").orderBy("hop", "node").limit(1).collect()
    path, rows = [], hit
    while rows:  # at most max_hops + 1 rows
        path.append((rows[0].hop, rows[0].node))
        rows = seen.where((F.col("node") == F.lit(rows[0].parent)) & (F.col("hop") == rows[0].hop - 1)).collect() if rows[0].parent is not None else []
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(path[::-1], f"hop int, node {kind}")


def call_graph(edges: DataFrame, center: DataFrame, depth: int, per_node: int, reverse: bool = False) -> DataFrame:
    """`level`, `src`, `dst`, `weight` of the edges around a centre: at each level the heaviest `per_node` of a node.

    `edges` has `src`, `dst`, `weight`; ties go to the smaller neighbour.
    """
    from pyspark.sql import Window

    _ready(edges.sparkSession)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    top = Window.partitionBy(a).orderBy(F.desc("weight"), b)
    edges = edges.select("src", "dst", "weight").checkpoint()
    frontier = center.select(F.col("node").alias(a)).distinct().checkpoint()
    seen, out = frontier, None
    for level in range(1, depth + 1):
        best = edges.join(frontier, a, "left_semi").withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= per_node).drop("_r")
        best = best.select(F.lit(level).alias("level"), "src", "dst", "weight").checkpoint()
        out = best if out is None else out.unionByName(best)
        frontier = best.select(F.col(b).alias(a)).distinct().join(seen, a, "left_anti").checkpoint()
        seen = seen.unionByName(frontier)
    return out
