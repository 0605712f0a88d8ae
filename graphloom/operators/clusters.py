"""Changed symbols grouped into pieces of work along their calls, and the risk of each piece."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import discard, kept

#: A change that this many changed functions call is a tool of all of them; the reach and size of a cluster.
HUB_CALLERS, CLUSTER_DEPTH, CLUSTER_SIZE = 4, 3, 20
#: What new calls of one function add to the risk at most, and the rise of complexity that counts.
CALLS_RISK_CAP, COMPLEXITY_RISE = 3, 5
CALLABLE = ("function", "method")


def claims(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """`root`, `node`, `depth`, `position`: the changed functions, each claimed by one root.

    `functions` is (id, exported, complexity), `edges` (src, dst); only links between two of them count. Roots go in the order
    uncalled first, then exported, then complex, then the smaller id. A root that nobody claimed claims breadth first along
    its calls, callees by id, to three levels and twenty members; a function with four changed callers or more is never
    claimed and is a root of its own.

    The sequence is run in rounds. A root is ready when it comes before every free root that could meet any function within
    its reach; ready roots cannot meet, so a round claims for all of them at once and the result is that of one after the
    other. At most three callers lead to a function that can be claimed, so it lies within the reach of at most 40 roots and
    the state is 40 rows a function. The number of rounds is the longest chain of overlapping reaches with falling order.
    """
    known = kept(functions.groupBy("id").agg(F.bool_or(F.coalesce("exported", F.lit(False))).alias("exported"), F.max(F.coalesce("complexity", F.lit(0))).alias("complexity")))
    ids = known.select("id")
    links = kept(edges.select("src", "dst").where("src <> dst").distinct().join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi"))
    called = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    hubs = called.where(F.col("n") >= HUB_CALLERS).select(F.col("id").alias("dst"))
    down = kept(links.join(hubs, "dst", "left_anti").select("src", "dst"))
    order = F.struct(F.col("n").isNotNull().alias("called"), (~F.col("exported")).alias("hidden"), (-F.col("complexity")).alias("simple"), F.col("id").alias("id"))
    level = kept(known.join(called, "id", "left").select(F.col("id").alias("root"), F.col("id").alias("node"), order.alias("rank")))
    levels = [level]
    for _ in range(CLUSTER_DEPTH):
        level = kept(level.join(down, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), "rank").distinct())
        levels.append(level)
    pairs, out = kept(reduce(DataFrame.unionByName, levels).distinct()), []
    discard(known, links, *levels[:-1])
    while not pairs.isEmpty():
        least = pairs.groupBy("node").agg(F.min("rank").alias("least"))
        ready = pairs.join(least, "node").groupBy("root").agg(F.bool_and(F.col("rank") == F.col("least")).alias("ready")).where("ready")
        taken = kept(ready.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("position")))
        level, free = taken, pairs.where("root = node").select("node")
        for depth in range(1, CLUSTER_DEPTH + 1):
            met = level.join(down, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min("position").alias("by"))
            met = met.join(free, "node", "left_semi").join(taken.select("root", "node"), ["root", "node"], "left_anti")
            nth = F.row_number().over(Window.partitionBy("root").orderBy("by", "node"))
            # The literal limit lets each task cut its rows before the shuffle; the room that is left decides.
            met = met.withColumn("k", nth).where(F.col("k") < CLUSTER_SIZE)
            size = taken.groupBy("root").agg(F.max("position").alias("size"))
            level = kept(met.join(size, "root").select("root", "node", F.lit(depth).alias("depth"), (F.col("size") + F.col("k")).alias("position")).where(F.col("position") <= CLUSTER_SIZE))
            taken = taken.unionByName(level)
        out.append(taken)
        gone = taken.select("node")
        before, pairs = pairs, kept(pairs.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "root"), "root", "left_anti"))
        discard(before)
    return reduce(DataFrame.unionByName, out) if out else level.select("root", "node", F.lit(0).alias("depth"), F.lit(1).alias("position"))


def change_clusters(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """`cluster`, `label`, `id`, `position`: every changed symbol in one piece of work, the first member at position 1.

    `changes` are the added and modified symbols of source files (id, path, name, container, kind, exported, complexity),
    one row an id; `edges` (src, dst) the certain calls of the head. Functions and methods go by `claims`; types and
    constants, which have no calls, by file. A cluster of a file with several members is named after the file.
    """
    named = F.when(F.col("container").isNotNull(), F.concat_ws(".", "container", "name")).otherwise(F.col("name"))
    rows = changes.select("id", "path", "kind", "exported", "complexity", named.alias("label"))
    functions = rows.where(F.col("kind").isin(*CALLABLE))
    claimed = claims(functions, edges).join(functions.select(F.col("id").alias("root"), "label"), "root")
    claimed = claimed.select(F.concat(F.lit("cluster:"), F.col("root").cast("string")).alias("cluster"), "label", F.col("node").alias("id"), "position")
    rest = rows.where(~F.coalesce(F.col("kind").isin(*CALLABLE), F.lit(False)))
    sizes = rest.groupBy("path").agg(F.count("*").alias("n"))
    rest = rest.join(sizes, "path").withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("id")))
    by_file = F.when(F.col("n") == 1, F.col("label")).otherwise(F.element_at(F.split("path", "/"), -1))
    return claimed.unionByName(rest.select(F.concat(F.lit("cluster:"), F.col("path")).alias("cluster"), by_file.alias("label"), "id", "position"))


def cluster_risk(clusters: DataFrame, changes: DataFrame, behaviour: DataFrame, entries: DataFrame) -> DataFrame:
    """`cluster`, `label`, `members`, `entries`, `risk` and the counts behind it: `exported`, `signature`, `io`, `calls`, `complexity`, `untested`.

    `clusters` as from `change_clusters`; `changes` adds status, complexity_before (null: added), signature_changed,
    shape_changed and tests; `behaviour` is (id, io_added, calls_added), `entries` (entry_id, symbol_id) the symbols that an
    entry is or reaches. A member adds 1, and 3 if exported, 2 for a changed signature, 4 a new kind of I/O, up to 3 for new
    calls, 2 for 5 more points of complexity, 2 for a changed body without tests; each entry that meets the cluster adds 1.
    """
    rows = clusters.join(changes.drop("path", "name", "container"), "id").join(behaviour.groupBy("id").agg(F.max("io_added").alias("io_added"), F.max("calls_added").alias("calls_added")), "id", "left")
    flag = lambda condition: F.coalesce(condition.cast("long"), F.lit(0).cast("long"))
    new = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    reasons = {
        "exported": flag(F.col("exported")),
        "signature": flag((F.col("status") == "modified") & F.col("signature_changed")),
        "io": new("io_added"),
        "calls": new("calls_added"),
        "complexity": flag(F.col("complexity") - F.col("complexity_before") >= COMPLEXITY_RISE),
        "untested": flag(F.col("kind").isin(*CALLABLE) & (F.col("tests") == 0) & F.col("shape_changed")),
    }
    each = rows.select("cluster", "label", F.least(reasons["calls"], F.lit(CALLS_RISK_CAP)).alias("capped"), *[c.alias(f"_{n}") for n, c in reasons.items()])
    points = 1 + 3 * F.col("_exported") + 2 * F.col("_signature") + 4 * F.col("_io") + F.col("capped") + 2 * F.col("_complexity") + 2 * F.col("_untested")
    sums = each.groupBy("cluster", "label").agg(F.count("*").alias("members"), F.sum(points).alias("own"), *[F.sum(f"_{n}").alias(n) for n in reasons])
    touch = clusters.select("cluster", F.col("id").alias("symbol_id")).join(entries.select("entry_id", "symbol_id").distinct(), "symbol_id")
    touch = touch.groupBy("cluster").agg(F.count_distinct("entry_id").alias("entries"))
    out = sums.join(touch, "cluster", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))
    return out.select("cluster", "label", "members", "entries", (F.col("own") + F.col("entries")).alias("risk"), *reasons)
