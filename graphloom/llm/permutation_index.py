"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order (after lifting all vectors to one length, so that a large inner
product is a small angle). Each pivot has an inverted file of the vectors that have it among their nearest POSTED pivots,
and a query is posted to the files of its own. Files are the shuffle's keys; a long file is dealt into blocks. In a file,
vectors are ranked by the footrule distance of their permutation to the query's, and those within the query's radius are
reranked by inner product. The radius is the distance that RERANK_SHARE of a fixed sample of the vectors keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Pivots are the vectors with the smallest hash of their number of which no two are closer than ALIKE; each vector lists its nearest DEPTH of them and is
#: posted in the files of the first POSTED.
PIVOTS, DEPTH, POSTED = 512, 128, 20
#: The share of all vectors that a query reranks if they are posted with it, and the sample on which its radius is
#: found: at most SAMPLE vectors, those with the smallest hash of their number. Of vectors whose cosine is at least ALIKE
#: one stands for all, so that a crowd of near copies fills neither pivots nor a radius. Recall was measured at these values.
RERANK_SHARE, SAMPLE, ALIKE = 0.12, 4096, 0.9
#: The radius also keeps so many times k + 1 vectors of the sample: a share of a small table is too few for k neighbours.
RERANK_LEAST = 8
#: A vector that at least one in POPULAR rows has (so at most POPULAR vectors), and k + 1 rows, is compared with every
#: query: its copies alone can be a whole result.
POPULAR = 512
#: Rows and queries of a block of an inverted file.
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 4096


def is_valid(vector: Column) -> Column:
    """Not null, with finite components only, one of them not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one more component that makes all of them as long as the longest.

    A query keeps 0 there, so that its largest inner products are its smallest angles to the lifted vectors.
    """
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1, keepdims=True), 0))])


def unlike(x: np.ndarray, alike: float = ALIKE) -> np.ndarray:
    """The places of rows that are no near copy of an earlier one of them. All rows are equally long."""
    kept, most = np.zeros_like(x), alike * (x[:1] ** 2).sum()
    out: list[int] = []
    for n, row in enumerate(x):
        if not out or (kept[: len(out)] @ row).max() < most:
            kept[len(out)] = row
            out.append(n)
    return np.array(out, np.int64)


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The places of the nearest pivots of each row, nearest first; ties go to the earlier pivot."""
    near = x @ pivots.T  # lifted pivots are equally long
    return np.argsort(-near, axis=1, kind="stable")[:, :depth]


def footrule_gain(query: np.ndarray, weights: np.ndarray, depth: int) -> np.ndarray:
    """How much less than the greatest distance the footrule distance of each row to a query's list is.

    Against lists without a common pivot, one at places i and j saves 2 (depth - max(i, j)). `weights` has a row a pivot:
    depth - place where a vector lists it, else 0.
    """
    own = (depth - np.arange(len(query))).astype(weights.dtype)
    return 2 * np.minimum(weights[query], own[:, None]).sum(axis=0, dtype=np.int32)


def place_weights(lists: np.ndarray, pivots: int, depth: int) -> np.ndarray:
    out = np.zeros((pivots, len(lists)), np.int16)
    out[lists, np.arange(len(lists))[:, None]] = depth - np.arange(lists.shape[1])
    return out


def search_file(pivot: int, ids, x, qid, q, radius, pivots: np.ndarray, longest: float, k: int, depth: int, posted: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each query of a block of a pivot's file the k nearest of the block's vectors: (query ids, ids, scores).

    A vector that shares several posted pivots with a query is compared only in the file of the query's first of them.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    lists = permutations(lifted(x, longest), pivots, depth)
    weights = place_weights(lists, len(pivots), depth)
    asked = permutations(np.hstack([q, np.zeros((len(q), 1))]), pivots, depth)
    for n in range(len(qid)):
        first = int(np.flatnonzero(asked[n] == pivot)[0])
        here = (weights[asked[n, :first]] > depth - posted).any(axis=0) if first else np.zeros(len(ids), bool)
        near = np.flatnonzero(~here & (footrule_gain(asked[n], weights, depth) >= radius[n]))
        score = (x[near] * q[n]).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:k]
        yield np.full(len(best), qid[n]), ids[near[best]], score[best]


def _padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def distinct_vectors(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows that take part (`rid`, `vec_id`, `x`) and the distinct vectors (`node`, `x`, `ids`, `popular`).

    `ids` are the k + 1 smallest (vec_id, rid) of the rows with the vector: no result needs more of its copies. `node`
    is the smallest rid of them.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))
    rows = written(rows.where(F.col("vec_id").isNotNull() & is_valid(F.col("x").cast("array<double>"))), "vectors")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id", "rid"))).where(F.col("r") <= k + 1)
    one = ranked.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("vec_id", "rid"))).alias("ids"))
    least = max(k + 1, rows.count() / POPULAR)
    often = rows.groupBy("x").agg(F.count("*").alias("copies")).where(F.col("copies") >= least).select(F.col("x").alias("y"))
    one = one.join(F.broadcast(often), F.col("x") == F.col("y"), "left")
    return rows, written(one.select(F.col("ids")[0]["rid"].alias("node"), "x", "ids", F.col("y").isNotNull().alias("popular")), "distinct")


def _exact(one: DataFrame, asking: DataFrame, n: int, n_asking: int, width: int, k: int) -> DataFrame:
    """The k nearest of all distinct vectors to each query, found block by block: `query`, `node`, `score`."""
    blocks, turns = -(-n // ROWS_PER_BLOCK), -(-n_asking // QUERIES_PER_BLOCK)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = one.select(F.lit(False).alias("asks"), "node", "x", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("a"), each(turns).alias("b"))
    right = asking.select(F.lit(True).alias("asks"), "node", "x", F.pmod(F.xxhash64("node"), F.lit(turns)).cast("int").alias("b"), each(blocks).alias("a"))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        asks, x, node = block.asks.to_numpy(bool), _padded(block.x, width), block.node.to_numpy(np.int64)
        out = []
        for query, q in zip(node[asks], x[asks], strict=True):
            score = (x[~asks] * q).sum(axis=1)
            best = np.lexsort((node[~asks], -score))[:k]
            out.append(pd.DataFrame({"query": query, "node": node[~asks][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "node": [], "score": []})

    return left.unionByName(right).groupBy("a", "b").applyInPandas(search, "query long, node long, score double")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, n_pivots: int = PIVOTS, depth: int = DEPTH, posted: int = POSTED, share: float = RERANK_SHARE
) -> DataFrame:
    """The k nearest rows of each row whose `vec_id` is divisible by `every`: `query_id`, `rank`, `vec_id`, `score`.

    Nearness is the largest inner product in double precision on the original vectors; ties go to the smaller vec_id.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without a vec_id.
    Vectors of other lengths count as padded with zeros. Every row is a candidate for every query but itself, rows that
    repeat a vec_id too: each of them asks and is found as a row of its own. With fewer candidates than k all are
    returned: queries that the files leave short of k are compared with all rows, in blocks. Every row is indexed; only pivots and radii come from a sample.

    Equal vectors are indexed once and their rows, of which the k + 1 smallest can matter, put back afterwards; so copies
    fill neither a file nor a radius, and the most popular vectors are compared with every query. The blocks of a file have a bounded number of rows and queries. The work grows
    with queries times rows: a query meets the rows posted with it, about a half of all, of which it reranks `share`.
    """
    spark = vectors.sparkSession
    rows, one = distinct_vectors(vectors, k)
    doubles = F.col("x").cast("array<double>")
    total = one.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, v: a + v * v))).alias("longest")).first()
    found = "query long, node long, score double"
    if not total.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sampled = one.orderBy(F.xxhash64("node"), "node").limit(max(SAMPLE, n_pivots)).select("x").toPandas().x
    sample = lifted(_padded(sampled, total.width), total.longest)
    sample = sample[unlike(sample)]
    pivots = sample[:n_pivots]
    depth, posted = min(depth, len(pivots)), min(posted, len(pivots))
    held = place_weights(permutations(sample, pivots, depth), len(pivots), depth)
    keep = min(len(sample), max(int(np.ceil(share * len(sample))), RERANK_LEAST * (k + 1)))
    loud = one.where("popular").select("node", "x").toPandas()  # at most POPULAR
    sent = spark.sparkContext.broadcast((pivots, held, loud.node.to_numpy(np.int64), _padded(loud.x, total.width)))
    width, longest = total.width, total.longest
    queries = rows.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "x")
    queries = written(queries.join(one.select(F.col("x").alias("y"), "node"), F.col("x") == F.col("y")).select("rid", "vec_id", "node"), "queries")
    asking = one.join(queries.select("node").distinct(), "node").select("node", "x")

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = permutations(lifted(_padded(b.x, width), longest), sent.value[0], posted)
            yield pd.DataFrame({"node": b.node.repeat(posted), "x": b.x.repeat(posted), "pivot": lists.ravel()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, held, *_ = sent.value
        for b in batches:
            lists = permutations(np.hstack([_padded(b.x, width), np.zeros((len(b), 1))]), pivots, depth)
            gains = (footrule_gain(q, held, depth) for q in lists)
            radius = np.array([np.partition(g, len(g) - keep)[len(g) - keep] for g in gains], np.int32)
            yield pd.DataFrame({"node": b.node.repeat(posted), "x": b.x.repeat(posted), "pivot": lists[:, :posted].ravel(), "radius": radius.repeat(posted)})

    def ask_popular(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *_, nodes, x = sent.value
        for b in batches:
            for query, q in zip(b.node, _padded(b.x, width), strict=True):
                score = (x * q).sum(axis=1)
                best = np.lexsort((nodes, -score))[: k + 1]
                yield pd.DataFrame({"query": query, "node": nodes[best], "score": score[best]})

    kind = one.schema["x"].dataType.simpleString()
    files = written(one.where("not popular").select("node", "x").mapInPandas(post, f"node long, x {kind}, pivot int"), "postings")
    asks = written(asking.mapInPandas(ask, f"node long, x {kind}, pivot int, radius int"), "asks")
    many = lambda df, most: F.broadcast(df.groupBy("pivot").agg(F.ceil(F.count("*") / most).alias("parts")))
    blocks, turns = many(files, ROWS_PER_BLOCK).withColumnRenamed("parts", "blocks"), many(asks, QUERIES_PER_BLOCK).withColumnRenamed("parts", "turns")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block, turn = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns"))
    left = files.join(turns, "pivot").join(blocks, "pivot").select(F.lit(False).alias("asks"), "node", "x", "pivot", F.lit(0).alias("radius"), block.alias("a"), each("turns").alias("b"))
    right = asks.join(turns, "pivot").join(blocks, "pivot").select(F.lit(True).alias("asks"), "node", "x", "pivot", "radius", turn.alias("b"), each("blocks").alias("a"))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        asks, out = block.asks.to_numpy(bool), []
        if asks.any() and not asks.all():
            node, x, radius = block.node.to_numpy(np.int64), _padded(block.x, width), block.radius.to_numpy()
            out = list(search_file(int(block["pivot"].iloc[0]), node[~asks], x[~asks], node[asks], x[asks], radius[asks], sent.value[0], longest, k + 1, depth, posted))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query", "node", "score"), parts, strict=True)))

    part = left.unionByName(right).groupBy("pivot", "a", "b").applyInPandas(search, found)
    if len(loud):
        part = part.unionByName(asking.mapInPandas(ask_popular, found))
    top = lambda n: F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *n))
    part = part.withColumn("r", top(["node"])).where(F.col("r") <= k + 1).drop("r")
    each_row = part.join(one.select("node", "ids"), "node").select("query", "score", F.inline("ids"))
    kept = lambda df: df.withColumn("r", top(["vec_id", "rid"])).where(F.col("r") <= k + 1).drop("r")
    each_row = written(kept(each_row), "near")
    found_few = each_row.groupBy("query").count().where(F.col("count") >= min(k + 1, rows.count()))
    short = written(asking.join(found_few, F.col("node") == F.col("query"), "left_anti"), "short")
    if n_short := short.count():
        every_row = _exact(one, short, total.n, n_short, width, k + 1).join(one.select("node", "ids"), "node").select("query", "score", F.inline("ids"))
        each_row = each_row.join(short.select(F.col("node").alias("query")), "query", "left_anti").unionByName(written(kept(every_row), "whole"))
    asked = queries.select(F.col("rid").alias("own"), F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    out = asked.join(each_row, "query").where("own <> rid")
    best = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "rid")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
