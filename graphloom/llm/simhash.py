"""Near-duplicate detection: SimHash fingerprints, anchor-point covering, connected components.

Covering. The 64 bits fall into six blocks. `TRIPLES` are sets of three blocks such that, however at most four
differing bits are spread over the blocks, at least one triple holds at most one of them (`triples_cover` proves it).
On 31 bits of each triple the perfect Hamming code [31, 26] is the covering code: its words are the anchors, and
every 31-bit word lies within the covering radius 1 of exactly one anchor, its home. A fingerprint is replicated to
every anchor within radius plus threshold (1 + 1) of it on the triple: 1 or 16 anchors, of 2^26. Two linked
fingerprints meet at the home of either of them in some triple, and are compared there on all 64 bits.

Growth. Each triple has 2^26 anchors and a fingerprint has 91 rows, so an anchor holds a pair of unrelated fingerprints
once there are some 10^7 of them; beyond about 10^9 distinct fingerprints CODE_BITS (and the blocks) must grow.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import field, numbered, row_order, shuffle_width, without_rows, written
from graphloom.llm.components import connected_components

SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
CODE_BITS = 31


def triples_cover(triples=TRIPLES, blocks: int = len(BLOCKS), differing: int = MAX_DISTANCE, within: int = 1) -> bool:
    """Whether each way to spread at most `differing` bits over the blocks leaves a triple with at most `within`."""
    spreads = (s for s in itertools.product(range(differing + 1), repeat=blocks) if sum(s) <= differing)
    return all(any(sum(s[b] for b in t) <= within for t in triples) for s in spreads)


def print_of(parts: Iterable) -> int:
    """The SimHash of 64-bit hashes in arrays, as a signed integer: a bit is 1 if set in over half of all; none give 0."""
    import numpy as np

    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_of(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text as a signed 64-bit integer; no words give 0."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    # Long texts in pieces of bounded memory.
    return print_of(np.fromiter((digest(b" ".join(words[i : i + size]), seed) for i in range(at, min(n, at + 65536))), np.uint64) for at in range(0, n, 65536))


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(fingerprint_of).astype("int64")


def _take(bits: Column, triple: tuple[int, int, int]) -> Column:
    """The first 31 bits of a triple's blocks, side by side."""
    out, at = F.lit(0).cast("long"), 0
    for b in triple:
        start, width = BLOCKS[b]
        width = min(width, CODE_BITS - at)
        part = F.shiftrightunsigned(bits, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out, at = out.bitwiseOR(F.shiftleft(part, at)), at + width
    return out


def _syndrome(word: Column) -> Column:
    """XOR of the places (from 1) of the set bits: 0 on code words, else the place whose flip leads home."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (place - 1) for place in range(1, CODE_BITS + 1) if place >> j & 1)
        parity = F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))) % 2
        out = out + parity * (1 << j)
    return out


def _steps(radius: int) -> list[list[int]]:
    """For each syndrome the masks that lead from a word to all anchors within `radius` (1 or 2) of it."""
    at = lambda place: 1 << (place - 1)
    out = [[0]]
    for s in range(1, CODE_BITS + 1):
        second = [at(i) | at(i ^ s) for i in range(1, CODE_BITS + 1) if i != s and i < i ^ s]
        out.append([at(s)] + second * (radius > 1))
    return out


def _anchors(prints: DataFrame, radius: int) -> DataFrame:
    """The columns of `prints` and an anchor for each triple and each mask; the triple's number stands above the 31 bits."""
    words = [F.struct(_take(F.col("fp"), t).alias("word"), F.lit(k << CODE_BITS).cast("long").alias("tag")) for k, t in enumerate(TRIPLES)]
    steps = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in _steps(radius)])
    spread = prints.repartition(shuffle_width(prints.sparkSession), "fp")  # few bytes become many rows
    spread = spread.select(*prints.columns, F.inline(F.array(*words)))
    spread = spread.select("*", F.explode(F.element_at(steps, _syndrome(F.col("word")) + 1)).alias("step"))
    return spread.select(*prints.columns, F.col("word").bitwiseXOR(F.col("step")).bitwiseOR(F.col("tag")).alias("anchor"))


def homes(prints: DataFrame) -> DataFrame:
    """One anchor a triple: the code word within the covering radius."""
    return _anchors(prints, 1)


def visits(prints: DataFrame) -> DataFrame:
    """All anchors within radius plus threshold: the home, and for words off the code the fifteen at distance 2."""
    return _anchors(prints, 2)


def _distance() -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")))


def component_of_prints(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`fp`, `component` (smallest `fp` reachable) for each distinct fingerprint of `prints` that is not its own component.

    Dense groups do not become all their pairs. First each visitor of an anchor is linked to the smallest
    fingerprint at home there, if they differ in few enough bits; the components of these stars join dense groups.
    Then visitors and homes are compared in full, but only links between different components are kept.
    """
    if max_distance > MAX_DISTANCE:
        raise ValueError(f"the covering holds up to {MAX_DISTANCE} differing bits")
    least = homes(prints).groupBy("anchor").agg(F.min("fp").alias("b"))
    stars = visits(prints).select("anchor", F.col("fp").alias("a")).join(least.hint("merge"), "anchor").where("a <> b").where(_distance() <= max_distance)
    joined = written(connected_components(stars.select(F.col("a").alias("u"), F.col("b").alias("v"))), "stars")
    known = prints.join(joined, prints.fp == joined.node, "left").select("fp", F.coalesce("component", "fp").alias("c"))
    known = written(known, "known")
    left = visits(known).select("anchor", F.col("fp").alias("a"), F.col("c").alias("u"))
    right = homes(known).select("anchor", F.col("fp").alias("b"), F.col("c").alias("v"))
    cross = left.join(right.hint("merge"), "anchor").where("u <> v").where(_distance() <= max_distance).select("u", "v")
    merged = connected_components(cross)
    out = known.join(merged, known.c == merged.node, "left").select("fp", F.coalesce("component", "c").alias("component"))
    return out.where("fp <> component")


def checked_components(prints: DataFrame, check: Callable[[DataFrame], DataFrame], max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`node`, `component` (smallest `node` reachable) for each row of `prints` (node, fp) that is not its own component.

    As `component_of_prints`, but fingerprints only find the candidates: nodes whose fingerprints differ in at most
    `max_distance` bits are linked if `check`, given pairs (a, b), keeps them. Nodes may share a fingerprint. All visits
    are dealt out once; the second pass reads those that met another node, at anchors that still hold two components.
    Fingerprints travel with the visits and are compared at the anchor: what only meets there never becomes a pair.
    """
    if max_distance > MAX_DISTANCE:
        raise ValueError(f"the covering holds up to {MAX_DISTANCE} differing bits")
    prints = prints.select("node", "fp")
    close = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_distance
    least = homes(prints).groupBy("anchor").agg(F.min("node").alias("b"))
    met = visits(prints).select("anchor", F.col("node").alias("a"), F.col("fp").alias("f")).join(least.hint("merge"), "anchor").where("a <> b")
    met = written(met, "met")
    near = met.join(prints.toDF("b", "g"), "b").where(close).select("a", "b").distinct()
    joined = written(connected_components(check(near).toDF("u", "v")), "stars")
    known = written(prints.join(joined, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("c")), "known")
    placed = written(met.join(known.select(F.col("node").alias("a"), F.col("c").alias("u")), "a"), "placed")
    mixed = placed.join(known.select(F.col("node").alias("b"), F.col("c").alias("v")), "b").where("u <> v").select("anchor").distinct()
    mixed = written(mixed, "mixed-anchors")
    left = placed.select("anchor", "a", "f", "u").join(mixed, "anchor")
    right = homes(known).select("anchor", F.col("node").alias("b"), F.col("fp").alias("g"), F.col("c").alias("v")).join(mixed, "anchor")
    cross = left.hint("merge").join(right, "anchor").where("u <> v").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = check(cross).toDF("u", "v").unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return connected_components(links)


def _grouped(rows: DataFrame, max_distance: int) -> DataFrame:
    """`key`, `rid`, `fp`, `component_id` and `stays` for each of the rows (`key`, `text`, `rid`)."""
    own = rows.select("key", "rid", fingerprints("text").alias("fp"))
    own = written(own, "fingerprints").withColumn("order", row_order())
    per = own.groupBy("fp").agg(F.min("key").alias("least"), F.min("order").alias("first"))
    per = written(per, "prints")
    linked = written(component_of_prints(per.select("fp"), max_distance).withColumnRenamed("fp", "node"), "links")
    per = per.join(linked, per.fp == linked.node, "left").select("fp", "least", "first", F.coalesce("component", "fp").alias("component"))
    best = per.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("best"))
    ids = per.join(best, "component").select(F.col("fp").alias("print"), "component_id", "best")
    return own.join(ids, own.fp == ids.print).select("key", "rid", "fp", "component_id", (F.col("order") == F.col("best")).alias("stays"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of `docs`: the key, `fingerprint` (16 hex digits), `component_id`.

    Texts are lower-cased in A-Z, split at ASCII white space and shingled by four words. Fewer words give one
    shingle; no words (also null text) give the fingerprint zero, which links like any other. Fingerprints that
    differ in at most `max_distance` bits are linked; `component_id` is the smallest key in the component, nulls
    aside (null if all keys of a component are null). Repeated rows are returned as often as they came. An empty
    table gives an empty result. Only the two named columns are read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    return _grouped(rows, max_distance).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_filter(docs: DataFrame, key: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each component.

    The row with the smallest key stays (a null key comes last), the first as written if rows share that key.
    """
    rows = numbered(docs)
    own = rows.select(field(key).alias("key"), field(text).alias("text"), "rid")
    return without_rows(rows, _grouped(own, max_distance).where(~F.col("stays")))
