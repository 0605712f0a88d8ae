"""Packing into fixed sequences: cutting-stock by column generation over the histogram of remainder lengths.

Each document's ids are cut at multiples of the sequence length, and a remainder above a quarter of a sequence once
more at its last multiple of a quarter: long remainders would find no partners. Full pieces are sequences of their
own; the others are the items of a cutting-stock problem. Only their length histogram (a little over a quarter of a
sequence of counters) reaches the driver. There a linear program over patterns is solved: duals of the current basis price
new patterns by an unbounded knapsack (dynamic programming), until no pattern improves it or the waste is below
`GAP`. Rounded-down patterns and a greedy cover of what the rounding leaves become a table of rank intervals, and the
documents, ranked within their length on Spark, look up their place in it.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.byte_pairs import BytePairs
from graphloom.llm.common import kept, shuffle_width, small_batches, tidy, written

CAPACITY = 1024
END_ID = 0
#: The program stops when its sequences exceed the volume bound by no more than this share.
GAP = 0.001
MAX_ROUNDS = 60

class _Ids:
    """The ids of a tokenizer file: by tiktoken where the file is a plain byte-level BPE, else by the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        try:
            self.encode = BytePairs(path).encode
        except (KeyError, ValueError):
            self.encode = lambda text: np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)


@kept
def _ids(path: str) -> _Ids:
    """One for all tasks of a Python worker."""
    return _Ids(path)


def token_bytes(text: str | None, ids: _Ids) -> bytes:
    """The ids of a text and the end id, 4 bytes each."""
    end = END_ID.to_bytes(4, "little")
    return ids.encode(text).astype("<u4").tobytes() + end if text else end


def tokenized(docs: DataFrame, tokenizer: str, text: str = "text", with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """`docs` with `_t`: the number of ids and the CRC-32 of each piece of `capacity` ids (and the ids, if asked for)."""
    fields = [T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    @F.pandas_udf(T.StructType(fields))
    @tidy(_ids)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids = _ids(tokenizer)
        for batch in batches:
            got = [token_bytes(t, ids) for t in batch]
            cut = [[zlib.crc32(b[4 * i : 4 * j]) for i, j in itertools.pairwise(cuts(len(b) // 4, capacity))] for b in got]
            yield pd.DataFrame({"n": [len(b) // 4 for b in got], "crcs": cut} | ({"ids": got} if with_ids else {}))

    return docs.withColumn("_t", encode(F.col(text)))


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document of n ids begin, and n."""
    at, grain = list(range(0, n, capacity)), capacity // 4
    if grain < n - at[-1] < capacity and n % grain:
        at.append(n - n % grain)
    return [*at, n]


def _price_patterns(lengths: np.ndarray, price: np.ndarray, capacity: int, most: int) -> tuple[float, list[np.ndarray]]:
    """The unbounded knapsack: the value of the dearest multiset of lengths that fits, and the dearest patterns by their largest item."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - lengths[:k]] + price[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], took[c] = gain[j], j
    value, found = price + best[capacity - lengths], []
    for j in np.argsort(-value, kind="stable")[:most]:
        if value[j] <= 1 + 1e-9:
            break
        counts, c = np.zeros(len(lengths)), capacity - int(lengths[j])
        counts[j] = 1
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                counts[took[c]] += 1
                c -= int(lengths[took[c]])
        found.append(counts)
    return best[capacity], found


def solve_patterns(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, max_rounds: int = MAX_ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: times}) patterns that hold each item of the histogram exactly once."""
    full = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0 and k != capacity), dtype=np.int64)
    if not len(lengths):
        return full
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError("an item is longer than a sequence, or empty")
    demand = np.array([histogram[int(k)] for k in lengths], float)
    bound = float(lengths @ demand) / capacity
    columns = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1 / (capacity // lengths))
    amount = inverse @ demand
    for _ in range(max_rounds):
        if np.abs(columns @ amount - demand).max() > 1e-6 * demand.max():  # the updates' rounding errors have added up
            inverse = np.linalg.inv(columns)
            amount = np.maximum(inverse @ demand, 0)
        if amount.sum() <= bound * (1 + gap):
            break
        value, patterns = _price_patterns(lengths, inverse.sum(axis=0), capacity, len(lengths))
        if value <= 1 + 1e-9 or amount.sum() / value >= amount.sum() * (1 - gap):  # the dual bound
            break
        for pattern in patterns:
            if inverse.sum(axis=0) @ pattern <= 1 + 1e-9:  # an earlier one took its place
                continue
            step = inverse @ pattern
            ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
            out = int(ratio.argmin())
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            least = ratio[out]
            amount = np.maximum(amount - step * least, 0)
            amount[out] = least
            columns[:, out] = pattern
    left, plan = demand.astype(np.int64), full
    for j in np.argsort(-amount, kind="stable"):
        pattern = columns[:, j].astype(np.int64)
        used = pattern > 0
        copies = int(min(np.floor(amount[j] + 1e-7), (left[used] // pattern[used]).min()))
        if copies:
            plan.append((copies, {int(lengths[i]): int(pattern[i]) for i in np.flatnonzero(used)}))
            left -= copies * pattern
    rest = {int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}
    while rest:  # at most one sequence per basis column and a few more: largest first, then the largest that fits
        room, pattern, take = capacity, {}, {}
        for k in sorted(rest, reverse=True):
            if k <= room:
                take[k] = min(rest[k], room // k)
                room -= k * take[k]
        copies = min(rest[k] // n for k, n in take.items())
        for k, n in take.items():
            pattern[k] = n
            rest[k] -= n * copies
            if not rest[k]:
                del rest[k]
        plan.append((copies, pattern))
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, last rank + 1, first sequence, times in a sequence, first offset; ranks and sequences from 0."""
    rows, ranks, sequence = [], {}, 0
    for copies, pattern in plan:
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            first = ranks.get(length, 0)
            ranks[length] = first + copies * times
            rows.append((length, first, ranks[length], sequence, times, offset))
            offset += length * times
        sequence += copies
    return rows


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: the key, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset` (and `ids`).

    Every document, null and empty text included, ends in one end id and so has at least one piece. Each id lies in
    exactly one piece. Repeated rows and keys are packed as often as they come; keys may be null. Ties are ranked by
    the row number of the scan. An empty table gives an empty result. Only the two named columns are read.
    """
    spark = docs.sparkSession
    salts = 4 * shuffle_width(spark)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    with small_batches(spark):
        own = written(tokenized(own, tokenizer, "text", with_ids, capacity).select("key", "rid", "_t.*"), "tokens")
    grain = capacity // 4
    place = F.col("pos").cast("long") * capacity  # only the last piece may begin elsewhere, on the grain
    start = F.when(place < F.col("n"), place).otherwise(F.col("n") - F.col("n") % grain)
    pieces = own.select("key", "rid", "n", F.posexplode("crcs").alias("pos", "ids_crc32"), F.size("crcs").alias("k"))
    pieces = pieces.select("key", "rid", "n", "ids_crc32", start.alias("start"), F.pmod(F.xxhash64("rid"), F.lit(salts)).alias("salt"))
    left = F.col("n") - F.col("start")
    body = (left > grain) & (F.col("start") % capacity == 0)
    pieces = pieces.withColumn("length", F.when(left >= capacity, capacity).when(body, left - left % grain).otherwise(left).cast("long"))
    # Ranks within a length are counted in salted parts and then shifted: no task sees all pieces of a popular length.
    parts = written(pieces.groupBy("salt", "length").count(), "parts")
    shift = parts.select("salt", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("shift"))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = _places(solve_patterns(histogram, capacity))
    places = F.broadcast(spark.createDataFrame(rows, "len long, first long, last long, base long, times long, off0 long"))
    rank = (F.row_number().over(Window.partitionBy("salt", "length").orderBy("rid", "start")) - 1).alias("rank")
    ranked = pieces.select("*", rank).join(shift, ["salt", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    put = ranked.join(places, (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    turn = F.col("rank") - F.col("first")
    put = put.withColumns(
        {"sequence_id": F.col("base") + F.floor(turn / F.col("times")), "offset": F.col("off0") + (turn % F.col("times")) * F.col("length")}
    )
    if with_ids:
        ids = own.select(F.col("rid").alias("r"), "ids")
        put = put.join(ids, F.col("rid") == F.col("r")).withColumn("ids", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))"))
    return put.select(F.col("key").alias(key), "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset", *(["ids"] if with_ids else []))
