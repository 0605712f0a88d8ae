"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, over exactly deduplicated texts.

Texts are shuffled by their full text, with their multiplicity counted before and after the shuffle; each distinct text
is tokenised twice and aligned once, in Arrow batches. Offsets where tokens of both end cut them into groups; the tokens
of a group are linked. Each distinct text brings its id pairs once, with its multiplicity, so that the sum over texts is
the number of documents that hold a pair. Pairs of the highest counts (at most POPULAR of them) come back to the texts by
a broadcast, all others by a shuffle on the pair, whose keys are therefore not hot. The measures come back to the
documents by the texts' SHA-256, after a check that no two distinct texts share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.byte_pairs import BYTE_OF, BytePairs
from graphloom.llm.common import kept, small_batches, tidy, written
from graphloom.llm.sentence_pieces import SPACE, Codec, slices

#: At most so many pair counts, of the most frequent pairs, are broadcast (16 bytes each).
POPULAR = 100_000

_ALIGNED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("a", "b", "times")]
)


class Aligner:
    """Both vocabularies: ids of whole texts, the bytes of each id and the written forms of ids in groups.

    Strings of special tokens stay plain text.
    """

    def __init__(self, a_path: str, b_path: str):
        self.b = Codec(b_path, check=False)
        self.a = BytePairs(a_path)
        whole = lambda t: bytes(map(BYTE_OF.__getitem__, t)) if all(c in BYTE_OF for c in t) else t.encode()
        self.a_bytes = [whole(self.a.names.get(i, "")) for i in range(max(self.a.names) + 1)]
        byte_of = {i: b for b, i in enumerate(self.b.byte_ids or [])}
        self.b_bytes = [bytes([byte_of[i]]) if i in byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.b.pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        n, m = len(self.a_bytes), len(self.b_bytes)
        # What follows an id in the written groups: another id of its side, the other side, the next group.
        self.written = np.array([f"{i}{e}" for k, e in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(k)], object)
        self.base = (0, n, 2 * n, 2 * n + m)

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both, or None where a text is empty or one of them does not give back its bytes."""
        found: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, b in zip(texts, self.b.encode(texts), strict=True):
            pair = None
            if text:
                spaced = " " + text
                a = self.a.plain(spaced).astype(np.int64)
                whole = spaced.encode()
                # Byte pairs give back any text: a sum of lengths is enough there.
                if int(self.a_size[a].sum()) == len(whole) and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == whole:
                    pair = a, b.astype(np.int64)
            found.append(pair)
        return found

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple:
        """n_a, n_b, n_groups, n_links, the written groups, and the distinct id pairs with the number of their links."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        in_both = np.zeros((2, int(ends_a[-1]) + 1), bool)
        in_both[0, ends_a] = in_both[1, ends_b] = True
        last_a, last_b = in_both[1, ends_a], in_both[0, ends_b]
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[group_a]] = a + np.where(last_a, self.base[1], self.base[0])
        order[np.arange(len(b)) + (before_a + in_a)[group_b]] = b + np.where(last_b, self.base[3], self.base[2])
        groups = "".join(self.written[order].tolist())[:-1]
        width = len(self.b_bytes)
        single = (in_a == 1) & (in_b == 1)
        keys = [a[single[group_a]] * width + b[single[group_b]]]
        times = [np.ones(len(keys[0]), np.int64)]
        if not single.all():
            keys.append((got := _links(group_a, a, group_b, b, ~single, width))[0])
            times.append(got[1])
        pair, n = _summed(np.concatenate(keys), np.concatenate(times))
        # As the columns' type: Arrow would convert each number of other arrays.
        return len(a), len(b), len(in_a), int((in_a * in_b).sum()), groups, (pair // width).astype(np.int32), (pair % width).astype(np.int32), n.astype(np.int32)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times


def _links(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of the wanted groups, made from each group's distinct ids and how often they occur: pair keys and counts."""
    in_a, in_b = wanted[group_a], wanted[group_b]
    ka, ta = np.unique(group_a[in_a] << 20 | a[in_a], return_counts=True)
    kb, tb = np.unique(group_b[in_b] << 20 | b[in_b], return_counts=True)
    ga, gb = ka >> 20, kb >> 20
    size_b = np.bincount(gb, minlength=len(wanted))
    n = size_b[ga]
    at_a = np.repeat(np.arange(len(ka)), n)
    at_b = (np.cumsum(size_b) - size_b)[ga[at_a]] + np.arange(len(at_a)) - np.repeat(np.cumsum(n) - n, n)
    return (ka[at_a] & 0xFFFFF) * width + (kb[at_b] & 0xFFFFF), ta[at_a] * tb[at_b]


@kept
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(a_path, b_path)


def _aligned(a_path: str, b_path: str):
    @F.pandas_udf(_ALIGNED)
    @tidy(aligner)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, none = aligner(a_path, b_path), (0, 0, 0, 0, None, [], [], [])
        for batch in batches:
            for part in slices(batch):
                rows = [none if p is None else own.align(*p) for p in own.ids(part)]
                yield pd.DataFrame(rows, columns=_ALIGNED.fieldNames())

    return run


def align_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """One row per distinct text that is not null: `sha` (SHA-256), `docs` (its multiplicity), `n_a`, `n_b`, `n_groups`,
    `n_links`, `groups` (written `a1,a2|b1;a3|b2`, null without tokens), and the distinct pairs as parallel arrays `a`, `b`, `times`."""
    distinct = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("docs"))
    return distinct.select(F.sha2("text", 256).alias("sha"), "docs", _aligned(a_path, b_path)("text").alias("t")).select("sha", "docs", "t.*")


def _each(texts: DataFrame, *more: str | Column) -> DataFrame:
    return texts.select(*more, F.inline(F.arrays_zip("a", "b", "times")))


def pair_counts(texts: DataFrame) -> DataFrame:
    """`a`, `b`, `count`: how many documents hold the pair linked, from `align_texts`; `best`: whether it is a's highest count."""
    counts = written(_each(texts, "docs").groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`.

    Null and empty texts, and texts that one vocabulary does not give back byte by byte (U+2581 in a text), have zeros
    and ''. Strings of special tokens are plain text. Whole texts are aligned: a text takes memory by its own length
    and its distinct pairs. Repeated rows and keys are kept, each with the measures of its text; keys may be null. Equal
    counts are all best. An empty table gives an empty result; further columns are not read.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    with small_batches(docs.sparkSession):
        texts = written(align_texts(docs, a_path, b_path, text).withColumn("groups", digest), "aligned")
    if not texts.groupBy("sha").count().where("count > 1").isEmpty():
        raise RuntimeError("two distinct texts share a SHA-256")
    counts = written(pair_counts(texts), "counts")
    popular = counts.orderBy(F.desc("count"), "a", "b").limit(POPULAR)
    popular = F.broadcast(written(popular, "popular"))
    pairs = _each(texts, "sha").join(popular, ["a", "b"], "left")
    sums = lambda df: df.groupBy("sha").agg(
        F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    common = sums(pairs.where("count is not null"))
    rare_counts = counts.join(popular.select("a", "b"), ["a", "b"], "left_anti")
    rare = sums(pairs.where("count is null").select("a", "b", "sha", "times").join(rare_counts, ["a", "b"]))
    both = common.unionByName(rare).groupBy("sha").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = written(texts.select("sha", "n_a", "n_b", "n_groups", "n_links", "groups").join(both, "sha", "left"), "measures")
    own = docs.select(F.col(f"`{key}`").alias("key"), F.sha2(F.col(f"`{text}`"), 256).alias("sha"))
    # Both sides have an exchange, so that a text of very many documents is split between tasks.
    found = own.repartition("sha").join(measures.repartition("sha"), "sha", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    columns = [zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return found.select(F.col("key").alias(key), *columns, F.coalesce("groups", F.lit("")).alias("groups_sha256"))
