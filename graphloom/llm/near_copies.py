"""Near copies by shingle similarity: the SimHash operator and MinHash bands find candidates, an exact Jaccard check keeps the true ones.

Fingerprints. The distinct sets of shingles go through the SimHash operator: a 64-bit fingerprint each, anchor-point
covering, all pairs within four bits. The closest copies become components there. At a similarity of 0.8 about ten bits
differ, so one fingerprint cannot find every link; bands find the rest, between the components that are left.

Bands. A distinct set of shingles has BANDS band values of ROWS minima each. Two sets of similarity s share none with
probability (1 - s^ROWS)^BANDS: 1.9e-6 at 0.8, less above. Sets that share a value are candidates.

Parities. A bitmap says for each of PARITY_BITS classes whether a set holds an odd number of its shingles. The XOR of
two bitmaps has no more set bits than the sets have shingles that differ, so it rules candidates out without an error.
What remains is compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import BROADCAST_ROWS, field, numbered, row_order, tidy, without_rows, written
from graphloom.llm.components import connected_components
from graphloom.llm.sentence_pieces import slices
from graphloom.llm.simhash import checked_components, print_of

SHINGLE, SEED = 5, 42
#: Sets are near copies if their Jaccard similarity is at least NUM / DEN.
NUM, DEN = 4, 5
BANDS, ROWS = 25, 4
PARITY_BITS = 1024


@cache
def _factors():
    import numpy as np

    rng = np.random.default_rng(SEED)
    odd = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(SHINGLE), odd(BANDS * ROWS), odd(BANDS * ROWS)[:, None]


def shingles_of(text: str | None):
    """The distinct 64-bit digests of a text's shingles, in order. Fewer than SHINGLE words are one shingle; no words have none."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    digests = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for j, factor in enumerate(_factors()[0]):
        out = (out ^ digests[j : j + n]) * factor
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch_of(text: str | None) -> tuple[bytes, int, list[int], list[int]]:
    """A digest of the set of shingles, its size, the band values (none for the empty set) and the parities."""
    return _sketch(shingles_of(text))


def _sketch(found) -> tuple[bytes, int, list[int], list[int]]:
    import hashlib

    import numpy as np
    import xxhash

    _, factors, shifts = _factors()
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):  # long texts in pieces of bounded memory
        np.minimum(least, (np.multiply.outer(factors, found[at : at + 1024]) + shifts).min(1), out=least)
    bands = np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(least.reshape(BANDS, ROWS))] if len(found) else [], np.uint64)
    classes = np.bincount((found >> np.uint64(64 - (PARITY_BITS - 1).bit_length())).astype(np.int64), minlength=PARITY_BITS)
    parity = np.packbits(classes % 2 == 1, bitorder="little").view("<i8")
    return hashlib.md5(found.tobytes()).digest(), len(found), bands.view(np.int64).tolist(), parity.tolist()


_LONGS = T.ArrayType(T.LongType())
_SKETCH = T.StructType().add("sid", T.BinaryType()).add("n", T.IntegerType()).add("bands", _LONGS).add("parity", _LONGS).add("fp", T.LongType())


@F.pandas_udf(_SKETCH)
@tidy()
def sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        for part in slices(batch):
            sets = map(shingles_of, part)
            yield pd.DataFrame([(*_sketch(s), print_of(s[at : at + 65536] for at in range(0, len(s), 65536))) for s in sets], columns=["sid", "n", "bands", "parity", "fp"])


@F.pandas_udf(_LONGS)
@tidy()
def shingle_sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: shingles_of(t).view("int64"))


def _possible(p: Column, q: Column, m: Column, n: Column) -> Column:
    """Whether sets of the sizes m and n and the parities p and q can be near copies; never false if they are."""
    differing = reduce(Column.__add__, [F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(PARITY_BITS // 64)])
    return (F.least(m, n) * DEN >= F.greatest(m, n) * NUM) & (differing * (NUM + DEN) <= (m + n) * (DEN - NUM))


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The `pairs` (a, b: numbers of `rows`) whose sets of shingles are near copies."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    need = written(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "need")
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    sets = written(rows.select("rid", "text").join(need, "rid", "left_semi").select("rid", shingle_sets("text").alias("set")), "sets")
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("rid").alias("b"), F.col("set").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(shared * (NUM + DEN) >= (F.size("s") + F.size("t")) * NUM).select("a", "b")


def _components(per: DataFrame, texts: DataFrame) -> DataFrame:
    """`node`, `component` for each row of `per` (node, n, bands, parity, fp) that is not its own component.

    Dense groups do not become all their pairs. The SimHash operator joins the closest sets. In bands that still hold
    several components each set is compared with the band's center first, the node that meets most others over all bands: a
    node at a group's edge would leave the group apart. Then bands whose sets are still apart are compared in full,
    between components only.
    """
    sizes = per.select("node", "n", "parity")

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sizes.toDF("a", "m", "p"), "a").join(sizes.toDF("b", "n", "q"), "b")
        return _verified(both.where(_possible(F.col("p"), F.col("q"), F.col("m"), F.col("n"))), texts)

    close = written(checked_components(per.select("node", "fp"), near), "close")
    own = written(per.select("node", "bands").join(close, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "bands"), "own")
    rows = own.select("node", "c", F.explode("bands").alias("band"))
    met = rows.groupBy("band").agg(F.count("*").alias("met"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").drop("low", "high")
    rows = written(rows.join(met, "band"), "bands")
    central = rows.join(rows.groupBy("node").agg(F.sum("met").alias("weight")), "node").groupBy("band").agg(F.max_by("node", "weight").alias("center"))
    stars = rows.join(central, "band").where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"), "c").distinct()
    stars = stars.join(own.select(F.col("node").alias("a"), F.col("c").alias("d")), "a").where("c <> d").select("a", "b")
    found = close.select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined = written(connected_components(near(stars).toDF("u", "v").unionByName(found)), "stars")
    known = rows.select("node", "band").join(joined, "node", "left").select("node", "band", F.coalesce("component", "node").alias("c"))
    known = written(known, "known")
    mixed = known.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    full = written(known.join(mixed, "band").join(sizes, "node"), "mixed")
    left, right = full.toDF(*(f"l_{c}" for c in full.columns)), full.toDF(*(f"r_{c}" for c in full.columns))
    meet = (F.col("l_band") == F.col("r_band")) & (F.col("l_c") < F.col("r_c")) & _possible(F.col("l_parity"), F.col("r_parity"), F.col("l_n"), F.col("r_n"))
    cross = left.hint("merge").join(right, meet).select(F.col("l_node").alias("a"), F.col("r_node").alias("b"))
    links = _verified(cross, texts).toDF("u", "v").unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return connected_components(links)


def _grouped(rows: DataFrame) -> DataFrame:
    """`key`, `rid`, `component_id` and `stays` for each of the written rows (`key`, `text`, `rid`)."""
    own = rows.select("key", "rid", sketches("text").alias("s"))
    own = written(own.select("key", "rid", "s.*"), "sketches").withColumn("order", row_order())
    per = own.groupBy("sid").agg(F.min("key").alias("least"), F.min("order").alias("first"), F.min("rid").alias("node"))
    per = written(per, "sets-by-digest")
    sketched = per.select("node").join(own.select(F.col("rid").alias("node"), "n", "bands", "parity", "fp"), "node")
    linked = written(_components(written(sketched, "distinct-sketches"), rows), "links")
    per = per.join(linked, "node", "left").select("sid", "least", "first", F.coalesce("component", "node").alias("component"))
    best = per.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("best"))
    ids = written(per.join(best, "component").select("sid", "component_id", "best"), "components")
    return own.select("key", "rid", "sid", "order").join(ids, "sid").select("key", "rid", "component_id", (F.col("order") == F.col("best")).alias("stays"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: the key and `component_id`, the smallest key of the component of near copies, nulls aside.

    Texts are lower-cased in A-Z, split at ASCII white space and shingled by five words. Two texts are linked if the
    Jaccard similarity of their sets of shingles is at least 0.8; texts without words (also null) are linked with each
    other. Repeated rows are returned as often as they came; an empty table gives an empty result.
    """
    rows = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("rid", "row.*")
    return _grouped(rows).select(F.col("key").alias(key), "component_id")


def near_filter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component of near copies the row with the smallest
    key (a null key comes last), the first as written if rows share that key."""
    rows = numbered(docs)
    own = rows.select(field(key).alias("key"), field(text).alias("text"), "rid")
    return without_rows(rows, _grouped(own).where(~F.col("stays")))
