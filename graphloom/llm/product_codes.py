"""Product-quantised vector codes in integers, with a GNAT over each part's codebook entries.

Vectors become integers floor(256 x) and are cut into equal parts; each part position has its own codebook. An entry
tree (geometric near-neighbour access tree) has a few split points; every other entry belongs to the child of its nearest
split point, and for each split point and child the range of distances between them is stored. A query measures its
distances to the split points, and drops a whole child where some split point's distance minus the best distance so far
lies above the range, or plus it below. Roots are rounded outwards and the comparison is strict, so that no entry at
the best distance is lost; the remaining entries are compared by exact integer squared distances, ties to the lower index.

Rounds run in Arrow batches. A task sums its parts by entry, so that at most parts x entries rows per task are
shuffled; the driver sees one sum and count for each entry, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Children of a node; nodes up to LEAF entries are compared directly.
DEGREE, LEAF = 8, 8
#: Sums of per-label errors up to so many labels are broadcast, beyond that they are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Integers up to this size keep squared distances of up to 2^20 components within 64 bits.
LARGEST = 2**20


class Gnat:
    """A tree over the rows of `entries` (integers). `nearest` is exact, with ties to the lower row."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.index = np.arange(len(entries)) if index is None else index
        self.entries = entries
        self.children: list[Gnat] = []
        if len(entries) <= LEAF or (entries == entries[0]).all():
            return
        # Split points: each the entry that is farthest from those chosen before it.
        chosen, gap = [0], _squares(entries, entries[:1])[:, 0]
        while len(chosen) < DEGREE and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _squares(entries, entries[chosen[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(entries)), chosen)
        self.splits, self.split_index = entries[chosen], self.index[chosen]
        squares = _squares(entries[rest], self.splits)
        owner = squares.argmin(1)
        low, high = [], []
        for k in range(len(chosen)):
            mine = owner == k
            if mine.any():
                self.children.append(Gnat(entries[rest[mine]], self.index[rest[mine]]))
                low.append(_root(squares[mine].min(0), down=True))
                high.append(_root(squares[mine].max(0), down=False))
        self.low, self.high = np.array(low), np.array(high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of the nearest entry and its squared distance, for each query."""
        best = np.full(len(queries), 2**62, np.int64)
        row = np.full(len(queries), 2**31, np.int64)
        self._search(queries, np.arange(len(queries)), best, row)
        return row, best

    def _search(self, queries: np.ndarray, who: np.ndarray, best: np.ndarray, row: np.ndarray) -> None:
        if not self.children:
            _improve(_squares(queries[who], self.entries), self.index, who, best, row)
            return
        squares = _squares(queries[who], self.splits)
        _improve(squares, self.split_index, who, best, row)
        below, above = _root(squares, down=True), _root(squares, down=False)
        # Children of the nearest split points first: their entries shrink the radius for the others.
        for child in np.argsort(np.array([_squares(c.entries[:1], self.splits)[0].min() for c in self.children]), kind="stable"):
            radius = _root(best[who], down=False)[:, None]
            apart = (below - radius > self.high[child]) | (above + radius < self.low[child])
            near = ~apart.any(1)
            if near.any():
                self.children[child]._search(queries, who[near], best, row)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between all rows, component by component, in 64-bit integers."""
    total = np.zeros((len(a), len(b)), np.int64)
    for c in range(a.shape[1]):
        d = a[:, c, None] - b[None, :, c]
        total += d * d
    return total


def _root(squares: np.ndarray, down: bool) -> np.ndarray:
    """Square roots in floating point, moved outwards by more than any rounding error of them or of their sums."""
    root = np.sqrt(squares.astype(np.float64))
    return root * (1 - 2**-45) if down else root * (1 + 2**-45)


def _improve(squares: np.ndarray, index: np.ndarray, who: np.ndarray, best: np.ndarray, row: np.ndarray) -> None:
    least = squares.min(1)
    first = np.where(squares == least[:, None], index[None, :], 2**31).min(1)
    better = (least < best[who]) | ((least == best[who]) & (first < row[who]))
    best[who[better]], row[who[better]] = least[better], first[better]


def _integers(vectors: pa.Array, size: int) -> np.ndarray:
    """A batch's vectors as rows of integers, shorter ones padded with zeros."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    length = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), size), np.int64)
    row = np.repeat(np.arange(len(vectors)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def kept_vectors(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds only finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.where(F.col(vector).isNotNull() & F.forall(vector, fine))


def _assign(batches: Iterator[pa.RecordBatch], trees: list[Gnat], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    part = size // len(trees)
    for batch in batches:
        ints = _integers(batch.column("v"), size)
        found = [t.nearest(ints[:, k * part : (k + 1) * part]) for k, t in enumerate(trees)]
        yield batch, ints, np.array([r for r, _ in found]), np.array([d for _, d in found])


def product_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: the key, `code`, `error`, `label_error`, `codebooks_sha256`.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors, and a length that the
    parts do not divide, are padded with zeros. Codebooks start from the rows of the smallest keys (null keys last, equal
    keys by vector, then label); with fewer rows they have fewer entries. Repeated rows are kept. Null labels are one
    group. Components beyond LARGEST / 256 fail with a ValueError, as their squares would not fit. An empty table gives an
    empty result. The other columns are not read.
    """
    spark = df.sparkSession
    rows = kept_vectors(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").alias("label")), "v")
    bound = rows.select(F.max(F.size("v")).alias("n"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))).alias("top")).first()
    if bound.top is not None and bound.top * SCALE > LARGEST:
        raise ValueError("a component is too large for 64-bit squared distances")
    size = -(-max(bound.n or 0, 1) // parts) * parts
    part = size // parts
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v", "label").limit(entries).select("v").toArrow()
    books = np.zeros((parts, first.num_rows, part), np.int64)
    if first.num_rows:
        books[:] = _integers(first.column("v").combine_chunks(), size).reshape(first.num_rows, parts, part).swapaxes(0, 1)
    for _ in range(rounds if first.num_rows else 0):
        books = _moved(rows, books, size)
    trees = [Gnat(b) for b in books]
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kind = dict(rows.dtypes)

    def code(batches):
        for batch, _, found, squares in _assign(batches, trees, size):
            text = found.T.astype(np.uint8)
            codes = [text[i].tobytes().hex() for i in range(len(text))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(codes, pa.string()), pa.array(squares.sum(0), pa.int64())], ["key", "label", "code", "error"])

    coded = rows.mapInArrow(code, f"key {kind['key']}, label {kind['label']}, code string, error long") if first.num_rows else spark.createDataFrame([], f"key {kind['key']}, label {kind['label']}, code string, error long")
    coded = written(coded, "codes")
    sums = written(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("l")))
    else:
        joined = coded.repartition("label").join(sums.repartition("l"), F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _moved(rows: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean, unused ones as before."""
    parts, n, part = books.shape
    trees = [Gnat(b) for b in books]

    def sums(batches):
        total, count = np.zeros((parts, n, part), np.int64), np.zeros((parts, n), np.int64)
        for _, ints, found, _ in _assign(batches, trees, size):
            for k in range(parts):
                np.add.at(total[k], found[k], ints[:, k * part : (k + 1) * part])
                count[k] += np.bincount(found[k], minlength=n)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p * n + e), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    by_task = rows.mapInArrow(sums, "slot long, n long, total array<long>")
    by_slot = by_task.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[c]).alias(f"t{c}") for c in range(part)])
    moved = books.copy().reshape(parts * n, part)
    for r in by_slot.collect():  # at most parts x entries rows
        moved[r.slot] = [r[f"t{c}"] // r.n for c in range(part)]
    return moved.reshape(books.shape)


_SQL_ASSIGN = """
best{k} as materialized (
  select p, vec_id, label, v, arg_min(k, d * 64 + k) as e, min(d) as d from (
    select x.p, x.vec_id, x.label, x.v, c.k, list_sum(list_transform(x.v, lambda a, i: (a - c.v[i]) * (a - c.v[i]))) as d from part x join book{k} c using (p)) group by all)"""
_SQL_MOVE = """
mean{k} as materialized (
  select p, e, list(m order by i) as v from (
    select p, e, i, cast((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as m from best{k}, range(1, 5) r(i) group by all) group by all),
book{n} as materialized (select b.p, b.k, coalesce(m.v, b.v) as v from book{k} b left join mean{k} m on m.p = b.p and m.e = b.k)"""
#: The twin for vectors of 64 components: brute-force nearest entries, the rounds written out.
OP13_SQL = (
    """
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
part as materialized (select vec_id, label, p, v[4 * p + 1 : 4 * p + 4] as v from kept, range(0, 16) r(p)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as k from kept qualify k < 64),
book0 as materialized (select p, k, v from part join first using (vec_id)),"""
    + ",".join(_SQL_ASSIGN.format(k=k) + ("," + _SQL_MOVE.format(k=k, n=k + 1) if k < 2 else "") for k in range(3))
    + """,
coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from best2 group by all)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) from book2) as codebooks_sha256
from coded"""
)
