"""Exact deduplication by content-defined chunk recipes, in built-in functions only.

A text is cut where its own content says so, each distinct chunk gets one identifier that is verified against
the chunk's bytes, and texts are compared by their ordered lists of identifiers. Chunks are deduplicated before
they are shuffled, so a long or popular text moves at most once; the texts themselves never do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ASCII_SPACE, discard, field, numbered, row_order, text_or_empty, without_rows, written

#: A chunk ends where ten characters in a row have code points of these parities, once in about a thousand characters
#: of most texts, so that cuts fall at the same places after an insertion; or else after MAX_CHUNK characters.
MIN_CHUNK, MAX_CHUNK, PARITIES = 64, 8192, "1011001110"
_ODD = "".join(f"\\x{c:02x}" for c in range(0x21, 0x100, 2))
BOUNDARY = "".join(f"[{_ODD}]" if p == "1" else f"[^{_ODD}]" for p in PARITIES)


def normalised(column: str = "text") -> Column:
    """The text that is compared: each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(text_or_empty(column), f"{ASCII_SPACE}+", " ")


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK, boundary: str = BOUNDARY) -> str:
    return f"(?s).{{{least},{most}}}?{boundary}|.{{1,{most}}}"


def chunks_of(text: Column, pattern: str | None = None) -> Column:
    """All chunks of a text, in order; joined they are the text again. The empty text has none."""
    return F.regexp_extract_all(text, F.lit(pattern or chunk_pattern()), F.lit(0))


def chunk_id(chunk: Column, seed: int) -> Column:
    """16 bytes of a seeded digest. Equal identifiers do not prove equal chunks: `verified_recipes` does."""
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), chunk)))


def _named(identify: Callable[[Column, int], Column], seed: int, chunk: Column) -> Column:
    return F.struct(identify(chunk, seed).alias("id"), chunk.alias("chunk"))


def verified_recipes(
    docs: DataFrame,
    text: str = "text",
    identify: Callable[[Column, int], Column] = chunk_id,
    pattern: str | None = None,
    seeds: int = 8,
) -> DataFrame:
    """`docs` without its text, with `_recipe` (ordered chunk identifiers) and `_sha` (SHA-256 of the normalised text).

    The identifiers are verified: all distinct (identifier, chunk) pairs are compared by their bytes, and if two
    chunks share an identifier, the next seed is taken. So equal recipes mean equal normalised texts. The named chunks
    are written once, so that no text is normalised and cut twice, and deleted when the recipes are written.
    """
    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, normalised(text).alias("_norm"))
    for seed in range(seeds):
        parts = F.transform(chunks_of(F.col("_norm"), pattern), partial(_named, identify, seed)).alias("_parts")
        named = written(cut.select(*rest, parts, F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha")), "chunks")
        pairs = named.select(F.explode("_parts").alias("p")).select("p.id", "p.chunk")
        clashes = pairs.distinct().groupBy("id").count().where("count > 1").limit(1)
        if clashes.isEmpty():
            recipes = written(named.select(*rest, F.col("_parts.id").alias("_recipe"), "_sha"), "recipes")
            discard(named)
            return recipes
        discard(named)
    raise ValueError(f"{seeds} seeds all gave two different chunks one identifier")


def _grouped(rows: DataFrame, **how) -> DataFrame:
    """`rows` has `key`, `text` and `rid`; the row number breaks ties between rows that repeat a key."""
    light = verified_recipes(rows, "text", **how).withColumn("order", row_order())
    groups = light.groupBy("_recipe").agg(F.min("key").alias("keep_id"), F.min("order").alias("first"), F.count("*").alias("group_size"))
    # Written, so that the join has an exchange of its own on each side and can split the copies of a popular text.
    groups = written(groups.where("group_size > 1"), "groups")
    return light.join(groups, "_recipe", "left").select(
        "key",
        "rid",
        "_sha",
        F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("order") == F.col("first"), F.lit(True)).alias("kept"),
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of `docs`: the key, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal if they are identical after white-space normalisation; null counts as empty, and all empty
    texts are one group. Of equal texts the row with the smallest key stays; a null key comes after all others.
    Rows that repeat a key with an equal text count each, and exactly one of them stays. An empty table gives an
    empty result. Other columns, whatever their names, are not read.

    Groups of any size are safe: the smallest key and the size come from a partial aggregation, and the join back
    carries only identifiers, so its hot partitions can be split.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    return _grouped(rows, **how).select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def exact_dedup_filter(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names: one of each group of equal texts.

    Null and empty texts, ties, repeated rows and an empty table are treated as in `exact_dedup`.
    """
    rows = numbered(docs)
    dropped = _grouped(rows.select(field(key).alias("key"), field(text).alias("text"), "rid"), **how).where(~F.col("kept"))
    return without_rows(rows, dropped)


#: DuckDB twin of op9.
OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm, row_number() OVER () AS rid
  FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
), r AS (
  SELECT n.*, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, rid) AS k FROM n
)
SELECT r.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, r.k = 1 AS kept, sha256(r.norm) AS text_sha256
FROM r JOIN g ON r.norm = g.norm
"""
