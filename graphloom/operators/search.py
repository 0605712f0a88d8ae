"""Text search: an inverted index of tokens, prefix terms, phrases and BM25; and search of lines."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build_index(entries: DataFrame) -> DataFrame:
    """`ref`, `token`, `tf`, `length` from `entries` (ref, label, detail)."""
    own = entries.select("ref", tokens(F.concat_ws(" ", "label", "detail")).alias("t"))
    each = own.select("ref", F.size("t").alias("length"), F.explode("t").alias("token"))
    return each.groupBy("ref", "token", "length").agg(F.count("*").alias("tf"))


def search(index: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The best `limit` entries that hold a token with each term's prefix: `ref`, `score` (BM25), by score, then ref."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if t]
    stats = index.select("ref", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    term = F.array(*[F.when(F.col("token").startswith(t), F.lit(t)) for t in terms])
    hits = index.select("ref", "length", "tf", F.explode(F.array_compact(term)).alias("term")).groupBy("ref", "term", "length").agg(F.sum("tf").alias("tf"))
    return scored(hits, stats, len(terms)).orderBy(F.desc("score"), "ref").limit(limit)


def scored(hits: DataFrame, stats: DataFrame, terms: int) -> DataFrame:
    """`ref`, `score`: BM25 of the refs that hit all terms. `hits` is (ref, term, length, tf), `stats` one row (n, mean)."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    each = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # as many rows as terms, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = each.groupBy("ref").agg(F.sum(weight).alias("score"), F.count("*").alias("terms")).where(F.col("terms") == terms)
    return out.select("ref", F.round("score", 6).alias("score"))


@lru_cache
def _accents() -> tuple[str, str]:
    """Lower-case letters that decompose into one letter and marks, and these letters, by the Unicode rule."""
    pairs = []
    for point in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point) and base.isalpha() and chr(point).lower() == chr(point):
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics, be they part of a letter or marks of their own; null counts as empty."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accents())
    return F.regexp_replace(plain, r"\p{M}+", "")


def build_positions(entries: DataFrame) -> DataFrame:
    """`ref`, `field`, `position`, `token`: one row a token of the folded label (field 0) and detail (field 1).

    Whole texts, one flat row a token: nothing is collected per token or entry, so that a frequent word is many rows.
    """
    words = lambda c: F.filter(F.split(folded(F.col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    fields = entries.select("ref", F.posexplode(F.array(words("label"), words("detail"))).alias("field", "words"))
    return fields.select("ref", "field", F.posexplode("words").alias("position", "token"))


def _fold_query(query: str) -> list[tuple[str, ...]]:
    """The phrases of a query: each of its terms is a phrase of its tokens, in order, without repeats."""
    text = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.category(c).startswith("M"))
    phrases = [tuple(w for w in re.split(r"[\W_]+", term) if w) for term in text.split()]
    return [p for p in dict.fromkeys(phrases) if p]


def search_phrases(entries: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """`ref`, `score` of all entries (ref, label, detail) that hold every term of the query; `postings` as `build_positions` gives.

    A term of one token fits tokens with this prefix; a term that has several (`read-fi`) is a phrase: its tokens in a row
    within one field, the last as a prefix. Case and diacritics do not count. Scores are BM25 with a phrase as the term. A
    query without any token looks for itself in the labels, as it stands, with score 0; an empty one finds nothing.

    A phrase is a join of its tokens' postings on (ref, field, position), so that the shuffle is over the rows of its own
    words and spreads by ref, however frequent a word is.
    """
    phrases = _fold_query(query)
    if not phrases:
        literal = query.strip()
        kept = entries.where(F.contains(F.lower("label"), F.lit(literal.lower()))) if literal else entries.limit(0)
        return kept.select("ref", F.lit(0.0).alias("score")).distinct()
    place, found = ["ref", "field", "at"], []
    for n, phrase in enumerate(phrases):
        steps = []
        for k, word in enumerate(phrase):
            fits = F.col("token").startswith(word) if k == len(phrase) - 1 else F.col("token") == word
            steps.append(postings.where(fits).select("ref", "field", (F.col("position") - k).alias("at")))
        rows = reduce(lambda a, b: a.join(b, place), steps)
        found.append(rows.groupBy("ref").agg(F.count("*").alias("tf")).withColumn("term", F.lit(n)))
    lengths = postings.groupBy("ref").agg(F.count("*").alias("length"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    return scored(reduce(DataFrame.unionByName, found).join(lengths, "ref"), stats, len(phrases))


def search_lines(files: DataFrame, pattern: str, per_file: int = 6, total: int = 60) -> DataFrame:
    """`ref`, `line`, `text` of lines that match: the first `per_file` of a file, `total` in all. A feature's limits."""
    lines = files.where(F.col("text").rlike(pattern)).select("ref", F.posexplode(F.split("text", "\n")).alias("n", "text")).where(F.col("text").rlike(pattern))
    first = lines.withColumn("k", F.row_number().over(Window.partitionBy("ref").orderBy("n"))).where(F.col("k") <= per_file)
    return first.select("ref", (F.col("n") + 1).alias("line"), "text").orderBy("ref", "line").limit(total)


def sql_tables(literals: DataFrame) -> DataFrame:
    """`id`, `name`, `write` of the tables that SQL text reads or writes; CTE names and pragma tables are left out."""
    text = F.lower(F.regexp_replace("literal", r"\s+", " "))
    name = r"([a-z_][a-z0-9_.]*)"
    writes = F.regexp_extract_all(text, F.lit(rf"\b(?:insert (?:or [a-z]+ )?into|replace into|update|delete from|merge into) {name}"), F.lit(1))
    reads = F.regexp_extract_all(text, F.lit(rf"(?<!delete )\b(?:from|join) {name}"), F.lit(1))
    ctes = F.regexp_extract_all(text, F.lit(rf"(?:\bwith(?: recursive)?|,) {name} as \("), F.lit(1))
    rows = F.concat(
        F.transform(F.array_except(writes, ctes), lambda n: F.struct(n.alias("name"), F.lit(True).alias("write"))),
        F.transform(F.array_except(reads, ctes), lambda n: F.struct(n.alias("name"), F.lit(False).alias("write"))),
    )
    out = literals.select("id", F.inline(rows)).where("not startswith(name, 'pragma_') and name not in ('select', 'set', 'where', 'values')")
    return out.groupBy("id", "name").agg(F.bool_or("write").alias("write"))
