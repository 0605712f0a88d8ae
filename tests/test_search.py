"""Phrase search: adjacency, prefixes, diacritics, the plain look-up in labels."""

import re
import unicodedata

import pytest

from graphloom.operators import search

ENTRIES = [
    (1, "readFile", "Lies die Datei: read file, read-fire"),
    (2, "read", "file"),
    (3, "Crème brûlée", "crème fraîche, reading FILES"),
    (4, None, None),
    (5, "->", "file read"),
    (6, "read", "read file " * 3000 + "read filing"),
    (6, "read", "read fi"),
]


def plain(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.category(c).startswith("M"))
    return [w for w in re.split(r"[\W_]+", bare) if w]


def brute(query):
    phrases = [p for p in (plain(t) for t in query.split()) if p]
    hit = lambda p, w: any(w[i : i + len(p) - 1] == p[:-1] and i + len(p) <= len(w) and w[i + len(p) - 1].startswith(p[-1]) for i in range(len(w)))
    ids = {e[0] for e in ENTRIES}
    return {i for i in ids if all(any(hit(p, plain(t)) for e in ENTRIES if e[0] == i for t in e[1:]) for p in phrases)}


@pytest.mark.parametrize("query", ["read-fi", "file-read", "creme", "CRÈME-br", "crème-fraiche read", "readfile", "nothing-here", "read read"])
def test_phrases_equal_brute_force(spark, query):
    entries = spark.createDataFrame(ENTRIES, "ref long, label string, detail string")
    rows = search.search_phrases(entries, search.build_positions(entries), query).collect()
    assert len(rows) == len({r.ref for r in rows}) and {r.ref for r in rows} == brute(query)
    assert all(r.score > 0 for r in rows)


def test_query_without_tokens_looks_in_labels(spark):
    entries = spark.createDataFrame(ENTRIES, "ref long, label string, detail string")
    find = lambda q: [tuple(r) for r in search.search_phrases(entries, search.build_positions(entries), q).collect()]
    assert find("->") == [(5, 0.0)] and find("  ") == []
    assert search.search_phrases(entries.limit(0), search.build_positions(entries.limit(0)), "read").collect() == []
