"""Exact and near deduplication against brute force, with the cases the docstrings define."""

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup as E
from graphloom.llm import simhash as S
from graphloom.llm.components import connected_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
ODD = [(7, None), (3, ""), (5, " \t\n"), (None, "same text"), (9, "same  text"), (4, "same\ntext"), (4, "same text"), (11, "x" * 20000), (12, "x" * 20000), (13, "x" * 19999 + "y"), (14, "日本語 テキスト"), (15, "日本語 テキスト")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((k is None, k or 0, i, k))
    out = []
    for i, (k, t) in enumerate(rows):
        g = groups[norm(t)]
        least = min((x[3] for x in g if x[3] is not None), default=None)
        out.append((k, least, len(g), min(g)[2] == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def exact(df, **how):
    return sorted((tuple(r) for r in E.exact_dedup(df, **how).collect()), key=repr)


def test_exact_cases(make):
    df = make(ODD, "doc_id long, text string").coalesce(1)
    got, want = exact(df), brute_exact(ODD)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert sum(r[3] for r in got) == sum(r[3] for r in want) == len({norm(t) for _, t in ODD})
    kept = E.exact_dedup_filter(df)
    assert kept.columns == df.columns and sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in ODD})


def test_exact_empty_table_and_clashing_columns(make):
    assert exact(make([], "doc_id long, text string")) == []
    df = make([(1, "a", "k", 5), (2, "a", "l", 6)], "doc_id long, text string, key string, rid int")
    assert [r[:4] for r in exact(df)] == [(1, 1, 2, True), (2, 1, 2, False)]
    assert [tuple(r) for r in E.exact_dedup_filter(df).collect()] == [(1, "a", "k", 5)]


def test_chunks_rebuild_the_text(make):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 50, 6000)] + ["z" * 30000]
    df = make([(t,) for t in texts], "t string").select("t", E.chunks_of(F.col("t")).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.t and all(len(c) <= E.MAX_CHUNK + 10 for c in r.c)
    shifted = "new start. " + texts[3]
    a, b = (set(r.c) for r in make([(texts[3],), (shifted,)], "t string").select(E.chunks_of(F.col("t")).alias("c")).collect())
    assert len(a) > 5 and len(a & b) >= len(a) - 2  # an insertion moves no later boundary


def test_clashing_identifiers_are_found(make):
    weak = lambda c, seed: F.unhex(F.when(F.lit(seed == 0), F.lit("00")).otherwise(F.md5(c)))
    df = make([(1, "a"), (2, "b")], "doc_id long, text string")
    assert [r[2] for r in exact(df, identify=weak)] == [1, 1]
    with pytest.raises(ValueError):
        exact(df, identify=lambda c, seed: F.unhex(F.substring(F.lit("00"), 1, 2)))


def brute_components(rows, prints, distance=S.MAX_DISTANCE):
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                part[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(rows))]


def test_the_triples_cover():
    assert S.triples_cover()
    assert not S.triples_cover(S.TRIPLES[:5])


def test_fingerprint_by_the_book():
    import xxhash

    text = "The  QUICK brown\tfox jumps É"
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())) if w]
    hashes = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert S.fingerprint_of(text) % 2**64 == want
    assert S.fingerprint_of("a b") % 2**64 == xxhash.xxh64(b"a b", seed=42).intdigest()
    assert S.fingerprint_of(None) == S.fingerprint_of(" \n") == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**9))
def test_all_links_are_found(spark, seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.append(p)
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
    prints = list(dict.fromkeys(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.fp: r.component for r in S.component_of_prints(df).collect()}
    want = brute_components([(s, None) for s in signed], prints)
    assert [got.get(s, s) for s in signed] == want


def test_near_groups(make):
    rng = random.Random(1)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(400)]
    near = base.copy()
    near[200] = "changed"
    rows = [(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(rng.choice(WORDS) + str(i) for i in range(300))), (1, None), (8, ""), (2, " ".join(near)), (None, " ".join(base)), (3, "word " * 60000)]
    df = make([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, key int").coalesce(1)
    got = [tuple(r) for r in S.simhash_groups(df).collect()]
    prints = [S.fingerprint_of(t) for _, t in rows]
    want = brute_components(rows, [p % 2**64 for p in prints])
    assert sorted(got, key=repr) == sorted([(k, f"{p % 2**64:016x}", c) for (k, _), p, c in zip(rows, prints, want, strict=True)], key=repr)
    kept = S.simhash_filter(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w for w in want}, key=str)
    assert S.simhash_groups(make([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path_and_a_star(make):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 1)]
    got = {r.node: r.component for r in connected_components(make(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}


def test_rows_keep_their_numbers_when_executors_go(make, spark, tmp_path):
    """A scan that is split otherwise in a later job still drops, and replaces in, the right rows."""
    from graphloom.llm import near_copies, pii

    rng = random.Random(9)
    text = lambda i: " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(30)) + f" m{i}@mail.example.com"
    texts = [text(i) for i in range(150)]
    rows = [(i, texts[i % 150], "c") for i in range(300)]
    make(rows, "doc_id long, text string, rid string").repartition(24).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def during(operator):
        """Run it with another split of scans from its second job on."""
        from graphloom.llm import common

        plain, seen = common.written, []

        def changed(df, name):
            out = plain(df, name)
            seen.append(name)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", 2 if len(seen) % 2 else 16)
            return out

        modules = [common, E, S, near_copies, pii]
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 16)
        try:
            for m in modules:
                m.written = changed
            return operator(docs).collect()
        finally:
            for m in modules:
                m.written = plain
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")

    for operator in (E.exact_dedup_filter, S.simhash_filter, near_copies.near_filter):
        assert sorted(r.doc_id for r in during(operator)) == list(range(150)), operator
    got = during(lambda d: pii.replace_pii(d, "k"))
    words = {r.doc_id: r.text.split() for r in got}
    assert all(words[i][:-1] == texts[i % 150].split()[:-1] and words[i][-1] != texts[i % 150].split()[-1] for i in range(300))
    assert len({w[-1] for w in words.values()}) == 150 and all(words[i] == words[i + 150] for i in range(150))
