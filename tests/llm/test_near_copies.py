"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import near_copies as N
from graphloom.llm import simhash as S

ODD = [(900, None), (901, " \t"), (902, "two words"), (903, "Two  WORDS"), (None, "a b c d e"), (904, "a b c d e"), (905, "w " * 5000)]


def shingles(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_components(rows):
    sets, part = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        return x if part[x] == x else root(part[x])

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(rows))]


def edited_texts():
    """Texts with copies of every similarity, most of them far more than four bits of a SimHash away, and a chain."""
    rng = random.Random(5)
    rows, word = list(ODD), lambda: f"w{rng.randrange(3000)}"
    for size in (30, 90, 400, 1500):
        base = [word() for _ in range(size)]
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 2, 3, size // 60, size // 50, size // 40, size // 20):
            copy = base.copy()
            for at in rng.sample(range(size), max(1, edits)):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    link = [word() for _ in range(200)]
    for _ in range(12):
        link = link[9:] + [word() for _ in range(9)]
        rows.append((len(rows), " ".join(link)))
    rng.shuffle(rows)
    return rows


def test_near_stage_equals_brute_force(make, spark):
    rows = edited_texts()
    df = make([(*r, "x") for r in rows], "doc_id long, text string, sid string").coalesce(1)
    want = brute_components(rows)
    assert sorted((tuple(r) for r in N.near_groups(df).collect()), key=repr) == sorted(((k, c) for (k, _), c in zip(rows, want, strict=True)), key=repr)
    kept = corpus_pipeline.near_stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert N.near_groups(make([], "doc_id long, text string")).count() == 0


def test_the_parities_never_rule_out_a_near_copy():
    sketches = [(shingles(t), N.sketch_of(t)) for _, t in edited_texts()]
    ruled_out = 0
    for a, (_, m, _, p) in sketches:
        assert m == len(a)
        for b, (_, n, _, q) in sketches:
            differing = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p, q, strict=True))
            assert differing <= len(a ^ b)
            ruled_out += differing * 9 > m + n
    assert ruled_out > len(sketches)


def test_the_simhash_operator_links_the_closest_copies(make, spark, monkeypatch):
    """Without any bands the stage still joins what is within four bits of a fingerprint, and nothing else."""
    rng = random.Random(11)
    rows = [r for r in edited_texts() if r[0] is not None and r[0] < 900]
    for k in range(6):
        base = [f"v{rng.randrange(3000)}" for _ in range(2000)]
        rows += [(100 + 10 * k + j, " ".join(base[:at] + ["new"] + base[at + 1 :])) for j, at in enumerate(rng.sample(range(2000), 4))]
    sets = [shingles(t) for _, t in rows]
    prints = [S.print_of([N.shingles_of(t)]) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= S.MAX_DISTANCE and near(sets[i], sets[j]):
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    joined = [i for i in range(len(rows)) if part[i] != i]
    assert len(joined) >= 18 and len(set(part)) > len(set(brute_components(rows)))
    plain = N.sketches
    monkeypatch.setattr(N, "sketches", lambda c: F.transform(F.array(plain(c)), lambda s: s.withField("bands", F.array().cast("array<bigint>")))[0])
    df = make(list(enumerate(t for _, t in rows)), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()) == sorted(set(part))


def test_checked_components_equal_brute_force(make):
    rng, prints = random.Random(2), []
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.append(p)
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
    rng.shuffle(prints)
    kept = lambda a, b: (a + b) % 3 > 0
    part = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if kept(i, j) and (prints[i] ^ prints[j]).bit_count() <= S.MAX_DISTANCE:
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    df = make([(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)], "node long, fp long")
    got = {r.node: r.component for r in S.checked_components(df, lambda pairs: pairs.where("(a + b) % 3 > 0")).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == part
    assert S.checked_components(df.where("false"), lambda pairs: pairs).count() == 0


def join_rows(spark, run):
    """The most rows that a join makes while `run` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in _each(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most = 0
    for e in _each(store.executionsList()):
        if e.executionId() not in before:
            found = store.executionMetrics(e.executionId())
            for node in _each(store.planGraph(e.executionId()).allNodes()):
                for m in _each(node.metrics()) if "Join" in node.name() else ():
                    if m.name() == "number of output rows" and (said := found.get(m.accumulatorId())).isDefined():
                        most = max(most, int(said.get().replace(",", "")))
    return most


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_a_crowd_just_beyond_the_threshold_does_not_become_pairs(make, spark):
    """Fingerprints that meet at anchors by thousands, but differ in six bits and more, stay out of the joins' rows."""
    rng, crowd = random.Random(3), []
    while len(crowd) < 900:
        flips = frozenset(rng.sample(range(64), 5))
        if all(len(flips & c) <= 2 for c in crowd):
            crowd.append(flips)
    crowd += [c ^ {rng.randrange(64)} for c in crowd[:40]]
    base = rng.getrandbits(64)
    prints = [base ^ sum(1 << at for at in c) for c in crowd]
    part = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= S.MAX_DISTANCE:
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    df = make([(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)], "node long, fp long")
    got = {}
    made = join_rows(spark, lambda: got.update({r.node: r.component for r in S.checked_components(df, lambda pairs: pairs).collect()}))
    assert [got.get(i, i) for i in range(len(prints))] == part
    assert made <= 91 * len(prints)  # no join holds more rows than there are visits


def test_nodes_at_the_edge_of_a_group_do_not_leave_it_to_pairs(make, spark, monkeypatch):
    """The first rows share most bands of a group of near copies but are near none; the bands alone still join the group by stars."""
    rng, word = random.Random(9), lambda: f"w{rng.randrange(3000)}"
    base, rows = [word() for _ in range(300)], []
    for edits in [14] * 30 + [2] * 100:
        copy = base.copy()
        for at in rng.sample(range(300), edits):
            copy[at] = word()
        rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(N, "checked_components", lambda prints, check: prints.select("node", F.col("node").alias("component")).where("false"))
    df, got = make(rows, "doc_id long, text string").coalesce(1), []
    made = join_rows(spark, lambda: got.extend(sorted(tuple(r) for r in N.near_groups(df).collect())))
    assert got == [(k, c) for (k, _), c in zip(rows, brute_components(rows), strict=True)]
    assert len({c for _, c in got}) == 31
    assert made <= N.BANDS * len(rows)
