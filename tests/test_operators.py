"""The operators on small hand-made facts, with properties where they are cheap."""

from collections import deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import diff, findings, graph, history, link, metrics, reach, search
from graphloom.streaming import live


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.ts",), ("c.ts",), ("a/./b/../c",), ("../x",)], "p string")
    got = [tuple(r) for r in df.select(paths.dir_of(F.col("p")), paths.base_name(F.col("p")), paths.normalize(F.col("p")), paths.ancestors(F.col("p"))).collect()]
    assert got[0] == ("a/b", "c.ts", "a/b/c.ts", ["a", "a/b"])
    assert got[1] == (".", "c.ts", "c.ts", [])
    assert got[2][2] == "a/c" and got[3][2] == "../x"
    within = spark.createDataFrame([("a_b/x", "a_b"), ("aXb/x", "a_b"), ("a", "a"), ("z", ".")], "p string, d string")
    assert [r[0] for r in within.select(paths.is_within(F.col("p"), F.col("d"))).collect()] == [True, False, True, True]


def test_globs():
    import re

    assert re.match(paths.glob_pattern("src/**/*.ts"), "src/a/b/x.ts") and re.match(paths.glob_pattern("src/**/*.ts"), "src/x.ts")
    assert not re.match(paths.glob_pattern("src/*.ts"), "src/a/x.ts")
    assert re.match(paths.glob_pattern("*.{js,ts}"), "a.ts") and re.match(paths.glob_pattern("[!a]?.c+"), "bx.c+")


def test_longest_owner(spark):
    items = spark.createDataFrame([("a/b/x",), ("a/c",), ("q",)], "path string")
    owners = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, owner string")
    assert rows(paths.longest_owner(items, "path", owners, "dir", "owner")) == [("a/b/x", "B"), ("a/c", "A"), ("q", None)]


def brute_bfs(edges, seeds, depth):
    out = {}
    for seed, node in seeds:
        todo, seen = deque([(node, 0)]), {}
        while todo:
            n, d = todo.popleft()
            if n in seen:
                continue
            seen[n] = d
            if d < depth:
                todo.extend((b, d + 1) for a, b in edges if a == n)
        for n, d in seen.items():
            out[(seed, n)] = min(d, out.get((seed, n), 99))
    return sorted((s, n, d) for (s, n), d in out.items())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14))
def test_bfs_finds_least_depths(spark, edges):
    seeds = [(0, 0), (1, 3), (1, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert rows(graph.bfs(df, spark.createDataFrame(seeds, "seed long, node long"), 3)) == brute_bfs(edges, seeds, 3)


def test_shortest_path_and_fixpoint(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 1)], "src long, dst long")
    node = lambda n: spark.createDataFrame([(n,)], "node long")
    assert rows(graph.shortest_path(df, node(1), node(5))) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert rows(graph.shortest_path(df, node(5), node(9))) == []
    grown = graph.fixpoint(node(1), lambda new: new.join(df, new.node == df.src).select(F.col("dst").alias("node")), ["node"])
    assert rows(grown) == [(1,), (2,), (3,), (4,), (5,)]


def test_import_and_call_edges(spark):
    imports = spark.createDataFrame([(1, 1, 2, True), (2, 1, 2, False), (3, 1, 3, True), (4, 1, 1, False), (5, 1, None, False)], "id long, file_id long, target_file_id long, is_type_only boolean")
    assert rows(link.import_edges(imports)) == [(1, 2, 2, "imports"), (1, 3, 1, "references")]
    calls = spark.createDataFrame([(2, 1, 10, 20, 5, 9, "call", "likely"), (1, 1, 10, 20, 7, 3, "method", "exact"), (3, 1, 10, 10, 1, 1, "call", "exact"), (4, 1, 10, 30, 1, 1, "call", "unresolved")], "id long, file_id long, caller_symbol_id long, target_symbol_id long, line int, end_offset int, call_kind string, resolution string")
    assert rows(link.call_edges(calls)) == [(10, 20, 7, "method", "exact", 2)]


def test_http_links(spark):
    req = spark.createDataFrame([(1, "/api/users/42"), (2, "http://h/users/:id?x=1"), (3, "/nothing")], "request_id long, u string").select("request_id", link.route_segments(F.col("u")).alias("segments"))
    routes = spark.createDataFrame([(7, "/users/:id"), (8, "/users/list"), (9, "/orders/{id}")], "route_id long, u string").select("route_id", link.route_segments(F.col("u")).alias("segments"))
    got = {r.request_id: (r.route_id, r.score, r.confidence) for r in link.http_links(req, routes).collect()}
    assert got == {1: (7, 11, "likely"), 2: (7, 12, "likely")}


def test_http_links_equal_all_pairs(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(3)
    path = lambda: [rng.choice(["a", "b", "c", "*", "*", "d", None] if rng.random() < 0.2 else ["a", "b", "*"]) for _ in range(rng.randint(0, 4))]
    req = spark.createDataFrame([(rng.randint(1, 150), path()) for _ in range(200)] + [(500, None)], "request_id long, segments array<string>")
    routes = spark.createDataFrame([(rng.randint(1, 60), path()) for _ in range(80)] + [(None, ["d", "a"]), (None, ["d", "*"])], "route_id long, segments array<string>")
    pairs = req.distinct().withColumnRenamed("segments", "a").crossJoin(routes.distinct().withColumnRenamed("segments", "b")).withColumn("score", link.match_score(F.col("a"), F.col("b"))).where("score is not null")
    one = Window.partitionBy("request_id")
    best = pairs.withColumn("t", F.max("score").over(one)).where("score = t").withColumn("n", F.count("*").over(one)).where("n <= 4")
    want = rows(best.select("request_id", "route_id", "score", F.when(F.col("n") == 1, "likely").otherwise("ambiguous")))
    assert rows(link.http_links(req, routes)) == want and len(want) > 50


def test_http_links_of_one_common_segment(spark):
    req = spark.range(2000).select(F.col("id").alias("request_id"), F.array(F.lit("en"), F.concat(F.lit("p"), F.col("id").cast("string"))).alias("segments"))
    routes = spark.range(1000, 3000).select(F.col("id").alias("route_id"), F.array(F.lit("en"), F.concat(F.lit("p"), F.col("id").cast("string"))).alias("segments"))
    out = link.http_links(req, routes)
    assert rows(out) == [(k, k, 20, "likely") for k in range(1000, 2000)]

    def made(node):  # the most rows that a step of the plan that ran made
        kind, below = node.getClass().getSimpleName(), node.children()
        inner = [node.executedPlan()] if kind.startswith("Adaptive") else [node.plan()] if kind.endswith("QueryStageExec") else [below.apply(i) for i in range(below.size())]
        count = node.metrics().get("numOutputRows")
        return max([count.get().value() if count.isDefined() else 0, *map(made, inner)])

    assert made(out._jdf.queryExecution().executedPlan()) <= 10_000  # 4,000,000 pairs share `en`


def test_history_and_coupling(spark):
    cf = [(c, f) for c in range(5) for f in (1, 2)] + [(9, 1), (9, 3)] + [(c, 50 + c) for c in range(10, 20)]
    commits = spark.createDataFrame([(c, c % 2, f"2024-0{1 + c % 9}-01 00:00:00", c == 0) for c in range(20)], "commit_id long, author long, t string, ai boolean").select("commit_id", "author", F.to_timestamp("t").alias("made_at"), "ai")
    cf = spark.createDataFrame(cf, "commit_id long, file_id long")
    pairs = history.co_changes(cf)
    assert rows(pairs) == [(1, 2, 5)]
    own = history.file_history(commits, cf, F.to_timestamp(F.lit("2024-05-15")))
    one = own.where("file_id = 1").first()
    assert (one.commits, one.authors, one.ai_commits) == (6, 2, 1)
    none = spark.createDataFrame([], "src long, dst long")
    assert [r[:3] for r in rows(findings.coupling(pairs, own, 20, none))] == [(1, 2, 5)]
    direct = spark.createDataFrame([(2, 1)], "src long, dst long")
    assert rows(findings.coupling(pairs, own, 20, direct)) == []
    over = spark.createDataFrame([(2, 8), (1, 8)], "src long, dst long")
    assert rows(findings.coupling(pairs, own, 20, over)) == []


def test_diff(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3")], "path string, hash string")
    head = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3")], "path string, hash string")
    assert rows(diff.diff_files(base, head)) == [("b", "modified", None), ("d", "removed", None), ("x", "moved", "c")]
    assert rows(diff.diff_files(base, base)) == []
    assert rows(diff.diff_keys(base, head, ["path"])) == [("c", "removed"), ("d", "removed"), ("x", "added")]
    s = "id long, path string, container string, name string, kind string, start_line int, hash string"
    a = spark.createDataFrame([(1, "f", None, "g", "function", 1, "h"), (2, "f", None, "g", "function", 9, "k")], s)
    b = spark.createDataFrame([(5, "f", None, "g", "function", 2, "h"), (6, "f", None, "n", "function", 3, "z")], s)
    assert [(r.name, r.ordinal, r.status) for r in sorted(diff.pair_symbols(a, b).collect(), key=lambda r: (r.name, r.ordinal))] == [("g", 1, "same"), ("g", 2, "removed"), ("n", 1, "added")]


def test_scope_graph_keeps_sums(spark):
    nodes = spark.createDataFrame([(i, i * 10, i) for i in range(1, 8)], "id long, loc long, complexity long")
    edges = spark.createDataFrame([(7, 6, 2), (1, 2, 5), (7, 1, 1), (7, 2, 1)], "src long, dst long, weight long")
    shown, merged = metrics.scope_graph(nodes, edges, 3)
    assert shown.agg(F.sum("loc")).first()[0] == 280 and shown.count() == 3
    assert rows(merged) == [("7", "6", 2), ("7", "agg:", 2)]


def test_intervals_and_asof(spark):
    outer = spark.createDataFrame([(1, 1, 1, 100), (2, 1, 10, 20), (3, 2, 1, 9)], "id long, f long, lo long, hi long")
    inner = spark.createDataFrame([(9, 1, 15), (8, 1, 50), (7, 2, 50)], "id long, f long, at long")
    assert rows(metrics.containing(inner, outer, "f")) == [(8, 1), (9, 2)]
    right = spark.createDataFrame([(1, 1, 15), (2, 1, 60), (3, 1, 60)], "id long, f long, at long")
    assert rows(metrics.next_at(inner, right, ["f"])) == [(7, None), (8, 2), (9, 1)]


def test_search(spark):
    e = spark.createDataFrame([(1, "walkRepo", "walk the repository"), (2, "Walker", None), (3, "other", "thing")], "ref long, label string, detail string")
    got = search.search(search.build_index(e), "walk").collect()
    assert {r.ref for r in got} == {1, 2} and got[0].score >= got[1].score
    assert search.search(search.build_index(e), "walk thing").count() == 0
    sql = spark.createDataFrame([(1, "SELECT * FROM items JOIN users u"), (2, "insert into logs values (1)"), (3, "with c as (select 1 from t) select * from c"), (4, "DELETE FROM old")], "id long, literal string")
    assert rows(search.sql_tables(sql)) == [(1, "items", False), (1, "users", False), (2, "logs", True), (3, "t", False), (4, "old", True)]


def test_reach(spark):
    e = spark.createDataFrame([(1, 2, "exact"), (2, 3, "likely"), (3, 4, "ambiguous")], "src long, dst long, confidence string")
    sites = spark.createDataFrame([(3, "database"), (4, "network")], "symbol_id long, kind string")
    assert rows(reach.io_reach(e, sites)) == [(1, "database", 2), (2, "database", 1), (3, "database", 0), (4, "network", 0)]
    cov = reach.test_coverage(e, spark.createDataFrame([(1,)], "case_id long"), spark.createDataFrame([(2,), (3,)], "id long"))
    assert rows(cov) == [(2, 1, 1, "1"), (3, 1, 0, "1")]


def test_stream_debounce_and_refresh(spark, tmp_path):
    import json

    feed, done = tmp_path / "feed", []
    feed.mkdir()
    events = [("r", "2024-01-01T00:00:00.000"), ("r", "2024-01-01T00:00:00.500"), ("r", "2024-01-01T00:00:05.000"), ("r", "2024-01-01T01:00:00.000")]
    (feed / "1.json").write_text("\n".join(json.dumps({"repo": r, "ts": t, "path": f"p{i}"}) for i, (r, t) in enumerate(events)))
    stream = live.change_feed(spark, str(feed), "repo string, ts timestamp, path string")
    q = live.debounce(stream, key="repo", late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.changes for r in spark.table("bursts").collect()) == [1, 2]  # the last burst waits for the watermark
    q = live.refresh_on(stream, lambda df, n: done.append(df.count()), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert sum(done) == 4
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    new = spark.createDataFrame([("b", 2, False), ("a", 0, True), ("c", 3, None)], "path string, v int, deleted boolean")
    assert rows(live.upsert_facts(old, new, "path")) == [("b", 2), ("c", 3)]
