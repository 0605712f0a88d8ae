"""The registered queries of the code-graph operators and their DuckDB twins, over facts projected from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import boundary, clusters, diff, findings, graph, history, ignore, link, methods, metrics, modules, reach, resolve, search
from graphloom.sources.projection import facts, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = twin(sql.strip(), recursive)
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package and directory dependencies that import each other."""
    imports, files = facts(spark, sf_dir, "imports", "files")
    return link.cycles(link.rollup_edges(imports, files))


EDGES = """edges AS (SELECT file_id AS src, target_file_id AS dst, count(*) AS weight,
  CASE WHEN min(CASE WHEN is_type_only THEN 1 ELSE 0 END) = 0 THEN 'imports' ELSE 'references' END AS type
  FROM imports WHERE target_file_id IS NOT NULL AND file_id <> target_file_id GROUP BY 1, 2)"""
CALLS = """made AS (SELECT *, row_number() OVER (PARTITION BY caller_symbol_id, target_symbol_id ORDER BY file_id, end_offset, id) AS k,
  count(*) OVER (PARTITION BY caller_symbol_id, target_symbol_id) AS weight FROM calls
  WHERE target_symbol_id IS NOT NULL AND resolution <> 'unresolved' AND caller_symbol_id <> target_symbol_id),
call_edges AS (SELECT caller_symbol_id AS src, target_symbol_id AS dst, line, call_kind, resolution AS confidence, weight FROM made WHERE k = 1)"""
ROLLUPS = """pairs AS (SELECT i.is_type_only, a.dir_path d1, b.dir_path d2, a.package p1, b.package p2 FROM imports i
  JOIN files a ON i.file_id = a.id AND a.role = 'source' JOIN files b ON i.target_file_id = b.id AND b.role = 'source'),
levels AS (SELECT 'directory' AS level, is_type_only, d1 AS src, d2 AS dst FROM pairs UNION ALL SELECT 'package', is_type_only, p1, p2 FROM pairs),
rollups AS (SELECT level, CASE WHEN is_type_only THEN 'references' ELSE 'imports' END AS type, src, dst, count(*) AS weight FROM levels WHERE src <> dst GROUP BY 1, 2, 3, 4)"""
DIRS = """up AS (SELECT package AS path, '.' AS parent, 1 AS depth, loc, complexity, role FROM files
  UNION ALL SELECT dir_path, package, 2, loc, complexity, role FROM files),
dirs AS (SELECT path, parent, depth, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(complexity) AS BIGINT) AS complexity FROM up WHERE role = 'source' GROUP BY 1, 2, 3)"""


@query("g1_index_totals", """
SELECT (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(loc) AS BIGINT) FROM files) AS loc, (SELECT CAST(sum(complexity) AS BIGINT) FROM files) AS complexity,
  (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM symbols WHERE exported) AS exported, (SELECT count(*) FROM imports) AS imports,
  (SELECT count(*) FROM imports WHERE confidence = 'external') AS external, (SELECT count(*) FROM imports WHERE confidence = 'unresolved') AS unresolved,
  (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM calls WHERE resolution = 'exact') AS exact_calls, (SELECT count(*) FROM imports WHERE confidence = 'exact') AS resolved""")
def g1(spark, sf_dir):
    return metrics.index_totals(*facts(spark, sf_dir, "files", "symbols", "imports", "calls"))


@query("g2_language_breakdown", """
SELECT language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, round(sum(loc) / (SELECT greatest(sum(loc), 1) FROM files WHERE role <> 'asset'), 9) AS share FROM files WHERE role <> 'asset' GROUP BY 1""")
def g2(spark, sf_dir):
    return metrics.language_breakdown(*facts(spark, sf_dir, "files")).withColumn("share", F.round("share", 9))


@query("g3_package_totals", """
SELECT name, count(f.id) AS files, CAST(coalesce(sum(loc), 0) AS BIGINT) AS loc, CAST(coalesce(sum(complexity), 0) AS BIGINT) AS complexity
FROM packages LEFT JOIN files f ON f.package = name AND f.role = 'source' GROUP BY 1""")
def g3(spark, sf_dir):
    return metrics.package_totals(*facts(spark, sf_dir, "packages", "files"))


@query("g4_directory_totals", f"WITH {DIRS} SELECT * FROM dirs")
def g4(spark, sf_dir):
    return metrics.directory_totals(facts(spark, sf_dir, "files")[0], ["source"])


@query("n3_tree_level", f"WITH {DIRS} SELECT path, files, loc, complexity, round(loc / greatest(max(loc) OVER (), 1), 9) AS heat FROM dirs WHERE parent = 'brand_1'")
def n3(spark, sf_dir):
    out = metrics.tree_level(metrics.directory_totals(facts(spark, sf_dir, "files")[0], ["source"]), "brand_1")
    return out.withColumn("heat", F.round("heat", 9))


@query("g6_import_edges", f"WITH {EDGES} SELECT * FROM edges")
def g6(spark, sf_dir):
    return link.import_edges(*facts(spark, sf_dir, "imports"))


@query("g7_rollup_edges", f"WITH {ROLLUPS} SELECT * FROM rollups")
def g7(spark, sf_dir):
    return link.rollup_edges(*facts(spark, sf_dir, "imports", "files"))


@query("l2_cycles", f"""WITH {ROLLUPS}
SELECT a.level, a.src, a.dst, CASE WHEN a.level = 'package' THEN 'high' ELSE 'medium' END AS severity, a.weight, b.weight AS back
FROM rollups a JOIN rollups b ON a.level = b.level AND a.src = b.dst AND a.dst = b.src AND a.src < a.dst WHERE a.type = 'imports' AND b.type = 'imports'""")
def l2(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("g9_call_edges", f"WITH {CALLS} SELECT * FROM call_edges")
def g9(spark, sf_dir):
    return link.call_edges(*facts(spark, sf_dir, "calls"))


@query("g30_call_resolution", "SELECT resolution, call_kind, count(*) AS n FROM calls GROUP BY 1, 2")
def g30(spark, sf_dir):
    return facts(spark, sf_dir, "calls")[0].groupBy("resolution", "call_kind").agg(F.count("*").alias("n"))


@query("k2_type_relations", """
WITH t AS (SELECT name, min(id) AS target_id, count(*) AS n FROM symbols WHERE kind IN ('class', 'interface', 'struct', 'enum', 'type', 'trait') GROUP BY 1)
SELECT c.id, c.callee_name AS target, t.target_id, CASE WHEN n IS NULL THEN 'external' WHEN n = 1 THEN 'likely' ELSE 'ambiguous' END AS confidence
FROM calls c LEFT JOIN t ON c.callee_name = t.name WHERE c.callee_name IS NOT NULL""")
def k2(spark, sf_dir):
    calls, symbols = facts(spark, sf_dir, "calls", "symbols")
    return link.link_type_relations(calls.where("callee_name is not null").select("id", F.col("callee_name").alias("target")), symbols).select("id", "target", "target_id", "confidence")


@query("k5_resolve_plain_calls", """
WITH needs AS (SELECT DISTINCT c.file_id, callee_name AS name, language, dir_path FROM calls c JOIN files f ON f.id = c.file_id WHERE callee_name IS NOT NULL),
l AS (SELECT file_id, name, min(id) AS sid, count(*) AS n FROM symbols GROUP BY 1, 2),
ex AS (SELECT file_id, name, min(id) AS sid FROM symbols WHERE exported GROUP BY 1, 2),
bound AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, local ORDER BY import_id, imported) AS k FROM bindings) WHERE k = 1),
step AS (SELECT file_id, local AS name, target_file_id, imported FROM bound WHERE target_file_id IS NOT NULL
  UNION SELECT s.file_id, x.name, s.target_file_id, x.name FROM stars s CROSS JOIN (SELECT DISTINCT name FROM needs) x),
open_names AS (SELECT n.* FROM needs n ANTI JOIN l USING (file_id, name)),
by_import AS (SELECT o.file_id, o.name, b.target_file_id, b.imported, b.external_name FROM open_names o JOIN bound b ON o.file_id = b.file_id AND o.name = b.local),
by_star AS (SELECT o.file_id, o.name, s.target_file_id FROM open_names o JOIN stars s USING (file_id) WHERE language IN ('python', 'rust')),
chase AS (SELECT target_file_id AS f0, imported AS n0, target_file_id AS f, imported AS n, 0 AS hop FROM (
    SELECT target_file_id, imported FROM by_import WHERE target_file_id IS NOT NULL UNION SELECT target_file_id, name FROM by_star)
  UNION SELECT c.f0, c.n0, s.target_file_id, s.imported, hop + 1 FROM chase c JOIN step s ON s.file_id = c.f AND s.name = c.n
    ANTI JOIN ex ON ex.file_id = c.f AND ex.name = c.n WHERE hop < 24),
hit AS (SELECT f0, n0, min_by(sid, hop * 100000000000000 + sid) AS sid FROM chase JOIN ex ON ex.file_id = f AND ex.name = n GROUP BY 1, 2),
star AS (SELECT b.file_id, b.name, min(h.sid) AS sid, count(DISTINCT h.sid) AS n FROM by_star b JOIN hit h ON h.f0 = target_file_id AND h.n0 = b.name GROUP BY 1, 2),
pack AS (SELECT dir_path, name, min(s.id) AS sid, count(*) AS n FROM symbols s JOIN files f ON f.id = s.file_id WHERE language = 'go' GROUP BY 1, 2),
named AS (SELECT o.file_id, o.name,
  CASE WHEN l.sid IS NOT NULL THEN 'local' WHEN i.external_name IS NOT NULL OR h.sid IS NOT NULL OR t.sid IS NOT NULL THEN 'import' WHEN star.sid IS NOT NULL THEN 'star' WHEN o.language = 'go' AND pack.sid IS NOT NULL THEN 'package' END AS tier,
  CASE WHEN l.sid IS NOT NULL THEN l.sid WHEN i.external_name IS NOT NULL THEN NULL ELSE coalesce(h.sid, t.sid, star.sid, CASE WHEN o.language = 'go' THEN pack.sid END) END AS target_symbol_id,
  CASE WHEN l.sid IS NULL THEN i.external_name END AS external_name,
  CASE WHEN l.n = 1 THEN 'exact' WHEN l.n > 1 THEN 'ambiguous' WHEN i.external_name IS NOT NULL THEN 'external' WHEN h.sid IS NOT NULL THEN 'exact' WHEN t.sid IS NOT NULL THEN 'likely'
    WHEN star.n = 1 THEN 'likely' WHEN star.n > 1 THEN 'ambiguous' WHEN o.language = 'go' AND pack.n = 1 THEN 'likely' WHEN o.language = 'go' AND pack.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS confidence
  FROM needs o LEFT JOIN l USING (file_id, name) LEFT JOIN by_import i USING (file_id, name) LEFT JOIN hit h ON h.f0 = i.target_file_id AND h.n0 = i.imported
  LEFT JOIN l t ON t.file_id = i.target_file_id AND t.name = i.imported AND t.n = 1 LEFT JOIN star USING (file_id, name) LEFT JOIN pack ON pack.dir_path = o.dir_path AND pack.name = o.name)
SELECT c.id, n.tier, n.target_symbol_id, n.external_name, coalesce(n.confidence, 'unresolved') AS confidence FROM calls c LEFT JOIN named n ON n.file_id = c.file_id AND n.name = c.callee_name""", recursive=True)
def k5(spark, sf_dir):
    names = ("calls", "files", "symbols", "bindings", "stars")
    return resolve.resolve_plain_calls(*facts(spark, sf_dir, *names, once=("sites", "symbols")))


@query("a4_layered_ignore", """
SELECT path, coalesce(CASE WHEN path LIKE '%00.ts' THEN false END,
  CASE WHEN path LIKE '%5.ts' THEN false WHEN path LIKE '%' || CAST(CAST(substr(package, 7) AS BIGINT) % 10 AS STRING) || '.ts' THEN true END,
  CASE WHEN split_part(path, '/', 2) LIKE 'promo%' OR path LIKE '%3.ts' THEN true END, false) AS ignored FROM files""")
def a4(spark, sf_dir):
    files, rules = facts(spark, sf_dir, "files", "ignore_files")
    return ignore.ignored(files.select("path"), rules)


@query("k4_resolve_method_calls", """
WITH needs AS (SELECT DISTINCT c.file_id, s.container AS host, receiver, regexp_extract(receiver, '^(.*?)(?:\\.|::|$)', 1) AS head, callee_name AS name,
    receiver IN ('this', 'self', 'Self', 'cls') AS is_self, receiver IN ('super', 'super()') AS is_super FROM method_calls c LEFT JOIN symbols s ON s.id = c.caller_symbol_id
  WHERE callee_name IS NOT NULL AND receiver <> ''),
owned AS (SELECT s.id, s.file_id, s.name, s.container AS owner, f.language, f.dir_path, f.package FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.container IS NOT NULL),
placed AS (SELECT t.id AS type_id, t.file_id, t.name AS owner, f.language, f.dir_path, f.package FROM types t JOIN files f ON f.id = t.file_id),
near AS (SELECT type_id, o.name, max(o.id) AS id FROM placed p JOIN owned o ON o.file_id = p.file_id AND o.owner = p.owner GROUP BY 1, 2),
afar AS (SELECT type_id, o.name, max(o.id) AS id FROM placed p JOIN owned o ON o.owner = p.owner AND o.language = p.language AND (p.language = 'go' AND o.dir_path = p.dir_path OR p.language = 'rust' AND o.package = p.package) GROUP BY 1, 2),
has AS (SELECT * FROM near UNION ALL SELECT a.* FROM afar a ANTI JOIN near n ON n.type_id = a.type_id AND n.name = a.name),
impl AS (SELECT p.parent_id AS type_id, h.name, min(h.id) AS id, count(DISTINCT h.id) AS n FROM (SELECT DISTINCT type_id, parent_id FROM parents) p JOIN has h USING (type_id) WHERE p.parent_id IN (SELECT id FROM types WHERE kind = 'interface') GROUP BY 1, 2),
answer AS (SELECT h.type_id, h.name, h.id, 1 AS n, 'exact' AS confidence FROM has h JOIN types t ON t.id = h.type_id WHERE t.kind <> 'interface'
  UNION ALL SELECT type_id, name, id, n, CASE WHEN n = 1 THEN 'likely' ELSE 'ambiguous' END FROM impl
  UNION ALL SELECT h.type_id, h.name, h.id, 1, 'likely' FROM has h JOIN types t ON t.id = h.type_id ANTI JOIN impl i ON i.type_id = h.type_id AND i.name = h.name WHERE t.kind = 'interface'),
host_type AS (SELECT file_id, name AS host, min(id) AS type_id FROM types GROUP BY 1, 2),
wanted AS (SELECT DISTINCT type_id, n.name FROM needs n JOIN host_type USING (file_id, host) WHERE is_self OR is_super),
up AS (SELECT DISTINCT type_id AS start, type_id, CAST(NULL AS VARCHAR) AS external_name, CAST([] AS INT[]) AS path FROM wanted
  UNION ALL SELECT u.start, p.parent_id, p.external_name, list_append(u.path, p.ordinal) FROM up u JOIN parents p ON p.type_id = u.type_id WHERE len(u.path) < 6 AND (p.parent_id IS NULL OR p.parent_id <> p.type_id)),
met AS (SELECT w.type_id, w.name, u.path, CASE WHEN u.type_id IS NOT NULL THEN a.id END AS id, CASE WHEN u.type_id IS NULL THEN 0 ELSE a.n END AS n, u.external_name, CASE WHEN u.type_id IS NULL THEN 'external' ELSE a.confidence END AS confidence
  FROM wanted w JOIN up u ON u.start = w.type_id AND len(u.path) > 0 LEFT JOIN answer a ON a.type_id = u.type_id AND a.name = w.name WHERE u.type_id IS NULL OR a.id IS NOT NULL),
above AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY type_id, name ORDER BY path, id) = 1),
bound AS (SELECT * FROM owner_bindings QUALIFY row_number() OVER (PARTITION BY file_id, local ORDER BY import_id, imported) = 1),
whole AS (SELECT n.*, CASE WHEN a.file_id IS NOT NULL THEN a.target_file_id ELSE b.target_file_id END AS tf, CASE WHEN a.file_id IS NOT NULL THEN a.imported ELSE b.imported END AS imported,
    CASE WHEN a.file_id IS NOT NULL THEN a.external_name ELSE b.external_name END AS ext, a.file_id IS NOT NULL OR b.file_id IS NOT NULL AS is_bound
  FROM needs n LEFT JOIN bound a ON a.file_id = n.file_id AND a.local = n.receiver LEFT JOIN bound b ON b.file_id = n.file_id AND b.local = n.head),
ex AS (SELECT file_id, name, min(id) AS sid FROM symbols WHERE exported GROUP BY 1, 2),
module AS (SELECT DISTINCT tf AS f0, name, tf AS f, 0 AS hop FROM whole WHERE imported = '*' AND tf IS NOT NULL
  UNION SELECT m.f0, m.name, s.target_file_id, hop + 1 FROM module m JOIN stars s ON s.file_id = m.f ANTI JOIN ex ON ex.file_id = m.f AND ex.name = m.name WHERE hop < 24),
module_hit AS (SELECT f0, m.name, min_by(sid, hop * 100000000000000 + sid) AS sid FROM module m JOIN ex ON ex.file_id = f AND ex.name = m.name GROUP BY 1, 2),
sole AS (SELECT file_id, owner, name, min(id) AS sid FROM owned GROUP BY 1, 2, 3 HAVING count(*) = 1),
chase AS (SELECT DISTINCT tf AS f0, imported AS o0, name, tf AS f, imported AS o, 0 AS hop FROM whole WHERE imported <> '*' AND tf IS NOT NULL AND NOT contains(receiver, '.')
  UNION SELECT c.f0, c.o0, c.name, s.f1, coalesce(s.o1, c.o), hop + 1 FROM chase c
    JOIN (SELECT file_id, local, target_file_id AS f1, imported AS o1 FROM bound WHERE target_file_id IS NOT NULL AND imported <> '*' UNION ALL SELECT file_id, NULL, target_file_id, NULL FROM stars) s ON s.file_id = c.f AND coalesce(s.local, c.o) = c.o
    ANTI JOIN sole ON sole.file_id = c.f AND sole.owner = c.o AND sole.name = c.name WHERE hop < 24),
owner_hit AS (SELECT f0, o0, c.name, min_by(sid, hop * 100000000000000 + sid) AS sid FROM chase c JOIN sole ON sole.file_id = f AND sole.owner = o AND sole.name = c.name GROUP BY 1, 2, 3),
sees AS (SELECT file_id, name AS owner FROM types UNION SELECT file_id, local FROM bound),
visible AS (SELECT n.file_id, n.name, min(o.id) AS sid, least(count(DISTINCT o.id), 16) AS n FROM (SELECT DISTINCT file_id, name FROM needs) n JOIN sees USING (file_id) JOIN owned o ON o.owner = sees.owner AND o.name = n.name GROUP BY 1, 2),
mine AS (SELECT file_id, owner, name, min(id) AS sid, count(*) AS n FROM owned GROUP BY 1, 2, 3),
joined AS (SELECT w.*, m.sid AS self_id, a.id AS up_id, a.n AS up_n, a.external_name AS up_ext, a.confidence AS up_grade, mh.sid AS module_id, CASE WHEN NOT is_bound THEN h.sid WHEN imported <> '*' THEN oh.sid END AS owner_id, v.sid AS seen_id, v.n AS seen_n
  FROM whole w LEFT JOIN mine m ON m.file_id = w.file_id AND m.owner = w.host AND m.name = w.name LEFT JOIN host_type t ON t.file_id = w.file_id AND t.host = w.host LEFT JOIN above a ON a.type_id = t.type_id AND a.name = w.name
  LEFT JOIN module_hit mh ON mh.f0 = w.tf AND mh.name = w.name AND w.imported = '*' LEFT JOIN owner_hit oh ON oh.f0 = w.tf AND oh.o0 = w.imported AND oh.name = w.name
  LEFT JOIN mine h ON h.file_id = w.file_id AND h.owner = w.receiver AND h.name = w.name AND h.n = 1 LEFT JOIN visible v ON v.file_id = w.file_id AND v.name = w.name),
tiers AS (SELECT *, CASE WHEN is_self AND self_id IS NOT NULL THEN 'self' WHEN (is_self OR is_super) AND up_grade IS NOT NULL THEN 'inherited' WHEN imported = '*' AND (ext IS NOT NULL OR module_id IS NOT NULL) THEN 'namespace'
  WHEN NOT contains(receiver, '.') AND owner_id IS NOT NULL THEN 'owner' WHEN seen_id IS NOT NULL THEN 'visible' END AS tier FROM joined),
decided AS (SELECT file_id, host, receiver, name, tier,
  CASE tier WHEN 'self' THEN self_id WHEN 'inherited' THEN up_id WHEN 'namespace' THEN CASE WHEN ext IS NULL THEN module_id END WHEN 'owner' THEN owner_id WHEN 'visible' THEN seen_id END AS target_symbol_id,
  CASE tier WHEN 'inherited' THEN up_ext WHEN 'namespace' THEN ext END AS external_name,
  CASE tier WHEN 'self' THEN 'exact' WHEN 'inherited' THEN up_grade WHEN 'namespace' THEN CASE WHEN ext IS NULL THEN 'exact' ELSE 'external' END WHEN 'owner' THEN 'exact' WHEN 'visible' THEN CASE WHEN seen_n = 1 THEN 'likely' ELSE 'ambiguous' END ELSE 'unresolved' END AS confidence,
  CASE tier WHEN 'self' THEN 1 WHEN 'inherited' THEN least(up_n, 16) WHEN 'namespace' THEN CASE WHEN ext IS NULL THEN 1 ELSE 0 END WHEN 'owner' THEN 1 WHEN 'visible' THEN seen_n ELSE 0 END AS candidates FROM tiers)
SELECT c.id, d.tier, d.target_symbol_id, d.external_name, coalesce(d.confidence, 'unresolved') AS confidence, CAST(coalesce(d.candidates, 0) AS BIGINT) AS candidates
FROM method_calls c LEFT JOIN symbols s ON s.id = c.caller_symbol_id LEFT JOIN decided d ON d.file_id = c.file_id AND d.host IS NOT DISTINCT FROM s.container AND d.receiver = c.receiver AND d.name = c.callee_name""", recursive=True)
def k4(spark, sf_dir):
    names = ("method_calls", "files", "symbols", "types", "parents", "owner_bindings", "stars")
    return methods.resolve_method_calls(*facts(spark, sf_dir, *names, once=("sites", *names)))  # each is read by several steps


@query("f5_longest_prefix_owner", """
WITH o AS (SELECT DISTINCT package AS dir, package AS owner FROM files UNION ALL SELECT DISTINCT dir_path, dir_path FROM files WHERE length(dir_path) % 2 = 0)
SELECT f.path, max_by(o.owner, length(o.dir)) AS owner FROM files f LEFT JOIN o ON f.path LIKE replace(o.dir, '_', '\\_') || '/%' ESCAPE '\\' GROUP BY 1""")
def f5(spark, sf_dir):
    files = facts(spark, sf_dir, "files")[0]
    dirs = files.select("dir_path").distinct().where(F.length("dir_path") % 2 == 0).select(F.col("dir_path").alias("dir"))
    owners = files.select(F.col("package").alias("dir")).distinct().unionByName(dirs).withColumn("owner", F.col("dir"))
    return paths.longest_owner(files.select("path"), "path", owners, "dir", "owner")


@query("f6_innermost_container", """
SELECT inner_id, min_by(outer_id, (hi - lo) * 100000000000000 + outer_id) AS outer_id FROM (
  SELECT c.id AS inner_id, s.id AS outer_id, s.start_line AS lo, s.end_line AS hi FROM calls c JOIN symbols s ON c.file_id = s.file_id AND c.line * 60 BETWEEN s.start_line AND s.end_line) GROUP BY 1""")
def f6(spark, sf_dir):
    calls, symbols = facts(spark, sf_dir, "calls", "symbols")
    outer = symbols.select("file_id", "id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    return metrics.containing(calls.select("id", "file_id", (F.col("line") * 60).alias("at")), outer, "file_id")


@query("f7_next_symbol_asof", """
SELECT c.id AS left_id, min_by(s.id, s.start_line * 100000000000000 + s.id) AS right_id FROM calls c LEFT JOIN symbols s ON c.file_id = s.file_id AND s.start_line >= c.line * 60 GROUP BY 1""")
def f7(spark, sf_dir):
    calls, symbols = facts(spark, sf_dir, "calls", "symbols")
    left = calls.select("id", "file_id", (F.col("line") * 60).cast("long").alias("at"))
    return metrics.next_at(left, symbols.select("id", "file_id", F.col("start_line").alias("at")), ["file_id"])


@query("h1_occurrence", "SELECT id, CAST(row_number() OVER (PARTITION BY file_id, kind, container ORDER BY start_line, id) AS INT) AS occurrence FROM symbols")
def h1(spark, sf_dir):
    return metrics.occurrence(facts(spark, sf_dir, "symbols")[0], ["file_id", "kind", "container"], ["start_line", "id"]).select("id", "occurrence")


@query("h3_largest_functions", """
SELECT * FROM (SELECT file_id, id, complexity, CAST(row_number() OVER (PARTITION BY file_id ORDER BY complexity DESC, id) AS INT) AS rank FROM symbols WHERE kind <> 'class') WHERE rank <= 5""")
def h3(spark, sf_dir):
    own = facts(spark, sf_dir, "symbols")[0].where("kind <> 'class'").select("file_id", "id", "complexity")
    return metrics.top_per_group(own, "file_id", [F.desc("complexity"), "id"], 5)


@query("g24_degrees", f"""WITH {EDGES}
SELECT f.id, (SELECT count(*) FROM edges WHERE dst = f.id) AS n_in, (SELECT count(*) FROM edges WHERE src = f.id) AS n_out FROM files f""")
def g24(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    return metrics.degrees(link.import_edges(imports), files)


SCOPE = f"""WITH {EDGES}, top AS (SELECT id FROM files ORDER BY loc DESC, id LIMIT 59),
key AS (SELECT f.id, loc, complexity, CASE WHEN top.id IS NULL THEN 'agg:' ELSE CAST(f.id AS STRING) END AS node FROM files f LEFT JOIN top ON f.id = top.id)"""


@query("i1_scope_graph_nodes", SCOPE + " SELECT node, count(*) AS members, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(complexity) AS BIGINT) AS complexity FROM key GROUP BY 1")
def i1_nodes(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    return metrics.scope_graph(files, link.import_edges(imports), 60)[0]


@query("i1_scope_graph_edges", SCOPE + " SELECT a.node AS src, b.node AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges e JOIN key a ON e.src = a.id JOIN key b ON e.dst = b.id WHERE a.node <> b.node GROUP BY 1, 2")
def i1_edges(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    return metrics.scope_graph(files, link.import_edges(imports), 60)[1]


@query("l1_duplicates", """
SELECT shape, count(*) AS members, count(DISTINCT file_id) AS files, CASE WHEN min(name) = max(name) THEN 'high' ELSE 'low' END AS severity
FROM symbols WHERE complexity >= 2 AND end_line - start_line + 1 >= 3 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT file_id) >= 2""")
def l1(spark, sf_dir):
    return findings.duplicates(*facts(spark, sf_dir, "symbols"))


RULES = [
    {"name": "no-economy", "from": ["brand_1*/**"], "disallow": ["**/economy/**"]},
    {"name": "small-only", "from": ["**/large/*"], "disallow": ["**/small/**"], "allow": ["brand_2/**"], "include_type_only": True},
]


@query("l3_violations", r"""
WITH p AS (SELECT i.file_id, i.is_type_only, a.path AS p1, b.path AS p2 FROM imports i JOIN files a ON i.file_id = a.id AND a.role = 'source' JOIN files b ON i.target_file_id = b.id),
v AS (SELECT 'no-economy' AS rule, file_id FROM p WHERE NOT is_type_only AND regexp_matches(p1, '^brand_1[^/]*/.*$') AND regexp_matches(p2, '^(?:.*/)?economy/.*$')
UNION ALL SELECT 'small-only', file_id FROM p WHERE regexp_matches(p1, '^(?:.*/)?large/[^/]*$') AND regexp_matches(p2, '^(?:.*/)?small/.*$') AND NOT regexp_matches(p2, '^brand_2/.*$'))
SELECT rule, file_id, count(*) AS n FROM v GROUP BY 1, 2""")
def l3(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    return findings.violations(imports, files, RULES)


@query("l4_oversized_functions", """
SELECT id, complexity, end_line - start_line + 1 AS lines, CASE WHEN complexity >= 50 OR end_line - start_line + 1 >= 400 THEN 'medium' ELSE 'low' END AS severity
FROM symbols WHERE kind IN ('function', 'method') AND (complexity >= 25 OR (end_line - start_line + 1 >= 200 AND complexity >= 10))""")
def l4(spark, sf_dir):
    return findings.oversized_functions(*facts(spark, sf_dir, "symbols"))


@query("l5_oversized_files", """
SELECT f.id, f.loc, CAST(sum(s.complexity) AS BIGINT) AS complexity, count(*) AS functions FROM files f JOIN symbols s ON s.file_id = f.id
WHERE f.role = 'source' AND f.loc >= 1000 GROUP BY 1, 2 HAVING sum(s.complexity) >= 100""")
def l5(spark, sf_dir):
    return findings.oversized_files(*facts(spark, sf_dir, "files", "symbols"))


@query("l6_unapproved_dependencies", f"""WITH {ROLLUPS}, d AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM rollups WHERE level = 'package' GROUP BY 1, 2)
SELECT * FROM d WHERE NOT (src < dst OR src = 'brand_9')""")
def l6(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    deps = link.rollup_edges(imports, files).where("level = 'package'").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return findings.unapproved(deps, deps.where("src < dst or src = 'brand_9'"))


@query("l7_layering", """
WITH m AS (SELECT DISTINCT package AS member, CAST(length(package) + ascii(right(package, 1)) AS BIGINT) % 4 AS ordinal FROM files),
o AS (SELECT f.id, m.ordinal FROM files f JOIN m ON f.package = m.member WHERE f.role = 'source')
SELECT a.ordinal AS from_layer, b.ordinal AS to_layer, count(*) AS n, count(DISTINCT file_id) AS files
FROM imports i JOIN o a ON i.file_id = a.id JOIN o b ON i.target_file_id = b.id WHERE NOT is_type_only AND a.ordinal > b.ordinal GROUP BY 1, 2""")
def l7(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    layers = files.select(F.col("package").alias("member")).distinct().withColumn("ordinal", ((F.length("member") + F.ascii(F.right("member", F.lit(1)))) % 4).cast("long"))
    return findings.layering(imports, files, layers)


@query("l8_entry_bypass", """
SELECT a.package AS src, b.package AS dst, count(*) AS n, count(DISTINCT target_file_id) AS files FROM imports i
JOIN files a ON i.file_id = a.id AND a.role = 'source' JOIN files b ON i.target_file_id = b.id
WHERE NOT is_type_only AND a.package <> b.package AND b.package IN (SELECT package FROM files WHERE id % 10 = 3) AND b.id % 10 <> 3 GROUP BY 1, 2""")
def l8(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    return findings.bypasses(imports, files, files.where("id % 10 = 3").select("id"))  # a manifest's entry files


HISTORY = """h AS (SELECT c.*, f.file_id FROM commits c JOIN commit_files f USING (commit_id)),
m AS (SELECT max(made_at) AS t FROM commits)"""
PAIRS = """cf AS (SELECT *, count(*) OVER (PARTITION BY commit_id) AS n FROM commit_files),
own AS (SELECT file_id, count(*) AS n FROM commit_files GROUP BY 1),
co AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS together FROM cf x JOIN cf y ON x.commit_id = y.commit_id AND x.file_id < y.file_id WHERE x.n BETWEEN 2 AND 30 GROUP BY 1, 2),
pairs2 AS (SELECT a, b, together FROM co JOIN own p ON p.file_id = a JOIN own q ON q.file_id = b WHERE together >= {least} AND together >= {share} * least(p.n, q.n))"""


@query("g16_file_history", f"""WITH {HISTORY}
SELECT file_id, count(*) AS commits, CAST(sum(CASE WHEN made_at >= (SELECT t FROM m) - INTERVAL 90 DAY THEN 1 ELSE 0 END) AS BIGINT) AS recent, CAST(max(made_at) AS STRING) AS last_at,
count(DISTINCT author) AS authors, CAST(sum(CASE WHEN ai THEN 1 ELSE 0 END) AS BIGINT) AS ai_commits FROM h GROUP BY 1""")
def g16(spark, sf_dir):
    commits, files = facts(spark, sf_dir, "commits", "commit_files")
    out = history.file_history(commits, files, F.lit(commits.agg(F.max("made_at")).first()[0]))
    return out.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("g17_commit_counts", f"""WITH {HISTORY}, d AS (SELECT DISTINCT package, commit_id, made_at, ai FROM h JOIN files f ON f.id = h.file_id AND f.role = 'source')
SELECT package, count(*) AS commits, CAST(coalesce(sum(CASE WHEN made_at >= (SELECT t FROM m) - INTERVAL 90 DAY THEN 1 ELSE 0 END), 0) AS BIGINT) AS recent, CAST(coalesce(sum(CASE WHEN ai THEN 1 ELSE 0 END), 0) AS BIGINT) AS ai_commits FROM d GROUP BY 1""")
def g17(spark, sf_dir):
    commits, cf, files = facts(spark, sf_dir, "commits", "commit_files", "files")
    return history.module_commit_counts(commits, cf, files.where("role = 'source'").select(F.col("id").alias("file_id"), "package"))


@query("g18_co_changes", "WITH " + PAIRS.format(least=2, share=0.02) + " SELECT * FROM pairs2")
def g18(spark, sf_dir):
    return history.co_changes(*facts(spark, sf_dir, "commit_files"), min_together=2, min_share=0.02)


@query("l9_hidden_coupling", "WITH " + PAIRS.format(least=2, share=0.02) + f""", {EDGES}, n AS (SELECT count(*) AS c FROM commits),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
cand AS (SELECT a, b, together, together * c / (p.n * q.n) AS lift FROM pairs2 JOIN own p ON p.file_id = a JOIN own q ON q.file_id = b, n WHERE together * c / (p.n * q.n) >= 2),
near AS (SELECT k.a, k.b FROM cand k JOIN both_ways e ON e.src = k.a AND e.dst = k.b UNION SELECT k.a, k.b FROM cand k JOIN both_ways e ON e.src = k.a JOIN both_ways g ON g.src = e.dst AND g.dst = k.b)
SELECT k.a, k.b, k.together, round(k.lift, 6) AS lift FROM cand k LEFT JOIN near w ON w.a = k.a AND w.b = k.b WHERE w.a IS NULL""")
def l9(spark, sf_dir):
    cf, commits, imports = facts(spark, sf_dir, "commit_files", "commits", "imports")
    own = cf.groupBy("file_id").agg(F.count("*").alias("commits"))
    pairs = history.co_changes(cf, min_together=2, min_share=0.02)
    return findings.coupling(pairs, own, commits.count(), link.import_edges(imports), min_together=2).withColumn("lift", F.round("lift", 6))


def _bfs_sql(seeds: str, step: str, depth: int) -> str:
    return f"""walk(seed, node, depth) AS (SELECT seed, node, 0 FROM ({seeds}) UNION SELECT w.seed, e.b, w.depth + 1 FROM walk w JOIN ({step}) e ON e.a = w.node WHERE w.depth < {depth}),
best AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2)"""


@query("k21_io_reach", f"WITH {CALLS}, " + _bfs_sql("SELECT kind AS seed, symbol_id AS node FROM io_sites", "SELECT dst AS a, src AS b FROM call_edges WHERE confidence IN ('exact', 'likely')", 10) + " SELECT node AS symbol_id, seed AS kind, CAST(depth AS INT) AS depth FROM best", True)
def k21(spark, sf_dir):
    calls, sites = facts(spark, sf_dir, "calls", "io_sites")
    return reach.io_reach(link.call_edges(calls), sites)


@query("k22_entry_reach", f"WITH {CALLS}, " + _bfs_sql("SELECT id AS seed, id AS node FROM symbols WHERE name = 'fn_1'", "SELECT src AS a, dst AS b FROM call_edges WHERE confidence IN ('exact', 'likely')", 4)
       + """ SELECT seed AS entry_id, least(count(*), 999) AS reach_symbols, count(DISTINCT CASE WHEN s.file_id <> h.file_id THEN s.file_id END) AS reach_files
FROM best JOIN symbols s ON s.id = node JOIN symbols h ON h.id = seed WHERE depth > 0 GROUP BY 1""", True)
def k22(spark, sf_dir):
    calls, symbols = facts(spark, sf_dir, "calls", "symbols")
    entries = symbols.where("name = 'fn_1'").select(F.col("id").alias("entry_id"), F.col("id").alias("symbol_id"))
    return reach.entry_reach(link.call_edges(calls), entries, symbols, 4)


@query("k26_test_coverage", f"WITH {CALLS}, " + _bfs_sql("SELECT case_id AS seed, case_id AS node FROM cases", "SELECT src AS a, dst AS b FROM call_edges", 4)
       + """, hit AS (SELECT b.node, b.seed, b.depth, row_number() OVER (PARTITION BY b.node ORDER BY b.depth, b.seed) AS k FROM best b JOIN symbols s ON s.id = b.node JOIN files f ON f.id = s.file_id AND f.role = 'source' WHERE b.depth > 0)
SELECT node AS symbol_id, count(*) AS tests, count(*) FILTER (depth = 1) AS direct, string_agg(CAST(seed AS STRING), ',' ORDER BY k) FILTER (k <= 6) AS nearest FROM hit GROUP BY 1""", True)
def k26(spark, sf_dir):
    calls, cases, symbols, files = facts(spark, sf_dir, "calls", "cases", "symbols", "files")
    sources = symbols.join(files.where("role = 'source'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return reach.test_coverage(link.call_edges(calls), cases, sources)


@query("k37_change_impact", f"WITH {CALLS}, " + _bfs_sql("SELECT id AS seed, id AS node FROM symbols WHERE name = 'fn_2'", "SELECT dst AS a, src AS b FROM call_edges", 6)
       + " SELECT node AS symbol_id, CAST(min(depth) AS INT) AS depth, count(*) AS changes FROM best WHERE depth > 0 GROUP BY 1", True)
def k37(spark, sf_dir):
    calls, symbols = facts(spark, sf_dir, "calls", "symbols")
    return reach.impact(link.call_edges(calls), symbols.where("name = 'fn_2'").select(F.col("id").alias("symbol_id")))


@query("k34_call_graph", f"""WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM edges),
walk(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT r.dst, w.depth + 1 FROM walk w JOIN r ON r.src = w.node AND r.k <= 5 WHERE w.depth < 3),
best AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)
SELECT CAST(b.depth + 1 AS INT) AS level, r.src, r.dst, r.weight FROM best b JOIN r ON r.src = b.node AND r.k <= 5 WHERE b.depth < 3""", True)
def k34(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    return graph.call_graph(link.import_edges(imports), files.where("id = 1").select(F.col("id").alias("node")), 3, 5)


@query("k35_shortest_import_path", f"""WITH {EDGES},
goal AS (SELECT id AS node FROM files WHERE package = 'brand_2' AND role = 'test'),
reached AS (SELECT id AS node, 0 AS hop FROM files WHERE package = 'brand_1' AND role = 'config' UNION SELECT e.dst, r.hop + 1 FROM reached r JOIN edges e ON e.src = r.node WHERE r.hop < 8),
level AS (SELECT node, min(hop) AS hop FROM reached GROUP BY 1),
path AS (SELECT * FROM (SELECT node, hop FROM level SEMI JOIN goal USING (node) ORDER BY hop, node LIMIT 1)
  UNION SELECT parent, parent_hop FROM (SELECT l.node AS parent, l.hop AS parent_hop, row_number() OVER (ORDER BY l.node) AS k FROM path p JOIN edges e ON e.dst = p.node JOIN level l ON l.node = e.src AND l.hop = p.hop - 1) WHERE k = 1)
SELECT CAST(hop AS INT) AS hop, node FROM path""", True)
def k35(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    a = files.where("package = 'brand_1' and role = 'config'").select(F.col("id").alias("node"))
    b = files.where("package = 'brand_2' and role = 'test'").select(F.col("id").alias("node"))
    return graph.shortest_path(link.import_edges(imports), a, b)


@query("m1_file_diff", """
WITH base AS (SELECT path, hash FROM files WHERE id % 7 <> 0), head AS (SELECT CASE WHEN id % 11 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN id % 13 = 0 THEN md5(hash) ELSE hash END AS hash FROM files WHERE id % 5 <> 0),
j AS (SELECT coalesce(b.path, h.path) AS path, b.hash AS h0, h.hash AS h1 FROM base b FULL JOIN head h ON b.path = h.path),
gone AS (SELECT h0 AS hash, path AS old_path, row_number() OVER (PARTITION BY h0 ORDER BY path) AS k FROM j WHERE h1 IS NULL),
new AS (SELECT h1 AS hash, path, row_number() OVER (PARTITION BY h1 ORDER BY path) AS k FROM j WHERE h0 IS NULL)
SELECT coalesce(n.path, g.old_path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN g.old_path IS NULL THEN 'added' ELSE 'moved' END AS status, CASE WHEN n.path IS NOT NULL THEN g.old_path END AS old_path
FROM new n FULL JOIN gone g ON n.hash = g.hash AND n.k = g.k UNION ALL SELECT path, 'modified', NULL FROM j WHERE h0 <> h1""")
def m1(spark, sf_dir):
    files = facts(spark, sf_dir, "files")[0]
    base = files.where("id % 7 <> 0").select("path", "hash")
    head = files.where("id % 5 <> 0").select(F.expr("case when id % 11 = 0 then 'moved/' || path else path end").alias("path"), F.expr("case when id % 13 = 0 then md5(hash) else hash end").alias("hash"))
    return diff.diff_files(base, head)


SNAPSHOTS = """cut AS (SELECT DATE '1999-01-01' AS t),
b AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate < (SELECT t FROM cut) GROUP BY 1, 2),
h AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"""


@query("m2_symbol_pairs", f"""WITH {SNAPSHOTS}
SELECT CAST(coalesce(b.p, h.p) AS STRING) AS path, CAST(coalesce(b.s, h.s) AS STRING) AS name, CASE WHEN b.p IS NULL THEN 'added' WHEN h.p IS NULL THEN 'removed' WHEN b.q <> h.q THEN 'modified' ELSE 'same' END AS status
FROM b FULL JOIN h ON b.p = h.p AND b.s = h.s""")
def m2(spark, sf_dir):
    facts(spark, sf_dir)
    raw = spark.table("lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("name"), "l_quantity", "l_shipdate")

    def snapshot(rows):
        out = rows.groupBy("path", "name").agg(F.sum("l_quantity").cast("string").alias("hash"))
        return out.select("path", "name", F.lit(None).cast("string").alias("container"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.xxhash64("path", "name").alias("id"), "hash")

    pairs = diff.pair_symbols(snapshot(raw.where("l_shipdate < date '1999-01-01'")), snapshot(raw))
    return pairs.select("path", "name", "status")


@query("m5_dependency_diff", """
WITH w AS (SELECT a.package AS src, b.package AS dst, count(*) FILTER (s.l_shipdate < DATE '1999-01-01') AS before, count(*) AS after FROM sites s JOIN files a ON s.l_partkey = a.id JOIN files b ON s.next_part = b.id WHERE a.package <> b.package GROUP BY 1, 2)
SELECT src, dst, CASE WHEN before = 0 THEN 'added' ELSE 'modified' END AS status, before, after FROM w WHERE before <> after""")
def m5(spark, sf_dir):
    sites, files = facts(spark, sf_dir, "sites", "files")
    own = files.select("id", "package")
    pairs = sites.join(own.toDF("l_partkey", "src"), "l_partkey").join(own.toDF("next_part", "dst"), "next_part").where("src <> dst")
    weigh = lambda df: df.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return diff.diff_weights(weigh(pairs.where("l_shipdate < date '1999-01-01'")), weigh(pairs), ["src", "dst"])


@query("m7_finding_diff", """
WITH o AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < DATE '1999-01-01' AND l_quantity > 40), n AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= DATE '1999-01-01' AND l_quantity > 40)
SELECT k AS group_key, 'added' AS status FROM n WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'removed' FROM o WHERE k NOT IN (SELECT k FROM n)""")
def m7(spark, sf_dir):
    facts(spark, sf_dir)
    big = spark.table("lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("group_key"), "l_shipdate")
    return diff.diff_keys(big.where("l_shipdate < date '1999-01-01'"), big.where("l_shipdate >= date '1999-01-01'"), ["group_key"])


@query("n9_search_bm25", """
WITH raw_tokens AS (SELECT p_partkey AS ref, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS token FROM part),
t AS (SELECT ref, token, count(*) OVER (PARTITION BY ref) AS length FROM raw_tokens WHERE token <> ''),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT ref, length FROM t)),
hits AS (SELECT ref, length, term, count(*) AS tf FROM t JOIN (SELECT unnest(['red', 'wid']) AS term) q ON starts_with(t.token, q.term) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1)
SELECT ref, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
FROM hits JOIN df USING (term) CROSS JOIN stats GROUP BY ref HAVING count(*) = 2 ORDER BY score DESC, ref LIMIT 30""")
def n9(spark, sf_dir):
    facts(spark, sf_dir)
    entries = spark.table("part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("label"), F.col("p_type").alias("detail"))
    return search.search(search.build_index(entries), "red wid")


@query("n9_search_matches", """
WITH t AS (SELECT p_partkey AS ref, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS token FROM part)
SELECT ref FROM t GROUP BY 1 HAVING bool_or(starts_with(token, 'red')) AND bool_or(starts_with(token, 'wid'))""")
def n9_matches(spark, sf_dir):
    facts(spark, sf_dir)
    entries = spark.table("part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("label"), F.col("p_type").alias("detail"))
    return search.search(search.build_index(entries), "red wid", limit=2**31 - 1).select("ref")


@query("n31_code_search", """
WITH l AS (SELECT doc_id AS ref, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY line) AS k FROM l WHERE regexp_matches(text, '[Ll]icensed? under'))
SELECT ref, CAST(line AS INT) AS line, text FROM m WHERE k <= 6 ORDER BY ref, line LIMIT 60""")
def n31(spark, sf_dir):
    facts(spark, sf_dir)
    return search.search_lines(spark.table("documents").select(F.col("doc_id").alias("ref"), "text"), "[Ll]icensed? under")


@query("k23_route_segments", r"""
SELECT page_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda p: p <> ''),
  lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN '*' ELSE p END), '/') AS route FROM pages""")
def k23(spark, sf_dir):
    facts(spark, sf_dir)
    return spark.table("pages").select("page_id", F.array_join(link.route_segments(F.col("url")), "/").alias("route"))


@query("k25_http_links")
def k25(spark, sf_dir):
    facts(spark, sf_dir)
    pages = spark.table("pages")
    routes = pages.select(link.route_segments(F.col("url")).alias("segments")).distinct().select(F.xxhash64(F.array_join("segments", "/")).alias("route_id"), "segments")
    return link.http_links(pages.select(F.col("page_id").alias("request_id"), link.route_segments(F.col("url")).alias("segments")), routes)


@query("a2_content_hash", "SELECT doc_id, substr(sha1(text), 1, 16) AS hash FROM documents")
def a2(spark, sf_dir):
    facts(spark, sf_dir)
    return spark.table("documents").select("doc_id", F.substring(F.sha1("text"), 1, 16).alias("hash"))


@query("d11_changed_files", """
WITH old AS (SELECT doc_id, sha1(text) AS hash FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, sha1(CASE WHEN doc_id % 4 = 0 THEN text || ' ' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0)
SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM new n LEFT JOIN old o USING (doc_id) WHERE o.hash IS NULL OR o.hash <> n.hash
UNION ALL SELECT doc_id, 'deleted' FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def d11(spark, sf_dir):
    facts(spark, sf_dir)
    docs = spark.table("documents")
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha1("text").alias("was"))
    new = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha1(F.expr("case when doc_id % 4 = 0 then text || ' ' else text end")).alias("hash"))
    both = old.join(new, "doc_id", "full_outer").where("was is null or hash is null or was <> hash")
    return both.select("doc_id", F.when(F.col("hash").isNull(), "deleted").when(F.col("was").isNull(), "new").otherwise("changed").alias("state"))


@query("s_context_budget", """
WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, count(*) AS turns, CAST(max(used) AS BIGINT) AS chars FROM r WHERE used <= 3000 GROUP BY 1""")
def s_budget(spark, sf_dir):
    from pyspark.sql import Window

    facts(spark, sf_dir)
    used = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return spark.table("conversations").select("conv_id", used.alias("used")).where("used <= 3000").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("used").alias("chars"))


@query("s_stale_summaries", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def s_stale(spark, sf_dir):
    facts(spark, sf_dir)
    both = spark.table("documents").select("doc_id").join(spark.table("labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 0, "stale").otherwise("fresh")
    return both.select("doc_id", state.alias("state"))


@query("qs2_debounce_sessions", """
WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(min(ts) AS STRING)[1:19] AS started, count(*) AS changes FROM s GROUP BY user_id, k""")
def qs2(spark, sf_dir):
    from graphloom.streaming.live import debounce

    facts(spark, sf_dir)
    out = debounce(spark.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), "2 hours")
    return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "changes")


@query("g20_boundary_usage", """
SELECT i.package, c.target_symbol_id AS symbol_id, count(*) AS calls, count(DISTINCT coalesce(c.caller_symbol_id, -c.file_id)) AS callers
FROM calls c JOIN symbols s ON s.id = c.target_symbol_id JOIN files i ON i.id = s.file_id JOIN files o ON o.id = c.file_id AND o.package <> i.package GROUP BY 1, 2""")
def g20(spark, sf_dir):
    calls, symbols, files = facts(spark, sf_dir, "calls", "symbols", "files")
    return boundary.module_usage(calls, symbols, files)


@query("g21_module_api", """
WITH u AS (SELECT b.package, s.id AS symbol_id, count(DISTINCT c.caller_symbol_id) AS callers FROM calls c JOIN files a ON a.id = c.file_id JOIN symbols s ON s.id = c.target_symbol_id
  JOIN files b ON b.id = s.file_id WHERE a.package <> b.package GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY package ORDER BY callers DESC, symbol_id) AS INT) AS rank FROM u) WHERE rank <= 12""")
def g21(spark, sf_dir):
    return boundary.module_api(*facts(spark, sf_dir, "calls", "symbols", "files"))


@query("g27_module_dependencies", f"""WITH {EDGES}, p AS (SELECT a.package AS src, b.package AS dst, e.weight, a.path || '>' || b.path AS s, row_number() OVER (PARTITION BY a.package, b.package ORDER BY e.weight DESC, a.path, b.path) AS k
  FROM edges e JOIN files a ON a.id = e.src JOIN files b ON b.id = e.dst WHERE a.package <> b.package)
SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight, string_agg(s, ';' ORDER BY k) FILTER (k <= 3) AS samples FROM p GROUP BY 1, 2""")
def g27(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    return boundary.module_dependencies(link.import_edges(imports), files)


@query("k30_public_api_closure", """
WITH api(file_id) AS (SELECT id FROM files WHERE role = 'config' UNION SELECT i.target_file_id FROM api JOIN imports i ON i.file_id = api.file_id WHERE i.is_type_only AND i.target_file_id IS NOT NULL) SELECT file_id FROM api""", True)
def k30(spark, sf_dir):
    imports, files = facts(spark, sf_dir, "imports", "files")
    entries = files.where("role = 'config'").select(F.col("id").alias("file_id"))  # what manifests name
    return boundary.public_api_files(entries, imports.where("is_type_only and target_file_id is not null"))


@query("n21_forwarders", f"""WITH {CALLS}, one AS (SELECT src, min(dst) AS dst FROM call_edges GROUP BY 1 HAVING count(*) = 1)
SELECT o.src AS symbol_id, o.dst AS target_id FROM one o JOIN symbols s ON s.id = o.src WHERE s.complexity <= 10 AND s.end_line - s.start_line < 90""")
def n21(spark, sf_dir):
    calls, symbols = facts(spark, sf_dir, "calls", "symbols")
    return boundary.forwarders(link.call_edges(calls), symbols, max_lines=90, max_complexity=10)


@query("m4_behaviour_diff", """
WITH b AS (SELECT DISTINCT caller_symbol_id AS s, callee_name AS c FROM calls WHERE callee_name IS NOT NULL AND line <= 5), h AS (SELECT DISTINCT caller_symbol_id AS s, callee_name AS c FROM calls WHERE callee_name IS NOT NULL AND line >= 3),
j AS (SELECT coalesce(b.s, h.s) AS symbol_id, b.s IS NULL AS gained, h.s IS NULL AS lost FROM b FULL JOIN h ON b.s = h.s AND b.c = h.c)
SELECT symbol_id, count(*) FILTER (gained) AS added, count(*) FILTER (lost) AS removed FROM j WHERE gained OR lost GROUP BY 1""")
def m4(spark, sf_dir):
    calls = facts(spark, sf_dir, "calls")[0].where("callee_name is not null").select(F.col("caller_symbol_id").alias("symbol_id"), F.col("callee_name").alias("callee"), "line")
    return boundary.behaviour_diff(calls.where("line <= 5"), calls.where("line >= 3"))


@query("e14_lookup", "SELECT CAST(5 AS INT) AS tier, 'symbol' AS kind, CAST(id AS STRING) AS ref FROM symbols WHERE name = 'fn_3' ORDER BY ref LIMIT 12")
def e14(spark, sf_dir):
    return boundary.lookup("fn_3", *facts(spark, sf_dir, "packages", "files", "symbols"))


@query("k27_sql_lineage", """
SELECT id, name, bool_or(write) AS write FROM (SELECT p_partkey AS id, lower(p_type) AS name, true AS write FROM part
UNION ALL SELECT p_partkey, lower(replace(p_brand, '#', '_')), false FROM part UNION ALL SELECT p_partkey, lower(split_part(p_name, ' ', 2)), false FROM part) GROUP BY 1, 2""")
def k27(spark, sf_dir):
    facts(spark, sf_dir)
    literal = F.expr("'INSERT INTO ' || p_type || ' SELECT * FROM ' || replace(p_brand, '#', '_') || ' b JOIN ' || split_part(p_name, ' ', 2) || ' USING (id)'")
    return search.sql_tables(spark.table("part").select(F.col("p_partkey").alias("id"), literal.alias("literal")))


@query("n11_reveal_chain", """
SELECT id, level, CAST(depth AS INT) AS depth FROM (SELECT id, package AS level, 1 AS depth FROM files UNION ALL SELECT id, dir_path, 2 FROM files UNION ALL SELECT id, path, 3 FROM files)""")
def n11(spark, sf_dir):
    files = facts(spark, sf_dir, "files")[0]
    each = files.select("id", F.posexplode(paths.ancestors(F.col("path"), include_self=True)).alias("d", "level"))
    return each.select("id", "level", (F.col("d") + 1).alias("depth"))


@query("g14_finding_summary", """
WITH d AS (SELECT shape, CASE WHEN min(name) = max(name) THEN 'high' ELSE 'low' END AS severity FROM symbols WHERE complexity >= 2 AND end_line - start_line + 1 >= 3 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT file_id) >= 2),
o AS (SELECT id, CASE WHEN complexity >= 50 OR end_line - start_line + 1 >= 400 THEN 'medium' ELSE 'low' END AS severity FROM symbols WHERE kind IN ('function', 'method') AND (complexity >= 25 OR (end_line - start_line + 1 >= 200 AND complexity >= 10))),
f AS (SELECT 'duplicate' AS kind, severity FROM d UNION ALL SELECT 'oversized', severity FROM o) SELECT kind, severity, count(*) AS groups FROM f GROUP BY 1, 2""")
def g14(spark, sf_dir):
    symbols = facts(spark, sf_dir, "symbols")[0]
    kinds = findings.duplicates(symbols).select(F.lit("duplicate").alias("kind"), "severity").unionByName(findings.oversized_functions(symbols).select(F.lit("oversized").alias("kind"), "severity"))
    return kinds.groupBy("kind", "severity").agg(F.count("*").alias("groups"))


@query("h5_latest_summary", """
SELECT o_custkey AS target, max_by(o_orderkey, epoch_ms(o_orderdate) // 1000 * 10000000 + o_orderkey) AS latest FROM orders GROUP BY 1""")
def h5(spark, sf_dir):
    facts(spark, sf_dir)
    return spark.table("orders").groupBy(F.col("o_custkey").alias("target")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("c1_resolve_modules", r"""
WITH i AS (SELECT *, string_split(path, '/') AS parts, len(string_split(specifier, '../')) - 1 AS ups FROM module_imports),
ends AS (SELECT unnest(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.vue', '.svelte', '.astro', '.d.ts']) AS e, unnest(range(12)) AS k),
bases AS (
  SELECT id, 0 AS pos, ltrim(array_to_string(parts[1:len(parts) - 1 - ups], '/') || '/' || replace(specifier, '../', ''), '/') AS base FROM i WHERE specifier LIKE '../%'
  UNION ALL SELECT id, 0, CASE WHEN CAST(substr(parts[1], 7) AS BIGINT) % 3 = 0 THEN 'brand_1' ELSE parts[1] END || '/src/' || substr(specifier, 3) FROM i WHERE specifier LIKE '~/%'
  UNION ALL SELECT id, k, split_part(specifier, '/', 2) || '/' || s || array_to_string(string_split(specifier, '/')[3:], '/') FROM i, (SELECT unnest(['src/', '', 'lib/', 'dist/']) AS s, unnest(range(4)) AS k) WHERE specifier LIKE '@loom/%'),
tried AS (
  SELECT id, pos, 0 AS rank, base AS path FROM bases
  UNION ALL SELECT id, pos, 1 + k, replace(base, '.js', '') || e FROM bases, (SELECT unnest(['.ts', '.tsx', '.mts', '.cts', '.d.ts']) AS e, unnest(range(5)) AS k) WHERE base LIKE '%.js'
  UNION ALL SELECT id, pos, 10 + k, base || e FROM bases, ends WHERE base NOT LIKE '%.js'
  UNION ALL SELECT id, pos, 30 + k, base || '/index' || e FROM bases, ends
  UNION ALL SELECT id, 0, 0, parts[1] || '/src/' || parts[3] || '/' || substr(specifier, 8) || e FROM i, (SELECT unnest(['.rs', '/mod.rs']) AS e) WHERE specifier LIKE 'super::%'
  UNION ALL SELECT id, 0, 0, CASE WHEN specifier LIKE 'crate::%' THEN parts[1] ELSE split_part(specifier, '::', 1) END || '/src/' || split_part(specifier, '::', 2) || '/' || split_part(specifier, '::', 3) || e
    FROM i, (SELECT unnest(['.rs', '/mod.rs']) AS e) WHERE specifier LIKE 'crate::%' OR specifier LIKE 'brand_%::%'),
hits AS (SELECT t.id, min_by(t.path, pos * 100 + rank) AS target FROM tried t JOIN module_files f ON f.path = t.path GROUP BY 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM module_files),
found AS (SELECT i.id, i.specifier, h.target, d.dir, CASE WHEN specifier LIKE 'library%' OR specifier LIKE 'serde%' OR specifier LIKE 'std%' THEN regexp_extract(specifier, '^[^/:]*') WHEN specifier = 'fmt/x' THEN specifier
    WHEN specifier LIKE 'github%' THEN 'github.com/u/r' WHEN specifier LIKE '~/%' AND h.target IS NULL THEN '~' END AS outside
  FROM i LEFT JOIN hits h ON h.id = i.id AND i.language <> 'go' LEFT JOIN dirs d ON i.language = 'go' AND 'example.com/' || d.dir = i.specifier)
SELECT id, target AS target_path, dir AS target_dir, outside AS external_name, CASE WHEN coalesce(target, dir) IS NOT NULL THEN 'exact' WHEN outside IS NOT NULL THEN 'external' ELSE 'unresolved' END AS confidence FROM found""")
def c1_modules(spark, sf_dir):
    imports, files, packages, configs = facts(spark, sf_dir, "module_imports", "module_files", "module_packages", "module_configs")
    packages = packages.withColumn("entries", F.array().cast("array<string>"))
    return modules.resolve_modules(imports, files, packages, modules.path_mappings(modules.script_configs(configs)))


CUT = "date '1999-01-01'"


def changed_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The symbols of source files that differ between two snapshots, the certain calls between symbols and the sites."""
    calls, files, symbols, sites = facts(spark, sf_dir, "calls", "files", "symbols", "sites", once=("sites",))
    before = F.col("l_shipdate") < F.expr(CUT)
    raw = spark.table("lineitem").groupBy((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("id"))
    rows = raw.agg(F.sum("l_quantity").alias("q1"), F.sum(F.when(before, F.col("l_quantity"))).alias("q0"), F.count("*").alias("n1"), F.count(F.when(before, 1)).alias("n0"))
    rows = rows.where("q0 is null or q0 <> q1").select("id", F.when(F.col("q0").isNull(), "added").otherwise("modified").alias("status"), "n0", "n1")
    edges = link.call_edges(calls).where("confidence in ('exact', 'likely')").select("src", "dst")
    tested = calls.join(files.where("role = 'test'").select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy(F.col("target_symbol_id").alias("id")).agg(F.count_distinct("caller_symbol_id").alias("tests"))
    source = files.where("role = 'source'").select(F.col("id").alias("file_id"), "path")
    changes = symbols.join(source, "file_id").join(rows, "id").join(tested, "id", "left")
    changes = changes.select("id", "path", "name", "container", "kind", "exported", "complexity", "status", F.when(F.col("n0") > 0, F.col("complexity") - (F.col("n1") - F.col("n0")) * 9).alias("complexity_before"),
                             (F.col("n1") - F.col("n0") > 1).alias("signature_changed"), F.lit(True).alias("shape_changed"), F.coalesce("tests", F.lit(0)).alias("tests"))
    return changes, edges, sites


@query("k38_change_clusters")
def k38(spark, sf_dir):
    changes, edges, _ = changed_symbols(spark, sf_dir)
    return clusters.change_clusters(*graph.once(changes, edges))


@query("m9_cluster_risk")
def m9(spark, sf_dir):
    changes, edges, sites = changed_symbols(spark, sf_dir)
    changes, edges = graph.once(changes, edges)
    caller, before = (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("id"), F.col("l_shipdate") < F.expr(CUT)
    made = sites.where("next_part is not null").groupBy(caller, (F.col("next_part") * 1000000 + F.col("next_supp")).alias("callee")).agg(F.bool_or(before).alias("old"))
    io = spark.table("lineitem").where("l_quantity >= 49").groupBy(caller).agg((~F.bool_or(before)).cast("long").alias("io_added"))
    behaviour = made.groupBy("id").agg(F.count_if(~F.col("old")).alias("calls_added")).join(io, "id", "full")
    files, symbols = facts(spark, sf_dir, "files", "symbols")
    entries = symbols.where("exported").join(files.where("role = 'config'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    reached = graph.bfs(edges, entries.select(F.col("id").alias("seed"), F.col("id").alias("node")), 6)
    grouped, behaviour = graph.once(clusters.change_clusters(changes, edges), behaviour)
    return clusters.cluster_risk(grouped, changes, behaviour, reached.select(F.col("seed").alias("entry_id"), F.col("node").alias("symbol_id")))


@query("n9_phrase_search", r"""
WITH entry_texts AS (SELECT doc_id AS ref, unnest([source, text]) AS t, unnest([0, 1]) AS field FROM documents),
w AS (SELECT ref, field, [x FOR x IN regexp_split_to_array(strip_accents(lower(coalesce(t, ''))), '[^\p{L}\p{N}]+') IF x <> ''] AS words FROM entry_texts),
p AS (SELECT ref, field, unnest(words) AS token, unnest(range(len(words))) AS position FROM w),
lengths AS (SELECT ref, count(*) AS length FROM p GROUP BY 1), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
found AS (SELECT a.ref, 0 AS term, count(*) AS tf FROM p a JOIN p b ON a.ref = b.ref AND a.field = b.field AND b.position = a.position + 1 WHERE a.token = 'por' AND starts_with(b.token, 'la') GROUP BY 1
  UNION ALL SELECT ref, 1, count(*) FROM p WHERE starts_with(token, 'cion') GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM found GROUP BY 1)
SELECT ref, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM found JOIN df USING (term) JOIN lengths USING (ref) CROSS JOIN stats GROUP BY ref HAVING count(*) = 2""")
def n9_phrases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ref"), F.col("source").alias("label"), F.col("text").alias("detail"))
    return search.search_phrases(docs, search.build_positions(docs), "Por-la ción")
