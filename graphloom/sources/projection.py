"""The code-graph facts as projections of the given relational tables.

One SQL text a fact, in the dialect that Spark and DuckDB share, so that a query and its twin read the same facts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.graph import kept

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

FACTS = {
    "packages": "SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS name FROM part",
    "files": """
        SELECT p_partkey AS id, lower(replace(p_brand, '#', '_')) AS package,
          lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) AS dir_path,
          lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) || '.ts' AS path,
          CASE p_size % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'rust' END AS language,
          CASE WHEN p_size % 10 = 0 THEN 'test' WHEN p_size % 10 = 1 THEN 'config' WHEN p_size % 10 = 2 THEN 'asset' ELSE 'source' END AS role,
          CAST(p_size * 25 AS BIGINT) AS loc, CAST(p_size % 13 + p_size % 7 * 10 AS BIGINT) AS complexity,
          md5(p_name || CAST(p_size AS STRING)) AS hash
        FROM part""",
    "sites": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate,
          lead(l_partkey) OVER w AS next_part, lead(l_suppkey) OVER w AS next_supp, CAST(row_number() OVER w AS BIGINT) AS pos
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)""",
    "symbols": """
        SELECT l_partkey * 1000000 + l_suppkey AS id, l_partkey AS file_id, 'fn_' || CAST(l_suppkey AS STRING) AS name,
          CASE l_suppkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END AS kind,
          CASE WHEN l_suppkey % 5 = 1 THEN 'Owner_' || CAST(l_suppkey % 7 AS STRING) END AS container,
          l_suppkey % 3 <> 0 AS exported, CAST(l_suppkey % 50 * 10 + 1 AS BIGINT) AS start_line,
          CAST(l_suppkey % 50 * 10 + count(*) * 80 + l_partkey % 40 AS BIGINT) AS end_line, CAST(count(*) * 9 + l_partkey % 11 AS BIGINT) AS complexity,
          'shape_' || CAST((l_partkey * 31 + l_suppkey) % 997 AS STRING) AS shape, md5(CAST(sum(l_quantity) AS STRING)) AS hash
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "imports": """
        SELECT l_orderkey * 100 + pos AS id, l_partkey AS file_id, next_part AS target_file_id, l_returnflag = 'N' AS is_type_only,
          CASE WHEN next_part IS NULL THEN 'external' WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND pos = 1 THEN 'unresolved' ELSE 'exact' END AS confidence
        FROM sites""",
    "calls": """
        SELECT l_orderkey * 100 + pos AS id, l_partkey AS file_id, l_partkey * 1000000 + l_suppkey AS caller_symbol_id,
          next_part * 1000000 + next_supp AS target_symbol_id, l_linenumber AS line, pos AS end_offset,
          CASE WHEN l_linenumber % 3 = 0 THEN 'method' ELSE 'call' END AS call_kind,
          'fn_' || CAST(next_supp AS STRING) AS callee_name,
          CASE WHEN next_part IS NULL THEN 'unresolved' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'ambiguous' WHEN l_returnflag = 'A' THEN 'likely' ELSE 'exact' END AS resolution
        FROM sites""",
    "bindings": """
        SELECT l_orderkey * 100 + pos AS import_id, l_partkey AS file_id, 'fn_' || CAST(next_supp AS STRING) AS local,
          CASE WHEN l_linestatus = 'F' AND pos = 2 THEN NULL ELSE next_part END AS target_file_id, 'fn_' || CAST(next_supp AS STRING) AS imported,
          CASE WHEN l_linestatus = 'F' AND pos = 2 THEN 'library_' || CAST(next_supp AS STRING) END AS external_name
        FROM sites WHERE next_part IS NOT NULL AND l_returnflag <> 'R'""",
    "stars": "SELECT DISTINCT l_partkey AS file_id, next_part AS target_file_id FROM sites WHERE pos = 6 AND l_returnflag = 'R' AND next_part IS NOT NULL",
    "types": """
        SELECT DISTINCT file_id * 10 + CAST(substr(container, 7) AS BIGINT) AS id, file_id, container AS name,
          CASE CAST(substr(container, 7) AS BIGINT) % 3 WHEN 2 THEN 'interface' ELSE 'class' END AS kind
        FROM symbols WHERE container IS NOT NULL""",
    "parents": """
        SELECT type_id, CAST(k - 1 AS INT) AS ordinal, CASE WHEN parent_id % 11 <> 0 THEN parent_id END AS parent_id,
          CASE WHEN parent_id % 11 = 0 THEN 'library_' || CAST(parent_id % 7 AS STRING) END AS external_name
        FROM (SELECT type_id, parent_id, row_number() OVER (PARTITION BY type_id ORDER BY parent_id) AS k FROM (
          SELECT DISTINCT a.id AS type_id, b.id AS parent_id FROM sites s JOIN types a ON a.id = s.l_partkey * 10 + s.l_suppkey % 7
            JOIN types b ON b.id = s.next_part * 10 + s.next_supp % 7) pairs) ranked WHERE k <= 2""",
    "method_calls": """
        SELECT l_orderkey * 100 + pos AS id, l_partkey AS file_id, l_partkey * 1000000 + l_suppkey AS caller_symbol_id, 'fn_' || CAST(next_supp AS STRING) AS callee_name,
          CASE l_orderkey % 5 WHEN 0 THEN 'self' WHEN 1 THEN 'super' WHEN 2 THEN 'Owner_' || CAST(next_supp % 7 AS STRING) WHEN 3 THEN 'lib_' || CAST(next_supp % 3 AS STRING) ELSE 'value.at' END AS receiver
        FROM sites WHERE next_part IS NOT NULL""",
    "owner_bindings": """
        SELECT l_orderkey * 100 + pos AS import_id, l_partkey AS file_id,
          CASE WHEN pos % 3 = 0 THEN 'lib_' || CAST(next_supp % 3 AS STRING) ELSE 'Owner_' || CAST(next_supp % 7 AS STRING) END AS local,
          CASE WHEN pos % 3 <> 0 OR l_returnflag = 'A' THEN next_part END AS target_file_id,
          CASE WHEN pos % 3 = 0 THEN '*' ELSE 'Owner_' || CAST((next_supp + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) % 7 AS STRING) END AS imported,
          CASE WHEN pos % 3 = 0 AND l_returnflag <> 'A' THEN 'library_' || CAST(next_supp AS STRING) END AS external_name
        FROM sites WHERE next_part IS NOT NULL""",
    "ignore_files": """
        SELECT DISTINCT 1 AS layer, package AS scope, '*' || CAST(CAST(substr(package, 7) AS BIGINT) % 10 AS STRING) || '.ts' || chr(10) || '!*5.ts' AS text FROM files
        UNION ALL SELECT DISTINCT 0, '', 'promo*/' || chr(10) || '*3.ts' FROM files
        UNION ALL SELECT DISTINCT 3, '', '!*00.ts' FROM files""",
    "module_files": """
        SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'vue' WHEN 2 THEN 'go' ELSE 'rust' END AS language,
          lower(replace(p_brand, '#', '_')) AS package, lower(replace(p_type, ' ', '_')) AS module,
          lower(replace(p_brand, '#', '_')) || '/src/' || lower(replace(p_type, ' ', '_')) || '/m' || CAST(p_partkey AS STRING) ||
          CASE p_size % 4 WHEN 0 THEN CASE p_partkey % 4 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.d.ts' ELSE '.ts' END WHEN 1 THEN '.vue' WHEN 2 THEN '/g.go'
            ELSE CASE p_partkey % 2 WHEN 0 THEN '/mod.rs' ELSE '.rs' END END AS path
        FROM part""",
    "module_packages": """
        SELECT '@loom/' || name AS name, name AS dir, 'npm' AS manager FROM packages UNION ALL SELECT 'example.com/' || name, name, 'go' FROM packages
        UNION ALL SELECT replace(name, '_', '-'), name, 'cargo' FROM packages""",
    "module_configs": """
        SELECT name || '/tsconfig.json' AS path, CASE WHEN CAST(substr(name, 7) AS BIGINT) % 3 = 0 THEN '{"extends": "../base", /* no paths */}'
          ELSE '{"compilerOptions": {"baseUrl": "./src", "paths": {"~/*": ["*"],}}}' END AS text FROM packages
        UNION ALL SELECT 'base.json', '{"compilerOptions": {"paths": {"~/*": ["none/*", "brand_1/src/*"]}}} // shared'""",
    "module_imports": """
        SELECT l_orderkey * 100 + pos AS id, a.path, a.language, CASE a.language
          WHEN 'go' THEN CASE l_orderkey % 4 WHEN 0 THEN 'fmt/x' WHEN 1 THEN 'github.com/u/r/v2/p' WHEN 2 THEN 'example.com/' || b.package || '/gone' ELSE 'example.com/' || b.package || '/src/' || b.module || '/m' || CAST(b.id AS STRING) END
          WHEN 'rust' THEN CASE l_orderkey % 6 WHEN 0 THEN 'std::io' WHEN 1 THEN 'serde::de' WHEN 2 THEN 'super::m' || CAST(b.id AS STRING) WHEN 3 THEN 'crate::' || b.module || '::m' || CAST(b.id AS STRING)
            WHEN 4 THEN 'crate::' || b.module || '::m' || CAST(b.id AS STRING) || '::Thing' ELSE b.package || '::' || b.module || '::m' || CAST(b.id AS STRING) END
          ELSE CASE l_orderkey % 6 WHEN 0 THEN 'library_' || CAST(next_supp AS STRING) || '/sub' WHEN 1 THEN '../' || b.module || '/m' || CAST(b.id AS STRING)
            WHEN 2 THEN '../../../' || b.package || '/src/' || b.module || '/m' || CAST(b.id AS STRING) || CASE WHEN pos % 2 = 0 THEN '.js' ELSE '' END WHEN 3 THEN '~/' || b.module || '/m' || CAST(b.id AS STRING)
            ELSE '@loom/' || b.package || '/' || b.module || '/m' || CAST(b.id AS STRING) END END AS specifier
        FROM sites JOIN module_files a ON a.id = l_partkey JOIN module_files b ON b.id = next_part""",
    "io_sites": """
        SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS symbol_id,
          CASE l_suppkey % 5 WHEN 0 THEN 'database' WHEN 1 THEN 'network' WHEN 2 THEN 'filesystem' WHEN 3 THEN 'message-queue' ELSE 'process' END AS kind
        FROM lineitem WHERE l_quantity >= 49""",
    "commits": "SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS made_at, o_orderpriority = '1-URGENT' AS ai FROM orders",
    "commit_files": "SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file_id FROM lineitem",
    "cases": "SELECT s.id AS case_id FROM symbols s JOIN files f ON s.file_id = f.id WHERE f.role = 'test'",
}


def facts(spark: SparkSession, sf_dir: str, *names: str, once: tuple[str, ...] = ()) -> list[DataFrame]:
    """The named facts; only they, the earlier facts and the tables that they build on are planned. Without names, the tables alone.

    Those in `once` are computed now and kept, so that later facts and steps read them instead of shuffling a table again.
    """
    needed = set(names) if names else set(RAW)
    for name in reversed(FACTS):
        if name in needed:
            needed |= {other for other in (*RAW, *FACTS) if re.search(rf"\b{other}\b", FACTS[name])}
    for raw in RAW:
        if raw in needed:
            spark.read.parquet(f"{sf_dir}/{raw}.parquet").createOrReplaceTempView(raw)
    out = {}
    for name, text in FACTS.items():
        if name in needed:
            out[name] = kept(spark.sql(text)) if name in once else spark.sql(text)
            out[name].createOrReplaceTempView(name)
    return [out[n] for n in names]


def twin(query: str, recursive: bool = False) -> str:
    """A DuckDB query over the facts."""
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in FACTS.items())
    more = ",\n" + query[5:] if query.startswith("WITH ") else "\n" + query
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{more}"
