"""Module resolution: hand-made cases of each language, configurations, and a plain prober on random trees."""

import json
import posixpath
import random

import pytest

from graphloom.operators import modules as M

PACKAGE = "name string, dir string, manager string, entries array<string>"


def resolve(spark, imports, files, packages=(), configs=()):
    """{(path, specifier): what was found}: a path, `dir:` and a directory, `lib:` and a name, or None."""
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    rows = [(i, p, lang, s) for i, (p, lang, s) in enumerate(imports)]
    mappings = M.path_mappings(M.script_configs(frame(configs, "path string, text string")))
    out = M.resolve_modules(frame(rows, "id long, path string, language string, specifier string"), frame([(f,) for f in files], "path string"), frame(packages, PACKAGE), mappings)
    got = out.collect()
    assert sorted(r.id for r in got) == [r[0] for r in rows]
    for r in got:
        found = r.target_path is not None or r.target_dir is not None
        assert r.confidence == ("exact" if found else "external" if r.external_name is not None else "unresolved")
        assert sum(x is not None for x in (r.target_path, r.target_dir, r.external_name)) <= 1
    name = lambda r: r.target_path or (f"dir:{r.target_dir}" if r.target_dir else f"lib:{r.external_name}" if r.external_name else None)
    return {(rows[r.id][1], rows[r.id][3]): name(r) for r in got}


def check(spark, language, wants, *more):
    """`wants` is {path: {specifier: what is found}}."""
    flat = {(p, s): v for p, want in wants.items() for s, v in want.items()}
    assert resolve(spark, [(p, language, s) for p, s in flat], *more) == flat


def test_scripts(spark):
    files = ["src/main.ts", "src/App.vue", "src/Widget.svelte", "src/Page.astro", "src/a.ts", "src/a.tsx", "src/b.d.ts", "src/b/index.ts", "src/c/index.d.ts", "src/raw.js", "src/raw.ts", "src/x.css", "top.mts", "src/d.js/index.ts"]
    check(spark, "typescript", {"src/main.ts": {
        "./App.vue": "src/App.vue", "./Widget": "src/Widget.svelte", "./Page": "src/Page.astro", "./a": "src/a.ts", "./a.js": "src/a.ts", "./a.jsx": "src/a.ts",
        "./b": "src/b.d.ts", "./b/": "src/b.d.ts", "./b.js": "src/b.d.ts", "./c": "src/c/index.d.ts", "./raw.js": "src/raw.js", "./raw.cjs": "src/raw.ts", "../top": "top.mts", "../top.mjs": "top.mts",
        "./d.js": "src/d.js/index.ts", "./x.css": "src/x.css", "./y.css": "lib:./y.css", "pkg/y.svg": "lib:pkg/y.svg", "./none": None, "../../out": None, "/src/a": None, "": None, "node:fs": "lib:node:fs",
        "react": "lib:react", "react/jsx": "lib:react", "@a/b/c": "lib:@a/b", "@a": "lib:@a", ".": None,
    }}, files)


def test_workspaces(spark):
    files = ["p/core/src/index.ts", "p/core/src/types.ts", "p/core/flat.ts", "p/core/gen/deep.ts", "p/core-x/lib/index.js", "p/main/cli.ts", "p/none/readme.md", "go/x.go"]
    packages = [
        ("@w/core", "p/core", "npm", ["gen/deep.ts"]), ("@w/core-x", "p/core-x", None, None), ("@w/core/flat", "p/none", "npm", []), ("main", "p/main", "pnpm", ["./gone.ts", "./cli.js"]),
        ("go", "go", "go", []), ("main", "z/main", "npm", []),
    ]
    check(spark, "tsx", {"app/x.ts": {
        "@w/core": "p/core/gen/deep.ts", "@w/core/types": "p/core/src/types.ts", "@w/core/deep": "p/core/gen/deep.ts", "@w/core-x": "p/core-x/lib/index.js", "@w/core/flat": None,
        "@w/core/flat.js": "p/core/flat.ts", "@w/core/missing": None, "main": "p/main/cli.ts", "maine": "lib:maine", "go": "lib:go",
    }}, files, packages)


def test_aliases(spark):
    base = {"compilerOptions": {"paths": {"@/*": ["src/*", "gen/*"], "@/deep/*": ["never/*"], "lib": ["src/lib.ts"], "~*.mod": ["src/*_mod"], "bad": "src/bad"}}}
    configs = [
        ("tsconfig.json", '// "top"\n{"extends": "./conf/base", /* , } */ "compilerOptions": {"baseUrl": ".",},}'),
        ("conf/base.json", json.dumps(base | {"extends": "../tsconfig.json"}).replace('"src/*", ', '"../src/*", /* second */ ').replace('["src/', '["../src/')),
        ("app/tsconfig.json", '{"compilerOptions": {"baseUrl": "./code", "paths": {"#/*": ["*", "https://x/*"]}}}'),
        ("broken/tsconfig.json", "{nothing"),
        ("loop/tsconfig.json", '{"extends": "./tsconfig.json"}'),
        ("pack/tsconfig.json", '{"extends": "@tsconfig/node"}'),
        ("empty/tsconfig.json", None),
    ]
    files = ["src/a.ts", "conf/gen/b.ts", "src/deep/c.ts", "src/lib.ts", "src/m_mod.ts", "app/code/z.ts"]
    top = {"@/a": "src/a.ts", "@/b": "conf/gen/b.ts", "@/deep/c": "src/deep/c.ts", "lib": "src/lib.ts", "library": "lib:library", "~m.mod": "src/m_mod.ts", "@/none": "lib:@/none", "bad": "lib:bad"}
    wants = {path: top for path in ("x.ts", "broken/x.ts", "loop/deep/x.ts", "pack/x.ts", "empty/x.ts")}
    check(spark, "vue", wants | {"app/code/y.ts": {"#/z.js": "app/code/z.ts", "@/a": "lib:@/a"}}, files, [], configs)
    # a workspace package is asked only after the patterns
    packages = [("@/a", "q", "npm", []), ("@/q", "q", "npm", []), ("@", "none", "npm", [])]
    check(spark, "typescript", {"x.ts": {"@/a": "src/a.ts", "@/q": "q/index.ts", "@": None}}, [*files, "q/index.ts"], packages, configs)


def test_extends_ends(spark):
    chain = [(f"{'tsconfig' if k == 0 else f'c{k}'}.json", json.dumps({"extends": f"./c{k + 1}"})) for k in range(M.MAX_EXTENDS)]
    last = ("c5.json", '{"compilerOptions": {"paths": {"@/*": ["*"]}}}')
    assert resolve(spark, [("x.ts", "typescript", "@/y")], ["y.ts"], [], [*chain, last]) == {("x.ts", "@/y"): "y.ts"}
    longer = [*chain, ("c5.json", '{"extends": "./c6"}'), ("c6.json", last[1])]
    assert resolve(spark, [("x.ts", "typescript", "@/y")], ["y.ts"], [], longer) == {("x.ts", "@/y"): "lib:@/y"}


def test_go(spark):
    files = ["go.mod", "main.go", "internal/db/db.go", "internal/store/store.go", "tools/go.mod", "tools/cli/main.go"]
    packages = [("example.com/app", ".", "go", []), ("example.com/app/tools", "tools", "go", None), ("fmt", "x", "npm", [])]
    check(spark, "go", {"internal/store/store.go": {
        "example.com/app/internal/db": "dir:internal/db", "example.com/app": "dir:.", "example.com/app/tools/cli": "dir:tools/cli", "example.com/application": "lib:example.com/application",
        " fmt ": "lib:fmt", "net/http": "lib:net/http", "github.com/google/uuid": "lib:github.com/google/uuid", "github.com/google/uuid/v5/internal": "lib:github.com/google/uuid",
        "example.com/app/internal/missing": None, "./relative": None, "/abs": None, "": None,
    }}, files, packages)


RUST = [f"crates/store/{p}" for p in ("Cargo.toml", "src/lib.rs", "src/config.rs", "src/cache.rs", "src/handlers.rs", "src/handlers/http.rs", "src/handlers/errors.rs", "src/store/mod.rs", "src/store/models.rs", "tests/all.rs", "tests/util.rs")]
RUST += ["crates/cli/Cargo.toml", "crates/cli/src/main.rs", "crates/cli/src/args.rs", "crates/odd/code/entry/lib.rs", "crates/odd/code/entry/part.rs"]
CRATES = [("loom-store", "crates/store", "cargo", []), ("loom-cli", "crates/cli", "cargo", None), ("odd", "crates/odd", "cargo", ["code/entry/lib.rs"])]


def test_rust(spark):
    src = "crates/store/src/"
    check(spark, "rust", {
        src + "handlers/http.rs": {
            "crate::config": src + "config.rs", "crate::store": src + "store/mod.rs", "crate::store::models": src + "store/models.rs", "crate::store::Record": src + "store/mod.rs", "crate::MAX": src + "lib.rs",
            "$crate": src + "lib.rs", "super::errors": src + "handlers/errors.rs", "super::Helper": src + "handlers.rs", "super::super::config": src + "config.rs", "super": src + "handlers.rs", "super::super::Top": src + "lib.rs",
            "super::super::super::x": None, "crate::nonexistent::deep": None, " crate :: config ": src + "config.rs", "": None, "::": None, "config::Thing": src + "config.rs", "self::a::b": src + "handlers/http.rs", "self": src + "handlers/http.rs",
        },
        src + "lib.rs": {
            "self::cache": src + "cache.rs", "self::inner::Thing": src + "lib.rs", "self::missing_mod": None, "loom_cli::args": "crates/cli/src/args.rs", "loom_cli": "crates/cli/src/main.rs", "loom_cli::gone::X": "crates/cli/src/main.rs",
            "odd::part::X": "crates/odd/code/entry/part.rs", "std::collections": "lib:std", "core": "lib:core", "serde::de": "lib:serde", "tokio": "lib:tokio",
        },
        "crates/store/tests/all.rs": {"self::util": "crates/store/tests/all.rs", "crate::util": "crates/store/tests/util.rs", "util::help": "crates/store/tests/util.rs"},
        "crates/odd/code/entry/part.rs": {"crate::part": "crates/odd/code/entry/part.rs", "super::X": "crates/odd/code/entry/lib.rs"},
    }, RUST, CRATES)
    # without a package file
    loose = ["a/src/b/c.rs", "a/src/d.rs", "a/src/b.rs", "one.rs", "two.rs", "main.rs"]
    check(spark, "rust", {"a/src/b/c.rs": {"crate::d": "a/src/d.rs", "super::E": "a/src/b.rs"}, "one.rs": {"crate::two": "two.rs", "self::X": "one.rs", "crate::Y": "main.rs"}}, loose)


def test_edges(spark):
    odd = [(None, "typescript", "./a"), ("a.ts", None, "./a"), ("a.ts", "cobol", "./a"), ("a.ts", "typescript", None), ("a.rs", "rust", None)]
    assert set(resolve(spark, odd, ["a.ts", "a.ts", None, ""]).values()) == {None}
    assert resolve(spark, [], []) == {}
    assert resolve(spark, [("a.ts", "typescript", "./b"), ("a.ts", "typescript", "./b")], []) == {("a.ts", "./b"): None}


def probe(files, path, spec):
    """A relative script import by trying file after file."""
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
    tried = [base]
    stem, end = posixpath.splitext(base)
    if end in M.COMPILED:
        tried += [stem + e for e in M.WRITTEN]
    if not base.endswith(M.SOURCE):
        tried += [base + e for e in M.SOURCE]
    tried += [f"{base}/index{e}" for e in M.SOURCE]
    return next((t for t in tried if t in files), None)


@pytest.mark.parametrize("seed", range(2))
def test_random_script_trees(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "index", "a.d", "b.js"])
    files = {"/".join(word() for _ in range(rng.randint(1, 3))) + rng.choice(M.SOURCE) for _ in range(150)}
    imports = [(rng.choice(sorted(files)), "javascript", rng.choice(["./", "../", "../../", "./../"]) + "/".join(word() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", *M.SOURCE])) for _ in range(500)]
    want = {(p, s): probe(files, p, s) for p, _, s in imports}
    assert resolve(spark, imports, files) == want and len({v for v in want.values() if v}) > 20


def test_answers_are_not_broadcast(spark, tmp_path):
    # They are several rows a file, but the planner counts one: a million files came under the limit of a broadcast.
    files = spark.createDataFrame([("a/b.ts",), ("a/c.rs",)], "path string")
    imports = spark.createDataFrame([(1, "a/x.ts", "typescript", "./b")], "id long, path string, language string, specifier string")
    packages = spark.createDataFrame([], "name string, dir string, manager string, entries array<string>")
    mappings = spark.createDataFrame([], "dir string, base_dir string, patterns array<struct<prefix: string, suffix: string, star: boolean, targets: array<string>>>")
    files.write.parquet(str(tmp_path / "files"))
    out = M.resolve_modules(imports, spark.read.parquet(str(tmp_path / "files")), packages, mappings)
    assert [tuple(r) for r in out.collect()] == [(1, "a/b.ts", None, None, "exact")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [family" in plan and not any("base#" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
