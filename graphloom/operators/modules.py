"""Module specifiers to files: script paths, aliases and workspace packages, Go module directories, Rust module paths.

Instead of probing candidate after candidate, each file states once which bases it answers and how early it would have
been tried (`answers`); an import states its bases in order, and the least (base, rank) of one equi-join is the target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import ancestors, base_name, depth, dir_of, is_within, join, longest_owner
from graphloom.operators.graph import kept

#: Extensions of source files in the order in which they are tried (fixed values).
SOURCE = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".d.ts")
#: A written extension of compiled files, and the extensions of what it may have been compiled from (fixed values).
COMPILED, WRITTEN = (".js", ".mjs", ".cjs", ".jsx"), (".ts", ".tsx", ".mts", ".cts", ".d.ts")
#: Imports of these are not code; outside of a relative path that exists they are external (fixed values).
ASSETS = r"(?i)\.(?:css|scss|sass|less|svg|png|jpe?g|gif|webp|woff2?|ttf|wasm|json|txt|md)$"
#: Where a workspace package's root and its subpaths are looked for (fixed values).
PACKAGE_ROOTS, SUBPATHS = ("src/index", "index", "src/main", "lib/index"), ("src", "", "lib", "dist")
#: Languages by the rules that resolve them (fixed values).
FAMILIES = {"typescript": "script", "tsx": "script", "javascript": "script", "jsx": "script", "vue": "script", "svelte": "script", "astro": "script", "go": "go", "rust": "rust"}
#: Package managers whose names a script cannot import (fixed values).
NOT_SCRIPT = ("go", "cargo", "python")
#: Crates of the language, and directories in which each file is a crate root (fixed values).
OWN_CRATES, TARGET_DIRS = ("std", "core", "alloc", "proc_macro", "test"), ("tests", "benches", "examples", "src/bin")
#: Steps of `extends` that are followed.
MAX_EXTENDS = 5
CONFIG = "struct<extends: string, compilerOptions: struct<baseUrl: string, paths: map<string, string>>>"
NEED = ["family", "origin", "specifier"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _cut(end: str) -> Column:
    return F.left(F.col("path"), F.length("path") - len(end))


def answers(files: DataFrame) -> DataFrame:
    """`family`, `base`, `rank`, `target`: what each file answers to, at most some ten rows a file.

    A script `a/b.ts` answers `a/b.ts`, the compiled names `a/b.js` and its like, and `a/b`; `a/index.ts` answers `a` as
    well. A Rust file answers its module path, `lib.rs` and `main.rs` their directory with a slash. Go: directories.
    """
    path = F.col("path")
    known = lambda base: reduce(lambda a, b: a | b, [base.endswith(e) for e in SOURCE])
    row = lambda family, base, rank: F.struct(F.lit(family).alias("family"), base.alias("base"), F.lit(rank).alias("rank"))
    said = [row("script", path, 0)]
    for k, end in enumerate(WRITTEN, 1):
        said += [F.when(path.endswith(end), row("script", F.concat(_cut(end), F.lit(js)), k)) for js in COMPILED]
    first = 1 + len(WRITTEN)
    for k, end in enumerate(SOURCE, first):
        said.append(F.when(path.endswith(end) & ~known(_cut(end)), row("script", _cut(end), k)))
        said.append(F.when(path.endswith("/index" + end), row("script", _cut("/index" + end), k + len(SOURCE))))
    said += [F.when(path.endswith(end), row("rust", _cut(end), k)) for k, end in enumerate((".rs", "/mod.rs"))]
    said += [F.when(base_name(path) == name, row("rust", F.concat(dir_of(path), F.lit("/")), k)) for k, name in enumerate(("lib.rs", "main.rs"))]
    paths = files.select("path").where("path <> ''").distinct()
    by_file = paths.select(F.explode(F.filter(F.array(*said), lambda s: s.isNotNull())).alias("a"), "path").select("a.*", F.col("path").alias("target"))
    dirs = paths.select(F.explode(F.array_prepend(ancestors(path), ".")).alias("base")).distinct()
    return by_file.unionByName(dirs.select(F.lit("go").alias("family"), "base", F.lit(0).alias("rank"), F.col("base").alias("target")))


def script_configs(texts: DataFrame) -> DataFrame:
    """`path`, `extends`, `base_url`, `patterns` of compiler configurations (`path`, `text`), comments and trailing commas allowed.

    A pattern is (prefix, suffix, star, targets), in the order in which they are written. A text that is no object gives
    no patterns and extends nothing.
    """
    string = r'("(?:[^"\\]++|\\.)*+")'
    plain = F.regexp_replace(F.regexp_replace("text", string + r"|//[^\n]*|(?s:/\*.*?(?:\*/|$))", "$1"), string + r"|,(?=\s*[}\]])", "$1")
    read = texts.select("path", F.from_json(plain, CONFIG).alias("c"))
    written = F.coalesce(F.map_entries("c.compilerOptions.paths"), F.array().cast("array<struct<key: string, value: string>>"))
    listed = F.filter(F.transform(written, lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], "array<string>").alias("targets"))), lambda e: e["targets"].isNotNull())

    def pattern(e: Column) -> Column:
        at = F.instr(e["key"], "*")
        prefix = F.when(at > 0, F.left(e["key"], at - 1)).otherwise(e["key"])
        return F.struct(prefix.alias("prefix"), F.when(at > 0, F.substr(e["key"], at + 1)).otherwise("").alias("suffix"), (at > 0).alias("star"), e["targets"].alias("targets"))

    return read.select("path", F.col("c.extends").alias("extends"), F.col("c.compilerOptions.baseUrl").alias("base_url"), F.transform(listed, pattern).alias("patterns"))


def path_mappings(configs: DataFrame) -> DataFrame:
    """`dir`, `base_dir`, `patterns` for each directory whose `tsconfig.json` has patterns, its own or those it extends.

    The first configuration with patterns on the chain of relative `extends` decides, with its own directory and base;
    the chain is a loop of joins of at most MAX_EXTENDS steps, so that cycles end.
    """
    up = F.when(F.col("extends").startswith("."), join(dir_of(F.col("path")), F.col("extends")))
    base = join(dir_of(F.col("path")), F.coalesce("base_url", F.lit(".")))
    known = kept(configs.dropDuplicates(["path"]).select(
        F.col("path").alias("at"), F.when(up.endswith(".json"), up).otherwise(F.concat(up, F.lit(".json"))).alias("up"), base.alias("base_dir"), "patterns", (F.size("patterns") > 0).alias("decides")
    ))
    state = known.where((F.col("at") == "tsconfig.json") | F.col("at").endswith("/tsconfig.json")).select(dir_of(F.col("at")).alias("dir"), "at")
    found = []
    for _ in range(MAX_EXTENDS + 1):
        state = kept(state.join(known, "at"))
        found.append(state.where("decides").select("dir", "base_dir", "patterns"))
        state = state.where("not decides and up is not null").select("dir", F.col("up").alias("at"))
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _aliased(needs: DataFrame, mappings: DataFrame) -> DataFrame:
    """`needs` with `aliased`, the bases of all patterns that fit a bare specifier, in the order of the nearest mapping."""
    origins = needs.select("origin").distinct()
    above = origins.select("origin", F.explode(F.array_distinct(F.array_prepend(ancestors(F.col("origin"), include_self=True), "."))).alias("dir"))
    nearest = above.join(mappings.select("dir"), "dir").groupBy("origin").agg(F.max_by("dir", depth(F.col("dir"))).alias("dir"))
    spec = F.col("specifier")
    fits = lambda p: F.when(
        p["star"], spec.startswith(p["prefix"]) & spec.endswith(p["suffix"]) & (F.length(spec) >= F.length(p["prefix"]) + F.length(p["suffix"]))
    ).otherwise(spec == p["prefix"])

    def bases(p: Column) -> Column:
        inner = F.substr(spec, F.length(p["prefix"]) + 1, F.length(spec) - F.length(p["prefix"]) - F.length(p["suffix"]))
        at = lambda t: F.instr(t, "*")
        full = lambda t: F.when(at(t) > 0, F.concat(F.left(t, at(t) - 1), inner, F.substr(t, at(t) + 1))).otherwise(t)
        return F.transform(p["targets"], lambda t: join(F.col("base_dir"), full(t)))

    mapped = needs.join(nearest, "origin", "left").join(mappings, "dir", "left")
    return mapped.withColumn("aliased", F.coalesce(F.flatten(F.transform(F.filter("patterns", fits), bases)), _none())).drop("dir", "base_dir", "patterns")


def _script(needs: DataFrame, packages: DataFrame, mappings: DataFrame) -> DataFrame:
    owners = packages.where(~F.coalesce("manager", F.lit("")).isin(*NOT_SCRIPT)).groupBy("name").agg(F.min_by(F.struct("name", "dir", "entries"), "dir").alias("package"))
    out = longest_owner(_aliased(needs, mappings), "specifier", owners, "name", "package")
    spec, p, origin = F.col("specifier"), F.col("package"), F.col("origin")
    sub = F.regexp_replace(F.substr(spec, F.length(p["name"]) + 1), "^/", "")
    below = lambda inner: join(p["dir"], inner)
    whole = F.concat(F.transform(p["entries"], below), F.array(*[below(F.lit(r)) for r in PACKAGE_ROOTS]))
    parts = F.concat(F.array(*[below(F.concat(F.lit(s + "/"), sub)) for s in SUBPATHS]), F.transform(F.slice(F.filter(p["entries"], lambda e: e.contains(sub)), 1, 1), below))
    shared = F.when(p.isNull(), _none()).when(sub == "", whole).otherwise(parts)
    asset, relative = spec.rlike(ASSETS), spec.rlike(r"^\.\.?(?:/|$)")
    fixed = (spec == "") | spec.startswith("/") | spec.startswith("node:")
    head = F.split(spec, "/")
    library = F.when(spec.startswith("@") & (F.size(head) > 1), F.concat(head[0], F.lit("/"), head[1])).otherwise(head[0])
    out = out.withColumn("bases", F.when((asset & spec.startswith(".")) | relative, F.array(join(origin, spec))).when(asset | fixed, _none()).otherwise(F.concat("aliased", shared)))
    outside = F.when(asset | spec.startswith("node:"), spec).when(relative | fixed | p.isNotNull(), None).otherwise(library)
    return out.select(*NEED, "bases", outside.alias("outside"))


def _go(needs: DataFrame, packages: DataFrame) -> DataFrame:
    owners = packages.where("manager = 'go'").groupBy("name").agg(F.min_by(F.struct("name", "dir"), "dir").alias("package"))
    out = longest_owner(needs, "specifier", owners, "name", "package")
    spec, p = F.col("specifier"), F.col("package")
    inside = F.array(join(p["dir"], F.substr(spec, F.length(p["name"]) + 1)))
    invalid = (spec == "") | spec.rlike("^[./]")
    outside = F.when(F.split(spec, "/")[0].contains("."), F.substring_index(spec, "/", 3)).otherwise(spec)
    return out.select(*NEED, F.when(invalid | p.isNull(), _none()).otherwise(inside).alias("bases"), F.when(invalid | p.isNotNull(), None).otherwise(outside).alias("outside"))


def _crate_roots(origins: DataFrame, crates: DataFrame) -> DataFrame:
    """`origin`, `root`, `own`: the directory from which a file's crate counts its modules, and the file's own module path.

    The crate is the nearest above the file; its root the deepest target directory or entry directory that holds the file, else its
    `src`. Without a crate it is the first `src` on the path, or the file's directory.
    """
    origin = F.col("origin")
    above = origins.select("origin", F.explode(F.array_prepend(ancestors(origin), ".")).alias("dir"))
    near = above.join(crates.select("dir", "entries"), "dir").groupBy("origin").agg(F.max_by(F.struct("dir", "entries"), F.struct(depth(F.col("dir")), "entries")).alias("c"))
    out = origins.join(near, "origin", "left")
    c = F.col("c")
    dirs = F.concat(F.array(*[join(c["dir"], F.lit(d)) for d in TARGET_DIRS]), F.transform(c["entries"], lambda e: dir_of(join(c["dir"], e))))
    holding = F.transform(F.filter(dirs, lambda d: is_within(origin, d)), lambda d: F.struct(depth(d).alias("depth"), d.alias("dir")))
    parts = F.split(origin, "/")
    at = F.array_position(parts, "src")
    loose = F.when(at > 0, F.array_join(F.slice(parts, 1, at.cast("int")), "/")).otherwise(dir_of(origin))
    out = out.withColumn("root", F.when(c.isNull(), loose).otherwise(F.coalesce(F.array_max(holding)["dir"], join(c["dir"], F.lit("src")))))
    root = F.col("root")
    inner = F.split(F.regexp_replace(F.when(root == ".", origin).otherwise(F.substr(origin, F.length(root) + 2)), r"\.[^./]*$", ""), "/")
    own = F.when(F.element_at(inner, -1).isin("mod", "lib", "main"), F.slice(inner, 1, F.size(inner) - 1)).otherwise(inner)
    return out.select("origin", "root", F.when(is_within(origin, root), own).otherwise(_none()).alias("own"))


def _rust(needs: DataFrame, packages: DataFrame) -> DataFrame:
    crates = packages.where("manager = 'cargo'")
    entry = lambda e: dir_of(join(F.col("dir"), e))
    library = F.get(F.filter("entries", lambda e: e.endswith("lib.rs")), F.lit(0))
    stated = F.coalesce(library, F.get("entries", F.lit(0)))
    home = F.when(stated.isNotNull(), entry(stated)).otherwise(join(F.col("dir"), F.lit("src")))
    named = crates.select(F.regexp_replace("name", "-", "_").alias("head"), "dir", home.alias("home")).groupBy("head").agg(F.min_by("home", "dir").alias("home"))
    parts = F.filter(F.transform(F.split("specifier", "::"), lambda s: F.trim(s)), lambda s: s != "")
    out = needs.join(_crate_roots(needs.select("origin").distinct(), crates), "origin").withColumn("parts", parts).withColumn("head", F.get("parts", F.lit(0))).join(named, "head", "left")
    own, tail = F.col("own"), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    # `super` counts only at the beginning.
    plain = F.array_position(F.transform("parts", lambda s: s != "super"), True).cast("int")
    ups = F.when(plain > 0, plain - 1).otherwise(F.size("parts"))
    base = F.slice(own, 1, F.greatest(F.size(own) - ups, F.lit(0)))
    rest = F.slice("parts", ups + 1, F.size("parts"))
    head, way = F.col("head"), lambda root, path, back: F.struct(root.alias("root"), path.alias("path"), back.alias("back"))
    never, top, root = F.lit(None).cast("array<string>"), _none(), F.col("root")
    chosen = (
        F.when(head.isin("crate", "$crate"), way(root, tail, F.when(F.size(tail) <= 1, top)))
        .when(head == "self", way(root, F.concat(own, tail), F.when(F.size(tail) != 1, own)))
        .when((head == "super") & (ups <= F.size(own)), way(root, F.concat(base, rest), F.when(F.size(rest) <= 1, base)))
        .when(head == "super", F.lit(None))
        .when(F.col("home").isNotNull(), way(F.col("home"), tail, top))
        .when(~head.isin(*OWN_CRATES), way(root, F.col("parts"), never))
    )
    out = out.withColumn("way", chosen)
    w = F.col("way")
    at = lambda path: F.when(F.size(path) == 0, F.concat(w["root"], F.lit("/"))).otherwise(join(w["root"], F.array_join(path, "/")))
    falling = F.when(F.size(w["path"]) > 0, F.transform(F.sequence(F.greatest(F.size(w["path"]), F.lit(1)), F.lit(1), F.lit(-1)), lambda n: at(F.slice(w["path"], 1, n)))).otherwise(_none())
    bases = F.coalesce(F.when(w["back"].isNotNull(), F.concat(falling, F.array(at(w["back"])))).otherwise(falling), _none())
    inside = head.isin("crate", "$crate", "self", "super") | F.col("home").isNotNull()
    return out.select(*NEED, bases.alias("bases"), F.when(~inside, head).alias("outside"))


def resolve_modules(imports: DataFrame, files: DataFrame, packages: DataFrame, mappings: DataFrame) -> DataFrame:
    """`id`, `target_path`, `target_dir`, `external_name`, `confidence` of each import.

    `imports` is (id, path, language, specifier), `files` (path), `packages` (name, dir, manager, entries array<string>),
    `mappings` as from `path_mappings`. An import of a file or, in Go, of a directory is exact; else it is external under
    its library's name, or unresolved.

    Scripts: relative paths (`.` and `..` too) by the file, its compiled name, the extensions in their order, then an
    index file; assets; then the patterns of the nearest mapping in their written order, each target tried (a pattern
    without a star fits only itself); then the workspace package of the longest name, by its entries and usual places. Go: the module
    of the longest name, then the directory. Rust: `crate`, `self`, `super`, other crates and modules of the crate root,
    from the longest module path down, with the file that alone could hold the symbol last.

    Null or empty specifiers, null paths and other languages are unresolved. Each (place, specifier) is resolved once, repeated
    imports stay apart; of packages with one name the least directory counts. State is needs x bases, a handful each.
    """
    family = F.try_element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), F.col("language"))
    spec = F.when(family == "script", F.col("specifier")).otherwise(F.trim("specifier"))
    origin = F.when(F.col("path").isNotNull(), F.when(family == "script", dir_of(F.col("path"))).when(family == "rust", F.col("path")).when(family == "go", ""))
    rows = kept(imports.select("id", family.alias("family"), origin.alias("origin"), spec.alias("specifier")))
    packages = packages.where("name <> '' and dir is not null").select("name", "dir", "manager", F.filter(F.coalesce("entries", _none()), lambda e: e.isNotNull()).alias("entries"))
    needs = kept(rows.dropna().drop("id").distinct())
    of = lambda name: needs.where(F.col("family") == name)
    ways = kept(_script(of("script"), packages, mappings).unionByName(_go(of("go"), packages)).unionByName(_rust(of("rust"), packages)))
    # The planner takes the answers for as small as the files; they never go through the driver.
    tried = ways.select(*NEED, F.posexplode("bases").alias("pos", "base")).join(answers(files).hint("merge"), ["family", "base"])
    hits = tried.groupBy(*NEED).agg(F.min_by("target", F.struct("pos", "rank")).alias("target"))
    done = ways.select(*NEED, "outside").join(hits, NEED, "left")
    hit, outside = F.col("target"), F.when(F.col("target").isNull(), F.col("outside"))
    is_go = F.col("family") == "go"
    grade = F.when(hit.isNotNull(), "exact").when(outside.isNotNull(), "external").otherwise("unresolved")
    return rows.join(done, NEED, "left").select("id", F.when(~is_go, hit).alias("target_path"), F.when(is_go, hit).alias("target_dir"), outside.alias("external_name"), grade.alias("confidence"))
