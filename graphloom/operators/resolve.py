"""Call resolution by evidence: what a file declares, binds by an import, or may see in its language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import discard, kept

#: Hops of re-exports that are followed.
MAX_CHASE = 24
#: Languages where only an import can bring another file's function into a plain call.
IMPORT_ONLY = ("typescript", "javascript", "tsx", "jsx", "vue", "svelte")
STAR_LANGUAGES = ("python", "rust")
PACKAGE_LANGUAGES = ("go",)


def star_closure(stars: DataFrame, hops: int = MAX_CHASE) -> DataFrame:
    """`f`, `g`, `far`: the files that each file stars, directly or over others, with the least number of steps (1 to `hops`).

    Paths are doubled, so that 24 steps take five rounds. The state is one row a pair of files, whatever the number of names;
    files that star each other in a ring are all in each other's rows, which is quadratic in the ring.
    """
    best = kept(stars.where("file_id is not null and target_file_id <> file_id").select(F.col("file_id").alias("f"), F.col("target_file_id").alias("g"), F.lit(1).alias("far")).distinct())
    reach, pairs = 1, best.count()
    while reach < hops:
        second = best.select(F.col("f").alias("g"), F.col("g").alias("to"), F.col("far").alias("more"))
        longer = best.join(second, "g").select("f", F.col("to").alias("g"), (F.col("far") + F.col("more")).alias("far")).where(f"far <= {hops} and f <> g")
        shorter, best = best, kept(best.unionByName(longer).groupBy("f", "g").agg(F.min("far").alias("far")))
        discard(shorter)
        reach, before, pairs = reach * 2, pairs, best.count()
        if pairs == before:  # a doubling that adds no pair has found all of them, and each by its shortest way
            break
    return best


def chase(starts: DataFrame, own: DataFrame, named: DataFrame, closure: DataFrame, fixed: tuple[str, ...] = ()) -> DataFrame:
    """`f`, `n`, the `fixed` columns, `symbol_id`, `hops`: what each start (f, n, fixed) reaches in the fewest steps.

    `own` (f, n, fixed, symbol_id) answers; `named` (f, n, f1, n1) leads on under another name, `closure` (f, g, far) to
    starred files under the same one. At most `MAX_CHASE` steps; of equally near answers the smallest id. A round takes all
    starred files by one join and then one named step, so there are as many rounds as named steps in a row, not as steps.
    A start whose `fixed` columns no answer has is not followed. A state goes on only while its start has no nearer answer
    (`limit`), and not if it is one of an earlier round again (1, 2, 4, 8, 16), with no fewer steps: cycles end.
    """
    state, live = ["s", *fixed, "f", "n"], ["s", *fixed, "f", "n", "hops", "limit"]
    asked = starts.select("f", "n", *fixed).distinct()
    if fixed:
        asked = asked.join(own.select(*fixed).distinct(), list(fixed), "left_semi")
    asked = kept(asked.withColumn("s", F.monotonically_increasing_id()))
    frontier = past = asked.select(*state, F.lit(0).alias("hops"), F.lit(MAX_CHASE).alias("limit"))
    least, found = [F.min("hops").alias("hops"), F.min("limit").alias("limit")], []
    for k in range(MAX_CHASE + 1):
        over = frontier.join(closure, "f").select("s", *fixed, F.col("g").alias("f"), "n", (F.col("hops") + F.col("far")).alias("hops"), "limit")
        spread = frontier.unionByName(over).where("hops <= limit").groupBy(*state).agg(*least)
        spread = kept(spread.join(own, ["f", "n", *fixed], "left").select(*live, "symbol_id"))
        found.append(kept(spread.where("symbol_id is not null").groupBy("s").agg(F.min(F.struct("hops", "symbol_id")).alias("hit"))))
        step = spread.where("hops < limit").join(named, ["f", "n"]).select("s", *fixed, F.col("f1").alias("f"), F.col("n1").alias("n"), (F.col("hops") + 1).alias("hops"), "limit")
        step = step.join(found[-1], "s", "left").withColumn("limit", F.least("limit", "hit.hops")).where("hops <= limit").groupBy(*state).agg(*least)
        last, frontier = frontier, kept(step.join(past.select(*state, F.col("hops").alias("was")), state, "left").where("was is null or hops < was").select(*live))
        discard(spread)
        if k and last is not past:
            discard(last)
        if frontier.isEmpty():
            break
        if k & (k + 1) == 0:
            if k:
                discard(past)
            past = frontier
    if k:
        discard(past)
    every = reduce(DataFrame.unionByName, found).groupBy("s").agg(F.min("hit").alias("hit"))
    return asked.join(every, "s").select("f", "n", *fixed, "hit.symbol_id", "hit.hops")


def chase_exports(starts: DataFrame, exports: DataFrame, bindings: DataFrame, stars: DataFrame) -> DataFrame:
    """`file_id`, `name`, `symbol_id`, `hops`: the definition that each start (file_id, name) exports or re-exports.

    `exports` is (file_id, name, symbol_id), `bindings` (file_id, local, target_file_id, imported) with one row a local
    name, `stars` (file_id, target_file_id). The nearest definition wins, of several the smallest id; a start without
    one gives no row.
    """
    own = exports.groupBy(F.col("file_id").alias("f"), F.col("name").alias("n")).agg(F.min("symbol_id").alias("symbol_id"))
    named = bindings.where("target_file_id is not null").select(F.col("file_id").alias("f"), F.col("local").alias("n"), F.col("target_file_id").alias("f1"), F.col("imported").alias("n1"))
    closure = star_closure(stars)
    found = chase(starts.select(F.col("file_id").alias("f"), F.col("name").alias("n")), kept(own), kept(named), closure)
    return found.select(F.col("f").alias("file_id"), F.col("n").alias("name"), "symbol_id", "hops")


def first_bindings(bindings: DataFrame) -> DataFrame:
    """One binding a file and local name: that of the smallest import_id."""
    first = F.min_by(F.struct("target_file_id", "imported", "external_name"), F.struct("import_id", "imported"))
    return bindings.groupBy("file_id", "local").agg(first.alias("b")).select("file_id", "local", "b.*")


def resolve_plain_calls(calls: DataFrame, files: DataFrame, symbols: DataFrame, bindings: DataFrame, stars: DataFrame) -> DataFrame:
    """`id`, `tier`, `target_symbol_id`, `external_name`, `confidence` of each plain call.

    `calls` is (id, file_id, callee_name), `files` (id, language, dir_path), `symbols` (id, file_id, name, exported),
    `bindings` (import_id, file_id, local, target_file_id, imported, external_name), `stars` (file_id, target_file_id).
    Tiers: `local` (one is exact, several ambiguous); `import` (a package is external, an export exact, a sole unexported
    name likely); then by language: none where only imports bind, `star` for star imports, `package` for the directory,
    `exported` for any exported name elsewhere (one is likely, several ambiguous, the smallest id). No evidence, no link.
    Each name of a file is resolved once and joined back to its calls; a null name is unresolved.
    """
    needs = calls.where("callee_name is not null").select("file_id", F.col("callee_name").alias("name")).distinct()
    needs = kept(needs.join(files.select(F.col("id").alias("file_id"), "language", "dir_path"), "file_id", "left"))
    counted = lambda df, *keys: df.groupBy(*keys).agg(F.min("id").alias("sid"), F.count("*").alias("n"))
    local = kept(counted(symbols, "file_id", "name"))
    bound = kept(first_bindings(bindings))
    open_names = kept(needs.join(local, ["file_id", "name"], "left_anti"))
    by_import = kept(open_names.join(bound.withColumnRenamed("local", "name"), ["file_id", "name"]))
    star_needs = open_names.where(F.col("language").isin(*STAR_LANGUAGES)).select("file_id", "name").join(stars.distinct(), "file_id")

    starts = by_import.select(F.col("target_file_id").alias("file_id"), F.col("imported").alias("name")).unionByName(star_needs.select(F.col("target_file_id").alias("file_id"), "name"))
    exports = symbols.where("exported").select("file_id", "name", F.col("id").alias("symbol_id"))
    chased = kept(chase_exports(starts.where("file_id is not null"), exports, bound, stars).drop("hops"))

    defined = chased.select(F.col("file_id").alias("target_file_id"), F.col("name").alias("imported"), F.col("symbol_id").alias("i_exact"))
    sole = local.where("n = 1").select(F.col("file_id").alias("target_file_id"), F.col("name").alias("imported"), F.col("sid").alias("i_likely"))
    imported = by_import.join(defined, ["target_file_id", "imported"], "left").join(sole, ["target_file_id", "imported"], "left").select("file_id", "name", "external_name", "i_exact", "i_likely")
    starred = star_needs.join(chased.withColumnRenamed("file_id", "target_file_id"), ["target_file_id", "name"]).groupBy("file_id", "name").agg(F.min("symbol_id").alias("s_id"), F.count_distinct("symbol_id").alias("s_n"))
    placed = symbols.join(files.where(F.col("language").isin(*PACKAGE_LANGUAGES)).select(F.col("id").alias("file_id"), "dir_path"), "file_id")
    package = counted(placed, "dir_path", "name").select("dir_path", "name", F.col("sid").alias("p_id"), F.col("n").alias("p_n"))
    anywhere = counted(symbols.where("exported"), "name").select("name", F.col("sid").alias("e_id"), F.col("n").alias("e_n"))

    # Directories and names alone are keys only of the names of the languages that look there.
    free = ~F.coalesce(F.col("language").isin(*IMPORT_ONLY, *STAR_LANGUAGES, *PACKAGE_LANGUAGES), F.lit(False))
    beside = open_names.where(F.col("language").isin(*PACKAGE_LANGUAGES)).join(package, ["dir_path", "name"]).select("file_id", "name", "p_id", "p_n")
    afar = open_names.where(free).join(anywhere, "name").select("file_id", "name", "e_id", "e_n")
    out = needs.select("file_id", "name", "language").join(local, ["file_id", "name"], "left")
    found = [kept(f) for f in (imported, starred, beside, afar)]
    discard(bound, open_names, by_import, chased)
    for f in found:
        out = out.join(f, ["file_id", "name"], "left")
    link = lambda tier, target, grade, ext=None: F.struct(
        F.lit(tier).alias("tier"), target.alias("target_symbol_id"), (F.lit(None).cast("string") if ext is None else ext).alias("external_name"), grade.alias("confidence"))
    several = lambda n, one: F.when(F.col(n) == 1, one).otherwise("ambiguous")
    none = F.lit(None).cast("long")
    decided = (
        F.when(F.col("sid").isNotNull(), link("local", F.col("sid"), several("n", "exact")))
        .when(F.col("external_name").isNotNull(), link("import", none, F.lit("external"), F.col("external_name")))
        .when(F.col("i_exact").isNotNull(), link("import", F.col("i_exact"), F.lit("exact")))
        .when(F.col("i_likely").isNotNull(), link("import", F.col("i_likely"), F.lit("likely")))
        .when(F.col("s_id").isNotNull(), link("star", F.col("s_id"), several("s_n", "likely")))
        .when(F.col("p_id").isNotNull(), link("package", F.col("p_id"), several("p_n", "likely")))
        .when(F.col("e_id").isNotNull(), link("exported", F.col("e_id"), several("e_n", "likely")))
        .otherwise(link(None, none, F.lit("unresolved")))
    )
    names = kept(out.select("file_id", F.col("name").alias("callee_name"), decided.alias("d")))
    discard(needs, local, *found)
    rows = calls.select("id", "file_id", "callee_name").join(names, ["file_id", "callee_name"], "left")
    return rows.select("id", "d.tier", "d.target_symbol_id", "d.external_name", F.coalesce("d.confidence", F.lit("unresolved")).alias("confidence"))
