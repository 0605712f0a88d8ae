"""Path algebra as column expressions, and joins by path prefix rewritten as equi-joins on exploded ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    """The directory of a path; '.' at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(F.lit("."))


def depth(path: Column) -> Column:
    """The number of parts; the root '.' has none."""
    return F.when(path == ".", 0).otherwise(F.size(F.split(path, "/")))


def normalize(path: Column) -> Column:
    """Without empty and '.' parts, '..' resolved where it can be."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    step = lambda done, p: F.when(
        (p == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, 1, F.size(done) - 1)
    ).otherwise(F.concat(done, F.array(p)))
    out = F.array_join(F.aggregate(parts, empty, step), "/")
    # Most paths have no such part and are not taken apart.
    return F.when(~path.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), path).when(out == "", F.lit(".")).otherwise(out)


def join(base: Column, path: Column) -> Column:
    return normalize(F.concat_ws("/", base, path))


def ancestors(path: Column, include_self: bool = False) -> Column:
    """The directories above a path, outermost first, without the root; with the path itself if asked for."""
    parts = F.split(path, "/")
    last = F.size(parts) - (0 if include_self else 1)
    rising = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(last >= 1, rising).otherwise(F.array().cast("array<string>"))


def is_within(path: Column, directory: Column) -> Column:
    """A literal prefix test: '_' and '%' in names are no wildcards."""
    return (directory == ".") | (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def longest_owner(items: DataFrame, path: str, owners: DataFrame, owner_dir: str, owner: str) -> DataFrame:
    """`items` with the owner of the longest directory that holds each path, else null.

    The prefix test is an equi-join on exploded ancestors, so it shuffles by key instead of comparing all pairs.
    """
    up = items.select(path).distinct().select(path, F.explode(ancestors(F.col(path), include_self=True)).alias("_dir"))
    found = up.join(owners.select(F.col(owner_dir).alias("_dir"), F.col(owner).alias("_owner")), "_dir")
    best = found.groupBy(path).agg(F.max_by("_owner", F.length("_dir")).alias(owner))
    return items.join(best, path, "left")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: `**` any depth, `*` and `?` within a part, `{a,b}` alternatives, `[..]` classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + r".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body.startswith("!") else body) + "]", end + 1
            continue
        out += {"*": r"[^/]*", "?": r"[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and out.count("(?:") > out.count(")") else ("\\" + c if c in r".+^$()|\\" else c))
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)
