"""Layered ignore rules: ordered patterns of many folders decide on paths, the last match wins, a closed folder closes all below it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of layers: a later one overrides. Within `nested`, deeper folders override.
ROOT, NESTED, OWN, CONFIGURED = range(4)
_RULE = T.StructType([T.StructField("regex", T.StringType()), T.StructField("negated", T.BooleanType()), T.StructField("folders_only", T.BooleanType())])


def parse_rule(line: str | None) -> tuple[str | None, bool, bool]:
    """A line of an ignore file as (regular expression over local paths, negated, folders only); no expression for comments and blanks."""
    line = re.sub(r"(?<!\\)\s+$", "", line or "")
    negated = line.startswith("!")
    body = line[1:] if negated else line
    if not body or line.startswith("#"):
        return None, False, False
    folders, body = body.endswith("/"), body.rstrip("/")
    anchored, body = "/" in body, body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            kept = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "[" + ("^" + kept[1:] if kept[0] in "!^" else kept) + "]", end + 1
        else:
            i += c == "\\" and i + 1 < len(body)
            out, i = out + re.sub(r"([^\w/])", r"\\\1", body[i], flags=re.ASCII), i + 1
    return f"(?is)^{'' if anchored else '(?:.*/)?'}{out}$", negated, folders


@F.pandas_udf(_RULE)
def _parsed(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_rule(x) for x in lines], columns=["regex", "negated", "folders_only"])


def rules_of(files: DataFrame) -> DataFrame:
    """`layer`, `scope` and `rules` (in order: regex, negated, folders_only) of ignore files (layer, scope, text)."""
    lines = files.select("layer", "scope", F.posexplode(F.split("text", r"\r?\n")).alias("place", "line"))
    rules = lines.select("layer", "scope", "place", _parsed("line").alias("rule")).where("rule.regex is not null")
    each = F.array_sort(F.collect_list(F.struct("place", "rule")))
    return rules.groupBy("layer", "scope").agg(F.transform(each, lambda x: x["rule"]).alias("rules"))


def _verdict(local: Column, rules: Column) -> Column:
    """What one file's rules say of a local path: true ignored, false taken back, null nothing.

    The outermost folder on the way that is ignored decides; else the last rule that matches the path itself.
    """
    parts = F.split(local, "/")
    said = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.element_at(
            F.concat(
                F.array(F.lit(None).cast("boolean")),
                F.transform(
                    F.filter(rules, lambda r: (~r["folders_only"] | (k < F.size(parts))) & F.rlike(F.array_join(F.slice(parts, F.lit(1), k), "/"), r["regex"])),
                    lambda r: ~r["negated"],
                ),
            ),
            -1,
        ),
    )
    return F.when(F.exists(said, lambda v: F.coalesce(v, F.lit(False))), F.lit(True)).otherwise(F.element_at(said, -1))


def ignored(paths: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """`paths` with `ignored`, decided by the ignore files (layer, scope, text); scope '' is the repository's root.

    A file's rules see paths below its folder only, relative to it. Of all files the one of the highest layer, then of the
    deepest folder, that says something decides; where none does, or the path is null or empty, nothing is ignored. Files
    meet paths by an equi-join on the paths' folders, a row for each file above a path, however many rules it has.
    """
    above = F.concat(F.array(F.lit("")), F.expr(f"transform(sequence(1, size(split(`{path}`, '/')) - 1), k -> array_join(slice(split(`{path}`, '/'), 1, k), '/'))"))
    above = F.when(F.instr(path, "/") > 0, above).otherwise(F.array(F.lit("")))
    ways = paths.select(path).where(F.col(path) != "").distinct().select(path, F.explode(above).alias("scope"))
    met = ways.join(rules_of(files), "scope")
    local = F.when(F.col("scope") == "", F.col(path)).otherwise(F.expr(f"substring(`{path}`, length(scope) + 2)"))
    said = met.select(path, "layer", F.length("scope").alias("deep"), _verdict(local, F.col("rules")).alias("v")).where("v is not null")
    last = said.groupBy(path).agg(F.max_by("v", F.struct("layer", "deep")).alias("ignored"))
    return paths.drop("ignored").join(last, path, "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
