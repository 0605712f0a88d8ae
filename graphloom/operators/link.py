"""The link stage: from resolved facts to typed, weighted edges and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import kept

CONFIDENCES = ("exact", "likely", "ambiguous", "external", "unresolved")


def import_edges(imports: DataFrame) -> DataFrame:
    """One edge per pair of different files: `weight` counts imports; `type` is imports if any of them is a runtime import."""
    inner = imports.where("target_file_id is not null and file_id <> target_file_id")
    return inner.groupBy(F.col("file_id").alias("src"), F.col("target_file_id").alias("dst")).agg(
        F.count("*").alias("weight"), F.when(F.min(F.col("is_type_only").cast("int")) == 0, "imports").otherwise("references").alias("type")
    )


def rollup_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports between source files, counted by directory and by package, own pairs dropped; runtime and type-only apart.

    Both levels come from one pass over the joined imports.
    """
    own = files.where("role = 'source'").select("id", "dir_path", "package")
    a = own.select(F.col("id").alias("file_id"), F.col("dir_path").alias("d1"), F.col("package").alias("p1"))
    b = own.select(F.col("id").alias("target_file_id"), F.col("dir_path").alias("d2"), F.col("package").alias("p2"))
    kind = F.when(F.col("is_type_only"), "references").otherwise("imports").alias("type")
    level = lambda name, s, d: F.struct(F.lit(name).alias("level"), F.col(s).alias("src"), F.col(d).alias("dst"))
    pairs = imports.join(a, "file_id").join(b, "target_file_id").select(kind, F.inline(F.array(level("directory", "d1", "d2"), level("package", "p1", "p2"))))
    return pairs.where("src <> dst").groupBy("level", "type", "src", "dst").agg(F.count("*").alias("weight"))


def cycles(rollups: DataFrame) -> DataFrame:
    """Pairs that import each other at run time: `severity` is high between packages, medium between directories.

    A directory and its ancestor are no cycle, nor is the root.
    """
    runs = rollups.where("type = 'imports' and src <> '.' and dst <> '.'")
    back = runs.select("level", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back"))
    pair = runs.where("src < dst").join(back, ["level", "src", "dst"])
    nested = F.col("dst").startswith(F.concat("src", F.lit("/"))) | F.col("src").startswith(F.concat("dst", F.lit("/")))
    severity = F.when(F.col("level") == "package", "high").otherwise("medium").alias("severity")
    return pair.where((F.col("level") == "package") | ~nested).select("level", "src", "dst", severity, "weight", "back")


def call_edges(calls: DataFrame) -> DataFrame:
    """One edge per caller and callee: the first site's line, kind and confidence; `weight` counts sites.

    Unresolved sites and self-recursion make no edge. The first is by file, place and id, stated as an order.
    """
    made = calls.where("target_symbol_id is not null and resolution <> 'unresolved' and caller_symbol_id <> target_symbol_id")
    first = F.min_by(F.struct("line", "call_kind", F.col("resolution").alias("confidence")), F.struct("file_id", "end_offset", "id"))
    out = made.groupBy(F.col("caller_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst")).agg(first.alias("f"), F.count("*").alias("weight"))
    return out.select("src", "dst", "f.*", "weight")


def link_type_relations(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """A relation's target by global type name: none is external, one likely, several ambiguous (the smallest id)."""
    types = symbols.where(F.col("kind").isin("class", "interface", "struct", "enum", "type", "trait"))
    byname = types.groupBy("name").agg(F.min("id").alias("target_id"), F.count("*").alias("n"))
    out = relations.join(byname.withColumnRenamed("name", "target"), "target", "left")
    grade = F.when(F.col("n").isNull(), "external").when(F.col("n") == 1, "likely").otherwise("ambiguous")
    return out.withColumn("confidence", grade).drop("n")


def route_segments(route: Column) -> Column:
    """The segments of a route or URL path; parameters (`:id`, `{id}`, `<id>`, numbers) become `*`."""
    path = F.regexp_replace(F.regexp_replace(route, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"^(?::.*|\{.*\}|<.*>|\$\{.*\}|[0-9]+)$"), F.lit("*")).otherwise(p))


def match_score(request: Column, route: Column) -> Column:
    """Suffix alignment of two segment lists: 10 a static pair, 2 a pair of parameters, 1 a mixed pair, -1 a missing segment.

    Null if two static segments differ or none is static in both.
    """
    n = F.least(F.size(request), F.size(route))
    pairs = F.zip_with(F.slice(F.reverse(request), 1, n), F.slice(F.reverse(route), 1, n), lambda a, b: F.when((a == "*") & (b == "*"), 2).when((a == "*") | (b == "*"), 1).when(a == b, 10).otherwise(-1000))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    fits = (n > 0) & F.exists(pairs, lambda x: x == 10) & ~F.exists(pairs, lambda x: x < 0)
    return F.when(fits, total - F.abs(F.size(request) - F.size(route)))


#: Routes that a request may be linked to; more that match equally well are no link.
MAX_ROUTES = 4


def http_links(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests joined to the routes that match best: `request_id`, `route_id`, `score`, `confidence`.

    One best route is likely, up to four are ambiguous, more are dropped.

    The score of a pair follows from the two shapes, which tell from the end where a parameter stands (`*`), a static segment
    (`s`) or null (`0`, which fits a parameter only). Routes of a shape that have the same static segments where a shape of requests has some as well are
    one group, of which five routes tell enough; a path meets groups, not routes, so that one segment of very many paths and
    routes makes no square. State is distinct paths x shapes of routes.
    """
    from pyspark.sql import Window

    def shaped(df: DataFrame, shape: str, flipped: str) -> DataFrame:
        kinds = F.transform(F.reverse("segments"), lambda p: F.when(p.isNull(), "0").when(p == "*", "*").otherwise("s"))
        return df.where("segments is not null").select("*", F.array_join(kinds, "").alias(shape), F.reverse("segments").alias(flipped))

    asked = kept(shaped(requests.select("segments").distinct(), "a", "x"))
    known = kept(shaped(routes.select("route_id", "segments").distinct(), "b", "y"))
    shapes = asked.select("a").distinct().crossJoin(known.select("b").distinct())
    n = F.least(F.length("a"), F.length("b"))
    both = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i"), F.substr("a", i, F.lit(1)).alias("p"), F.substr("b", i, F.lit(1)).alias("q")))
    gain = lambda e: F.when((e["p"] == "*") & (e["q"] == "*"), 2).when((e["p"] == "*") | (e["q"] == "*"), 1).otherwise(10)
    places = F.transform(F.filter("both", lambda e: (e["p"] == "s") & (e["q"] == "s")), lambda e: e["i"])
    score = F.aggregate("both", F.lit(0), lambda s, e: s + gain(e)) - F.abs(F.length("a") - F.length("b"))
    shapes = shapes.where(n > 0).withColumn("both", both).where(~F.exists("both", lambda e: ((e["p"] == "0") & (e["q"] != "*")) | ((e["q"] == "0") & (e["p"] != "*"))))
    shapes = kept(shapes.select("a", "b", places.alias("places"), score.alias("score")).where(F.size("places") > 0))

    at = lambda flipped: F.transform("places", lambda i: F.element_at(flipped, i)).alias("static")
    group = ["b", "places", "static"]
    members = known.join(shapes.select("b", "places").distinct(), "b").select(*group[:2], at("y"), "route_id")
    # The literal limit lets each task cut a group before the shuffle.
    members = members.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("route_id"))).where(F.col("k") <= MAX_ROUTES + 1)
    members = members.groupBy(*group).agg(F.collect_list(F.struct("route_id")).alias("found"))
    met = asked.join(shapes, "a").select("segments", *group[:2], at("x"), "score").join(members, group)
    top = lambda *keys: F.max("score").over(Window.partitionBy(*keys))
    met = kept(met.select("segments", "score", "found").withColumn("_top", top("segments")).where("score = _top").drop("_top"))

    pairs = requests.select("request_id", "segments").distinct().join(met, "segments")
    best = pairs.withColumn("_top", top("request_id")).where("score = _top")
    counted = best.withColumn("_n", F.sum(F.size("found")).over(Window.partitionBy("request_id"))).where(F.col("_n") <= MAX_ROUTES)
    return counted.select("request_id", F.inline("found").alias("route_id"), "score", F.when(F.col("_n") == 1, "likely").otherwise("ambiguous").alias("confidence"))
