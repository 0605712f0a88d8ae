"""Secret scan: regular expressions find candidates, a random forest removes the false positives.

Built-in functions and the DataFrame-based random forest only. Features are the candidate's length, the transitions
between its characters (between classes, and how probable its pairs of letters are in words), the share of it that
dictionary words cover, the words of its path, and the words beside it.
"""

from __future__ import annotations

import json
from functools import reduce
from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import shared_dir, text_or_empty, written

#: How much text on each side counts as neighbouring words.
NEAR = 48
#: The forest is trained on at most so many distinct labelled values, those with the smallest hash.
MAX_TRAINING_ROWS = 8192
TREES, DEPTH, SEED = 40, 6, 7

_CREDENTIAL = r"passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key|auth|bearer|credential|private[_\-]?key"
CREDENTIAL = rf"(?i)(?:{_CREDENTIAL})"
PLACEHOLDER = r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_\-]|fake|redacted|x{4,}|0{6,}|1234567|^[<${%]|^\*+$)"
TEST_PATH = r"(?i)(?:^|[/._\-])(?:tests?|specs?|fixtures?|examples?|samples?|docs?|mocks?)(?:$|[/._\-])"
#: Formats of providers' keys, web tokens and key files (fixed values of the formats).
_FORMATS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_\-]{35}"
    r"|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
)
PROVIDER = rf"^(?:{_FORMATS})$"
#: What stands before a value that is assigned to a credential word.
_ASSIGNED = rf"(?i:(?:{_CREDENTIAL})[\w\-]{{0,24}}[\"']?\s{{0,3}}(?::=|=>|=|:)\s{{0,3}}[\"']?)"
#: A key of a known format, a value of six characters or more assigned to a credential word, or a run of 16 characters
#: of key alphabets that holds a digit. The forest is there to remove what of these is no secret.
CANDIDATE = (
    rf"(?<![A-Za-z0-9+/_])(?:{_FORMATS})"
    rf"|(?<![A-Za-z0-9])(?:[A-Za-z0-9]{{1,16}}[_\-])?{_ASSIGNED}[^\s\"'<>]{{6,}}+"
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
)
#: Hash buckets of the words beside a candidate and of its path.
NEAR_BUCKETS, PATH_BUCKETS = 32, 16
#: Findings of this fold (crc32 of the value) are never trained on.
FOLDS = 5
WORDS = (
    "access account action admin agent alert alpha api app array async auth back base batch beta body bool bucket build byte cache call cert chart check child class click client "
    "cloud code color column common config connect const content context control copy core count create data date debug default delete demo dev device disk doc domain double draft "
    "edit email empty enable end engine entry env error event export factory false feature fetch field file filter final flag float font form frame from front function graph group "
    "handler hash head height hello home host html http icon image import index info input int item job json key label lang layer level light line link list load local lock log "
    "login main map mask master match max menu message meta method min mock mode model module mount name net new next node null number object offset open option order output page "
    "param parent parse path plan play point pool port post prefix print prod proxy public query queue random range read redis release remote report request reset response rest "
    "result return role root route row rule run save scale schema scope script search section select send server service session set shape share short size slot sort source space "
    "spec stack staging start state static status step stop store stream string style sub sum sync system tab table tag target task team temp test text theme time title token tool "
    "track tree true type unit update upload url user util value vector version view volume web width window work write zone"
).split()

FEATURES = ("length", "digits", "uppers", "symbols", "transitions", "pairs", "distinct", "vowels", "dictionary", "hex", "assigned", "quoted", "credential", "placeholder", "test_path", "path_depth")


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: the key, `ordinal` in its text, `value`, `before`, `after`, `path`.

    Texts without a candidate, null and empty ones have no row. Repeated rows are scanned as often as they come.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    own = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_t"), where.alias("path")).where(F.col("_t").rlike(CANDIDATE))
    cut = own.select("_key", "path", F.split("_t", CANDIDATE, -1).alias("_between"), F.posexplode(F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0))).alias("ordinal", "_hit"))
    lead = F.regexp_extract("_hit", rf"^(?:[A-Za-z0-9]{{1,16}}[_\-])?{_ASSIGNED}(?=[^\s\"'<>]{{6,}})", 0)
    value = F.substring(F.col("_hit"), F.length(lead) + 1, F.length("_hit"))
    value = F.when(lead != "", F.regexp_replace(value, r"(?<=.{6})[,;.)\]}#]+$", "")).otherwise(value)
    return cut.select(
        F.col("_key").alias(key),
        "ordinal",
        value.alias("value"),
        F.substring(F.concat(F.element_at("_between", F.col("ordinal") + 1), lead), -NEAR, NEAR).alias("before"),
        F.substring(F.element_at("_between", F.col("ordinal") + 2), 1, NEAR).alias("after"),
        "path",
    )


def _share(value: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def pair_table() -> list[float]:
    """Log probabilities of the 26 x 26 pairs of letters in the dictionary's words, with add-one smoothing."""
    counts = [1] * 676
    for w in WORDS:
        for a, b in zip(w, w[1:], strict=False):
            counts[(ord(a) - 97) * 26 + ord(b) - 97] += 1
    return [log(n / sum(counts[k // 26 * 26 : k // 26 * 26 + 26])) for k, n in enumerate(counts)]


def _pair_score(value: Column) -> Column:
    """The mean log probability of the pairs of letters of a value; without any, a twentieth."""
    table = F.from_json(F.lit(json.dumps(pair_table())), "array<double>")
    place = lambda c: F.ascii(c) - 97
    codes = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c.between("a", "z"), place(c)))
    n = F.size(codes)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a * 26 + b)
    known = F.filter(pairs, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + F.element_at(table, x + 1))
    return F.when(F.size(known) > 0, total / F.size(known)).otherwise(F.lit(log(0.05)))


def with_features(found: DataFrame) -> DataFrame:
    v = F.col("value")
    classes = reduce(lambda c, p: F.regexp_replace(c, *p), [("[0-9]", "0"), ("[a-z]", "a"), ("[A-Z]", "A"), (r"[^0aA]", "_")], v)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    words = lambda c, n: F.slice(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != ""), n, 3)
    near = F.concat(F.transform(F.reverse(words(F.col("before"), -3)), lambda w: F.concat(F.lit("<"), w)), words(F.col("after"), 1))
    out = found.withColumns(
        {
            "length": F.length(v).cast("double"),
            "digits": _share(v, "[0-9]"),
            "uppers": _share(v, "[A-Z]"),
            "symbols": _share(v, "[^A-Za-z0-9]"),
            "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / F.length(v),
            "pairs": _pair_score(v),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
            "vowels": _share(v, "(?i)[aeiou]"),
            "dictionary": _share(F.lower(v), "(?:" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"),
            "hex": flag(v.rlike("^[0-9a-fA-F]+$")),
            "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
            "quoted": flag(F.col("before").rlike(r"[\"']$")),
            "credential": flag(F.col("before").rlike(CREDENTIAL)),
            "placeholder": flag(v.rlike(PLACEHOLDER)),
            "test_path": flag(F.col("path").rlike(TEST_PATH)),
            "path_depth": F.size(F.split("path", "/")).cast("double"),
            "_near": F.coalesce(near, F.array().cast("array<string>")),
            "_where": F.filter(F.split(F.lower("path"), r"[^\p{L}]+"), lambda w: w != ""),
        }
    )
    out = HashingTF(numFeatures=NEAR_BUCKETS, inputCol="_near", outputCol="near_words").transform(out)
    return HashingTF(numFeatures=PATH_BUCKETS, inputCol="_where", outputCol="path_words").transform(out).drop("_near", "_where")


def weak_labels(found: DataFrame) -> DataFrame:
    """Label findings that clear rules decide: provider formats and assigned credentials are secrets (1); numbers,
    placeholders, few distinct characters and dictionary words are not (0). The others are left to the forest."""
    featured = with_features(found)
    v = F.col("value")
    no = v.rlike("^[0-9]+$") | (F.col("placeholder") == 1) | (F.col("distinct") * F.col("length") <= 4) | (F.col("dictionary") >= 0.75)
    yes = v.rlike(PROVIDER) | ((F.col("assigned") == 1) & (F.col("credential") == 1) & ((F.col("digits") > 0) | (F.col("symbols") > 0)))
    return featured.withColumn("label", F.when(v.rlike(PROVIDER), 1.0).when(no, 0.0).when(yes, 1.0)).where("label is not null").select(*found.columns, "label")


def held_out(value: str = "value") -> Column:
    return F.crc32(F.col(value).cast("binary")) % FOLDS == 0


def _assembled(featured: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*FEATURES, "near_words", "path_words"], outputCol="features").transform(featured)


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS):
    """A forest fitted on labelled findings outside the held-out fold, each distinct value once; None without both labels.

    Of rows with one value the largest label counts, and of these rows' contexts the smallest (all its parts of one row).
    One partition in a fixed order, so that the same findings give the same forest.
    """
    worst = F.min(F.struct((-F.col("label")).alias("l"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.coalesce("path", F.lit("")).alias("path")))
    one = labelled.where("label is not null and value is not null").where(~held_out()).groupBy("value").agg(worst.alias("w"))
    one = one.select("value", (-F.col("w.l")).cast("double").alias("label"), "w.before", "w.after", "w.path")
    sample = written(one.orderBy(F.xxhash64("value"), "value").limit(max_rows), "training")
    if sample.select("label").distinct().count() < 2:
        return None
    rows = _assembled(with_features(sample.repartition(1).sortWithinPartitions("value")))
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: the key, `ordinal`, `value_sha256`, `length`, `score`, `is_secret`, `label`, `held_out`.

    `labelled` holds findings (value, before, after, path) with `label` 0 or 1; without it, findings that clear rules
    decide are the labels, and `label` returns them (null: undecided) beside `held_out`, so that the forest can be
    measured on values that it was not trained on. Without both labels the forest cannot be trained and every candidate
    scores 1 (none is removed). The secret itself is returned as its SHA-256 only. Whole texts are scanned, however long;
    null, empty and repeated ones are treated as in `findings`. No candidate or an empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    shared_dir(docs.sparkSession)
    found = written(findings(docs, key, text, path).withColumnRenamed(key, "_key"), "findings")
    known = weak_labels(found.drop("_key", "ordinal").distinct()) if labelled is None else labelled
    known = written(known.select("value", "before", "after", "path", "label"), "labels")
    forest = train(known)
    featured = with_features(found)
    if forest is None:
        scored = featured.withColumn("score", F.lit(1.0))
    else:
        scored = forest.transform(_assembled(featured)).withColumn("score", vector_to_array("probability")[1])
    marks = known.groupBy(F.sha2("value", 256).alias("sha")).agg(F.max("label").alias("label"))
    scored = scored.withColumn("value_sha256", F.sha2("value", 256)).withColumn("held_out", held_out())
    return scored.join(marks, F.col("value_sha256") == F.col("sha"), "left").select(
        F.col("_key").alias(key), F.col("ordinal").cast("int").alias("ordinal"), "value_sha256", F.col("length").cast("int").alias("length"), "score", (F.col("score") >= 0.5).alias("is_secret"), "label", "held_out"
    )
