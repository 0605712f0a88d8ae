"""Evidence-based resolution of plain calls on hand-made facts."""

import time

from graphloom.operators.graph import kept
from graphloom.operators.resolve import resolve_plain_calls


def test_tiers(spark):
    files = spark.createDataFrame([(1, "typescript", "a"), (2, "typescript", "a"), (3, "typescript", "b"), (4, "python", "p"), (5, "python", "p"), (6, "go", "g"), (7, "go", "g"), (8, "java", "j")], "id long, language string, dir_path string")
    symbols = spark.createDataFrame(
        [(10, 1, "own", False), (20, 2, "twice", True), (21, 2, "hidden", False), (30, 3, "twice", True), (31, 3, "deep", True), (50, 5, "star", True), (70, 7, "peer", False), (11, 1, "two", False), (12, 1, "two", False)],
        "id long, file_id long, name string, exported boolean",
    )
    # 1 binds `alias` to 2's `again`, which 2 itself binds to 3's `deep`; 3 and 2 star each other.
    bindings = spark.createDataFrame(
        [(1, 1, "alias", 2, "again", None), (2, 2, "again", 3, "deep", None), (3, 1, "hidden", 2, "hidden", None), (4, 1, "lib", None, "lib", "left-lib"), (5, 1, "gone", 3, "gone", None)],
        "import_id long, file_id long, local string, target_file_id long, imported string, external_name string",
    )
    stars = spark.createDataFrame([(4, 5), (2, 3), (3, 2)], "file_id long, target_file_id long")
    names = [(1, "own"), (1, "two"), (1, "alias"), (1, "hidden"), (1, "lib"), (1, "gone"), (1, "twice"), (4, "star"), (4, "deep"), (6, "peer"), (8, "deep"), (8, "twice"), (1, None)]
    calls = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(names)], "id long, file_id long, callee_name string")
    got = [tuple(r) for r in resolve_plain_calls(calls, files, symbols, bindings, stars).orderBy("id").collect()]
    assert got == [
        (0, "local", 10, None, "exact"),
        (1, "local", 11, None, "ambiguous"),
        (2, "import", 31, None, "exact"),
        (3, "import", 21, None, "likely"),
        (4, "import", None, "left-lib", "external"),
        (5, None, None, None, "unresolved"),
        (6, None, None, None, "unresolved"),
        (7, "star", 50, None, "likely"),
        (8, None, None, None, "unresolved"),
        (9, "package", 70, None, "likely"),
        (10, "exported", 31, None, "likely"),
        (11, "exported", 20, None, "ambiguous"),
        (12, None, None, None, "unresolved"),
    ]


def test_kept_frames_leave_no_shuffle_files(spark, tmp_path):
    # checkpoint() left them, and itself uncompressed, until the driver collected its garbage: twenty times the input at once.
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    out = kept(spark.range(20_000).selectExpr("id % 5000 as k", "'same text' as t").groupBy("k", "t").count())
    until = time.time() + 10
    while (left := disk.getAllFiles().size()) > before and time.time() < until:
        time.sleep(0.2)
    assert left <= before
    assert out.count() == 5000 and all(f.endswith(".zstd.parquet") for f in out.inputFiles())
