"""Repository ingestion on a small tree, and the commit source on this repository's own kind of history."""

import subprocess

from pyspark.sql import functions as F

from graphloom.sources import repository as R


def test_walk_parse_resolve(spark, tmp_path):
    tree = {
        "pkg/__init__.py": "",  # empty: not listed
        "pkg/a.py": "from . import b\nfrom .b import helper as h\nimport os\nimport pkg.b\nfrom .gone import x\n\nclass C(Base):\n    def m(self, x):\n        if x and x > 1:\n            return h(x)\n        # note\n        return [y for y in x]\n",
        "pkg/b.py": "def helper(x):\n    def inner():\n        return x\n    return inner()\n",
        "pkg/bad.py": "def (",
        "tests/test_a.py": "def test_x():\n    pass\n",
        "node_modules/x.py": "x = 1",
        "web/app.ts": "// c\nlet a = 1; /* b\n b */\n\n",
        "gen.py": "# Code generated by tool. DO NOT EDIT\nx = 1\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = R.walk(spark, str(tmp_path))
    got = {r.path: (r.language, r.role) for r in files.collect()}
    assert set(got) == set(tree) - {"node_modules/x.py", "pkg/__init__.py"}
    assert got["tests/test_a.py"] == ("python", "test") and got["web/app.ts"] == ("typescript", "source") and got["gen.py"][1] == "generated"
    loc = dict(files.select("path", R.lines_of_code(F.col("text"), F.col("language"))).collect())
    assert loc["web/app.ts"] == 1 and loc["pkg/b.py"] == 4 and loc["pkg/a.py"] == 10
    facts = R.parse_python(files)
    symbols = {(r.path, r.name): (r.kind, r.container, r.complexity) for r in facts.where("fact = 'symbol'").collect()}
    assert symbols[("pkg/a.py", "m")] == ("method", "C", 4) and symbols[("pkg/b.py", "helper")][2] == 1
    calls = {(r.path, r.name, r.target) for r in facts.where("fact = 'call'").collect()}
    assert ("pkg/a.py", "h", "C.m") in calls and ("pkg/b.py", "inner", "helper") in calls
    assert facts.where("fact = 'error'").select("path").collect()[0][0] == "pkg/bad.py"
    imports = {(r.path, r.name): (r.file, r.confidence) for r in R.resolve_python_imports(facts, files).collect()}
    assert imports[("pkg/a.py", "b")] == ("pkg/b.py", "exact") and imports[("pkg/a.py", "helper" if ("pkg/a.py", "helper") in imports else "h")] == ("pkg/b.py", "exact")
    assert imports[("pkg/a.py", "os")] == (None, "external") and imports[("pkg/a.py", "pkg.b")][0] == "pkg/b.py"


def test_git_history(spark, tmp_path):
    assert R.git_history(spark, str(tmp_path)) is None
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(2):
        (tmp_path / f"f{k}").write_text("x")
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
    commits, files = R.git_history(spark, str(tmp_path))
    assert commits.count() == 2 and sorted(r.file_id for r in files.collect()) == ["f0", "f1"]


def test_overrides_win(spark):
    df = spark.createDataFrame([("src/a.ts",), ("docs/a.ts",)], "p string")
    assert [r[0] for r in df.select(R.role_of(F.col("p"), overrides={"src/**": "test"})).collect()] == ["test", "docs"]
