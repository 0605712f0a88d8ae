"""A repository as fact tables: walk, languages, roles, Python facts, commit history.

Files are read by Spark's binary source, so any store serves, and parsed where they lie.
"""

from __future__ import annotations

import ast
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import dir_of, matches_any

#: Directories that are never entered (fixed values).
HARD_IGNORED = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "jspm_packages", "web_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    ".gradle", ".idea", ".vscode-test", ".turbo", ".nx", ".cache", ".parcel-cache", ".pnpm-store", "target", ".next", ".nuxt", ".svelte-kit", ".output", "coverage",
)
#: Extensions of the languages that are told apart (fixed values).
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "sh": "shell", "ps1": "powershell", "css": "css", "vue": "vue", "svelte": "svelte",
    "astro": "astro", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "html": "html", "kt": "kotlin", "swift": "swift", "scala": "scala",
}
#: Globs by role, in the order in which they are tried.
ROLE_GLOBS = (
    ("vendor", ["**/vendor/**", "**/third_party/**", "**/*.min.js"]),
    ("test", ["**/*.test.*", "**/*.spec.*", "**/test_*.py", "**/*_test.*", "**/tests/**", "**/test/**", "**/__tests__/**", "**/conftest.py"]),
    ("generated", ["**/*.generated.*", "**/*.pb.go", "**/*_pb2.py", "**/generated/**"]),
    ("config", ["**/*.config.*", "**/package.json", "**/tsconfig*.json", "**/*.toml", "**/*.yaml", "**/*.yml", "**/Dockerfile", "**/Makefile"]),
    ("docs", ["**/*.md", "**/*.rst", "**/docs/**", "**/LICENSE*"]),
    ("asset", ["**/*.png", "**/*.jpg", "**/*.svg", "**/*.ico", "**/*.woff*", "**/*.pdf"]),
    ("types", ["**/*.d.ts", "**/*.pyi"]),
)
GENERATED_MARK = r"(?i)(?:@generated|code generated .* do not edit|auto-?generated)"


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("other"))


def role_of(path: Column, text: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """The first role whose globs match; later overrides win over all of these. A mark in the first lines makes a file generated."""
    out = F.lit("source")
    if text is not None:
        out = F.when(F.substring_index(text, "\n", 40).rlike(GENERATED_MARK), "generated").otherwise(out)
    for role, globs in reversed(ROLE_GLOBS):
        out = F.when(matches_any(path, globs), role).otherwise(out)
    for glob, role in (overrides or {}).items():
        out = F.when(matches_any(path, [glob]), role).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, max_bytes: int = 1_000_000, overrides: dict[str, str] | None = None) -> DataFrame:
    """`path`, `dir_path`, `language`, `role`, `bytes`, `hash`, `text` of the files below `root`, hard-ignored directories left out.

    The hash is the first 16 digits of the content's SHA-1; of assets and files above `max_bytes` it names the size.
    Empty files are not listed, as Spark's file sources skip them; they hold no facts.
    """
    root = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", f"^(?:file:)?/*{re.escape(root.lstrip('/'))}/", "")
    ignored = F.array(*[F.lit(d) for d in HARD_IGNORED])
    own = found.select(path.alias("path"), F.col("length").alias("bytes"), "content").where(~F.arrays_overlap(F.split("path", "/"), ignored))
    text = F.when(F.col("bytes") <= max_bytes, F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string"))
    own = own.withColumns({"text": text, "dir_path": dir_of(F.col("path")), "language": language_of(F.col("path"))})
    own = own.withColumn("role", role_of(F.col("path"), F.col("text"), overrides))
    size = F.concat(F.lit("size:"), F.col("bytes"))
    digest = F.when((F.col("role") == "asset") | (F.col("bytes") > max_bytes), size).otherwise(F.substring(F.sha1("content"), 1, 16))
    return own.select("path", "dir_path", "language", "role", "bytes", digest.alias("hash"), "text")


def lines_of_code(text: Column, language: Column) -> Column:
    """Lines that are neither blank nor only a comment; block comments are taken out first."""
    hashed = language.isin("python", "ruby", "shell", "yaml", "toml")
    plain = F.when(hashed, text).otherwise(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""))
    mark = F.when(hashed, F.lit(r"^\s*#.*$")).otherwise(F.lit(r"^\s*//.*$"))
    return F.size(F.filter(F.split(plain, "\n"), lambda s: (F.trim(s) != "") & ~F.rlike(s, mark))).cast("long")


FACT = "path string, fact string, name string, kind string, container string, target string, line int, end_line int, complexity int, level int, error string"
_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.comprehension, ast.match_case)


def _complexity(node: ast.AST) -> int:
    """1 and one for each decision of the function itself, without those of functions inside it."""
    total, todo = 1, list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            continue
        total += isinstance(n, _DECISIONS) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0)
        todo += ast.iter_child_nodes(n)
    return total


def python_facts(path: str, text: str) -> list[tuple]:
    """Symbols, imports and calls of one Python file; a file that cannot be parsed gives one row with the error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [(path, "error", None, None, None, None, None, None, None, None, str(error)[:200])]
    rows: list[tuple] = []

    def visit(node: ast.AST, owner: str | None, caller: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{n.name}" if owner else n.name
                rows.append((path, "symbol", n.name, "method" if owner else "function", owner, None, n.lineno, n.end_lineno, _complexity(n), None, None))
                visit(n, None, name)
            elif isinstance(n, ast.ClassDef):
                rows.append((path, "symbol", n.name, "class", owner, None, n.lineno, n.end_lineno, 1, None, None))
                for base in n.bases:
                    rows.append((path, "relation", n.name, "extends", None, ast.unparse(base), n.lineno, None, None, None, None))
                visit(n, n.name, caller)
            else:
                if isinstance(n, ast.Import):
                    rows.extend((path, "import", a.asname or a.name, "static", None, a.name, n.lineno, None, None, 0, None) for a in n.names)
                elif isinstance(n, ast.ImportFrom):
                    rows.extend((path, "import", a.asname or a.name, "static", a.name, n.module or "", n.lineno, None, None, n.level, None) for a in n.names)
                elif isinstance(n, ast.Call):
                    f = n.func
                    name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                    if name:
                        receiver = ast.unparse(f.value)[:200] if isinstance(f, ast.Attribute) else None
                        rows.append((path, "call", name, "method" if receiver else "call", receiver, caller, n.lineno, None, None, None, None))
                visit(n, owner, caller)

    visit(tree, None, None)
    return rows


def parse_python(files: DataFrame) -> DataFrame:
    """Facts of all Python files (columns of FACT), parsed in parallel."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACT.split(", ")]
        for b in batches:
            rows = [r for p, t in zip(b.path, b.text, strict=True) for r in python_facts(p, t or "")]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("line", "end_line", "complexity", "level")})

    return files.where("language = 'python' and text is not null").select("path", "text").mapInPandas(parse, FACT)


def resolve_python_imports(facts: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("", "src/")) -> DataFrame:
    """`path`, `line`, `target`, `confidence`: imports by the first candidate file that exists, else external.

    Candidates are joined to the files, in order, instead of probing one by one. A relative import without a file is unresolved.
    """
    imp = facts.where("fact = 'import'")
    up = F.split(dir_of(F.col("path")), "/")
    base = F.when(F.col("level") > 0, F.array_join(F.slice(up, 1, F.greatest(F.size(up) - F.col("level") + 1, F.lit(0))), "/"))
    base = F.when((base == "") | (base == "."), "").otherwise(F.concat(base, F.lit("/")))
    module = F.regexp_replace("target", r"\.", "/")
    # `from a import b` may name the module a.b.
    inner = F.when(F.col("container").isNotNull() & (F.col("container") != "*"), F.when(module == "", F.col("container")).otherwise(F.concat_ws("/", module, "container")))
    starts = F.when(F.col("level") > 0, F.array(base)).otherwise(F.array(*[F.lit(r) for r in roots]))
    stems = F.filter(F.flatten(F.transform(starts, lambda s: F.array(F.concat(s, inner), F.concat(s, F.when(module != "", module))))), lambda x: x.isNotNull())
    candidates = F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))
    each = imp.select("path", "line", "target", "name", "level", F.posexplode_outer(candidates).alias("pos", "candidate"))
    hit = each.join(files.select(F.col("path").alias("candidate"), F.lit(True).alias("there")), "candidate", "left")
    best = hit.groupBy("path", "line", "target", "name", "level").agg(F.min_by("candidate", F.when(F.col("there"), F.col("pos"))).alias("file"))
    grade = F.when(F.col("file").isNotNull(), "exact").when(F.col("level") > 0, "unresolved").otherwise("external")
    return best.select("path", "line", "name", F.col("target").alias("module"), "file", grade.alias("confidence"))


def git_history(spark: SparkSession, root: str, since: str = "12 months", limit: int = 5000) -> tuple[DataFrame, DataFrame] | None:
    """(commits, commit_files) of a local clone by `git log`, without merges; None where git or the history is missing."""
    form = "--format=%x1e%H%x1f%an%x1f%aI%x1f%B%x1d"
    try:
        out = subprocess.run(["git", "-C", root, "log", "--no-merges", "--no-renames", "--name-only", f"--since={since}", f"-n{limit}", form], capture_output=True, text=True, timeout=20, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    rows = [r.strip("\n") for r in out.split("\x1e") if r.strip()]
    raw = spark.createDataFrame([(r,) for r in rows], "raw string")
    head, names = F.split(F.split("raw", "\x1d")[0], "\x1f"), F.split(F.split("raw", "\x1d")[1], "\n")
    ai = head[3].rlike(r"(?i)co-authored-by:.*\b(?:bot|assistant|ai)\b")
    own = raw.select(head[0].alias("commit_id"), head[1].alias("author"), F.to_timestamp(head[2]).alias("made_at"), ai.alias("ai"), F.filter(names, lambda n: n != "").alias("files"))
    return own.drop("files"), own.select("commit_id", F.explode("files").alias("file_id"))
