"""Layered ignore rules against hand-made cases and a plain matcher on random trees."""

import random
import re

import pytest

from graphloom.operators import ignore as G


def decide(spark, files, paths):
    rules = spark.createDataFrame(files, "layer int, scope string, text string")
    return {r.path: r.ignored for r in G.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}


def test_layers(spark):
    files = [
        (G.ROOT, "", "# note\n\n*.log\n!keep.log\nbuild/\n/only.txt\ndocs/**/x.md\n\\#odd\n[ab].c\nsp\\ ace"),
        (G.NESTED, "pkg", "!*.log\nlocal\n/deep/file"),
        (G.NESTED, "pkg/sub", "*.log"),
        (G.OWN, "", "secret.*\r\n!pkg/sub/free.log"),
        (G.CONFIGURED, "", "vendor/\n!vendor/mine.ts"),
    ]
    want = {
        "a.log": True, "keep.log": False, "x/keep.log": False, "build/a.ts": True, "x/build/a.ts": True, "build": False, "only.txt": True, "x/only.txt": False,
        "docs/x.md": True, "docs/a/b/x.md": True, "#odd": True, "a.c": True, "c.c": False, "sp ace": True, "A.LOG": True,
        "pkg/a.log": False, "pkg/local/z.ts": True, "pkg/deep/file": True, "pkg/x/deep/file": False, "local": False,
        "pkg/sub/a.log": True, "pkg/sub/free.log": False, "secret.key": True, "pkg/secret.key": True,
        "vendor/mine.ts": True, "plain.ts": False, "": False, None: False,
    }
    assert decide(spark, files, list(want)) == want
    assert decide(spark, [], ["a", "a"]) == {"a": False}


def plain(files, path):
    """The same by loops, with patterns of names, `*`, a leading or a trailing slash."""
    out = False
    for _, scope, text in sorted(files, key=lambda f: (f[0], len(f[1]))):
        if scope and not path.startswith(scope + "/"):
            continue
        parts = (path[len(scope) + 1 :] if scope else path).split("/")
        said = []
        for k in range(1, len(parts) + 1):
            here = None
            for line in text.split("\n"):
                negated, body = line.startswith("!"), line.removeprefix("!")
                if body.endswith("/") and k == len(parts):
                    continue
                body = body.rstrip("/")
                name = re.compile(body.lstrip("/").replace("*", "[^/]*"))
                if name.fullmatch("/".join(parts[:k])) if "/" in body else name.fullmatch(parts[k - 1]):
                    here = not negated
            said.append(here)
        if True in said:
            out = True
        elif said[-1] is not None:
            out = said[-1]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["a", "b", "ab", "ba"])
    paths = sorted({"/".join(name() for _ in range(rng.randint(1, 5))) for _ in range(300)})
    line = lambda: rng.choice(["", "!"]) + rng.choice([name(), "/" + name(), name() + "/", "a*", "*b", name() + "/" + name(), name() + "/*"])
    scopes = ["", *sorted({p.rsplit("/", 1)[0] for p in paths if "/" in p})[::4]]
    files = [(G.ROOT if s == "" else G.NESTED, s, "\n".join(line() for _ in range(rng.randint(1, 4)))) for s in scopes]
    files += [(G.OWN, "", line()), (G.CONFIGURED, "", line())]
    assert decide(spark, files, paths) == {p: plain(files, p) for p in paths}
