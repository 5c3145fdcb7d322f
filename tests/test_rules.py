"""The rules on one small tree that holds a true and a silent case of each."""

import difflib
import random

import pytest

from proofline import queries_rules
from proofline.operators import post
from proofline.operators.facts import FactBase
from proofline.plans import rules as R
from proofline.sinks import reports
from proofline.sources import trees

TREE = {
    "pyproject.toml": '[project]\nname = "demo"\ndependencies = ["requests>=2"]\n[project.scripts]\ndemo = "pkg.cli:main"\nold = "pkg.gone:main"\n',
    "pkg/__init__.py": "",
    "pkg/core.py": (
        '"""Core."""\nimport requests\nimport yaml\n\nTIMEOUT = 30\n\n# timeout is 10 seconds\ndef run(path):\n    """Run it."""\n'
        "    return path\n\n# calls `fetch_everything()` before it ends, after `run()`\ndef other():\n    return run(1)\n\n# HACK around the parser\n"
        "# see line 42 for why\ndef unused_thing():\n    pass\n"
    ),
    "pkg/star.py": "from pkg.core import *\n",
    "pkg/cli.py": (
        "from pkg.core import run, vanish\nfrom pkg.lost import x\nfrom .core import other\nfrom pkg.star import run as again\nimport os\n\n"
        "# Deprecated: use start_all() instead\nPORT = os.getenv(\"PORT_NUM\", \"8080\")  # PORT_NUM defaults to 9090\n"
        "# see pkg/missing.py for details, not pkg/core.py\ndef main():\n    other()\n    run(2)\n    again(3)\n"
    ),
    "pkg/args.py": (
        "import argparse\np = argparse.ArgumentParser()\np.add_argument(\"--fast\")\np.add_argument(\"--slow\")\n"
        "one = p.get(\"/v1/users/3\")\ntwo = p.get(\"/v2/gone\")\n"
    ),
    "tests/test_core.py": (
        "from unittest.mock import patch\n@patch(\"pkg.core.charge\")\ndef test_it(m):\n    pass\n@patch(\"pkg.core.run\")\ndef test_ok(m):\n    pass\n"
    ),
    "broken.py": "def f(:\n",
    "README.md": (
        "# Demo\n\n```python\nfrom pkg.core import run\nrun(1)\nlaunch_it(2)\n```\n\n```console\n$ demo --fast --slwo\n```\n\n```js\nopen\n"
    ),
    "openapi.json": '{"openapi": "3.0", "paths": {"/v1/users/{id}": {}}}',
    "package.json": '{"name": "web", "main": "src/nope.js", "dependencies": {"left": "1"}}',
    "tsconfig.json": '{"compilerOptions": {/* c */ "paths": {"@app/*": ["src/*"]},}}',
    "src/a.js": (
        "import { b, c } from './b';\nimport d from './gone.js';\nimport x from 'right-pad';\nimport l from 'left';\n"
        "import { b as bb } from '@app/b';\nimport q from '@app/none';\nimport dd from './b';\nexport const z = 1;\n"
    ),
    "src/b.js": "export function b() {}\n",
    "go/m.go": "package m\n\n// sum adds; it calls lostHelper() first\nfunc sum(a int) int {\n\treturn a\n}\n",
}
EXPECTED = {
    ("stale-symbol-ref", "pkg/core.py", 12), ("stale-symbol-ref", "go/m.go", 3), ("fragile-anchor", "pkg/core.py", 16), ("fragile-anchor", "pkg/core.py", 17),
    ("number-drift", "pkg/core.py", 7), ("stale-file-ref", "pkg/cli.py", 9), ("stale-import", "pkg/cli.py", 1), ("stale-import", "pkg/cli.py", 2),
    ("stale-import", "src/a.js", 1), ("stale-import", "src/a.js", 2), ("stale-import", "src/a.js", 6), ("stale-import", "src/a.js", 7),
    ("stale-mock-ref", "tests/test_core.py", 2), ("stale-entrypoint", "pyproject.toml", 6), ("stale-entrypoint", "package.json", 1),
    ("stale-doc-ref", "README.md", 6), ("unclosed-fence", "README.md", 13), ("stale-contract-ref", "pkg/cli.py", 7), ("stale-contract-ref", "pkg/cli.py", 8),
    ("ghost-export", "pkg/core.py", 18), ("ghost-export", "go/m.go", 4), ("phantom-package", "pkg/core.py", 3), ("phantom-package", "src/a.js", 3),
    ("slop-package", "pkg/core.py", 3), ("stale-api-ref", "pkg/args.py", 6), ("stale-cli-flag", "README.md", 10), ("stale-cli-ref", "README.md", 10),
}


@pytest.fixture(scope="module")
def base(spark):
    b = FactBase(trees.from_dict(spark, TREE))
    yield b
    b.close()


@pytest.fixture(scope="module")
def found(spark, base):
    registry = spark.createDataFrame([("py", "requests", True, 9e5), ("py", "pyyaml", False, None)], "kind string, dist string, exists boolean, age_hours double")
    spec = spark.createDataFrame([("demo", None, "--fast", False)], "program string, command string, flag string, takes_value boolean")
    out = R.scan(base, ["all"], registry=registry, spec=spec).persist()
    yield out
    out.unpersist()


def test_scan_finds_exactly_the_planted(found):
    got = {(r.checker, r.path, r.line) for r in found.collect()}
    assert got - EXPECTED == set()
    assert EXPECTED - got == set()


def test_point_queries(base, found):
    claims = {(r.claim, r.verdict) for r in R.check_text(base, "Use `run()` and `nope()` from pkg/core.py or pkg/zzz.py").collect()}
    assert claims == {("run", "known"), ("nope", "unknown"), ("pkg/core.py", "known"), ("pkg/zzz.py", "unknown")}
    radius = {r.kind: r.paths for r in R.blast_radius(base, "run").collect()}
    assert radius["defined_in"] == ["pkg/core.py"] and "pkg/cli.py" in radius["imported_by"]
    assert R.check_path(found, "pkg").first()["lie"] > 0
    assert R.check_path(found, "nowhere").first()["status"] == 0


def test_reports(found, tmp_path, spark):
    import json

    assert len(json.loads(reports.to_json(found))) == found.count()
    sarif = json.loads(reports.to_sarif(found))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == found.count()
    assert "| lie |" in reports.to_markdown(found) and "<table>" in reports.to_html(found)
    assert "stale-import" in reports.to_terminal(found)
    assert reports.to_terminal(found.limit(0)) == "clean\n" and "failed" in reports.to_terminal(found.limit(0), errors=1)
    reports.write_baseline(found, str(tmp_path / "base"))
    again = reports.read_baseline(spark, str(tmp_path / "base"))
    assert post.split_baseline(found, again).filter("not baselined").count() == 0
    assert post.introduced(found, found).count() == 0


def test_suppression_and_registry(spark, base, found):
    marks = spark.createDataFrame([("pkg/core.py", 12, "# proofline: ignore=stale-symbol-ref"), ("pkg/core.py", 3, "# proofline: ignore=nope")], "path string, lineno int, line string")
    m = post.markers(marks)
    assert post.suppressed(found, m).filter("suppressed").count() == 1
    assert [r.rule for r in post.unknown_markers(m, list(R.REGISTRY)).collect()] == ["nope"]
    with pytest.raises(ValueError):
        R.enabled(["no-such-rule"])
    assert R.enabled(None, ["all"]) == [k for k, r in R.REGISTRY.items() if r.default]
    assert R.explain(spark).count() == 16


def test_repartition_does_not_matter(spark, found):
    b = FactBase(trees.from_dict(spark, TREE).repartition(5), keep=True)
    again = {(r.checker, r.path, r.line, r.title) for r in R.scan(b, ["fragile-anchor", "number-drift", "unclosed-fence", "stale-symbol-ref"]).collect()}
    b.close()
    kept = {(r.checker, r.path, r.line, r.title) for r in found.filter("checker in ('fragile-anchor','number-drift','unclosed-fence','stale-symbol-ref')").collect()}
    assert again == kept


def test_hints(spark):
    claims = spark.createDataFrame([("", "fetch_user"), ("", "zzzz")], "repo string, claim string")
    names = spark.createDataFrame([("", "fetch_users"), ("", "fetch_usr"), ("", "other")], "repo string, name string")
    assert {(r.claim, r.name) for r in R.did_you_mean(claims, names).collect()} == {("fetch_user", "fetch_users"), ("fetch_user", "fetch_usr")}


def test_hints_miss_nothing(spark, monkeypatch):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abc_") for _ in range(rng.randrange(1, 14))) for _ in range(250)} | {"abcdef", "xabycdzef", "é", ""})
    for cutoff in (0.75, 0.8):
        got = {(a, b) for a, b, _ in R.close_pairs(names, names, cutoff, None, False, True)}
        assert got == {(a, b) for a in names for b in names if difflib.SequenceMatcher(None, a, b).ratio() >= cutoff}
    monkeypatch.setattr(R, "CLAIM_CELL", 60)
    monkeypatch.setattr(R, "SYMBOL_CELL", 90)
    n = spark.createDataFrame([(r, x) for r in ("1", "2") for x in names[:: int(r)]] + [("1", None), (None, "abc")], "repo string, name string")
    got = sorted((r.repo, r.claim, r.rank, r.name) for r in R.did_you_mean(n.withColumnRenamed("name", "claim"), n, others=True).collect())
    want = [
        (r, x, k + 1, y) for r in ("1", "2") for x in names[:: int(r)]
        for k, y in enumerate(difflib.get_close_matches(x, [z for z in names[:: int(r)] if z != x], 2, 0.8))
    ]
    assert got == sorted(want)


def test_moved_names(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "file_id long, repo_id int").write.parquet(str(tmp_path / "file_facts.parquet"))
    names = [(1, "load_rows"), (1, "load_row"), (1, "load_rowz"), (1, "sort"), (2, "load_rows")]
    spark.createDataFrame(names, "file_id long, name string").write.parquet(str(tmp_path / "func_info.parquet"))
    got = {(r.repo, r.claim, r.name) for r in queries_rules.moved_names(spark, str(tmp_path)).collect()}
    three = ["load_rows", "load_row", "load_rowz"]
    assert got == {("7", a, b) for a in three for b in three if a != b}


def test_empty_and_null_files(spark):
    files = spark.createDataFrame([("", "a.py", None), ("", None, "x"), ("", "b.py", ""), (None, "c.md", "")], "repo string, path string, text string")
    b = FactBase(files)
    assert R.scan(b, ["fragile-anchor", "unclosed-fence", "number-drift"]).count() == 0
    assert b.errors().count() == 0
    b.close()
