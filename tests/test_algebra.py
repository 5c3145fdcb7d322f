"""Algebra, sources and incremental processing against plain Python."""

import random

import pytest

from proofline.functions.extract import fences
from proofline.operators import algebra as A
from proofline.operators import incremental as inc
from proofline.operators import post
from proofline.sources import trees
from proofline.streaming.watch import NewFindings, TreeWatch


def test_band_and_span_join(spark):
    rng = random.Random(1)
    left = [(k, rng.randrange(100)) for k in "ab" for _ in range(40)]
    right = [(k, rng.randrange(100)) for k in "ab" for _ in range(40)]
    l = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(left)], "k string, i int, at int")
    r = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(right)], "k string, j int, pos int").withColumnRenamed("i", "j")
    got = sorted((x.i, x.j) for x in A.band_join(l, r, ["k"], "at", "pos", 3, 2).collect())
    want = sorted((i, j) for i, (k, v) in enumerate(left) for j, (m, w) in enumerate(right) if k == m and v - 3 <= w <= v + 2)
    assert got == want
    spans = l.selectExpr("k", "i", "at as lo", "at + 70 as hi")
    got = sorted((x.i, x.j) for x in A.span_join(spans, "lo", "hi", r, "pos", ["k"]).collect())
    assert got == sorted((i, j) for i, (k, v) in enumerate(left) for j, (m, w) in enumerate(right) if k == m and v <= w <= v + 70)


def test_small_helpers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert {(r.node, r.depth) for r in A.closure(e, roots, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    new = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, o int")
    old = spark.createDataFrame([("x", 9)], "k string, o int")
    assert sorted(r.o for r in A.bag_diff(new, old, ["k"], ["o"]).collect()) == [2, 3]
    runs = A.islands(spark.createDataFrame([("f", n) for n in (1, 2, 3, 7, 8)], "p string, n int"), ["p"], "n").groupBy("island").count()
    assert sorted(r["count"] for r in runs.collect()) == [2, 3]
    p = spark.createDataFrame([("a/b/c.py",)], "p string").select(A.prefixes("p" and A.F.col("p")).alias("x"), A.suffixes(A.F.col("p")).alias("y")).first()
    assert p.x == ["a", "a/b"] and p.y == ["a/b/c.py", "b/c.py", "c.py"]
    assert A.ref_anti(spark.createDataFrame([(1,), (None,), (3,)], "a int"), "a", spark.createDataFrame([(1,)], "b int"), "b").collect()[0].a == 3


def test_diff_source(spark):
    diff = ["diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -1,2 +3,3 @@", " same", "+new", "-old", "+more", "@@ -9 +20 @@", "+last", "--- a/gone.py", "+++ /dev/null", "@@ -1 +0,0 @@", "-x"]
    lines = spark.createDataFrame([("d", n, x) for n, x in enumerate(diff)], "diff_id string, lineno int, line string")
    assert sorted((r.path, r.line) for r in trees.parse_diff(lines).collect()) == [("x.py", 4), ("x.py", 5), ("x.py", 20)]
    st = trees.name_status(spark.createDataFrame([("M\ta b.py",), ("noise",)], "line string")).collect()
    assert [(r.status, r.path) for r in st] == [("M", "a b.py")]


def test_tree_source(spark, tmp_path):
    for p, t in {"a.py": "x = 1\n", "build/lib.py": "y\n", "build/__init__.py": "", "node_modules/m.js": "", "dist/o.js": "", "k.min.js": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = sorted(r.path for r in trees.read_tree(spark, str(tmp_path)).collect())
    assert got == ["a.py", "build/__init__.py", "build/lib.py"]


def test_manifests_and_ignores(spark):
    rows = trees.manifest_rows("web/package.json", '{"name": "w", "bin": "cli.js", "devDependencies": {"@a/b": "1"}} // c')
    assert ("web", "js_dep", "@a/b", None, 1) in rows and any(r[1] == "entry_js" for r in rows)
    assert trees.manifest_rows("pyproject.toml", "not [ toml") == [("", "manifest", "python", None, 1)]
    files = trees.from_dict(spark, {".gitignore": "out/\n*.log\n!keep.log\n", "a.py": ""})
    paths = spark.createDataFrame([("", "out/x"), ("", "b.log"), ("", "keep.log"), ("", "a.py")], "repo string, path string")
    assert sorted(r.path for r in trees.gitignored(paths, trees.manifests(files)).collect()) == ["b.log", "out/x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("```py\nx\n```\n", [(1, 3)]), ("```\nx\n", [(1, None)]), ("~~~~\n```\n~~~~\n", [(1, 3)]), ("```a`b\n", []),
        ("    ```\nx\n", []), ("````\n```\n````\n", [(1, 3)]), ("", []),
    ],
)
def test_fences(text, want):
    assert [(f["open"], f["close"]) for f in fences(text.split("\n"))] == want


def test_pending_paths_against_brute_force(spark):
    rng = random.Random(3)
    rows, runs = [], []
    for n in range(400):
        t = rng.randrange(10**6)
        rows.append((n, rng.choice([1, 2, None]), rng.choice(["a.py", "./a.py", "d//b.py", "d/b.py", None, "c"]), rng.choice(["x", "y", None]), t, t + rng.randrange(10**5)))
    for n in range(12):
        runs.append((n, rng.choice([1, 2]), rng.randrange(10**6), rng.choice(["ok", "failed", None])))
    changes = spark.createDataFrame(rows, "change_id long, repo_id int, path string, sha string, c long, a long").selectExpr(
        "change_id", "repo_id", "path", "sha", "timestamp_seconds(c) as changed_at", "timestamp_seconds(a) as arrived_at", "1 as cutoff"
    )
    table = spark.createDataFrame(runs, "run_id long, repo_id int, c long, outcome string").selectExpr("run_id", "repo_id", "timestamp_seconds(c) as cutoff_at", "outcome")
    cut = {}
    for _, repo, c, o in runs:
        if o == "ok":
            cut[repo] = max(cut.get(repo, -1), c)
    known, current = {}, {}
    for n, repo, path, sha, c, a in sorted(rows, key=lambda r: (r[4], r[0])):
        if repo is None or path is None:
            continue
        k = (repo, path.replace("//", "/").removeprefix("./"))
        current[k] = sha
        if a <= cut.get(repo, -1):
            known[k] = sha
    want = {k for k in current if current[k] != known.get(k)}
    assert {(r.repo_id, r.path) for r in inc.pending_paths(changes, table).collect()} == want
    assert inc.pending_paths(changes.limit(0), table).count() == 0


def test_incremental_run_survives_a_crash(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    run = inc.IncrementalRun(spark, str(tmp_path / "run"))
    work = lambda p: p.select("path")
    with pytest.raises(RuntimeError):
        run.run(inc.list_inputs(spark, str(src)), work, fail_before_commit=True)
    assert run.results() is None
    first = run.run(inc.list_inputs(spark, str(src)), work)
    assert first and run.results().count() == 1
    assert run.run(inc.list_inputs(spark, str(src)), work) is None
    (src / "a.txt").write_text("two")
    (src / "b.txt").write_text("three")
    assert run.run(inc.list_inputs(spark, str(src)), work) != first
    assert run.results().count() == 3 and run.manifest().count() == 3


def test_incremental_run_sees_returns_and_deletions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = inc.IncrementalRun(spark, str(tmp_path / "run"))
    seen = []

    def step():
        def work(p):
            seen.append(sorted((r.path.rsplit("/", 1)[1], r.checksum is None) for r in p.collect()))
            return p.select("path")

        return run.run(inc.list_inputs(spark, str(src)), work)

    (src / "b.txt").write_text("stays")
    batches = []
    for text in ("A", "B", "A"):
        (src / "a.txt").write_text(text)
        batches += [step()]
        assert step() is None
    (src / "a.txt").unlink()
    batches += [step()]
    assert step() is None
    (src / "a.txt").write_text("A")
    batches += [step()]
    assert step() is None
    a = ("a.txt", False)
    assert seen == [[a, ("b.txt", False)], [a], [a], [("a.txt", True)], [a]]
    assert len(set(batches)) == 5 and run.results().count() == 6


def test_incremental_run_misses_no_change_during_a_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("old")
    run = inc.IncrementalRun(spark, str(tmp_path / "run"))
    listing = lambda: inc.list_inputs(spark, str(src), manifest=run.manifest())

    def work(p):
        rows = [(r.path, (src / "a.txt").read_text()) for r in p.collect()]
        (src / "a.txt").write_text("new content")
        return spark.createDataFrame(rows, "path string, text string")

    assert run.run(listing(), work)
    read = lambda p: spark.createDataFrame([(r.path, (src / "a.txt").read_text()) for r in p.collect()], "path string, text string")
    assert run.run(listing(), read)
    assert sorted(r.text for r in run.results().collect()) == ["new content", "old"]
    assert run.run(listing(), read) is None


def test_unchanged_files_are_not_read(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    first = inc.list_inputs(spark, str(src)).collect()
    known = spark.createDataFrame([(r.path, r.size, r.modified, "kept as it was", 1) for r in first], "path string, size long, modified long, checksum string, seq long")
    (src / "b.txt").write_text("three")
    got = {r.path.rsplit("/", 1)[1]: r.checksum for r in inc.list_inputs(spark, str(src), manifest=known).collect()}
    assert got["a.txt"] == "kept as it was" and len(got["b.txt"]) == 64


def test_a_number_is_committed_once(spark, tmp_path):
    entries = spark.createDataFrame([("a", 1, 1, "x")], "path string, size long, modified long, checksum string")
    run = inc.IncrementalRun(spark, str(tmp_path / "run"))
    run._commit(entries, "one", 1)
    with pytest.raises(RuntimeError):
        run._commit(entries, "two", 1)
    assert run.commits() == [1] and [r.batch for r in run.manifest().collect()] == ["one"]


def test_repositories_do_not_speak_for_each_other(spark):
    rows = [(r, "a.py", 12, 12, "c", "lie", "t", "x", "", "", 0.5) for r in ("A", "B")]
    f = spark.createDataFrame(rows, "repo string, path string, line int, end_line int, checker string, severity string, title string, claim string, evidence string, fix string, confidence double")
    lines = spark.createDataFrame([("A", "a.py", 12, "x  # proofline: ignore=c")], "repo string, path string, lineno int, line string")
    assert {r.repo: r.suppressed for r in post.suppressed(f, post.markers(lines)).collect()} == {"A": True, "B": False}
    only_a = f.filter("repo = 'A'")
    assert [r.repo for r in post.introduced(f, only_a).collect()] == ["B"]
    assert {r.repo: r.baselined for r in post.split_baseline(f, post.baseline_of(only_a)).collect()} == {"A": True, "B": False}
    hunks = spark.createDataFrame([("B", "a.py", 12)], "repo string, path string, line int")
    none = spark.createDataFrame([], "repo string, path string, name string")
    assert [r.repo for r in post.changed(f, hunks, none, none).collect()] == ["B"]
    assert post.dedupe(f.unionByName(f)).count() == 2


def test_watch_reports_new_findings_once(spark, tmp_path):
    f = lambda rows: spark.createDataFrame([(p, 1, 1, "c", "lie", t, t, "", "", 0.5) for p, t in rows], post.FINDING_SCHEMA)
    seen = NewFindings(spark, str(tmp_path / "s"))
    assert seen.accept(f([("a", "x"), ("a", "x")]), 0).count() == 1
    assert seen.accept(f([("a", "x"), ("b", "y")]), 1).count() == 1
    assert seen.accept(f([("a", "x"), ("b", "y")]), 1).count() == 1  # a repeated attempt reports the same


def test_tree_watch(spark, tmp_path):
    w = TreeWatch(spark, str(tmp_path / "t"), ["fragile-anchor"])
    v = lambda rows: spark.createDataFrame(rows, "repo string, path string, text string")
    assert w.step(v([("", "a.py", "# see line 3\n")]), 0).count() == 1
    assert w.step(v([("", "b.py", "# see line 4\n")]), 1).count() == 1
    assert w.step(v([("", "b.py", None)]), 2).count() == 0


def test_gate(spark):
    f = spark.createDataFrame([("a", 1, 1, "c", "LIE", "t", "x", "", "", 0.5)], post.FINDING_SCHEMA)
    assert post.gate(f).first()["status"] == 1 and post.gate(f.limit(0)).first()["status"] == 0
    err = spark.createDataFrame([("extract", "a", "m"), ("extract", "b", "m")], "checker string, path string, message string")
    assert post.gate(f, errors=err).first()["status"] == 3
    assert post.error_summary(err).first()["more"] == 1
    sc = post.scores(f, f).first()
    assert (sc.tp, sc.fp, sc.fn) == (1, 0, 0)
    assert post.baseline_change(post.baseline_of(f.limit(0)), post.baseline_of(f)).first().asDict() == {"added": 1, "removed": 0, "total": 1}
