"""Sources: source trees, tables of files, diffs, manifests, routes and alias maps, all as DataFrames.

File tables have the columns repo, path, text. Paths are relative, with forward slashes.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.functions import words as W

#: Line ends as Python's ``splitlines`` knows them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _segments(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))


def kept(files: DataFrame, ignore_dirs: frozenset[str] = W.IGNORED_DIRS, ignore_files: frozenset[str] = W.IGNORED_FILES) -> DataFrame:
    """Without ignored directories, lock files and minified bundles. A directory named like build output is kept
    where it is a Python package (it holds ``__init__.py``): a semi-join on directories, not a walk."""
    output = ["build", "dist", "out", "coverage"]
    hard = [d for d in ignore_dirs if d not in output]
    soft = [d for d in output if d in ignore_dirs]
    seg = _segments(F.col("path"))
    base = files.filter(
        ~F.arrays_overlap(F.coalesce(seg, F.array().cast("array<string>")), F.array(*[F.lit(d) for d in hard]))
        & ~F.element_at(F.split("path", "/"), -1).isin(*ignore_files)
        & ~F.col("path").rlike(r"\.min\.[cm]?js$")
    )
    if not soft:
        return base
    packages = (
        files.filter(F.col("path").rlike(r"(^|/)(" + "|".join(soft) + r")/__init__\.py$"))
        .select("repo", F.regexp_extract("path", r"^(.*)/__init__\.py$", 1).alias("_pkg")).distinct()
    )
    holder = F.regexp_extract("path", r"^((?:[^/]+/)*?(?:" + "|".join(soft) + r"))/", 1)
    inside = base.withColumn("_pkg", holder)
    free = inside.filter("_pkg = ''").drop("_pkg")
    package = inside.filter("_pkg <> ''").join(packages, ["repo", "_pkg"], "left_semi").drop("_pkg")
    return free.unionByName(package)


def read_tree(spark: SparkSession, root: str, repo: str = "", ignore_dirs: frozenset[str] = W.IGNORED_DIRS) -> DataFrame:
    """A source tree: the driver walks the directories, leaving ignored ones out, and the executors read the files.

    The file readers of Spark skip names that begin with ``_`` or ``.``, which would lose every ``__init__.py``;
    the walk therefore lists names itself. ``root`` is a path or URI that all executors reach. Bytes that are no
    UTF-8 are dropped.
    """
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    hard = ignore_dirs - {"build", "dist", "out", "coverage"}
    names, todo = [], [base]
    while todo:
        for info in where.get_file_info(fs.FileSelector(todo.pop())):
            if info.type == fs.FileType.Directory:
                if info.base_name not in hard:
                    todo.append(info.path)
            elif info.extension.lower() in W.CODE_SUFFIXES or info.base_name == ".gitignore":
                names.append((info.path[len(base) :].lstrip("/"),))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, at = fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
        for f in frames:
            texts = []
            for p in f["path"]:
                with here.open_input_stream(f"{at}/{p}") as stream:
                    texts.append(stream.read().decode("utf-8", "ignore"))
            yield pd.DataFrame({"repo": repo, "path": f["path"], "text": texts})

    listed = spark.createDataFrame(names, "path string")
    parts = max(1, min(len(names) // 200 + 1, 10_000))
    return kept(listed.repartition(parts).mapInPandas(read, "repo string, path string, text string"), ignore_dirs)


def from_file_facts(file_facts: DataFrame) -> DataFrame:
    """The table of files as a file table: the latest delivery of each (repo_id, path)."""
    row = F.struct(F.col("file_id"), F.col("lines"))
    return (
        file_facts.filter(F.col("path").isNotNull() & F.col("lines").isNotNull())
        .groupBy(F.col("repo_id").cast("string").alias("repo"), "path")
        .agg(F.max_by(row, F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-1))).alias("r"))
        .select("repo", "path", F.array_join("r.lines", "\n", "").alias("text"))
    )


def from_dict(spark: SparkSession, tree: dict[str, str], repo: str = "") -> DataFrame:
    """A small tree given in place, for tests and examples."""
    return spark.createDataFrame([(repo, p, t) for p, t in sorted(tree.items())], "repo string, path string, text string")


def lines_of(files: DataFrame) -> DataFrame:
    """(repo, path, lineno, line), without the empty piece behind a last line end."""
    parts = F.split("text", LINE_END, -1)
    trimmed = F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("repo", "path", F.posexplode(trimmed).alias("pos", "line")).select(
        "repo", "path", (F.col("pos") + 1).alias("lineno"), "line"
    )


def parse_diff(lines: DataFrame) -> DataFrame:
    """(path, line) of added lines in unified diffs, from a table (diff_id, lineno, line).

    The current file and hunk are the last headers above a line: two windows, no state machine.
    """
    w = Window.partitionBy("diff_id").orderBy("lineno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.regexp_extract("line", r"^\+\+\+ (?:\"?b/)?(.*?)\"?\t?$", 1)
    hunk = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    is_add = F.col("line").startswith("+") & ~F.col("line").rlike(r"^\+\+\+ ")
    marked = lines.select(
        "diff_id", "lineno", "line",
        F.last(F.when(F.col("line").rlike(r"^\+\+\+ "), head), True).over(w).alias("path"),
        F.last(F.when(hunk != "", hunk.cast("int")), True).over(w).alias("start"),
        F.sum(F.when(hunk != "", 1).otherwise(0)).over(w).alias("hunk_no"),
        is_add.alias("add"), F.col("line").rlike(r"^ ").alias("same"),
    )
    g = Window.partitionBy("diff_id", "hunk_no").orderBy("lineno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("start") + F.sum(F.when(F.col("add") | F.col("same"), 1).otherwise(0)).over(g) - 1
    return marked.withColumn("at", at).filter("add and hunk_no > 0 and path <> '/dev/null'").select("path", F.col("at").cast("int").alias("line"))


def name_status(lines: DataFrame) -> DataFrame:
    """(status, path) of lines such as ``M<tab>path``."""
    return lines.select(
        F.regexp_extract("line", r"^([AMD])\t", 1).alias("status"), F.regexp_extract("line", r"^[AMD]\t\"?(.*?)\"?$", 1).alias("path")
    ).filter("status <> ''")


# Manifests


def dist_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.strip()).lower()


_INCLUDE = re.compile(r"\s*(?:-r|-c|--requirement|--constraint)[ =]\s*(\S+)")


def _requirement(line: str) -> str | None:
    m = re.match(r"\s*([A-Za-z0-9][\w.\-]*)", line)
    return dist_name(m[1]) if m and not line.lstrip().startswith(("#", "-")) else None


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, ValueError, RecursionError):
        return {}


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    out = re.sub(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text)
    return re.sub(r'("(?:[^"\\\n]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], out)


def _json(text: str) -> dict:
    try:
        got = json.loads(strip_jsonc(text))
        return got if isinstance(got, dict) else {}
    except (ValueError, RecursionError):
        return {}


def manifest_rows(path: str, text: str) -> list[tuple[str, str, str, str | None, int]]:
    """(dir, fact, name, value, line) of a manifest: dependencies, programs, entry points, own name, aliases."""
    name, where = path.rsplit("/", 1)[-1], path.rsplit("/", 1)[0] if "/" in path else ""
    rows: list[tuple[str, str, str, str | None, int]] = []
    lines = text.split("\n")

    def line_of(what: str) -> int:
        return next((n for n, x in enumerate(lines, 1) if what in x), 1)

    if name == "pyproject.toml":
        doc = _toml(text)
        project = doc.get("project") if isinstance(doc.get("project"), dict) else {}
        poetry = doc.get("tool", {}).get("poetry", {}) if isinstance(doc.get("tool"), dict) else {}
        rows.append((where, "manifest", "python", None, 1))
        deps = list(project.get("dependencies") or [])
        for group in (project.get("optional-dependencies") or {}).values():
            deps += group
        # groups may include each other; every group counts, so that an include adds nothing
        for group in (doc.get("dependency-groups") or {}).values():
            deps += [d for d in group if isinstance(d, str)]
        deps += (doc.get("build-system") or {}).get("requires") or []
        for table in [poetry.get("dependencies"), poetry.get("dev-dependencies"), *(g.get("dependencies") for g in (poetry.get("group") or {}).values() if isinstance(g, dict))]:
            deps += list(table or [])
        rows += [(where, "py_dep", r, None, 1) for d in deps if isinstance(d, str) and (r := _requirement(d))]
        own = project.get("name") or poetry.get("name")
        if isinstance(own, str):
            rows.append((where, "own", own, None, 1))
        for key in ("scripts", "gui-scripts"):
            for prog, target in (project.get(key) or {}).items():
                rows += [(where, "program", prog, None, line_of(prog)), (where, "entry_py", prog, str(target), line_of(str(target)))]
        for prog, target in (poetry.get("scripts") or {}).items():
            rows += [(where, "program", prog, None, line_of(prog)), (where, "entry_py", prog, str(target), line_of(str(target)))]
    elif re.fullmatch(r"requirements[\w.-]*\.txt", name) or re.search(r"(?:^|/)(?:requirements|reqs?)/[^/]+\.txt$", path) or name in ("base.txt", "dev.txt", "test.txt"):
        rows.append((where, "manifest", "python", None, 1))
        rows += [(where, "py_dep", r, None, n) for n, x in enumerate(lines, 1) if (r := _requirement(x))]
        rows += [(where, "include", m[1], None, n) for n, x in enumerate(lines, 1) if (m := _INCLUDE.match(x))]
    elif name in ("setup.py", "setup.cfg"):
        rows.append((where, "manifest", "python", None, 1))
        for block in re.findall(r"(?:install_requires|extras_require|setup_requires|tests_require)\s*=\s*(?:\[([^\]]*)\]|((?:\n[ \t]+.*)+))", text):
            for x in re.findall(r"[\"']([^\"']+)[\"']", block[0]) or block[1].split("\n"):
                if r := _requirement(x):
                    rows.append((where, "py_dep", r, None, 1))
        rows += [(where, "program", m[1], None, 1) for m in re.finditer(r"[\"']?\s*([\w-]+)\s*=\s*[\w.]+:[\w.]+", text)]
    elif name == "package.json":
        doc = _json(text)
        rows.append((where, "manifest", "js", None, 1))
        for key in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            rows += [(where, "js_dep", d, None, 1) for d in (doc.get(key) or {})] if isinstance(doc.get(key), dict) else []
        if isinstance(doc.get("name"), str):
            rows.append((where, "own", doc["name"], None, 1))
        entries = doc.get("bin")
        entries = {doc.get("name", ""): entries} if isinstance(entries, str) else entries if isinstance(entries, dict) else {}
        for prog, target in entries.items():
            if isinstance(target, str):
                rows += [(where, "program", prog.rsplit("/", 1)[-1], None, 1), (where, "entry_js", "bin", target, line_of(target))]
        browser = doc.get("browser")
        rows += [(where, "browser", k, None, 1) for k in browser if k.startswith(".")] if isinstance(browser, dict) else []
        if isinstance(doc.get("main"), str):
            rows.append((where, "entry_js", "main", doc["main"], line_of(doc["main"])))
    elif re.fullmatch(r"tsconfig[\w.-]*\.json", name):
        doc = _json(text)
        options = doc.get("compilerOptions") or {}
        base = options.get("baseUrl") or "."
        if isinstance(doc.get("extends"), str):
            rows.append((where, "extends", doc["extends"], None, 1))
        rows += [(where, "exclude", re.sub(r"^\./|/?\*+.*$|/$", "", x), None, 1) for x in doc.get("exclude") or [] if isinstance(x, str)]
        for prefix, repl in (options.get("paths") or {}).items() if isinstance(options.get("paths"), dict) else ():
            rows += [(where, "alias", prefix, re.sub(r"^\./", "", f"{base}/{r}".replace("./", "")), k) for k, r in enumerate(repl) if isinstance(r, str)]
    elif name.endswith(".json"):
        doc = _json(text) if _SPEC.search(text) else {}
        if "openapi" in doc or "swagger" in doc:
            rows += [(where, "route", p, None, 1) for p in doc["paths"]] if isinstance(doc.get("paths"), dict) else []
    elif name == ".gitignore":
        for n, x in enumerate(lines, 1):
            x = x.strip()
            if x and not x.startswith("#"):
                rows.append((where, "ignore", x, None, n))
    elif re.search(r"(?:^|/)cmd/([\w-]+)/main\.go$", path):
        rows.append((where, "program", path.split("/")[-2], None, 1))
    return rows


_MANIFESTS = r"(?:^|/)(?:pyproject\.toml|requirements[\w.-]*\.txt|setup\.py|setup\.cfg|package\.json|tsconfig[\w.-]*\.json|(?:(?:requirements|reqs?)/[^/]+|base|dev|test)\.txt|\.gitignore|cmd/[\w-]+/main\.go)$"
#: What a description of an interface says of itself, whatever its file is called.
_SPEC = re.compile(r'"(?:openapi|swagger)"\s*:')
_ROWS = "repo string, dir string, fact string, name string, value string, line int, path string"


def manifests(files: DataFrame) -> DataFrame:
    """(repo, dir, fact, name, value, line, path): what the manifests of a tree declare."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, *row, p) for r, p, t in zip(f["repo"], f["path"], f["text"]) for row in manifest_rows(p, t)]
            yield pd.DataFrame(rows, columns=["repo", "dir", "fact", "name", "value", "line", "path"])

    return files.select("repo", "path", "text").filter(
        F.col("text").isNotNull() & (F.col("path").rlike(_MANIFESTS) | (F.col("path").endswith(".json") & F.col("text").rlike(_SPEC.pattern)))
    ).mapInPandas(read, _ROWS)


def inherited_aliases(rows: DataFrame, depth: int = 3) -> DataFrame:
    """(repo, zone, name, value): aliases of each TypeScript configuration, its own or else the nearest ancestor's.

    ``extends`` is followed for ``depth`` steps, so that a cycle ends; a child's ``paths`` replace its parent's.
    """
    conf = rows.filter(F.col("path").rlike(r"tsconfig[\w.-]*\.json$"))
    own = rows.filter("fact = 'alias'").select("repo", "path", "dir", "name", "value")
    up = conf.filter("fact = 'extends' and name like '.%'").select(
        "repo", "path", "dir", F.regexp_replace(F.concat_ws("/", F.nullif("dir", F.lit("")), F.when(F.col("name").endswith(".json"), F.col("name")).otherwise(F.concat("name", F.lit(".json")))), r"(^|/)\./", "$1").alias("parent")
    )
    for _ in range(2):  # fold "a/../"
        up = up.withColumn("parent", F.regexp_replace("parent", r"(^|/)(?!\.\.)[^/]+/\.\./", "$1"))
    out, chain = own.withColumn("step", F.lit(0)), up
    for step in range(1, depth + 1):
        got = chain.select("repo", "path", "dir", F.col("parent").alias("_p")).join(
            own.select("repo", F.col("path").alias("_p"), "name", "value"), ["repo", "_p"]
        )
        out = out.unionByName(got.select("repo", "path", "dir", "name", "value").withColumn("step", F.lit(step)))
        chain = chain.join(up.select("repo", F.col("path").alias("parent"), F.col("parent").alias("next")), ["repo", "parent"]).select(
            "repo", "path", "dir", F.col("next").alias("parent")
        )
    nearest = Window.partitionBy("repo", "path").orderBy("step")
    return out.withColumn("_r", F.dense_rank().over(nearest)).filter("_r = 1").select("repo", F.col("dir").alias("zone"), "name", "value").distinct()


def ignore_pattern(base: str, pattern: str) -> tuple[str, bool]:
    """(regular expression over repository paths, negated) of a line of an ignore file."""
    negated = pattern.startswith("!")
    p = pattern[1:] if negated else pattern
    only_dir, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    body = "/".join(".*" if s == "**" else re.sub(r"^\(\?s:(.*)\)\\z$", r"\1", fnmatch.translate(s).replace("\\Z", "\\z")).replace(".*", "[^/]*") for s in p.split("/"))
    prefix = re.escape(base + "/") if base else ""
    return f"^{prefix}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", negated


@F.udf(T.StringType())
def _pattern_of(base, pattern):
    return ignore_pattern(base or "", pattern)[0]


def gitignored(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """(repo, path) of paths that an ignore file in an ancestor excludes; the last matching pattern decides."""
    rules = rows.filter("fact = 'ignore'").select(
        "repo", F.col("dir").alias("base"), "line", F.col("name").startswith("!").alias("negated"), _pattern_of("dir", "name").alias("regex")
    )
    return (
        paths.select("repo", "path").distinct().join(rules, "repo").filter(F.expr("path rlike regex"))
        .groupBy("repo", "path").agg(F.max_by("negated", F.struct(F.length("base"), F.col("line"))).alias("negated"))
        .filter("not negated").select("repo", "path")
    )
