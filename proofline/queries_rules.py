"""The rules and point queries over the table of files, each over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline import queries_cases
from proofline.operators import algebra as A
from proofline.operators import post
from proofline.operators.facts import FactBase
from proofline.plans import rules as R
from proofline.session import table
from proofline.sources import trees

_bases: dict[tuple[str, str], FactBase] = {}


def fact_base(spark, d: str) -> FactBase:
    """One fact base an application and table, so that the rules share its extraction."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _bases:
        _bases[key] = FactBase(trees.from_file_facts(table(spark, d, "file_facts")))
    return _bases[key]


def scan_summary(spark, d):
    """Findings of the default rules over the table of files, by checker and severity."""
    return R.scan(fact_base(spark, d)).groupBy("checker", "severity").agg(F.count("*").alias("n"))


def scan_opt_in(spark, d):
    """Findings of the other rules over the table of files; the registry and the specification are those of the cases."""
    other = [k for k, r in R.REGISTRY.items() if not r.default]
    return R.scan(fact_base(spark, d), other, registry=queries_cases.registry(spark), spec=queries_cases.spec(spark)).groupBy("checker", "severity").agg(
        F.count("*").alias("n")
    )


def symbols(spark, d):
    return fact_base(spark, d).relation("symbols").groupBy("language", "kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def impact(spark, d):
    """The twenty symbols with the most users: who defines and who imports them (a top-k report)."""
    e = fact_base(spark, d).edges()
    return (
        e.groupBy("repo", "symbol").agg(F.count_if(F.col("kind") == "imported_by").alias("importers"), F.count_if(F.col("kind") == "defined_in").alias("definers"))
        .orderBy(F.desc("importers"), "repo", "symbol").limit(20)
    )


def scanned_files(spark, d):
    """The files that a scan reads (list), by repository and ending."""
    f = trees.kept(trees.from_file_facts(table(spark, d, "file_facts")))
    return f.groupBy("repo", F.regexp_extract("path", r"\.(\w+)$", 1).alias("suffix")).agg(F.count("*").alias("files"))


def file_lines(spark, d):
    """Lines of all files by language."""
    return trees.lines_of(trees.from_file_facts(table(spark, d, "file_facts"))).groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("suffix")).agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters")
    )


def conflict_markers(spark, d):
    """Lines that begin with a conflict marker, by marker."""
    lines = table(spark, d, "file_facts").select("file_id", F.posexplode("lines").alias("pos", "line"))
    return lines.select("file_id", (F.col("pos") + 1).alias("lineno"), F.regexp_extract("line", r"^(<{7}|={7}|>{7}|\|{7})(?:\s|$)", 1).alias("marker")).filter(
        "marker <> ''"
    ).groupBy("marker").agg(F.count_distinct("file_id", "lineno").alias("lines"), F.count_distinct("file_id").alias("files"))


def changed_lines(spark, d):
    """Findings on a line that some change of their file touched (finding spans x hunk lines)."""
    c = table(spark, d, "changed_plan").select(
        "repo_id", trees_path("path").alias("path"), F.explode("hunks").alias("hunk_line")
    ).distinct()
    f = table(spark, d, "findings").select("finding_id", "repo_id", trees_path("path").alias("path"), "line", F.greatest("line", "end_line").alias("last"))
    return A.span_join(f, "line", "last", c, "hunk_line", ["repo_id", "path"]).select("finding_id").distinct()


def trees_path(c: str):
    p = F.translate(F.trim(c), "\\", "/")
    return F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), r"^(\./)+", "")


def baseline_split(spark, d):
    """Findings of the last batch by whether the earlier ones already had their fingerprint."""
    f = table(spark, d, "findings")
    base = post.baseline_of(f.filter("batch_id < 24"))
    return post.split_baseline(f.filter("batch_id = 24"), base).groupBy("baselined").agg(F.count("*").alias("n"))


def gate_status(spark, d):
    """Counts by severity and the status of a gate at ``lie``, per repository's table as a whole."""
    return post.gate(table(spark, d, "findings"))


def moved_names(spark, d):
    """For each name of a function, the two most similar other names of the same repository, of a ratio of 0.8 or more."""
    f = table(spark, d, "func_info").join(table(spark, d, "file_facts").select("file_id", "repo_id").distinct(), "file_id")
    n = f.select(F.col("repo_id").cast("string").alias("repo"), "name").distinct()
    return R.did_you_mean(n.withColumnRenamed("name", "claim"), n, 0.8, 2, others=True).select("repo", "claim", "name")


QUERIES = {
    f.__name__: f
    for f in (
        scan_summary, scan_opt_in, symbols, impact, scanned_files, file_lines, conflict_markers, changed_lines, baseline_split, gate_status, moved_names,
    )
}

_CLEAN = "regexp_replace(regexp_replace(replace(trim({c}), chr(92), '/'), '/{{2,}}', '/', 'g'), '^(\\./)+', '')"
_LATEST = "(SELECT repo_id, path, lines FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at DESC) AS rn FROM file_facts WHERE path IS NOT NULL AND lines IS NOT NULL) WHERE rn = 1)"
_FP = "substr(sha256('v1' || chr(0) || coalesce(repo_id::VARCHAR, '') || chr(0) || checker || chr(0) || path || chr(0) || coalesce(claim, '') || chr(0) || coalesce(title, '')), 1, 32)"
ORACLE = {
    "conflict_markers": "SELECT marker, count(DISTINCT (file_id, pos)) AS lines, count(DISTINCT file_id) AS files FROM (SELECT file_id, unnest(range(1, len(lines) + 1)) AS pos, "
    "regexp_extract(unnest(lines), '^(<{7}|={7}|>{7}|\\|{7})(?:\\s|$)', 1) AS marker FROM file_facts) WHERE marker <> '' GROUP BY 1",
    "changed_lines": f"SELECT DISTINCT finding_id FROM (SELECT finding_id, repo_id, {_CLEAN.format(c='path')} AS p, line, greatest(line, end_line) AS last FROM findings) f "
    f"JOIN (SELECT DISTINCT repo_id, {_CLEAN.format(c='path')} AS p, unnest(hunks) AS h FROM changed_plan) c ON f.repo_id = c.repo_id AND f.p = c.p AND h BETWEEN line AND last",
    "baseline_split": f"SELECT b IS NOT NULL AS baselined, count(*) AS n FROM (SELECT {_FP} AS fp FROM findings WHERE batch_id = 24) LEFT JOIN "
    f"(SELECT DISTINCT {_FP} AS b FROM findings WHERE batch_id < 24) ON fp = b GROUP BY 1",
    "gate_status": "SELECT count(*) FILTER (WHERE lower(severity) = 'lie') AS lie, count(*) FILTER (WHERE lower(severity) = 'drift') AS drift, "
    "count(*) FILTER (WHERE lower(severity) = 'smell') AS smell, count(*) FILTER (WHERE lower(severity) = 'lie') AS failing, 0::BIGINT AS errors, "
    "CASE WHEN count(*) FILTER (WHERE lower(severity) = 'lie') > 0 THEN 1 ELSE 0 END AS status FROM findings",
}
