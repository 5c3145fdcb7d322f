"""What happens to findings after the rules: dedupe, suppression, scope, baseline, change scoping and the gate.

A finding has the columns path, line, end_line, checker, severity, title, claim, evidence, fix, confidence, and its
repository in ``repo`` or ``repo_id``; tables without either are of one repository. The repository is part of every
identity: a marker, a baseline or a change of one repository says nothing about another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.operators import algebra as A

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
        T.StructField("checker", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("claim", T.StringType()), T.StructField("evidence", T.StringType()), T.StructField("fix", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
# Severities by rank, and their names in the exchange format.
SEVERITY_RANK = {"lie": 3, "drift": 2, "smell": 1}
FINGERPRINT_VERSION = "v1"


def severity_rank(c: Column | str = "severity") -> Column:
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    out = F.when(F.lit(False), 0)
    for name, rank in SEVERITY_RANK.items():
        out = out.when(c == name, rank)
    return out


def repo_of(df: DataFrame) -> Column:
    """The repository of a row as a string; a null one is the empty string."""
    name = next((c for c in ("repo", "repo_id") if c in df.columns), None)
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_repo", repo_of(df))


def fingerprint(df: DataFrame) -> Column:
    """Stable identity of a finding: independent of its line and evidence. A null checker or path gives null."""
    sep = F.lit("\0")
    parts = [F.lit(FINGERPRINT_VERSION), repo_of(df), F.col("checker"), F.col("path"), F.coalesce("claim", F.lit("")), F.coalesce("title", F.lit(""))]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, sep, p)
    return F.substring(F.sha2(joined, 256), 1, 32)


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding per (repository, path, line, checker, title); the least claim is kept."""
    return A.first_per(
        _keyed(findings), ["_repo", "path", "line", "checker", "title"], [F.coalesce("claim", F.lit("")), F.coalesce("evidence", F.lit(""))]
    ).select(*findings.columns)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "checker", "title")


_MARKER = r"proofline:\s*ignore(?:-line)?\s*[:=]\s*([\w\-, ]+)"


def markers(lines: DataFrame) -> DataFrame:
    """(repo, path, line, rule) of suppression markers in a line table (repo, path, lineno, line)."""
    return (
        lines.filter(F.col("line").contains("proofline:"))
        .select(repo_of(lines).alias("repo"), "path", F.col("lineno").alias("mark_line"), F.explode(F.split(F.regexp_extract("line", _MARKER, 1), r"[,\s]+")).alias("rule"))
        .filter("rule <> ''")
    )


def suppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings with ``suppressed``: a marker with their rule or ``all`` stands on one of their lines."""
    f = _keyed(findings)
    key = ["_repo", "path", "line", "checker", "title"]
    hit = (
        A.span_join(
            f.select(*key, F.greatest("line", F.coalesce("end_line", "line")).alias("_last")), "line", "_last",
            marks.select(repo_of(marks).alias("_repo"), "path", "mark_line", "rule"), "mark_line", ["_repo", "path"],
        )
        .filter((F.col("rule") == F.col("checker")) | (F.col("rule") == "all"))
        .select(*key).distinct().withColumn("suppressed", F.lit(True))
    )
    return f.join(hit, key, "left").fillna(False, ["suppressed"]).select(*findings.columns, "suppressed")


def unknown_markers(marks: DataFrame, rules: list[str]) -> DataFrame:
    """Markers that name no rule."""
    return marks.filter(~F.col("rule").isin([*rules, "all"]))


def in_scope(findings: DataFrame, prefix: str | None = None) -> DataFrame:
    """Findings below a directory, or on the file itself."""
    if not prefix or prefix == ".":
        return findings
    p = prefix.rstrip("/")
    return findings.filter((F.col("path") == p) | F.col("path").startswith(p + "/"))


def split_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with ``baselined``: whether their fingerprint is in the baseline."""
    known = baseline.select("fingerprint").distinct().withColumn("baselined", F.lit(True))
    return findings.withColumn("fingerprint", fingerprint(findings)).join(known, "fingerprint", "left").fillna(False, ["baselined"])


def baseline_of(findings: DataFrame) -> DataFrame:
    return findings.select(fingerprint(findings).alias("fingerprint")).filter("fingerprint is not null").distinct()


def baseline_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added, removed, total) between two baselines."""
    joined = old.select("fingerprint", F.lit(1).alias("a")).join(new.select("fingerprint", F.lit(1).alias("b")), "fingerprint", "full")
    return joined.agg(
        F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count("b").alias("total")
    )


def introduced(head: DataFrame, base: DataFrame) -> DataFrame:
    """Findings of the head beyond those of the base, as bags by fingerprint."""
    h, b = (x.withColumn("fingerprint", fingerprint(x)) for x in (head, base))
    return A.bag_diff(h, b, ["fingerprint"], ["path", "line"]).drop("fingerprint")


def changed(findings: DataFrame, hunks: DataFrame, untracked: DataFrame, changed_names: DataFrame) -> DataFrame:
    """Findings on a changed line, in an untracked file, or about a changed name of three letters or more, each within
    its repository."""
    f = _keyed(findings)
    by_line = A.span_join(
        f.withColumn("_last", F.greatest("line", F.coalesce("end_line", "line"))), "line", "_last",
        hunks.select(repo_of(hunks).alias("_repo"), "path", F.col("line").alias("hunk_line")), "hunk_line", ["_repo", "path"],
    ).select(*findings.columns)
    by_file = f.join(untracked.select(repo_of(untracked).alias("_repo"), "path").distinct(), ["_repo", "path"], "left_semi").select(*findings.columns)
    tokens = f.withColumn("_t", F.explode(F.array_distinct(F.regexp_extract_all("claim", F.lit(r"(\w{3,})"), F.lit(1)))))
    by_name = tokens.join(
        changed_names.select(repo_of(changed_names).alias("_repo"), F.col("name").alias("_t")).distinct(), ["_repo", "_t"], "left_semi"
    ).select(*findings.columns)
    return by_line.unionByName(by_file).unionByName(by_name).distinct()


def gate(findings: DataFrame, fail_on: str = "lie", errors: DataFrame | None = None) -> DataFrame:
    """One row: counts by severity, errors, and status 0 clean, 1 gate reached, 3 incomplete."""
    rank = SEVERITY_RANK.get(fail_on, 3)
    counts = findings.agg(
        *[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITY_RANK],
        F.count_if(severity_rank() >= rank).alias("failing"),
    )
    failed = errors.agg(F.count("*").alias("errors")) if errors is not None else findings.sparkSession.range(1).select(F.lit(0).cast("long").alias("errors"))
    both = counts.join(failed)  # two single rows
    return both.withColumn("status", F.when(F.col("errors") > 0, 3).when(F.col("failing") > 0, 1).otherwise(0))


def error_summary(errors: DataFrame) -> DataFrame:
    """(checker, message, path, more): failures grouped, with the first path and the number of others."""
    return errors.groupBy("checker", "message").agg(F.min("path").alias("path"), (F.count("*") - 1).alias("more"))


def scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """True and false positives and misses per checker, by (checker, path, line)."""
    key = ["checker", "path", "line"]
    f = found.select(*key).distinct().withColumn("f", F.lit(1))
    e = expected.select(*key).distinct().withColumn("e", F.lit(1))
    return f.join(e, key, "full").groupBy("checker").agg(
        F.count_if(F.expr("f is not null and e is not null")).alias("tp"), F.count_if(F.expr("e is null")).alias("fp"), F.count_if(F.expr("f is null")).alias("fn")
    )
