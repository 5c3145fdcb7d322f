"""Each rule over the trees of ``proofline.cases``; the oracle lists the findings that were expected by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline import cases
from proofline.operators.facts import FactBase
from proofline.plans import rules as R
from proofline.session import ship
from proofline.sources import trees

_bases: dict[str, FactBase] = {}


def judged(case: cases.Case, rule: str) -> bool:
    return rule in case.rules if case.rules else R.REGISTRY[rule].default


def fact_base(spark) -> FactBase:
    """One fact base an application over the trees of all cases, each a repository."""
    key = spark.sparkContext.applicationId
    if key not in _bases:
        ship(spark)
        rows = [(c.name, p, t) for c in cases.CASES for p, t in c.files.items()]
        _bases[key] = FactBase(trees.kept(spark.createDataFrame(rows, "repo string, path string, text string").coalesce(4)))
    return _bases[key]


def registry(spark):
    return spark.createDataFrame(cases.REGISTRY, "kind string, dist string, exists boolean, age_hours double")


def spec(spark):
    return spark.createDataFrame(cases.SPEC, "program string, command string, flag string, takes_value boolean")


def findings(spark, rule: str):
    """Findings of a rule in the cases that judge it."""
    extra = {"slop-package": {"registry": registry}, "stale-cli-ref": {"spec": spec}}.get(rule, {})
    found = R.REGISTRY[rule].plan(fact_base(spark), **{k: make(spark) for k, make in extra.items()})
    return found.filter(F.col("repo").isin([c.name for c in cases.CASES if judged(c, rule)]))


def _query(rule: str):
    def query(spark, d):
        return findings(spark, rule).groupBy(F.col("repo").alias("case_name"), "path", "line").agg(F.count_distinct("title").alias("titles"))

    return query


def _oracle(rule: str) -> str:
    rows = {}
    for c in cases.CASES:
        for checker, path, line in c.expect:
            if checker == rule and judged(c, rule):
                rows[c.name, path, line] = rows.get((c.name, path, line), 0) + 1
    values = ", ".join(f"('{n}', '{p}', {k}, {m}::BIGINT)" for (n, p, k), m in sorted(rows.items()))
    return f"SELECT * FROM (VALUES {values}) AS t(case_name, path, line, titles)"


def _key(rule: str) -> str:
    return "rule_" + rule.replace("-", "_")


QUERIES = {_key(r): _query(r) for r in R.REGISTRY}
ORACLE = {_key(r): _oracle(r) for r in R.REGISTRY}
