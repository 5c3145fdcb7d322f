"""Every rule on the trees of ``proofline.cases``, compared with the oracle as the driver does."""

import duckdb
import pytest

from proofline import cases, queries_cases
from proofline.plans import rules as R


@pytest.mark.parametrize("rule", list(R.REGISTRY))
def test_rule_equals_its_oracle(spark, rule):
    key = "rule_" + rule.replace("-", "_")
    want = sorted(duckdb.sql(queries_cases.ORACLE[key]).fetchall())
    got = sorted((r.case_name, r.path, r.line, r.titles) for r in queries_cases.QUERIES[key](spark, "").collect())
    assert got == want and want


def test_cases_are_named_once_and_judge_what_they_expect():
    names = [c.name for c in cases.CASES]
    assert len(names) == len(set(names))
    for c in cases.CASES:
        assert all(queries_cases.judged(c, checker) and path in c.files for checker, path, _ in c.expect)
