"""Reports of findings: JSON, SARIF, Markdown, HTML and a terminal view.

Distributed writers (``write_json``, ``json_lines``) scale with the findings. The single-document formats gather
one row a finding on the driver, as one document must; ``limit`` bounds the listing of the views for people.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators import post

_SARIF_LEVEL = {"lie": "error", "drift": "warning", "smell": "note"}
_FIELDS = post.FINDING_SCHEMA.names


def json_lines(findings: DataFrame) -> DataFrame:
    """(value): one JSON object a finding, written by the executors."""
    return findings.select(F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}).alias("value"))


def write_json(findings: DataFrame, path: str) -> None:
    json_lines(findings).write.mode("overwrite").text(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    """Sorted unique fingerprints; range-partitioned, so that the sort is distributed."""
    post.baseline_of(findings).orderBy("fingerprint").write.mode("overwrite").json(path)


def read_baseline(spark, path: str) -> DataFrame:
    """A baseline; a file of another shape is an error, not an empty baseline."""
    got = spark.read.json(path)
    if got.columns and got.columns != ["fingerprint"]:
        raise ValueError(f"not a baseline: {path}")
    return got if got.columns else spark.createDataFrame([], "fingerprint string")


def _rows(findings: DataFrame) -> list[dict]:
    return [r.asDict() for r in post.ordered(findings.select(*_FIELDS)).toLocalIterator()]


def to_json(findings: DataFrame) -> str:
    """A list of finding objects."""
    return json.dumps(_rows(findings), indent=2, ensure_ascii=False)


def to_sarif(findings: DataFrame, tool: str = "proofline", version: str = "0.1.0") -> str:
    """SARIF 2.1.0; rules in the order in which they first appear."""
    rows = _rows(findings)
    rules = list(dict.fromkeys(r["checker"] for r in rows))
    results = [
        {
            "ruleId": r["checker"], "ruleIndex": rules.index(r["checker"]), "level": _SARIF_LEVEL.get((r["severity"] or "").lower(), "none"),
            "message": {"text": f"{r['title']}. {r['evidence'] or ''}".strip()},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": max(1, r["line"] or 1), "endLine": max(1, r["end_line"] or r["line"] or 1)}}}],
        }
        for r in rows
    ]
    return json.dumps(
        {
            "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0",
            "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": [{"id": r} for r in rules]}}, "results": results}],
        },
        indent=2,
    )


def _cell(text: object) -> str:
    return str(text if text is not None else "").replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def to_markdown(findings: DataFrame, errors: int = 0) -> str:
    """A summary table; with failed files it says that the scan is incomplete."""
    rows = _rows(findings)
    head = [f"**Incomplete:** {errors} file(s) could not be checked.", ""] if errors else []
    if not rows:
        return "\n".join([*head, "No findings." if not errors else "No findings in what was checked."]) + "\n"
    counts = {s: sum((r["severity"] or "").lower() == s for r in rows) for s in post.SEVERITY_RANK}
    head += [", ".join(f"{n} {s}" for s, n in counts.items() if n), "", "| severity | rule | place | finding |", "|---|---|---|---|"]
    return "\n".join([*head, *(f"| {_cell(r['severity'])} | {_cell(r['checker'])} | {_cell(r['path'])}:{r['line']} | {_cell(r['title'])} |" for r in rows)]) + "\n"


def to_html(findings: DataFrame, title: str = "Findings") -> str:
    """A page without outside resources."""
    rows = _rows(findings)
    e = lambda x: html.escape(str(x if x is not None else ""))
    body = "".join(
        f"<tr class='{e(r['severity'])}'><td>{e(r['severity'])}</td><td>{e(r['checker'])}</td><td>{e(r['path'])}:{e(r['line'])}</td>"
        f"<td><b>{e(r['title'])}</b><br>{e(r['evidence'])}<br><i>{e(r['fix'])}</i></td></tr>"
        for r in rows
    )
    style = "body{font:14px sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;vertical-align:top}.lie{background:#fdd}.drift{background:#ffd}"
    return f"<!doctype html><meta charset='utf-8'><title>{e(title)}</title><style>{style}</style><h1>{e(title)}</h1><p>{len(rows)} findings</p><table><tr><th>severity<th>rule<th>place<th>finding</tr>{body}</table>"


def _cut(text: object, n: int) -> str:
    s = str(text or "")
    return s if len(s) <= n else s[: n - 1] + "…"


def to_terminal(findings: DataFrame, errors: int = 0, limit: int = 1000) -> str:
    """A view for people: texts are cut, and "clean" is only said of a complete scan."""
    rows = [r.asDict() for r in post.ordered(findings.select(*_FIELDS)).limit(limit).toLocalIterator()]
    if not rows:
        return "clean\n" if not errors else f"nothing found, but {errors} file(s) failed\n"
    out = []
    for r in rows:
        out += [f"{r['path']}:{r['line']} [{r['severity']}] {r['checker']}: {r['title']}", f"    claim: {_cut(r['claim'], 200)}", f"    evidence: {_cut(r['evidence'], 220)}", f"    fix: {_cut(r['fix'], 220)}"]
    return "\n".join(out) + "\n"


def badge(findings: DataFrame) -> DataFrame:
    """(lies): contradictions in documents, the figure of a badge."""
    return findings.filter("severity = 'lie'").filter(F.col("path").rlike(r"(?i)readme[^/]*$")).agg(F.count("*").alias("lies"))


def edits(findings: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, line, old, new): textual edits that a rename would make; applying them is left to the caller."""
    return findings.join(renames.select("path", "line", F.col("claim").alias("old"), F.col("name").alias("new")), ["path", "line"]).select("path", "line", "old", "new").distinct()
