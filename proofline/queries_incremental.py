"""Queries of problem 3, processing only new or changed records."""

from __future__ import annotations

from proofline.operators import incremental as inc
from proofline.session import scratch, table

_STATE_SQL = """
WITH log AS (
  SELECT repo_id, regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '^(\\./)+', '') AS path,
         sha, changed_at, arrived_at, change_id
  FROM changed_plan WHERE repo_id IS NOT NULL AND changed_at IS NOT NULL AND length(trim(path)) > 0),
cut AS (SELECT repo_id, max(cutoff_at) AS cutoff_at FROM scan_runs WHERE outcome = 'ok' GROUP BY repo_id),
cur AS (SELECT repo_id, path, sha, row_number() OVER (PARTITION BY repo_id, path ORDER BY changed_at DESC, change_id DESC) AS rn FROM log),
old AS (SELECT l.repo_id, l.path, l.sha, row_number() OVER (PARTITION BY l.repo_id, l.path ORDER BY changed_at DESC, change_id DESC) AS rn
        FROM log l JOIN cut c ON l.repo_id = c.repo_id AND l.arrived_at <= c.cutoff_at),
st AS (SELECT c.repo_id, c.path, c.sha AS current_sha, o.sha AS known_sha
       FROM (SELECT * FROM cur WHERE rn = 1) c LEFT JOIN (SELECT * FROM old WHERE rn = 1) o USING (repo_id, path))
"""


def p3_found(spark, sf_dir):
    """The next batch, run and committed: the manifest holds what the last successful runs knew; the rows are read back
    from the committed batch."""
    changes, runs = table(spark, sf_dir, "changed_plan"), table(spark, sf_dir, "scan_runs")
    root = scratch(spark)
    run = inc.IncrementalRun(spark, root, "repo_id int, path string", "sha string", ("sha",))
    run.seed(inc.known_manifest(changes, runs))
    run.run(inc.current_listing(changes), lambda paths: paths.select("repo_id", "path"))
    done = run.results()
    return spark.createDataFrame([], "repo_id int, path string") if done is None else done.select("repo_id", "path")


def p3_states(spark, sf_dir):
    return inc.path_states(table(spark, sf_dir, "changed_plan"), table(spark, sf_dir, "scan_runs"))


QUERIES = {"p3_found": p3_found, "p3_states": p3_states}
ORACLE = {
    "p3_found": _STATE_SQL + "SELECT repo_id, path FROM st WHERE current_sha IS DISTINCT FROM known_sha",
    "p3_states": _STATE_SQL + "SELECT repo_id, path, current_sha, known_sha FROM st",
}
