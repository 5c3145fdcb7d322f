"""Integrity rules over relational tables: each proves an operator of the algebra, with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.operators import algebra as A
from proofline.session import table

EDGES = (
    ("lineitem.orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders.customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("customer.nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier.nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation.region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("func_info.file_facts", "func_info", "file_id", "file_facts", "file_id"),
    ("findings.repos", "findings", "repo_id", "repos", "repo_id"),
)


def dangling_refs(spark, d):
    children: dict[str, list] = {}
    for e, c, k, p, pk in EDGES:
        children.setdefault(c, []).append((e, k, table(spark, d, p), pk))
    return reduce(DataFrame.unionByName, [A.ref_summaries(table(spark, d, c), edges) for c, edges in children.items()])


_DANGLING_SQL = " UNION ALL ".join(
    f"SELECT '{e}' AS edge, count(c.{k}) AS checked, "
    f"coalesce(sum(CASE WHEN c.{k} IS NOT NULL AND p.k IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS dangling "
    f"FROM {c} c LEFT JOIN (SELECT DISTINCT {pk} AS k FROM {p}) p ON c.{k} = p.k"
    for e, c, k, p, pk in EDGES
)


def unknown_paths(spark, d):
    """Findings whose file is not in the tree (stale-file-ref over tables)."""
    f = table(spark, d, "findings").select("finding_id", "repo_id", "checker", _clean("path").alias("path"))
    known = table(spark, d, "file_facts").select("repo_id", "path").distinct()
    return (
        f.join(known, ["repo_id", "path"], "left_anti").groupBy("checker").agg(F.count("*").alias("findings"), F.count_distinct("repo_id", "path").alias("paths"))
    )


def _clean(c):
    p = F.translate(F.trim(c), "\\", "/")
    return F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), r"^(\./)+", "")


_CLEAN = "regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\\./)+', '')"


def ghost_entities(spark, d):
    """Entities that nobody refers to (ghost-export over tables)."""
    out = []
    for kind, t, k, ref, rk in (
        ("order", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "customer", "c_custkey", "orders", "o_custkey"),
        ("part", "part", "p_partkey", "lineitem", "l_partkey"), ("supplier", "supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ):
        ghosts = A.ref_anti(table(spark, d, t).select(k), k, table(spark, d, ref).select(rk).distinct(), rk)
        out.append(ghosts.select(F.lit(kind).alias("kind"), F.col(k).alias("id")))
    return reduce(DataFrame.unionByName, out)


_GHOST_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {k} AS id FROM {t} WHERE NOT EXISTS (SELECT 1 FROM {ref} WHERE {rk} = {k})"
    for kind, t, k, ref, rk in (
        ("order", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "customer", "c_custkey", "orders", "o_custkey"),
        ("part", "part", "p_partkey", "lineitem", "l_partkey"), ("supplier", "supplier", "s_suppkey", "lineitem", "l_suppkey"),
    )
)


def number_drift_tables(spark, d):
    """Stated numbers that contradict the data: n_chars against the text."""
    return (
        table(spark, d, "documents").filter(F.col("n_chars") != F.length("text"))
        .select("doc_id", F.col("n_chars").alias("claimed"), F.length("text").cast("long").alias("actual"))
    )


def order_drift(spark, d):
    """Orders whose stated total is far from the sum of their lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    o = table(spark, d, "orders")
    return (
        o.join(lines, o.o_orderkey == lines.l_orderkey)
        .filter(F.abs(F.col("o_totalprice") - F.col("s")) > 0.5 * F.col("o_totalprice"))
        .groupBy("o_orderpriority").agg(F.count("*").alias("drifting"))
    )


def nearby_evidence(spark, d):
    """Errors with a purchase of the same user within fifteen minutes (band join)."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    err = e.filter("event_type = 'error'").select("event_id", "user_id", "t")
    buy = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("near_id"), F.col("t").alias("near_t"))
    return A.band_join(err, buy, ["user_id"], "t", "near_t", 900, 900).select("event_id", "near_id")


def same_line_band(spark, d):
    """Findings of different checkers within two lines of each other in a file, per pair of checkers."""
    f = table(spark, d, "findings").select("repo_id", _clean("path").alias("path"), "line", "checker", "finding_id")
    g = f.select("repo_id", "path", F.col("line").alias("line2"), F.col("checker").alias("checker2"), F.col("finding_id").alias("id2"))
    return (
        A.band_join(f, g, ["repo_id", "path"], "line", "line2", 2, 2).filter("checker < checker2")
        .groupBy("checker", "checker2").agg(F.count("*").alias("pairs"))
    )


def comment_islands(spark, d):
    """Runs of consecutive comment lines in Python files (gaps and islands)."""
    lines = (
        table(spark, d, "file_facts").filter("language = 'python'").select("file_id", "indexed_at", F.posexplode("lines").alias("pos", "line"))
        .filter(F.col("line").rlike(r"^\s*#")).select("file_id", (F.col("pos") + 1).alias("lineno")).distinct()
    )
    runs = A.islands(lines, ["file_id"], "lineno").groupBy("file_id", "island").agg(F.min("lineno").alias("first_line"), F.count("*").alias("n"))
    return runs.filter("n >= 2").select("file_id", "first_line", "n")


def first_delivery(spark, d):
    """The first finding of each (repository, file, checker), as the rules report it once."""
    f = table(spark, d, "findings").select("repo_id", "checker", _clean("path").alias("path"), "line", "finding_id")
    return A.first_per(f, ["repo_id", "checker", "path"], ["line", "finding_id"])


def blast_radius_nation(spark, d):
    """Everything that refers to a nation, as edges of three kinds."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    o = table(spark, d, "orders").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    edges = (
        c.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind"))
        .unionByName(s.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind")))
        .unionByName(o.select(F.col("c_nationkey").alias("k"), F.lit("order").alias("kind")))
        .groupBy("k", "kind").agg(F.count("*").alias("referrers"))
    )
    n = table(spark, d, "nation")
    return edges.join(n, edges.k == n.n_nationkey).select(F.col("n_name").alias("name"), "kind", "referrers")


def reachable(spark, d):
    """Nodes reachable from each region in three steps (bounded closure)."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return A.closure(n.unionByName(c).unionByName(s), roots, 3).groupBy("root", "depth").agg(F.count("*").alias("nodes"))


DECLARED = ("click", "view", "purchase")


def undeclared_types(spark, d):
    """Event types that nothing declares, with their first use (phantom-package over tables)."""
    e = table(spark, d, "events")
    declared = spark.createDataFrame([(x,) for x in DECLARED], "event_type string")
    return e.join(declared, "event_type", "left_anti").groupBy("event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("uses"))


def introduced(spark, d):
    """Findings of the last batches beyond those of the earlier ones, as a bag difference."""
    f = table(spark, d, "findings").select(
        "batch_id", "finding_id", "repo_id", "checker", _clean("path").alias("path"), F.lower(F.trim("title")).alias("title")
    )
    key = ["repo_id", "checker", "path", "title"]
    return A.bag_diff(f.filter("batch_id > 20"), f.filter("batch_id <= 20"), key, ["finding_id"]).select("finding_id")


def severity_rollup(spark, d):
    """Counts by checker and severity with totals, and the severity's rank for a gate."""
    f = table(spark, d, "findings").select("checker", F.lower("severity").alias("severity"))
    return (
        f.rollup("checker", "severity").agg(F.count("*").alias("n"))
        .withColumn("rank", F.when(F.col("severity") == "lie", 3).when(F.col("severity") == "drift", 2).when(F.col("severity") == "smell", 1))
    )


def fingerprints(spark, d):
    """Stable fingerprints: the first 32 hexadecimal digits of SHA-256 over repository, checker, path, claim and title."""
    from proofline.operators.post import fingerprint

    f = table(spark, d, "findings")
    return f.select("finding_id", fingerprint(f).alias("fingerprint"))


def case_variants(spark, d):
    """Names whose lower case form has exactly one other spelling."""
    n = table(spark, d, "func_info").select("name").distinct().withColumn("low", F.lower("name"))
    return n.groupBy("low").agg(F.count("*").alias("spellings"), F.min("name").alias("first")).filter("spellings = 2").select("low", "first")


def line_table(spark, d):
    """Lines of all documents with their number of lines that look like a reference to a line."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    return t.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(r"(?i)\blines? \d+")).alias("anchors"))


def longest_prefix(spark, d):
    """The deepest ancestor directory of each finding's file that holds a file of the repository directly."""
    f = table(spark, d, "findings").select("finding_id", "repo_id", _clean("path").alias("path"))
    dirs = table(spark, d, "file_facts").select(F.concat_ws(":", "repo_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("dir")).distinct()
    withrepo = F.transform(A.prefixes(F.col("path")), lambda p: F.concat_ws(":", F.col("repo_id"), p))
    found = A.longest_match(f, withrepo, dirs, "dir", ["finding_id"])
    return found.groupBy("matched").agg(F.count("*").alias("findings"))


def precision_recall(spark, d):
    """How well ``has_value_return`` of the older extraction predicts a return with a value, per repository's files."""
    f = table(spark, d, "func_info").dropDuplicates(["func_id"])
    x = f.select((F.size("args") > 0).alias("p"), F.col("has_value_return").alias("y")).dropna()
    return x.agg(
        F.count_if(F.expr("p and y")).alias("tp"), F.count_if(F.expr("p and not y")).alias("fp"), F.count_if(F.expr("not p and y")).alias("fn")
    ).withColumn("precision", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6))


def window_runs(spark, d):
    """Sessions of users: events not more than thirty minutes apart."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    s = e.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= 1800, 0).otherwise(1))
    return s.groupBy("user_id").agg(F.sum("new").alias("sessions"))


QUERIES = {
    f.__name__: f
    for f in (
        dangling_refs, unknown_paths, ghost_entities, number_drift_tables, order_drift, nearby_evidence, same_line_band,
        comment_islands, first_delivery, blast_radius_nation, reachable, undeclared_types, introduced, severity_rollup,
        fingerprints, case_variants, line_table, longest_prefix, precision_recall, window_runs,
    )
}

_F = f"SELECT *, {_CLEAN} AS cpath FROM findings"
ORACLE = {
    "dangling_refs": _DANGLING_SQL,
    "unknown_paths": f"SELECT checker, count(*) AS findings, count(DISTINCT (repo_id, cpath)) AS paths FROM ({_F}) f "
    "WHERE NOT EXISTS (SELECT 1 FROM file_facts x WHERE x.repo_id = f.repo_id AND x.path = f.cpath) GROUP BY checker",
    "ghost_entities": _GHOST_SQL,
    "number_drift_tables": "SELECT doc_id, n_chars AS claimed, length(text) AS actual FROM documents WHERE n_chars <> length(text)",
    "order_drift": "SELECT o_orderpriority, count(*) AS drifting FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem "
    "GROUP BY 1) ON o_orderkey = l_orderkey WHERE abs(o_totalprice - s) > 0.5 * o_totalprice GROUP BY 1",
    "nearby_evidence": "SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' "
    "AND b.event_type = 'purchase' AND abs(floor(epoch_us(a.ts) / 1000000) - floor(epoch_us(b.ts) / 1000000)) <= 900",
    "same_line_band": f"WITH f AS ({_F}) SELECT a.checker, b.checker AS checker2, count(*) AS pairs FROM f a JOIN f b ON a.repo_id = b.repo_id "
    "AND a.cpath = b.cpath AND abs(a.line - b.line) <= 2 AND a.checker < b.checker GROUP BY 1, 2",
    "comment_islands": "WITH l AS (SELECT DISTINCT file_id, pos AS lineno FROM (SELECT file_id, unnest(lines) AS line, "
    "unnest(range(1, len(lines) + 1))::INT AS pos FROM file_facts WHERE language = 'python') WHERE regexp_matches(line, '^\\s*#')), "
    "i AS (SELECT file_id, lineno, lineno - row_number() OVER (PARTITION BY file_id ORDER BY lineno) AS g FROM l) "
    "SELECT file_id, min(lineno) AS first_line, count(*) AS n FROM i GROUP BY file_id, g HAVING count(*) >= 2",
    "first_delivery": f"SELECT repo_id, checker, cpath AS path, line, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, checker, cpath "
    f"ORDER BY line, finding_id) AS rn FROM ({_F})) WHERE rn = 1",
    "blast_radius_nation": "SELECT n_name AS name, kind, count(*) AS referrers FROM (SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL "
    "SELECT s_nationkey, 'supplier' FROM supplier UNION ALL SELECT c_nationkey, 'order' FROM orders JOIN customer ON o_custkey = c_custkey) "
    "JOIN nation ON k = n_nationkey GROUP BY 1, 2",
    "reachable": "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, "
    "'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), "
    "t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION "
    "SELECT root, dst, depth + 1 FROM t JOIN e ON node = src WHERE depth < 3) SELECT root, depth, count(*) AS nodes FROM t GROUP BY 1, 2",
    "undeclared_types": "SELECT event_type, min(event_id) AS first_event, count(*) AS uses FROM events WHERE event_type NOT IN ('click','view','purchase') GROUP BY 1",
    "introduced": f"WITH f AS (SELECT batch_id, finding_id, repo_id, checker, cpath, lower(trim(title)) AS t FROM ({_F})), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, checker, cpath, t ORDER BY finding_id) AS rn FROM f WHERE batch_id > 20), "
    "b AS (SELECT repo_id, checker, cpath, t, count(*) AS had FROM f WHERE batch_id <= 20 GROUP BY 1, 2, 3, 4) "
    "SELECT finding_id FROM n LEFT JOIN b USING (repo_id, checker, cpath, t) WHERE rn > coalesce(had, 0)",
    "severity_rollup": "SELECT checker, severity, count(*) AS n, CASE severity WHEN 'lie' THEN 3 WHEN 'drift' THEN 2 WHEN 'smell' THEN 1 END AS rank "
    "FROM (SELECT checker, lower(severity) AS severity FROM findings) GROUP BY ROLLUP (checker, severity)",
    "fingerprints": "SELECT finding_id, substr(sha256('v1' || chr(0) || coalesce(repo_id::VARCHAR, '') || chr(0) || checker || chr(0) || path || chr(0) || coalesce(claim, '') || chr(0) || "
    "coalesce(title, '')), 1, 32) AS fingerprint FROM findings",
    "case_variants": "SELECT lower(name) AS low, min(name) AS first FROM (SELECT DISTINCT name FROM func_info) GROUP BY 1 HAVING count(*) = 2",
    "line_table": "SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '(?i)\\blines? \\d+')) AS anchors FROM "
    "(SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents) GROUP BY doc_id",
    "longest_prefix": f"WITH f AS (SELECT finding_id, repo_id, cpath FROM ({_F})), p AS (SELECT finding_id, repo_id, "
    "array_to_string(string_split(cpath, '/')[1:k], '/') AS dir FROM (SELECT *, unnest(range(1, len(string_split(cpath, '/')))) AS k FROM f)), "
    "d AS (SELECT DISTINCT repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM file_facts), "
    "m AS (SELECT finding_id, arg_max(repo_id || ':' || dir, length(dir)) AS matched FROM p JOIN d USING (repo_id, dir) GROUP BY 1) "
    "SELECT matched, count(*) AS findings FROM m GROUP BY 1",
    "precision_recall": "WITH x AS (SELECT len(args) > 0 AS p, has_value_return AS y FROM (SELECT DISTINCT ON (func_id) * FROM func_info) "
    "WHERE args IS NOT NULL AND has_value_return IS NOT NULL), a AS (SELECT count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, "
    "count(*) FILTER (WHERE NOT p AND y) AS fn FROM x) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM a",
    "window_runs": "SELECT user_id, sum(new)::BIGINT AS sessions FROM (SELECT user_id, CASE WHEN floor(epoch_us(ts)/1000000) - lag(floor(epoch_us(ts)/1000000)) OVER "
    "(PARTITION BY user_id ORDER BY floor(epoch_us(ts)/1000000), event_id) <= 1800 THEN 0 ELSE 1 END AS new FROM events) GROUP BY 1",
}
