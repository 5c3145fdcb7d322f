"""The relational algebra under the integrity rules: small planners that keep joins on equalities.

Every helper returns a DataFrame plan and leaves the choice of physical joins to Catalyst. Nulls never match in
a join key; where that matters the helper's docstring says what becomes of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ref_anti(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Claims without a fact: rows of ``child`` whose non-null key has no row in ``parent``."""
    facts = parent.select(F.col(parent_key).alias("_fact"))
    return child.filter(F.col(key).isNotNull()).join(facts, F.col(key) == F.col("_fact"), "left_anti")


def ref_summary(edge: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(edge, checked, dangling) of a reference; null keys claim nothing.

    Both sides are aggregated to distinct keys with counts first, so that a hot key is one row in the join.
    """
    claims = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    facts = parent.filter(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("k")).distinct().withColumn("known", F.lit(1))
    return (
        claims.join(facts, "k", "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("dangling"),
        )
        .select(F.lit(edge).alias("edge"), "checked", "dangling")
    )


def ref_summaries(child: DataFrame, edges: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """``ref_summary`` of several references (edge, key, parent, parent_key) of one child, which is read once.

    The keys of a row are exploded with their edge and counted together; all parents meet them in one join.
    """
    pairs = F.array(*[F.struct(F.lit(e).alias("edge"), F.col(k).cast("string").alias("k")) for e, k, _, _ in edges])
    claims = child.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("k").isNotNull()).groupBy("edge", "k").agg(F.count("*").alias("n"))
    facts = None
    for e, _, parent, pk in edges:
        one = parent.filter(F.col(pk).isNotNull()).select(F.lit(e).alias("edge"), F.col(pk).cast("string").alias("k"))
        facts = one if facts is None else facts.unionByName(one)
    names = child.sparkSession.createDataFrame([(e,) for e, *_ in edges], "edge string")
    counted = (
        claims.join(facts.distinct().withColumn("known", F.lit(1)), ["edge", "k"], "left")
        .groupBy("edge").agg(F.sum("n").alias("checked"), F.sum(F.when(F.col("known").isNull(), F.col("n"))).alias("dangling"))
    )
    return names.join(counted, "edge", "left").select("edge", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("checked", "dangling")])


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, before: int, after: int) -> DataFrame:
    """Pairs with equal keys and ``right_at`` within [at - before, at + after], as an equi-join on blocks.

    Blocks are as wide as the band, so that a left row meets at most two of them: the join's input grows by two,
    whatever the band, and a hot key is split by its blocks.
    """
    width = before + after + 1
    l = left.withColumn(
        "_block",
        F.explode(F.array_distinct(F.array(F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width)))),
    )
    r = right.withColumn("_block", F.floor(F.col(right_at) / width))
    return (
        l.join(r, [*keys, "_block"])
        .filter(F.col(right_at).between(F.col(at) - before, F.col(at) + after))
        .drop("_block")
    )


def span_join(spans: DataFrame, first: str, last: str, points: DataFrame, point: str, keys: Sequence[str], width: int = 64) -> DataFrame:
    """Pairs with equal keys and ``point`` within [first, last]: spans are cut into blocks of ``width``."""
    s = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    p = points.withColumn("_block", F.floor(F.col(point) / width))
    return s.join(p, [*keys, "_block"]).filter(F.col(point).between(F.col(first), F.col(last))).drop("_block")


def islands(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Numbers runs of consecutive values of ``at`` per key as ``island`` (value less rank)."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("island", F.col(at) - F.dense_rank().over(w))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; the aggregate keeps one candidate a key and task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("_o")
    row = F.struct(*[F.col(c) for c in rest])
    return (
        df.groupBy(*keys).agg(F.min_by(row, ranked).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    )


def longest_match(left: DataFrame, pieces: Column, right: DataFrame, key: str, ident: Sequence[str]) -> DataFrame:
    """For each left row the longest of its candidate prefixes (an array) that exists in ``right[key]``."""
    return (
        left.withColumn("_candidate", F.explode(pieces))
        .join(right.select(F.col(key).alias("_candidate")).distinct(), "_candidate", "left_semi")
        .groupBy(*ident)
        .agg(F.max_by("_candidate", F.length("_candidate")).alias("matched"))
    )


def prefixes(path: Column, sep: str = "/") -> Column:
    """All ancestors of a path, shortest first, without the path itself."""
    parts = F.split(path, re.escape(sep))
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, 1, n), sep),
    )


def suffixes(path: Column, sep: str = "/") -> Column:
    """All suffixes of a path at separators, the path itself first: turns ``endswith`` into an equality."""
    parts = F.split(path, re.escape(sep))
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts) - n + 1), sep)
    )


def closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth) of nodes reachable in at most ``depth`` steps over (src, dst); the least depth counts.

    Each step keeps the new frontier only: an anti-join against what is known bounds it by distinct pairs.
    """
    known = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = known
    for d in range(1, depth + 1):
        step = (
            frontier.join(edges, F.col("node") == F.col("src"))
            .select("root", F.col("dst").alias("node"))
            .distinct()
            .join(known.select("root", "node"), ["root", "node"], "left_anti")
            .withColumn("depth", F.lit(d))
        )
        known, frontier = known.unionByName(step), step
    return known


def bag_diff(new: DataFrame, base: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` beyond the number of times their key occurs in ``base``; the last in order remain."""
    counts = base.groupBy(*key).agg(F.count("*").alias("_had"))
    w = Window.partitionBy(*key).orderBy(*order)
    return (
        new.withColumn("_n", F.row_number().over(w))
        .join(counts, list(key), "left")
        .filter(F.col("_n") > F.coalesce(F.col("_had"), F.lit(0)))
        .drop("_n", "_had")
    )


def fold_lines(lines: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """An ordered state machine over an array of lines, inside the JVM."""
    return F.aggregate(lines, start, step)


__all__ = [
    "bag_diff", "band_join", "closure", "first_per", "fold_lines", "islands", "longest_match", "prefixes", "ref_anti",
    "ref_summaries", "ref_summary", "span_join", "suffixes",
]
