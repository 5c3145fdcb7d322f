"""One object for a user: scan, compare, ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.config import Config
from proofline.operators import post
from proofline.operators.facts import FactBase
from proofline.plans import rules as R
from proofline.session import ship
from proofline.sources import trees


class Engine:
    """A file table (repo, path, text) under a configuration."""

    def __init__(self, files: DataFrame, config: Config | None = None):
        self.spark: SparkSession = files.sparkSession
        ship(self.spark)
        self.config = config or Config()
        aliases = [("", "", "alias", k, r, n, "") for k, v in self.config.path_aliases.items() for n, r in enumerate(v)]
        self.files = trees.kept(files, self.config.ignore_dirs, self.config.ignore_files)
        self.base = FactBase(self.files)
        self._found: DataFrame | None = None
        if aliases:
            extra = self.spark.createDataFrame(aliases, "repo string, dir string, fact string, name string, value string, line int, path string")
            self.base.manifests = self.base.manifests.unionByName(extra)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, config: Config | None = None) -> Engine:
        return cls(trees.read_tree(spark, root), config)

    def scan(
        self, scope: str | None = None, baseline: DataFrame | None = None, show_baselined: bool = False,
        registry: DataFrame | None = None, spec: DataFrame | None = None, routes: DataFrame | None = None,
    ) -> DataFrame:
        """Findings after suppression, scope and baseline."""
        if registry is None and spec is None and routes is None:
            found = self.found()
        else:
            found = R.scan(self.base, list(self.config.rules), registry=registry, spec=spec, routes=routes)
        marks = post.markers(self.base.lines)
        out = post.in_scope(post.suppressed(found, marks).filter("not suppressed").drop("suppressed"), scope)
        if baseline is not None:
            out = post.split_baseline(out, baseline)
            out = out if show_baselined else out.filter("not baselined").drop("baselined", "fingerprint")
        return out

    def found(self) -> DataFrame:
        """All findings of the configured rules, computed once and kept: findings are few beside the facts."""
        if self._found is None:
            self._found = self.base.kept("found", lambda: R.scan(self.base, list(self.config.rules)))
        return self._found

    def close(self) -> None:
        self.base.close()

    def gate(self, findings: DataFrame) -> DataFrame:
        return post.gate(findings, self.config.fail_on, self.base.errors())

    def changed(self, base_files: DataFrame, diff_lines: DataFrame | None = None) -> DataFrame:
        """Findings that the tree has and ``base_files`` had not, and those on changed lines of a diff."""
        before = FactBase(trees.kept(base_files, self.config.ignore_dirs, self.config.ignore_files))
        head = self.found()
        fresh = post.introduced(head, R.scan(before, list(self.config.rules))).select(*head.columns)
        if diff_lines is None:
            return fresh
        empty = self.spark.createDataFrame([], "path string, name string")
        on_lines = post.changed(head, trees.parse_diff(diff_lines), empty, empty).select(*head.columns)
        return fresh.unionByName(on_lines).distinct()

    def cross_index(self, other: Engine) -> DataFrame:
        """The route rule on this tree with the routes of both; trees belong together by their ``repo``."""
        routes = other.base.manifests.filter("fact = 'route'").select("repo", F.col("name").alias("route"))
        return R.stale_api_ref(self.base, routes)

    def impact(self, symbol: str) -> DataFrame:
        return R.blast_radius(self.base, symbol)

    def check_text(self, text: str, repo: str = "") -> DataFrame:
        return R.check_text(self.base, text, repo)

    def list(self) -> DataFrame:
        return self.files.select("repo", "path").distinct().orderBy("repo", "path")

    def grep(self, tokens: list[str]) -> DataFrame:
        """(repo, path, token): files that hold a token as a word; one pass, a semi-join on words."""
        wanted = self.spark.createDataFrame([(t,) for t in tokens], "token string")
        words = self.files.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("token"))
        return words.join(wanted, "token", "left_semi").select("repo", "path", "token")


class FactStore:
    """Facts kept in a folder by (repo, path, content hash): a later base extracts only what changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def refresh(self, files: DataFrame) -> tuple[DataFrame, int]:
        """(facts of all files, number of files that were extracted)."""
        current = files.filter("path is not null and text is not null").select(
            F.coalesce("repo", F.lit("")).alias("repo"), "path", "text", F.sha2("text", 256).alias("sha")
        )
        versions = self._versions()
        stored = self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None
        fresh = current if stored is None else current.join(stored.select("repo", "path", "sha"), ["repo", "path", "sha"], "left_anti")
        n = fresh.count()
        facts = FactBase(fresh, keep=False).facts.join(fresh.select("repo", "path", "sha"), ["repo", "path"])
        if stored is not None:
            same = stored.join(current.select("repo", "path", "sha"), ["repo", "path", "sha"], "left_semi")
            facts = same.unionByName(facts)
        at = f"{self.path}/v{len(versions):09d}"
        facts.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at), n
