"""The fact base: every file's facts and claims, extracted once and exploded into relations.

Extraction is a pure function of a file, so it is one pass without a shuffle. Its nested result is written once as a
table in the shared folder (``spark.checkpoint.dir``) while rules run; each relation is a projection of it and reads
only its own columns. Relations that several rules read are tables there too: a plan over them starts at a scan, so
that plans stay small, executors may be lost without a new extraction, and Spark knows the sizes when it joins.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.extract import facts_of
from proofline.session import checkpoint_dir, remove
from proofline.sources import trees

_CLAIM = "line:int,end_line:int"
_STRUCTS = {
    "comments": "array<struct<text:string,line:int,end_line:int,block:string>>",
    "functions": "array<struct<name:string,lineno:int,end_lineno:int,args:array<string>,docstring:string,doc_line:int,is_method:boolean>>",
    "symbols": "array<struct<name:string,lineno:int,kind:string,top:boolean>>",
    "imports": "array<struct<kind:string,module:string,level:int,name:string,alias:string,guarded:boolean,lineno:int>>",
    "exports": "array<string>", "export_stars": "array<string>",
    "symbol_claims": f"array<struct<claim:string,name:string,root:string,base:string,ticked:boolean,{_CLAIM}>>",
    "file_claims": f"array<struct<ref:string,kind:string,{_CLAIM}>>",
    "mock_claims": "array<struct<target:string,line:int>>",
    "contract_claims": f"array<struct<name:string,root:string,base:string,frame:string,{_CLAIM}>>",
    "env_drifts": f"array<struct<var:string,claimed:string,actual:string,code_line:int,{_CLAIM}>>",
    "http_calls": "array<struct<method:string,path:string,line:int>>",
    "fence_findings": f"array<struct<opened:int,kind:string,{_CLAIM}>>",
    "doc_calls": "array<struct<name:string,base:string,root:string,line:int>>",
    "invocations": "array<struct<argv:array<string>,line:int,strong:boolean>>",
    "flags": "array<string>",
    "words": "array<struct<word:string,n:int>>",
    "attrs": "array<struct<mod:string,attr:string>>",
    "quoted": "array<string>",
}
_SCHEMA = (
    "repo string, path string, language string, parse_failed boolean, dynamic boolean, esm boolean, opaque_cli boolean, error string, "
    + ", ".join(f"{k} {v}" for k, v in _STRUCTS.items())
)
#: Test data and templates are indexed, but make no claims.
FIXTURE = r"(?:^|/)(?:fixtures?|testdata|test_data|__fixtures__|snapshots?|__snapshots__|golden|templates?)/"


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for repo, path, text in zip(f["repo"], f["path"], f["text"]):
            try:
                row = facts_of(path, text)
            except Exception as e:  # one file's failure is a row, not the job's end
                row = facts_of("x.txt", "") | {"error": f"{type(e).__name__}: {e}"}
            rows.append(row | {"repo": repo, "path": path})
        out = pd.DataFrame(rows)
        for c in _STRUCTS:
            if c not in out:
                out[c] = [[] for _ in rows]
        yield out[["repo", "path", "language", "parse_failed", "dynamic", "esm", "opaque_cli", "error", *_STRUCTS]]


class FactBase:
    """Relations over a file table (repo, path, text). Rows with null path or text are left out."""

    def __init__(self, files: DataFrame, keep: bool = True):
        self.spark = files.sparkSession
        self.files = files.filter(F.col("path").isNotNull() & F.col("text").isNotNull()).select(
            F.coalesce("repo", F.lit("")).alias("repo"), "path", "text"
        )
        self._keep = keep
        self._kept: dict[str, DataFrame] = {}
        self._folder: str | None = None

    @functools.cached_property
    def facts(self) -> DataFrame:
        return self.kept("facts", lambda: self.files.mapInPandas(_extract, _SCHEMA))

    def close(self) -> None:
        """Removes what the base keeps."""
        if self._folder is not None:
            remove(self.spark, self._folder)
        self._kept.clear()

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived relation that several rules read, built once and kept as a table."""
        if name not in self._kept:
            df = build()
            if self._keep:
                self._folder = self._folder or f"{checkpoint_dir(self.spark)}/facts-{uuid.uuid4().hex}"
                at = f"{self._folder}/{name}"
                df.write.parquet(at)
                df = self.spark.read.schema(df.schema).parquet(at)
            self._kept[name] = df
        return self._kept[name]

    def relation(self, name: str, claims: bool = False) -> DataFrame:
        """A relation with the columns repo, path, language and those of the fact. ``claims``: without fixtures."""
        src = self.facts.filter(~F.col("path").rlike(FIXTURE)) if claims else self.facts
        one = src.select("repo", "path", "language", F.explode(name).alias("_x"))
        if _STRUCTS[name] == "array<string>":
            return one.withColumnRenamed("_x", "name")
        return one.select("repo", "path", "language", "_x.*")

    @functools.cached_property
    def paths(self) -> DataFrame:
        return self.kept("paths", lambda: self.files.select("repo", "path").distinct())

    @functools.cached_property
    def tops(self) -> DataFrame:
        """(repo, top): first segments of the tree."""
        return self.paths.select("repo", F.split("path", "/")[0].alias("top")).distinct()

    @functools.cached_property
    def symbols(self) -> DataFrame:
        """(repo, name): every name defined anywhere, imported names of files that do not parse included as unknown."""
        return self.kept("symbols", lambda: self.relation("symbols").select("repo", "name").distinct())

    @functools.cached_property
    def manifests(self) -> DataFrame:
        return self.kept("manifests", lambda: trees.manifests(self.files))

    @functools.cached_property
    def lines(self) -> DataFrame:
        return trees.lines_of(self.files)

    def errors(self) -> DataFrame:
        """(checker, path, message) of files whose extraction failed."""
        return self.facts.filter("error is not null").select(F.lit("extract").alias("checker"), "path", F.col("error").alias("message"))

    def edges(self) -> DataFrame:
        """(repo, kind, symbol, path): who defines, imports or claims a symbol."""
        defined = self.relation("symbols").select("repo", F.lit("defined_in").alias("kind"), F.col("name").alias("symbol"), "path")
        imported = self.relation("imports").filter("name is not null and name <> '*'").select(
            "repo", F.lit("imported_by").alias("kind"), F.col("name").alias("symbol"), "path"
        )
        used = self.relation("attrs").join(self.relation("imports").select("repo", "path", F.col("alias").alias("mod")).distinct(), ["repo", "path", "mod"], "left_semi").select(
            "repo", F.lit("imported_by").alias("kind"), F.col("attr").alias("symbol"), "path"
        )
        text = self.relation("comments").select("repo", "path", "text").unionByName(
            self.relation("functions").filter("docstring is not null").select("repo", "path", F.col("docstring").alias("text"))
        )
        claimed = text.select(
            "repo", "path", F.explode(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))).alias("s")
        ).select("repo", F.lit("claimed_by").alias("kind"), F.element_at(F.split("s", r"\."), -1).alias("symbol"), "path")
        mocks = self.relation("mock_claims").select("repo", F.lit("claimed_by").alias("kind"), F.element_at(F.split("target", r"\."), -1).alias("symbol"), "path")
        docs = self.relation("doc_calls").select("repo", F.lit("claimed_by").alias("kind"), F.col("base").alias("symbol"), "path")
        return defined.unionByName(imported).unionByName(used).unionByName(claimed).unionByName(mocks).unionByName(docs).distinct()

    def tree_digest(self) -> DataFrame:
        """(repo, digest): identity of a tree's content, independent of order."""
        return self.files.groupBy("repo").agg(
            F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.sha2("text", 256)))), "\n")).alias("digest")
        )


def upsert(stored: DataFrame, fresh: DataFrame, removed: DataFrame) -> DataFrame:
    """Facts with the rows of changed or removed paths replaced: anti-join and union."""
    gone = fresh.select("repo", "path").unionByName(removed.select("repo", "path")).distinct()
    return stored.join(gone, ["repo", "path"], "left_anti").unionByName(fresh)


__all__ = ["FactBase", "upsert"]
