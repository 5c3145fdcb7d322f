"""Processing only new or changed records: a manifest of processed inputs, an anti-join, idempotent batches.

``pending``          the comparison under all of it: a *listing* of what there is against a *manifest* of what the last
                     committed batch of each key knew. What differs is pending; what is gone comes with null content.
``IncrementalRun``   fixes the pending set in a written table first, so that what is processed, named and committed is
                     one and the same; writes results under the batch's identifier (over a torn earlier attempt) and
                     commits the manifest entries last, by one atomic rename onto the batch's number.
``list_inputs``      files with size, time and, only where size or time differ from the manifest, a checksum.
``pending_paths``    the change log as listing and manifest: known states are what the last successful run committed.

Defined results: rows whose path is null or blank, or whose ``repo_id`` or ``changed_at`` is null, name no
version of a path and are ignored. Rows delivered again count once. Of equal ``changed_at`` the greater
``change_id`` wins. An empty log gives no pending path; without a counting run every path that exists now is
pending. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normal_path(path):
    """Path without leading ``./`` and with single slashes."""
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), r"^(\./)+", "")


def last_cutoffs(runs: DataFrame, outcome: str = "ok") -> DataFrame:
    """Per repository the greatest cutoff of a run that counts: one row a repository."""
    return (
        runs.filter((F.col("outcome") == outcome) & F.col("repo_id").isNotNull() & F.col("cutoff_at").isNotNull())
        .groupBy("repo_id")
        .agg(F.max("cutoff_at").alias("cutoff_at"))
    )


def _log(changes: DataFrame) -> DataFrame:
    return changes.select(
        "repo_id", normal_path(F.col("path")).alias("path"), "sha", "changed_at", "arrived_at", "change_id"
    ).filter(
        F.col("repo_id").isNotNull() & (F.length(F.trim("path")) > 0) & F.col("changed_at").isNotNull()
    )


def _states(log: DataFrame) -> DataFrame:
    """(repo_id, path, sha): the latest version of each path; one shuffle with map-side combine."""
    state = F.struct("sha")  # keeps a null sha as a value
    return log.groupBy("repo_id", "path").agg(F.max_by(state, F.struct("changed_at", "change_id"))["sha"].alias("sha"))


def current_listing(changes: DataFrame) -> DataFrame:
    """(repo_id, path, sha) of every path in the log; a null sha is an absent file."""
    return _states(_log(changes))


def known_manifest(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo_id, path, sha): what the last successful run of each repository had read when it committed.

    The run table is reduced to one row a repository before the join, whose strategy Spark picks by size.
    """
    read = _log(changes).join(last_cutoffs(runs), "repo_id").filter(F.col("arrived_at") <= F.col("cutoff_at"))
    return _states(read)


def pending(listing: DataFrame, manifest: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """(keys, content) of the keys whose content is not what the manifest has; gone ones with null content.

    An anti-join that tells apart unknown, changed and gone: both sides have a row a key and meet on it, so that a hot
    repository is spread by its paths. Null content is absence, on either side.
    """
    now, known = F.struct(*content), F.struct(*content)
    both = listing.select(*keys, now.alias("_now")).join(manifest.select(*keys, known.alias("_known")), keys, "full")
    differs = [~F.col(f"_now.{c}").eqNullSafe(F.col(f"_known.{c}")) for c in content]
    return both.filter(reduce(lambda a, b: a | b, differs)).select(*keys, *[F.col(f"_now.{c}").alias(c) for c in content])


def path_states(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Current and known ``sha`` of every path in the log."""
    return current_listing(changes).withColumnRenamed("sha", "current_sha").join(
        known_manifest(changes, runs).withColumnRenamed("sha", "known_sha"), ["repo_id", "path"], "left"
    )


def pending_paths(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo_id, path, sha) of the paths the next run must process, each once."""
    return pending(current_listing(changes), known_manifest(changes, runs), ["repo_id", "path"], ["sha"])


def latest_entries(manifest: DataFrame) -> DataFrame:
    """(path, size, modified, checksum): what the last committed batch of each path knew; a tombstone has nulls."""
    order = F.coalesce("seq", F.lit(0)) if "seq" in manifest.columns else F.lit(0)
    columns = [c for c in ("size", "modified", "checksum") if c in manifest.columns]
    return manifest.groupBy("path").agg(F.max_by(F.struct(*columns), order).alias("known")).select("path", *[f"known.{c}" for c in columns])


def pending_inputs(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, size, checksum) of the inputs that are not as their last committed batch knew them.

    ``listing`` names all inputs: a known path that is absent from it is gone, and pending with null size and
    checksum until a batch has committed that.
    """
    return pending(listing, latest_entries(manifest), ["path"], ["size", "checksum"])


def _checksums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for f in frames:
        sums = []
        for p in f["path"]:
            where, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", p))
            digest = hashlib.sha256()
            with where.open_input_stream(at) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield f[["path", "size", "modified"]].assign(checksum=sums)


def list_inputs(spark: SparkSession, root: str, pattern: str = "*", manifest: DataFrame | None = None) -> DataFrame:
    """(path, size, modified, checksum) of the files below ``root``.

    With a manifest, only files whose size or time differ from its last entries are read for a checksum, by the
    executors; of the others the checksum is taken from there. The listing itself reads no content.
    """
    names = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))
    )
    schema = "path string, size long, modified long, checksum string"
    if manifest is None or "modified" not in manifest.columns:
        return names.mapInPandas(_checksums, schema)
    known = latest_entries(manifest)
    same = names.join(known, ["path", "size", "modified"]).select("path", "size", "modified", "checksum")
    fresh = names.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")
    return same.unionByName(fresh.mapInPandas(_checksums, schema))


class IncrementalRun:
    """Exactly-once batches: ``out/batch=<number>-<hash>`` holds results, ``manifest/seq=<number>`` the committed entries.

    ``keys`` name an input and ``content`` its state. A crash before the commit leaves at most a folder of the
    unfinished batch, which no reader sees and a retry of the same inputs overwrites: the identifier is a hash of the
    batch's own inputs and of its number among the committed ones, which lets the same inputs come back later. A crash
    after it leaves nothing to do. Of two runs that commit the same number one fails: the rename does not replace. (On
    object stores without an atomic rename, runs of one folder must not overlap.)
    """

    def __init__(
        self, spark: SparkSession, root: str, keys: str = "path string", content: str = "size long, modified long, checksum string",
        compared: tuple[str, ...] = ("size", "checksum"),
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.keys = [c.split()[0] for c in keys.split(",")]
        self.content = [c.split()[0] for c in content.split(",")]
        self.compared = list(compared)
        self._schema = f"{keys}, {content}, batch string"
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def commits(self) -> list[int]:
        """Numbers of the committed batches: one folder a batch."""
        at = self._path(f"{self.root}/manifest")
        names = [p.getPath().getName() for p in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removeprefix("seq=")) for n in names if n.startswith("seq="))

    def manifest(self) -> DataFrame:
        if not self.commits():
            return self.spark.createDataFrame([], self._schema + ", seq long")
        return self.spark.read.schema(self._schema + ", seq long").parquet(f"{self.root}/manifest")

    def known(self) -> DataFrame:
        """The last committed entry of each key."""
        state = F.struct(*self.content)
        return self.manifest().groupBy(*self.keys).agg(F.max_by(state, "seq").alias("_k")).select(*self.keys, *[f"_k.{c}" for c in self.content])

    def results(self) -> DataFrame | None:
        """Rows of committed batches only."""
        done = [r["batch"] for r in self.manifest().select("batch").distinct().collect()]  # one name a batch
        there = [b for b in done if self._fs.exists(self._path(f"{self.root}/out/batch={b}"))]
        if not there:
            return None
        return self.spark.read.option("basePath", f"{self.root}/out").parquet(*[f"{self.root}/out/batch={b}" for b in there])

    def seed(self, entries: DataFrame) -> None:
        """Commits entries that earlier runs had processed elsewhere."""
        self._commit(entries.select(*self.keys, *self.content), "seed", (self.commits() or [0])[-1] + 1)

    def run(self, listing: DataFrame, process, fail_before_commit: bool = False) -> str | None:
        """Process what is pending; the batch id, or None if nothing is. ``process(pending) -> DataFrame``.

        ``listing`` names all inputs; ``process`` also gets those that are gone, with null content.
        """
        seq = (self.commits() or [0])[-1] + 1
        plan = f"{self.root}/_staged/{uuid.uuid4().hex}"
        differs = pending(listing.dropDuplicates(self.keys), self.known(), self.keys, self.compared)
        extra = [c for c in self.content if c not in self.compared]
        if extra:
            differs = differs.join(listing.dropDuplicates(self.keys).select(*self.keys, *extra), self.keys, "left")
        # the pending set is fixed here: inputs that change from now on are the next batch's
        differs.select(*self.keys, *self.content).write.parquet(plan)
        fixed = self.spark.read.parquet(plan)
        ident = fixed.agg(
            F.sha2(
                F.concat_ws("|", F.lit(seq), F.count("*"), F.sum(F.xxhash64(*self.keys, *self.compared).cast("decimal(38,0)"))), 256
            ).alias("id"),
            F.count("*").alias("n"),
        ).first()
        if not ident["n"]:
            self._fs.delete(self._path(plan), True)
            return None
        batch = f"{seq:09d}-{ident['id'][:24]}"
        process(fixed).write.mode("overwrite").parquet(f"{self.root}/out/batch={batch}")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        self._commit(fixed, batch, seq)
        self._fs.delete(self._path(plan), True)
        return batch

    def _commit(self, entries: DataFrame, batch: str, seq: int) -> None:
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        entries.withColumn("batch", F.lit(batch)).write.parquet(staged)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        option = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(option, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._path(staged), self._path(f"{self.root}/manifest/seq={seq}"), none)
        except Exception as e:
            raise RuntimeError(f"batch {seq} was committed by another run") from e


def manifest_json(manifest: DataFrame) -> DataFrame:
    """The manifest as JSON lines, for tools outside Spark."""
    return manifest.select(F.to_json(F.struct("path", "size", "checksum", "batch")).alias("line"))


__all__ = [
    "IncrementalRun", "current_listing", "known_manifest", "last_cutoffs", "latest_entries", "list_inputs", "manifest_json",
    "normal_path", "path_states", "pending", "pending_inputs", "pending_paths",
]
