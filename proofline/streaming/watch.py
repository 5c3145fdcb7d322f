"""Watching a stream of files or findings: each batch updates the stored facts and reports only what is new.

State lives in a folder (a shared one on a cluster). A batch writes under its own id and replaces a torn attempt
of the same id, so that a retry after a failure neither skips nor repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofline.operators import post
from proofline.operators.facts import FactBase
from proofline.plans import rules as R


class NewFindings:
    """Keeps the fingerprints seen so far; a batch's new findings are an anti-join against earlier batches."""

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self.state}/batch={batch:012d}"

    def seen_before(self, batch: int) -> DataFrame:
        schema = "fingerprint string, batch long"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.state)
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.state).filter(F.col("batch") < batch)

    def accept(self, findings: DataFrame, batch: int) -> DataFrame:
        """The new findings of the batch; stores their fingerprints."""
        marked = findings.withColumn("fingerprint", post.fingerprint(findings)).dropDuplicates(["fingerprint"])
        fresh = marked.join(self.seen_before(batch), "fingerprint", "left_anti")
        fresh.select("fingerprint").write.mode("overwrite").parquet(self._path(batch))
        mine = self.spark.read.parquet(self._path(batch))
        return marked.join(mine, "fingerprint", "left_semi").drop("fingerprint")


def watch(findings: DataFrame, state: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs a stream of findings; ``sink(new_findings, batch_id)`` gets each new one once."""
    seen = NewFindings(findings.sparkSession, state)

    def step(df: DataFrame, batch: int) -> None:
        sink(seen.accept(df, batch), batch)

    return findings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TreeWatch:
    """A tree under a stream of file versions (repo, path, text; null text removes the file).

    Rules negate: a new file can end a finding elsewhere. The tree is therefore upserted and scanned as a whole,
    and the result compared with what was reported.
    """

    def __init__(self, spark: SparkSession, state: str, rules: list[str] | None = None):
        self.spark, self.state, self.rules = spark, state.rstrip("/"), rules
        self.new = NewFindings(spark, f"{self.state}/seen")

    def _tree(self, batch: int) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.state}/tree/{batch}")
        except Exception:
            return None

    def step(self, versions: DataFrame, batch: int) -> DataFrame:
        """Applies a batch of versions; the findings that are new since the batch before."""
        old = next((t for b in range(batch - 1, -1, -1) if (t := self._tree(b)) is not None), None)
        fresh = versions.select("repo", "path", "text")
        if old is not None:
            fresh = old.join(versions.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(fresh)
        fresh.filter("text is not null").write.mode("overwrite").parquet(f"{self.state}/tree/{batch}")
        base = FactBase(self.spark.read.parquet(f"{self.state}/tree/{batch}"))
        return self.new.accept(R.scan(base, self.rules), batch)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time; later ones than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")
    ).select(F.col("window.start").alias("start"), "event_type", "n", "value")
