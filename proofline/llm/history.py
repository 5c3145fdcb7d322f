"""Deduplicating new batches against all history.

A finding repeats an accepted one if repository, checker, file and symbol are equal, the lines differ by at most
``MAX_LINES`` and the titles, without the symbol, say the same.

Method: a segment index for edit distance. A text is cut into segments of at most two characters, stored by
length, position and line block. At most a quarter of the shorter text's characters may be edited, so that even
the head that a shortened text shares with it has more segments than edits: one of them is unharmed, and has
been shifted by no more than its number. A newcomer probes with the substrings that can be such a segment, and
what it meets is verified by a bounded edit distance. Texts below ``SHORT`` characters are compared directly. An
accepted finding appends its segments.

Only groups of equal repository, checker, file and symbol with two members or more are looked at. Copies that
agree in line and text are one class, built before the shuffle, so that a hot group shrinks to its distinct
statements. What lies more than ``MAX_LINES`` lines apart, with nothing between, cannot meet, directly or through
others: a group is split into such runs of lines, found over its distinct lines only (at most the lines of a file), and
each run streams through an index of its own, in the order of delivery, wherever it lands.

A new batch reads from the stored index only the groups that it touches (``repeats_of_batch``) and appends what it adds.
``repeats_by_batches`` loads the past in one pass, stores its index, and takes the last batches that way, one by one.

Defined results: a row with null ``finding_id``, ``batch_id``, ``repo_id``, ``checker``, ``path``, ``line`` or
``title`` repeats nothing and is repeated by nothing. A finding that repeats several accepted ones is returned
with each. A title without a symbol has the empty symbol. Rows delivered again, with the same ``finding_id``,
count once. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import written

MAX_LINES = 5
#: One edit is allowed for so many characters.
CHARS_PER_EDIT = 4
#: The shorter text must cover this share of the longer one; less is no lost end but another statement.
MIN_COVER = 0.4
#: Below this length a head may have no segment to spare.
SHORT = 12
_BLOCK = MAX_LINES + 1
#: Batches that ``repeats_by_batches`` takes one by one.
INCREMENTS = 2
_MEMO_LIMIT = 200_000

# Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = ("аеорсухіѕјԁһӏАВЕКМНОРСТХοαν", "aeopcyxisjdhlABEKMHOPCTXoav")

_QUOTED = (
    r"`[^`]+`|“[^”]+”|‘[^’]+’|«[^»]+»|\"[^\"]+\"|'[A-Za-z_$][\w.$]*'(?!\w)"
)
_BARE = r"[A-Za-z$][A-Za-z0-9$]*(?:[_.][A-Za-z0-9$]+)+|_+[A-Za-z][A-Za-z0-9_]*|[a-z]+[0-9]*(?:[A-Z][a-z0-9]*)+"
_LEAD = r"^(?:\s*(?:\([^()\x01]*\)|\[[^\[\]\x01]*\]|[a-z]+\s*:(?!\S)|[a-z]+(?:-[a-z]+)+\s+[-:–]\s))+"
_TRAIL = r"(?:\s*(?:\([^()\x01]*\)?|\[[^\[\]\x01]*\]?))+[\s.!;]*$"


def same_file(path: Column) -> Column:
    """Path without outer blanks, backslashes, doubled slashes and leading ``./``."""
    p = F.regexp_replace(path, r"^[\s ]+|[\s ]+$", "")
    p = F.regexp_replace(F.translate(p, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./)+", "")


def statements(findings: DataFrame) -> DataFrame:
    """(finding_id, batch_id, k1, k2, line, text): group keys as two hashes, and the title without its symbol."""
    quoted = F.regexp_extract("title", _QUOTED, 0)
    return (
        findings.select("finding_id", "batch_id", "repo_id", "checker", "path", "line", "title")
        .dropna()
        .withColumn("title", F.regexp_replace("title", r"(?i)(?:`*</?code>`*)+|`{2,}", "`"))
        .withColumn("title", F.translate("title", "   \t", "    "))
        .withColumn("raw", F.when(quoted != "", quoted).otherwise(F.regexp_extract("title", _BARE, 0)))
        .withColumn("symbol", F.regexp_replace("raw", r"^[`“‘«\"'\s]+|[`”’»\"'\s]+$", ""))
        .withColumn("file", same_file(F.col("path")))
        .withColumn(
            "text",
            F.lower(F.translate(F.expr("replace(title, raw, '\u0001')"), *LOOKALIKES)),
        )
        .withColumn("text", F.regexp_replace("text", r"n['’]t\b", " not"))
        .withColumn("text", F.regexp_replace(F.regexp_replace("text", _LEAD, ""), _TRAIL, ""))
        .withColumn("text", F.regexp_replace("text", r"[^\p{L}\p{N}\x01]+|\b(?:the|a|an|such)\b", " "))
        .withColumn("text", F.regexp_replace("text", r"\b(?:has|have) +been\b", "is"))
        .withColumn("text", F.regexp_replace("text", r"\bnot +any\b", "no"))
        .select(
            F.col("finding_id").cast("long"), F.col("batch_id").cast("int"),
            F.xxhash64("repo_id", "checker", "file", "symbol").alias("k1"),
            F.xxhash64(F.lit(1), "symbol", "file", "checker", "repo_id").alias("k2"),
            F.col("line").cast("int").alias("line"),
            F.replace("text", F.lit(" "), F.lit("")).alias("text"),
        )
    )


def edits_within(a: str, b: str, limit: int) -> bool:
    """Whether the shorter text is within ``limit`` edits of the longer one or of a head of it."""
    if len(a) > len(b):
        a, b = b, a
    if b.startswith(a):
        return True
    n, m = len(a), min(len(b), len(a) + limit)
    far = limit + 1
    prev = [min(j, far) for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - limit), min(m, i + limit)
        cur = [far] * (m + 1)
        if i <= limit:
            cur[0] = i
        least = cur[0]
        ca = a[i - 1]
        for j in range(low, high + 1):
            v = prev[j - 1] if ca == b[j - 1] else 1 + min(prev[j - 1], prev[j], cur[j - 1])
            cur[j] = v
            if v < least:
                least = v
        if least > limit:
            return False
        prev = cur
    return min(prev) <= limit


class SameText:
    """Memo of verdicts on pairs of texts, as few wordings recur in many findings."""

    def __init__(self):
        self._memo: dict[tuple[str, str], bool] = {}

    def __call__(self, a: str, b: str) -> bool:
        if a == b:
            return True
        key = (a, b) if a < b else (b, a)
        got = self._memo.get(key)
        if got is None:
            short, long = sorted((len(a), len(b)))
            got = short >= MIN_COVER * long and edits_within(a, b, short // CHARS_PER_EDIT)
            if len(self._memo) > _MEMO_LIMIT:
                self._memo.clear()
            self._memo[key] = got
        return got


class SegmentIndex:
    """Texts with lines, found by a line near and a text within a quarter of its length in edits."""

    def __init__(self, same: SameText):
        self._same = same
        self._exact: dict[tuple[int, str], list[int]] = {}
        self._by_segment: dict[tuple[int, int, int, str], list[int]] = {}
        self._short: dict[int, list[int]] = {}
        self._lengths: dict[int, set[int]] = {}
        self.entries: list[tuple[int, str, object]] = []

    @staticmethod
    @functools.lru_cache(maxsize=4096)
    def segments(n: int) -> list[tuple[int, int]]:
        """(start, length) of the segments of a text of length n."""
        k = (n + 1) // 2
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def add(self, line: int, text: str, value: object) -> None:
        at = len(self.entries)
        self.entries.append((line, text, value))
        block = line // _BLOCK
        if len(text) < SHORT:
            self._short.setdefault(block, []).append(at)
            return
        self._lengths.setdefault(block, set()).add(len(text))
        self._exact.setdefault((block, text), []).append(at)
        for i, (start, size) in enumerate(self.segments(len(text))):
            self._by_segment.setdefault((block, len(text), i, text[start : start + size]), []).append(at)

    def near(self, line: int, text: str) -> list[object]:
        """Values of the entries that say the same nearby, in order of entry."""
        block = line // _BLOCK
        met: set[int] = set()
        for b in (block - 1, block, block + 1):
            met.update(self._short.get(b, ()))
            lengths = self._lengths.get(b)
            if not lengths:
                continue
            met.update(self._exact.get((b, text), ()))
            for n in lengths:
                if min(n, len(text)) < MIN_COVER * max(n, len(text)):
                    continue
                edits = min(n, len(text)) // CHARS_PER_EDIT
                for i, (start, size) in enumerate(self.segments(n)):
                    # some unharmed segment has no more edits before it than segments
                    shift = min(i, edits)
                    for p in range(max(0, start - shift), min(len(text) - size, start + shift) + 1):
                        got = self._by_segment.get((b, n, i, text[p : p + size]))
                        if got:
                            met.update(got)
        out = []
        for at in sorted(met):
            other, words, value = self.entries[at]
            if abs(other - line) <= MAX_LINES and self._same(text, words):
                out.append(value)
        return out


_CLASS_SCHEMA = "class long, accepted_id long, accepted_batch int"


def _class(k1: Column, k2: Column, line: Column, text: Column) -> Column:
    return F.xxhash64(k1, k2, line, text)


def classes(rows: DataFrame) -> DataFrame:
    """(k1, k2, line, text, batch_id, finding_id, last): distinct statements with their first delivery and last member."""
    return (
        rows.groupBy("k1", "k2", "line", "text")
        .agg(F.min(F.struct("batch_id", "finding_id")).alias("first"), F.max("finding_id").alias("last"))
        .select("k1", "k2", "line", "text", "first.batch_id", "first.finding_id", "last")
    )


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams classes sorted by run and delivery; gives (class, accepted) wherever they say the same."""
    same = SameText()
    group = None
    for f in frames:
        out: list[tuple[int, int, int]] = []
        for k1, k2, run, line, text, batch, ident, cls, known in zip(
            f["k1"], f["k2"], f["run"], f["line"], f["text"], f["batch_id"], f["finding_id"], f["class"], f["accepted"]
        ):
            if (k1, k2, run) != group:
                group, accepted, repeated = (k1, k2, run), SegmentIndex(same), SegmentIndex(same)
            hits = [] if known else accepted.near(line, text)
            if hits:
                out += [(cls, i, b) for i, b in hits]
                repeated.add(line, text, cls)
            else:
                # later copies of classes that repeat an earlier finding repeat this one as well
                out += [(c, ident, batch) for c in repeated.near(line, text)]
                out.append((cls, ident, batch))  # its own copies
                accepted.add(line, text, (ident, batch))
        if out:
            c, i, b = zip(*out)
            yield pd.DataFrame({"class": c, "accepted_id": i, "accepted_batch": b})


def _runs(first: DataFrame) -> DataFrame:
    """(k1, k2, line, run): lines that must meet, of runs with something new that can be a repeat."""
    lines = first.groupBy("k1", "k2", "line").agg(
        F.count("*").alias("n"), F.max((F.col("last") != F.col("finding_id"))).alias("copies"), F.max(~F.col("accepted")).alias("new")
    )
    ordered = Window.partitionBy("k1", "k2").orderBy("line")
    gap = F.col("line") - F.lag("line").over(ordered) > MAX_LINES
    numbered = lines.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(ordered))
    run = Window.partitionBy("k1", "k2", "run")
    return (
        numbered.withColumn("members", F.sum("n").over(run))
        .withColumn("again", F.max("copies").over(run))
        .withColumn("fresh", F.max("new").over(run))
        # a lone class has only copies of itself: its first member is accepted
        .filter(F.col("fresh") & ((F.col("members") > 1) | F.col("again")))
        .select("k1", "k2", "line", "run")
    )


def _links(first: DataFrame, rows: DataFrame) -> DataFrame:
    """(accepted_id, finding_id): what the members ``rows`` of the classes ``first`` repeat."""
    links = (
        first.join(_runs(first), ["k1", "k2", "line"])
        .withColumn("class", _class(F.col("k1"), F.col("k2"), F.col("line"), F.col("text")))
        .select("k1", "k2", "run", "line", "text", "batch_id", "finding_id", "class", "accepted")
        .repartition("k1", "k2", "run")
        .sortWithinPartitions("k1", "k2", "run", F.col("accepted").desc(), "batch_id", "finding_id")
        .mapInPandas(_decide, _CLASS_SCHEMA)
    )
    members = rows.select(
        "finding_id", "batch_id", _class(F.col("k1"), F.col("k2"), F.col("line"), F.col("text")).alias("class")
    )
    return _later(members.join(links, "class"))


def repeats(findings: DataFrame) -> DataFrame:
    """(accepted_id, finding_id): each later finding with the accepted ones that it repeats, in one pass."""
    rows = statements(findings)
    return _links(classes(rows).withColumn("accepted", F.lit(False)), rows)


def repeats_by_batches(findings: DataFrame, increments: int = INCREMENTS) -> DataFrame:
    """The same rows: the past in one pass, the last batches one by one against the stored index."""
    rows = written(statements(findings))
    newest = [r["batch_id"] for r in rows.select("batch_id").distinct().orderBy(F.desc("batch_id")).limit(increments).collect()]
    past = rows.filter(~F.col("batch_id").isin(newest)) if newest else rows
    out = written(_links(classes(past).withColumn("accepted", F.lit(False)), past))
    index = written(_accepted(past, out))
    for batch in sorted(newest):
        mine = rows.filter(F.col("batch_id") == batch)
        again = written(_batch(index, mine))
        out, index = out.unionByName(again), index.unionByName(written(_accepted(mine, again)))
    return out


def _later(pairs: DataFrame) -> DataFrame:
    return (
        pairs.filter(
            (F.col("batch_id") > F.col("accepted_batch"))
            | ((F.col("batch_id") == F.col("accepted_batch")) & (F.col("finding_id") > F.col("accepted_id")))
        )
        .select("accepted_id", "finding_id")
        .distinct()
    )


def _accepted(rows: DataFrame, again: DataFrame) -> DataFrame:
    return classes(rows.join(again.select("finding_id").distinct(), "finding_id", "left_anti"))


def accepted_statements(findings: DataFrame) -> DataFrame:
    """The index as stored: (k1, k2, line, text, batch_id, finding_id, last) of accepted findings."""
    return _accepted(statements(findings), repeats(findings))


def _batch(stored: DataFrame, rows: DataFrame) -> DataFrame:
    fresh = classes(rows).withColumn("accepted", F.lit(False))
    touched = stored.join(rows.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").withColumn(
        "accepted", F.lit(True)
    )
    return _links(touched.unionByName(fresh), rows)


def repeats_of_batch(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeats, additions) of a batch: its repeats, and the statements to append to the stored index.

    Of the stored index the keys are scanned, and only groups that the batch touches are read on: a semi-join by group.
    Lines, texts and comparisons follow the batch.
    """
    rows = statements(batch)
    again = _batch(stored, rows)
    return again, _accepted(rows, again)


__all__ = ["SameText", "SegmentIndex", "accepted_statements", "edits_within", "repeats", "repeats_by_batches", "repeats_of_batch", "statements"]
