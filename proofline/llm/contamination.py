"""Evaluation texts leaking into training text.

Method: winnowing. The k-gram hashes of a text's words are cut into windows of ``w`` hashes and the least of each
window is a fingerprint, so that any two texts that share ``k + w - 1`` consecutive words share a fingerprint.
Fingerprints of test items are looked up for those of the corpus; each hit is extended to both sides and counts
if the shared run reaches ``MIN_RUN`` words, or the whole item where it has fewer. Items are handled in tiers
whose windows suit their length, so the guarantee holds for short items too.

Words are runs of letters or digits after NFKC normalisation, without soft hyphens, case folded; markup tags
between them do not count.

Defined results: null or wordless texts leak nothing and contain nothing; rows with a null id are ignored; each
(document, item) is returned once however often its rows are delivered. Extra columns are ignored. Test items
of up to ``MAX_BROADCAST_CHARS`` characters in total travel to the executors; a larger test set is joined by a
shuffle on the fingerprints, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 13
GRAM = 5
MAX_BROADCAST_CHARS = 32_000_000
_BATCH_CHARS = 4_000_000
_MEMO_LIMIT = 500_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?/?>")
_TOP = np.uint64(2**64 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode())
        if len(self) > _MEMO_LIMIT:
            self.clear()
        self[word] = value
        return value


_hashes = _WordHashes()


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").casefold()
    else:
        text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and where each text begins (with a last entry for the end)."""
    words: list[str] = []
    starts = [0]
    for t in texts:
        words += words_of(t)
        starts.append(len(words))
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)), np.array(starts)


def grams(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k-gram hash at each word; the greatest value where a text ends before the gram does."""
    n = len(hashes)
    out = np.full(n, _TOP)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * _FACTOR + hashes[j : n - k + 1 + j]
        h ^= h >> np.uint64(33)
        h *= _MIX
        h ^= h >> np.uint64(29)
        out[: n - k + 1] = h
    for back in range(1, k):
        at = starts[1:] - back
        out[at[at >= starts[:-1]]] = _TOP
    return out


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some window of w hashes. Windows may reach into the next text, which
    only adds positions; those within one text are all there."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([h, np.full(w - 1, _TOP)])
    least = padded[:n].copy()  # of the window that begins here
    for j in range(1, w):
        np.minimum(least, padded[j : n + j], out=least)
    front = np.concatenate([np.zeros(w - 1, np.uint64), least])
    most = least.copy()  # greatest such minimum over the windows that hold this position
    for j in range(1, w):
        np.maximum(most, front[w - 1 - j : w - 1 - j + n], out=most)
    return np.flatnonzero((most == h) & (h != _TOP))


def tiers(lengths: list[int], min_run: int = MIN_RUN, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(least length, greatest length, k, w) of groups of items; a run of k + w - 1 words is sure to be found."""
    out = []
    if any(n >= min_run for n in lengths):
        k = min(gram, min_run)
        out.append((min_run, 1 << 60, k, min_run - k + 1))
    low = [n for n in lengths if 0 < n < min_run]
    for floor in (8, 1):  # short items in two groups, that a lone word need not make all fingerprints dense
        mine = [n for n in low if n >= floor and (floor == 8 or n < 8)]
        if mine:
            k = min(gram, min(mine))
            out.append((min(mine), max(mine), k, min(mine) - k + 1))
    return out


class Index:
    """Fingerprints of the test items."""

    def __init__(self, items: list[tuple[int, str]], min_run: int = MIN_RUN, gram: int = GRAM):
        items = [(i, t) for i, t in items if i is not None and t]
        self.ids = [i for i, _ in items]
        hashes, starts = word_hashes([t for _, t in items])
        self.words = [hashes[a:b].tolist() for a, b in zip(starts, starts[1:])]
        self.min_run = min_run
        self.tiers = []
        for low, high, k, w in tiers([len(x) for x in self.words], min_run, gram):
            places: dict[int, list[tuple[int, int]]] = {}
            for n, x in enumerate(self.words):
                if low <= len(x) <= high:
                    h = grams(np.array(x, np.uint64), np.array([0, len(x)]), k)
                    for p in winnowed(h, w).tolist():
                        places.setdefault(int(h[p]), []).append((n, p))
            keys = np.array(sorted(places), np.uint64)
            self.tiers.append((k, w, keys, places))

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, first word in the text, first word in the item, words) of the longest run each."""
        hashes, starts = word_hashes(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        by_gram: dict[int, np.ndarray] = {}
        for k, w, keys, places in self.tiers:
            if not len(keys):
                continue
            if k not in by_gram:
                by_gram[k] = grams(hashes, starts, k)
            h = by_gram[k]
            at = winnowed(h, w)
            found = np.searchsorted(keys, h[at])
            found[found == len(keys)] = 0
            at = at[keys[found] == h[at]]
            owner = np.searchsorted(starts, at, side="right") - 1
            for p, d in zip(at.tolist(), owner.tolist()):
                for n, q in places[int(h[p])]:
                    run = _extend(hashes, int(starts[d]), int(starts[d + 1]), p, self.words[n], q)
                    if run[2] >= min(self.min_run, len(self.words[n])) and run[2] > best.get((d, n), (0, 0, 0))[2]:
                        best[d, n] = (run[0] - int(starts[d]), run[1], run[2])
        return [(d, self.ids[n], *run) for (d, n), run in best.items()]


def _extend(doc: np.ndarray, low: int, high: int, p: int, item: list[int], q: int) -> tuple[int, int, int]:
    """The longest equal run around positions p and q."""
    a, b = p, q
    while a > low and b > 0 and int(doc[a - 1]) == item[b - 1]:
        a, b = a - 1, b - 1
    n = p - a
    while a + n < high and b + n < len(item) and int(doc[a + n]) == item[b + n]:
        n += 1
    return a, b, n


_SCHEMA = "doc_id long, item_id long, doc_word int, item_word int, run int"


def _batches(rows: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Groups of rows of bounded text, so that memory does not follow the row count of an Arrow batch."""
    out: list[tuple[int, str]] = []
    size = 0
    for r in rows:
        out.append(r)
        size += len(r[1])
        if size > _BATCH_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def leaks(documents: DataFrame, items: DataFrame, max_broadcast_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, run): the longest run that an item and a document share."""
    docs = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    tests = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct()
    size = tests.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > max_broadcast_chars:
        return _leaks_by_shuffle(docs, tests)
    spark = documents.sparkSession
    index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in tests.toLocalIterator()]))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch in _batches(zip(frame["doc_id"].tolist(), frame["text"].tolist())):
                got = index.value.leaks([t for _, t in batch])
                if got:
                    d, i, p, q, n = zip(*got)
                    yield pd.DataFrame(
                        {"doc_id": [batch[x][0] for x in d], "item_id": i, "doc_word": p, "item_word": q, "run": n}
                    )

    return _longest(docs.mapInPandas(find, _SCHEMA))


def _longest(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("run", (-F.col("doc_word")).alias("a"), (-F.col("item_word")).alias("b"))).alias("m"))
        .select(
            "doc_id", "item_id", (-F.col("m.a")).alias("doc_word"), (-F.col("m.b")).alias("item_word"), "m.run"
        )
    )


def fingerprints(texts: DataFrame, key: str, k: int, w: int) -> DataFrame:
    """(key, pos, hash, words): winnowed fingerprints; ``words`` is the text's number of words."""

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch in _batches(zip(frame[key].tolist(), frame["text"].tolist())):
                hashes, starts = word_hashes([t for _, t in batch])
                h = grams(hashes, starts, k)
                at = winnowed(h, w)
                owner = np.searchsorted(starts, at, side="right") - 1
                ids = np.array([x for x, _ in batch])
                yield pd.DataFrame(
                    {
                        key: ids[owner], "pos": (at - starts[owner]).astype("int32"),
                        "hash": h[at].view(np.int64), "words": np.diff(starts)[owner].astype("int32"),
                    }
                )

    return texts.mapInPandas(take, f"{key} long, pos int, hash long, words int")


def _leaks_by_shuffle(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """As ``leaks``, for a test set too large to send to each executor: fingerprints meet in a join.

    Lengths of items that do not occur cost no pass over the corpus; an item of fewer than eight words is one gram as
    long as itself, so that what meets is a case already.
    """
    words = fingerprints(tests, "item_id", 1, 1).select(F.least("words", F.lit(MIN_RUN)).alias("n")).distinct()
    there = {r["n"] for r in words.collect()}  # at most MIN_RUN values
    tiers = [(MIN_RUN, 1 << 30, GRAM, MIN_RUN - GRAM + 1)] if MIN_RUN in there else []
    tiers += [(8, MIN_RUN - 1, GRAM, 8 - GRAM + 1)] if there & set(range(8, MIN_RUN)) else []
    tiers += [(n, n, n, 1) for n in range(1, 8) if n in there]
    if not tiers:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    out = None
    for low, high, k, w in tiers:
        mine = fingerprints(tests, "item_id", k, w).filter(F.col("words").between(low, high))
        hits = (
            fingerprints(docs, "doc_id", k, w)
            .select("doc_id", "pos", "hash")
            .join(mine.select("item_id", F.col("pos").alias("item_pos"), "hash"), "hash")
            .groupBy("doc_id", "item_id")
            .agg(F.collect_set(F.struct("pos", "item_pos")).alias("hits"))
        )
        out = hits if out is None else out.unionByName(hits)
    pairs = out.join(docs, "doc_id").join(tests.withColumnRenamed("text", "item_text"), "item_id")

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, i, hits, text, item in zip(
                frame["doc_id"], frame["item_id"], frame["hits"], frame["text"], frame["item_text"]
            ):
                hashes, starts = word_hashes([text, item])
                n, words = int(starts[1]), hashes[starts[1] :].tolist()
                for h in hits:
                    run = _extend(hashes, 0, n, h["pos"], words, h["item_pos"])
                    if run[2] >= min(MIN_RUN, len(words)):
                        rows.append((d, i, *run))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_word", "item_word", "run"])

    return _longest(pairs.select("doc_id", "item_id", "hits", "text", "item_text").mapInPandas(extend, _SCHEMA))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Test items that leaked, with the number of documents and the longest run."""
    return leaks(documents, items).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.max("run").alias("longest_run")
    )


__all__ = ["Index", "fingerprints", "leaked_items", "leaks", "words_of"]
