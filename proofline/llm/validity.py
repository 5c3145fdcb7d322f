"""Source files that do not parse.

Method: chunks of a file's lines are lexed into state maps and bracket summaries (``lexers``), which reduce
associatively; a file whose brackets match and whose lexer ends in its normal state is then parsed from its
balanced groups with local grammars (``grammars``), Python statement by statement with the interpreter's own parser.

A file of up to ``CHUNK_LINES`` lines is one chunk and is judged where it is read, without a shuffle. Longer
files are cut into chunks; summaries are shuffled to where a file is reduced. The verdict is the same for any size of
chunks. Of Python, the summary holds the statements that a cut divides; of the others, a letter for each token.

Defined results: a null ``language`` is replaced by the one that the suffix of ``path`` stands for; other
languages are never flagged. Null ``lines`` are an unknown content and no delivery; a null element is an
empty line. Of repeated deliveries of a ``file_id`` the latest counts (null ``indexed_at`` first; of equal times the
greater hash of the content), also where it names another language or repository than earlier ones. Rows with
null ``file_id`` are ignored. An empty file is valid, except in Go. Nesting too deep for the parser is not
flagged. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm import grammars, lexers

CHUNK_LINES = 128


def language_of(language: Column, path: Column) -> Column:
    """The language of a file, by suffix where none is given."""
    by_suffix = F.create_map(*[F.lit(x) for kv in lexers.SUFFIX_LANGUAGE.items() for x in kv])
    return F.coalesce(F.lower(F.trim(language)), by_suffix[F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))])


def text_of(lines: Column) -> Column:
    return F.array_join(lines, "\n", "")


def parses(language: str, text: str) -> bool:
    """Whether the text is a whole file of the language."""
    return accepts_code(language, lexers.summarise(language, text.removeprefix("﻿"), first=True))


def accepts_code(language: str, total: lexers.ChunkSummary) -> bool:
    """The verdict on a whole file's summary."""
    if language == "python":
        return lexers.python_sound(total)
    state, brackets, code = total.by_state[lexers.NORMAL]
    if state != lexers.NORMAL or brackets or lexers.BAD in code:
        return False
    return grammars.GRAMMARS[language].accepts(code)


_LEXED = T.StructType([T.StructField("broken", T.BooleanType()), T.StructField("summary", T.StringType())])


@F.pandas_udf(_LEXED)
def _lexed(language: pd.Series, text: pd.Series, seq: pd.Series, pieces: pd.Series) -> pd.DataFrame:
    """The verdict on a file of one piece, the summary of a piece of a longer one."""
    broken, summary = [], []
    for lang, t, k, n in zip(language, text, seq, pieces):
        if lang not in lexers.CODE_LANGUAGES:
            broken.append(False)
            summary.append(None)
        elif n == 1:
            broken.append(not parses(lang, t))
            summary.append(None)
        else:
            one = lexers.summarise(lang, t.removeprefix("\ufeff") if k == 0 else t, first=k == 0)
            broken.append(None)
            summary.append(json.dumps([one.by_state, one.length]))
    return pd.DataFrame({"broken": pd.Series(broken, dtype="object"), "summary": pd.Series(summary, dtype="object")})


def _load(s: str) -> lexers.ChunkSummary:
    by_state, length = json.loads(s)
    return lexers.ChunkSummary({k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in by_state.items()}, length)


@F.pandas_udf(T.BooleanType())
def _reduced(language: pd.Series, parts: pd.Series) -> pd.Series:
    """The verdict on a long file, from the summaries of its pieces."""
    broken = []
    for lang, ps in zip(language, parts):
        if lang not in lexers.CODE_LANGUAGES or not len(ps):
            broken.append(False)
            continue
        mine = sorted(ps, key=lambda p: p["seq"])
        broken.append(not accepts_code(lang, functools.reduce(lexers.compose, (_load(p["summary"]) for p in mine))))
    return pd.Series(broken, dtype="bool")


def code_files(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, path, lines, indexed_at) of rows in the five languages with a content."""
    return (
        files.select(
            "file_id", "repo_id", "path", "lines", "indexed_at",
            language_of(F.col("language"), F.col("path")).alias("language"),
        )
        .filter(
            F.col("file_id").isNotNull()
            & F.col("lines").isNotNull()
            & F.col("language").isin(*lexers.CODE_LANGUAGES)
        )
    )


def delivery_time(indexed_at: Column) -> Column:
    """Order of deliveries; null comes first."""
    return F.coalesce(F.unix_micros(indexed_at.cast("timestamp")), F.lit(-(2**62)))


def delivery_order() -> Column:
    """Orders the deliveries of a file: by time, equal times by a hash of what was delivered, the same in every run."""
    return F.struct(delivery_time(F.col("indexed_at")).alias("at"), F.xxhash64("repo_id", "language", "path", "lines").alias("content"))


def verdicts(files: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(file_id, repo_id, language, broken): one row a file of the five languages.

    One scan and one shuffle of verdicts (of long files, also of summaries); texts do not travel.
    """
    pieces = (
        latest_code(files)
        .withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.size("lines") / chunk_lines)).cast("int"))
        .select(
            "file_id", "repo_id", "language", "pieces", "at",
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.col("pieces") - 1),
                    lambda k: F.concat(
                        text_of(F.slice("lines", k * chunk_lines + 1, F.lit(chunk_lines))),
                        F.when(k < F.col("pieces") - 1, F.lit("\n")).otherwise(F.lit("")),
                    ),
                )
            ).alias("seq", "text"),
        )
        .withColumn("lexed", _lexed("language", "text", "seq", "pieces"))
    )
    part = F.struct("seq", F.col("lexed.summary").alias("summary"))
    # pieces of one delivery meet; then the latest delivery of a file counts, whatever repository or language others named
    whole = (
        pieces.groupBy("file_id", "at")
        .agg(
            F.first("repo_id").alias("repo_id"), F.first("language").alias("language"), F.max("lexed.broken").alias("broken"),
            F.collect_set(F.when(F.col("pieces") > 1, part)).alias("parts"),
        )
        .withColumn("broken", F.when(F.size("parts") > 0, _reduced("language", "parts")).otherwise(F.col("broken")))
    )
    return whole.groupBy("file_id").agg(F.max_by(F.struct("repo_id", "language", "broken"), "at").alias("r")).select(
        "file_id", "r.repo_id", "r.language", "r.broken"
    )


def latest_code(files: DataFrame) -> DataFrame:
    """``code_files`` with ``at``, the order of a delivery; those that name no language of the five stay, so that they
    can be the latest."""
    known = F.coalesce(language_of(F.col("language"), F.col("path")), F.lit(""))
    return files.filter(F.col("file_id").isNotNull() & F.col("lines").isNotNull()).select(
        "file_id", "repo_id", F.when(known.isin(*lexers.CODE_LANGUAGES), F.col("lines")).otherwise(F.array().cast("array<string>")).alias("lines"),
        known.alias("language"), delivery_order().alias("at"),
    )


def broken_files(files: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The flagged files, each once."""
    return verdicts(files, chunk_lines).filter("broken").select("file_id")


def broken_rates(files: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Files, flagged files and their share per repository and language."""
    return (
        verdicts(files, chunk_lines)
        .filter(F.col("language").isin(*lexers.CODE_LANGUAGES))
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("files"), F.count_if("broken").alias("broken"))
        .withColumn("share", F.round(F.col("broken") / F.col("files"), 6))
    )


__all__ = ["broken_files", "broken_rates", "code_files", "delivery_time", "language_of", "parses", "text_of", "verdicts"]
