"""Generated, minified, vendored and data files among the sources.

Method: header notices and customary names label files; a random forest is trained on what remains visible when
the notices are hidden (paths are no feature at all): compression ratio, token entropy, identifier lengths, comment
density and the like. A labelled file is a case as its notice says; of the others the forest decides, alone, at a
probability of one half.

Notices are rare on minified files and absent from data stored as code, so that labels by notices alone teach next to
nothing about them. The forest is therefore also shown made positives: sampled sources without a label, minified or
replaced by a table of their size by this module. No label is a threshold on a feature.

Defined results: languages other than the five are no case; a null language is taken from the suffix. Null
``lines`` and null elements count as empty. Null paths have no name to judge by. A file whose repository is
unknown has no own project, so that any project named with a version is another one. A file is a case if any of
its deliveries is. A file without any text is none by its looks. Rows with null ``file_id`` are ignored, extra columns too. If the sample has no file without a
label no forest is trained and only labels count.
"""

from __future__ import annotations

import keyword
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import validity
from proofline.session import written

#: Bounds of the training sample, chosen by a hash of the file's id, and of the sampled files that positives are made of.
SAMPLE_ROWS, MADE_ROWS = 8000, 1000
#: A file without a label is no negative from this probability of the coarse forest on.
DOUBTFUL = 0.25
HEAD_LINES, TAIL_LINES = 12, 4

# Customary directories of third-party code and of tool output, and customary file names.
VENDOR_DIRS = frozenset(
    """third_party third-party thirdparty 3rdparty vendor vendors vendored _vendor _vendored node_modules bower_components
    jspm_packages godeps external externals extern deps pods carthage site-packages""".split()
)
OUTPUT_DIRS = frozenset(
    """generated __generated__ _generated gen autogen auto_generated autogenerated codegen-out generated-src
    generated-sources dist out""".split()
)
_OUTPUT_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw|-c|\.validate)?\.(?:go|js|ts|c|h|cc|py)|_pb\.(?:js|d\.ts|ts)|\.min\.[cm]?js"
    r"|[.-]bundle\.[cm]?js|\.deepcopy\.go|^zz_generated.*|[._]generated\.\w+|\.gen\.\w+|_gen\.go|_string\.go|_mock\.go"
    r"|^bundle-[\w]+\.[cm]?js|\.(?:chunk|umd|prod)\.[cm]?js|\.tab\.[ch]|^lex\.yy\.c|\.yy\.c|\.designer\.\w+|^moc_.*)$",
    re.I,
)

_COMMENT_OPEN = re.compile(r"\s*+(?:#+!?|//+[!#@]?|/\*+!?|\*+|--|\"\"\"|''')\s*+")
_COMMENT_CLOSE = re.compile(r"(?:\*/|\"\"\")\Z")
_COMMENT_SIGNS = tuple("#/*-\"'")
_GENERATED = re.compile(
    r"^(?:(?:the |this )?(?:code|file|source|module|document|content|script)s? (?:(?:is|was|has been) )?)?"
    r"(?:auto(?:matically)?[ -]?)?generated(?: (?:file|code))? ?(?:by|with|from|using|on)\b"
    r"|^(?:automatically|auto|machine)[ -]?generated\b(?! (?:files?|code) (?:are|is|when|that)\b)"
    r"|^@generated\b|<auto-?generated\b|^(?:produced|emitted|created automatically) (?:by|with) \w"
    r"|\b(?:do not|don't) (?:edit|modify|change)(?: this(?: file)?| by hand| manually| directly| it)?(?:$|[.!:;,])"
    r"|\b(?:manual|hand|local|any) (?:edits|changes) (?:are|will be|get) (?:lost|overwritten|discarded)"
    r"|\b(?:changes|edits) (?:will|may) be (?:lost|overwritten)",
    re.I,
)
_NOT_GENERATED = re.compile(r"\bnot (?:\w+ )?(?:auto-?)?generated\b|^(?>.*?\bedit (?:it )?by hand\b).*\bplease\b|\bplease,? edit\b", re.I)
_NAME = r"@?[A-Za-z][\w.-]*(?:/[\w.-]+)?"
_VERSION = r"v?\d+\.\d+(?:\.\d+)*(?:[-+][\w.]+)?"
_OTHER_PROJECT = re.compile(
    rf"^(?:(?P<lead>{_NAME}) (?:version )?{_VERSION}(?=$|[\s,;|(–-])"
    rf"|.*\b(?:vendored|imported|copied|taken|bundled|adapted|forked|derived|borrowed|extracted|ported|pulled|synced)"
    rf"(?: \w+){{0,2}}? (?:from|of|in) (?:the |another |module |of )*(?P<from>{_NAME}),?(?: in)?(?: (?:version|release|tag))? {_VERSION})",
    re.I,
)
_OWN_PART = re.compile(r"part of the public interface|this (?:project|repository)|another module of", re.I)


#: Notices that say so wherever they stand, as their makers write them.
_ANYWHERE = re.compile(r"^(?:code generated .*\bdo not edit\b|@generated\b|<auto-?generated\b)", re.I)
_ANYWHERE_HINT = re.compile(r"[Gg][Ee][Nn][Ee][Rr][Aa][Tt][Ee][Dd]")


def _comment_text(line: str) -> str | None:
    """What a comment that begins the line says, without its signs."""
    m = _COMMENT_OPEN.match(line)
    return _COMMENT_CLOSE.sub("", line[m.end():].rstrip()).rstrip() if m else None


def _comment(line: str, block: bool = False) -> str | None:
    """The text of a comment that begins the line (``block``: that the line continues), without the code after it."""
    if block or line.lstrip().startswith("/*"):
        line = line.split("*/", 1)[0]
    text = _comment_text(line) if line.lstrip()[:1] in _COMMENT_SIGNS else None
    return line.strip() if text is None and block else text


def _head(lines: list[str]) -> Iterator[str]:
    """Comments before the first code, however many; of a docstring the first line."""
    end = None
    for line in lines:
        x = line.strip()
        if end:
            if end == "*/":
                yield _comment(line, True)
            if end in x:
                end = None
            continue
        text = _comment(line)
        if text is None:
            if x:
                return
            continue
        yield text
        opened = next((o for o in ("/*", '"""', "'''") if x.startswith(o)), None)
        if opened:
            close = "*/" if opened == "/*" else opened
            if close not in x[len(opened):]:
                end = close
            elif x[len(opened):].split(close, 1)[1].strip():
                return


def _says(text: str, own: str | None) -> str | None:
    if _GENERATED.search(text) and not _NOT_GENERATED.search(text):
        return "generated"
    if _OTHER_PROJECT.match(text) and not (own and own.lower() in text.lower()) and not _OWN_PART.search(text):
        return "vendored"
    return None


def notice(lines: list[str], own: str | None) -> str | None:
    """``generated`` or ``vendored`` if a comment before the code, near the head or at the end says so, or one
    anywhere in unmistakable words."""
    full = [x for x in lines if x.strip()]
    near = full[:HEAD_LINES] + full[max(HEAD_LINES, len(full) - TAIL_LINES):]
    for text in chain((t for x in near if (t := _comment(x)) is not None), _head(full)):
        if said := _says(text, own):
            return said
    for line in full:
        if _ANYWHERE_HINT.search(line) and _ANYWHERE.match(_comment(line) or ""):
            return "generated"
    return None


def named(path: str | None) -> str | None:
    """``generated`` or ``vendored`` if the path says so."""
    parts = (path or "").replace("\\", "/").lower().split("/")
    if VENDOR_DIRS.intersection(parts[:-1]):
        return "vendored"
    if OUTPUT_DIRS.intersection(parts[:-1]) or _OUTPUT_NAME.search(parts[-1]):
        return "generated"
    return None


FEATURES = (
    "compression", "token_entropy", "identifier_length", "short_identifiers", "comment_density", "log_mean_line",
    "log_longest_line", "literal_lines", "number_tokens", "space_ratio", "symbol_tokens", "log_size", "code_space_ratio",
    "line_statements",
)
#: Comments that begin a line: what stands above minified code says nothing about its layout.
_HEAD_COMMENT = re.compile(r"^[ \t]*(?://[^\n]*|/\*[\s\S]*?(?:\*/|\Z))", re.M)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\w\s]")
#: Blank lines that lead to no comment are matched as ``blank``, so that each is read once; they are none.
_COMMENT = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
    r"|(?m:^\s*+#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|pragma|undef)\b)[^\n]*)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)"
    r"|(?P<blank>(?m:^[^\S\n]*+\n\s*+))"
)
#: Literals one after the other. A number ends at its last character, or before what only then can be read: the last digit
#: of a hexadecimal one before a point, a further ``0x``, ``false`` after a suffix.
_LITERAL_LINE = re.compile(
    r"(?:[-+]?+(?:0x[\da-fA-F]+(?=\d[eE]*[._]|0x[\da-fA-F]|[fF]alse)|\d[\d.eE_]*(?=0x[\da-fA-F])"
    r"|(?:0x[\da-fA-F]++|\d[\d.eE_]*+)(?:[uUlLfF]*(?=[fF]alse)|[uUlLfF]*+))"
    r"|\"[^\"\s]*+\"|'[^'\s]*+'|null|true|false|None|True|False|nil|NULL|[\[\]{}(),:;\s])++$"
)
_BLOB = re.compile(r"[\"'`][^\"'`\s]{120,}[\"'`]")


def features(lines: list[str]) -> list[float]:
    """Statistics of a file without its notices."""
    text = "\n".join(
        x for x in lines
        if not (x.lstrip()[:1] in _COMMENT_SIGNS and len(x) < 300 and (t := _comment_text(x)) and (_GENERATED.search(t) or _OTHER_PROJECT.match(t)))
    )
    size = len(text)
    if not text.strip():
        return [0.0] * len(FEATURES)
    full = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    tokens = Counter(_TOKEN.findall(text))
    n = sum(tokens.values()) or 1
    idents = [(t, c) for t, c in tokens.items() if t[0].isalpha() or t[0] in "_$"]
    k = sum(c for _, c in idents) or 1
    literal = sum(
        len(x) + 1 for x in full
        if x.strip(" \t\r[]{}();,") and (_LITERAL_LINE.match(x) or _BLOB.search(x))
    )
    code = _HEAD_COMMENT.sub("", text)
    dense = len("".join(code.split()))
    return [
        len(zlib.compress(raw, 1)) / len(raw),
        -sum(c / n * math.log2(c / n) for c in tokens.values()) / max(1.0, math.log2(n)),
        sum(len(t) * c for t, c in idents) / k,
        sum(c for t, c in idents if len(t) <= 2) / k,
        sum(len(m[0]) for m in _COMMENT.finditer(text) if m["blank"] is None) / size,
        math.log1p(size / len(full)),
        math.log1p(max(map(len, full))),
        literal / sum(len(x) + 1 for x in full),
        sum(c for t, c in tokens.items() if t[0].isdigit()) / n,
        (size - len("".join(text.split()))) / size,
        sum(c for t, c in tokens.items() if not (t[0].isalnum() or t[0] in "_$")) / n,
        math.log1p(size),
        (len(code.strip()) - dense) / len(code.strip()) if dense else 1.0,
        (code.count(";") + code.count("{")) / sum(1 for x in code.split("\n") if x.strip()) if dense else 0.0,
    ]


_SCHEMA = "file_id long, label string, features array<double>"


def _examined(files: DataFrame, repos: DataFrame) -> DataFrame:
    own = repos.select("repo_id", F.col("name").alias("own")).dropna().dropDuplicates(["repo_id"])
    src = (
        validity.code_files(files)
        .join(own, "repo_id", "left")
        .select("file_id", "path", "own", F.transform("lines", lambda x: F.coalesce(x, F.lit(""))).alias("lines"))
    )
    src = src.withColumn("text", validity.text_of(F.col("lines"))).drop("lines")

    def examine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            labels, values = [], []
            for path, own_name, text in zip(f["path"], f["own"], f["text"]):
                lines = text.split("\n")
                labels.append(notice(lines, own_name) or named(path))
                values.append(features(lines))
            yield pd.DataFrame({"file_id": f["file_id"], "label": labels, "features": values})

    return src.mapInPandas(examine, _SCHEMA)


def _sampled(files: DataFrame, rows: int) -> DataFrame:
    n = files.count()
    if n <= rows:
        return files
    return files.filter(F.xxhash64("file_id") <= F.lit(-(2**63) + int(rows / n * 2**64)))


# Made positives


_SPACE_BETWEEN = re.compile(r"(?:(?<!\s)\s++)?+([^\w\s$\"'])\s*+")
_MADE_NAME = re.compile(r"[\"'`][^\"'`\n]*[\"'`]|(?<![\w.$])[A-Za-z_$][\w$]{2,}")


def minified(lines: list[str], rng: random.Random) -> list[str]:
    """The code on one line, or on few long ones, without comments and needless blanks, local names shortened."""
    code = _COMMENT.sub(lambda m: m["blank"] or "", "\n".join(lines))
    short: dict[str, str] = {}

    def rename(m: re.Match) -> str:
        w = m[0]
        if w[0] in "\"'`" or keyword.iskeyword(w) or w in KEPT_WORDS or rng.random() < 0.15:
            return w
        if w not in short:
            k = len(short)
            short[w] = "etnrioaswuvxyzbcdfg"[k % 19] + (str(k // 19) if k >= 19 else "")
        return short[w]

    code = " ".join(_SPACE_BETWEEN.sub(r"\1", _MADE_NAME.sub(rename, x)) for x in map(str.strip, code.split("\n")) if x)
    code = re.sub(r"(?<=[;{},()]) +", "", code)
    if rng.random() < 0.3:
        code = code[: rng.randrange(80, 600)]  # bundles of a single function
    if rng.random() < 0.5:
        return [code]
    width = rng.choice((120, 400, 900, 5000))
    return [code[k : k + width] for k in range(0, len(code), width)]


# Words of the languages that a minifier keeps.
KEPT_WORDS = frozenset(
    """break case catch class const continue default do else export for function func if import in let new null return switch
    this throw true try typeof var void while static struct unsigned int char long package range nil""".split()
)


def as_table(lines: list[str], language_like: str, rng: random.Random) -> list[str]:
    """A table of literals of about the size of a file, as data is stored in the language."""
    n = max(6, min(len(lines), 400))
    kind = rng.choice(("numbers", "hex", "decimals", "words", "rows", "blob"))
    indent = rng.choice(("  ", "    ", "\t"))
    per = rng.randrange(4, 20)

    def cell() -> str:
        if kind == "numbers":
            return str(rng.randrange(rng.choice((10, 256, 70000))))
        if kind == "hex":
            return hex(rng.randrange(256))
        if kind == "decimals":
            return f"{rng.uniform(-9, 9):.{rng.randrange(2, 7)}f}"
        if kind == "words":
            return '"' + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) + '"'
        return "(" + ", ".join(str(rng.randrange(999)) for _ in range(3)) + ")" if language_like == "py" else "[" + ", ".join(str(rng.randrange(999)) for _ in range(3)) + "]"

    name = rng.choice(("TABLE", "values", "glyph_bits", "lookup", "Rows", "codes"))
    open_, close = {
        "py": (f"{name} = [", "]"), "go": (f"package p\n\nvar {name} = []int{{", "}"), "c": (f"static const unsigned char {name}[] = {{", "};"),
        "h": (f"static const unsigned char {name}[] = {{", "};"), "ts": (f"export const {name}: number[] = [", "];"),
    }.get(language_like, (rng.choice(("module.exports = [", f"export const {name} = [", f"var {name} = [")), "];"))
    if kind == "blob":
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        if rng.random() < 0.3:
            return [open_.rstrip("[{") + '"' + "".join(rng.choices(letters, k=60 * min(n, 40))) + '"']
        body = [indent + '"' + "".join(rng.choices(letters, k=rng.choice((60, 76)))) + '"' + ("," if rng.random() < 0.2 else "") for _ in range(n)]
    else:
        body = [indent + ", ".join(cell() for _ in range(per)) + "," for _ in range(n)]
    head = [rng.choice(("# ", "// ") if language_like != "py" else ("# ",)) + "Values as measured."] if rng.random() < 0.3 else []
    return head + open_.split("\n") + body + [close]


def _made(files: DataFrame, rows: int) -> DataFrame:
    """Features of made positives, one minified and one table for each sampled file without a label."""
    src = validity.code_files(_sampled(files, rows)).select(
        "file_id", "path", validity.text_of(F.transform("lines", lambda x: F.coalesce(x, F.lit("")))).alias("text")
    )

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ident, path, text in zip(f["file_id"], f["path"], f["text"]):
                lines, rng = text.split("\n"), random.Random(int(ident))
                if notice(lines, None) or named(path) or len(text) < 80:
                    continue
                suffix = (path or "").rsplit(".", 1)[-1].lower()
                out.append((ident, features(as_table(lines, suffix, rng))))
                if suffix not in ("py", "pyi"):
                    small = minified(lines, rng)
                    if sum(map(len, small)) >= 60:
                        out.append((ident, features(small)))
            yield pd.DataFrame(out, columns=["file_id", "features"])

    return src.mapInPandas(make, "file_id long, features array<double>")


def train(
    files: DataFrame, repos: DataFrame, sample_rows: int = SAMPLE_ROWS, made_rows: int = MADE_ROWS, seen: DataFrame | None = None
) -> RandomForestClassificationModel | None:
    """The forest: labelled and made positives against the files without a label."""
    seen = _examined(files, repos) if seen is None else seen
    rows = _sampled(seen, sample_rows).select(F.col("label").isNotNull().cast("double").alias("y"), "features")
    if not rows.filter("y = 0").take(1):
        return None
    made = _made(files, made_rows)
    got = [(float(r["y"]), list(r["features"])) for r in rows.collect()]
    got += [(1.0, list(r["features"])) for r in made.collect()]
    if len({y for y, _ in got}) < 2:
        return None
    data = files.sparkSession.createDataFrame(sorted(got), "label double, x array<double>").coalesce(2).select(
        "label", array_to_vector("x").alias("features")
    ).persist()
    # a file without a label need not be written by hand: those that a coarse forest takes for made are no negatives
    coarse = RandomForestClassifier(numTrees=20, maxDepth=3, minInstancesPerNode=20, featureSubsetStrategy="0.6", seed=11).fit(data)
    doubtful = vector_to_array("probability")[1] >= DOUBTFUL
    sure = coarse.transform(data).filter((F.col("label") == 1.0) | ~doubtful).select("label", "features")
    model = RandomForestClassifier(numTrees=30, maxDepth=7, minInstancesPerNode=4, featureSubsetStrategy="0.5", seed=11).fit(sure)
    data.unpersist()
    return model


def not_handwritten(files: DataFrame, repos: DataFrame, sample_rows: int = SAMPLE_ROWS, made_rows: int = MADE_ROWS) -> DataFrame:
    """(file_id, reason, probability): files not written by hand for their repository.

    The reason is the notice's, or ``minified`` or ``data`` by what there is more of in a file that the forest found.
    """
    seen = written(_examined(files, repos))  # features are small beside the texts; both training and scoring read them
    model = train(files, repos, sample_rows, made_rows, seen)
    if model is None:
        return _once(seen.select("file_id", F.col("label").alias("reason"), F.lit(None).cast("double").alias("probability")))
    scored = model.transform(seen.withColumn("vector", array_to_vector("features")).drop("features").withColumnRenamed(
        "vector", "features"
    )).select("file_id", "label", vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"))
    at = {c: F.col("x")[i] for i, c in enumerate(FEATURES)}
    kind = F.when(at["literal_lines"] >= 0.5, F.lit("data")).otherwise(F.lit("minified"))
    return _once(
        scored.select(
            "file_id", F.coalesce("label", F.when((F.col("p") >= 0.5) & (at["log_size"] > 0), kind)).alias("reason"), F.col("p").alias("probability")
        )
    )


def _once(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNotNull()).groupBy("file_id").agg(
        F.min("reason").alias("reason"), F.max("probability").alias("probability")
    )


__all__ = ["as_table", "features", "minified", "named", "not_handwritten", "notice", "train"]
