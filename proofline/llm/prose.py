"""Per-document text quality statistics, and the documents that are not prose.

Method: gradient-boosted trees on document statistics, trained on weak labels (clearly prose, clearly structural
junk), their margins calibrated to probabilities on a holdout checked by hand. The trees decide alone.

The weak labels come from a sentence test that is hidden from the features and runs on the training sample only: the
share of characters in sentences, above or below wide cuts. A sentence is a stretch of at least three words with a verb
that has something before it (or an imperative before its object); layouts such as tables, logs, listings, code and
key-value lines are no sentences whatever words they hold. The features are plain counts over the whole text.

Defined results: a null text is an empty one; empty and blank documents, and those without a word, are not prose.
Rows with a null ``doc_id`` are ignored; of repeated ids each delivery is judged and the id is returned if any
is not prose. Extra columns are ignored. If the sample has no document of one of the two labels, no trees are
trained, and the sentence test decides everywhere, at half of the characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample; which documents are in it is decided by a hash of their id.
SAMPLE_ROWS = 12_000
#: Weak labels: share of characters in sentences from which a document is clearly prose, or clearly not.
CLEAR_PROSE, CLEAR_JUNK = 0.85, 0.15
#: Weight of the prior (the trees' own probability) in the calibration, which has few points.
PRIOR = 0.2

# Common words of several languages.
COMMON = {
    "en": "the a an and or of to in is are was were be been it its this that these those for on by with from at as if "
    "then than when while not no you we they he she i his her our your their which who what there here so but into "
    "about after before because can will would should must has have had do does did all each every some any more",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war nicht kein keine keinen von zu im in "
    "mit auf für aus bei nach vor über unter wenn weil dass als auch noch nur wie wir ihr sie er es ohne seit bevor obwohl",
    "es": "el la los las un una unos unas y o de del que en no con por para su sus se es son fue como más pero sin sobre "
    "cuando porque aunque desde hasta este esta ese esa lo le al ya muy antes",
    "fr": "le la les un une des et ou de du que qui en ne pas avec pour par sur dans son sa ses se est sont été comme plus "
    "mais sans cette ce il elle nous vous ils au aux",
    "it": "il lo la gli le un una e o di del della che in non con per da su suo sua si è sono come più ma senza questo questa",
    "pt": "o a os as um uma e ou de do da que em não com por para seu sua se é são foi como mais mas sem este esta",
    "nl": "de het een en of van te in is zijn was niet geen met op voor uit bij na om als ook nog maar dat die dit deze er",
}
_COMMON_ALL = frozenset(w for words in COMMON.values() for w in words.split())
_FOREIGN = frozenset(w for k, words in COMMON.items() if k != "en" for w in words.split() if len(w) > 1) - frozenset(
    COMMON["en"].split()
)
# Words that are finite verbs wherever they stand.
SURE_VERBS = frozenset(
    """is are was were am isn't aren't wasn't weren't has have had hasn't haven't does do did don't doesn't didn't can cannot
    can't could couldn't will won't would wouldn't should shouldn't shall must may might seems became went came said
    made took gave got knew thought found wrote told felt kept began showed heard ran brought grew left lost meant saw
    it's that's there's you're we're they're i'm he's she's
    ist sind war waren hat haben hatte wird werden wurde kann können muss müssen soll sollte darf gibt macht geht kommt steht
    bleibt braucht ersetzt meldet findet behält nennt liest verliert prüft erklärt endet hinsieht zeigt enthält schreibt lädt
    está están fue fueron puede pueden debe deben hay tiene tienen hace guarda muestra explica nombra reemplaza encuentra lee
    revisa pierde necesita cambió mira termine contiene escribe carga permite dice
    est sont était peut doit fait montre contient è può deve fa zijn heeft wordt kan moet é são tem pode deve""".split()
)
# Verbs that can be nouns or adjectives too; their place decides.
BASE_VERBS = frozenset(
    """accept add agree allow answer appear apply arrive ask avoid become begin believe belong break bring build call carry
    catch cause change check choose close collect come compare complete contain continue copy correct count cover create cut decide
    define delete deliver depend describe disable disagree disappear discard drop emit enable end ensure enter exist expand
    expect explain fail fall feel fetch fill find finish fit follow forget format get give go grow handle happen hear help hide
    hold ignore improve include increase insert join jump keep know lead learn leave let lie like list live load look lose
    love make mark match mean measure meet mention merge miss move name need notice offer open own overlap parse pass pay play
    point prefer prevent print promise protect provide pull push put raise reach read rebuild receive record reduce refer
    reject release rely remain remember remove rename repeat replace report require resolve rest restore return run save say
    see seem select send serve set share show sit skip sleep solve speak spend split stand start state stay stop store suggest
    support suppose suppress surprise swallow take talk teach tell test think throw touch track travel treat try turn
    understand update use verify visit wait walk want warn watch win wish work write""".split()
)
_DETERMINERS = frozenset("the a an this that these those each every our your his her its their my no some any all one".split())
_AFTER_VERB = _DETERMINERS | {"it", "them", "him", "us", "me"}
_BEFORE_BASE = frozenset(
    "you we they i to then not never often quickly still also only always just please who which that who cannot and".split()
)
_NOT_BEFORE_S = _DETERMINERS | frozenset("of for with in on at by from about without under over and or".split())

_LINE_END = re.compile(r"\r\n|\r|\n")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?/?>")
_CODE_NAME = re.compile(r"`[^`\n]*`|\b\w+(?:[./]\w+)+(?:\(\))?|\b\w*_\w+(?:\([^()\n]*\))?|\b[a-z]+[A-Z]\w*(?:\([^()\n]*\))?")
_CODE_SIGN = re.compile(r"[`_/(]|\w\.\w|[a-z][A-Z]")
_LEAD = re.compile(r"^(?:[\s>#*+|•·–—=~/;:%!-]|\d+[.)](?=\s)|[^\w\s`\"'“‘«(<\[{¿¡@])+")
_STRUCTURE = re.compile(
    r"^\s*(?:"
    r"[{\[].*[}\]],?$|[\]})]+[,;]*$|\||@@|[-+]\s{2,}\S|\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d:\d\d|--?\w[\w-]*(?:\s|$)(?!.*[.?!]$)"
    r"|(?:def|class|return|import|from|func|package|const|let|var|if|for|while|else|try|except|function|public|private|static|int|void)\b.*[:;{}()]\s*$"
    r"|[\w.\[\]\"']+\s*(?:[-+*/|]?=|:=|=>)\s*\S.*$|[\w.]+\(.*\)[;,]?$|File \"|Traceback |\w[\w.-]*:\s+\S+$|#include|\$\s"
    r"|[A-Za-z0-9+/=]{24,}$)"
    r"|\|\s*$|\t.*\t|\S {2,}\S.* {2,}\S"
)
#: What every structure has one of; looked for first, as most lines of prose have none.
_STRUCTURE_SIGN = re.compile(r"[{}\[\]()|@=:;$#\t\"]|  |^\s*[-+\d]|^[A-Za-z0-9+/=]{24,}$|Traceback ")
_SENTENCE_END = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_OTHER_SCRIPT = re.compile(r"[Ѐ-ӿͰ-Ͽ֐-ࣿऀ-๿]")


def _is_sentence(text: str) -> bool:
    """Whether a stretch of text has a subject and a verb."""
    ascii_only = text.isascii()
    if not ascii_only and _CJK.search(text):
        return len(_CJK.findall(text)) >= 5 and bool(re.search(r"[。！？のはをがです了是的不]|다", text))
    words = _WORD.findall(_CODE_NAME.sub(" x ", text) if _CODE_SIGN.search(text) else text)
    n = len(words)
    if n < 3:
        return False
    low = [w.lower().replace("’", "'") for w in words]
    verbs = foreign = 0
    for i, w in enumerate(low):
        if verbs and n <= 45 * verbs:
            return True
        if w in SURE_VERBS:
            verbs += i > 0 or n > 3
            continue
        if w in _FOREIGN:
            foreign += 1
        prev = low[i - 1] if i else ""
        if w in BASE_VERBS:
            if not i:
                verbs += low[1] in _DETERMINERS
            elif prev in _BEFORE_BASE or prev in SURE_VERBS or (len(prev) > 3 and prev[-1] == "s" and prev[-2] != "s"):
                verbs += 1
        elif w[-1] == "s" and i and len(w) > 3 and prev not in _NOT_BEFORE_S:
            verbs += (
                w[:-1] in BASE_VERBS
                or (w[-2] == "e" and w[:-2] in BASE_VERBS)
                or (w.endswith("ies") and w[:-3] + "y" in BASE_VERBS)
                or (i + 1 < n and prev[-1] != "s" and low[i + 1] in _AFTER_VERB)
            )
        elif w.endswith("ed") and len(w) > 4 and i and prev not in _NOT_BEFORE_S and i + 1 < n:
            verbs += (w[:-2] in BASE_VERBS or w[:-1] in BASE_VERBS or w[:-3] in BASE_VERBS) and low[i + 1] in (
                _DETERMINERS | {"to", "by", "in", "on", "that", "as", "with", "it", "them"}
            )
        elif w[-1] == "t" and i and len(w) > 4 and words[i].islower() and words[i - 1][0].isupper() and any(
            x in ("der", "die", "das", "den", "dem", "ein", "eine", "und", "nicht") for x in low
        ):
            verbs += 1
    if not verbs and not ascii_only and _OTHER_SCRIPT.search(text):
        return n >= 4 and text.rstrip()[-1:] in ".?!"
    if not verbs and foreign >= max(2, 0.25 * n) and n >= 5:
        return True
    return verbs > 0 and n <= 45 * verbs


def sentence_characters(text: str) -> tuple[int, int, int, int]:
    """Characters in sentences, all characters of content, lines of structure, lines with content."""
    inside = total = structure = lines = 0
    paragraph: list[str] = []

    def close() -> tuple[int, int]:
        if not paragraph:
            return 0, 0
        longest = max(map(len, paragraph))
        each_own = len(paragraph) > 1 and all(not p[0].islower() for p in paragraph)
        parts = [paragraph[0]]
        for before, line in zip(paragraph, paragraph[1:]):
            if not line[0].islower() and (each_own or len(before) < 0.7 * longest):
                parts.append(line)
            elif each_own is False and len(before) < 28 and len(line) < 28:
                parts.append(line)
            else:
                parts[-1] += " " + line
        good = whole = 0
        for p in parts:
            for s in _SENTENCE_END.split(p):
                whole += len(s)
                if len(s) > 6 and _is_sentence(s):
                    good += len(s)
        paragraph.clear()
        return good, whole

    for raw in _LINE_END.split(text):
        line = raw.strip("﻿ \t\f\v ")
        if not line:
            g, w = close()
            inside, total = inside + g, total + w
            continue
        if "<" in line:
            line = _TAG.sub(" ", line).strip()
        body = _LEAD.sub("", line).strip()
        if not body or not any(map(str.isalnum, body)):
            if len(line) > 4 or not body and any(c.isalnum() for c in line):
                total += len(line)
                structure += 1
                lines += 1
            elif len(line) <= 4:
                g, w = close()
                inside, total = inside + g, total + w
            continue
        lines += 1
        if (_STRUCTURE_SIGN.search(line) and _STRUCTURE.search(line)) or (
            body is not line and _STRUCTURE_SIGN.search(body) and _STRUCTURE.search(body)
        ):
            g, w = close()
            inside, total = inside + g, total + w
            total += len(line)
            structure += 1
        else:
            paragraph.append(body)
    g, w = close()
    return inside + g, total + w, structure, lines


FEATURES = (
    "log_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "upper_ratio",
    "distinct_words", "mean_line_length", "bullet_lines", "long_words", "repeated_lines", "comma_ratio", "space_ratio",
)
_PUNCTUATED = tuple(".!?:;…。！？")
_COUNTS = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")


def statistics(text: str | None) -> dict[str, float]:
    """The statistics of a text, over all of it."""
    text = text or ""
    full = [y for x in _LINE_END.split(text) if (y := x.strip())]
    words = _WORD.findall(text)
    low = " ".join(words).lower().split(" ") if words else []
    n, chars = len(words), len(text)
    distinct = Counter(low)
    letters = sum(map(len, words))
    spaces = chars - len("".join(text.split()))
    digits = sum(map(text.count, "0123456789"))
    return {
        "word_count": n,
        "mean_word_length": letters / n if n else 0.0,
        "symbol_ratio": (chars - spaces - letters) / chars if chars else 0.0,
        "punctuated_lines": sum(x.endswith(_PUNCTUATED) for x in full) / len(full) if full else 0.0,
        "common_words": sum(c for w, c in distinct.items() if w in _COMMON_ALL) / n if n else 0.0,
        "log_words": math.log1p(n),
        "digit_ratio": digits / chars if chars else 0.0,
        "upper_ratio": sum(1 for w in words if w[0].isupper()) / n if n else 0.0,
        "distinct_words": len(distinct) / n if n else 0.0,
        "mean_line_length": min(400.0, chars / len(full)) if full else 0.0,
        "bullet_lines": sum(x[0] in "-*+•|{[0123456789" for x in full) / len(full) if full else 0.0,
        "long_words": sum(c for w, c in distinct.items() if len(w) > 14) / n if n else 0.0,
        "repeated_lines": 1 - len(set(full)) / len(full) if full else 0.0,
        "comma_ratio": text.count(",") / chars if chars else 0.0,
        "space_ratio": spaces / chars if chars else 0.0,
    }


def sentence_share(text: str | None) -> float:
    """Share of the characters of content that stand in sentences; zero without content."""
    inside, total, _, _ = sentence_characters(text or "")
    return inside / total if total else 0.0


_STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} {'long' if c == 'word_count' else 'double'}" for c in _COUNTS) + ", share double, features array<double>"


def _measured(documents: DataFrame, share: bool = False) -> DataFrame:
    """Statistics and features of each delivery; ``share``: also the sentence test's verdict."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [statistics(t) for t in f["text"]]
            out = pd.DataFrame({"doc_id": f["doc_id"]} | {c: [r[c] for r in rows] for c in _COUNTS})
            out["share"] = [sentence_share(t) if share else None for t in f["text"]]
            out["share"] = out["share"].astype("float64")
            out["features"] = [[r[c] for c in FEATURES] for r in rows]
            yield out

    return documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).mapInPandas(measure, _STATS_SCHEMA)


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, word_count, mean_word_length, symbol_ratio, punctuated_lines, common_words)."""
    return _measured(documents).select("doc_id", "word_count", *[F.round(c, 6).alias(c) for c in _COUNTS[1:]])


def sample_of(documents: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` documents, chosen by a hash of their id; all where there are fewer."""
    n = documents.count()
    if n <= rows:
        return documents
    limit = -(2**63) + int(rows / n * 2**64)
    return documents.filter(F.xxhash64("doc_id") <= F.lit(limit))


# Texts checked by hand, with 1 where less than half of the characters stand in sentences.
HOLDOUT: tuple[tuple[int, str], ...] = (
    (0, "We moved the parser to its own package last week. Nothing else changed, but please read the guide before you upgrade."),
    (0, "the cache was cold, so the first run took longer\nafter that every request came back within a second"),
    (0, "// The reader keeps two buffers and swaps them\n// when the writer falls behind. This avoids a lock."),
    (0, "> I tried it on a clean machine and it works.\n> You should close the ticket."),
    (0, "<p>Users expect the list to stay sorted.</p>\n<p>If a row changes, we sort it again.</p>"),
    (0, "Der Dienst startet nicht, weil die Datei fehlt. Wir prüfen das morgen noch einmal."),
    (0, "El servicio no arranca porque falta el archivo. Lo revisamos mañana con el equipo."),
    (0, "Old branches keep their names. New tickets follow the same rule, small fixes skip review."),
    (0, "Le service ne démarre pas parce que le fichier est absent. Nous allons vérifier cela demain."),
    (0, "# Notes\n\nThe build fails on two machines. Both run the old compiler, which does not know the flag.\n\n- gcc 4\n- gcc 5"),
    (0, "Why does the scanner skip hidden folders? It has always done so, and nobody asked for a switch."),
    (0, "1. Open the settings page and choose the second tab.\n2. Then type the name of the group, and press save."),
    (0, "WE HAVE SEEN THIS BEFORE. THE SERVER RUNS OUT OF HANDLES WHEN THE LOG ROTATES."),
    (0, "She asked whether the tests cover the new path, and they do. We merged it on Friday after lunch."),
    (0, "It is known that the clock drifts. The monitor corrects it every hour.\n\nhost: alpha\nport: 8080"),
    (1, ""),
    (1, "   \n\n "),
    (1, "name\tsize\tkind\nalpha\t12\tfile\nbeta\t99\tfolder\ngamma\t4\tfile"),
    (1, "| key | value |\n|---|---|\n| the first row | of each list |\n| for a short name | in the table |"),
    (1, "2024-01-01T10:00:00Z INFO web.server[12] status=200\n2024-01-01T10:00:01Z WARN web.server[12] status=500"),
    (1, "def area(r):\n    x = r * r\n    return scale(x)\n\ndef edge(r):\n    return 4 * r"),
    (1, '{"id": 1, "kind": "a"}\n{"id": 2, "kind": "b"}\n{"id": 3, "kind": "c"}'),
    (1, "1. The history of the house . . . . 4\n2. On the nature of a garden . . . . 9\n3. A short walk and the river . . 12"),
    (1, "Home\nAbout\nPrevious | Next\nSearch\nSign in\nHelp > Contact\nTop"),
    (1, "apple, pear, plum, fig, grape, melon, lemon, lime, peach, cherry, berry, date"),
    (1, "@@ -1,2 +1,3 @@\n-    a = read(x)\n+    a = load(x)\n     return a"),
    (1, "aGVsbG8gd29ybGQgdGhpcyBpcyBub3Q\nSGVsbG9Xb3JsZFRoaXNJc05vdFByb3Nl\nQUJDREVGR0hJSktMTU5PUFFSU1RVVldY"),
    (1, "* feat(ui): blue button (#12)\n* fix(api): missing header (#13)\n* chore(deps): newer parser (#14)"),
    (1, "color: red\nwidth: 10\nheight: 20\nmode: fast\ndebug: false\nlevel: info"),
    (1, "  --output PATH  (default: out)\n  --jobs N  (default: 4)\n  --quiet\n  --format NAME"),
    (1, "  12.5   9.1   3.3\n   4.0   8.8   7.1\n   6.2   1.9   5.5"),
    (1, "%%%((==**))--!!??//\\\\||{{}}##@@\n$$^^&&**(())__++==--::;;"),
    (1, "Here are the names.\n- `readFile`\n- `write_file`\n- src/io/open.py\n- small helper\n- next step\n- `closeAll`"),
    (1, 'Traceback (most recent call last):\n  File "a.py", line 3, in run\n    x = load(y)\n  File "b.py", line 9, in load\n    z = parse(x)'),
    (1, "red house\nblue door\ngreen roof\nsmall window\nold fence\nlong path\nwide gate"),
    (1, "Ã©ta Â mi lo Ã¼ne ��ra Â so Ã©li â€™ka po ��ne Ã¼ta vo Â ru"),
)


def _calibration(model: GBTClassificationModel) -> tuple[float, float]:
    """Slope and intercept of the probability on the margin (logistic), from the holdout.

    The prior is the trees' own probability, whose slope is two.
    """
    points = []
    for label, text in HOLDOUT:
        s = statistics(text)
        raw = model.predictRaw(Vectors.dense([s[c] for c in FEATURES]))
        points.append((float(raw[1]), label))
    a, b = 2.0, 0.0
    for _ in range(2000):
        ga, gb = PRIOR * (a - 2.0), PRIOR * b
        for x, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            ga += (p - y) * x / len(points)
            gb += (p - y) / len(points)
        a, b = a - 0.2 * ga, b - 0.2 * gb
    return a, b


def train(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[GBTClassificationModel, float, float] | None:
    """Trees and calibration, from weak labels on a bounded sample."""
    rows = _measured(sample_of(documents, sample_rows), share=True).select("doc_id", "share", "features").toPandas()
    rows = rows[(rows["share"] >= CLEAR_PROSE) | (rows["share"] <= CLEAR_JUNK)].sort_values("doc_id")
    label = (rows["share"] <= CLEAR_JUNK).astype(float)
    if label.nunique() < 2:
        return None
    spark = documents.sparkSession
    data = (
        spark.createDataFrame(
            [(float(y), [float(v) for v in x]) for y, x in zip(label, rows["features"])], "label double, x array<double>"
        )
        .coalesce(1)
        .select("label", array_to_vector("x").alias("features"))
        .persist()
    )
    model = GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.3, seed=7, featureSubsetStrategy="0.5").fit(data)
    data.unpersist()
    return (model, *_calibration(model))


def not_prose(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, junk_probability) of documents that are not natural prose."""
    trained = train(documents, sample_rows)
    if trained is None:
        return _measured(documents, share=True).filter((F.col("share") < 0.5) | (F.col("word_count") == 0)).select(
            "doc_id", F.lit(None).cast("double").alias("junk_probability")
        )
    model, a, b = trained
    scored = model.transform(_measured(documents).withColumn("features", array_to_vector("features")))
    p = 1 / (1 + F.exp(-(F.lit(a) * vector_to_array("rawPrediction")[1] + F.lit(b))))
    return (
        scored.select("doc_id", p.alias("junk_probability"), "word_count")
        .filter((F.col("word_count") == 0) | (F.col("junk_probability") > 0.5))
        .select("doc_id", "junk_probability")
    )


__all__ = ["document_statistics", "not_prose", "sentence_characters", "sentence_share", "statistics", "train"]
