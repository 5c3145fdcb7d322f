"""Functions paired with their documentation.

Method: the comments that can be documentation and the function declarations near them form a bipartite graph;
an edge weighs the distance in lines, the agreement of parameter tags with the arguments and mentions of the
name. The heaviest assignment links each function with at most one comment. A link that ends just above the
declaration stands by its place; one over blank lines or other code is implausible, and rejected, unless tags or names
speak for it (``PLAUSIBLE``). Uninformative descriptions are rejected too. In Python the docstring is part of the
function, so that its link is certain. ``code_doc_pairs`` gives all accepted links with their distance,
``documented_functions`` those that the language's convention knows: the comment ends on the line just above.

Defined results: the lines decide, an older extraction is not consulted. Files that do not parse, are of no
supported language, or have null ``lines`` give no pairs; null elements are empty lines. Of repeated deliveries
of a ``file_id`` the latest counts (equal times: the greater hash of the content). Rows with null ``file_id`` are ignored. Extra columns are ignored; an empty
table gives no rows. Two functions declared on the same line with the same name count once.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm import lexers, validity

#: Lines below a comment in which a declaration is a candidate for it.
WINDOW = 3
MIN_WORDS = 4
#: Weight from which a link that does not end just above a declaration is accepted: more than any distance can give.
PLAUSIBLE = 2.5

# A description whose words are all among these says that there is none, or where one is.
FILLER_WORDS = frozenset(
    """a above add added again all an and any as at available base be been below below by class code coming comment
    comments described describe description desc details do doc docs docstring document documentation documented done
    elsewhere empty entry file fill filled fix fixme follow follows for found from function further given goes guide
    has have header help here hidden how implementation in info information inherit inherited inheritdoc interface is
    it itself its later manual me method missing module more my name need needed needs no none not note now of on one
    or original overridden override page parent pending placeholder please provided readme refer reference same see
    should some soon source spec still stub super superclass tba tbd text that the there this to todo under
    undocumented unknown use until usage wiki will wip with write written xxx yet""".split()
)
FILLER_SIGNS = frozenset(
    """desc description describe described doc docs docstring document documentation documented elsewhere fixme
    inherit inherited inheritdoc missing none parent placeholder readme refer see stub tba tbd todo undocumented
    wiki wip written xxx comment text""".split()
)

_WORD = re.compile(r"[^\W_]+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+|[A-Z]")
_TAG_PARAM = re.compile(r"(?:@param\s+(?:\{[^}]*\}\s*)?\[?|:param\s+(?:[\w\[\], .|]+\s+)??)\*{0,2}([A-Za-z_$][\w$]*)")
_GO_DIRECTIVE = re.compile(r"//(?:[a-z0-9]+:[a-z0-9]|line |export |extern )")


@dataclass
class Function:
    name: str
    line: int  # of the name
    first_line: int  # of the declaration
    end_line: int
    args: list[str]
    distance: int = 1  # lines from the end of its comment to the declaration


@dataclass
class Comment:
    first_line: int
    line: int  # the last
    text: str
    edges: list[tuple[int, float]] = field(default_factory=list)


def name_words(name: str) -> set[str]:
    """Words of a function's name: split at ``_`` and at capitals; letters and digits also in one run."""
    parts: set[str] = set()
    for run in re.split(r"[_$#]+", name):
        spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", run)
        parts.update(w.lower() for w in spaced.split())
        parts.update(w.lower() for w in _NAME_PART.findall(run))
    return parts


def described(text: str) -> str:
    """The description without its tag lines."""
    return "\n".join(x for x in text.split("\n") if not x.lstrip().startswith(("@", ":")))


def informative(text: str, name: str) -> bool:
    """Whether a documentation says something."""
    own = name_words(name)
    words = [w.lower() for w in _WORD.findall(described(text))]
    if sum(w not in own for w in words) < MIN_WORDS:
        return False
    return not (FILLER_SIGNS.intersection(words) and all(w in FILLER_WORDS or w in own for w in words))


# Python


def python_pairs(text: str) -> list[tuple[Function, str]]:
    tree = lexers.python_tree(text)
    if not isinstance(tree, ast.Module):
        return []
    out, todo = [], [tree.body]
    while todo:
        for node in todo.pop():
            kind = type(node)
            if kind in (ast.FunctionDef, ast.AsyncFunctionDef):
                first = node.body[0]
                if (
                    type(first) is ast.Expr and type(first.value) is ast.Constant and type(first.value.value) is str
                ):
                    doc = first.value.value
                    if informative(doc, node.name):
                        a = node.args
                        args = [x.arg for x in a.posonlyargs + a.args]
                        args += ["*" + a.vararg.arg] if a.vararg else []
                        args += [x.arg for x in a.kwonlyargs]
                        args += ["**" + a.kwarg.arg] if a.kwarg else []
                        start = node.decorator_list[0].lineno if node.decorator_list else node.lineno
                        out.append((Function(node.name, node.lineno, start, node.end_lineno, args), doc))
                todo.append(node.body)
            elif kind is ast.Expr or kind is ast.Assign or kind is ast.Return:
                continue
            else:
                for part in ("body", "orelse", "finalbody"):
                    inner = getattr(node, part, None)
                    if isinstance(inner, list) and inner:
                        todo.append(inner)
                for part in ("handlers", "cases"):
                    todo.extend(h.body for h in getattr(node, part, ()))
    return out


# Languages with comments above declarations


class Tokens:
    """Tokens of a file with their lines; comments and line ends apart."""

    def __init__(self, language: str, text: str):
        self.language = language
        self.text = text
        self.raw = lexers.tokenize(language, text)
        self.sig: list[str] = []
        self.lines: list[int] = []
        self.comments: list[tuple[str, int, int, bool]] = []  # token, first and last line, alone on its line so far
        self.first_on_line: dict[int, int] = {}
        line, busy = 1, 0
        sig, lines = self.sig, self.lines
        for t in self.raw:
            if t == "\n":
                line += 1
                continue
            two = t[:2]
            if two == "//" or two == "/*":
                n = t.count("\n")
                self.comments.append((t, line, line + n, busy != line))
                line += n
                continue
            if t[0] == "#" and language == "c":
                line += t.count("\n")
                busy = line
                self.first_on_line.setdefault(line, -1)
                continue
            if busy != line:
                self.first_on_line[line] = len(sig)
                busy = line
            sig.append(t)
            lines.append(line)
            if "\n" in t:
                line += t.count("\n")
                busy = line

    def close(self, i: int) -> int:
        """Index of the partner of the opening bracket at i."""
        depth = 0
        for j in range(i, len(self.sig)):
            t = self.sig[j]
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth -= 1
                if not depth:
                    return j
        return len(self.sig) - 1

    def valid(self) -> bool:
        if any(t[0] == "`" and "${" in t for t in self.raw):
            return validity.parses(self.language, self.text)
        if self.raw and lexers.open_state(self.language, self.raw[-1]) != lexers.NORMAL:
            return False
        code = lexers.encode(self.language, self.raw)
        return validity.accepts_code(
            self.language, lexers.ChunkSummary({lexers.NORMAL: (lexers.NORMAL, lexers.bracket_summary(code), code)})
        )


def _clean_block(token: str) -> str:
    body = token[2:-2] if token.endswith("*/") else token[2:]
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x) if k else x.lstrip("*! ") for k, x in enumerate(body.split("\n"))).strip()


def doc_comments(tok: Tokens) -> list[Comment]:
    """Comments that can be documentation in the language."""
    out: list[Comment] = []
    run: list[tuple[str, int]] = []  # lines of a run of line comments, and their numbers

    def flush() -> None:
        if run:
            texts = [t for t, _ in run if not (tok.language == "go" and _GO_DIRECTIVE.match(t))]
            out.append(Comment(run[0][1], run[-1][1], "\n".join(x.lstrip("/! \t") for x in texts)))
            run.clear()

    mark = {"go": "//", "c": "///"}.get(tok.language)
    for token, first, last, alone in tok.comments:
        if token.startswith("//"):
            if mark and alone and token.startswith(mark):
                if run and run[-1][1] != first - 1:
                    flush()
                run.append((token, first))
            elif run:
                flush()
            continue
        flush()
        if tok.language in ("go", "c") or token.startswith("/**"):
            out.append(Comment(first, last, _clean_block(token)))
    flush()
    return out


# Words that stand before a method's name, and words that no method is called by.
_MODIFIERS = {"static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override", "abstract", "accessor"}
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "with", "new", "typeof", "await", "do", "else", "super", "throw"}
_IDENT = re.compile(r"[#A-Za-z_$\u0080-\U0010ffff][\w$]*\Z")


def _split_args(tok: Tokens, i: int, j: int) -> list[list[str]]:
    """Tokens between the brackets at i and j, split at the commas between them."""
    out: list[list[str]] = [[]]
    depth = 0
    for t in tok.sig[i + 1 : j]:
        if t in "([{<":
            depth += 1
        elif t in ")]}>":
            depth -= 1
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _js_args(tok: Tokens, i: int, j: int) -> list[str]:
    names = []
    for p in _split_args(tok, i, j):
        p = [t for t in p if t not in ("public", "private", "protected", "readonly")] or p
        names.append(("..." + p[1]) if p[0] == "..." and len(p) > 1 else p[0] if _IDENT.match(p[0]) else "".join(p))
    return names


def _js_function(tok: Tokens, i: int) -> Function | None:
    sig, n = tok.sig, len(tok.sig)
    start = i

    def at(k: int) -> str:
        return sig[k] if k < n else ""

    def made(name_at: int, open_at: int, body_at: int, args: list[str]) -> Function:
        end = tok.close(body_at) if at(body_at) == "{" else body_at
        return Function(sig[name_at], tok.lines[name_at], tok.lines[start], tok.lines[min(end, n - 1)], args)

    def body_after(close: int) -> int:
        """Index of the body's brace behind a parameter list, or -1."""
        k = close + 1
        if at(k) == "{":
            return k
        if at(k) != ":" or tok.language != "typescript":
            return -1
        k += 1
        while k < n and at(k) not in (";", "}", "=>"):
            if at(k) == "{":
                e = tok.close(k)
                if at(k - 1) not in (":", "|", "&", "<", ","):
                    return k
                k = e
            elif at(k) in "([":
                k = tok.close(k)
            k += 1
        return -1

    while at(i) in ("export", "default", "declare"):
        i += 1
    if at(i) == "async" and at(i + 1) == "function":
        i += 1
    if at(i) == "function":
        k = i + 2 if at(i + 1) == "*" else i + 1
        if not _IDENT.match(at(k)):
            return None
        p = k + 1
        while p < n and at(p) != "(":
            p += 1
        close = tok.close(p) if p < n else n - 1
        body = body_after(close)
        return made(k, p, body, _js_args(tok, p, close)) if body > 0 else None
    if at(i) in ("const", "let", "var"):
        k = i + 1
        if not _IDENT.match(at(k)):
            return None
        e = k + 1
        if at(e) == ":":
            while e < n and at(e) not in ("=", ";"):
                e = tok.close(e) + 1 if at(e) in "([{" else e + 1
        if at(e) != "=":
            return None
        e += 1
        if at(e) == "async":
            e += 1
        if at(e) == "function":
            p = e + 1
            while p < n and at(p) != "(":
                p += 1
            close = tok.close(p) if p < n else n - 1
            body = body_after(close)
            return made(k, p, body, _js_args(tok, p, close)) if body > 0 else None
        if at(e) == "<":
            while e < n and at(e) != "(":
                e += 1
        if at(e) == "(":
            close = tok.close(e)
            a = close + 1
            if at(a) == ":":
                while a < n and at(a) not in ("=>", ";"):
                    a = tok.close(a) + 1 if at(a) in "([{" else a + 1
            if at(a) == "=>" and at(a + 1) == "{":
                return made(k, e, a + 1, _js_args(tok, e, close))
        elif _IDENT.match(at(e)) and at(e + 1) == "=>" and at(e + 2) == "{":
            return made(k, e, e + 2, [at(e)])
        return None
    while at(i) in _MODIFIERS and at(i + 1) not in ("(", "=", ":", ";", "<", "?", "!", ""):
        i += 1
    if not _IDENT.match(at(i)) or at(i) in _NO_METHOD:
        return None
    p = i + 1
    if at(p) == "<":
        while p < n and at(p) not in ("(", ";", "{"):
            p += 1
    if at(p) != "(":
        return None
    close = tok.close(p)
    body = body_after(close)
    return made(i, p, body, _js_args(tok, p, close)) if body > 0 else None


def _go_function(tok: Tokens, i: int) -> Function | None:
    sig, n = tok.sig, len(tok.sig)
    start = i
    if sig[i] != "func":
        return None
    i += 1
    if i < n and sig[i] == "(":
        i = tok.close(i) + 1
    if i >= n or not _IDENT.match(sig[i]):
        return None
    name_at = i
    i += 1
    if i < n and sig[i] == "[":
        i = tok.close(i) + 1
    if i >= n or sig[i] != "(":
        return None
    close = tok.close(i)
    args = [p[0] for p in _split_args(tok, i, close)]
    k = close + 1
    line = tok.lines[close]
    while k < n and sig[k] != "{" and tok.lines[k] == line:
        k = tok.close(k) + 1 if sig[k] in "([" else k + 1
    end = tok.close(k) if k < n and sig[k] == "{" and tok.lines[k] == line else close
    return Function(sig[name_at], tok.lines[name_at], tok.lines[start], tok.lines[end], args)


def _c_function(tok: Tokens, i: int) -> Function | None:
    sig, n = tok.sig, len(tok.sig)
    start = i
    if sig[i] in ("typedef", "return", "if", "for", "while", "switch", "else", "do", "case"):
        return None
    while i < n:
        t = sig[i]
        if t in ("__attribute__", "__declspec", "_Alignas") and i + 1 < n:
            i = tok.close(i + 1) + 1
            continue
        if t == "(":
            if i == start or not _IDENT.match(sig[i - 1]) or i - 1 == start and not (i > start):
                return None
            break
        if not (_IDENT.match(t) or t == "*"):
            return None
        i += 1
    else:
        return None
    name_at, close = i - 1, tok.close(i)
    k = close + 1
    while k < n and sig[k] == "__attribute__":
        k = tok.close(k + 1) + 1
    if k < n and _IDENT.match(sig[k]):  # parameter declarations of the old style
        while k < n and sig[k] not in ("{", "}", "("):
            k += 1
    if k >= n or sig[k] != "{":
        return None
    args = []
    for p in _split_args(tok, i, close):
        names = [t for t in p if _IDENT.match(t)]
        if p != ["void"]:
            args.append(names[-1] if names else "".join(p))
    return Function(sig[name_at], tok.lines[name_at], tok.lines[start], tok.lines[tok.close(k)], args)


_DECLARATION = {"javascript": _js_function, "typescript": _js_function, "go": _go_function, "c": _c_function}


def assignment(weights: Sequence[Sequence[float]]) -> list[int]:
    """Heaviest assignment of rows to columns (Hungarian method); -1 where a row stays alone."""
    n, m = len(weights), len(weights[0])
    size = max(n, m)
    cost = [[-(weights[r][c] if r < n and c < m else 0.0) for c in range(size)] for r in range(size)]
    inf = float("inf")
    u, v, match, way = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for r in range(1, size + 1):
        match[0], c0 = r, 0
        low, used = [inf] * (size + 1), [False] * (size + 1)
        while True:
            used[c0] = True
            r0, delta, c1 = match[c0], inf, 0
            for c in range(1, size + 1):
                if not used[c]:
                    cur = cost[r0 - 1][c - 1] - u[r0] - v[c]
                    if cur < low[c]:
                        low[c], way[c] = cur, c0
                    if low[c] < delta:
                        delta, c1 = low[c], c
            for c in range(size + 1):
                if used[c]:
                    u[match[c]] += delta
                    v[c] -= delta
                else:
                    low[c] -= delta
            c0 = c1
            if not match[c0]:
                break
        while c0:
            match[c0], c0 = match[way[c0]], way[c0]
    out = [-1] * n
    for c in range(1, m + 1):
        if 0 < match[c] <= n and weights[match[c] - 1][c - 1] > 0:
            out[match[c] - 1] = c - 1
    return out


def link_weight(comment: Comment, fn: Function) -> float:
    """Larger for near declarations, agreeing parameter tags and a mention of the name; tags of other names count against."""
    weight = 4.0 / (fn.first_line - comment.line) if fn.first_line == comment.line + 1 else 2.0 / (fn.first_line - comment.line)
    tags = set(_TAG_PARAM.findall(comment.text))
    if tags:
        weight += 3.0 * len(tags.intersection(a.lstrip("*.") for a in fn.args)) / len(tags) - 1.0
    if re.search(rf"(?<!\w){re.escape(fn.name)}(?!\w)", comment.text):
        weight += 1.5
    return max(weight, 0.01)


def plausible(comment: Comment, fn: Function) -> bool:
    """Whether an assigned link is accepted."""
    return fn.first_line == comment.line + 1 or link_weight(comment, fn) >= PLAUSIBLE


def comment_pairs(language: str, text: str) -> list[tuple[Function, str]]:
    if (language in ("javascript", "typescript") and "/**" not in text) or (language in ("go", "c") and "/" not in text):
        return []
    tok = Tokens(language, text)
    comments = doc_comments(tok)
    functions: list[Function] = []
    seen: dict[int, int] = {}
    for c in comments:
        for line in range(c.line + 1, c.line + 1 + WINDOW):
            at = tok.first_on_line.get(line, -1)
            if at < 0:
                continue
            if at not in seen:
                fn = _DECLARATION[language](tok, at)
                seen[at] = len(functions) if fn else -1
                if fn:
                    functions.append(fn)
            if seen[at] >= 0:
                c.edges.append((seen[at], link_weight(c, functions[seen[at]])))
    comments = [c for c in comments if c.edges]
    if not comments:
        return []
    pairs = []
    for group in _components(comments):
        if len(group) == 1 and len(group[0].edges) == 1:
            linked = [(group[0], functions[group[0].edges[0][0]])]
        else:
            cols = sorted({f for c in group for f, _ in c.edges})
            place = {f: k for k, f in enumerate(cols)}
            weights = [[0.0] * len(cols) for _ in group]
            for r, c in enumerate(group):
                for f, w in c.edges:
                    weights[r][place[f]] = w
            linked = [(group[r], functions[cols[k]]) for r, k in enumerate(assignment(weights)) if k >= 0]
        for c, fn in linked:
            if plausible(c, fn) and informative(c.text, fn.name):
                fn.distance = fn.first_line - c.line
                pairs.append((fn, c.text))
    return pairs if pairs and tok.valid() else []


def _components(comments: list[Comment]) -> list[list[Comment]]:
    """Comments that compete for functions; edges reach a few lines only, so groups are runs."""
    out: list[list[Comment]] = []
    last: set[int] = set()
    for c in comments:
        mine = {f for f, _ in c.edges}
        if out and mine & last:
            out[-1].append(c)
            last |= mine
        else:
            out.append([c])
            last = mine
    return out


def pairs_of(language: str, text: str) -> list[tuple[Function, str]]:
    """Pairs of a file, in order of lines."""
    text = text.removeprefix("﻿")
    got = python_pairs(text) if language == "python" else comment_pairs(language, text)
    return sorted(got, key=lambda p: (p[0].line, p[0].name))


_KEYS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("lineno", T.IntegerType())]))
_FULL = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("lineno", T.IntegerType()),
            T.StructField("first_lineno", T.IntegerType()),
            T.StructField("end_lineno", T.IntegerType()),
            T.StructField("args", T.ArrayType(T.StringType())),
            T.StructField("description", T.StringType()),
            T.StructField("distance", T.IntegerType()),
        ]
    )
)


@F.pandas_udf(_KEYS)
def _keys(language: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series(
        [[{"name": f.name, "lineno": f.line} for f, _ in pairs_of(a, b) if f.distance == 1] for a, b in zip(language, text)], dtype="object"
    )


@F.pandas_udf(_FULL)
def _full(language: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [
                {
                    "name": f.name, "lineno": f.line, "first_lineno": f.first_line, "end_lineno": f.end_line,
                    "args": f.args, "description": described(d).strip(),
                    "distance": f.distance,
                }
                for f, d in pairs_of(a, b)
            ]
            for a, b in zip(language, text)
        ],
        dtype="object",
    )


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, name, lineno) of each function with a documentation that is not trivial."""
    got = validity.code_files(files).select(
        "file_id", validity.delivery_order().alias("at"),
        _keys("language", validity.text_of(F.col("lines"))).alias("pairs"),
    )
    return (
        got.groupBy("file_id")
        .agg(F.max_by("pairs", "at").alias("pairs"))
        .select("file_id", F.explode("pairs").alias("p"))
        .select("file_id", "p.name", "p.lineno")
        .distinct()
    )


def code_doc_pairs(files: DataFrame) -> DataFrame:
    """Pairs of code and description with file, name, arguments and line."""
    src = validity.code_files(files)
    got = src.select(
        "file_id", "language", "lines", validity.delivery_order().alias("at"),
        _full("language", validity.text_of(F.col("lines"))).alias("pairs"),
    )
    rows = got.select(
        "file_id", "language", "at",
        F.transform(
            "pairs",
            lambda p: F.struct(
                p["name"].alias("name"), p["lineno"].alias("lineno"), p["args"].alias("args"),
                p["description"].alias("description"), p["distance"].alias("distance"),
                validity.text_of(
                    F.slice("lines", p["first_lineno"], p["end_lineno"] - p["first_lineno"] + 1)
                ).alias("code"),
            ),
        ).alias("pairs"),
    )
    return (
        rows.groupBy("file_id")
        .agg(F.max_by(F.struct("language", "pairs"), "at").alias("r"))
        .select("file_id", "r.language", "r.pairs")
        .select("file_id", "language", F.explode("pairs").alias("p"))
        .select("file_id", "language", "p.name", "p.lineno", "p.args", "p.description", "p.distance", "p.code")
    )


__all__ = ["assignment", "code_doc_pairs", "documented_functions", "informative", "name_words", "pairs_of"]
