"""Lexers of the source languages, as state maps that compose.

A chunk of lines is summarised, for every state the lexer can be in where the chunk begins, by the state it is
in at the end and by the brackets left open on either side. Such summaries compose associatively (``compose``),
so the chunks of a long file can be lexed anywhere and reduced in any grouping.

Tokens become one character each: a keyword or operator its own letter, every identifier ``x``, every number
``0``; comments nothing. The letters are private to a language's grammar (see ``grammars``).

JavaScript's templates nest: ``}`` ends a block or a substitution, whichever the brackets before the chunk say. Where a
chunk cannot know, its summary goes on from there in both ways, as entries of their own (``@position:state``), and
composition picks one.

Python needs no letters: a chunk is cut at the lines that begin a statement of the file's outermost level, the whole
statements are parsed where they lie, and only the pieces before the first and behind the last cut stay in the summary,
for each of three contexts: outside brackets (``0``), inside and out again (``x``), inside all along (``k``).
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass

#: Lexer states at a line end: normal, block comment, template or raw string, the two triple quotes, and a
#: preprocessor line that goes on, and the two quotes of a string that a backslash continues.
NORMAL, COMMENT, TEMPLATE, TRIPLE_S, TRIPLE_D, DIRECTIVE, QUOTE_S, QUOTE_D = "N", "C", "T", "s", "d", "P", "q", "Q"
_CLOSERS = {COMMENT: "*/", TEMPLATE: "`", TRIPLE_S: "'''", TRIPLE_D: '"""'}
_QUOTE_REST = {QUOTE_S: re.compile(r"(?:[^'\\\n]|\\[\s\S])*'?"), QUOTE_D: re.compile(r'(?:[^"\\\n]|\\[\s\S])*"?')}
#: Characters for what cannot be a token, and for an unterminated string.
BAD = "\x00"

# Suffixes of the languages.
SUFFIX_LANGUAGE = {
    "py": "python", "pyi": "python", "pyw": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "go": "go", "c": "c", "h": "c",
}
CODE_LANGUAGES = ("python", "javascript", "typescript", "go", "c")


class _Codes(dict):
    """Memo from token to character; bounded, as tokens come from the data."""

    def __init__(self, words: dict[str, str], limit: int = 200_000):
        super().__init__(words)
        self._words, self._limit = words, limit

    def __missing__(self, token: str) -> str:
        c = token[0]
        if token[:2] == "#!":
            code = ""
        elif c.isalpha() or c in "_$" or c > "\x7f" or (c == "#" and len(token) > 1):
            code = "x"
        elif c.isdigit() or (c == "." and len(token) > 1):
            code = "0"
        elif c in "\"'":
            code = '"' if len(token) > 1 and token[-1] == c else BAD
        elif c == "`":
            code = "`"
        elif token.startswith(("//", "/*")):
            code = ""
        elif c == "/" and len(token) > 1:
            code = "/"
        else:
            code = BAD
        if len(token) < 80:
            if len(self) > self._limit:
                self.clear()
                self.update(self._words)
            self[token] = code
        return code


def _words(**by_code: str) -> dict[str, str]:
    return {w: code for code, names in by_code.items() for w in names.split()}


def _ops(pairs: str) -> dict[str, str]:
    """``"op:code op:code"``; a code of ``_`` means the operator itself."""
    out = {}
    for p in pairs.split():
        op, _, code = p.rpartition("~")
        out[op] = op if code == "_" else code
    return out


_STRINGS = r"""|"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?"""
_COMMENTS = r"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
#: A template whose substitutions hold no braces, quotes or line ends is one token; of others, the opening tick is one.
_TEMPLATE = r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`\"'/\n]*\})*`|`"
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_BEFORE_REGEX = r"[=(,:!&|?{}\[;+~^<>%*\n-]"
_REGEX = (
    rf"|(?:(?<={_BEFORE_REGEX})|(?<={_BEFORE_REGEX}[ \t])|(?<=return )|(?<=typeof )|(?<=case )|\A)"
    r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
)

#: One token a match, or a lone character that no rule knows; blanks match nothing.
TOKENS = {
    "javascript": re.compile(
        r"\n|[A-Za-z_$\u0080-\U0010ffff][\w$]*"
        + _COMMENTS + _STRINGS + _TEMPLATE + _REGEX
        + r"|0[xXbBoO]\w+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?n?|\.\d[\d_]*(?:[eE][+-]?\d+)?"
        r"|\A#![^\n]*|\#[A-Za-z_$][\w$]*"
        r"|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--"
        r"|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|\S"
    ),
    "go": re.compile(
        r"\n|[A-Za-z_\u0080-\U0010ffff]\w*"
        + _COMMENTS + r"""|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.[^'\n]*)'?|`[^`]*(?:`|\Z)"""
        + r"|0[xXbBoO][\w.]+(?:(?<=[pP])[+-]\d+)?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?i?|\.\d[\d_]*(?:[eE][+-]?\d+)?i?"
        r"|\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|==|!=|<=|>=|&&|\|\||<<|>>|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
    ),
    "c": re.compile(
        r"\n|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\[\s\S])*\"?|[A-Za-z_$\u0080-\U0010ffff][\w$]*"
        + _COMMENTS + r"""|'(?:[^'\\\n]|\\[\s\S])*'?"""
        + r"|0[xX][\w.]+(?:(?<=[pP])[+-]\d+)?|\d[\d']*(?:\.\d*)?(?:[eE][+-]?\d+)?[uUlLfF]*|\.\d+(?:[eE][+-]?\d+)?[fFlL]*"
        r"|\#(?:[^\n\\/]|\\\r?\n|\\.|/(?!\*)|/\*[\s\S]*?(?:\*/|\Z))*"
        r"|\.\.\.|<<=|>>=|->|\+\+|--|==|!=|<=|>=|&&|\|\||<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
    ),
    "python": re.compile(
        r"""\n|\#[^\n]*|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"""(?:[^\\]|\\[\s\S])*?(?:\"""|\Z)"""
        r"""|"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?|[()\[\]{}]"""
    ),
}
TOKENS["typescript"] = TOKENS["javascript"]

# Keywords and operators by their letters.
_JS_WORDS = _words(
    v="const let var", F="function", C="class", E="extends", N="new", r="return", t="throw", i="if", e="else",
    f="for", w="while", d="do", S="switch", k="case", D="default", b="break continue", T="try", c="catch",
    y="finally", I="import", X="export", l="in instanceof", u="typeof void delete", A="await", Y="yield",
    a="async", o="of", s="static", g="get set", m="from", q="as", W="with", h="this super null true false",
    z="debugger",
)
_TS_WORDS = _JS_WORDS | _words(
    J="interface", j="type", n="enum", B="declare", P="namespace module", R="readonly", L="abstract",
    M="public private protected override", K="keyof", U="infer unique", V="is", H="implements", G="asserts",
    Q="satisfies",
)
_JS_OPS = _ops(
    "\n~_ (~_ )~_ [~_ ]~_ {~_ }~_ ;~_ ,~_ :~_ ?~_ .~_ ?.~. ...~… =>~→ =~_ ==~% ===~% !=~% !==~% <~_ >~_ <=~% >=~% "
    "&&~% ||~% ??~% &~& |~| ^~% <<~% +~_ -~_ *~_ /~% %~% **~% !~_ ~~_ ++~p --~p @~_ "
    "+=~ä -=~ä *=~ä /=~ä %=~ä &=~ä |=~ä ^=~ä **=~ä <<=~ä &&=~ä ||=~ä ??=~ä"
) | {"\n": "\n"}
_GO_WORDS = _words(
    K="package", I="import", c="const", v="var", t="type", F="func", s="struct", n="interface", m="map", h="chan",
    i="if", e="else", f="for", R="range", S="switch", k="case", D="default", L="select", g="go defer", r="return",
    b="break continue", o="goto", q="fallthrough",
)
_GO_OPS = _ops(
    "(~_ )~_ [~_ ]~_ {~_ }~_ ;~_ ,~_ :~_ .~_ ...~… :=~d =~_ <-~w ++~p --~p !~! ~~_ "
    "==~% !=~% <~% >~% <=~% >=~% &&~% ||~% <<~% >>~% &^~% /~% %~% |~| +~+ -~- *~* &~& ^~^ "
    "+=~ä -=~ä *=~ä /=~ä %=~ä &=~ä |=~ä ^=~ä <<=~ä >>=~ä &^=~ä"
) | {"\n": "\n"}
_C_WORDS = _words(
    T="void char short int long float double signed unsigned _Bool _Complex bool",
    q="const volatile restrict static extern register inline auto _Noreturn _Atomic _Thread_local __inline "
    "__inline__ __restrict __extension__ __volatile__ __const",
    y="typedef", s="struct union", e="enum", z="sizeof _Alignof alignof __alignof__", i="if", l="else", f="for",
    w="while", d="do", S="switch", k="case", D="default", b="break continue", r="return", g="goto",
    α="__attribute__ __declspec __asm__ asm _Alignas alignas _Static_assert",
)
_C_OPS = _ops(
    "(~_ )~_ [~_ ]~_ {~_ }~_ ;~_ ,~_ :~_ ?~_ .~. ->~. ...~… =~_ ==~% !=~% <~% >~% <=~% >=~% &&~% ||~% <<~% >>~% "
    "/~% %~% |~% ^~% +~+ -~- *~* &~& !~! ~~_ ++~p --~p "
    "+=~ä -=~ä *=~ä /=~ä %=~ä &=~ä |=~ä ^=~ä <<=~ä >>=~ä"
) | {"\n": ""}


class _CCodes(_Codes):
    def __missing__(self, token: str) -> str:
        if token[0] == "#":
            word = token[1:].lstrip()
            return "⟨" if word.startswith("if") else "⟩" if word.startswith("endif") else ""
        if token[-1:] == '"' and token[0] in "uUL" and len(token) > 2:
            return '"'
        return super().__missing__(token)


class _PyCodes(_Codes):
    def __missing__(self, token: str) -> str:
        q = token[:3]
        if token[0] == "#":
            return ""
        if q in ("'''", '"""'):
            return '"' if len(token) >= 6 and token.endswith(q) else BAD
        return super().__missing__(token)


CODES = {
    "javascript": _Codes(_JS_WORDS | _JS_OPS),
    "typescript": _Codes(_TS_WORDS | _JS_OPS),
    "go": _Codes(_GO_WORDS | _GO_OPS | {}),
    "c": _CCodes(_C_WORDS | _C_OPS),
    "python": _PyCodes({"\n": "", **{b: b for b in "()[]{}"}}),
}
_GO_RAW_OR_RUNE = str.maketrans({"`": '"'})


def encode(language: str, tokens: list[str]) -> str:
    """The code string of a token list."""
    code = "".join(map(CODES[language].__getitem__, tokens))
    return code.translate(_GO_RAW_OR_RUNE) if language == "go" else code


def open_state(language: str, token: str) -> str:
    """The state in which a chunk ends whose last token is this one."""
    if language == "python":
        q = token[:3]
        if q in ("'''", '"""'):
            return NORMAL if len(token) >= 6 and token.endswith(q) else TRIPLE_S if q == "'''" else TRIPLE_D
        if token[0] in "'\"" and token[-1] == "\n":
            return QUOTE_S if token[0] == "'" else QUOTE_D
        return NORMAL
    if token.startswith("/*") and not (len(token) >= 4 and token.endswith("*/")):
        return COMMENT
    if language == "c" and token[0] == "#" and token.endswith(("\\\n", "\\\r\n")):
        return DIRECTIVE
    if language == "go" and token[0] == "`" and not (len(token) >= 2 and token[-1] == "`"):
        return TEMPLATE
    if language != "go" and token[-1] == "\n" and token[-2:-1] in ("\\", "\r"):
        quote = token.lstrip("uUL8")[0]
        return QUOTE_S if quote == "'" else QUOTE_D if quote == '"' else NORMAL
    return NORMAL


_REST_OF_DIRECTIVE = re.compile(r"(?:[^\n\\]|\\[\s\S])*")
_PAIRS = re.compile(r"\(\)|\[\]|\{\}")
_NO_BRACKET = re.compile(r"[^()\[\]{}$]+")


def bracket_summary(code: str) -> str:
    """Brackets of a code string that find no partner in it: closers, then openers, if nothing mismatches."""
    left = _NO_BRACKET.sub("", code)
    while True:
        shorter = _PAIRS.sub("", left)
        if len(shorter) == len(left):
            return left
        left = shorter


@dataclass(frozen=True)
class ChunkSummary:
    """For each entry: exit state (or ``@position``, where the brackets before decide), unmatched brackets, and the code
    string (Python: whether the statements parsed, and the pieces before the first and behind the last cut)."""

    by_state: dict[str, tuple]
    length: int = 0


def states_of(language: str) -> tuple[str, ...]:
    if language == "python":
        return (NORMAL, TRIPLE_S, TRIPLE_D, QUOTE_S, QUOTE_D)
    if language == "go":
        return (NORMAL, COMMENT, TEMPLATE)
    return (NORMAL, COMMENT, QUOTE_S, QUOTE_D, DIRECTIVE if language == "c" else TEMPLATE)


def _enter(language: str, text: str, state: str) -> tuple[int, str, str | None]:
    """Where NORMAL begins in a chunk entered in another state, the code of what ended there, and the exit state if
    NORMAL never comes."""
    if state == DIRECTIVE:
        at = _REST_OF_DIRECTIVE.match(text).end()
        return at, "", DIRECTIVE if at == len(text) and text.endswith(("\\\n", "\\\r\n")) else None
    if state in _QUOTE_REST:
        m = _QUOTE_REST[state].match(text)
        if m.end() == len(text) and m[0].endswith(("\\\n", "\\\r\n")):
            return len(text), "", state
        closed = m[0][-1:] == ("'" if state == QUOTE_S else '"')
        return m.end(), '"' if closed else BAD, None
    closer = _CLOSERS[state]
    at = text.find(closer)
    while at >= 0 and language == "python" and (at - len(text[:at].rstrip("\\"))) % 2:
        at = text.find(closer, at + 1)
    if at < 0:
        return len(text), "", state
    return at + len(closer), "" if state == COMMENT else '"', None


def lex_from(language: str, text: str, state: str) -> tuple[str, str, str]:
    """Exit state, bracket summary and code of a Go or C chunk, or of JavaScript without substitutions, entered in ``state``."""
    lead = ""
    if state != NORMAL:
        at, lead, stays = _enter(language, text, state)
        if stays:
            return stays, "", ""
        text = text[at:]
    tokens = TOKENS[language].findall(text)
    exit_state = open_state(language, tokens[-1]) if tokens else NORMAL
    if exit_state not in (NORMAL, DIRECTIVE):
        tokens.pop()
    code = lead + encode(language, tokens)
    return exit_state, bracket_summary(code), code


def _lex_templates(language: str, text: str, pos: int, state: str) -> tuple[str, str, str]:
    """As ``lex_from``, from ``pos`` on, with nested templates, up to a ``}`` without a partner, which what stands before the chunk
    decides (in a file's first chunk it is an error)."""
    code: list[str] = []
    stack: list[str] = []  # brackets without a partner
    codes, tokens = CODES[language], TOKENS[language]
    if state not in (NORMAL, TEMPLATE):
        pos, lead, stays = _enter(language, text, state)
        if stays:
            return stays, "", ""
        code.append(lead)
        state = NORMAL
    while True:
        if state == TEMPLATE:
            pos = _TEMPLATE_TEXT.match(text, pos).end()
            if text[pos : pos + 1] == "`":
                pos += 1
            elif text[pos : pos + 2] == "${":
                stack.append("$")
                code.append("(")
                pos += 2
            else:
                return TEMPLATE, "".join(stack), "".join(code)
        state, last = NORMAL, ""
        for m in tokens.finditer(text, pos):
            last = t = m[0]
            if t == "`":
                code.append(t)
                state, pos = TEMPLATE, m.end()
                break
            if t in ("(", "[", "{"):
                stack.append(t)
            elif t in (")", "]", "}"):
                if t == "}" and (not stack or stack[-1] in ")]}"):
                    return f"@{m.end()}", "".join(stack), "".join(code)
                if stack and stack[-1] == "$" and t == "}":
                    stack.pop()
                    code.append(")")
                    state, pos = TEMPLATE, m.end()
                    break
                if stack and stack[-1] + t in ("()", "[]", "{}"):
                    stack.pop()
                else:
                    stack.append(t)
            code.append(codes[t])
        if state == NORMAL:
            end = open_state(language, last) if last else NORMAL
            if end != NORMAL:
                code.pop()
            return end, "".join(stack), "".join(code)


def summarise(language: str, text: str, first: bool = False) -> ChunkSummary:
    """The state map of a chunk; of a file's first chunk only the entry in NORMAL is of use."""
    entries = (NORMAL,) if first else states_of(language)
    if language == "python":
        return ChunkSummary({k: v for s in entries for k, v in _python_pieces(text, s, first).items()}, len(text))
    if language not in ("javascript", "typescript") or (first and "`" not in text):
        return ChunkSummary({s: lex_from(language, text, s) for s in entries}, len(text))
    out = {s: _lex_templates(language, text, 0, s) for s in entries}
    todo = [] if first else [v[0] for v in out.values()]
    while todo:
        at = todo.pop()
        if at[0] == "@" and f"{at}:{NORMAL}" not in out:
            for s in (NORMAL, TEMPLATE):
                out[f"{at}:{s}"] = _lex_templates(language, text, int(at[1:]), s)
                todo.append(out[f"{at}:{s}"][0])
    return ChunkSummary(out, len(text))


def tokenize(language: str, text: str) -> list[str]:
    """The tokens of a whole file; a template with all its substitutions is one."""
    if language not in ("javascript", "typescript") or "${" not in text:
        return TOKENS[language].findall(text)
    out, pos, pattern = [], 0, TOKENS[language]
    while True:
        for m in pattern.finditer(text, pos):
            if m[0] == "`":
                pos = _template_end(language, text, m.end())
                out.append(text[m.start() : pos])
                break
            out.append(m[0])
        else:
            return out


def _template_end(language: str, text: str, pos: int) -> int:
    """The place behind a template whose text begins at ``pos``."""
    while True:
        pos = _TEMPLATE_TEXT.match(text, pos).end()
        if text[pos : pos + 2] != "${":
            return min(len(text), pos + 1)
        pos, depth = pos + 2, 1
        while depth and pos < len(text):
            m = TOKENS[language].search(text, pos)
            if not m:
                return len(text)
            depth += (m[0] == "{") - (m[0] == "}")
            pos = _template_end(language, text, m.end()) if m[0] == "`" else m.end()


# Python: statements


_STATEMENT_START = re.compile(r"(?!(?:else|elif|except|finally)\b)[^\s#)\]}]")
_HARD_KEYWORD = re.compile(r"[ \t]*(?:def|class|import|return|while|with|try|raise|pass|assert|del|global|nonlocal|break|continue)\b")


def python_tree(text: str) -> ast.Module | bool | None:
    """The tree; None if the text does not parse; True if it is too deep to tell."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return compile(text, "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (RecursionError, MemoryError):
        return True
    except (SyntaxError, ValueError):
        return None


def _python_pieces(text: str, state: str, first: bool) -> dict[str, tuple]:
    """The entries of a chunk in one lexer state, for each context."""
    pos = 0
    exit_state: str | None = None
    bad = False
    if state != NORMAL:
        pos, lead, exit_state = _enter("python", text, state)
        bad = lead == BAD
    starts: list[tuple[int, int]] = [] if pos else [(0, 0)]
    depth = low = low_at = 0
    stack: list[str] = []
    closers: list[str] = []
    last = ""
    if exit_state is None:
        for m in TOKENS["python"].finditer(text, pos):
            last = t = m[0]
            if t == "\n":
                starts.append((m.end(), depth))
            elif t in "([{":
                stack.append(t)
                depth += 1
            elif t in ")]}":
                depth -= 1
                if not stack:
                    closers.append(t)
                    low, low_at = depth, m.end()
                elif stack.pop() + t not in ("()", "[]", "{}"):
                    bad = True
            elif t[0] in "'\"" and t[-1] != t[0] and t[-1] != "\n" and len(t) < len(text) - m.start() and t[:3] not in ("'''", '"""'):
                bad = True
        exit_state = open_state("python", last) if last else NORMAL
    brackets = "".join(closers + stack)
    broken = (exit_state, brackets, (False, "", None))
    if bad:
        return {state + c: broken for c in ("0" if first else "0xk")}
    cuts, before = [], None
    for at, d in starts:
        if d == low and at >= low_at and _STATEMENT_START.match(text, at) and text[at - 2 : at - 1] != "\\" and text[at - 3 : at - 1] != "\\\r":
            if before is not None and text[before] != "@":
                cuts.append(at)
            before = at
    if cuts:
        ok = all(python_tree(text[a:b]) is not None for a, b in zip(cuts, cuts[1:]))
        outside = (exit_state, brackets, (ok, text[: cuts[0]], text[cuts[-1] :]) if ok else (False, "", None))
    else:
        outside = (exit_state, brackets, (True, text, None))
    out = {state + "0": broken if closers else outside}
    if not first:
        out[state + "x"] = outside if closers else broken
        inside = any(_HARD_KEYWORD.match(text, at) for at, _ in starts[1:])
        out[state + "k"] = broken if inside else (exit_state, brackets, (True, text, None))
    return out


def python_sound(total: ChunkSummary) -> bool:
    """The verdict on a whole file's summary."""
    state, brackets, (ok, head, tail) = total.by_state[NORMAL + "0"]
    return (
        ok and state == NORMAL and not brackets and python_tree(head) is not None and (tail is None or python_tree(tail) is not None)
    )


def _join_pieces(a: tuple, b: tuple) -> tuple:
    if not (a[0] and b[0]):
        return (False, "", None)
    if a[2] is None:
        return (True, a[1] + b[1], b[2])
    if b[2] is None:
        return (True, a[1], a[2] + b[1])
    return (True, a[1], b[2]) if python_tree(a[2] + b[1]) is not None else (False, "", None)


def _compose_python(a: ChunkSummary, b: ChunkSummary) -> ChunkSummary:
    out = {}
    for key, (mid, left, pieces) in a.by_state.items():
        state, context = key
        inner = sum(x in "([{" for x in left)
        outer = sum(x in ")]}" for x in b.by_state[mid + "0"][1])
        if context == "k" or (context == "x" and outer > inner):
            pieces = a.by_state[state + "k"][2]
            then = context
        elif outer > inner:
            then = None
        else:
            then = "0" if not inner else "x" if outer == inner else "k"
        end, right, more = b.by_state[mid + (then or "0")]
        out[key] = (end, bracket_summary(left + right), _join_pieces(pieces, more) if then else (False, "", None))
    return ChunkSummary(out, a.length + b.length)


def compose(a: ChunkSummary, b: ChunkSummary) -> ChunkSummary:
    """The summary of chunk ``a`` followed by chunk ``b``; associative."""
    if any(k[-1] in "0xk" for k in a.by_state):
        return _compose_python(a, b)

    def follow(end: str, left: str, code: str) -> tuple[str, str, str]:
        key = end
        while True:
            end, right, more = b.by_state[key]
            left, code = bracket_summary(left + right), code + more
            if end[0] != "@":
                return end, left, code
            if not left or left[-1] in ")]}":
                return f"@{a.length + int(end[1:])}", left, code
            if left[-1] == "$":
                left, code, key = left[:-1], code + ")", f"{end}:{TEMPLATE}"
            else:  # a block ends here, or brackets do not match
                left, code, key = bracket_summary(left + "}"), code + "}", f"{end}:{NORMAL}"

    out = {k: v if v[0][0] == "@" else follow(*v) for k, v in a.by_state.items()}
    for k in b.by_state:
        if k[0] == "@":
            at, s = k[1:].split(":")
            end, brackets, code = b.by_state[k]
            out[f"@{a.length + int(at)}:{s}"] = (f"@{a.length + int(end[1:])}" if end[0] == "@" else end, brackets, code)
    return ChunkSummary(out, a.length + b.length)
