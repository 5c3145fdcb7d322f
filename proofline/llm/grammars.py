"""Local grammars over code strings (see ``lexers``).

A file's code string is reduced from the inside: an innermost bracket group is judged by its content alone and
replaced by one character that says what the group can be (call arguments, a block, an object literal, ...).
What remains has no brackets, so each grammar is a small recursive descent over a short string, and its
verdict is remembered by that string: sources repeat the same few shapes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Private characters: paren, bracket and brace groups, each with a mask of up to eight roles.
_BASE = {"(": 0xE000, "[": 0xE100, "{": 0xE200}
_INNERMOST = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
_MEMO_LIMIT = 300_000


class Bad(Exception):
    """The string is no sentence of the grammar."""


class Grammar:
    """Reduction of groups and the start rule; subclasses hold the rules.

    Rules take (s, i) and return the index behind what they read, or raise ``Bad``.
    """

    #: Per opener, the role predicates in order of their bits: name of a rule that must read the whole content.
    roles: dict[str, tuple[str, ...]] = {}

    def __init__(self):
        self._memo: dict[str, str] = {}
        self._whole: dict[tuple[str, str], bool] = {}

    def reads(self, rule: str, s: str) -> bool:
        try:
            return getattr(self, rule)(s, 0) >= len(s)
        except (Bad, IndexError, RecursionError):
            return False

    def _group(self, m: re.Match) -> str:
        key = m[0]
        got = self._memo.get(key)
        if got is None:
            opener = key[0]
            content = self.clean(opener, key[1:-1])
            mask = 0
            for bit, rule in enumerate(self.roles[opener]):
                if self.reads(rule, content):
                    mask |= 1 << bit
            got = chr(_BASE[opener] + mask)
            if len(key) < 400:
                if len(self._memo) > _MEMO_LIMIT:
                    self._memo.clear()
                self._memo[key] = got
        return got

    def clean(self, opener: str, content: str) -> str:
        return content if opener == "{" else content.replace("\n", "")

    def prepare(self, code: str) -> str:
        return code

    def accepts(self, code: str) -> bool:
        """Whether the code string is a whole file."""
        code = self.prepare(code)
        n = 1
        while n:
            code, n = _INNERMOST.subn(self._group, code)
        return self.reads("file", code)

    @staticmethod
    def at(s: str, i: int) -> str:
        return s[i] if i < len(s) else ""

    @staticmethod
    def is_group(c: str, opener: str, bit: int) -> bool:
        """Whether c is a group of this bracket that can play the role."""
        return bool(c) and 0 <= ord(c) - _BASE[opener] < 256 and bool((ord(c) - _BASE[opener]) >> bit & 1)

    def need(self, s: str, i: int, opener: str, bit: int) -> int:
        if self.is_group(self.at(s, i), opener, bit):
            return i + 1
        raise Bad

    def char(self, s: str, i: int, c: str) -> int:
        if self.at(s, i) == c:
            return i + 1
        raise Bad

    def listing(self, s: str, i: int, item: Callable[[str, int], int], trailing: bool = True, empty: bool = True) -> int:
        """Items between commas, up to the end of the string."""
        if i >= len(s):
            if empty:
                return i
            raise Bad
        while True:
            i = item(s, i)
            if i >= len(s):
                return i
            i = self.char(s, i, ",")
            if i >= len(s):
                if trailing:
                    return i
                raise Bad


class JavaScript(Grammar):
    """JavaScript as module or script; with ``types``, TypeScript."""

    roles = {
        "(": ("args", "paren", "params", "for_header", "paren_type"),
        "[": ("elements", "index", "type_list", "index_signature"),
        "{": ("block", "object", "class_body", "switch_body", "names", "type_body", "enum_body"),
    }
    ARGS, PAREN, PARAMS, HEADER, PAREN_TYPE = range(5)
    ELEMENTS, INDEX, TYPE_LIST, SIGNATURE = range(4)
    BLOCK, OBJECT, CLASS, SWITCH, NAMES, TYPE_BODY, ENUM = range(7)

    _WORDS = "xvFCENrtieEfwdSkDbTcyIXluAYaosgmqWhzJjnBPRLMKUVHGQ"
    #: Letters that can stand for a plain identifier.
    _SOFT_JS, _SOFT_TS = set("xaosgmq"), set("xaosgmqJjnBPRLMKUVHGQ")
    _DROP = re.compile(
        r"(?<=[{(\[,;:=→.?+\-*%!~&|…äFCENtieEdTyXluAkSWfw@])\n+"
        r"|\n+(?=[)\]},;:=?.*%&|→ä]|[lE](?![:=(]))|(?<=\))\n+(?=\{)|\A\n+|\n+\Z"
    )

    def __init__(self, types: bool):
        super().__init__()
        self.types = types
        self.soft = self._SOFT_TS if types else self._SOFT_JS

    def prepare(self, code: str) -> str:
        return self._DROP.sub("", code)

    def clean(self, opener: str, content: str) -> str:
        return content.strip("\n") if opener == "{" else content.replace("\n", "")

    # Statements

    def file(self, s: str, i: int) -> int:
        return self.statements(s, i)

    def block(self, s: str, i: int) -> int:
        return self.statements(s, i)

    def statements(self, s: str, i: int, stop: str = "") -> int:
        n = len(s)
        while i < n:
            c = s[i]
            if c in "\n;":
                i += 1
            elif stop and c in stop and self._case_here(s, i):
                return i
            else:
                i = self.statement(s, i)
        return i

    def _case_here(self, s: str, i: int) -> bool:
        return s[i] == "k" or self.at(s, i + 1) == ":"

    def end(self, s: str, i: int) -> int:
        if i >= len(s):
            return i
        if s[i] in ";\n":
            return i + 1
        if s[i] in "kD" and i + 1 < len(s):
            raise Bad
        raise Bad

    def skip(self, s: str, i: int) -> int:
        while i < len(s) and s[i] == "\n":
            i += 1
        return i

    def statement(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        if i >= len(s):
            raise Bad
        c = s[i]
        nxt = self.at(s, i + 1)
        if c == ";":
            return i + 1
        if 0 <= ord(c) - _BASE["{"] < 256:  # no expression statement begins with a brace
            return self.need(s, i, "{", self.BLOCK)
        if c == "v":
            if self.types and nxt == "n":
                return self._enum(s, i + 2)
            if not (nxt and nxt in ".=" and False):
                return self.end(s, self.bindings(s, i + 1))
        if c == "F" or (c == "a" and nxt == "F"):
            return self.function(s, i, named=True)
        if c == "C":
            return self.class_(s, i, named=True)
        if c == "@":
            i = self.postfix(s, i + 1)
            return self.statement(s, i)
        if c == "i":
            i = self.statement(s, self.need(s, i + 1, "(", self.PAREN))
            j = self.skip(s, i)
            if self.at(s, j) == "e":
                return self.statement(s, j + 1)
            return i
        if c == "w" or c == "W":
            return self.statement(s, self.need(s, i + 1, "(", self.PAREN))
        if c == "d":
            i = self.skip(s, self.statement(s, i + 1))
            i = self.need(s, self.char(s, i, "w"), "(", self.PAREN)
            return i + 1 if self.at(s, i) == ";" else i
        if c == "f":
            i += 2 if nxt == "A" else 1
            return self.statement(s, self.need(s, i, "(", self.HEADER))
        if c == "S":
            return self.need(s, self.need(s, i + 1, "(", self.PAREN), "{", self.SWITCH)
        if c == "T":
            i = self.need(s, i + 1, "{", self.BLOCK)
            j, some = self.skip(s, i), False
            if self.at(s, j) == "c":
                j += 1
                if 0 <= ord(self.at(s, j) or " ") - _BASE["("] < 256:
                    j = self.need(s, j, "(", self.PARAMS)
                i, some = self.need(s, j, "{", self.BLOCK), True
                j = self.skip(s, i)
            if self.at(s, j) == "y":
                i, some = self.need(s, j + 1, "{", self.BLOCK), True
            if not some:
                raise Bad
            return i
        if c == "r":
            if not nxt or nxt in ";\n":
                return self.end(s, i + 1)
            return self.end(s, self.expression(s, i + 1))
        if c == "t":
            return self.end(s, self.expression(s, i + 1))
        if c == "b":
            i += 1
            if self.at(s, i) in self.soft:
                i += 1
            return self.end(s, i)
        if c == "z":
            return self.end(s, i + 1)
        if c == "I" and nxt != "." and not self.is_group(nxt, "(", self.ARGS):
            return self.import_(s, i + 1)
        if c == "X":
            return self.export(s, i + 1)
        if self.types:
            got = self._ts_statement(s, i, c, nxt)
            if got is not None:
                return got
        if c in self.soft and nxt == ":":
            return self.statement(s, i + 2)
        return self.end(s, self.expression(s, i))

    def _ts_statement(self, s: str, i: int, c: str, nxt: str) -> int | None:
        if c == "B" and nxt and nxt in "vFCanJjPLB":
            if nxt == "P" or nxt == "x":
                return self._ts_statement(s, i + 1, nxt, self.at(s, i + 2))
            return self.statement(s, i + 1)
        if c == "B" and nxt == "x" and self.is_group(self.at(s, i + 2), "{", self.BLOCK):  # declare global
            return i + 3
        if c == "L" and nxt == "C":
            return self.class_(s, i + 1, named=True)
        if c == "J" and nxt in self.soft:
            i = self._type_params(s, i + 2)
            if self.at(s, i) == "E":
                i = self._type_commas(s, i + 1)
            i = self.need(s, i, "{", self.TYPE_BODY)
            return i + 1 if self.at(s, i) == ";" else i
        if c == "j" and nxt in self.soft:
            i = self._type_params(s, i + 2)
            return self.end(s, self.type(s, self.char(s, i, "=")))
        if c == "n" and nxt in self.soft:
            return self._enum(s, i + 1)
        if c == "P" and nxt and (nxt in self.soft or nxt == '"'):
            i += 2
            while self.at(s, i) == ".":
                i += 2
            if nxt == '"' and (i >= len(s) or s[i] in ";\n"):
                return self.end(s, i)
            return self.need(s, i, "{", self.BLOCK)
        return None

    def _enum(self, s: str, i: int) -> int:
        if self.at(s, i) == "n":
            i += 1
        if self.at(s, i) not in self.soft:
            raise Bad
        return self.need(s, i + 1, "{", self.ENUM)

    def target(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c and (c in self.soft or c in "AY"):
            i += 1
        elif self.is_group(c, "[", self.ELEMENTS) or self.is_group(c, "{", self.OBJECT):
            i += 1
        else:
            raise Bad
        if self.types:
            if self.at(s, i) in "!?" and self.at(s, i + 1) == ":":
                i += 1
            if self.at(s, i) == ":":
                i = self.type(s, i + 1)
        return i

    def bindings(self, s: str, i: int) -> int:
        while True:
            i = self.target(s, i)
            if self.at(s, i) == "=":
                i = self.assignment(s, i + 1)
            if self.at(s, i) != ",":
                return i
            i += 1

    def function(self, s: str, i: int, named: bool) -> int:
        if s[i] == "a":
            i += 1
        i = self.char(s, i, "F")
        if self.at(s, i) == "*":
            i += 1
        c = self.at(s, i)
        if c and (c in self.soft or c in "AY"):
            i += 1
        elif named:
            raise Bad
        return self.callable_rest(s, i, overload=named)

    def callable_rest(self, s: str, i: int, overload: bool) -> int:
        """Parameters, return type and body."""
        i = self.need(s, self._type_params(s, i), "(", self.PARAMS)
        if self.types and self.at(s, i) == ":":
            i = self.type(s, i + 1)
        j = self.skip(s, i)
        if self.is_group(self.at(s, j), "{", self.BLOCK):
            return j + 1
        if self.types and overload:
            return self.end(s, i)
        raise Bad

    def class_(self, s: str, i: int, named: bool) -> int:
        i += 1
        c = self.at(s, i)
        if c in self.soft and c:
            i = self._type_params(s, i + 1)
        elif named:
            raise Bad
        if self.at(s, i) == "E":
            i = self.postfix(s, i + 1)
            if self.types and self.at(s, i) == "<":
                i = self._type_args(s, i)
        if self.types and self.at(s, i) == "H":
            i = self._type_commas(s, i + 1)
        return self.need(s, self.skip(s, i), "{", self.CLASS)

    def _module_name(self, s: str, i: int) -> int:
        i = self.char(s, self.char(s, i, "m"), '"')
        if self.at(s, i) in ("W", "x") and self.is_group(self.at(s, i + 1), "{", self.OBJECT):
            i += 2
        return self.end(s, i)

    def import_(self, s: str, i: int) -> int:
        if self.at(s, i) == '"':
            return self.end(s, i + 1)
        if self.types and self.at(s, i) == "j" and self.at(s, i + 1) not in ("m", ","):
            i += 1
        some = False
        if self.at(s, i) and self.at(s, i) in self.soft:
            i, some = i + 1, True
            if self.types and self.at(s, i) == "=":
                return self.end(s, self.expression(s, i + 1))
            if self.at(s, i) == ",":
                i, some = i + 1, False
        if not some:
            if self.at(s, i) == "*":
                i = self.char(s, i + 1, "q")
                if self.at(s, i) not in self.soft:
                    raise Bad
                i += 1
            else:
                i = self.need(s, i, "{", self.NAMES)
        return self._module_name(s, i)

    def export(self, s: str, i: int) -> int:
        c, nxt = self.at(s, i), self.at(s, i + 1)
        if c == "D":
            if nxt == "F" or (nxt == "a" and self.at(s, i + 2) == "F"):
                return self.function(s, i + 1, named=False)
            if nxt == "C" or (nxt == "L" and self.at(s, i + 2) == "C"):
                return self.class_(s, i + (1 if nxt == "C" else 2), named=False)
            if self.types and nxt == "J":
                return self.statement(s, i + 1)
            return self.end(s, self.assignment(s, i + 1))
        if c == "*":
            i += 1
            if self.at(s, i) == "q":
                i += 2
            return self._module_name(s, i)
        if self.types and c == "j" and (nxt == "*" or 0 <= ord(nxt or " ") - _BASE["{"] < 256):
            return self.export(s, i + 1)
        if self.types and c == "=":
            return self.end(s, self.expression(s, i + 1))
        if self.types and c == "q":
            return self.end(s, i + 3)
        if self.is_group(c, "{", self.NAMES):
            return self._module_name(s, i + 1) if nxt == "m" else self.end(s, i + 1)
        if c and (c in "vFC@" or (c == "a" and nxt == "F") or (self.types and c in "JjnPBL")):
            return self.statement(s, i)
        if self.types and c == "I":
            return self.statement(s, i)
        raise Bad

    # Expressions

    def expression(self, s: str, i: int) -> int:
        i = self.assignment(s, i)
        while self.at(s, i) == ",":
            i = self.assignment(s, i + 1)
        return i

    def assignment(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c == "Y":
            i += 1
            if self.at(s, i) == "*":
                return self.assignment(s, i + 1)
            if i >= len(s) or s[i] in ";\n,:":
                return i
            return self.assignment(s, i)
        arrow = self._arrow(s, i, c)
        if arrow is not None:
            return arrow
        i = self.binary(s, i)
        c = self.at(s, i)
        if c == "?":
            i = self.char(s, self.assignment(s, self.skip(s, i + 1)), ":")
            return self.assignment(s, self.skip(s, i))
        if c == "=" or c == "ä":
            return self.assignment(s, self.skip(s, i + 1))
        return i

    def _arrow(self, s: str, i: int, c: str) -> int | None:
        j = i
        if c == "a" and self.at(s, i + 1) not in ("→", "", ".", ",", ";", "="):
            j += 1
        c = self.at(s, j)
        if c and (c in self.soft or c in "AY") and self.at(s, j + 1) == "→":
            return self._arrow_body(s, j + 2)
        if self.types and c == "<":
            try:
                j = self._type_params(s, j)
            except Bad:
                return None
            c = self.at(s, j)
        if self.is_group(c, "(", self.PARAMS):
            j += 1
            if self.at(s, j) == "→":
                return self._arrow_body(s, j + 1)
            if self.types and self.at(s, j) == ":":
                try:
                    j = self.type(s, j + 1)
                except Bad:
                    return None
                if self.at(s, j) == "→":
                    return self._arrow_body(s, j + 1)
        return None

    def _arrow_body(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        if 0 <= ord(self.at(s, i) or " ") - _BASE["{"] < 256:
            return self.need(s, i, "{", self.BLOCK)
        return self.assignment(s, i)

    def binary(self, s: str, i: int) -> int:
        i = self.unary(s, i)
        while i < len(s):
            c = s[i]
            if c in "%+-*&|l<":
                i = self.unary(s, self.skip(s, i + 1))
            elif c == ">":
                while self.at(s, i) == ">":
                    i += 1
                if self.at(s, i) == "=":
                    i += 1
                i = self.unary(s, self.skip(s, i))
            elif self.types and c in "qQ":
                i = self.type(s, i + 1)
            else:
                return i
        return i

    def unary(self, s: str, i: int) -> int:
        while i < len(s) and s[i] in "!~+-puA" and not (s[i] == "A" and self.at(s, i + 1) in ("", ";", ",", ".", "=")):
            i += 1
        if self.types and self.at(s, i) == "<":
            return self.unary(s, self._type_args(s, i))
        return self.postfix(s, i)

    def postfix(self, s: str, i: int) -> int:
        i = self.primary(s, i)
        while i < len(s):
            c = s[i]
            if c == ".":
                n = self.at(s, i + 1)
                if n and n in self._WORDS:
                    i += 2
                elif self.is_group(n, "(", self.ARGS) or self.is_group(n, "[", self.INDEX):
                    i += 2
                else:
                    raise Bad
            elif self.is_group(c, "(", self.ARGS) or self.is_group(c, "[", self.INDEX):
                i += 1
            elif c == "`" or c == "p":
                i += 1
            elif self.types and c == "!":
                i += 1
            elif self.types and c == "<":
                try:
                    j = self._type_args(s, i)
                except (Bad, IndexError):
                    return i
                if not (self.is_group(self.at(s, j), "(", self.ARGS) or self.at(s, j) in ("`", "", ";", "\n", ",")):
                    return i
                i = j
            else:
                return i
        return i

    def primary(self, s: str, i: int) -> int:
        c = s[i] if i < len(s) else " "
        if c in "x0\"`/h":
            return i + 1
        if c == "a" and self.at(s, i + 1) == "F" or c == "F":
            return self.function(s, i, named=False)
        if c == "C":
            return self.class_(s, i, named=False)
        if c == "N":
            i += 1
            if self.at(s, i) == ".":
                return i + 2
            i = self.primary(s, i)
            while self.at(s, i) == "." or self.is_group(self.at(s, i), "[", self.INDEX):
                i += 2 if s[i] == "." else 1
            if self.types and self.at(s, i) == "<":
                i = self._type_args(s, i)
            return i + 1 if self.is_group(self.at(s, i), "(", self.ARGS) else i
        if c == "I":
            if self.at(s, i + 1) == ".":
                return i + 3
            return self.need(s, i + 1, "(", self.ARGS)
        if c in self.soft:
            return i + 1
        if (
            self.is_group(c, "(", self.PAREN)
            or self.is_group(c, "[", self.ELEMENTS)
            or self.is_group(c, "{", self.OBJECT)
        ):
            return i + 1
        raise Bad

    def _spread(self, s: str, i: int) -> int:
        return self.assignment(s, i + 1 if self.at(s, i) == "…" else i)

    def args(self, s: str, i: int) -> int:
        return self.listing(s, i, self._spread)

    def paren(self, s: str, i: int) -> int:
        return self.expression(s, i)

    def index(self, s: str, i: int) -> int:
        return self.expression(s, i)

    def elements(self, s: str, i: int) -> int:
        while i < len(s):
            if s[i] == ",":
                i += 1
                continue
            i = self._spread(s, i)
            if i < len(s):
                i = self.char(s, i, ",")
        return i

    def _param(self, s: str, i: int) -> int:
        while self.at(s, i) == "@":
            i = self.postfix(s, i + 1)
        if self.types:
            while self.at(s, i) and self.at(s, i) in "MR" and self.at(s, i + 1) and (self.at(s, i + 1) in self.soft or ord(self.at(s, i + 1)) >= 0xE100):
                i += 1
            if self.at(s, i) == "h":
                return self.type(s, self.char(s, i + 1, ":"))
        if self.at(s, i) == "…":
            return self.target(s, i + 1)
        if self.types and self.at(s, i + 1) == "?":
            i += 2
            if self.at(s, i) == ":":
                i = self.type(s, i + 1)
            return i
        i = self.target(s, i)
        return self.assignment(s, i + 1) if self.at(s, i) == "=" else i

    def params(self, s: str, i: int) -> int:
        return self.listing(s, i, self._param)

    def for_header(self, s: str, i: int) -> int:
        c = self.at(s, i)
        j = None
        if c == "v":
            try:
                j = self.target(s, i + 1)
            except Bad:
                j = None
        elif c and (c in self.soft or ord(c) >= 0xE100):
            try:
                j = self.postfix(s, i)
            except Bad:
                j = None
        if j is not None and self.at(s, j) and self.at(s, j) in "ol":
            return self.expression(s, j + 1)
        if c == "v":
            i = self.bindings(s, i + 1)
        elif c != ";":
            i = self.expression(s, i)
        i = self.char(s, i, ";")
        if self.at(s, i) != ";":
            i = self.expression(s, i)
        i = self.char(s, i, ";")
        return self.expression(s, i) if i < len(s) else i

    def _property_name(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c and (c in self._WORDS or c in '0"'):
            return i + 1
        return self.need(s, i, "[", self.INDEX)

    def _method_or(self, s: str, i: int) -> tuple[int, bool]:
        """Modifiers and a name; whether modifiers were seen."""
        seen = False
        while True:
            c, nxt = self.at(s, i), self.at(s, i + 1)
            if c == "*":
                i, seen = i + 1, True
            elif c and c in "asgMRLB" and nxt and (nxt in self._WORDS or nxt in '*0"' or self.is_group(nxt, "[", self.INDEX)):
                i, seen = i + 1, True
            else:
                break
        return self._property_name(s, i), seen

    def _property(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        if self.at(s, i) == "…":
            return self.skip(s, self.assignment(s, i + 1))
        start = self.at(s, i)
        j, seen = self._method_or(s, i)
        c = self.at(s, j)
        if c == ":" and not seen:
            return self.skip(s, self.assignment(s, self.skip(s, j + 1)))
        if c == "<" or 0 <= ord(c or " ") - _BASE["("] < 256:
            return self.skip(s, self.callable_rest(s, j, overload=False))
        if seen or start not in self.soft | set("AY"):
            raise Bad
        if c == "=":
            j = self.assignment(s, j + 1)
        return self.skip(s, j)

    def object(self, s: str, i: int) -> int:
        return self.listing(s, i, self._property)

    def class_body(self, s: str, i: int) -> int:
        while i < len(s):
            if s[i] in ";\n":
                i += 1
                continue
            if s[i] == "@":
                i = self.skip(s, self.postfix(s, i + 1))
                continue
            if s[i] == "s" and self.is_group(self.at(s, i + 1), "{", self.BLOCK):
                i += 2
                continue
            if self.types and self.is_group(s[i], "[", self.SIGNATURE):
                i = self.end(s, self.type(s, self.char(s, i + 1, ":")))
                continue
            i, _ = self._method_or(s, i)
            if self.types and self.at(s, i) and self.at(s, i) in "?!":
                i += 1
            c = self.at(s, i)
            if c == "<" or 0 <= ord(c or " ") - _BASE["("] < 256:
                i = self.callable_rest(s, i, overload=True)
                continue
            if self.types and c == ":":
                i = self.type(s, i + 1)
            if self.at(s, i) == "=":
                i = self.assignment(s, self.skip(s, i + 1))
            i = self.end(s, i)
        return i

    def switch_body(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        while i < len(s):
            if s[i] == "k":
                i = self.char(s, self.expression(s, i + 1), ":")
            else:
                i = self.char(s, self.char(s, i, "D"), ":")
            i = self.skip(s, self.statements(s, i, stop="kD"))
        return i

    def _name_as(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        if self.types and self.at(s, i) == "j" and self.at(s, i + 1) not in ("", ",", "q", "\n"):
            i += 1
        if not (self.at(s, i) and self.at(s, i) in self._WORDS + '"'):
            raise Bad
        i += 1
        if self.at(s, i) == "q" and self.at(s, i + 1) and self.at(s, i + 1) in self._WORDS + '"':
            i += 2
        return self.skip(s, i)

    def names(self, s: str, i: int) -> int:
        return self.listing(s, i, self._name_as)

    # Types

    def type(self, s: str, i: int) -> int:
        if not self.types:
            raise Bad
        i = self.skip(s, i)
        if self.at(s, i) and self.at(s, i) in "|&":
            i += 1
        if self.at(s, i) == "G" and self.at(s, i + 1) and self.at(s, i + 1) in "xh":
            i += 1
        while True:
            i = self._type_unary(s, i)
            c = self.at(s, i)
            if c and c in "|&":
                i = self.skip(s, i + 1)
            elif c == "V":
                i += 1
            elif c == "E":
                i = self.char(s, self.type(s, i + 1), "?")
                i = self.char(s, self.type(s, i), ":")
                return self.type(s, i)
            else:
                return i

    def _type_unary(self, s: str, i: int) -> int:
        while self.at(s, i) and self.at(s, i) in "KURu" and self.at(s, i + 1) and self.at(s, i + 1) not in ",;)>=|&.":
            i += 1
        c, nxt = self.at(s, i), self.at(s, i + 1)
        if self.is_group(c, "(", self.PARAMS) and nxt == "→":
            return self.type(s, i + 2)
        if c == "<":
            i = self.need(s, self._type_params(s, i), "(", self.PARAMS)
            return self.type(s, self.char(s, i, "→"))
        if c == "N" or (c == "L" and nxt == "N"):
            i = self.need(s, self._type_params(s, i + (1 if c == "N" else 2)), "(", self.PARAMS)
            return self.type(s, self.char(s, i, "→"))
        if c == "-":
            i, c = i + 1, self.at(s, i + 1)
        if c == "I":
            i = self.need(s, i + 1, "(", self.ARGS)
            i -= 1
        elif not c:
            raise Bad
        if c in self.soft or c in "hu0\"`I":
            i += 1
            while self.at(s, i) == "." and self.at(s, i + 1) and self.at(s, i + 1) in self._WORDS:
                i += 2
            if self.at(s, i) == "<":
                i = self._type_args(s, i)
        elif (
            self.is_group(c, "(", self.PAREN_TYPE)
            or self.is_group(c, "[", self.TYPE_LIST)
            or self.is_group(c, "{", self.TYPE_BODY)
        ):
            i += 1
        else:
            raise Bad
        while self.is_group(self.at(s, i), "[", self.TYPE_LIST) or self.is_group(self.at(s, i), "[", self.INDEX):
            i += 1
        return i

    def paren_type(self, s: str, i: int) -> int:
        return self.type(s, i)

    def _tuple_item(self, s: str, i: int) -> int:
        if self.at(s, i) == "…":
            i += 1
        if self.at(s, i) in self.soft and self.at(s, i) and self.at(s, i + 1) == ":":
            i += 2
        elif self.at(s, i) in self.soft and self.at(s, i) and s[i + 1:i + 3] == "?:":
            i += 3
        i = self.type(s, i)
        return i + 1 if self.at(s, i) == "?" else i

    def type_list(self, s: str, i: int) -> int:
        return self.listing(s, i, self._tuple_item)

    def _type_commas(self, s: str, i: int) -> int:
        i = self.type(s, i)
        while self.at(s, i) == ",":
            i = self.type(s, i + 1)
        return i

    def _type_args(self, s: str, i: int) -> int:
        return self.char(s, self._type_commas(s, self.char(s, i, "<")), ">")

    def _type_params(self, s: str, i: int) -> int:
        if not self.types or self.at(s, i) != "<":
            return i
        i += 1
        while True:
            while self.at(s, i) == "v" or (self.at(s, i) == "l" and self.at(s, i + 1) in self.soft):
                i += 1
            if self.at(s, i) not in self.soft or i >= len(s):
                raise Bad
            i += 1
            if self.at(s, i) == "E":
                i = self.type(s, i + 1)
            if self.at(s, i) == "=":
                i = self.type(s, i + 1)
            if self.at(s, i) == ",":
                i += 1
                if self.at(s, i) == ">":
                    return i + 1
                continue
            return self.char(s, i, ">")

    def index_signature(self, s: str, i: int) -> int:
        if self.at(s, i) not in self.soft or i >= len(s):
            raise Bad
        if self.at(s, i + 1) == "l":
            i = self.type(s, i + 2)
            return self.type(s, i + 1) if self.at(s, i) == "q" else i
        return self.type(s, self.char(s, i + 1, ":"))

    def type_body(self, s: str, i: int) -> int:
        while i < len(s):
            if s[i] in ";,\n":
                i += 1
                continue
            while s[i] in "+-R" and self.at(s, i + 1) and (self.at(s, i + 1) in self._WORDS + "R" or ord(self.at(s, i + 1)) >= 0xE100):
                i += 1
            if self.is_group(s[i], "[", self.SIGNATURE):
                i += 1
            elif 0 <= ord(s[i]) - _BASE["("] < 256 or s[i] == "<":
                pass
            elif s[i] == "N" and 0 <= ord(self.at(s, i + 1) or " ") - _BASE["("] < 256:
                i += 1
            else:
                i, _ = self._method_or(s, i)
            if self.at(s, i) and self.at(s, i) in "+-":
                i += 1
            if self.at(s, i) == "?":
                i += 1
            if self.at(s, i) == "<" or 0 <= ord(self.at(s, i) or " ") - _BASE["("] < 256:
                i = self.need(s, self._type_params(s, i), "(", self.PARAMS)
            if self.at(s, i) == ":":
                i = self.type(s, i + 1)
            if i < len(s) and s[i] not in ";,\n":
                raise Bad
        return i

    def _enum_item(self, s: str, i: int) -> int:
        i = self._property_name(s, self.skip(s, i))
        if self.at(s, i) == "=":
            i = self.assignment(s, i + 1)
        return self.skip(s, i)

    def enum_body(self, s: str, i: int) -> int:
        return self.listing(s, i, self._enum_item)


class Go(Grammar):
    """A Go source file; newlines become semicolons as the language defines."""

    roles = {
        "(": ("args", "single", "params", "imports", "values", "types"),
        "[": ("subscript", "length", "type_params"),
        "{": ("block", "literal", "fields", "methods", "cases"),
    }
    ARGS, SINGLE, PARAMS, IMPORTS, VALUES, TYPES = range(6)
    SUBSCRIPT, LENGTH, TYPE_PARAMS = range(3)
    BLOCK, LITERAL, FIELDS, METHODS, CASES = range(5)
    _SEMI = re.compile(r"(?<=[x0\"rbqp)\]}])\n+")

    def prepare(self, code: str) -> str:
        return self._SEMI.sub(";", code + "\n").replace("\n", "")

    def clean(self, opener: str, content: str) -> str:
        return content

    def end(self, s: str, i: int) -> int:
        if i >= len(s):
            return i
        return self.char(s, i, ";")

    def file(self, s: str, i: int) -> int:
        i = self.char(s, i, "K")
        i = self.end(s, self.char(s, i, "x"))
        while self.at(s, i) == "I":
            i += 1
            if self.is_group(self.at(s, i), "(", self.IMPORTS):
                i = self.end(s, i + 1)
            else:
                i = self.end(s, self._import(s, i))
        while i < len(s):
            if s[i] == "F":
                i = self.end(s, self._func_decl(s, i + 1))
            elif s[i] in "cvt":
                i = self.end(s, self._decl(s, i))
            else:
                raise Bad
        return i

    def _import(self, s: str, i: int) -> int:
        if self.at(s, i) and self.at(s, i) in "x.":
            i += 1
        return self.char(s, i, '"')

    def _repeat(self, s: str, i: int, item: Callable[[str, int], int]) -> int:
        while i < len(s):
            i = self.end(s, item(s, i))
        return i

    def imports(self, s: str, i: int) -> int:
        return self._repeat(s, i, self._import)

    def values(self, s: str, i: int) -> int:
        return self._repeat(s, i, self._value_spec)

    def types(self, s: str, i: int) -> int:
        return self._repeat(s, i, self._type_spec)

    def _names(self, s: str, i: int) -> int:
        i = self.char(s, i, "x")
        while self.at(s, i) == ",":
            i = self.char(s, i + 1, "x")
        return i

    def _value_spec(self, s: str, i: int) -> int:
        i = self._names(s, i)
        if i < len(s) and s[i] not in "=;":
            i = self.type(s, i)
        if self.at(s, i) == "=":
            i = self.exprs(s, i + 1)
        return i

    def _type_spec(self, s: str, i: int) -> int:
        i = self.char(s, i, "x")
        if self.is_group(self.at(s, i), "[", self.TYPE_PARAMS):
            try:
                return self.type(s, i + 1)
            except (Bad, IndexError):
                pass
        if self.at(s, i) == "=":
            i += 1
        return self.type(s, i)

    def _decl(self, s: str, i: int) -> int:
        kind, i = s[i], i + 1
        if 0 <= ord(self.at(s, i) or " ") - _BASE["("] < 256:
            return self.need(s, i, "(", self.TYPES if kind == "t" else self.VALUES)
        return self._type_spec(s, i) if kind == "t" else self._value_spec(s, i)

    def _func_decl(self, s: str, i: int) -> int:
        if self.is_group(self.at(s, i), "(", self.PARAMS):
            i += 1
        i = self.char(s, i, "x")
        if self.is_group(self.at(s, i), "[", self.TYPE_PARAMS):
            i += 1
        i = self._signature(s, i)
        if i < len(s) and s[i] != ";":
            i = self.need(s, i, "{", self.BLOCK)
        return i

    def _signature(self, s: str, i: int) -> int:
        i = self.need(s, i, "(", self.PARAMS)
        if self.is_group(self.at(s, i), "(", self.PARAMS):
            return i + 1
        try:
            return self.type(s, i)
        except (Bad, IndexError):
            return i

    def type(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c == "x":
            i += 1
            if self.at(s, i) == ".":
                i = self.char(s, i + 1, "x")
            if self.is_group(self.at(s, i), "[", self.SUBSCRIPT):
                i += 1
            return i
        if c == "*" or c == "~":
            return self.type(s, i + 1)
        if c == "m":
            return self.type(s, self.need(s, i + 1, "[", self.SUBSCRIPT))
        if c == "h":
            return self.type(s, i + 2 if self.at(s, i + 1) == "w" else i + 1)
        if c == "w":
            return self.type(s, self.char(s, i + 1, "h"))
        if c == "F":
            return self._signature(s, i + 1)
        if c == "s":
            return self.need(s, i + 1, "{", self.FIELDS)
        if c == "n":
            return self.need(s, i + 1, "{", self.METHODS)
        if self.is_group(c, "[", self.LENGTH):
            return self.type(s, i + 1)
        if self.is_group(c, "(", self.SINGLE):
            return i + 1
        raise Bad

    def _field(self, s: str, i: int) -> int:
        try:
            j = self.type(s, self._names(s, i))
        except (Bad, IndexError):
            j = self.type(s, i)
        return j + 1 if self.at(s, j) == '"' else j

    def fields(self, s: str, i: int) -> int:
        return self._repeat(s, i, self._field)

    def _method(self, s: str, i: int) -> int:
        if s[i] == "x" and self.is_group(self.at(s, i + 1), "(", self.PARAMS):
            return self._signature(s, i + 1)
        i = self.type(s, i)
        while self.at(s, i) == "|":
            i = self.type(s, i + 1)
        return i

    def methods(self, s: str, i: int) -> int:
        return self._repeat(s, i, self._method)

    def _param(self, s: str, i: int) -> int:
        if self.at(s, i) == "x":
            j = i + 1
            if j >= len(s) or s[j] == ",":
                return j
            try:
                return self.type(s, j + 1 if self.at(s, j) == "…" else j)
            except (Bad, IndexError):
                pass
        return self.type(s, i + 1 if self.at(s, i) == "…" else i)

    def params(self, s: str, i: int) -> int:
        return self.listing(s, i, self._param)

    def type_params(self, s: str, i: int) -> int:
        def item(s: str, i: int) -> int:
            i = self.char(s, i, "x")
            if i < len(s) and s[i] != ",":
                i = self.type(s, i)
                while self.at(s, i) == "|":
                    i = self.type(s, i + 1)
            return i

        return self.listing(s, i, item, empty=False)

    def subscript(self, s: str, i: int) -> int:
        if ":" not in s:
            return self.listing(s, i, self.expr_or_type, empty=False)
        parts = s[i:].split(":")
        if len(parts) > 3:
            raise Bad
        for p in parts:
            if p and not self.reads("expr", p):
                raise Bad
        return len(s)

    def length(self, s: str, i: int) -> int:
        if i >= len(s) or s[i:] == "…":
            return len(s)
        return self.expr(s, i)

    def single(self, s: str, i: int) -> int:
        return i + 1 if s == "t" else self.expr_or_type(s, i)

    def expr_or_type(self, s: str, i: int) -> int:
        try:
            return self.expr(s, i)
        except (Bad, IndexError):
            return self.type(s, i)

    def args(self, s: str, i: int) -> int:
        def item(s: str, i: int) -> int:
            try:
                j = self.expr(s, i)
            except (Bad, IndexError):
                j = self.type(s, i)
            return j + 1 if self.at(s, j) == "…" else j

        return self.listing(s, i, item)

    def literal(self, s: str, i: int) -> int:
        def item(s: str, i: int) -> int:
            i = self._element(s, i)
            return self._element(s, i + 1) if self.at(s, i) == ":" else i

        return self.listing(s, i, item)

    def _element(self, s: str, i: int) -> int:
        return i + 1 if self.is_group(self.at(s, i), "{", self.LITERAL) else self.expr(s, i)

    def exprs(self, s: str, i: int, literals: bool = True) -> int:
        i = self.expr(s, i, literals)
        while self.at(s, i) == ",":
            i = self.expr(s, i + 1, literals)
        return i

    def expr(self, s: str, i: int, literals: bool = True) -> int:
        i = self._unary(s, i, literals)
        while i < len(s) and s[i] in "%+-*&^|":
            i = self._unary(s, i + 1, literals)
        return i

    def _unary(self, s: str, i: int, literals: bool) -> int:
        while i < len(s) and s[i] in "+-!^*&w~" and not (s[i] == "w" and self.at(s, i + 1) == "h"):
            i += 1
        c = self.at(s, i)
        if c and c in '0"':
            i += 1
        elif c == "x":
            i += 1
            if literals and self.is_group(self.at(s, i), "{", self.LITERAL):
                i += 1
        elif c == "F":
            i = self._signature(s, i + 1)
            if 0 <= ord(self.at(s, i) or " ") - _BASE["{"] < 256:
                i = self.need(s, i, "{", self.BLOCK)
        elif self.is_group(c, "(", self.SINGLE):
            i += 1
        else:
            i = self.type(s, i)
            if self.is_group(self.at(s, i), "{", self.LITERAL) and (literals or c in "ms" or 0 <= ord(c) - _BASE["["] < 256):
                i += 1
        while i < len(s):
            c = s[i]
            if c == ".":
                if self.at(s, i + 1) == "x":
                    i += 2
                    if literals and self.is_group(self.at(s, i), "{", self.LITERAL):
                        i += 1
                else:
                    i = self.need(s, i + 1, "(", self.SINGLE)
            elif self.is_group(c, "(", self.ARGS):
                i += 1
            elif self.is_group(c, "[", self.SUBSCRIPT):
                i += 1
                if literals and self.is_group(self.at(s, i), "{", self.LITERAL):
                    i += 1
            else:
                break
        return i

    def simple(self, s: str, i: int, literals: bool = True) -> int:
        if self.at(s, i) == "R":
            return self.expr(s, i + 1, literals)
        i = self.exprs(s, i, literals)
        c = self.at(s, i)
        if c == "p":
            return i + 1
        if c == "w":
            return self.expr(s, i + 1, literals)
        if c and c in "d=ä":
            if self.at(s, i + 1) == "R":
                return self.expr(s, i + 2, literals)
            return self.exprs(s, i + 1, literals)
        return i

    def block(self, s: str, i: int) -> int:
        return self.statements(s, i)

    def statements(self, s: str, i: int, stop: str = "") -> int:
        while i < len(s):
            if s[i] == ";":
                i += 1
            elif stop and s[i] in stop:
                return i
            else:
                i = self.end(s, self.statement(s, i))
        return i

    def _header(self, s: str, i: int) -> int:
        """Optional simple statements and semicolons before a body."""
        parts = 0
        while i < len(s) and not 0 <= ord(s[i]) - _BASE["{"] < 256:
            if s[i] == ";":
                parts += 1
                if parts > 2:
                    raise Bad
                i += 1
            else:
                i = self.simple(s, i, literals=False)
                if not (self.at(s, i) == ";" or 0 <= ord(self.at(s, i) or " ") - _BASE["{"] < 256):
                    raise Bad
        return i

    def statement(self, s: str, i: int) -> int:
        c = s[i]
        if c in "cvt":
            return self._decl(s, i)
        if c == "i":
            if 0 <= ord(self.at(s, i + 1) or " ") - _BASE["{"] < 256:
                raise Bad
            i = self.need(s, self._header(s, i + 1), "{", self.BLOCK)
            if self.at(s, i) == "e":
                if self.at(s, i + 1) == "i":
                    return self.statement(s, i + 1)
                return self.need(s, i + 1, "{", self.BLOCK)
            return i
        if c == "f":
            return self.need(s, self._header(s, i + 1), "{", self.BLOCK)
        if c == "S":
            return self.need(s, self._header(s, i + 1), "{", self.CASES)
        if c == "L":
            return self.need(s, i + 1, "{", self.CASES)
        if c == "r":
            return i + 1 if self.at(s, i + 1) in ("", ";") else self.exprs(s, i + 1)
        if c == "b":
            return i + 2 if self.at(s, i + 1) == "x" else i + 1
        if c == "q":
            return i + 1
        if c == "o":
            return self.char(s, i + 1, "x")
        if c == "g":
            return self.expr(s, i + 1)
        if c == "x" and self.at(s, i + 1) == ":":
            return i + 2 if i + 2 >= len(s) or s[i + 2] == ";" else self.statement(s, i + 2)
        if self.is_group(c, "{", self.BLOCK):
            return i + 1
        return self.simple(s, i)

    def cases(self, s: str, i: int) -> int:
        while i < len(s):
            if s[i] == "k":
                try:
                    j = self.char(s, self.simple(s, i + 1), ":")
                except (Bad, IndexError):
                    j = self.listing_until(s, i + 1)
                i = j
            else:
                i = self.char(s, self.char(s, i, "D"), ":")
            i = self.statements(s, i, stop="kD")
        return i

    def listing_until(self, s: str, i: int) -> int:
        """Types of a type switch's case, and its colon."""
        i = self.expr_or_type(s, i)
        while self.at(s, i) == ",":
            i = self.expr_or_type(s, i + 1)
        return self.char(s, i, ":")


class C(Grammar):
    """A C translation unit before preprocessing: directives are left out, both branches of a condition stay."""

    roles = {
        "(": ("args", "single", "params", "type_name", "for_header", "inner_declarator"),
        "[": ("bound",),
        "{": ("block", "initializers", "members", "enumerators"),
    }
    ARGS, SINGLE, PARAMS, TYPE_NAME, HEADER, INNER = range(6)
    _CONDITIONALS = re.compile("[^⟨⟩]+")
    BLOCK, INIT, MEMBERS, ENUM = range(4)

    def prepare(self, code: str) -> str:
        if "⟨" in code or "⟩" in code:
            left = self._CONDITIONALS.sub("", code)
            while "⟨⟩" in left:
                left = left.replace("⟨⟩", "")
            code = code.replace("⟨", "").replace("⟩", "") if not left else "\x00"
        return code

    def file(self, s: str, i: int) -> int:
        while i < len(s):
            if s[i] == ";":
                i += 1
                continue
            if s[i] == "α":
                i += 2
                continue
            if s[i] == "q" and self.at(s, i + 1) == '"':  # extern "C"
                i += 2
                if 0 <= ord(self.at(s, i) or " ") - _BASE["{"] < 256:
                    i += 1
                continue
            i = self.external(s, i)
        return i

    def external(self, s: str, i: int) -> int:
        try:
            j = self.specifiers(s, i)
        except (Bad, IndexError):
            j = i
        k = self._attributes(s, j)
        if self.at(s, k) == ";" and k > i:
            return k + 1
        try:
            k = self.declarator(s, k)
        except (Bad, IndexError):
            # the last identifier was the name: f(x) { }, and macro calls in a row of their own
            if s[i] == "x" and 0 <= ord(self.at(s, i + 1) or " ") - _BASE["("] < 256:
                k = i + 2
                if self.at(s, k) == ";":
                    return k + 1
                return k + 1 if self.is_group(self.at(s, k), "{", self.BLOCK) else k
            raise Bad from None
        if s[k - 1] == "x" and k - 1 == i:
            raise Bad
        k = self._attributes(s, k)
        if self.is_group(self.at(s, k), "{", self.BLOCK) and 0 <= ord(s[k - 1]) - _BASE["("] < 256:
            return k + 1
        if 0 <= ord(s[k - 1]) - _BASE["("] < 256 and self.at(s, k) and self.at(s, k) in "Tqxse":  # K&R parameters
            while self.at(s, k) and not 0 <= ord(s[k]) - _BASE["{"] < 256:
                k = self.declaration(s, k)
            return self.need(s, k, "{", self.BLOCK)
        return self.char(s, self._declarators_rest(s, k), ";")

    def _attributes(self, s: str, i: int) -> int:
        while self.at(s, i) == "α":
            i += 2
        return i

    def specifiers(self, s: str, i: int, typed: bool = False) -> int:
        """Storage, qualifiers and a type; at most one typedef name, and a macro before it."""
        start, names = i, 0
        while i < len(s):
            c = s[i]
            if c in "qy":
                i += 1
            elif c == "α":
                i += 2
            elif c == "T":
                i, typed = i + 1, True
            elif c in "se" and not typed:
                i, typed = self._attributes(s, i + 1), True
                some = self.at(s, i) == "x"
                if some:
                    i += 1
                if 0 <= ord(self.at(s, i) or " ") - _BASE["{"] < 256:
                    i, some = self.need(s, i, "{", self.MEMBERS if c == "s" else self.ENUM), True
                if not some:
                    raise Bad
            elif c == "x" and self._another(s, i) and names < 2:
                i, typed, names = i + 1, True, names + 1
            elif c == "x" and not typed and self._abstract(s, i):
                i, typed = i + 1, True
            else:
                break
        if i == start or not typed:
            raise Bad
        return i

    def _another(self, s: str, i: int) -> bool:
        """Whether the identifier at i is a type or macro because a declarator or type follows."""
        n = self.at(s, i + 1)
        if not n:
            return False
        if n in "xTqse*α":
            if n == "*":
                j = i + 1
                while self.at(s, j) and self.at(s, j) in "*q":
                    j += 1
                return self.at(s, j) == "x" or self.is_group(self.at(s, j), "(", self.INNER) or j >= len(s) or s[j] == ","
            return True
        return self.is_group(n, "(", self.INNER) and self.at(s, i + 2) and 0 <= ord(self.at(s, i + 2)) - _BASE["("] < 256

    @staticmethod
    def _abstract(s: str, i: int) -> bool:
        return i + 1 >= len(s) or s[i + 1] in ",*"

    def declarator(self, s: str, i: int, abstract: bool = False) -> int:
        while self.at(s, i) and self.at(s, i) in "*q^":
            i += 1
        i = self._attributes(s, i)
        c = self.at(s, i)
        if c == "x":
            i += 1
        elif self.is_group(c, "(", self.INNER):
            i += 1
        elif not abstract:
            raise Bad
        while i < len(s):
            if self.is_group(s[i], "(", self.PARAMS) or self.is_group(s[i], "[", 0):
                i += 1
            else:
                break
        return i

    def inner_declarator(self, s: str, i: int) -> int:
        if not s or s[0] not in "*x^q" and not 0 <= ord(s[0]) - _BASE["("] < 256:
            raise Bad
        return self.declarator(s, i, abstract=True)

    def _declarators_rest(self, s: str, i: int) -> int:
        while True:
            if self.at(s, i) == ":":
                i = self.conditional(s, i + 1)
            i = self._attributes(s, i)
            if self.at(s, i) == "=":
                i = self._initializer(s, i + 1)
            if self.at(s, i) != ",":
                return i
            i = self.declarator(s, i + 1)

    def _initializer(self, s: str, i: int) -> int:
        if self.is_group(self.at(s, i), "{", self.INIT):
            return i + 1
        return self.assignment(s, i)

    def initializers(self, s: str, i: int) -> int:
        def item(s: str, i: int) -> int:
            j = i
            while self.at(s, j) == "." or self.is_group(self.at(s, j), "[", 0):
                j += 2 if s[j] == "." else 1
            if j > i:
                i = self.char(s, j, "=")
            return self._initializer(s, i)

        return self.listing(s, i, item)

    def declaration(self, s: str, i: int) -> int:
        i = self._attributes(s, self.specifiers(s, i))
        if self.at(s, i) == ";":
            return i + 1
        return self.char(s, self._declarators_rest(s, self.declarator(s, i)), ";")

    def members(self, s: str, i: int) -> int:
        while i < len(s):
            if s[i] == ";":
                i += 1
                continue
            i = self._attributes(s, self.specifiers(s, i))
            if self.at(s, i) == ";":
                i += 1
                continue
            if self.at(s, i) != ":":
                i = self.declarator(s, i)
            i = self.char(s, self._declarators_rest(s, i), ";")
        return i

    def enumerators(self, s: str, i: int) -> int:
        def item(s: str, i: int) -> int:
            i = self._attributes(s, self.char(s, i, "x"))
            return self.conditional(s, i + 1) if self.at(s, i) == "=" else i

        return self.listing(s, i, item, empty=False)

    def _param(self, s: str, i: int) -> int:
        if self.at(s, i) == "…":
            return i + 1
        try:
            i = self.specifiers(s, i)
        except (Bad, IndexError):
            i = self.char(s, i, "x")
        return self._attributes(s, self.declarator(s, i, abstract=True))

    def params(self, s: str, i: int) -> int:
        return self.listing(s, i, self._param, trailing=False)

    def type_name(self, s: str, i: int) -> int:
        try:
            i = self.specifiers(s, i)
        except (Bad, IndexError):
            i = self.char(s, i, "x")
        return self.declarator(s, i, abstract=True)

    def bound(self, s: str, i: int) -> int:
        while self.at(s, i) and self.at(s, i) in "q":
            i += 1
        if i >= len(s) or s[i:] == "*":
            return len(s)
        return self.expression(s, i)

    def args(self, s: str, i: int) -> int:
        def item(s: str, i: int) -> int:
            try:
                j = self.assignment(s, i)
                if j >= len(s) or s[j] == ",":
                    return j
            except (Bad, IndexError):
                pass
            return self.type_name(s, i)

        return self.listing(s, i, item, trailing=False)

    def single(self, s: str, i: int) -> int:
        return self.expression(s, i)

    def expression(self, s: str, i: int) -> int:
        i = self.assignment(s, i)
        while self.at(s, i) == ",":
            i = self.assignment(s, i + 1)
        return i

    def assignment(self, s: str, i: int) -> int:
        i = self.conditional(s, i)
        if self.at(s, i) and self.at(s, i) in "=ä":
            return self.assignment(s, i + 1)
        return i

    def conditional(self, s: str, i: int) -> int:
        i = self.binary(s, i)
        if self.at(s, i) == "?":
            i = self.char(s, self.expression(s, i + 1), ":")
            return self.conditional(s, i)
        return i

    def binary(self, s: str, i: int) -> int:
        i = self.unary(s, i)
        while i < len(s) and s[i] in "%+-*&":
            i = self.unary(s, i + 1)
        return i

    def unary(self, s: str, i: int) -> int:
        while True:
            c = self.at(s, i)
            if c and c in "+-!~*&pz":
                if c == "z" and self.is_group(self.at(s, i + 1), "(", self.TYPE_NAME):
                    i += 2
                    return self._postfix(s, i)
                i += 1
            elif self.is_group(c, "(", self.TYPE_NAME) and self.at(s, i + 1) and self._operand_starts(s, i + 1):
                i += 1
                if self.is_group(self.at(s, i), "{", self.INIT):
                    return self._postfix(s, i + 1)
            else:
                break
        c = self.at(s, i)
        if c == '"':
            while self.at(s, i) and self.at(s, i) in '"x':
                i += 1
            return self._postfix(s, i)
        if c and c in "x0":
            i += 1
            while c == "x" and self.at(s, i) == '"':
                i += 1
            return self._postfix(s, i)
        if self.is_group(c, "(", self.SINGLE):
            return self._postfix(s, i + 1)
        if 0 <= ord(c or " ") - _BASE["("] < 256 and c != chr(_BASE["("]):
            return self.need(s, i, "(", self.SINGLE)
        raise Bad

    def _operand_starts(self, s: str, i: int) -> bool:
        c = s[i]
        return c in 'x0"!~z&p-+*' and (c not in "&-+*" or True) and not (c in "%") if c in 'x0"!~z' else (
            0 <= ord(c) - _BASE["("] < 256 or self.is_group(c, "{", self.INIT)
        )

    def _postfix(self, s: str, i: int) -> int:
        while i < len(s):
            c = s[i]
            if c == ".":
                i = self.char(s, i + 1, "x")
            elif self.is_group(c, "(", self.ARGS) or self.is_group(c, "[", 0):
                i += 1
            elif c == "p":
                i += 1
            else:
                break
        return i

    def for_header(self, s: str, i: int) -> int:
        if self.at(s, i) == ";":
            i += 1
        else:
            try:
                i = self.declaration(s, i)
            except (Bad, IndexError):
                i = self.char(s, self.expression(s, i), ";")
        if self.at(s, i) != ";":
            i = self.expression(s, i)
        i = self.char(s, i, ";")
        return self.expression(s, i) if i < len(s) else i

    def block(self, s: str, i: int) -> int:
        while i < len(s):
            i = self.statement(s, i)
        return i

    def statement(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c == ";":
            return i + 1
        if self.is_group(c, "{", self.BLOCK):
            return i + 1
        if c == "i":
            i = self.statement(s, self.need(s, i + 1, "(", self.SINGLE))
            return self.statement(s, i + 1) if self.at(s, i) == "l" else i
        if c == "w" or c == "S":
            return self.statement(s, self.need(s, i + 1, "(", self.SINGLE))
        if c == "f":
            return self.statement(s, self.need(s, i + 1, "(", self.HEADER))
        if c == "d":
            i = self.statement(s, i + 1)
            return self.char(s, self.need(s, self.char(s, i, "w"), "(", self.SINGLE), ";")
        if c == "k":
            i = self.conditional(s, i + 1)
            if self.at(s, i) == "…":
                i = self.conditional(s, i + 1)
            return self._labelled(s, self.char(s, i, ":"))
        if c == "D":
            return self._labelled(s, self.char(s, i + 1, ":"))
        if c == "b":
            return self.char(s, i + 1, ";")
        if c == "g":
            return self.char(s, self.char(s, i + 1, "x"), ";")
        if c == "r":
            return i + 2 if self.at(s, i + 1) == ";" else self.char(s, self.expression(s, i + 1), ";")
        if c == "α":
            while i < len(s) and s[i] != ";":
                i += 1
            return i + 1
        if c == "x" and self.at(s, i + 1) == ":":
            return self._labelled(s, i + 2)
        try:
            return self.declaration(s, i)
        except (Bad, IndexError):
            return self.char(s, self.expression(s, i), ";")

    def _labelled(self, s: str, i: int) -> int:
        return i if i >= len(s) else self.statement(s, i)


GRAMMARS: dict[str, Grammar] = {
    "javascript": JavaScript(types=False),
    "typescript": JavaScript(types=True),
    "go": Go(),
    "c": C(),
}
