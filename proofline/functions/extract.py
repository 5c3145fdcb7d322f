"""Facts and claims of one file: a pure function of path and text, applied by the fact base to every file.

Python is read with the interpreter's own parser; JavaScript, TypeScript, Go and C by masking comments and
strings and matching declarations in what remains. A Python file that does not parse gives comments only and is
marked, since nothing may be concluded from its silence.
"""

from __future__ import annotations

import ast
import bisect
import difflib
import re
import warnings

from proofline.functions import words as W

_MASK = {
    "javascript": re.compile(
        r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)"
        r"|(?<=[=(,:!&|?{;\[])\s*/(?![*/])(?:[^\\/\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
    ),
    "go": re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*(?:`|\Z))"),
    "c": re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)"),
    "python": re.compile(
        r"(?P<c>#[^\n]*)|(?P<s>[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?))"
    ),
}
_BLANK = re.compile(r"[^\n]")
_NAME = re.compile(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*\Z", re.A)
#: Runs of the characters of names, of paths, and what stands between two ticks: candidates that are then looked at whole.
_NAME_RUN = re.compile(r"[\w.$#]+(?=\(\))", re.A)
_PATH_RUN = re.compile(r"[\w./:@~\\-]+", re.A)
_TICKED = re.compile(r"`([^`\s]+)`")
_SUFFIXES = frozenset(W.FILE_SUFFIXES)


def ticked_names(text: str):
    """(raw, name, is it a call, start, end) of names between ticks."""
    for m in _TICKED.finditer(text):
        raw = m[1].rstrip(".,:;!?")
        name = raw.removesuffix("()")
        if _NAME.match(name):
            yield raw, name, raw != name, m.start(), m.end()


def called_names(text: str):
    """(name, start, end) of names with empty brackets that no tick, member sign or other name precedes."""
    for m in _NAME_RUN.finditer(text):
        if _NAME.match(m[0]) and not (m.start() and text[m.start() - 1] in "`#"):
            yield m[0], m.start(), m.end() + 2


def path_names(text: str):
    """(path, start) of relative paths with a known suffix; addresses and absolute paths are none."""
    for m in _PATH_RUN.finditer(text):
        run = m[0].rstrip(".:-")
        stem, dot, suffix = run.rpartition(".")
        if "/" in run and dot and suffix in _SUFFIXES and run[0] not in "./:~-@" and ":" not in run and "\\" not in run and "//" not in run and stem[-1] != "/":
            yield run, m.start()


_CODE_LIKE = re.compile(r"^\s*(?:def |class |return\b|if .*:$|for .*:$|import \w|from \w+ import|\w+\(.*\);?$|\w+ = .+|const |let |var |func |[{}]+;?$)")
_TAG_LINE = re.compile(
    r"^\s*(?::(?:param|arg|argument|type|return|rtype|returns|raises|except|var|ivar|cvar|meta|keyword|key)\b"
    r"|\*?\s*@(?:param|arg|argument|returns?|throws?|exception|type|typedef|property|prop|template|yields?)\b)"
)
_DYNAMIC = re.compile(r"\bglobals\(\)\s*(?:\[|\.update)|\bsetattr\(\s*sys\.modules|\bsys\.modules\[[^\]\n]*\][^\n=]*=(?!=)|\bsys\.modules\.(?:update|setdefault)\(|\b__getattr__\b|\bvars\(\)\s*\[")
_DATA_DUNDERS = tuple(sorted({n for n in dir(object) + dir(type) + dir(list) + dir(dict) + dir(int) if n.startswith("__")} | {
    "__enter__", "__exit__", "__aenter__", "__aexit__", "__aiter__", "__anext__", "__await__", "__call__", "__get__", "__set__",
    "__delete__", "__set_name__", "__post_init__", "__fspath__", "__missing__", "__getattr__", "__all__", "__version__", "__name__",
    "__file__", "__path__", "__main__", "__doc__", "__dict__", "__module__", "__slots__", "__weakref__",
}))


class Masked:
    """Comments, strings and the code with both blanked, all with their places."""

    def __init__(self, language: str, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.comments: list[tuple[str, int, int]] = []
        self.strings: list[tuple[str, int]] = []
        out, bare, at = [], [], 0
        for m in _MASK[language].finditer(text):
            blank = _BLANK.sub(" ", m[0])
            out += (text[at : m.start()], blank)
            bare += (text[at : m.start()], blank if m["c"] else m[0])
            at = m.end()
            if m["c"]:
                first = self.line(m.start())
                self.comments.append((m[0], first, first + m[0].count("\n")))
            else:
                self.strings.append((m[0], self.line(m.start())))
        self.code = "".join([*out, text[at:]])
        self.bare = "".join([*bare, text[at:]])  # comments blanked, strings kept

    def line(self, pos: int) -> int:
        return bisect.bisect_right(self.starts, pos)


def _comment_text(raw: str) -> str:
    if raw.startswith("/*"):
        body = raw[2:].removesuffix("*/")
        return "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in body.split("\n")).strip("* \n")
    return re.sub(r"^(?:#+|//+)[!:]? ?", "", raw)


def _blocks(comments: list[dict]) -> None:
    """Contiguous comments form a block, whose text each of them carries."""
    group: list[dict] = []
    for c in [*comments, None]:
        if c and group and c["line"] <= group[-1]["end_line"] + 1:
            group.append(c)
            continue
        block = "\n".join(x["text"] for x in group)
        for x in group:
            x["block"] = block
        group = [c] if c else []


def _dead(c: dict) -> bool:
    lines = [x for x in c["block"].split("\n") if x.strip()]
    return len(lines) > 0 and sum(bool(_CODE_LIKE.match(x)) for x in lines) > 0.6 * len(lines)


def _function_of(node: ast.AST, method: bool) -> dict:
    a = node.args
    args = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
    args += ["*" + a.vararg.arg] if a.vararg else []
    args += ["**" + a.kwarg.arg] if a.kwarg else []
    first = node.body[0]
    doc = first.value.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else None
    return {
        "name": node.name, "lineno": node.lineno, "end_lineno": node.end_lineno, "args": args, "docstring": doc,
        "doc_line": first.lineno if doc is not None else None, "is_method": method,
    }


#: Definitions in a file that does not parse: what they name is not undefined.
_LOOSE_DEF = re.compile(r"^[ \t]*((?:async[ \t]+def|def|class)[ \t]+(\w+)|(\w+)[ \t]*(?::[^=\n]+)?=(?!=))", re.M)
_GUARD = re.compile(r"TYPE_CHECKING|version_info|sys\.platform|os\.name")


def _python(text: str, out: dict) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = compile(text, "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out["parse_failed"] = True
        for m in _LOOSE_DEF.finditer(text):
            top = m.start() == m.start(1)
            out["symbols"].append({"name": m[2] or m[3], "lineno": text.count("\n", 0, m.start(1)) + 1, "kind": "opaque", "top": top})
        return

    def define(name: str, line: int, kind: str, top: bool) -> None:
        out["symbols"].append({"name": name, "lineno": line, "kind": kind, "top": top})

    def targets(node: ast.AST):
        if isinstance(node, ast.Name):
            yield node
        elif isinstance(node, (ast.Tuple, ast.List)):
            for e in node.elts:
                yield from targets(e)
        elif isinstance(node, ast.Starred):
            yield from targets(node.value)

    def walk(body: list[ast.stmt], top: bool, in_class: bool, guarded: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out["functions"].append(_function_of(n, in_class))
                define(n.name, n.lineno, "method" if in_class else "function", top)
                walk(n.body, False, False, guarded)
            elif isinstance(n, ast.ClassDef):
                define(n.name, n.lineno, "class", top)
                walk(n.body, False, True, guarded)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out["imports"].append({"kind": "py", "module": a.name, "level": 0, "name": None, "alias": a.asname or a.name.split(".")[0], "guarded": guarded, "lineno": n.lineno})
            elif isinstance(n, ast.ImportFrom):
                for a in n.names:
                    out["imports"].append({"kind": "py", "module": n.module or "", "level": n.level, "name": a.name, "alias": a.asname or a.name, "guarded": guarded, "lineno": n.lineno})
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and (top or in_class):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for name in targets(t):
                        define(name.id, n.lineno, "value", top)
            else:
                if type(n).__name__ == "TypeAlias":
                    define(n.name.id, n.lineno, "value", top)
                inside = guarded or isinstance(n, ast.Try) or (isinstance(n, ast.If) and bool(_GUARD.search(ast.unparse(n.test))))
                for part in ("body", "orelse", "finalbody"):
                    walk(getattr(n, part, None) or [], top, in_class, inside)
                for part in ("handlers", "cases"):
                    for h in getattr(n, part, None) or []:
                        walk(h.body, top, in_class, inside)

    walk(tree.body, True, False, False)


_JS_DEF = re.compile(
    r"^(?P<e>[ \t]*export\s+(?:default\s+)?)?[ \t]*(?:(?:declare|abstract)\s+)?(?:async\s+)?(?:(?P<k>function\*?|class|interface|enum|type|namespace)\s+(?P<n>[A-Za-z_$][\w$]*)"
    r"|(?P<v>const|let|var)\s+(?:(?P<m>[A-Za-z_$][\w$]*)|\{(?P<d>[^}=]*)\}))", re.M
)
_JS_METHOD = re.compile(r"^[ \t]+(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*(?P<n>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::[^;{]*)?\{", re.M)
_JS_IMPORT = re.compile(
    r"^[ \t]*(?:import|export)\s+(?:type\s+)?(?P<b>[^'\";]*?)\s*(?:from\s*)?[\"'](?P<s>[^\"'\n]+)[\"']|(?P<l>(?:const|let|var)\s+(?P<r>[\w$]+|\{[^}]*\})\s*=\s*)?\brequire\(\s*[\"'](?P<q>[^\"'\n]+)[\"']\s*\)", re.M
)
_JS_LIST = re.compile(r"^[ \t]*export\s*(?:type\s*)?\{([^}]*)\}", re.M)
_JS_STAR = re.compile(r"^[ \t]*export\s*\*\s*(?:as\s+([\w$]+)\s+)?from\s*[\"']([^\"'\n]+)[\"']", re.M)
_JS_CJS = re.compile(r"\b(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=")
_JS_CJS_OBJECT = re.compile(r"\bmodule\.exports\s*=\s*\{([^}]*)\}")


def _parameters(code: str, at: int, kind: str) -> tuple[list[str], int]:
    """Names of the parameters in the first brackets from ``at`` on, and where the brackets end.

    Javascript names come first in a parameter, Go's too (a group shares a type), C's last.
    """
    open_ = code.find("(", at)
    if open_ < 0:
        return [], at
    depth, parts, start, k = 0, [], open_ + 1, open_
    for k in range(open_, len(code)):
        ch = code[k]
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        if (ch == "," and depth == 1) or not depth:
            parts.append(code[start:k])
            start = k + 1
        if not depth:
            break
    names = []
    for part in parts:
        words = re.findall(r"[A-Za-z_$][\w$]*", part.split("=")[0] if kind == "js" else part)
        if part.strip()[:1] in ("{", "["):
            names += words
        elif words and not (kind == "c" and words == ["void"]):
            words = [w for w in words if w not in ("public", "private", "protected", "readonly")] or words
            names.append(words[-1] if kind == "c" else words[0])
    return names, k


def _end_line(mask: "Masked", at: int) -> int | None:
    """The line on which the block that opens after ``at`` closes."""
    open_ = mask.code.find("{", at)
    if open_ < 0:
        return None
    depth = 0
    for m in _BRACE.finditer(mask.code, open_):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return mask.line(m.start())
    return None


_BRACE = re.compile(r"[{}]")


def _function_row(mask: "Masked", name: str, at: int, line: int, kind: str, method: bool) -> dict:
    args, end = _parameters(mask.code, at, kind)
    return {"name": name, "lineno": line, "end_lineno": _end_line(mask, end), "args": args, "docstring": None, "doc_line": None, "is_method": method}


def _names(listing: str) -> list[tuple[str, str]]:
    """(original, local) of a list of names with ``as`` or ``:``."""
    out = []
    for part in listing.split(","):
        m = re.match(r"\s*(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:(?:as|:)\s*([A-Za-z_$][\w$]*))?", part)
        if m:
            out.append((m[1], m[2] or m[1]))
    return out


def _javascript(text: str, mask: Masked, out: dict) -> None:
    code = mask.code
    for m in _JS_DEF.finditer(code):
        kind = (m["k"] or "value").rstrip("*")
        exported = bool(m["e"])
        names = [m["n"] or m["m"]] if (m["n"] or m["m"]) else [b for _, b in _names(m["d"] or "")]
        top = m.start() == 0 or not text[mask.starts[mask.line(m.start()) - 1] : m.end()][:1].isspace()
        for name in names:
            out["symbols"].append({"name": name, "lineno": mask.line(m.end()), "kind": kind, "top": top})
            if exported:
                out["exports"].append("default" if "default" in (m["e"] or "") else name)
            if kind == "function":
                out["functions"].append(_function_row(mask, name, m.end(), mask.line(m.end()), "js", False))
    for m in _JS_METHOD.finditer(code):
        if m["n"] not in W.JS_RESERVED:
            out["symbols"].append({"name": m["n"], "lineno": mask.line(m.end("n")), "kind": "method", "top": False})
            out["functions"].append(_function_row(mask, m["n"], m.end("n"), mask.line(m.end("n")), "js", True))
    for m in _JS_IMPORT.finditer(mask.bare):
        spec = m["s"] or m["q"]
        line = mask.line(m.end())
        row = {"kind": "js", "module": spec, "level": 0, "guarded": bool(m["q"]) and not m["l"], "lineno": line}
        bound = m["b"] if m["s"] else (m["r"] or "")
        is_export = m[0].lstrip().startswith("export")
        braces = re.search(r"\{([^}]*)\}", bound or "")
        listed = _names(braces[1]) if braces else []
        default = re.match(r"\s*([A-Za-z_$][\w$]*)\s*(?:,|$)", bound or "") if not is_export and m["s"] else None
        for orig, local in listed:
            out["imports"].append(row | {"name": orig, "alias": local})
        if default and default[1] != "type":
            out["imports"].append(row | {"name": "default", "alias": default[1]})
        star = re.search(r"\*\s*as\s+([\w$]+)", bound or "")
        if star or (m["q"] and m["r"] and not braces):
            out["imports"].append(row | {"name": "*", "alias": star[1] if star else m["r"]})
        if not (listed or default or star or (m["q"] and m["r"])):
            out["imports"].append(row | {"name": None, "alias": None})
        if is_export and braces:
            out["exports"] += [local for _, local in listed]
    for m in _JS_LIST.finditer(code):
        out["exports"] += [b for _, b in _names(m[1])]
    for m in _JS_STAR.finditer(mask.bare):
        if m[1]:
            out["exports"].append(m[1])
        else:
            out["export_stars"].append(m[2])
    out["exports"] += [m[1] for m in _JS_CJS.finditer(code)]
    whole = _JS_CJS_OBJECT.search(code)
    if whole:
        out["exports"] += [a for a, _ in _names(whole[1])]
        out["dynamic"] |= "..." in whole[1]
    elif re.search(r"\bmodule\.exports\s*=", code):
        out["dynamic"] = True
    if re.search(r"^[ \t]*export\s+default\b", code, re.M):
        out["exports"].append("default")
    out["esm"] = bool(re.search(r"^[ \t]*export\b", code, re.M))


def _go(mask: Masked, text: str, out: dict) -> None:
    for m in re.finditer(r"^func\s*(\([^)]*\)\s*)?([A-Za-z_]\w*)", mask.code, re.M):
        out["symbols"].append({"name": m[2], "lineno": mask.line(m.start()), "kind": "method" if m[1] else "function", "top": True})
        out["functions"].append(_function_row(mask, m[2], m.end(), mask.line(m.start()), "go", bool(m[1])))
    for m in re.finditer(r"^(?:type|var|const)\s+([A-Za-z_]\w*)|^\t([A-Za-z_]\w*)\s*(?:=|\w+\s*=)", mask.code, re.M):
        out["symbols"].append({"name": m[1] or m[2], "lineno": mask.line(m.start()), "kind": "value", "top": True})
    for block in _GO_IMPORT.finditer(mask.bare):
        for m in re.finditer(r'(?:([\w.]+)[ \t]+)?"([^"\n]+)"', block[0]):
            out["imports"].append({"kind": "go", "module": m[2], "level": 0, "name": None, "alias": m[1] if m[1] not in (None, "import") else m[2].rsplit("/", 1)[-1], "guarded": False, "lineno": mask.line(block.start() + m.start(2))})


_GO_IMPORT = re.compile(r"^import\s*(?:\([^)]*\)|[^\n(]*)", re.M)


def _c(mask: Masked, text: str, out: dict) -> None:
    for m in re.finditer(r"^(?!return\b|else\b|typedef\b)[A-Za-z_][\w \t*]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(\{|;)", mask.code, re.M):
        out["symbols"].append({"name": m[1], "lineno": mask.line(m.start(1)), "kind": "function" if m[2] == "{" else "prototype", "top": True})
        if m[2] == "{":
            out["functions"].append(_function_row(mask, m[1], m.end(1), mask.line(m.start(1)), "c", False))
    for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+(\w+)|^(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)|^[A-Za-z_][\w \t*]*?\b(\w+)\s*(?:=|\[[^\]]*\]|;)|^\}\s*(\w+)\s*;", mask.code, re.M):
        out["symbols"].append({"name": next(g for g in m.groups() if g), "lineno": mask.line(m.start()), "kind": "value", "top": True})
    for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', text, re.M):
        stem = m[1].rsplit("/", 1)[-1].rsplit(".", 1)[0]
        out["imports"].append({"kind": "c", "module": m[1], "level": 0, "name": None, "alias": stem, "guarded": "<" in m[0], "lineno": mask.line(m.start())})


def _go_docs(comments: list[dict], functions: list[dict]) -> None:
    """The run of comments that ends on the line above a function."""
    by_end = {c["end_line"]: c for c in comments}
    for f in functions:
        run = []
        while c := by_end.get((run[-1]["line"] if run else f["lineno"]) - 1):
            run.append(c)
        if run:
            f["docstring"], f["doc_line"] = "\n".join(c["text"] for c in reversed(run)), run[-1]["line"]


def _doc_attach(comments: list[dict], functions: list[dict], every: bool = False) -> None:
    by_end = {c["end_line"]: c for c in comments if every or c["raw"].startswith("/**")}
    for f in functions:
        for back in range(1, 5):
            c = by_end.get(f["lineno"] - back)
            if c:
                f["docstring"], f["doc_line"] = c["text"], c["line"]
                break


def _symbol_claims(language: str, comments: list[dict], functions: list[dict], words: dict[str, int], imported: set[str], out: list[dict]) -> None:
    texts = [(c["text"], c["block"], c["line"], c["end_line"]) for c in comments if not _dead(c)]
    if language == "python":
        texts += [
            ("\n".join(x for x in f["docstring"].split("\n") if not _TAG_LINE.match(x)),) * 2 + (f["doc_line"],) * 2
            for f in functions if f["docstring"]
        ]

    def known(root: str, base: str, least: int) -> bool:
        if root in imported or root in words or base in words:
            return True
        if language == "python" and (root in W.STDLIB or (root[:1].isupper() and root.lower() in W.STDLIB)):
            return True
        return len(base) >= least and any(w.endswith(base) and w != base for w in words)

    def judged(base: str) -> bool:
        return len(base) >= 3 and "xxx" not in base.lower() and base.lower() not in W.METASYNTACTIC and not W.reserved(base, language)

    seen: set[tuple] = set()
    for text, block, line, end in texts:
        for raw, name, call, start, stop in ticked_names(text):
            root, base = name.split(".")[0], name.split(".")[-1]
            if not judged(base):
                continue
            if not call:
                if language != "python" or not (base.startswith("__") and base.endswith("__")) or base in _DATA_DUNDERS or "." in name:
                    continue
                if not difflib.get_close_matches(base, _DATA_DUNDERS, 1, 0.85):
                    continue
            window = text[max(0, start - 60) : stop + 40]
            if W.NEGATED.search(window) or W.HISTORICAL.search(block) or (W.TICKET.search(block) and not W.WORK_ITEM.search(block)):
                continue
            if known(root, base, 6) or (language == "javascript" and "." in name and root in W.JS_RESERVED):
                continue
            if (line, name, True) not in seen:
                seen.add((line, name, True))
                out.append({"claim": f"`{raw}`", "name": name, "root": root, "base": base, "ticked": True, "line": line, "end_line": end})
        for name, start, stop in called_names(text):
            root, base = name.split(".")[0], name.split(".")[-1]
            window = text[max(0, start - 60) : stop + 40]
            if (
                not judged(base) or f"`{name}()`" in text or f"`{base}()`" in text or not W.REFERENCE_VERB.search(window)
                or W.TICKET.search(text) or re.match(r"[A-Z]{2,}", base) or W.NEGATED.search(window) or W.HISTORICAL.search(window)
                or known(root, base, 4)
                or (language == "c" and re.fullmatch(r"[A-Z][a-z]+(?:[A-Z]\w*)+", base))
            ):
                continue
            if (line, name, False) not in seen:
                seen.add((line, name, False))
                out.append({"claim": f"{name}()", "name": name, "root": root, "base": base, "ticked": False, "line": line, "end_line": end})


def _file_claims(comments: list[dict], functions: list[dict], out: list[dict]) -> None:
    ticketed = {n for c in comments if W.TICKET.search(c["text"]) for n in range(c["line"] - 2, c["end_line"] + 3)}
    texts = [(c["text"], c["line"], c["end_line"], "Comment") for c in comments if not _dead(c)]
    texts += [(f["docstring"], f["doc_line"], f["doc_line"], "Docstring") for f in functions if f["docstring"] and f["doc_line"]]
    for text, line, end, kind in texts:
        text = re.sub(r"https?://\S+", "", text)
        if W.TICKET.search(text) or line in ticketed:
            continue
        for ref, start in path_names(text):
            parts = [p for p in re.split(r"[/.]", ref.lower()) if p]
            stem = ref.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            if (
                W.PATH_PLACEHOLDERS.intersection(parts) or "..." in ref or stem in ("x", "y", "z") or any("xxx" in p for p in parts)
                or any(re.fullmatch(r"my[_-]?(?:pkg|package|module|lib|app|project|file|dir|repo|plugin|script|code)s?", p) for p in parts)
                or W.IGNORED_DIRS.intersection(ref.split("/")[:-1])
                or W.ILLUSTRATIVE.search(text[max(0, start - 120) : start])
                or re.search(r"\b[A-Za-z][\w.-]*'s\s+`?$", text[max(0, start - 60) : start])
            ):
                continue
            out.append({"ref": ref, "line": line, "end_line": end, "kind": kind})


_PATCH = re.compile(r"\bpatch(?:\.object)?\(\s*[\"']([A-Za-z_][\w.]*\.[A-Za-z_]\w*)[\"']")
_PATCH_OBJECT = re.compile(r"\bpatch\.object\(\s*([A-Za-z_]\w*)\s*,\s*[\"']([A-Za-z_]\w*)[\"']")
_DEPRECATED = re.compile(r"\bdeprecat|\b(?:replaced|superseded) by\b|\bmigrate to\b|\buse\b.{0,80}\binstead\b", re.I)
_WEAK_FRAME = re.compile(r"\buse\b.{0,80}\binstead\b", re.I)
_LOCK = re.compile(r"\b(?:must hold|holding|guarded by|protected by|acquires?|requires?)\s+(?:the\s+)?`?([A-Za-z_][\w.]*)`?", re.I)
_LOCK_LIKE = re.compile(r"lock|mutex|guard|monitor|semaphore", re.I)
_ENV = re.compile(
    r"(?:os\.)?(?:getenv|environ\.get)\(\s*[\"'](?P<a>[A-Z][A-Z0-9_]*)[\"']\s*,\s*(?P<x>[\"'][^\"'\n]*[\"']|\d[\d.]*)"
    r"|process\.env\.(?P<b>[A-Z][A-Z0-9_]*)\s*(?:\?\?|\|\|)\s*(?P<y>[\"'][^\"'\n]*[\"']|\d[\d.]*)"
)
_DEFAULT_WORD = re.compile(r"\bdefault(?:s|ed|ing)?\b|\bfalls? back\b|\bfallback\b", re.I)
_HTTP = re.compile(r"\b(?:[\w$]+\.)?(?:(get|post|put|delete|patch|head|options)|request|fetch|ajax)\(\s*f?([\"'`])([^\"'`\n]+)\2", re.I)


def _other_claims(language: str, text: str, mask: Masked, comments: list[dict], words: dict[str, int], imports: list[dict], out: dict) -> None:
    imported = {i["alias"] for i in imports if i["alias"]}
    lines = text.split("\n")
    commented = {n for c in comments for n in range(c["line"], c["end_line"] + 1) if lines[n - 1].lstrip().startswith(("#", "//", "*", "/*"))}
    if language == "python":
        origin = {i["alias"]: (f"{i['module']}.{i['name']}" if i["name"] else i["module"]) for i in imports if i["level"] == 0}
        for n, x in enumerate(lines, 1):
            if n in commented or "create=True" in x or "patch" not in x:
                continue
            found = [m[1] for m in _PATCH.finditer(x)]
            found += [f"{origin[m[1]]}.{m[2]}" for m in _PATCH_OBJECT.finditer(x) if m[1] in origin]
            for target in found:
                tail = target.rsplit(".", 1)[1]
                if len(tail) >= 3 and not tail.startswith("__"):
                    out["mock_claims"].append({"target": target, "line": n})
    reads = []
    for n, x in enumerate(lines, 1):
        if n in commented:
            continue
        for m in _ENV.finditer(x):
            reads.append((m["a"] or m["b"], (m["x"] or m["y"]).strip("\"'"), n))
        if language in ("python", "javascript"):
            for m in _HTTP.finditer(x):
                path = re.sub(r"^[a-z]+://[^/]+", "", m[3])
                path = re.split(r"[?#]", path)[0]
                if path.startswith("/") and not re.search(r"[\s\\]", path) and not re.search(r"\.(?:js|css|png|jpe?g|svg|ico|html|map|woff2?)$", path) and not re.match(r"/(?:etc|tmp|usr|var|home|dev)(?:/|$)", path):
                    out["http_calls"].append({"method": (m[1] or "").upper(), "path": path.rstrip("/") or "/", "line": n})
    for c in comments:
        if W.TICKET.search(c["text"]):
            continue
        t = c["text"]
        if _DEPRECATED.search(t):
            weak = bool(_WEAK_FRAME.search(t)) and not re.search(r"deprecat|replaced by|superseded by|migrate to", t, re.I)
            for m in re.finditer(r"(?<![`\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|[A-Za-z_]\w*(?=\(\)))(?![`\w])", t):
                root, base = m[1].split(".")[0], m[1].split(".")[-1]
                if len(base) < 3 or base.startswith("__") or W.reserved(base, language) or (weak and base.isupper()) or root in imported or base in words or root in words or root in W.STDLIB or re.search(r"\.(?:py|js|ts|go|c|h|md|com|org|io)$", m[1]):
                    continue
                out["contract_claims"].append({"name": m[1], "root": root, "base": base, "frame": "deprecation", "line": c["line"], "end_line": c["end_line"]})
        for m in _LOCK.finditer(t):
            base = m[1].split(".")[-1]
            if (base.startswith("_") or _LOCK_LIKE.search(base)) and len(base) >= 3 and base not in words and m[1].split(".")[0] not in imported and base.lower() not in ("lock", "mutex", "the", "locks"):
                out["contract_claims"].append({"name": m[1], "root": m[1].split(".")[0], "base": base, "frame": "lock", "line": c["line"], "end_line": c["end_line"]})
    for var, actual, n in reads:
        for c in comments:
            if var in c["text"] and _DEFAULT_WORD.search(c["text"]):
                claimed = next(iter(re.findall(r"(?<![\w.])(\d[\d.]*\d|\d)(?![\w])|[\"'`]([^\"'`]+)[\"'`]", c["text"].replace(var, ""))), None)
                value = (claimed[0] or claimed[1]) if claimed else None
                if value and value != actual:
                    out["env_drifts"].append({"var": var, "claimed": value, "actual": actual, "line": c["line"], "end_line": c["end_line"], "code_line": n})
                break


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
# Fence languages whose calls can be judged.
_DOC_LANGUAGES = {"python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "ts": "javascript", "typescript": "javascript", "go": "go", "golang": "go", "c": "c"}
_SHELL = {"console", "shell", "bash", "sh", "zsh", "shell-session", "text"}
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\(")


def fences(lines: list[str]) -> list[dict]:
    """Fenced blocks by the CommonMark walk; ``close`` is None for a block open at the end."""
    out: list[dict] = []
    open_ = None
    for n, line in enumerate(lines, 1):
        m = _FENCE.match(line.rstrip("\r"))
        if open_ is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                open_ = {"open": n, "close": None, "info": m[2].strip(), "ch": m[1][0], "len": len(m[1]), "inner": []}
        elif m and m[1][0] == open_["ch"] and len(m[1]) >= open_["len"] and not m[2].strip():
            open_["close"] = n
            out.append(open_)
            open_ = None
        elif m and m[2].strip() and not (m[1][0] == "`" and "`" in m[2]):
            open_["inner"].append((n, m[1][0], len(m[1])))
    return out + ([open_] if open_ else [])


_SHELL_TOKEN = re.compile(r"""\s+|\#[^\n]*|\|\||&&|[|;&\n]|(?:\\.|'[^']*'|"(?:[^"\\]|\\.)*"|[^\s|;&'"\\])+|.""", re.S)
_QUOTES = re.compile(r"""'([^']*)'|"((?:[^"\\]|\\.)*)"|\\(.)""", re.S)
# Commands that run the command behind them.
_WRAPPERS = frozenset("command env exec nice nohup npx pipx poetry run sudo time uv uvx".split())


def commands_of(line: str) -> list[list[str]]:
    """Words of the simple commands in a line of shell, without settings of variables and wrapping commands."""
    out: list[list[str]] = [[]]
    for m in _SHELL_TOKEN.finditer(line):
        t = m[0]
        if t.isspace() and t != "\n":
            continue
        if t[0] == "#" and (not m.start() or line[m.start() - 1].isspace()):
            continue
        if t in ("||", "&&", "|", ";", "&", "\n"):
            out.append([])
        else:
            out[-1].append(_QUOTES.sub(lambda q: next(g for g in (*q.groups(), "") if g is not None), t))
    done = []
    for argv in out:
        while argv and (re.match(r"[A-Za-z_]\w*=", argv[0]) or argv[0] in _WRAPPERS or (argv[0] in ("python", "python3") and argv[1:2] == ["-m"])):
            argv = argv[2:] if argv[0].startswith("python") else argv[1:]
        if argv:
            done.append(argv)
    return done


def _invoke(out: dict, command: str, line: int, strong: bool) -> None:
    found = commands_of(command)
    out["invocations"] += [{"argv": argv, "line": line, "strong": strong} for argv in (found if strong else found[:1])]


def _rst(text: str, out: dict) -> None:
    """Prompts of literal blocks."""
    for n, x in enumerate(text.split("\n"), 1):
        m = re.match(r"\s+[$>]\s+(.*)", x)
        if m:
            _invoke(out, m[1], n, True)


def _markdown(text: str, out: dict) -> None:
    lines = text.split("\n")
    last = len(lines) - (1 if lines and not lines[-1] else 0)
    bound: set[str] = set()
    for f in fences(lines):
        for n, ch, size in f["inner"]:
            if not (f["info"] and (f["len"] > size or ch != f["ch"])):
                out["fence_findings"].append({"line": n, "end_line": n, "opened": f["open"], "kind": "swallowed"})
        if f["close"] is None:
            out["fence_findings"].append({"line": f["open"], "end_line": max(f["open"], last), "opened": f["open"], "kind": "open"})
            continue
        info = (re.split(r"[\s{,]", f["info"]) or [""])[0].lower()
        body = lines[f["open"] : f["close"] - 1]
        if info in _SHELL:
            for k, x in enumerate(body):
                x = x.strip()
                prompt = re.match(r"[$>]\s+(.*)", x)
                if prompt or info != "text":
                    _invoke(out, prompt[1] if prompt else x, f["open"] + 1 + k, True)
        lang = _DOC_LANGUAGES.get(info)
        if not lang or any("..." in x or "…" in x or re.match(r"\s*(?:\$|>>>|# -)", x) for x in body):
            continue
        before = next((x for x in reversed(lines[: f["open"] - 1]) if x.strip()), "")
        for x in body:
            bound.update(re.findall(r"\b(?:def|class|func|function|const|let|var|import|as|for|type)\s+([A-Za-z_$][\w$]*)", x))
            bound.update(re.findall(r"([A-Za-z_$][\w$]*)\s*(?::=|=(?!=))", x))
            m = re.match(r"\s*from\s+\S+\s+import\s+(.+)", x)
            if m:
                bound.update(re.findall(r"\w+", m[1]))
            m = re.match(r"\s*import\s*\{([^}]*)\}", x)
            if m:
                bound.update(b for _, b in _names(m[1]))
        if W.ILLUSTRATIVE.search(before):
            continue
        for k, x in enumerate(body):
            if re.match(r"\s*(?:#|//|\*|/\*|@)", x):
                continue
            bare = re.sub(r"(['\"`]).*?\1", "''", re.split(r"\s(?:#|//)", x)[0])
            for m in _CALL.finditer(bare):
                root, base = m[1].split(".")[0], m[1].split(".")[-1]
                if len(base) >= 3 and base not in bound and root not in bound and root not in ("cls", "self", "this") and not W.reserved(base, lang) and not W.reserved(root, lang) and root not in W.STDLIB and base.lower() not in W.METASYNTACTIC and root not in W.METASYNTACTIC:
                    out["doc_calls"].append({"name": m[1], "base": base, "root": root, "line": f["open"] + 1 + k})
    for n, x in enumerate(lines, 1):
        for m in re.finditer(r"(?<!`)`([a-z][\w.-]+(?: [^`\n]+))`(?!`)", x):
            if not W.ILLUSTRATIVE.search(x) and not (n > 1 and W.ILLUSTRATIVE.search(lines[n - 2])):
                _invoke(out, m[1], n, False)


_FLAG_DEF = re.compile(r"""(?:add_argument|add_option|option|Flag|flag|Bool|String|Int|Duration|Var|Option)\w*\(\s*(?:&?[\w.]+\s*,\s*)?((?:["']-{0,2}[A-Za-z][\w-]*["']\s*,?\s*)+)""")
_QUOTED_FLAG = re.compile(r"""["'](--[A-Za-z][\w-]*)[=\s"']""")
_OPAQUE_CLI = re.compile(r"^\s*(?:import typer|from typer|import fire|from fire|import docopt|from docopt)\b", re.M)

ARRAYS = (
    "comments", "functions", "symbols", "imports", "exports", "export_stars", "symbol_claims", "file_claims", "mock_claims",
    "contract_claims", "env_drifts", "http_calls", "fence_findings", "doc_calls", "invocations", "flags", "words", "attrs", "quoted",
)


def facts_of(path: str, text: str) -> dict:
    """All facts and claims of a file."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    language = W.CODE_SUFFIXES.get(suffix, "config")
    out: dict = {k: [] for k in ARRAYS} | {"language": language, "parse_failed": False, "dynamic": False, "esm": False, "opaque_cli": False, "error": None}
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if language == "markdown":
        (_rst if suffix == "rst" else _markdown)(text, out)
        return out
    if language == "config":
        return out
    mask = Masked(language, text)
    comments = [{"text": _comment_text(t), "raw": t[:3], "line": a, "end_line": b} for t, a, b in mask.comments if not (t.startswith("#!") and a == 1)]
    _blocks(comments)
    if language == "python":
        _python(text, out)
    elif language == "javascript":
        _javascript(text, mask, out)
        _doc_attach(comments, out["functions"])
    elif language == "go":
        _go(mask, text, out)
        _go_docs(comments, out["functions"])
    else:
        _c(mask, text, out)
        _doc_attach([c for c in comments if c["raw"].startswith("/*")], out["functions"], every=True)
    out["dynamic"] |= bool(_DYNAMIC.search(text)) if language == "python" else False
    counts: dict[str, int] = {}
    for w in re.findall(r"[A-Za-z_$][\w$]*", mask.code):
        counts[w] = counts.get(w, 0) + 1
    imported = {i["alias"] for i in out["imports"] if i["alias"]}
    _symbol_claims(language, comments, out["functions"], counts, imported, out["symbol_claims"])
    _file_claims(comments, out["functions"] if language != "go" else [], out["file_claims"])
    _other_claims(language, text, mask, comments, counts, out["imports"], out)
    for m in _FLAG_DEF.finditer(text):
        out["flags"] += ["--" + f.lstrip("-") for f in re.findall(r"""["'](-{0,2}[A-Za-z][\w-]*)["']""", m[1]) if len(f.lstrip("-")) > 1]
    out["flags"] += [m[1] for m in _QUOTED_FLAG.finditer(text)]
    out["opaque_cli"] = bool(_OPAQUE_CLI.search(text))
    if language == "python":
        out["quoted"] = sorted({x.rsplit(".", 1)[-1] for t, _ in mask.strings if len(t) < 200 and _NAME.match(x := t.lstrip("rRbBuUfF").strip("\"'"))})
    out["comments"] = comments
    out["words"] = [{"word": w, "n": n} for w, n in counts.items()]
    out["attrs"] = [{"mod": a, "attr": b} for a, b in sorted(set(re.findall(r"\b([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)", mask.code)))]
    return out
