"""Problem 1 and 2: verdicts on snippets, chunked lexing, documentation pairs."""

import random

import pytest

from proofline.llm import docpairs, lexers, validity

GOOD = {
    "python": ["", "x = [\n1,\n(2,\n3),\n]\ny = 'a \\\nb'\n@a\n@b(\n1)\ndef f():\n    pass\nif x:\n    y = 1\nelse:\n    y = 2\n", "x = {\n'a': [\n1],\n}\nfoo(\n)\n\n# c\ntry:\n    a\nexcept B:\n    pass\nfinally:\n    c\nx = 1 + \\\n2\n", "x = 1\n", "﻿x = 1", "def f(a, *, b=1):\n    '''doc'''\n    return {**a}\n", "s = '''\n<<<<<<< HEAD\n'''\n", "\tif_ = 1".strip()],
    "javascript": [
        "", "// only a comment", "const a = 1, {b, c: [d = 2]} = x\nlet e", "if (a) b(); else { c() }", "for (const x of y) z(x)\nfor (let i = 0; i < 3; i++) {}",
        "class A extends B { static x = 1; #p; get y() { return this.#p } async *g() { yield* h() } }", "export default async (a, {b}) => ({ [b]: a?.c ?? d })",
        "import d, * as n from 'm'; export * from 'k'; export { a as default }", "const r = /[/({]+\\s*x/g.test(s) ? `a ${b + `c${d}`} e` : 0",
        "label: while (true) { break label }", "try { a() } catch { b() } finally { c() }", "switch (x) { case 'a': { break; } default: y() }",
        "#!/usr/bin/env node\n'use strict';\nfoo()\n[1, 2].map((x) => x * 2)", "a = function* () {}\nnew Foo\nnew Bar(1).baz()", "if (x)\n  y()\nelse\n  z()", "var f = async x => await x",
        "const t = `\n<<<<<<< HEAD\n`;", "x = {a, b() {}, get c() { return 1 }, async d() {}, ...e, 'f': 1, 2: 3,}", "do x++; while (x < 5)", "({a: 1}).a",
    ],
    "typescript": [
        "const s = `a ${rows.map((r) => {\n  if (r) { return f({ id: `x${r}` }); }\n}).join(',')} b`\nlet y = `${a.split(\"{\")}`",
        "interface A<T> extends B { readonly x?: T[]; [k: string]: any; f(a: number): void }", "type T = { [K in keyof A]?: A[K] } | ((x: number) => string)",
        "function f<T extends B = C>(this: D, a?: number, ...r: string[]): asserts a is string { return }", "enum E { A = 1, B }", "const x = y as unknown as Map<string, Array<number>>;",
        "abstract class A implements B, C { private constructor(readonly x: number) { super() } abstract f(): void; declare y: string }", "declare module 'm' { export const a: number }",
        "export type { A } from './a'; import type B from 'b'; const f = <T,>(x: T): T => x", "let a: [x: number, y?: string] = b!; let c = <any>d;", "const s = a satisfies B", "x = a < b && c > d",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `tag`\n\t*E\n}\n",
        "package a\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn 1, nil\n\t} else if !ok {\n\t}\n\tfor i := range xs {\n\t\tgo f(i)\n\t}\n\tswitch y := x.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t}\n\treturn\n}\n",
        "package a\nvar x = map[string][]T{\"a\": {{1, 2}}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\nvar f = func(a int) { defer g() }\n", "package a\nfunc f() { for { break }; x.y = &T{a: 1}; s[1:2:3] = z; a <<= 1 }\n",
    ],
    "c": [
        "", "#include <a.h>\n#define X(a) \\\n  (a)\nint main(void) { return 0; }", "struct a { int b : 3; const char *c[4]; union { int d; } e; };", "static const int t[] = { 1, [3] = 2, };",
        "typedef int (*fn)(int, char *); enum e { A = 1, B, };", "int f(a, b) int a; char b; { for (int i = 0; i < 3; i++) { if (a) continue; else break; } do { a--; } while (a); return sizeof(int) * (long)a; }",
        "size_t n = sizeof *p, *q; extern int g(const char *s, ...);", "int f(void) { switch (x) { case 1: return 1; default: break; } goto out; out: return a ? b : c; }", "/*\n=======\n*/\nlong x = 1L;",
        "uint8_t *f(struct s *p) { p->a[1] = (uint8_t)(b & 3); return &p->a[0]; }",
    ],
}
BAD = {
    "python": ["def f(:\n", "x = [\n1,\ndef f(): pass\n]\n", "x = 1\nelse:\n    y\n", "@a\nx = 1\n", "x = (\n1]\n", "x = 'a\nb = 1\n", "x = [\n1\n2\n]\n", "if x:\ny = 1\n", "x = (1\n", "  x = 1\n", "<<<<<<< HEAD\nx = 1\n", "s = '''abc\n", "function f() { return 1 }\n"],
    "javascript": ["function f( {", "const x = ;", "}\n", "a b c", "<<<<<<< HEAD\na()", "a()\n=======\nb()", "def f(x):\n    return x", "const s = 'abc", "/* open", "interface A { x: string }", "const f = (a: string): void => {}", "{\"a\": 1, \"b\": 2}", "if (x) else y", "* text of a comment\n */\nf()"],
    "typescript": ["const x: = 1", "interface { }", "class A { f( }", "package main\n", "a()\n>>>>>>> theirs\n"],
    "go": ["", "// nothing", "func f() {}", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\n=======\nvar x = 1\n", "package a\nfunc f() { if x { } else y() }\n"],
    "c": ["int f( {", "}", "* comment tail\n */\nint x;", "int x = ;", "import os\ndef f():\n    pass", "#ifdef A\nint x;\n", "int f(void) {\n=======\n return 1; }", "The text of a page says so.\nint x;"],
}


@pytest.mark.parametrize("language", list(GOOD))
def test_good_and_bad(language):
    assert [s for s in GOOD[language] if not validity.parses(language, s)] == []
    assert [s for s in BAD[language] if validity.parses(language, s)] == []


def test_python_chunks_compose_in_any_grouping():
    rng = random.Random(7)
    pieces = ["x = 1", "x = [", "1,", "]", "(", ")", "def f():", "    pass", "@a", "else:", "if x:", "'a \\", "b'", '"""', "class A: pass", "# c", "", "f(1)", "for x in y"]
    for _ in range(400):
        rows = [rng.choice(pieces) + "\n" for _ in range(rng.randint(2, 9))]
        parts = [lexers.summarise("python", x, first=k == 0) for k, x in enumerate(rows)]
        left = parts[0]
        for p in parts[1:]:
            left = lexers.compose(left, p)
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = lexers.compose(p, right)
        want = lexers.python_tree("".join(rows)) is not None
        assert validity.accepts_code("python", left) == validity.accepts_code("python", right) == want
        assert validity.parses("python", "".join(rows)) == want


@pytest.mark.parametrize("language", ["javascript", "go", "c"])
def test_summaries_compose_in_any_grouping(language):
    rng = random.Random(5)
    pieces = {"javascript": ["/* a", "b */ {", "`x", "y`;", "}", "f(", ")", "// c", "`a ${", "} b ${ {", "}`", "'s \\", "t'", "{"], "go": ["/* a", "b */ {", "`x", "y`", "}", "f(", ")"], "c": ["/* a", "b */ {", "}", "f(", ")", "'s \\", "t'"]}[language]
    for _ in range(200):
        lines = [rng.choice(pieces) + "\n" for _ in range(rng.randint(2, 8))]
        whole = lexers.summarise(language, "".join(lines), first=True).by_state["N"]
        parts = [lexers.summarise(language, x, first=k == 0) for k, x in enumerate(lines)]
        left = parts[0]
        for p in parts[1:]:
            left = lexers.compose(left, p)
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = lexers.compose(p, right)
        assert left == right
        assert left.by_state["N"] == whole or "@" in left.by_state["N"][0] + whole[0]  # an end without a beginning: an error at once
        assert validity.accepts_code(language, left) == validity.parses(language, "".join(lines))


def _files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, repo_id int, path string, language string, lines array<string>, indexed_at timestamp, name string")


def test_broken_files_edge_cases(spark):
    rows = [
        (1, 1, "a.py", "python", ["def f(:"], None, "x"), (2, 1, "b.js", None, ["{"], None, "x"), (3, 1, "c.md", "markdown", ["{"], None, "x"),
        (4, 1, "d.go", "go", [], None, "x"), (5, 1, "e.c", "c", None, None, "x"), (None, 1, "f.py", "python", ["("], None, "x"),
        (6, None, None, "python", ["x = 1", None, "y = 2\r"], None, "x"), (7, 1, "g.py", "PYTHON", [""], None, "x"), (1, 1, "a.py", "python", ["def f(:"], None, "x"),
        (8, 1, "h.js", "javascript", ["f(" + "1, " * 20000 + "2);"], None, "x"),
    ]
    f = _files(spark, rows)
    for chunk in (2, validity.CHUNK_LINES):
        assert sorted(r.file_id for r in validity.broken_files(f, chunk).collect()) == [1, 2, 4]
    assert validity.broken_files(f.limit(0)).count() == 0
    rate = {(r.repo_id, r.language): (r.files, r.broken) for r in validity.broken_rates(f).collect()}
    assert rate[1, "javascript"] == (2, 1) and rate[1, "python"] == (2, 1)


def test_latest_delivery_decides(spark):
    import datetime as dt

    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    ts = ["const x: number = 1;"]
    rows = [
        (1, 1, "a.ts", "javascript", ts, early, ""), (1, 1, "a.ts", "typescript", ts, late, ""),
        (2, 1, "b.js", "javascript", ["{"], early, ""), (2, 2, "b.js", "javascript", ["x()"], late, ""),
        (3, 1, "c.js", "javascript", ["x()"], early, ""), (3, 1, "c.js", "javascript", ["{"], late, ""),
        (4, 1, "d.js", "javascript", ["{"], early, ""), (4, 1, "d.md", "markdown", ["{"], late, ""),
        (5, 1, "e.js", "javascript", ["{"], early, ""), (5, 1, "e.js", "javascript", None, late, ""),
    ]
    for chunk in (1, 7, validity.CHUNK_LINES):
        assert sorted(r.file_id for r in validity.broken_files(_files(spark, rows), chunk).collect()) == [3, 5]


def test_chunked_equals_whole(spark):
    rows = []
    for k, (language, texts) in enumerate([*GOOD.items(), *BAD.items()]):
        rows += [(100 * k + n, 1, "x", language, t.split("\n"), None, "") for n, t in enumerate(texts)]
    f = _files(spark, rows)
    whole = {r.file_id for r in validity.broken_files(f).collect()}
    for chunk in (1, 7):
        assert {r.file_id for r in validity.broken_files(f, chunk).collect()} == whole
    assert whole == {r[0] for r in rows if r[0] >= 500}


SOURCES = {
    "python": (
        'class A:\n    @cached\n    def fetch(self, a, *b):\n        """Reads the next block from disk."""\n    def two(self):\n        """TODO: write this doc."""\n'
        'def x():\n    y = 1\n    """Not a docstring at all here."""\nasync def load_page(u):\n    r"""Load page."""\n'
    ),
    "javascript": (
        "/**\n * Reads the next block from disk.\n * @param {string} a\n */\nexport const fetch = async (a, {b}) => {\n};\n\n/** Counts all open tickets here. */\n\nfunction far() {}\n"
        "class K {\n  /** Walks over every known node. */\n  static walk(a = 1) {\n  }\n}\n/** Holds the number of nodes. */\nconst n = 3;\n/* Plain comment above this function. */\nfunction plain() {}\nconst s = `\n/** Inside of a template string. */\nfunction no() {}\n`;\n"
    ),
    "typescript": "/** Maps names to their places. */\nfunction place(\n  a: string,\n  b?: Map<string, number>\n): { x: number } {\n  return { x: 1 };\n}\n",
    "go": "package a\n\n// Sum adds all the numbers up.\n//go:noinline\nfunc (t *T) Sum(a int, b int) int {\n\treturn a\n}\n\n//go:noinline\nfunc none() {}\n\n/*\nLoads every open page again.\n*/\nfunc load() {}\n",
    "c": "/* Reads one line from the file. */\nint read_line(const char *p, int n);\n\n/// Reads one line from the\n/// open file again.\nstatic int read_line(const char *p, int n)\n{\n    return 0;\n}\n// Plain line comment above this one.\nint other(void) { return 1; }\n",
}
WANT = {
    "python": [("fetch", 3)], "javascript": [("fetch", 5), ("walk", 13)], "typescript": [("place", 2)], "go": [("Sum", 5), ("load", 15)], "c": [("read_line", 6)],
}


@pytest.mark.parametrize("language", list(SOURCES))
def test_pairs(language):
    got = docpairs.pairs_of(language, SOURCES[language])
    assert [(f.name, f.line) for f, _ in got] == WANT[language]


def test_links_over_a_gap_need_tags_or_names():
    far = "/**\n * Counts how many rows are open now.\n * @param {number} limit\n */\n\nfunction count(limit) {}\n"
    other = far.replace("@param {number} limit", "@param {number} width")
    rival = "/** Says how rows are counted in here. */\nfunction one(a) {}\n/** Shows what two does with rows. */\n\nfunction two(b) {}\n"
    assert [(f.name, f.distance) for f, _ in docpairs.pairs_of("javascript", far)] == [("count", 2)]
    assert docpairs.pairs_of("javascript", other) == []
    assert [(f.name, f.distance) for f, _ in docpairs.pairs_of("javascript", rival)] == [("one", 1), ("two", 2)]


def test_pairs_have_arguments_and_code(spark):
    rows = [(k, 1, "x", lang, SOURCES[lang].split("\n"), None, "n") for k, lang in enumerate(SOURCES)] + [(99, 1, "b.py", "python", ["def f(:", '    """Says something useful about it."""'], None, "n"), (98, 1, "n.py", "python", None, None, "n")]
    f = _files(spark, rows)
    got = {(r.language, r.name): r for r in docpairs.code_doc_pairs(f).collect()}
    assert got["python", "fetch"].args == ["self", "a", "*b"] and got["c", "read_line"].args == ["p", "n"] and got["go", "Sum"].args == ["a", "b"]
    assert got["typescript", "place"].args == ["a", "b"] and got["typescript", "place"].code.endswith("}")
    assert got["javascript", "fetch"].description == "Reads the next block from disk."
    keys = {(r.file_id, r.name, r.lineno) for r in docpairs.documented_functions(f).collect()}
    assert keys == {(k, n, l) for k, lang in enumerate(SOURCES) for n, l in WANT[lang]}
    assert docpairs.documented_functions(f.limit(0)).count() == 0


def test_trivial_descriptions():
    assert not docpairs.informative("Fetches the user record.", "fetches_user_record")
    assert not docpairs.informative("See the parent class for details.", "run")
    assert not docpairs.informative("TODO: add a description here later", "run")
    assert not docpairs.informative("@param a the first one of all\n:param b: the second of all", "run")
    assert docpairs.informative("See how rows are merged here.", "run")
    assert docpairs.name_words("loadHTTPPage_v2") >= {"load", "http", "page", "v", "2"}


def test_assignment_is_the_heaviest():
    import itertools

    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = [[rng.choice([0, rng.random() * 5]) for _ in range(m)] for _ in range(n)]
        got = sum(w[r][c] for r, c in enumerate(docpairs.assignment(w)) if c >= 0)
        best = max(sum(w[r][c] for r, c in zip(rows, cols)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-9
