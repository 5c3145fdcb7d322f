"""Cases of JavaScript, TypeScript, Go and C trees."""

from proofline.cases import Case, lines

CASES = [
    Case("js-relative-gone", {"src/app.js": lines("import x from './gone.js';", "import y from './here';", "x(y);"), "src/here.js": lines("export default 1;")}, [("stale-import", "src/app.js", 1)]),
    Case("js-name-gone", {"src/use.js": lines("import { a } from './shared';", "import { slow } from './shared';", "a(slow);"), "src/shared.js": lines("export function a() {}")}, [("stale-import", "src/use.js", 2)]),
    Case("js-destructured-export", {"src/use.js": lines("import { glob } from './shared';", "import { fast } from './shared';", "import { slow } from './shared';"), "src/shared.js": lines("export const { glob, match: fast } = require('x');")}, [("stale-import", "src/use.js", 3)]),
    Case("js-star-reexport", {"src/index.js": lines("export * from './a';"), "src/a.js": lines("export const one = 1;"), "use.js": lines("import { one } from './src';", "import { two } from './src';")}, [("stale-import", "use.js", 2)]),
    Case("js-star-of-package", {"src/index.js": lines("export * from 'outside';", "export const one = 1;"), "use.js": lines("import { two } from './src';")}),
    Case("js-no-default", {"a.js": lines("export const z = 1;"), "b.js": lines("import z from './a';")}, [("stale-import", "b.js", 1)]),
    Case("js-commonjs", {"lib/app.js": lines("const { a, b } = require('./util');", "const u = require('./util');"), "lib/util.js": lines("module.exports = { a: 1, b };", "function b() {}")}),
    Case("js-bundler-query", {"src/main.js": lines("import url from './worker.js?url';", "import w from './worker.js?worker';", "", "import m from './missing-worker.js?worker';"), "src/worker.js": lines("self.x = 1;")}, [("stale-import", "src/main.js", 4)]),
    Case("js-alias-boundary", {"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"], "@app": ["src/index.js"]}}}', "src/index.js": lines("export const real = 1;"), "a.js": lines("import { x } from '@apple/core';", "import { real } from '@app';"), "b.js": lines("import { ghost } from '@app';")}, [("stale-import", "b.js", 1)]),
    Case("js-alias-gone", {"tsconfig.json": '{"compilerOptions": {/* c */ "paths": {"@lib/*": ["./src/*"]},}}', "src/a.ts": lines("export const a = 1;"), "use.ts": lines("import { a } from '@lib/a';", "import { b } from '@lib/b';")}, [("stale-import", "use.ts", 2)]),
    Case("js-ts-sibling", {"app.ts": lines("import { f } from './util.js';"), "util.ts": lines("export function f() {}")}),
    Case("js-asset-and-above-root", {"app.js": lines("import './style.css';", "import x from '../../outside';", "import y from './data.json';"), "data.json": "{}"}),
    Case("js-package-entry", {"pkg/package.json": '{"main": "lib/entry.js"}', "pkg/lib/entry.js": lines("export const a = 1;"), "use.js": lines("import { a } from './pkg';", "import { b } from './pkg';")}, [("stale-import", "use.js", 2)]),
    Case("js-package-entry-built", {"package.json": '{"name": "mine", "main": "dist/index.js"}', "test/a.test.js": lines("import { a } from '..';")}),
    Case("js-browser-field", {"pkg/package.json": '{"main": "index.js", "browser": {"./node.js": "./web.js", "./shim.js": "./web.js"}}', "pkg/index.js": lines("import a from './shim.js';", "import b from './lost.js';"), "pkg/web.js": lines("export default 1;")}, [("stale-import", "pkg/index.js", 2)]),
    Case("js-self-name", {"package.json": '{"name": "mine"}', "tsconfig.json": '{"compilerOptions": {"paths": {"mine": ["./src/index"]}}}', "src/index.d.ts": lines("export const a: number;"), "tests/a.ts": lines("import { a } from 'mine';")}),
    Case("js-fixture-data", {"src/app.js": lines("import x from './gone.js';"), "tests/fixtures/input.js": lines("import y from './never.js';")}, [("stale-import", "src/app.js", 1)]),
    Case("js-comment-import", {"a.js": lines("// import x from './gone.js'", "/* import y from './lost.js' */", "const s = 1;")}),
    Case("js-symbol-gone", {"js/r.js": lines("export function render() {}", "// calls `renderOldRoot()` first", "// calls `Array.from()` and `JSON.parse()`", "render();")}, [("stale-symbol-ref", "js/r.js", 2)]),
    Case("js-ticket-block", {"a.js": lines("// See https://example.org/issues/3", "// calls `goneForever()`", "const x = 1;")}),
    Case("go-symbol-gone", {"go.mod": "module m\n", "go/m.go": lines("package m", "", "// NewControl calls `newLostControl()`", "// and `fmt.Println()`", "func NewControl() {}")}, [("stale-symbol-ref", "go/m.go", 3)]),
    Case("go-path-gone", {"examples/server.go": lines("package main", "", "// see packages/app/errors.go", "// see packages/app/app.go", "func main() {}"), "packages/app/app.go": lines("package app")}, [("stale-file-ref", "examples/server.go", 3)]),
    Case("c-symbol-gone", {"src/io.c": lines("#include <stdio.h>", "", "/* calls `fopen()`, `memcpy()` and `pthread_create()`", " * and `row_clear()` */", "int read_row(void) { return 0; }")}, [("stale-symbol-ref", "src/io.c", 3)]),
    Case("c-known", {"src/io.c": lines("#include \"io.h\"", "/* uses `row_size()` of the header */", "int read_row(void) { return row_size(); }"), "src/io.h": lines("int row_size(void);")}),
    Case("contract-js-default", {"app.js": lines("// PORT_NO falls back to 8080", "const port = process.env.PORT_NO ?? 3000;", "// HOST_NAME defaults to 'here'", "const host = process.env.HOST_NAME || 'here';")}, [("stale-contract-ref", "app.js", 1)], ("stale-contract-ref",)),
    Case("ghost-js", {"a.js": lines("function lonely() {}", "function paired() {}", "paired();", "export function open() {}", "module.exports = { shared };", "function shared() {}")}, [("ghost-export", "a.js", 1)], ("ghost-export",)),
    Case("ghost-js-block-comment", {"h.js": lines("/* a */ export const page = 1;", "export /* b */ function show() {}")}, [], ("ghost-export",)),
    Case("ghost-generated", {"tests/samples/x/_expected/client/index.js": lines("function made() {}")}, [], ("ghost-export",)),
    Case("ghost-go-sibling", {"p/debug.go": lines("package p", "", "func printAll(x int) {}", "func alone(x int) {}"), "p/main.go": lines("package p", "", "func Run() { printAll(1) }")}, [("ghost-export", "p/debug.go", 4)], ("ghost-export",)),
    Case("ghost-go-build-variants", {"p/a.go": lines("//go:build linux", "", "package p", "", "func openAll() {}"), "p/b.go": lines("//go:build !linux", "", "package p", "", "func openAll() {}")}, [], ("ghost-export",)),
    Case("api-gone", {"openapi.json": '{"openapi": "3.0", "paths": {"/v1/users/{id}": {}, "/v1/rows": {}}}', "app.py": lines("import requests", "def go():", "    requests.get('https://h.example/v1/users/3?x=1')", "    requests.post('/v2/gone')", "    # requests.get('/v3/comment')", "    requests.get('/v1/rows/')")}, [("stale-api-ref", "app.py", 4)], ("stale-api-ref",)),
    Case("api-js", {"api/spec.json": '{"swagger": "2.0", "paths": {"/rows/:id": {}}}', "app.js": lines("fetch('/rows/7');", "fetch(`/rows/${id}`);", "fetch('/static/app.css');", "fetch('/lines/7');")}, [("stale-api-ref", "app.js", 4)], ("stale-api-ref",)),
    Case("api-no-routes", {"app.py": lines("import requests", "requests.get('/v2/gone')")}, [], ("stale-api-ref",)),
]
