"""Cases of documents: fences, calls in examples, commands."""

from proofline.cases import Case, lines

CASES = [
    Case("fence-open", {"README.md": lines("# A", "", "Text.", "", "```python", "x = 1")}, [("unclosed-fence", "README.md", 5)]),
    Case("fence-swallowed", {"README.md": lines("# A", "", "Text.", "", "```python", "x = 1", "```js", "y()", "```")}, [("unclosed-fence", "README.md", 7)]),
    Case("fence-bare-outer", {"README.md": lines("# A", "", "```", "x", "```python", "y = 1", "```")}, [("unclosed-fence", "README.md", 5)]),
    Case("fence-nested", {"README.md": lines("````md", "```python", "x = 1", "```", "````", "", "~~~text", "```js", "~~~")}),
    Case("fence-longer-close", {"README.md": lines("```python", "x = 1", "`````", "", "   ```js", "y()", "   ```")}),
    Case("fence-not-a-fence", {"README.md": lines("    ```", "``` a`b", "Text.", "``")}),
    Case("doc-call-gone", {"pkg/core.py": lines("def load_row():", "    return 1"), "README.md": lines("# A", "", "```python", "from pkg.core import load_row", "load_row()", "", "fetch_row(1)", "```")}, [("stale-doc-ref", "README.md", 7)], ("stale-doc-ref",)),
    Case("doc-calls-bound", {"README.md": lines("```python", "def helper(x):", "    return x", "rows = helper(1)", "```", "", "```python", "helper(2)", "made = [str(k) for k in range(3)]", "cls.build_it(1)", "```")}, [], ("stale-doc-ref",)),
    Case("doc-illustrative", {"README.md": lines("For example:", "", "```python", "call_of_yours(1)", "```", "", "```python", "some_call(...)", "```", "", "```python", "# some_call(1)", "x = 1  # then some_call(2)", "```")}, [], ("stale-doc-ref",)),
    Case("doc-other-language", {"README.md": lines("```text", "some_call(1)", "```", "", "```", "some_call(1)", "```", "", "Call `some_call(1)` in prose.")}, [], ("stale-doc-ref",)),
    Case("doc-go", {"README.md": lines("```go", "x := make([]int, 3)", "fmt.Println(len(x))", "y := append(x, 1)", "z := ponder(y)", "```")}, [("stale-doc-ref", "README.md", 5)], ("stale-doc-ref",)),
    Case("cli-flag-gone", {"pyproject.toml": lines("[project]", 'name = "tool"', "[project.scripts]", 'tool = "tool.cli:main"'), "tool/cli.py": lines("import argparse", "def main():", "    p = argparse.ArgumentParser()", '    p.add_argument("-o", "--output")', '    p.add_argument("--color")'), "README.md": lines("```console", "$ tool --output x", "$ tool --outptu x", "$ FOO=1 sudo tool --out x -- --bogus", "```", "", "Run `tool --colour` or `tool --no-color`.", "", "For example `tool --nothing`."), "CHANGES.md": lines("```console", "$ tool --old-one", "```")}, [("stale-cli-flag", "README.md", 3), ("stale-cli-flag", "README.md", 7)], ("stale-cli-flag",)),
    Case("cli-flag-quoted", {"pyproject.toml": lines("[project.scripts]", 'tool = "tool.cli:main"'), "tool/cli.py": lines("def main(p):", '    p.add_argument("--name")'), "README.md": lines("```sh", "tool --name 'a --b c' # --comment", 'tool --name "--quoted text" && other --foreign', "```")}, [], ("stale-cli-flag",)),
    Case("cli-flag-go", {"go.mod": "module m\n", "cmd/srv/main.go": lines("package main", "", 'import "flag"', "", "func main() {", '\tflag.String("addr", "", "")', "}"), "docs/usage.rst": lines("Usage", "=====", "", "::", "", "    $ srv --addr x", "    $ srv --listen y")}, [("stale-cli-flag", "docs/usage.rst", 7)], ("stale-cli-flag",)),
    Case("cli-flag-opaque", {"pyproject.toml": lines("[project.scripts]", 'app = "app.main:run"'), "app/main.py": lines("import typer", "def run():", "    pass"), "README.md": lines("```console", "$ app --anything", "```")}, [], ("stale-cli-flag",)),
    Case("cli-command-gone", {"README.md": lines("```console", "$ tally run --jobs 3", "$ tally run --bogus-flag", "$ tally frob", "$ tally report --format json --jobs 2", "$ tally --config x clean", "```", "", "The `tally of votes` is no command."), "docs/a.md": lines("Use `tally run --quiet` or `tally run --loud`.")}, [("stale-cli-ref", "README.md", 3), ("stale-cli-ref", "README.md", 4), ("stale-cli-ref", "README.md", 5), ("stale-cli-ref", "docs/a.md", 1)], ("stale-cli-ref",)),
    Case("cli-command-known", {"README.md": lines("```console", "$ tally clean", "$ tally run -- --anything", "$ other frob", "```")}, [], ("stale-cli-ref",)),
]
