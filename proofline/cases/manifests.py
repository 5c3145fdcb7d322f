"""Cases of manifests: entry points and packages."""

from proofline.cases import Case, lines

CASES = [
    Case("entry-gone", {"pyproject.toml": lines("[project]", 'name = "p"', "[project.scripts]", 'good = "pkg.cli:main"', 'bad = "pkg.gone:main"', 'worse = "pkg.cli:absent"'), "pkg/__init__.py": "", "pkg/cli.py": lines("def main():", "    pass"), "js/package.json": '{"bin": {"x": "missing.js", "y": "cli.js"}}', "js/cli.js": lines("run();")}, [("stale-entrypoint", "pyproject.toml", 5), ("stale-entrypoint", "pyproject.toml", 6), ("stale-entrypoint", "js/package.json", 1)], ("stale-entrypoint",)),
    Case("entry-foreign-or-built", {"pyproject.toml": lines("[project.scripts]", 'ext = "other_package.cli:main"'), "package.json": '{"main": "dist/index.js"}', "a.py": "x = 1\n"}, [], ("stale-entrypoint",)),
    Case("package-undeclared", {"pyproject.toml": lines("[project]", 'dependencies = ["requests>=2"]'), "pkg/__init__.py": "", "pkg/a.py": lines("import requests, os", "import yaml", "import yaml.nodes", "from pkg import b"), "pkg/b.py": "x = 1\n"}, [("phantom-package", "pkg/a.py", 2)], ("phantom-package",)),
    Case("package-by-other-name", {"requirements.txt": lines("-r more/base.txt", "PyYAML==6"), "more/base.txt": lines("Pillow"), "a.py": lines("import yaml", "from PIL import Image")}, [], ("phantom-package",)),
    Case("package-guarded", {"requirements.txt": lines("requests"), "a.py": lines("try:", "    import ujson", "except ImportError:", "    ujson = None")}, [], ("phantom-package",)),
    Case("package-without-manifest", {"a.py": lines("import anything_at_all")}, [], ("phantom-package",)),
    Case("package-js", {"package.json": '{"name": "web", "dependencies": {"left": "1"}, "devDependencies": {"@types/estree": "1"}}', "src/a.js": lines("import l from 'left/deep';", "import r from 'right-pad';", "import fs from 'node:fs';", "import p from 'path';", "import t from 'estree';", "import w from 'web/x';", "import s from '@scope/name/deep';")}, [("phantom-package", "src/a.js", 2), ("phantom-package", "src/a.js", 7)], ("phantom-package",)),
    Case("package-group", {"pyproject.toml": lines("[project]", 'dependencies = []', "[dependency-groups]", 'base = ["requests"]', 'dev = [{include-group = "base"}, "attrs"]'), "a.py": lines("import requests", "import attr", "import bs4")}, [("phantom-package", "a.py", 3)], ("phantom-package",)),
    Case("package-invented", {"requirements.txt": lines("reqeusts-toolkit"), "a.py": lines("import requests", "import reqeusts_toolkit", "import fresh_thing", "import not_in_snapshot"), "b.js": lines("import c from 'colour-of-nothing';", "import l from 'left-pad';")}, [("slop-package", "a.py", 2), ("slop-package", "a.py", 3), ("slop-package", "b.js", 1)], ("slop-package",)),
]
