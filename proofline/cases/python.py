"""Cases of Python trees: symbols in comments, imports, paths, anchors, numbers, patches."""

from proofline.cases import Case, lines

CASES = [
    Case("symbol-gone", {"mod.py": lines("def keep():", "    # calls `drop_everything()` first", "    return 1")}, [("stale-symbol-ref", "mod.py", 2)]),
    Case("symbol-known", {"mod.py": lines("def keep():", "    return 1", "", "# calls `keep()` twice", "x = keep()")}),
    Case("symbol-elsewhere", {"a.py": lines("# see `far_away()` for the rest", "x = 1"), "b.py": lines("def far_away():", "    return 1")}),
    Case("symbol-negated", {"a.py": lines("# We do not call `old_loader()` any more", "# never uses fetch_rows() again", "x = 1")}),
    Case("symbol-history", {"a.py": lines("# `parse_blob()` was what this used to be", "x = 1")}),
    Case("symbol-metasyntactic", {"a.py": lines("# calls `foo()` and `bar()`, then `baz()`", "x = 1")}),
    Case("symbol-ticket-silent", {"a.py": lines("# replaced by the work of #4821:", "# calls `gone_helper()`", "x = 1")}),
    Case("symbol-todo-ticket", {"a.py": lines("# TODO(#4821): switch over to `next_loader()`", "x = 1")}, [("stale-symbol-ref", "a.py", 1)]),
    Case("symbol-foreign-root", {"a.py": lines("# calls `numpy.linalg.solve_all()` inside", "# see `store.lost_row()` too", "x = 1"), "store.py": lines("def row():", "    return 1")}, [("stale-symbol-ref", "a.py", 2)]),
    Case("symbol-docstring", {"a.py": lines("def load(path):", '    """Reads a path.', "", "    Calls `open_all()` inside.", "    :param path: see `no_param()`", '    """', "    return path")}, [("stale-symbol-ref", "a.py", 2)]),
    Case("symbol-dunder-typo", {"a.py": lines("class A:", "    # set in `__inti__` and read in `__len__`", "    x = 1")}, [("stale-symbol-ref", "a.py", 2)]),
    Case("symbol-family", {"a.py": lines("def load_page():", "    return 1", "def drop_page():", "    return 2", "# all the `_page()` functions", "x = 1")}),
    Case("symbol-dead-code", {"a.py": lines("# x = old_call()", "# return `old_call()`", "y = 1")}),
    Case("symbol-in-package-like-output", {"build/__init__.py": "", "build/wheel.py": lines("# see `pack_wheel()` for the layout", "x = 1"), "out/skip.py": lines("# see `pack_wheel()` there", "y = 1")}, [("stale-symbol-ref", "build/wheel.py", 1)]),
    Case("symbol-unparsed-file", {"broken.py": lines("def half(:", "    pass", "class Odd:", "    pass"), "a.py": lines("# uses `half()` and `Odd()`", "x = 1")}),
    Case("import-name-gone", {"pkg/__init__.py": "", "pkg/core.py": lines("def get_row():", "    return 1"), "pkg/view.py": lines("import os", "from pkg.core import get_user", "from pkg.core import get_row")}, [("stale-import", "pkg/view.py", 2)]),
    Case("import-module-gone", {"pkg/__init__.py": "", "pkg/view.py": lines("from pkg.lost import x", "from .gone import y", "from . import view")}, [("stale-import", "pkg/view.py", 1), ("stale-import", "pkg/view.py", 2)]),
    Case("import-star", {"pkg/__init__.py": lines("from pkg.mod import *"), "pkg/mod.py": lines("def thing():", "    return 1"), "use.py": lines("from pkg import thing")}),
    Case("import-star-of-unknown", {"pkg/__init__.py": lines("from somewhere_else import *"), "use.py": lines("from pkg import anything")}),
    Case("import-module-getattr", {"pkg/__init__.py": lines("def __getattr__(name):", "    return name"), "use.py": lines("from pkg import anything")}),
    Case("import-lazy-names", {"pkg/__init__.py": lines("_LAZY = {'Widget': 'pkg.widgets', 'Gadget': 'pkg.widgets'}"), "pkg/widgets.py": lines("class Widget:", "    pass"), "use.py": lines("from pkg import Gadget", "from pkg import Gizmo")}, [("stale-import", "use.py", 2)]),
    Case("import-self-replaced", {"pkg/__init__.py": "", "pkg/lazy.py": lines("import sys", "class M:", "    pass", "sys.modules[__name__] = M()"), "pkg/plain.py": lines("A = 1"), "use.py": lines("from pkg.lazy import Whatever", "from pkg.plain import Ghost")}, [("stale-import", "use.py", 2)]),
    Case("import-registered-module", {"pkg/__init__.py": "", "pkg/bundle.py": lines("import sys", "for name in ('json', 'csv'):", "    sys.modules['pkg.bundle.' + name] = __import__(name)"), "pkg/util.py": lines("A = 1"), "tests/test_it.py": lines("from pkg.bundle.json import loads", "from pkg.helpers.text import fold")}, [("stale-import", "tests/test_it.py", 2)]),
    Case("import-namespace-package", {"pkg/sub/mod.py": lines("A = 1"), "use.py": lines("from pkg.sub.mod import A", "from pkg.sub import mod", "from pkg import sub")}),
    Case("import-guarded", {"pkg/__init__.py": "", "use.py": lines("try:", "    from pkg.speedups import fast", "except ImportError:", "    fast = None")}),
    Case("import-stub-only", {"pkg/__init__.py": "", "pkg/_core.pyi": lines("def f() -> int: ..."), "use.py": lines("from pkg._core import f", "from pkg._cora import f")}, [("stale-import", "use.py", 2)]),
    Case("import-unparsed-target", {"pkg/__init__.py": "", "pkg/base.py": lines("def half(:", "    pass"), "use.py": lines("from pkg.base import anything")}),
    Case("import-src-layout", {"src/pkg/core.py": lines("def here():", "    return 1"), "src/pkg/view.py": lines("from pkg.core import gone_thing", "from pkg.core import here")}, [("stale-import", "src/pkg/view.py", 1)]),
    Case("import-template-tree", {"examples/templates/new.py": lines("from pkg.NAME import x", "from .lost import y"), "pkg/__init__.py": "", "pkg/sub/__init__.py": "", "pkg/sub/mod.py": lines("from ..gone import x")}, [("stale-import", "pkg/sub/mod.py", 1)]),
    Case("import-of-outside-name", {"app/__init__.py": "", "app/core.py": lines("A = 1"), "app/use.py": lines("from app.gone import x", "from django.db import models")}, [("stale-import", "app/use.py", 1)]),
    Case("path-gone", {"pkg/new_place.py": lines("A = 1"), "pkg/notes.py": lines("# moved out of pkg/old_place.py last year", "# next to pkg/new_place.py", "B = 1")}, [("stale-file-ref", "pkg/notes.py", 1)]),
    Case("path-illustrative", {"a.py": lines("# for example pkg/thing.py or path/to/file.py", "# the other project's pkg/inner.py", "x = 1"), "pkg/exists.py": lines("A = 1")}),
    Case("path-near", {"pkg/deep/mod.py": lines("# see data/table.json beside it", "# see pkg/deep/lost.json there", "x = 1"), "pkg/deep/data/table.json": "{}"}, [("stale-file-ref", "pkg/deep/mod.py", 2)]),
    Case("path-ignored", {".gitignore": lines("pkg/cache/", "*.gen.py"), "pkg/a.py": lines("# written to pkg/cache/rows.json and pkg/rows.gen.py", "# and pkg/rows.py", "x = 1")}, [("stale-file-ref", "pkg/a.py", 2)]),
    Case("path-placeholder", {"src/app/layout.py": lines("# as in src/app/foo.py and src/app/xxx.py", "# as in src/app/loader.py", "x = 1"), "src/app/real.py": lines("A = 1")}, [("stale-file-ref", "src/app/layout.py", 2)]),
    Case("anchor-lines", {"mod.py": lines("x = 1", "# as lines 42-45 say", "# see above", "y = 1")}, [("fragile-anchor", "mod.py", 2), ("fragile-anchor", "mod.py", 3)]),
    Case("anchor-workaround", {"mod.py": lines("# HACK until the parser is fixed", "x = 1", "y = 2", "z = 3", "# HACK until GH-12 is closed", "a = 1", "b = 2", "c = 3", "# temporarily disable the check", "d = 4")}, [("fragile-anchor", "mod.py", 1), ("fragile-anchor", "mod.py", 9)]),
    Case("number-drifts", {"mod.py": lines("# timeout is 5000 ms", "TIMEOUT = 3000")}, [("number-drift", "mod.py", 1)]),
    Case("number-agrees", {"mod.py": lines("# timeout is 3000 ms", "TIMEOUT = 3000", "OTHER_TIMEOUT = 10")}),
    Case("number-far-or-illustrative", {"mod.py": lines("# for example a port of 8080", "PORT = 9090", *["x = 1"] * 20, "# limit 5", "y = 1")}),
    Case("number-binding-in-test", {"test_back.py": lines("def test_it():", "    # at most max connections 5", "    assert pool.max_connections == 7")}, [("number-drift", "test_back.py", 2)]),
    Case("number-years", {"mod.py": lines("# limit 2019", "LIMIT = 2024")}),
    Case("mock-gone", {"app/__init__.py": "", "app/billing.py": lines("def charge():", "    return 1"), "tests/test_billing.py": lines("from unittest.mock import patch", "", "@patch('app.billing.charge_card')", "def test_a(m):", "    pass", "@patch('app.billing.charge')", "def test_b(m):", "    pass")}, [("stale-mock-ref", "tests/test_billing.py", 3)], ("stale-mock-ref",)),
    Case("mock-created-or-foreign", {"app/__init__.py": "", "app/billing.py": lines("import os", "def charge():", "    return 1"), "tests/test_x.py": lines("from unittest.mock import patch", "@patch('app.billing.extra', create=True)", "@patch('requests.get_all')", "@patch('app.billing.os')", "# @patch('app.billing.ghost')", "def test_a(a, b, c):", "    pass")}, [], ("stale-mock-ref",)),
    Case("contract-replacement", {"pkg/core.py": lines("def fetch_v1():", "    return 1"), "pkg/notes.py": lines("# Deprecated: use fetch_v2() instead", "# Deprecated: use fetch_v1() instead", "x = 1")}, [("stale-contract-ref", "pkg/notes.py", 1)], ("stale-contract-ref",)),
    Case("contract-lock-and-default", {"pkg/core.py": lines("import os", "# PORT_NO defaults to 9090", 'PORT = os.getenv("PORT_NO", "8080")', "# callers must hold _rows_lock", "def read():", "    return 1")}, [("stale-contract-ref", "pkg/core.py", 2), ("stale-contract-ref", "pkg/core.py", 4)], ("stale-contract-ref",)),
    Case("contract-kept", {"pkg/core.py": lines("import os, threading", "# PORT_NO defaults to 8080", 'PORT = os.getenv("PORT_NO", "8080")', "_rows_lock = threading.Lock()", "# callers must hold _rows_lock", "def read():", "    return _rows_lock")}, [], ("stale-contract-ref",)),
    Case("ghost-unused", {"a.py": lines("def check_old_token(t):", "    return t", "def used_here():", "    return 1", "x = used_here()")}, [("ghost-export", "a.py", 1)], ("ghost-export",)),
    Case("ghost-imported", {"a.py": lines("def check_token(t):", "    return t"), "b.py": lines("from a import check_token", "x = check_token(1)")}, [], ("ghost-export",)),
    Case("ghost-attribute-use", {"pkg/helper.py": lines("def shape(x):", "    return x"), "main.py": lines("from pkg import helper", "x = helper.shape(1)")}, [], ("ghost-export",)),
    Case("ghost-surface", {"pkg/__init__.py": lines("def public():", "    return 1"), "pkg/core.py": lines("__all__ = ['listed']", "def listed():", "    return 1"), "tests/test_a.py": lines("def test_all():", "    pass")}, [], ("ghost-export",)),
    Case("clean", {"a.py": lines("def load(path):", '    """Reads a path."""', "    return open(path).read()")}),
]
