"""The engine as a user meets it: configuration, baseline, changed mode, stored facts."""

import pytest

from proofline.config import Config
from proofline.engine import Engine, FactStore
from proofline.operators import post
from proofline.sources import trees

BASE = {"a.py": "# see line 3\nx = 1\n", "b.py": "from a import x\n", "web/tsconfig.base.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "web/tsconfig.json": '{"extends": "./tsconfig.base", "exclude": ["old/**"]}',
        "web/src/u.ts": "export const u = 1\n", "web/m.ts": "import { u } from '@/u'\n", "web/old/z.ts": "import { q } from './gone'\n"}


def test_engine(spark):
    head = BASE | {"b.py": "from a import x, y\n", "c.py": "# see line 9  proofline: ignore=fragile-anchor\n"}
    files = lambda t: trees.from_dict(spark, t)
    e = Engine(files(head), Config.of({"enable": ["fragile-anchor", "stale-import"]}))
    got = {(r.checker, r.path) for r in e.scan().collect()}
    assert got == {("fragile-anchor", "a.py"), ("stale-import", "b.py")}
    assert e.gate(e.scan()).first()["status"] == 1
    e.close()
    e = Engine(files(head), Config.of({"enable": ["fragile-anchor"]}))
    base = post.baseline_of(Engine(files(BASE), e.config).scan())
    assert {r.path for r in e.scan(baseline=base, show_baselined=True).filter("not baselined").collect()} == set()
    assert {r.path for r in e.changed(files(BASE)).collect()} == {"c.py"}
    assert sorted(r.path for r in e.grep(["x"]).collect()) == ["a.py", "b.py"]
    assert e.list().count() == len(head) and e.impact("x").count() == 2
    e.close()


def test_config(tmp_path):
    with pytest.raises(ValueError):
        Config.of({"nope": 1})
    with pytest.raises(ValueError):
        Config.of({"enable": ["no-rule"]})
    assert Config.of({"fail_on": "odd"}).fail_on == "lie"
    p = tmp_path / "c.toml"
    p.write_text('disable = ["fragile-anchor"]\nignore_dirs = ["x"]\n')
    c = Config.load(str(p))
    assert "fragile-anchor" not in c.rules and "x" in c.ignore_dirs
    p.write_text("not toml [")
    with pytest.raises(ValueError):
        Config.load(str(p))


def test_fact_store_extracts_only_changes(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    files = lambda t: trees.from_dict(spark, t)
    facts, n = store.refresh(files(BASE))
    assert n == len(BASE) and facts.count() == len(BASE)
    facts, n = store.refresh(files(BASE | {"a.py": "y = 2\n"}))
    assert n == 1 and facts.count() == len(BASE)
    facts, n = store.refresh(files({"a.py": "y = 2\n"}))
    assert n == 0 and [s.name for s in facts.first().symbols] == ["y"]
