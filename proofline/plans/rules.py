"""The sixteen rules as plans over the fact base: claims, minus what the facts account for.

Every rule maps a ``FactBase`` (and optional tables) to findings with a ``repo`` column. Silence rules are further
anti-joins or predicates; whatever is opaque (a file that does not parse, a namespace filled at run time, a
missing manifest) keeps a claim from being judged.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.functions import extract
from proofline.functions import words as W
from proofline.operators import algebra as A
from proofline.operators import post
from proofline.operators.facts import FIXTURE, FactBase
from proofline.sources.trees import gitignored, inherited_aliases

COLUMNS = ["repo", *post.FINDING_SCHEMA.names]


def finding(
    df: DataFrame, checker: str, severity: str, title: Column, claim: Column, evidence: Column, fix: str, confidence: Column | float,
    line: str = "line", end_line: str | None = None,
) -> DataFrame:
    """Rows of a rule in the shape of findings."""
    return df.select(
        "repo", "path", F.col(line).cast("int").alias("line"), F.col(end_line or line).cast("int").alias("end_line"),
        F.lit(checker).alias("checker"), F.lit(severity).alias("severity"), title.alias("title"), claim.alias("claim"),
        evidence.alias("evidence"), F.lit(fix).alias("fix"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"),
    )


def _s(template: str, *cols: str) -> Column:
    return F.format_string(template, *[F.col(c) for c in cols])


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _anti(df: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Claims without a fact. Facts may repeat: an anti-join asks for one, and a shuffle to drop copies would cost more."""
    return df.join(facts.select(*on), on, "left_anti")


# Symbols


def stale_symbol_ref(fb: FactBase) -> DataFrame:
    """Backticked or verb-led calls in comments that name nothing the repository defines."""
    claims = fb.relation("symbol_claims", claims=True)
    names = fb.symbols
    left = _anti(claims, names.withColumnRenamed("name", "base"), ["repo", "base"])
    left = _anti(left, names.withColumnRenamed("name", "name"), ["repo", "name"])
    # fragments of a family: `_suffix()` where some symbol ends with it
    tails = names.select(
        "repo", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("name", "_")) - 1)), lambda k: F.concat(F.lit("_"), F.array_join(F.slice(F.split("name", "_"), k + 1, F.lit(64)), "_")))).alias("base")
    ).filter(F.length("base") >= 4)
    fragments = left.filter(F.col("base").startswith("_") & (F.length("base") >= 4) & ~F.col("base").startswith("__"))
    family = fragments.join(tails.distinct(), ["repo", "base"], "left_semi").select("repo", "path", "line", "name").distinct()
    left = _anti(left, family, ["repo", "path", "line", "name"])
    # a dotted claim with a lower case root that the repository does not own speaks of another library
    stems = fb.paths.select("repo", F.explode(F.split("path", "/")).alias("p")).select("repo", F.regexp_replace("p", r"\.\w+$", "").alias("root"))
    owned = stems.unionByName(names.withColumnRenamed("name", "root")).unionByName(fb.tops.withColumnRenamed("top", "root")).distinct()
    dotted = left.filter(F.col("name").contains(".") & F.col("root").rlike("^[a-z]"))
    plain = left.filter(~(F.col("name").contains(".") & F.col("root").rlike("^[a-z]")))
    left = plain.unionByName(dotted.join(owned, ["repo", "root"], "left_semi").select(plain.columns))
    display = F.when(F.col("ticked"), F.concat(F.lit("`"), F.col("name"), F.lit("`"))).otherwise(F.concat("name", F.lit("()")))
    return finding(
        left, "stale-symbol-ref", "lie", F.concat(F.lit("Comment names "), display, F.lit(", which nothing here defines")), F.col("claim"),
        _s("`%s` is not defined, imported or used in this file, and no indexed file defines `%s`", "root", "base"),
        "Name the current symbol, or drop the reference.",
        F.when(~F.col("ticked"), 0.8).when(F.col("claim").contains("()"), 0.9).otherwise(0.85), end_line="end_line",
    )


def stale_file_ref(fb: FactBase) -> DataFrame:
    """Paths in comments that look like ours and do not exist."""
    claims = fb.relation("file_claims", claims=True).withColumn("top", F.split("ref", "/")[0])
    scoped = claims.join(fb.tops, ["repo", "top"], "left_semi")
    known_suffixes = fb.paths.select("repo", F.explode(A.suffixes(F.col("path"))).alias("ref")).distinct()
    left = _anti(scoped, known_suffixes, ["repo", "ref"])
    # relative to the commenting file or to one of its ancestors
    near = left.withColumn("up", F.explode(F.concat(A.prefixes(F.col("path")), F.array(F.lit("")))))
    near = near.withColumn("full", F.when(F.col("up") == "", F.col("ref")).otherwise(F.concat_ws("/", "up", "ref")))
    found = near.join(fb.paths.withColumnRenamed("path", "full"), ["repo", "full"], "left_semi").select("repo", "path", "line", "ref").distinct()
    left = _anti(left, found, ["repo", "path", "line", "ref"])
    # a path through a file names alternatives
    through = left.withColumn("full", F.explode(A.prefixes(F.col("ref")))).join(
        fb.paths.withColumnRenamed("path", "full"), ["repo", "full"], "left_semi"
    ).select("repo", "ref").distinct()
    left = _anti(left, through, ["repo", "ref"])

    left = _anti(left, gitignored(left.select("repo", F.col("ref").alias("path")), fb.manifests).withColumnRenamed("path", "ref"), ["repo", "ref"])
    same = fb.paths.select("repo", F.element_at(F.split("path", "/"), -1).alias("base"), F.col("path").alias("other"))
    same = same.groupBy("repo", "base").agg(F.array_sort(F.collect_set("other")).alias("others"))
    left = left.withColumn("base", F.element_at(F.split("ref", "/"), -1)).join(same, ["repo", "base"], "left")
    hint = F.when(F.col("others").isNull(), "").otherwise(
        F.concat(F.lit("; files of that name: "), F.array_join(F.slice("others", 1, 3), ", "),
                 F.when(F.size("others") > 3, F.format_string(" (+%d more)", F.size("others") - 3)).otherwise(""))
    )
    return finding(
        left, "stale-file-ref", "lie", _s("%s names the missing file `%s`", "kind", "ref"), F.col("ref"),
        F.concat(_s("`%s` begins like a path of this tree, but no such file exists", "ref"), hint),
        "Correct the path or remove the reference.", 0.85, end_line="end_line",
    )


# Imports


def _python_modules(fb: FactBase) -> DataFrame:
    return fb.kept("python_modules", lambda: _build_python_modules(fb))


def _build_python_modules(fb: FactBase) -> DataFrame:
    """(repo, target, module): import paths that the tree itself provides, from its root and from src/ or lib/."""
    py = fb.paths.filter(F.col("path").endswith(".py"))
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "")
    base = py.select("repo", F.col("path").alias("target"), F.regexp_replace(stem, "/", ".").alias("module")).filter("module <> ''")
    root_tops = base.select("repo", F.split("module", r"\.")[0].alias("top")).distinct()
    moved = base.filter(F.col("target").rlike("^(src|lib)/")).select("repo", "target", F.regexp_replace("module", r"^(src|lib)\.", "").alias("module"))
    moved = _anti(moved.withColumn("top", F.split("module", r"\.")[0]), root_tops, ["repo", "top"]).drop("top")
    return base.unionByName(moved).distinct()


def _resolved_imports(fb: FactBase) -> DataFrame:
    return fb.kept("resolved_imports", lambda: _build_resolved_imports(fb))


def _build_resolved_imports(fb: FactBase) -> DataFrame:
    """Python from-imports with ``full``, the absolute module they mean."""
    imp = fb.relation("imports").filter("kind = 'py' and name is not null")
    parts = F.split("path", "/")
    package = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - F.col("level"))), ".")
    full = F.when(F.col("level") == 0, F.col("module")).otherwise(F.concat_ws(".", F.nullif(package, F.lit("")), F.nullif("module", F.lit(""))))
    above = (F.col("level") > 0) & (F.col("level") > F.size(parts))
    return imp.withColumn("full", full).filter(~above & (F.col("full") != ""))


def provided_names(fb: FactBase, modules: DataFrame) -> DataFrame:
    return fb.kept("provided_names", lambda: _build_provided_names(fb, modules))


def _build_provided_names(fb: FactBase, modules: DataFrame) -> DataFrame:
    """(repo, target, name): names a module provides, its star imports followed two steps."""
    own = fb.relation("symbols").filter("language = 'python'").select("repo", F.col("path").alias("target"), "name")
    imported = fb.relation("imports").filter("kind = 'py'").select("repo", F.col("path").alias("target"), F.col("alias").alias("name"))
    names = own.unionByName(imported).distinct()
    stars = _resolved_imports(fb).filter("name = '*'").select("repo", F.col("path").alias("src"), F.col("full").alias("module"))
    stars = stars.join(modules.withColumnRenamed("target", "dst"), ["repo", "module"]).select("repo", "src", "dst").distinct()
    out, step = names, stars
    for _ in range(2):
        out = out.unionByName(
            step.join(names.withColumnRenamed("target", "dst"), ["repo", "dst"]).select("repo", F.col("src").alias("target"), "name")
        )
        step = step.join(stars.select("repo", F.col("src").alias("dst"), F.col("dst").alias("next")), ["repo", "dst"]).select(
            "repo", "src", F.col("next").alias("dst")
        ).distinct()
    return out.distinct()


def _quoted(fb: FactBase) -> DataFrame:
    """(repo, target, name): names that stand in a string of a module, which may provide them when asked."""
    return fb.kept("quoted", lambda: fb.relation("quoted").select("repo", F.col("path").alias("target"), "name"))


def _opaque(fb: FactBase) -> DataFrame:
    return fb.kept("opaque", lambda: fb.facts.filter("parse_failed or dynamic").select("repo", F.col("path").alias("target")))


def _python_packages(fb: FactBase) -> DataFrame:
    """(repo, full): modules and the packages above them."""
    modules = _python_modules(fb)
    return fb.kept("python_packages", lambda: modules.select(
        "repo", F.explode(F.concat(A.prefixes(F.col("module"), "."), F.array("module"))).alias("full")
    ).distinct())


def stale_import_python(fb: FactBase) -> DataFrame:
    """``from M import N`` where M is ours and missing, or lacks N."""
    modules = _python_modules(fb)
    imp = _resolved_imports(fb).filter(~F.col("path").rlike(FIXTURE) & ~F.col("guarded"))
    packages = _python_packages(fb)
    tops = packages.select("repo", F.split("full", r"\.")[0].alias("top")).distinct()
    ours = imp.withColumn("top", F.split("full", r"\.")[0])
    ours = ours.filter("level > 0").unionByName(ours.filter("level = 0").join(tops, ["repo", "top"], "left_semi").select(ours.columns))
    # opaque ancestors may register modules at run time
    opaque_modules = modules.join(_opaque(fb), ["repo", "target"], "left_semi").select("repo", F.col("module").alias("full"))
    ours = ours.select("repo", "path", "lineno", "full", "module", "level", "name")
    missing = _anti(ours, packages, ["repo", "full"])
    climb = missing.withColumn("anc", F.explode(F.concat(A.prefixes(F.col("full"), "."), F.array("full"))))
    silent = climb.join(opaque_modules.withColumnRenamed("full", "anc"), ["repo", "anc"], "left_semi").select("repo", "path", "full").distinct()
    stubs = fb.paths.filter(F.col("path").endswith(".pyi")).select(
        "repo", F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.pyi$", ""), r"(^|/)__init__$", ""), "/", ".").alias("full")
    )
    missing = _anti(_anti(missing, silent, ["repo", "path", "full"]), stubs, ["repo", "full"])
    missing = missing.filter(~F.col("full").rlike(r"(^|\.)[A-Z][A-Z_]+(\.|$)"))
    no_module = A.first_per(
        missing.select("repo", "path", "lineno", "full", "module", "level"), ["repo", "path", "lineno"], ["full"]
    )
    f1 = finding(
        no_module, "stale-import", "lie", _s("Import of `%s`, but no such module exists", "full"), F.col("full"),
        _s("Neither `%s` as a file nor as a package is in the tree", "full"), "Correct the module path or remove the import.", 0.85, "lineno",
    )
    # names
    located = ours.filter("name <> '*' and not (name like '\\_\\_%\\_\\_')").join(modules.withColumnRenamed("module", "full"), ["repo", "full"])
    left = _anti(located, provided_names(fb, modules), ["repo", "target", "name"])
    left = _anti(left, _opaque(fb), ["repo", "target"])
    left = _anti(left, _quoted(fb), ["repo", "target", "name"])
    left = left.withColumn("sub", F.concat_ws(".", "full", "name"))
    left = _anti(left, packages.withColumnRenamed("full", "sub"), ["repo", "sub"])
    left = _anti(left, stubs.withColumnRenamed("full", "sub"), ["repo", "sub"])
    star_out = _resolved_imports(fb).filter("name = '*'").select("repo", F.col("path").alias("target"), "full").join(
        modules.withColumnRenamed("module", "full").withColumnRenamed("target", "dst"), ["repo", "full"], "left_anti"
    )  # a star import from outside may provide anything
    left = _anti(left, star_out, ["repo", "target"])
    left = A.first_per(left.select("repo", "path", "lineno", "full", "name", "target"), ["repo", "path", "lineno", "name"], ["target"])
    f2 = finding(
        left, "stale-import", "lie", _s("`%s` does not provide `%s`", "full", "name"), _s("from %s import %s", "full", "name"),
        _s("`%s` neither defines nor imports `%s`", "target", "name"), "Import the current name.", 0.85, "lineno",
    )
    return f1.unionByName(f2)


_JS_EXT = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", ".d.ts", ".json", ".vue", ".svelte"]
_JS_INDEX = [f"/index{e}" for e in _JS_EXT[1:10]]


def _normal(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; null where it climbs above the root."""
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when((s == ".") | (s == ""), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.get(acc, F.lit(0)) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(F.exists(folded, lambda s: s == ".."), F.lit(None)).otherwise(F.array_join(folded, "/"))


def _alias_matches(imports: DataFrame, spec: str, zones: DataFrame) -> DataFrame:
    """Imports with each alias (zone, prefix, repl, open) whose zone holds the file and whose prefix the specifier has.

    Every head of a specifier that ends at a sign, and every ancestor of the file, meets the aliases in an equality:
    work grows with the length of a specifier and not with the number of aliases. A head may also end anywhere if
    some alias of the repository ends within a word; such lengths are few and are listed first.
    """
    lengths = zones.filter("open").groupBy("repo").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    heads = F.array_distinct(F.transform(F.coalesce("_lengths", F.array().cast("array<int>")), lambda n: F.substring(F.col(spec), F.lit(1), n)))
    either = F.array_union(
        F.transform(heads, lambda h: F.struct(h.alias("prefix"), F.lit(True).alias("open"))),
        F.array(F.struct(F.col(spec).alias("prefix"), F.lit(False).alias("open"))),
    )
    tried = imports.join(lengths, "repo", "left").withColumn("_h", F.explode(either)).withColumn(
        "zone", F.explode(F.concat(A.prefixes(F.col("path")), F.array(F.lit(""))))
    )
    return tried.withColumn("prefix", F.col("_h.prefix")).withColumn("open", F.col("_h.open")).drop("_h", "_lengths").join(
        zones, ["repo", "zone", "prefix", "open"]
    )


def _js_targets(fb: FactBase) -> DataFrame:
    return fb.kept("js_targets", lambda: _build_js_targets(fb))


def _build_js_targets(fb: FactBase) -> DataFrame:
    """JavaScript imports with ``target``, the file they mean (null if none), and ``kind_of``: relative or alias."""
    imp = fb.relation("imports").filter("kind = 'js' and not guarded").withColumn("spec", F.regexp_replace("module", r"[?#].*$", ""))
    rel = imp.filter(F.col("spec").rlike(r"^\.\.?(/|$)")).select(
        "*", _normal(F.concat_ws("/", _dir(F.col("path")), F.col("spec"))).alias("base"), F.lit("relative").alias("kind_of")
    ).filter("base is not null")
    zones = inherited_aliases(fb.manifests).select(
        "repo", "zone", F.regexp_replace("name", r"\*$", "").alias("prefix"), F.regexp_replace("value", r"\*$", "").alias("repl"), F.col("name").endswith("*").alias("open")
    )
    bare = imp.filter(~F.col("spec").rlike(r"^\.\.?(/|$)|^/|^node:|^#"))
    alias = _alias_matches(bare, "spec", zones)
    longest = Window.partitionBy("repo", "path", "lineno", "spec").orderBy(F.length("zone").desc(), F.length("prefix").desc())
    alias = alias.withColumn("_r", F.dense_rank().over(longest)).filter("_r = 1").select(
        *imp.columns, _normal(F.concat_ws("/", F.nullif("zone", F.lit("")), F.concat("repl", F.expr("substring(spec, length(prefix) + 1)")))).alias("base"),
        F.lit("alias").alias("kind_of"),
    ).filter("base is not null")
    mains = fb.manifests.filter("fact = 'entry_js' and name = 'main'").select(
        "repo", F.col("dir").alias("base"), _normal(F.concat_ws("/", F.nullif("dir", F.lit("")), F.col("value"))).alias("entry")
    ).dropDuplicates(["repo", "base"])
    both = rel.unionByName(alias).join(mains, ["repo", "base"], "left")
    swapped = F.regexp_replace("base", r"\.(m|c)?jsx?$", "")
    stem_ts = F.when(F.col("base").rlike(r"\.(m|c)?jsx?$"), F.array(*[F.concat(swapped, F.lit(e)) for e in (".ts", ".tsx", ".mts", ".cts", ".d.ts")])).otherwise(F.array().cast("array<string>"))
    ends = [*_JS_EXT, *_JS_INDEX, "/package.json"]
    own = F.transform(
        F.concat(F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat("base", e)), stem_ts), lambda c: F.regexp_replace(c, "^/", "")
    )
    through = F.when(F.col("entry").isNotNull(), F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat("entry", e)))
    candidates = F.concat(F.coalesce(through, F.array().cast("array<string>")), own)
    tried = both.select("repo", "path", "lineno", "module", "kind_of", F.posexplode(candidates).alias("at", "target")).join(
        fb.paths.withColumnRenamed("path", "target"), ["repo", "target"], "left_semi"
    )
    hit = tried.groupBy("repo", "path", "lineno", "module", "kind_of").agg(F.min_by("target", "at").alias("target"))
    return both.join(hit, ["repo", "path", "lineno", "module", "kind_of"], "left")


def stale_import_js(fb: FactBase) -> DataFrame:
    """Relative or aliased specifiers without a file, and named imports that a complete export surface lacks."""
    imp = _js_targets(fb).filter(~F.col("path").rlike(FIXTURE))
    asset = F.col("spec").rlike(r"\.(?:css|scss|less|svg|png|jpe?g|gif|webp|woff2?|html|md|txt|wasm|graphql|ya?ml)$")
    hidden = F.col("base").rlike(r"(?:^|/)(?:" + "|".join(sorted(d.replace(".", r"\.") for d in W.IGNORED_DIRS)) + r")(?:/|$)")
    missing = imp.filter(F.col("target").isNull() & ~asset & ~hidden & F.col("entry").isNull())
    swapped_in = fb.manifests.filter("fact = 'browser'").select(
        "repo", F.regexp_replace(_normal(F.concat_ws("/", F.nullif("dir", F.lit("")), F.col("name"))), r"\.js$", "").alias("stem")
    )
    missing = _anti(missing.withColumn("stem", F.regexp_replace("base", r"\.js$", "")), swapped_in, ["repo", "stem"])
    excluded = fb.manifests.filter("fact = 'exclude' and name <> ''").select(
        "repo", F.concat_ws("/", F.nullif("dir", F.lit("")), F.col("name"), F.lit("")).alias("below")
    ).distinct()
    below = missing.withColumn("below", F.explode(A.prefixes(F.col("path")))).withColumn("below", F.concat("below", F.lit("/")))
    missing = _anti(missing, below.join(excluded, ["repo", "below"], "left_semi"), ["repo", "path"])
    missing = A.first_per(missing.select("repo", "path", "lineno", "module", "kind_of", "base"), ["repo", "path", "lineno", "module"], ["kind_of"])

    missing = _anti(missing, gitignored(missing.select("repo", F.col("base").alias("path")), fb.manifests).withColumnRenamed("path", "base"), ["repo", "base"])
    f1 = finding(
        missing, "stale-import", "lie", _s("Import of '%s' resolves to no file", "module"), F.col("module"),
        _s("Nothing at `%s`, with any known ending or index file", "base"), "Correct the path or remove the import.",
        F.when(F.col("kind_of") == "relative", 0.85).otherwise(0.6), "lineno",
    ).withColumn("severity", F.when(F.col("confidence") < 0.7, "drift").otherwise("lie"))
    # names: the export closure over stars, two steps, must be complete
    exports = fb.kept("exports", lambda: fb.relation("exports").select("repo", F.col("path").alias("target"), "name").distinct())
    star_imports = fb.relation("export_stars").select("repo", "path", F.col("name").alias("module")).distinct()
    resolved = imp.select("repo", "path", "module", "target").distinct()
    stars = fb.kept("js_stars", lambda: star_imports.join(resolved, ["repo", "path", "module"], "left").select(
        "repo", F.col("path").alias("src"), F.col("target").alias("dst")
    ))
    complete, step = exports, stars.filter("dst is not null")
    for _ in range(2):
        complete = complete.unionByName(step.join(exports.withColumnRenamed("target", "dst"), ["repo", "dst"]).select("repo", F.col("src").alias("target"), "name"))
        step = step.join(stars.filter("dst is not null").select("repo", F.col("src").alias("dst"), F.col("dst").alias("next")), ["repo", "dst"]).select("repo", "src", F.col("next").alias("dst")).distinct()
    unknown = stars.filter("dst is null").select("repo", F.col("src").alias("target")).unionByName(_opaque(fb)).unionByName(step.select("repo", F.col("src").alias("target")))
    unknown = unknown.unionByName(stars.join(unknown.withColumnRenamed("target", "dst"), ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("target"))).distinct()
    complete, unknown = fb.kept("js_surface", lambda: complete.distinct()), fb.kept("js_unknown", lambda: unknown)
    judged = imp.filter(
        "target is not null and name is not null and name <> '*' and name <> 'default'"
    ).filter(F.col("target").rlike(r"\.(?:[mc]?[jt]sx?)$") & ~F.col("target").endswith(".d.ts"))
    surface = complete.select("repo", "target").distinct()
    left = _anti(judged.join(surface, ["repo", "target"], "left_semi"), complete, ["repo", "target", "name"])
    left = A.first_per(_anti(left, unknown, ["repo", "target"]).select("repo", "path", "lineno", "name", "module", "target"), ["repo", "path", "lineno", "name"], ["target"])
    f2 = finding(
        left, "stale-import", "lie", _s("'%s' exports no `%s`", "module", "name"), F.col("name"),
        _s("`%s` does not export `%s`", "target", "name"), "Import the current name.", 0.8, "lineno",
    )
    esm = fb.facts.filter("esm and not dynamic").select("repo", F.col("path").alias("target"))
    no_default = imp.filter("name = 'default' and target is not null").join(esm, ["repo", "target"], "left_semi")
    no_default = _anti(_anti(no_default, complete.filter("name = 'default'").select("repo", "target"), ["repo", "target"]), unknown, ["repo", "target"])
    f3 = finding(
        A.first_per(no_default.select("repo", "path", "lineno", "module", "target"), ["repo", "path", "lineno"], ["target"]),
        "stale-import", "lie", _s("'%s' has no default export", "module"), F.col("module"), _s("`%s` exports names only", "target"),
        "Import a name, or add a default export.", 0.75, "lineno",
    )
    return f1.unionByName(f2).unionByName(f3)


def stale_import(fb: FactBase) -> DataFrame:
    return stale_import_python(fb).unionByName(stale_import_js(fb))


# Comments against nearby code

_KEYWORD = rf"(?:{'|'.join(W.SETTING_KINDS)})[ _-](?:{'|'.join(W.SETTINGS)})|{'|'.join(W.SETTINGS)}|(?:max|min)(?:imum)?"
#: A setting, perhaps a linking word, and its number with a unit.
_NUMBER = rf"(?i)(?<![A-Za-z0-9])({_KEYWORD})(?![A-Za-z])[\s\"'`]*(?:is|are|of|to|at|[=:]|->)?\s*(\d+(?:\.\d+)?)\s*({'|'.join(sorted(W.UNITS, key=len, reverse=True))})?(?![A-Za-z0-9])"
_BINDING = r"([A-Za-z_][A-Za-z0-9_]*)[\s\"']*(?:==|<=|>=|[=:<>])\s*\(?\s*(\d+(?:\.\d+)?)(?![A-Za-z0-9_.])"
_COMMENT_LINE = r"^\s*(?:#|//|\*|/\*)"
_ILLUSTRATIVE = "(?i)" + W.ILLUSTRATIVE.pattern
_TICKET = "(?i)" + W.TICKET.pattern
_LINE_ANCHOR = r"(?i)(?<![\w-])(?:on |at |in )?(lines? +#?\d+(?: ?(?:-|–|to|and) ?\d+)?)(?!\w)"
_POSITION = r"(?i)(?<!\w)((?:see|as|shown|described|defined) (?:above|below))(?!\w)"


def number_drift(fb: FactBase) -> DataFrame:
    """Numbers in comments that every binding of the same keyword within fifteen lines contradicts (band join)."""
    c = fb.relation("comments", claims=True).filter((F.length("text") <= 300) & ~F.col("text").rlike(_ILLUSTRATIVE))
    z = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(k)).alias(n) for k, n in ((1, "word"), (2, "value"), (3, "unit"))])
    claims = c.withColumn("m", F.explode(z)).select(
        "repo", "path", "line", "end_line", F.regexp_replace(F.split(F.lower(F.regexp_replace("m.word", "[- ]", "_")), "_")[0], "imum$", "").alias("stem"),
        F.col("m.value").alias("value"), F.lower("m.unit").alias("unit"),
    ).filter(F.length("stem") >= 3)
    code = fb.lines.filter(~F.col("line").rlike(_COMMENT_LINE)).withColumn("bare", F.regexp_replace("line", r"(['\"`]).*?\1", "$1$1"))
    b = F.arrays_zip(*[F.regexp_extract_all("bare", F.lit(_BINDING), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "number"))])
    bindings = code.withColumn("b", F.explode(b)).select(
        "repo", "path", F.col("lineno").alias("at"), F.trim("line").alias("code"), F.lower("b.name").alias("bound"), F.col("b.number").alias("number"),
    )
    near = A.band_join(claims, bindings, ["repo", "path"], "line", "at", 15, 15).filter(
        F.expr("instr(bound, stem) > 0 and not (at between line and end_line)")
    )
    claim, actual = F.col("value").cast("double"), F.col("number").cast("double")
    key = ["repo", "path", "line", "end_line", "stem", "value", "unit"]
    judged = near.groupBy(*key).agg(
        F.bool_or(claim == actual).alias("met"), F.min_by(F.struct("at", "number", "code"), F.struct("at", "number")).alias("first")
    ).filter("not met")
    n = F.col("first.number").cast("double")
    judged = judged.filter(
        ~((n > 1900) & (n < 2100) & (claim > 1900) & (claim < 2100)) & ~(n.isin(0.0, 1.0) & claim.isin(0.0, 1.0))
    )
    return finding(
        judged.withColumn("number", F.col("first.number")).withColumn("at", F.col("first.at")).withColumn("code", F.substring("first.code", 1, 120)),
        "number-drift", "drift", _s("Comment says %s %s%s, the code %s", "stem", "value", "unit", "number"), _s("%s = %s%s", "stem", "value", "unit"),
        _s("%s:%d: %s", "path", "at", "code"), "State the real value, or refer to a named constant.", 0.6, end_line="end_line",
    )


def fragile_anchor(fb: FactBase) -> DataFrame:
    """Comments that point by line number or position, or call themselves temporary without a ticket nearby."""
    c = fb.relation("comments", claims=True).filter("trim(text) <> ''")
    tickets = c.filter(F.col("text").rlike(_TICKET)).select("repo", "path", F.col("line").alias("t_line"))
    near = A.band_join(c.select("repo", "path", "line"), tickets, ["repo", "path"], "line", "t_line", 2, 2).select("repo", "path", "line").distinct().withColumn("ticketed", F.lit(True))
    c = c.join(near, ["repo", "path", "line"], "left").fillna(False, ["ticketed"])
    anchor = F.regexp_extract("text", _LINE_ANCHOR, 1)
    position = F.lower(F.regexp_extract("text", _POSITION, 1))
    hack = F.coalesce(
        F.nullif(F.regexp_extract("text", W.any_of(*W.MAKESHIFT_MARKS), 0), F.lit("")), F.regexp_extract("text", "(?i)" + W.any_of(*W.MAKESHIFT_WORDS), 0)
    )
    temporal = F.regexp_extract("text", "(?i)" + W.any_of(*W.TEMPORAL), 0)
    short = (F.length("text") < 160) & F.col("text").rlike("(?i)" + W.any_of(*W.COMPANIONS))
    case = (
        F.when(anchor != "", F.struct(F.lit("line").alias("k"), anchor.alias("claim"), F.lit(0.9).alias("conf")))
        .when(position != "", F.struct(F.lit("position").alias("k"), position.alias("claim"), F.lit(0.65).alias("conf")))
        .when((hack != "") & ~F.col("ticketed"), F.struct(F.lit("workaround").alias("k"), hack.alias("claim"), F.lit(0.7).alias("conf")))
        .when((temporal != "") & ~F.col("ticketed") & short, F.struct(F.lit("temporal").alias("k"), temporal.alias("claim"), F.lit(0.6).alias("conf")))
    )
    hit = c.withColumn("m", case).filter("m is not null").select("repo", "path", "line", "end_line", "m.*")
    title = (
        F.when(F.col("k") == "line", _s("Comment points to `%s`, which moves with every edit", "claim"))
        .when(F.col("k") == "position", F.lit("Comment points above or below without a name to look for"))
        .when(F.col("k") == "workaround", _s("Workaround (“%s”) without a ticket or link", "claim"))
        .otherwise(_s("Temporary (“%s”) without an end", "claim"))
    )
    return finding(
        hit, "fragile-anchor", "smell", title, F.col("claim"), F.lit("Positions and moods of a text do not survive its edits."),
        "Refer to a name, a ticket or a condition.", F.col("conf"), end_line="end_line",
    )


# Documents


def unclosed_fence(fb: FactBase) -> DataFrame:
    """Fences that never close, or swallow another block's opening."""
    f = fb.relation("fence_findings", claims=True)
    title = F.when(F.col("kind") == "open", F.lit("Code fence is never closed")).otherwise(
        F.format_string("Fence is swallowed by the block opened at line %d", F.col("opened"))
    )
    return finding(
        f, "unclosed-fence", "lie", title, F.format_string("fence at line %d", F.col("opened")), F.lit("What follows renders as code."),
        "Close the block, or use a longer fence around it.", F.when(F.col("kind") == "open", 0.95).otherwise(0.9), end_line="end_line",
    )


def stale_doc_ref(fb: FactBase) -> DataFrame:
    """Calls in documentation examples of names that nothing here defines."""
    calls = _anti(fb.relation("doc_calls", claims=True), fb.symbols.withColumnRenamed("name", "base"), ["repo", "base"])
    owned = fb.symbols.withColumnRenamed("name", "root").unionByName(fb.tops.withColumnRenamed("top", "root")).unionByName(
        fb.paths.select("repo", F.explode(F.split("path", "/")).alias("p")).select("repo", F.regexp_replace("p", r"\.\w+$", "").alias("root"))
    ).distinct()
    plain = calls.filter(~F.col("name").contains("."))
    dotted = calls.filter(F.col("name").contains(".")).join(owned, ["repo", "root"], "left_semi").select(plain.columns)
    declared = fb.manifests.filter("fact in ('py_dep', 'js_dep')").select("repo", F.col("name").alias("root"))
    left = _anti(plain.unionByName(dotted), declared, ["repo", "root"])
    return finding(
        A.first_per(left.select("repo", "path", "line", "name", "base"), ["repo", "path", "line", "name"], ["base"]),
        "stale-doc-ref", "lie", _s("Example calls `%s()`, which nothing here defines", "name"), _s("%s()", "name"),
        _s("No indexed file defines `%s`", "base"), "Update the example.", 0.75,
    )


def stale_mock_ref(fb: FactBase) -> DataFrame:
    """Patched targets whose module is ours and lacks the name."""
    modules = _python_modules(fb)
    claims = fb.relation("mock_claims", claims=True)
    matched = A.longest_match(
        claims, F.transform(A.prefixes(F.col("target"), "."), lambda p: F.concat_ws(":", F.col("repo"), p)),
        modules.select(F.concat_ws(":", "repo", "module").alias("m")), "m", ["repo", "path", "line", "target"],
    ).withColumn("module", F.expr("substring(matched, length(repo) + 2)"))
    located = matched.withColumnRenamed("target", "claim").join(modules, ["repo", "module"]).withColumn(
        "name", F.split(F.expr("substring(claim, length(module) + 2)"), r"\.")[0]
    )
    left = _anti(located, provided_names(fb, modules), ["repo", "target", "name"])
    left = _anti(left, _opaque(fb), ["repo", "target"]).withColumn("sub", F.concat_ws(".", "module", "name"))
    left = _anti(left, modules.select("repo", F.col("module").alias("sub")).unionByName(modules.select("repo", F.explode(A.prefixes(F.col("module"), ".")).alias("sub"))), ["repo", "sub"])
    left = left.filter(~F.col("name").isin(*sorted(W.PYTHON_RESERVED)))
    return finding(
        A.first_per(left.select("repo", "path", "line", "claim", "name", "target"), ["repo", "path", "line", "claim"], ["target"]),
        "stale-mock-ref", "lie", _s("Patched target `%s` does not exist", "claim"), F.col("claim"),
        _s("`%s` does not define `%s`", "target", "name"), "Patch the current name.", 0.8,
    )


def stale_entrypoint(fb: FactBase) -> DataFrame:
    """Entry points of manifests that lead to no file or function."""
    modules = _python_modules(fb)
    m = fb.manifests.filter(~F.col("path").rlike(FIXTURE))
    py = m.filter("fact = 'entry_py'").select(
        "repo", "path", "line", "value", F.split("value", ":")[0].alias("module"), F.split(F.split(F.coalesce(F.get(F.split("value", ":"), F.lit(1)), F.lit("")), r"[.\[ ]")[0], " ")[0].alias("name"), "dir"
    )
    local = py.withColumn("full", F.array(F.col("module"), F.concat_ws(".", F.nullif(F.regexp_replace("dir", "/", "."), F.lit("")), F.col("module")), F.concat_ws(".", F.nullif(F.regexp_replace("dir", "/", "."), F.lit("")), F.lit("src"), F.col("module"))))
    tried = local.withColumn("m", F.explode("full")).join(modules.withColumnRenamed("module", "m"), ["repo", "m"], "left")
    best = tried.groupBy("repo", "path", "line", "value", "module", "name").agg(F.min("target").alias("target"))
    own_top = best.withColumn("top", F.split("module", r"\.")[0]).join(
        modules.select("repo", F.explode(F.split("module", r"\.")).alias("top")).distinct(), ["repo", "top"], "left_semi"
    )
    gone = own_top.filter("target is null").withColumn("why", _s("No module `%s` is in the tree", "module"))
    lacking = _anti(own_top.filter("target is not null and name <> ''"), provided_names(fb, modules), ["repo", "target", "name"])
    lacking = _anti(lacking, _opaque(fb), ["repo", "target"]).withColumn("why", _s("`%s` does not define `%s`", "target", "name"))
    cols = ["repo", "path", "line", "value", "why"]
    js = m.filter("fact = 'entry_js'").withColumn("base", _normal(F.concat_ws("/", F.nullif("dir", F.lit("")), F.col("value")))).filter(
        "base is not null" ).filter(~F.col("base").rlike(r"(?:^|/)(?:dist|build|out|lib|es|esm|cjs|umd)/"))
    js = js.withColumn("target", F.explode(F.array(*[F.concat("base", F.lit(e)) for e in [*_JS_EXT, *_JS_INDEX]]))).join(
        fb.paths.select("repo", F.col("path").alias("target"), F.lit(1).alias("there")), ["repo", "target"], "left"
    ).groupBy("repo", "path", "line", "value").agg(F.max("there").alias("there")).filter("there is null").withColumn("why", _s("No file at `%s`", "value"))
    return finding(
        gone.select(cols).unionByName(lacking.select(cols)).unionByName(js.select(cols)), "stale-entrypoint", "lie",
        _s("Entry point `%s` leads nowhere", "value"), F.col("value"), F.col("why"), "Point to the current function or file.", 0.85,
    )


def stale_contract_ref(fb: FactBase) -> DataFrame:
    """Replacements and locks that comments name and nothing defines; defaults of variables that the code contradicts."""
    c = _anti(fb.relation("contract_claims", claims=True), fb.symbols.withColumnRenamed("name", "base"), ["repo", "base"])
    c = _anti(c, fb.symbols.withColumnRenamed("name", "root"), ["repo", "root"])
    f1 = finding(
        A.first_per(c.select("repo", "path", "line", "name", "end_line", "frame", "base"), ["repo", "path", "line", "name"], ["base"]),
        "stale-contract-ref", "lie",
        F.when(F.col("frame") == "lock", _s("Promised lock `%s` does not exist", "name")).otherwise(_s("Recommended replacement `%s` does not exist", "name")),
        F.col("name"), _s("No indexed file defines `%s`", "base"), "Name what exists.", 0.8, end_line="end_line",
    )
    e = fb.relation("env_drifts", claims=True)
    f2 = finding(
        e, "stale-contract-ref", "drift", _s("Comment says %s defaults to %s, the code %s", "var", "claimed", "actual"),
        _s("%s = %s", "var", "claimed"), F.format_string("%s:%d", F.col("path"), F.col("code_line")), "State the real default.", 0.7, end_line="end_line",
    )
    return f1.unionByName(f2)


def ghost_export(fb: FactBase) -> DataFrame:
    """Public definitions that no other file imports or uses, nor their own more than once."""
    s = fb.relation("symbols", claims=True).filter(F.col("language").isin("python", "javascript", "go") & F.col("kind").isin("function", "class") & F.col("top"))
    s = s.filter(
        (F.length("name") >= 3) & ~F.col("name").startswith("_") & ~((F.col("kind") == "class") & (F.col("language") != "javascript"))
        & ~(F.col("path").rlike(r"(?:^|/)(?:tests?/|test_|conftest)|_test\.|\.(?:test|spec)\.") & F.col("name").rlike("(?i)^test"))
        & ~F.col("path").rlike(r"(?:^|/)__init__\.py$|(?:^|/)(?:generated|gen|_expected)/")
        & ~((F.col("language") == "go") & (F.col("name").rlike("^[A-Z]") | F.col("name").isin("main", "init")))
    )
    s = s.join(fb.facts.filter("parse_failed").select("repo", "path"), ["repo", "path"], "left_anti")
    exported = fb.relation("exports").filter("language = 'javascript'").select("repo", "path", "name").distinct()
    s = s.filter("language <> 'javascript'").unionByName(_anti(s.filter("language = 'javascript'"), exported, ["repo", "path", "name"]))
    imported = fb.relation("imports").select("repo", F.col("path").alias("user"), F.explode(F.array("name", "alias")).alias("name")).filter("name is not null").distinct()
    used = imported.groupBy("repo", "name").agg(F.count("*").alias("users"), F.min("user").alias("a"))
    s = s.join(used, ["repo", "name"], "left").filter("users is null or (users = 1 and a = path)").drop("users", "a")
    s = _anti(s, fb.relation("attrs").select("repo", F.col("attr").alias("name")), ["repo", "name"])
    own = fb.relation("words").select("repo", "path", F.col("word").alias("name"), "n").groupBy("repo", "path", "name").agg(F.sum("n").alias("n"))
    s = s.join(own, ["repo", "path", "name"], "left").filter("coalesce(n, 0) <= 1")
    entries = fb.manifests.filter("fact = 'entry_py'").select("repo", F.regexp_extract("value", r":\s*([A-Za-z_]\w*)", 1).alias("name"))
    s = _anti(s, entries, ["repo", "name"])
    listed = fb.files.filter(F.col("text").contains("__all__")).select(
        "repo", "path", F.explode(F.regexp_extract_all("text", F.lit(r"[\"']([A-Za-z_]\w*)[\"']"), F.lit(1))).alias("name")
    )
    s = _anti(s, listed, ["repo", "path", "name"])
    sibling = fb.relation("words").filter("language = 'go'").select("repo", _dir(F.col("path")).alias("dir"), F.col("word").alias("name"), "path")
    pairs = s.filter("language = 'go'").select("repo", "path", "name", _dir(F.col("path")).alias("dir")).join(
        sibling.withColumnRenamed("path", "other"), ["repo", "dir", "name"]
    ).filter("other <> path").select("repo", "path", "name").distinct()
    s = _anti(s, pairs, ["repo", "path", "name"])
    return finding(
        s, "ghost-export", "smell", _s("`%s` has no user in the repository", "name"), F.col("name"),
        _s("No file imports `%s` and its own file names it once", "name"), "Remove it, or make it private.", 0.7, "lineno",
    )


# Packages


def _third_party(fb: FactBase) -> DataFrame:
    """(repo, path, lineno, top, dist, kind): imports of packages that are neither ours nor the language's."""
    imp = fb.relation("imports", claims=True)
    py = imp.filter("kind = 'py' and level = 0 and not guarded").withColumn("top", F.split("module", r"\.")[0])
    own = _python_modules(fb).select("repo", F.split("module", r"\.")[0].alias("top")).distinct()
    py = _anti(py.filter(~F.col("top").isin(*sorted(W.STDLIB))), own, ["repo", "top"])
    py = _anti(py, fb.tops.select("repo", F.regexp_replace("top", r"\.py$", "").alias("top")), ["repo", "top"])
    special = F.create_map(*[F.lit(x) for kv in W.DISTRIBUTION_OF.items() for x in kv])
    py = py.withColumn("dist", F.coalesce(special[F.col("top")], F.lower(F.regexp_replace("top", r"[-_.]+", "-"))))
    js = imp.filter("kind = 'js'").filter(~F.col("module").rlike(r"^[./#~@]?/|^\.|^#|^node:|^[a-z]+:")).withColumn(
        "top", F.regexp_extract("module", r"^(@[^/]+/[^/]+|[^/@][^/]*)", 1)
    ).filter(~F.col("top").isin(*sorted(W.NODE_BUILTINS)) & (F.col("top") != ""))
    zones = fb.manifests.filter("fact = 'alias'").select(
        "repo", F.lit("").alias("zone"), F.regexp_replace("name", r"\*$", "").alias("prefix"), F.col("name").endswith("*").alias("open")
    ).distinct()
    js = _anti(js, _alias_matches(js.select("repo", "path", "module"), "module", zones), ["repo", "path", "module"]).withColumn("dist", F.col("top"))
    names = fb.manifests.filter("fact = 'own'").select("repo", F.col("name").alias("top"))
    both = py.unionByName(js).select("repo", "path", "lineno", "top", "dist", "kind")
    return _anti(both, names, ["repo", "top"])


def _declared(fb: FactBase) -> tuple[DataFrame, DataFrame]:
    """(repo, dir, kind) of manifests, and (repo, dir, kind, dist) of what they declare."""
    m = fb.manifests
    # a requirements file declares what the files it includes declare, two steps deep
    inc = m.filter("fact = 'include'").select("repo", "dir", _normal(F.concat_ws("/", F.nullif("dir", F.lit("")), F.col("name"))).alias("at"))
    for _ in range(2):
        deps = m.filter("fact = 'py_dep'").select("repo", F.col("path").alias("at"), "fact", "name", "value", "line", "path")
        m = m.unionByName(inc.join(deps, ["repo", "at"]).select(*m.columns)).distinct()
    kind = F.when(F.col("fact").isin("py_dep") | (F.col("name") == "python"), "py").otherwise("js")
    return (
        m.filter("fact = 'manifest'").select("repo", "dir", kind.alias("kind")).distinct(),
        m.filter("fact in ('py_dep', 'js_dep')").select("repo", "dir", kind.alias("kind"), F.col("name").alias("dist")).distinct(),
    )


def _with_manifest(fb: FactBase) -> DataFrame:
    """Third-party imports below a manifest of their kind, with ``declared``: whether an ancestor declares them."""
    have, declared = _declared(fb)
    use = _third_party(fb).withColumn("dir", F.explode(F.concat(A.prefixes(F.col("path")), F.array(F.lit("")))))
    covered = use.join(have, ["repo", "dir", "kind"], "left_semi")
    twin = F.concat(F.lit("@types/"), F.regexp_replace(F.regexp_replace("dist", "^@", ""), "/", "__"))
    named = covered.withColumn("name", F.explode(F.when(F.col("kind") == "js", F.array(F.col("dist"), twin)).otherwise(F.array("dist"))))
    hit = named.join(declared.withColumnRenamed("dist", "name").withColumn("_d", F.lit(True)), ["repo", "dir", "kind", "name"], "left")
    return hit.groupBy("repo", "path", "lineno", "top", "dist", "kind").agg(F.coalesce(F.max("_d"), F.lit(False)).alias("declared"))


def phantom_package(fb: FactBase) -> DataFrame:
    """Packages that are imported and declared in no manifest up the tree; the first import of a file counts."""
    left = _with_manifest(fb).filter("not declared")
    first = A.first_per(left, ["repo", "path", "top"], ["lineno"])
    return finding(
        first, "phantom-package", "drift", _s("`%s` is imported but not declared", "top"), F.col("top"),
        _s("No manifest above %s declares `%s`", "path", "dist"), "Declare the dependency or remove the import.", 0.65, "lineno",
    )


def slop_package(fb: FactBase, registry: DataFrame | None = None) -> DataFrame:
    """Packages that a registry snapshot (kind, dist, exists, age_hours) does not know, or knows for two days only."""
    if registry is None:
        return fb.spark.createDataFrame([], T.StructType([T.StructField("repo", T.StringType()), *post.FINDING_SCHEMA.fields]))
    use = A.first_per(_third_party(fb), ["repo", "kind", "dist"], ["path", "lineno"])
    seen = use.join(registry.select("kind", "dist", "exists", "age_hours"), ["kind", "dist"])
    bad = seen.filter("exists = false or (exists and age_hours < 48)").withColumn("gone", ~F.col("exists"))
    return finding(
        bad, "slop-package", "lie", F.when(F.col("gone"), _s("`%s` is in no registry", "dist")).otherwise(_s("`%s` is days old", "dist")), F.col("dist"),
        F.lit("Registry snapshot"), "Check the name before installing it.", F.when(F.col("gone"), 0.85).otherwise(0.7), "lineno",
    ).withColumn("severity", F.when(F.col("confidence") > 0.8, "lie").otherwise("drift"))


# Interfaces


def stale_api_ref(fb: FactBase, routes: DataFrame | None = None) -> DataFrame:
    """Calls of paths that no route template matches: an anti-join on segment counts, then segment by segment."""
    r = fb.manifests.filter("fact = 'route'").select("repo", F.col("name").alias("route"))
    if routes is not None:
        r = r.unionByName(routes.select("repo", "route"))
    r = r.distinct().withColumn("segs", F.split(F.regexp_replace("route", "^/|/$", ""), "/")).withColumn("n", F.size("segs"))
    calls = fb.facts.filter(~F.col("path").rlike(FIXTURE)).select("repo", "path", F.explode("http_calls").alias("h")).select(
        "repo", "path", "h.line", "h.method", F.col("h.path").alias("url")
    )
    calls = calls.join(r.select("repo").distinct(), "repo", "left_semi").withColumn("parts", F.split(F.regexp_replace("url", "^/|/$", ""), "/")).withColumn("n", F.size("parts"))
    ok = F.forall(
        F.zip_with("segs", "parts", lambda a, b: (a == b) | ((a.rlike(r"^(?:\{.*\}|:.+)$") | b.rlike(r"\$?\{.*\}")) & (b != ""))), lambda x: x
    )
    known = calls.select("repo", "url", "parts", "n").distinct().join(r, ["repo", "n"]).filter(ok).select("repo", "url").distinct()
    return finding(
        _anti(calls, known, ["repo", "url"]), "stale-api-ref", "lie", F.trim(F.concat_ws(" ", F.lit("No route matches"), F.col("method"), F.col("url"))),
        F.trim(F.concat_ws(" ", "method", "url")), F.lit("No path of the specification has this shape"), "Call a documented route.", 0.75,
    )


def _argv(inv: DataFrame) -> DataFrame:
    """Commands with ``prog``, their program, and ``argv``, up to ``--``."""
    stop = F.array_position("argv", "--")
    upto = F.when(stop > 0, F.slice("argv", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("argv"))
    return inv.withColumn("argv", upto).filter(F.size("argv") > 0).withColumn("prog", F.col("argv")[0])


def stale_cli_flag(fb: FactBase) -> DataFrame:
    """Long flags of our own programs in documents that no parser definition knows."""
    programs = fb.manifests.filter("fact = 'program'").select("repo", F.col("name").alias("prog")).filter(F.length("prog") >= 2).distinct()
    flags = fb.relation("flags").select("repo", F.col("name").alias("flag")).distinct()
    opaque = fb.facts.filter("opaque_cli").select("repo").distinct()
    inv = fb.relation("invocations", claims=True).filter(~F.col("path").rlike(r"(?i)(?:^|/)(?:changes|changelog|history|news|releases?)[^/]*$"))
    use = _argv(inv).join(programs, ["repo", "prog"], "left_semi").join(opaque, "repo", "left_anti").join(flags.select("repo").distinct(), "repo", "left_semi")
    used = use.withColumn("raw", F.explode(F.slice("argv", F.lit(2), F.size("argv")))).withColumn("flag", F.regexp_extract("raw", r"^(--[A-Za-z][\w-]*)(?:=|$)", 1)).filter(
        (F.col("flag") != "") & ~F.col("flag").isin("--help", "--version")
    )
    left = _anti(used, flags, ["repo", "flag"])
    prefixes = flags.select("repo", F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("flag"))), lambda k: F.substring(F.col("flag"), F.lit(1), k))).alias("flag")).distinct()
    left = _anti(left, prefixes, ["repo", "flag"])
    left = left.withColumn("positive", F.regexp_replace("flag", "^--no-", "--"))
    left = _anti(left, flags.withColumnRenamed("flag", "positive"), ["repo", "positive"])
    once = A.first_per(left.select("repo", "path", "line", "flag", "prog"), ["repo", "path", "line", "flag"], ["prog"])
    return finding(
        once, "stale-cli-flag", "lie", _s("`%s` has no flag `%s`", "prog", "flag"), F.col("flag"),
        _s("No parser in the code defines `%s`", "flag"), "Document a flag that exists.", 0.8,
    )


def stale_cli_ref(fb: FactBase, spec: DataFrame | None = None) -> DataFrame:
    """Documented commands against a specification (program, command, flag, takes_value); the first bad token counts."""
    if spec is None:
        return fb.spark.createDataFrame([], T.StructType([T.StructField("repo", T.StringType()), *post.FINDING_SCHEMA.fields]))
    use = _argv(fb.relation("invocations", claims=True)).join(spec.select(F.col("program").alias("prog")).distinct(), "prog", "left_semi")
    use = use.withColumn("command_word", F.get("argv", F.lit(1)))
    commands = spec.select(F.col("program").alias("prog"), F.col("command").alias("command_word")).filter("command_word is not null").distinct().withColumn("known", F.lit(True))
    use = use.join(commands, ["prog", "command_word"], "left").fillna(False, ["known"])
    bad_command = use.filter(F.col("strong") & ~F.col("known") & F.col("command_word").rlike(r"^[a-z][\w-]*$")).select(
        "repo", "path", "line", "prog", F.col("command_word").alias("token"), F.lit(0).alias("at")
    )
    toks = use.filter("known or command_word like '-%'").select("repo", "path", "line", "prog", "command_word", F.posexplode("argv").alias("at", "tok"))
    valued = spec.filter("takes_value").select(F.col("program").alias("prog"), F.col("flag").alias("tok")).distinct()
    after = toks.join(valued, ["prog", "tok"], "left_semi").select("repo", "path", "line", "prog", (F.col("at") + 1).alias("at"))
    toks = toks.join(after, ["repo", "path", "line", "prog", "at"], "left_anti")
    flags = toks.withColumn("flag", F.regexp_extract("tok", r"^(--[A-Za-z][\w-]*)(?:=|$)", 1)).filter("flag <> '' and flag <> '--help'")
    allowed = spec.select(F.col("program").alias("prog"), F.coalesce("command", F.lit("*")).alias("cw"), "flag").filter("flag is not null")
    allowed = allowed.select("prog", "cw", F.explode(F.transform(F.sequence(F.lit(4), F.length("flag")), lambda k: F.substring(F.col("flag"), F.lit(1), k))).alias("flag")).distinct()
    flags = flags.withColumn("cw", F.col("command_word")).join(allowed, ["prog", "cw", "flag"], "left_anti")
    flags = flags.withColumn("cw", F.lit("*")).join(allowed, ["prog", "cw", "flag"], "left_anti")
    bad = bad_command.unionByName(flags.select("repo", "path", "line", "prog", F.col("flag").alias("token"), "at"))
    return finding(
        A.first_per(bad, ["repo", "path", "line", "prog"], ["at", "token"]), "stale-cli-ref", "lie", _s("`%s` knows no `%s`", "prog", "token"),
        F.col("token"), F.lit("Not in the command's specification"), "Document a command that exists.", 0.85,
    )


@dataclass(frozen=True)
class Rule:
    plan: Callable[..., DataFrame]
    severity: str
    default: bool
    text: str


REGISTRY: dict[str, Rule] = {
    "stale-symbol-ref": Rule(stale_symbol_ref, "lie", True, "A comment names a symbol that nothing defines."),
    "unclosed-fence": Rule(unclosed_fence, "lie", True, "A Markdown fence never closes or swallows another block."),
    "stale-file-ref": Rule(stale_file_ref, "lie", True, "A comment names a file that does not exist."),
    "stale-import": Rule(stale_import, "lie", True, "An import of a module or name that the tree does not provide."),
    "number-drift": Rule(number_drift, "drift", True, "A number in a comment that the code nearby contradicts."),
    "fragile-anchor": Rule(fragile_anchor, "smell", True, "A comment anchored to a line number, a position or a mood."),
    "stale-mock-ref": Rule(stale_mock_ref, "lie", True, "A patched target that does not exist."),
    "stale-entrypoint": Rule(stale_entrypoint, "lie", True, "A declared entry point that leads nowhere."),
    "stale-doc-ref": Rule(stale_doc_ref, "lie", False, "A documentation example that calls what nothing defines."),
    "stale-contract-ref": Rule(stale_contract_ref, "lie", False, "A promised replacement, lock or default that is not so."),
    "ghost-export": Rule(ghost_export, "smell", False, "A public definition that nobody uses."),
    "phantom-package": Rule(phantom_package, "drift", False, "A package imported and declared nowhere."),
    "stale-cli-ref": Rule(stale_cli_ref, "lie", False, "A documented command that its specification lacks."),
    "stale-cli-flag": Rule(stale_cli_flag, "lie", False, "A documented flag that no parser defines."),
    "stale-api-ref": Rule(stale_api_ref, "lie", False, "A call of a path that no route matches."),
    "slop-package": Rule(slop_package, "lie", False, "A package that the registry does not know."),
}


def enabled(enable: list[str] | None = None, disable: list[str] | None = None) -> list[str]:
    """Rule ids to run; unknown ids are an error, and an empty choice means the default set."""
    unknown = [r for r in [*(enable or []), *(disable or [])] if r not in REGISTRY and r != "all"]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    chosen = list(REGISTRY) if enable and "all" in enable else list(enable or [r for r, x in REGISTRY.items() if x.default])
    left = [r for r in chosen if r not in (disable or []) and "all" not in (disable or [])]
    return left or [r for r, x in REGISTRY.items() if x.default]


def explain(spark) -> DataFrame:
    """(rule, severity, default_on, text) of all rules."""
    return spark.createDataFrame([(k, r.severity, r.default, r.text) for k, r in REGISTRY.items()], "rule string, severity string, default_on boolean, text string")


def scan(
    fb: FactBase, enable: list[str] | None = None, disable: list[str] | None = None, registry: DataFrame | None = None,
    spec: DataFrame | None = None, routes: DataFrame | None = None,
) -> DataFrame:
    """Findings of the chosen rules, one per (repo, path, line, checker, title)."""
    extra = {"slop-package": {"registry": registry}, "stale-cli-ref": {"spec": spec}, "stale-api-ref": {"routes": routes}}
    parts = [REGISTRY[r].plan(fb, **extra.get(r, {})).select(COLUMNS) for r in enabled(enable, disable)]
    every = reduce(DataFrame.unionByName, parts)
    return A.first_per(every, ["repo", "path", "line", "checker", "title"], [F.coalesce("claim", F.lit(""))]).select(COLUMNS)


# Hints


#: Bounds of one cell of claims x symbols of a repository: what one task holds at a time.
CLAIM_CELL, SYMBOL_CELL = 2000, 20000


def _bigrams(x: str) -> list[tuple[str, int]]:
    """Bigrams with a mark at both ends, each with the number of its occurrence, so that shared ones count as a bag."""
    seen: dict[str, int] = {}
    out = []
    for g in map("".join, zip("\x02" + x, x + "\x03")):
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def close_pairs(claims: list[str], names: list[str], cutoff: float, top: int | None, others: bool, claim_first: bool) -> list[tuple[str, str, float]]:
    """(claim, name, ratio) of ratio >= cutoff, at most ``top`` a claim; equal ratios by the greater name, as difflib does.

    Lossless: M matched characters of lengths a and b mean a - M deletions, each of which breaks at most two bigrams
    of the claim, and b - M insertions, each of which breaks at most one. So at least a + 1 - 2(a - M) - (b - M) are
    shared, and M <= (shared + a + b - 1) / 3. Names are compared in the order of that bound until none can do better.
    """
    size = np.array([len(x) for x in names], dtype=np.int64)
    where: dict[tuple[str, int], list[int]] = {}
    for k, x in enumerate(names):
        for g in _bigrams(x):
            where.setdefault(g, []).append(k)
    index = {g: np.array(v, dtype=np.int64) for g, v in where.items()}
    out = []
    for claim in claims:
        found = [index[g] for g in _bigrams(claim) if g in index]
        shared = np.bincount(np.concatenate(found), minlength=len(names)) if found else np.zeros(len(names), dtype=np.int64)
        both = size + len(claim)
        most = np.minimum((shared + both - 1) // 3, np.minimum(size, len(claim)))
        bound = np.where(both > 0, 2.0 * most / np.maximum(both, 1), 1.0)
        can = np.flatnonzero(bound >= cutoff - 1e-9)
        best: list[tuple[float, str]] = []
        match = difflib.SequenceMatcher()
        (match.set_seq1 if claim_first else match.set_seq2)(claim)
        put = match.set_seq2 if claim_first else match.set_seq1
        for k in can[np.argsort(-bound[can], kind="stable")]:
            if top is not None and len(best) == top and bound[k] < best[-1][0] - 1e-9:
                break
            if others and names[k] == claim:
                continue
            put(names[k])
            r = match.ratio()
            if r >= cutoff:
                best.append((r, names[k]))
                if top is not None:
                    best = sorted(best, reverse=True)[:top]
        out += [(claim, x, r) for r, x in best]
    return out


def _close(claims: DataFrame, symbols: DataFrame, cutoff: float, top: int | None = None, others: bool = False, claim_first: bool = True) -> DataFrame:
    """``close_pairs`` of each repository, in cells of bounded size; with ``top``, each cell gives its own best."""
    c = claims.select("repo", "claim").dropna().distinct()
    s = symbols.select("repo", "name").dropna().distinct()
    n = c.groupBy("repo").agg(F.ceil(F.count("*") / CLAIM_CELL).cast("int").alias("cs")).join(
        s.groupBy("repo").agg(F.ceil(F.count("*") / SYMBOL_CELL).cast("int").alias("ss")), "repo"
    )
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    c = c.join(n, "repo").select(F.col("repo").alias("of"), "claim", F.expr("cast(pmod(xxhash64(claim), cs) as int)").alias("i"), every("ss").alias("j"))
    s = s.join(n, "repo").select(F.col("repo").alias("of"), "name", F.expr("cast(pmod(xxhash64(name), ss) as int)").alias("j"), every("cs").alias("i"))

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = close_pairs(a["claim"].tolist(), b["name"].tolist(), cutoff, top, others, claim_first) if len(a) and len(b) else []
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["repo", "claim", "name", "ratio"])

    keys = ["of", "i", "j"]
    return c.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInPandas(compare, "repo string, claim string, name string, ratio double")


def similar_symbols(claims: DataFrame, symbols: DataFrame, cutoff: float) -> DataFrame:
    """(repo, claim, name, ratio): symbols like a claim, all of them (see ``close_pairs``)."""
    return _close(claims, symbols, cutoff)


def did_you_mean(claims: DataFrame, symbols: DataFrame, cutoff: float = 0.8, top: int = 2, others: bool = False) -> DataFrame:
    """The ``top`` most similar symbols of each claim; with ``others``, without the claim itself."""
    w = Window.partitionBy("repo", "claim").orderBy(F.col("ratio").desc(), F.col("name").desc())
    near = _close(claims, symbols, cutoff, top, others, claim_first=False)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rename_candidates(fb: FactBase, findings: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(repo, path, line, claim, name): the one symbol that a stale claim can mean; none where several can.
    Symbols defined in the claim's directory come before others."""
    c = findings.filter("checker = 'stale-symbol-ref'").select(
        "repo", "path", "line", F.element_at(F.split(F.regexp_replace("claim", r"[`()]", ""), r"\."), -1).alias("claim")
    )
    like = similar_symbols(c, fb.symbols, cutoff)
    where = fb.relation("symbols").select("repo", "name", _dir(F.col("path")).alias("dir")).distinct()
    near = c.join(like, ["repo", "claim"]).join(where, ["repo", "name"]).withColumn("here", F.col("dir") == _dir(F.col("path")))
    one = near.groupBy("repo", "path", "line", "claim").agg(
        F.collect_set(F.when(F.col("here"), F.col("name"))).alias("near"), F.collect_set("name").alias("all")
    )
    pick = F.when(F.size("near") == 1, F.col("near")[0]).when((F.size("near") == 0) & (F.size("all") == 1), F.col("all")[0])
    return one.withColumn("name", pick).filter("name is not null").select("repo", "path", "line", "claim", "name")


def move_candidates(fb: FactBase, findings: DataFrame) -> DataFrame:
    """(repo, path, line, claim, moved_to): files of the same name, where there is exactly one."""
    c = findings.filter("checker = 'stale-file-ref'").select("repo", "path", "line", "claim", F.element_at(F.split("claim", "/"), -1).alias("base"))
    f = fb.paths.select("repo", F.element_at(F.split("path", "/"), -1).alias("base"), F.col("path").alias("moved_to"))
    one = f.groupBy("repo", "base").agg(F.min("moved_to").alias("moved_to"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return c.join(one, ["repo", "base"]).select("repo", "path", "line", "claim", "moved_to")


# Point queries


def blast_radius(fb: FactBase, symbol: str) -> DataFrame:
    """(repo, kind, paths): who defines, imports and claims a symbol."""
    return fb.edges().filter(F.col("symbol") == symbol).groupBy("repo", "kind").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def check_text(fb: FactBase, text: str, repo: str = "") -> DataFrame:
    """(claim, kind, verdict, detail) of the names and paths that a text about a repository mentions."""
    names = sorted({(n, n.split(".")[-1]) for _, n, _, _, _ in extract.ticked_names(text)} | {(n, n.split(".")[-1]) for n, _, _ in extract.called_names(text)})
    names = [x for x in names if x[1].lower() not in W.FILE_SUFFIXES or "." not in x[0]]
    claims = fb.spark.createDataFrame(names, "claim string, base string")
    symbols = fb.symbols.filter(F.col("repo") == repo)
    known = symbols.select(F.col("name").alias("base")).distinct().withColumn("known", F.lit(True))
    params = fb.relation("functions").filter(F.col("repo") == repo).select(F.explode("args").alias("base")).select(
        F.regexp_replace("base", r"^[*.]+", "").alias("base")
    ).distinct().withColumn("param", F.lit(True))
    lower = symbols.groupBy(F.lower("name").alias("low")).agg(F.count_distinct("name").alias("spellings"), F.min("name").alias("other"))
    n = claims.join(known, "base", "left").join(params, "base", "left").withColumn("low", F.lower("base")).join(lower, "low", "left")
    verdict = F.when(F.col("known") | F.col("param") | (F.col("spellings") == 1), "known").otherwise("unknown")
    detail = F.when(F.col("known"), "defined here").when(F.col("param"), "a parameter").when(F.col("spellings") == 1, F.concat(F.lit("spelled "), F.col("other"))).otherwise("defined nowhere")
    s = n.select("claim", F.lit("symbol").alias("kind"), verdict.alias("verdict"), detail.alias("detail"))
    refs = fb.spark.createDataFrame(sorted({(p,) for p, _ in extract.path_names(text)}), "claim string")
    ends = fb.paths.filter(F.col("repo") == repo).select(F.explode(A.suffixes(F.col("path"))).alias("claim")).distinct().withColumn("there", F.lit(True))
    f = refs.join(ends, "claim", "left").select(
        "claim", F.lit("file").alias("kind"), F.when(F.col("there"), "known").otherwise("unknown").alias("verdict"),
        F.when(F.col("there"), "in the tree").otherwise("not in the tree").alias("detail"),
    )
    return s.unionByName(f)


def check_path(findings: DataFrame, prefix: str, errors: DataFrame | None = None, repo: str | None = None) -> DataFrame:
    """Summary of the findings below a path, of one repository or of all: counts, and whether the scan was complete."""
    mine = findings if repo is None else findings.filter(post.repo_of(findings) == repo)
    return post.gate(post.in_scope(mine, prefix), "lie", errors)


def changed_findings(head: FactBase, base: FactBase, **kw) -> DataFrame:
    """Findings of the head that the base did not have: both snapshots scanned, then a bag difference."""
    return post.introduced(scan(head, **kw), scan(base, **kw))
