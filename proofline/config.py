"""Settings of a scan: the keys of the configuration file, checked."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field

from proofline.functions import words as W
from proofline.operators.post import SEVERITY_RANK
from proofline.plans.rules import enabled

KEYS = ("enable", "enabled", "disable", "ignore_dirs", "ignore_files", "fail_on", "path_aliases")


@dataclass(frozen=True)
class Config:
    rules: tuple[str, ...] = field(default_factory=lambda: tuple(enabled()))
    ignore_dirs: frozenset[str] = W.IGNORED_DIRS
    ignore_files: frozenset[str] = W.IGNORED_FILES
    fail_on: str = "lie"
    path_aliases: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, settings: Mapping) -> Config:
        """From a mapping. Unknown keys and rules are errors; an unknown ``fail_on`` means ``lie``."""
        unknown = [k for k in settings if k not in KEYS]
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")

        def strings(key: str) -> list[str]:
            v = settings.get(key) or []
            if isinstance(v, str) or not all(isinstance(x, str) for x in v):
                raise ValueError(f"{key} must be a list of strings")
            return list(v)

        aliases = settings.get("path_aliases") or {}
        fail = settings.get("fail_on", "lie")
        return cls(
            rules=tuple(enabled(strings("enable") or strings("enabled") or None, strings("disable") or None)),
            ignore_dirs=W.IGNORED_DIRS | frozenset(strings("ignore_dirs")),
            ignore_files=W.IGNORED_FILES | frozenset(strings("ignore_files")),
            fail_on=fail if fail in SEVERITY_RANK else "lie",
            path_aliases={k: tuple([v] if isinstance(v, str) else v) for k, v in aliases.items()},
        )

    @classmethod
    def load(cls, path: str, section: str | None = None) -> Config:
        """From a TOML file; a file that does not parse is an error."""
        with open(path, "rb") as f:
            try:
                doc = tomllib.load(f)
            except tomllib.TOMLDecodeError as e:
                raise ValueError(f"{path}: {e}") from e
        for part in (section or "").split("."):
            doc = doc.get(part, {}) if part else doc
        return cls.of(doc)
