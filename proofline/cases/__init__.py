"""Small trees with the findings that each must give and the silences that each must keep.

A case is a repository of its own: all of them form one file table, over which a rule runs as it does over any
other table. The expected findings are written by hand.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Case:
    name: str
    files: dict[str, str]
    #: (checker, path, line) of every finding of the rules judged; other findings of those rules are false.
    expect: list[tuple[str, str, int]] = field(default_factory=list)
    #: Rules judged; empty for the default set.
    rules: tuple[str, ...] = ()


def lines(*rows: str) -> str:
    return "\n".join(rows) + "\n"


from proofline.cases import javascript, manifests, python, texts  # noqa: E402

CASES: list[Case] = [*python.CASES, *javascript.CASES, *texts.CASES, *manifests.CASES]

# What a registry snapshot and a command specification say in these cases.
REGISTRY = [
    ("py", "requests", True, 90000.0), ("py", "pyyaml", True, 90000.0), ("py", "reqeusts-toolkit", False, None),
    ("py", "fresh-thing", True, 20.0), ("js", "left-pad", True, 90000.0), ("js", "colour-of-nothing", False, None),
]
SPEC = [
    ("tally", "run", "--jobs", True), ("tally", "run", "--quiet", False), ("tally", "report", "--format", True),
    ("tally", None, "--config", True), ("tally", "clean", None, None),
]
