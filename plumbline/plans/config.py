"""Layered configuration, on the driver: files from low to high precedence become rule settings."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from plumbline.functions import lexicons
from plumbline.operators.rules import Settings
from plumbline.plans.engine import RANK
from plumbline.sources.files import nearest
from plumbline.sources.wordset import allowed_set

#: Names of the files that are looked for.
APP = "plumbline"
USER_FILES = ("config.yaml", "config.yml")
PROJECT_FILES = (".plumbline.yaml", ".plumbline.yml")
LOCAL_FILES = (".plumbline.local.yaml", ".plumbline.local.yml")
STORE_FILES = (".plumbline.vocab.yaml",)
USER_STORE = "vocab.yaml"


@dataclass
class Config:
    min_severity: str = "error"
    strict: bool = False
    procedure_max: int = 20
    description_max: int = 25
    slop: bool = False
    builtin_terms: bool = True
    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    rules: dict[str, dict[str, Any]] = field(default_factory=dict)

    def settings(self) -> Settings:
        return Settings(self.procedure_max, self.description_max, self.strict, self.slop, allowed_set(lexicons.TECHNICAL_TERMS, self.allow, self.deny, self.builtin_terms))

    def disabled(self) -> set[str]:
        return {k for k, r in self.rules.items() if r.get("disabled")}

    def severities(self) -> dict[str, str]:
        return {k: r["severity"].strip().lower() for k, r in self.rules.items() if r.get("severity")}

    def validate(self) -> Config:
        for name in [self.min_severity, *self.severities().values()]:
            if name and name.strip().lower() not in RANK:
                raise ValueError(f"not a severity: {name}")
        if min(self.procedure_max, self.description_max) < 0:
            raise ValueError("sentence limits must not be negative")
        return self


def merge(config: Config, layer: Mapping[str, Any] | None) -> Config:
    """One higher layer: single values replace, lists add up, a rule's entry replaces the whole entry below it."""
    layer = layer or {}
    plain = {"minSeverity": "min_severity", "strictVocabulary": "strict"}
    nested = {("sentence", "procedureMax"): "procedure_max", ("sentence", "descriptionMax"): "description_max", ("slop", "enabled"): "slop", ("vocabulary", "builtinTechnicalTerms"): "builtin_terms"}
    lists = {("vocabulary", "allow"): "allow", ("vocabulary", "deny"): "deny", ("files", "include"): "include", ("files", "exclude"): "exclude"}
    for key, to in plain.items():
        if layer.get(key) is not None:
            setattr(config, to, layer[key])
    for (a, b), to in nested.items():
        if (layer.get(a) or {}).get(b) is not None:
            setattr(config, to, layer[a][b])
    for (a, b), to in lists.items():
        getattr(config, to).extend((layer.get(a) or {}).get(b) or [])
    config.rules.update(layer.get("rules") or {})
    return config


def load(paths: Iterable[str], explicit: str | None = None) -> Config:
    """The configuration of the given files, lowest first; a missing file is skipped, a missing explicit one is an error."""
    import yaml

    config = Config()
    for p in map(Path, paths):
        if p.is_file():
            merge(config, yaml.safe_load(p.read_text()))
    if explicit:
        merge(config, yaml.safe_load(Path(explicit).read_text()))
    return config.validate()


def discover(folder: str = ".", env: Mapping[str, str] | None = None) -> list[str]:
    """The configuration files that exist for a folder, lowest first.

    System folders (the first listed is the strongest), the user's file, the user's learned vocabulary, then the nearest
    project file, project-local file and project vocabulary, each found by itself in the folder or above it.
    """
    env = os.environ if env is None else env
    home = Path(env["HOME"]) if env.get("HOME") else None
    own = lambda key, *rest: Path(env[key]) if env.get(key) else home and home.joinpath(*rest)
    system = [Path(d) for d in (env.get("XDG_CONFIG_DIRS") or "/etc/xdg").split(os.pathsep) if d]
    user, state = own("XDG_CONFIG_HOME", ".config"), own("XDG_STATE_HOME", ".local", "state")
    of = lambda d, names: next((f for f in (d / APP / n for n in names) if f.is_file()), None) if d else None
    found = [*(of(d, USER_FILES) for d in reversed(system)), of(user, USER_FILES), of(state, [USER_STORE])]
    found += [nearest(folder, names) for names in (PROJECT_FILES, LOCAL_FILES, STORE_FILES)]
    return [str(f) for f in found if f]


def read_store(path: str) -> tuple[list[str], list[str]]:
    """(allow, deny) of a vocabulary file; a missing file is an empty one."""
    import yaml

    at = Path(path)
    terms = ((yaml.safe_load(at.read_text()) if at.is_file() else None) or {}).get("vocabulary") or {}
    return list(terms.get("allow") or []), list(terms.get("deny") or [])


def update_store(path: str, allow: Iterable[str] = (), deny: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Adds terms to a vocabulary file and gives all it holds then: trimmed, lower-cased, sorted, each once.

    The file is written anew beside the old one and takes its place at once.
    """
    import yaml

    old = read_store(path)
    new = tuple(sorted(allowed_set((), [*have, *more], ())) for have, more in zip(old, (allow, deny), strict=True))
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    part = at.with_name(at.name + ".part")
    part.write_text("# Learned terms; rewritten by the program.\n" + yaml.safe_dump({"vocabulary": {"allow": new[0], "deny": new[1]}}, allow_unicode=True, sort_keys=False))
    part.replace(at)
    return new
