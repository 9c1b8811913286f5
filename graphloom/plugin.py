"""Plugins: admitted by manifest, allowlist and powers; they add sources, mounts, predicates, functions and operations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .diagnostics import LoomError
from .functions.values import SQL_TYPE
from .schema import AdapterSchema, check_schema

API = 1
POWERS = ("read", "plan", "apply", "filesystem", "network")
RESERVED = ("from", "mount", "select", "where", "project", "distinct", "take", "count", "sort", "join", "invoke", "plan", "let", "related")
_NAMESPACE = re.compile(r"^[a-z][a-z0-9-]*$")
_TYPES = tuple(SQL_TYPE)


@dataclass(frozen=True)
class Predicate:
    """A typed test of rows: ``column(view, *args)`` gives a boolean Column."""

    name: str
    parameters: tuple[str, ...]
    column: Callable


@dataclass(frozen=True)
class ScalarFunction:
    """A typed function of values: ``column(*columns)``, or a Python callable for ``python``."""

    name: str
    parameters: tuple[str, ...]
    result: str
    column: Callable


def python_function(name: str, parameters: tuple[str, ...], result: str, body: Callable) -> ScalarFunction:
    """A function of Python values, sent to workers in Arrow batches; null and missing give null."""
    made = F.udf(lambda *xs: None if any(x is None for x in xs) else body(*xs), SQL_TYPE[result], useArrow=True)
    return ScalarFunction(name, parameters, result, made)


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    api: int = API
    namespaces: tuple[str, ...] = ()
    powers: tuple[str, ...] = ()
    aliases: dict = field(default_factory=dict)
    contributes: dict = field(default_factory=dict)


@dataclass
class Plugin:
    manifest: Manifest
    schemas: dict[str, AdapterSchema] = field(default_factory=dict)
    sources: dict = field(default_factory=dict)
    mounts: dict = field(default_factory=dict)
    predicates: list[Predicate] = field(default_factory=list)
    functions: list[ScalarFunction] = field(default_factory=list)
    operations: dict = field(default_factory=dict)
    renderers: dict = field(default_factory=dict)
    diffs: dict = field(default_factory=dict)
    rules: list[str] = field(default_factory=list)

    def contributions(self) -> dict[str, set]:
        return {
            "schemas": set(self.schemas),
            "sources": set(self.sources),
            "mounts": set(self.mounts),
            "predicates": {p.name for p in self.predicates},
            "functions": {f.name for f in self.functions},
            "operations": set(self.operations),
            "renderers": set(self.renderers),
            "diffs": set(self.diffs),
            "rules": set(self.rules),
        }


@dataclass(frozen=True)
class Policy:
    allow: tuple[str, ...] = ()
    powers: dict = field(default_factory=dict)


def _fail(code: str, message: str):
    raise LoomError(f"plugin.{code}", message)


def check_manifest(m: Manifest) -> Manifest:
    if not isinstance(m, Manifest) or not m.name or not m.version:
        _fail("invalid-manifest", "a manifest has a name and a version")
    if m.api != API:
        _fail("incompatible-api", f"{m.name} needs interface {m.api}")
    if len(set(m.namespaces)) != len(m.namespaces):
        _fail("duplicate-namespace", f"{m.name} lists a namespace twice")
    for n in m.namespaces:
        if not _NAMESPACE.match(n):
            _fail("invalid-manifest", f"not a namespace: {n}")
    for p in m.powers:
        if p not in POWERS:
            _fail("invalid-power", f"unknown power {p}")
    for kind, names in m.contributes.items():
        if len(set(names)) != len(list(names)):
            _fail("duplicate-contribution", f"{m.name} lists a contribution twice")
        for n in names:
            if "::" in n and n.split("::")[0] not in m.namespaces:
                _fail("foreign-namespace", f"{n} is outside the namespaces of {m.name}")
    for alias, target in m.aliases.items():
        if not re.fullmatch(r"[A-Za-z][\w-]*", alias):
            _fail("invalid-alias", f"not an alias: {alias}")
        if alias in RESERVED:
            _fail("reserved-alias", f"{alias} is a word of the language")
        if not any(target in names for names in m.contributes.values()):
            _fail("unknown-alias-target", f"{alias} stands for nothing")
    return m


class Registry:
    """Admitted plugins and what they contribute."""

    def __init__(self, policy: Policy | None = None):
        self.policy = policy or Policy()
        if len(set(self.policy.allow)) != len(self.policy.allow):
            _fail("duplicate-policy-entry", "a plugin is allowed twice")
        for powers in self.policy.powers.values():
            for p in powers:
                if p not in POWERS:
                    _fail("invalid-policy", f"unknown power {p}")
        self.plugins: dict[str, Plugin] = {}

    def admit(self, plugin: Plugin) -> Plugin:
        if not isinstance(plugin, Plugin):
            _fail("invalid-module", "not a plugin")
        m = check_manifest(plugin.manifest)
        if m.name in self.plugins:
            _fail("duplicate", f"{m.name} is there already")
        if m.name not in self.policy.allow:
            _fail("not-allowlisted", f"{m.name} is not allowed")
        extra = set(m.powers) - set(self.policy.powers.get(m.name, ()))
        if extra:
            _fail("unauthorized-power", f"{m.name} may not {sorted(extra)}")
        taken = {n for p in self.plugins.values() for n in p.manifest.namespaces}
        if taken & set(m.namespaces):
            _fail("duplicate-namespace", f"namespace {sorted(taken & set(m.namespaces))} is taken")
        declared = {k: set(v) for k, v in m.contributes.items()}
        for kind, names in plugin.contributions().items():
            if names != declared.get(kind, set()):
                _fail("contribution-mismatch", f"{m.name} declares other {kind} than it has")
        for namespace, schema in plugin.schemas.items():
            try:
                check_schema(schema)
            except ValueError as e:
                _fail("invalid-schema", str(e))
            if schema.namespace != namespace:
                _fail("schema-mismatch", f"{namespace} has the schema of {schema.namespace}")
            if not schema.dynamic:
                _fail("static-schema", "schemas of plugins are dynamic")
        for x in (*plugin.predicates, *plugin.functions):
            if "::" not in x.name or any(p not in _TYPES for p in x.parameters) or getattr(x, "result", "boolean") not in _TYPES:
                _fail("invalid-query-extension", f"{x.name} has an invalid signature")
        for s in plugin.sources.values():
            if getattr(s, "mode", None) not in ("roots", "selection"):
                _fail("invalid-selector-source", "a source is in mode roots or selection")
        for r in plugin.rules:
            if not isinstance(r, str) or "::" not in r:
                _fail("invalid-optimizer-rule", "a rule has a namespaced identity")
        for name in plugin.operations:
            if name.split("::")[0] not in m.namespaces:
                _fail("unknown-operation", f"{name} belongs to no schema of {m.name}")
        self.plugins[m.name] = plugin
        return plugin

    def get(self, name: str) -> Plugin:
        if name not in self.plugins:
            _fail("unknown", f"no plugin {name}")
        return self.plugins[name]

    def _contributed(self, table: str, name: str):
        for p in self.plugins.values():
            made = getattr(p, table)
            target = p.manifest.aliases.get(name, name)
            if target in made:
                return made[target]
        _fail("unknown-contribution", f"no plugin has {name} among its {table}")

    def render(self, plan, renderer: str | None = None, diff: str | None = None, reveal: bool = False) -> str:
        """A change plan by a contributed renderer, or as usual with a contributed diff."""
        from .change import render, unified

        made = self._contributed("renderers", renderer) if renderer else None
        return render(plan, reveal, self._contributed("diffs", diff) if diff else unified, made)

    def extend(self, env):
        """The environment with all contributions, also under their aliases."""
        from .plans.pipeline import Function

        for p in self.plugins.values():
            env.sources.update(p.sources)
            env.mounts.update(p.mounts)
            env.operations.update(p.operations)
            env.predicates.update({x.name: x for x in p.predicates})
            env.functions.update({f.name: Function(f.parameters, f.result, f.column) for f in p.functions})
            for alias, target in p.manifest.aliases.items():
                for table in (env.sources, env.mounts, env.functions):
                    if target in table:
                        if alias in table and table[alias] is not table[target]:
                            _fail("invalid-alias", f"{alias} is taken")
                        table[alias] = table[target]
        return env
