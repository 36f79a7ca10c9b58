"""The plugin surface: analyzers, enrichers and recognizers by id and version, activated by a manifest.

A plugin contributes named parts. Its identity is part of each state's input fingerprint, so
that a repository is analyzed again when a plugin changes, and not otherwise.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .analysis import Analysis, analyze_workspace
from .sources import frameworks
from .sources.facts_cache import FactCache


class WorkspaceAnalyzer(ABC):
    """From files (repository, path, content) to facts."""

    id: str
    version: str

    @abstractmethod
    def analyze(self, files: DataFrame) -> Analysis: ...


class WorkspaceEnricher(ABC):
    """From one repository's published graph to overrides, and perhaps edges, that a later revision holds."""

    id: str
    version: str

    @abstractmethod
    def enrich(self, repository: str, graph) -> tuple[DataFrame, DataFrame | None]: ...


@dataclass(frozen=True)
class Plugin:
    """What one plugin contributes. ``recognizers``: name to (path pattern, function from text to rows)."""

    id: str
    version: str
    analyzers: tuple[WorkspaceAnalyzer, ...] = ()
    enrichers: tuple[WorkspaceEnricher, ...] = ()
    recognizers: dict[str, tuple[str, Callable[[str, str, str], list[dict]]]] = field(default_factory=dict)


class DuplicateId(ValueError):
    """Two plugins or parts share an id."""


class Registry:
    """Installed plugins; those that a manifest names are active."""

    def __init__(self) -> None:
        self.installed: dict[str, Plugin] = {}

    def install(self, plugin: Plugin) -> None:
        """Add a plugin. Ids of plugins and of their parts are unique over all that is installed."""
        taken = {x for p in self.installed.values() for x in _parts(p)}
        new = list(_parts(plugin))
        if plugin.id in self.installed or taken & set(new) or len(new) != len(set(new)):
            raise DuplicateId(plugin.id)
        self.installed[plugin.id] = plugin

    def activate(self, manifest: Iterable[str]) -> "Active":
        """The plugins that a manifest lists; an unknown or repeated id is an error."""
        ids = list(manifest)
        if len(ids) != len(set(ids)):
            raise DuplicateId(", ".join(sorted({x for x in ids if ids.count(x) > 1})))
        if missing := [x for x in ids if x not in self.installed]:
            raise KeyError(f"plugins that aren't installed: {', '.join(missing)}")
        return Active([self.installed[x] for x in sorted(ids)])


def _parts(plugin: Plugin) -> Iterable[str]:
    yield from (f"analyzer:{x.id}" for x in plugin.analyzers)
    yield from (f"enricher:{x.id}" for x in plugin.enrichers)
    yield from (f"recognizer:{x}" for x in plugin.recognizers)


@dataclass
class Active:
    plugins: list[Plugin]

    def identity(self) -> str:
        """A digest of all active ids and versions, each with its length."""
        parts = [x for p in self.plugins for x in (p.id, p.version, *(f"{a.id} {a.version}" for a in (*p.analyzers, *p.enrichers)), *sorted(p.recognizers))]
        return hashlib.sha256("".join(f"{len(x.encode())}:{x}" for x in parts).encode()).hexdigest()

    def recognizers(self) -> dict:
        """What plugins recognize besides the built-in analyzer's, by name."""
        return {name: x for p in self.plugins for name, x in p.recognizers.items() if frameworks.RECOGNIZERS.get(name) is not x}

    def analyze(self, files: DataFrame, cache: FactCache | None = None) -> Analysis:
        """All active analyzers' facts together; the built-in one runs the plugins' recognizers, too."""
        out = None
        for analyzer in (a for p in self.plugins for a in p.analyzers):
            found = analyzer.analyze(files, self.recognizers(), cache) if isinstance(analyzer, BaselineAnalyzer) else analyzer.analyze(files)
            out = found if out is None else Analysis(*(getattr(out, k).unionByName(getattr(found, k)).distinct() for k in ("edges", "entities", "bound", "overrides", "diagnostics")))
        if out is None:
            raise ValueError("no active plugin analyzes files")
        return out

    def enrichers(self) -> list[WorkspaceEnricher]:
        return [e for p in self.plugins for e in p.enrichers]


class BaselineAnalyzer(WorkspaceAnalyzer):
    """The built-in frontends, with these recognizers."""

    id, version = "baseline", "2"

    def __init__(self, recognizers: tuple[str, ...] = tuple(frameworks.RECOGNIZERS)) -> None:
        self.recognizers = recognizers

    def analyze(self, files: DataFrame, own: dict | None = None, cache: FactCache | None = None) -> Analysis:
        return analyze_workspace(files, self.recognizers, own, cache)


def builtin() -> Registry:
    """A registry with the built-in plugin."""
    registry = Registry()
    registry.install(Plugin("baseline", "2", (BaselineAnalyzer(),), (), dict(frameworks.RECOGNIZERS)))
    return registry
