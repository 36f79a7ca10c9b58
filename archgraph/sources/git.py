"""Git repositories as a scan finds them: identity, head and working trees, read from the files of ``.git``.

These are a handful of small files of the machine that indexes, so the driver reads them.
"""

from __future__ import annotations

import configparser
import hashlib
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WorkingTree:
    path: str
    head: str | None
    branch: str | None


@dataclass(frozen=True)
class Topology:
    """One clone: its identity, the directory that its working trees share, and those trees by path."""

    identity: str
    common: str
    trees: tuple[WorkingTree, ...]

    def around(self, place: str | Path) -> WorkingTree | None:
        """The deepest working tree that holds a place."""
        here = Path(place).resolve()
        found = [t for t in self.trees if here.is_relative_to(t.path)]
        return max(found, key=lambda t: len(Path(t.path).parts), default=None)


def _text(path: Path) -> str | None:
    return path.read_text("utf-8", "replace").strip() if path.is_file() else None


def _directory(root: Path) -> Path | None:
    """The ``.git`` directory around a place; a working tree's ``.git`` file names its own."""
    for place in (root, *root.parents):
        dot = place / ".git"
        if dot.is_dir():
            return dot
        if (named := _text(dot)) and named.startswith("gitdir:"):
            return (place / named.removeprefix("gitdir:").strip()).resolve()
    return None


def _commit(common: Path, head: str | None) -> tuple[str | None, str | None]:
    """(commit, branch) that a HEAD file's text names."""
    if head is None or not head.startswith("ref:"):
        return head, None
    name = head.removeprefix("ref:").strip()
    commit = _text(common / name)
    if commit is None:
        packed = re.search(rf"^([0-9a-f]+) {re.escape(name)}$", _text(common / "packed-refs") or "", re.M)
        commit = packed and packed[1]
    return commit, name.removeprefix("refs/heads/")


def _remote(common: Path) -> str | None:
    """The fetch remote's url: origin's, else the first one's."""
    parser = configparser.RawConfigParser(strict=False, allow_no_value=True, interpolation=None)
    parser.read_string("\n".join(line.strip() for line in (_text(common / "config") or "").splitlines()))
    urls = {s: parser[s].get("url") for s in parser.sections() if s.startswith('remote "')}
    return urls.get('remote "origin"') or next((u for _, u in sorted(urls.items()) if u), None)


def remote_identity(url: str | None, path: str) -> str:
    """As ``files.repository_identity``, for one repository."""
    if not url:
        return f"local://{hashlib.sha256(path.encode()).hexdigest()}"
    bare = re.sub(r"^[^@/]+@", "", re.sub(r"^[a-z+]+://", "", url))
    return re.sub(r"(\.git)?/?$", "", re.sub(r"^([^/:]+):(?!\d+/)", r"\1/", bare), count=1)


def topology(root: str | Path) -> Topology | None:
    """The clone around a place; None outside of one. Working trees whose directory is gone are left out."""
    own = _directory(Path(root).resolve())
    if own is None:
        return None
    shared = _text(own / "commondir")
    common = (own / shared).resolve() if shared else own
    trees = []
    if common.name == ".git":
        trees.append(WorkingTree(str(common.parent), *_commit(common, _text(common / "HEAD"))))
    for entry in sorted((common / "worktrees").glob("*")) if (common / "worktrees").is_dir() else []:
        dot = _text(entry / "gitdir")
        if dot and Path(dot).exists():
            trees.append(WorkingTree(str(Path(dot).parent.resolve()), *_commit(common, _text(entry / "HEAD"))))
    return Topology(remote_identity(_remote(common), str(common.parent)), str(common), tuple(sorted(trees, key=lambda t: t.path)))


def choose_trees(places: DataFrame, trees: DataFrame) -> DataFrame:
    """``places`` (column place) with ``tree``: the deepest working tree at or above it that isn't prunable. ``trees``: tree, prunable."""
    from ..operators.resolve import longest_prefix

    return longest_prefix(places, "place", trees.where(~F.col("prunable")), "tree")
