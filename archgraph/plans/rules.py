"""The views of a workspace state: which edges hold, after overrides.

Edges are sets of rows with the columns of ``schema.EDGE``; overrides of ``schema.OVERRIDE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEPENDENCY, EDGE_COLUMNS
from .shared import dealt_by, tasks_for

#: What an override names an edge by.
IDENTITY = ("from_id", "relation", "to_id", "evidence")


def dependency_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation").isin(*DEPENDENCY))


def gone(overrides: DataFrame) -> DataFrame:
    """``IDENTITY`` of the edges that overrides replace: same from, relation, unresolved target and evidence."""
    return overrides.select("from_id", "relation", F.col("unresolved_to").alias("to_id"), "evidence")


def masked(edges: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """``edges`` without those that an override replaces."""
    if overrides is None:
        return edges
    tasks = tasks_for(edges)
    return dealt_by(edges, tasks, *IDENTITY).join(dealt_by(gone(overrides), tasks, *IDENTITY), list(IDENTITY), "left_anti")


def override_edges(overrides: DataFrame) -> DataFrame:
    return overrides.select("from_id", "relation", F.col("resolved_to").alias("to_id"), "evidence", "confidence", "provenance")


def _union(states: DataFrame, overrides: DataFrame | None, revision: DataFrame | None, distinct: bool = True) -> DataFrame:
    out = masked(states, overrides).select(*EDGE_COLUMNS)
    if overrides is not None:
        out = out.union(override_edges(overrides).select(*EDGE_COLUMNS))
    if revision is not None:
        out = out.union(revision.select(*EDGE_COLUMNS))
    return dealt_by(out, tasks_for(out), *IDENTITY).distinct() if distinct else out


def direct_edges(states: DataFrame, overrides: DataFrame | None = None, revision: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """Edges that can be traversed: dependencies of the states but those overridden, the overrides, and all edges of the revision.

    Searches and merges don't mind repeated edges; without ``distinct`` none of them is shuffled.
    """
    return _union(dependency_edges(states), overrides, revision, distinct)


def effective_edges(states: DataFrame, overrides: DataFrame | None = None, revision: DataFrame | None = None) -> DataFrame:
    """As ``direct_edges``, with structural edges of the states."""
    return _union(states, overrides, revision)


def unmasked_edges(states: DataFrame, overrides: DataFrame | None = None, revision: DataFrame | None = None) -> DataFrame:
    """The effective edges, perhaps repeated, and those that overrides mask: with ``direct``, whether they can be traversed, and ``maskable``, as edges of the states are.

    No row is shuffled for it; who deals the edges out drops ``maskable`` ones that are ``gone``.
    """
    out = states.select(*EDGE_COLUMNS, F.col("relation").isin(*DEPENDENCY).alias("direct"), F.lit(True).alias("maskable"))
    if overrides is not None:
        out = out.union(override_edges(overrides).select(*EDGE_COLUMNS, F.lit(True), F.lit(False)))
    if revision is not None:
        out = out.union(revision.select(*EDGE_COLUMNS, F.lit(True), F.lit(False)))
    return out


def selected_states(observations: DataFrame, view_states: DataFrame) -> DataFrame:
    """The observations of a view's states; ``view_states`` has one row for each repository."""
    return observations.join(view_states.select("state").distinct(), "state", "left_semi").drop("state")
