"""The five graph queries: context, dependencies, impact, trace and why."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import rules
from ..plans.adjacency import Adjacency, Direction
from ..plans.deep import deep_closure
from ..plans.fixpoint import MAX_ROUNDS, Levels, closure, least_path, levels, seeds
from ..plans.shared import materialize
from ..schema import DEFAULT_MAX_HOPS, EDGE_COLUMNS


#: What searches and descriptions of nodes read of an edge.
LINK = ("from_id", "relation", "to_id", "provenance")


@dataclass
class Graph:
    """A view at one revision. ``revision`` edges hold whatever their relation.

    With an ``adjacency`` of the view's effective edges, what is at a node is read from there.
    """

    states: DataFrame
    overrides: DataFrame | None = None
    revision: DataFrame | None = None
    entities: DataFrame | None = None
    adjacency: Adjacency | None = None
    _links: DataFrame | None = None

    def clustered(self, root: str | None = None, first: str = "from_id") -> "Graph":
        """This graph with an adjacency, in the shared folder or at ``root``. Who walks backward names ``to_id`` as the end to cluster by ``first``."""
        gone = None if self.overrides is None else rules.gone(self.overrides)
        built = Adjacency.build(rules.unmasked_edges(self.states, self.overrides, self.revision), root, gone=gone, first=first)
        return Graph(self.states, self.overrides, self.revision, self.entities, built)

    def direct(self) -> DataFrame:
        return rules.direct_edges(self.states, self.overrides, self.revision)

    def links(self) -> DataFrame:
        """``LINK`` columns of the direct edges, perhaps repeated, as a table made once for a graph: its revision never changes."""
        if self._links is None:
            direct = rules.direct_edges(self.states, self.overrides, self.revision, distinct=False)
            self._links = materialize(direct.select(*LINK), "links")
        return self._links

    def forward(self) -> DataFrame | Direction:
        """The pairs along which dependencies are walked."""
        return self.links().select("from_id", "to_id") if self.adjacency is None else self.adjacency.forward

    def backward(self) -> DataFrame | Direction:
        """The pairs along which an impact is walked."""
        return self.links().selectExpr("to_id as from_id", "from_id as to_id") if self.adjacency is None else self.adjacency.backward

    def at(self, end: str, nodes: DataFrame) -> DataFrame:
        """The direct edges whose ``end`` is a ``node`` of ``nodes``, perhaps repeated."""
        if self.adjacency is not None:
            return self.adjacency.around(end, nodes).where("direct").select(*EDGE_COLUMNS)
        direct = rules.direct_edges(self.states, self.overrides, self.revision, distinct=False)
        return direct.join(nodes.select(F.col("node").alias(end)), end, "left_semi").select(*EDGE_COLUMNS)

    def links_at(self, end: str, nodes: DataFrame) -> DataFrame:
        """``LINK`` columns of the direct edges whose ``end`` is a ``node`` of ``nodes``."""
        found = self.links().join(nodes.select(F.col("node").alias(end)), end, "left_semi") if self.adjacency is None else self.at(end, nodes)
        return found.select(*LINK)

    def effective(self) -> DataFrame:
        return rules.effective_edges(self.states, self.overrides, self.revision)


class Answer:
    """``entries``: entity, hops. ``edges``: merged edges among the nodes. ``nodes``: described entities.

    Edges and nodes are worked out when first asked for: who reads distances alone doesn't
    pay for the numbering of edges, nor who reads nodes, where their ``links`` are given.
    """

    def __init__(self, entries: DataFrame, edges: Callable[[], DataFrame], nodes: Callable[[DataFrame], DataFrame], truncated: bool = False, links: Callable[[], DataFrame] | None = None) -> None:
        self.entries, self.truncated = entries, truncated
        self._edges, self._nodes, self._links = edges, nodes, links

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges()

    @cached_property
    def nodes(self) -> DataFrame:
        return self._nodes(self.edges if self._links is None else self._links())


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (from_id, to_id, relation): the highest confidence, and the sorted set of evidence."""
    ref = ids.evidence_ref(F.col("from_id"), F.col("to_id"), F.col("evidence"), F.col("provenance"))
    return edges.groupBy("from_id", "to_id", "relation").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set(ref)).alias("evidence"))


def with_edge_ids(merged: DataFrame) -> DataFrame:
    """Ids e1, e2, ... by (from_id, to_id, relation order).

    Ranges of that order are sorted apart, and each is numbered on from the rows of those
    before it: no task sees all edges. One row for each range is what the offsets are summed over.
    """
    order = ("from_id", "to_id", ids.relation_rank(F.col("relation")))
    spark = merged.sparkSession
    ranges = merged.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    # The id's upper bits are the range, and its lower 33 the place in it.
    placed = materialize(ranges.withColumn("_place", F.monotonically_increasing_id()), "placed")
    range_ = F.shiftright("_place", 33)
    sizes = placed.groupBy(range_.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    numbered = placed.join(F.broadcast(offsets), range_ == F.col("_range"))  # one row for each range
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return numbered.select(*merged.columns, F.concat(F.lit("e"), place).alias("edge_id"))


def with_ids_among(few: DataFrame, every: DataFrame) -> DataFrame:
    """``few`` merged edges, such as a path's, with the ids that they have among ``every`` edge: each one's place by count.

    An id is one more than the number of smaller edges, so none is sorted or written: each edge
    falls between two of the few, and those in between are counted.
    """
    rank = ids.relation_rank(F.col("relation")).alias("rank")
    marks = few.select("from_id", "to_id", rank).collect()  # of a path's edges
    x = F.struct("from_id", "to_id", rank)
    upto = sum(((F.struct(F.lit(m.from_id).alias("from_id"), F.lit(m.to_id).alias("to_id"), F.lit(m.rank).alias("rank")) <= x).cast("int") for m in marks), F.lit(0))
    counts = every.select("from_id", "to_id", "relation").distinct().groupBy(upto.alias("at")).agg(F.count("*").alias("n")).collect()  # one row more than marks
    place = F.lit(1)
    for r in counts:
        place = place + F.when(upto > r.at, r.n).otherwise(0)
    return few.withColumn("edge_id", F.concat(F.lit("e"), place.cast("string")))


def describe(nodes: DataFrame, edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``id, kind, metadata, name, repository, origin, test`` for each ``node``.

    A typed fact decides the kind; else the hint of highest priority among the edges. If a
    node has facts of two kinds, the largest is taken.
    """
    relation, here = F.col("relation"), F.col("id")
    hints = edges.select("relation", F.col("from_id").alias("id"), F.lit(True).alias("source")).union(edges.select("relation", "to_id", F.lit(False)))
    hints = hints.distinct().withColumn("kind", ids.kind_hint(relation, F.col("source"), here))
    hints = hints.groupBy("id").agg(F.max(F.struct(ids.kind_priority(F.col("kind")).alias("p"), "kind")).alias("hint"))
    made = edges.where("provenance = 'generated'" if "provenance" in edges.columns else "exists(evidence, e -> e.source_kind = 'generated')")
    made = made.where("relation in ('defines', 'field_of')").selectExpr("if(relation = 'defines', to_id, from_id) as id").distinct().withColumn("generated", F.lit(True))
    out = nodes.select(F.col("node").alias("id")).distinct().join(hints, "id", "left").join(made, "id", "left")
    if entities is not None:
        facts = entities.groupBy("id").agg(F.max(F.struct("kind", "metadata")).alias("fact"))
        out = out.join(facts, "id", "left")
    else:
        out = out.withColumn("fact", F.expr("cast(null as struct<kind: string, metadata: string>)"))
    return out.select(
        "id", F.coalesce(result_kind(F.col("fact.kind"), F.col("fact.metadata")), "hint.kind", ids.infer_kind(here)).alias("kind"), "fact.metadata",
        ids.entity_name(here).alias("name"), ids.repository(here).alias("repository"),
        F.when(F.col("generated"), "generated").otherwise(ids.origin(here)).alias("origin"), ids.is_test(here).alias("test"),
    )


def result_kind(kind, metadata):
    """A stored kind as results name it."""
    return (
        F.when(kind.isin("grpc_operation", "proto_method"), "rpc")
        .when((kind == "proto_type") & (metadata == "proto_type:enum"), "proto_enum")
        .when(kind == "proto_type", "proto_message")
        .otherwise(kind)
    )


def context(graph: Graph, root: str) -> Answer:
    """All edges at an entity, structural ones too."""
    if graph.adjacency is None:
        edges = graph.effective().where((F.col("from_id") == root) | (F.col("to_id") == root))
    else:
        edges = graph.adjacency.at("from_id", [root]).union(graph.adjacency.at("to_id", [root])).drop("direct").distinct()
    spark = edges.sparkSession
    ends = edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")).distinct()

    def nodes(merged: DataFrame) -> DataFrame:
        found = merged.select(F.col("from_id").alias("node")).union(merged.select("to_id")).union(seeds(spark, root)).distinct()
        return describe(found, merged, graph.entities)

    return Answer(ends.where(F.col("node") != root).select(F.col("node").alias("entity"), F.lit(1).alias("hops")), lambda: with_edge_ids(merge_edges(edges)), nodes)


def _answer(graph: Graph, start: str, edges: Callable[[], DataFrame], links: Callable[[], DataFrame], found: Levels) -> Answer:
    """An answer whose edges are numbered over all of ``edges()``, and then kept where both ends are reached; nodes are described by ``links()``, of the same edges."""

    def inside(rows: DataFrame) -> DataFrame:
        return rows.join(found.reached.selectExpr("node as from_id"), "from_id", "left_semi").join(found.reached.selectExpr("node as to_id"), "to_id", "left_semi")

    entries = found.reached.where(F.col("node") != start).select(F.col("node").alias("entity"), "hops")
    numbered = lambda: inside(with_edge_ids(merge_edges(edges())))
    return Answer(entries, numbered, lambda rows: describe(found.reached, rows, graph.entities), found.truncated, lambda: inside(links()))


def dependencies(graph: Graph, start: str, max_hops: int = DEFAULT_MAX_HOPS) -> Answer:
    """What an entity depends on, with distances.

    The distances are a search of ``max_hops`` levels, and one look beyond the last. Edges are
    numbered over the whole forward closure, which is searched when they are asked for.
    """
    if max_hops <= 0:
        raise ValueError("max_hops must be positive")
    pairs = graph.forward()
    start_ = seeds(pairs.sparkSession, start)
    found = levels(pairs, start_, max_hops)

    def every() -> DataFrame:
        """What lies beyond ``max_hops`` may be deep."""
        return deep_closure(pairs.pairs() if isinstance(pairs, Direction) else pairs, start_)

    return _answer(graph, start, lambda: graph.at("from_id", every() if found.truncated else found.reached), lambda: graph.links_at("from_id", found.reached), found)


def impact(graph: Graph, start: str, max_hops: int = DEFAULT_MAX_HOPS) -> Answer:
    """What a change of an entity can reach: the reverse closure, where an RPC operation's implementations follow it forward.

    An implementation edge of the revision, ``grpc://... implemented_by ...``, is taken with
    its operation, but adds nothing to the closure; in the distances such an edge is walked
    forward instead of backward. Where the closure has no such edge, its own levels are the distances.
    """
    if max_hops <= 0:
        raise ValueError("max_hops must be positive")
    pairs = graph.backward()
    spark = pairs.sparkSession
    every = levels(pairs, seeds(spark, start), MAX_ROUNDS).reached
    reached = every.select("node")
    forward = "relation = 'implemented_by' and startswith(from_id, 'grpc://')"
    rpc = None if graph.revision is None else graph.revision.where(forward)
    leaving = lambda: rpc.join(reached.selectExpr("node as from_id"), "from_id", "left_semi").select(*EDGE_COLUMNS)

    def taken() -> DataFrame:
        found = graph.at("to_id", reached)
        return found if rpc is None else found.union(leaving()).distinct()

    links = graph.links_at("to_id", reached)
    if rpc is not None:
        links = links.union(leaving().select(*LINK))
    if links.where(forward).isEmpty():
        beyond = every.where(F.col("hops") > max_hops)
        return _answer(graph, start, taken, lambda: links, Levels(every.where(F.col("hops") <= max_hops), not beyond.isEmpty()))
    steps = links.selectExpr(f"if({forward}, from_id, to_id) as from_id", f"if({forward}, to_id, from_id) as to_id")
    steps = materialize(steps.distinct(), "steps")
    return _answer(graph, start, taken, lambda: links, levels(steps, seeds(spark, start), max_hops))


def trace(graph: Graph, source: str, target: str, max_hops: int = DEFAULT_MAX_HOPS) -> Answer:
    """One shortest path: of those of least length the smallest node sequence, and of parallel edges the first relation.

    ``edges`` has a column ``step`` from 1; ``entries`` are the path's nodes by distance. An
    entity always has the empty path to itself. Without a path only the two ends are nodes.
    """
    if max_hops <= 0:
        raise ValueError("max_hops must be positive")
    pairs = graph.forward()
    spark = pairs.sparkSession
    if source == target:
        nodes = seeds(spark, source)
        none = lambda: merge_edges(graph.direct().where("false")).withColumn("edge_id", F.lit("")).withColumn("step", F.lit(0))
        return Answer(nodes.select(F.col("node").alias("entity"), F.lit(0).alias("hops")), none, lambda merged: describe(nodes, merged, graph.entities))
    found = least_path(pairs, source, target, max_hops)
    steps = found.path.select(F.posexplode("nodes").alias("hops", "entity"))

    def edges() -> DataFrame:
        # A path has at most max_hops steps.
        hops = steps.withColumn("next", F.lead("entity").over(Window.orderBy("hops"))).where("next is not null")
        merged = merge_edges(graph.at("from_id", hops.select(F.col("entity").alias("node"))))
        joined = merged.join(hops, (merged.from_id == hops.entity) & (merged.to_id == hops.next))
        first = Window.partitionBy("from_id", "to_id").orderBy(ids.relation_rank(F.col("relation")))
        path = joined.withColumn("_first", F.row_number().over(first)).where("_first = 1").select(*merged.columns, (F.col("hops") + 1).alias("step"))
        return with_ids_among(path, graph.at("from_id", closure(pairs, seeds(spark, source))))

    nodes = steps.select(F.col("entity").alias("node")).union(seeds(spark, source, target)).distinct()
    return Answer(steps.select("entity", "hops"), edges, lambda path: describe(nodes, path, graph.entities), found.truncated)


#: A trace that is read for its evidence.
why = trace


def visibility(nodes: DataFrame, include_tests: bool = False) -> DataFrame:
    """``nodes`` with how prominently each is shown: primary, supporting or hidden."""
    shown = (
        F.when(F.col("test") & F.lit(not include_tests), "hidden").when(F.col("origin") != "source", "supporting")
        .when(F.col("kind").isin("namespace", "proto_file"), "hidden").otherwise("primary")
    )
    return nodes.withColumn("visibility", shown)


def project_path(answer: Answer, include_tests: bool = False) -> DataFrame:
    """A trace's steps between shown nodes: hidden ones are skipped and lend their evidence to the next shown one.

    ``step, to_id, relation, confidence, evidence``: the last edge's relation, the least
    confidence and the sorted evidence of the run; the end is always shown.
    """
    shown = visibility(answer.nodes, include_tests).select(F.col("id").alias("to_id"), (F.col("visibility") == "primary").alias("shown"))
    rows = answer.edges.join(shown, "to_id", "left")
    by_step = Window.orderBy("step")
    last = F.max("step").over(Window.partitionBy())
    rows = rows.withColumn("stop", F.when(F.coalesce("shown", F.lit(True)) | (F.col("step") == last), 1).otherwise(0))
    rows = rows.withColumn("run", F.coalesce(F.sum("stop").over(by_step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.groupBy("run").agg(
        F.max_by("to_id", "step").alias("to_id"), F.max_by("relation", "step").alias("relation"), F.min("confidence").alias("confidence"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    ).select((F.col("run") + 1).alias("step"), "to_id", "relation", "confidence", "evidence")


def impact_groups(answer: Answer, include_tests: bool = False) -> DataFrame:
    """Affected entities by 'direct' (one hop) or kind: ``grp, n, hidden_tests``."""
    rows = answer.entries.join(answer.nodes, answer.entries.entity == answer.nodes.id)
    shown = F.lit(include_tests) | ~F.col("test")
    group = F.when(F.col("hops") == 1, "direct").otherwise(F.col("kind"))
    return rows.groupBy(group.alias("grp")).agg(F.count_if(shown).alias("n"), F.count_if(~shown).alias("hidden_tests"))


def labels(nodes: DataFrame) -> DataFrame:
    """``id, label``: repository, scope and name; among equal labels the shortest scope suffix that tells them apart.

    Suffixes of each width are rows; one of its width that only one node has is unique, as
    a window over the suffix shows, without pairs of peers.
    """
    here, name = F.col("id"), F.col("name")
    repo = F.coalesce("repository", F.lit("cross-repository"))
    scoped = nodes.select("id", "name", repo.alias("repo"), F.coalesce(ids.symbol_scope(here, name), F.expr("cast(array() as array<string>)")).alias("scope"))
    dot = F.lit(" · ")
    last = F.try_element_at("scope", F.lit(-1))
    base = scoped.withColumn("base", F.concat("repo", dot, F.coalesce(F.concat(last, dot), F.lit("")), "name"))
    base = base.withColumn("peers", F.count("*").over(Window.partitionBy("base")))
    alone = base.where("peers = 1").select("id", F.col("base").alias("label"))
    wide = base.where("peers > 1").select("*", F.explode(F.expr("if(size(scope) > 0, sequence(1, size(scope)), array(0))")).alias("width"))
    wide = wide.withColumn("suffix", F.expr("if(width = 0, '', array_join(slice(scope, -width, width), '/'))"))
    wide = wide.withColumn("same", F.count("*").over(Window.partitionBy("base", "width", "suffix")))
    pick = wide.groupBy("id", "repo", "name").agg(F.min(F.when((F.col("same") == 1) & (F.col("width") > 0), F.struct("width", "suffix"))).alias("best"))
    apart = pick.select("id", F.when(F.col("best").isNotNull(), F.concat("repo", dot, "best.suffix", dot, "name")).otherwise(F.concat("repo", dot, "id")).alias("label"))
    return alone.union(apart)
