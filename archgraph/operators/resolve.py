"""Resolvers: joins on names and keys that take a target only where it is the only candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.fixpoint import all_pairs_closure, fixpoint
from ..plans.shared import dealt_by, materialize, tasks_for
from ..schema import EXACT, INFERRED


def only_value(rows: DataFrame, keys: list[str], value: str, alias: str = "only") -> DataFrame:
    """The one distinct ``value`` of each key that has exactly one; other keys are dropped."""
    return rows.groupBy(*keys).agg(F.min(value).alias(alias), F.max(value).alias("_max")).where(F.col(alias) == F.col("_max")).drop("_max")


def unique_name_overrides(edges: DataFrame, definitions: DataFrame, prefix: str = "rust-call://") -> DataFrame:
    """Overrides for unresolved calls whose name ends exactly one definition of the repository.

    ``definitions``: repository, id. A call's repository is its source's.
    """
    names = only_value(definitions.withColumn("name", F.substring_index("id", "/", -1)), ["repository", "name"], "id", "resolved_to")
    calls = edges.where(F.col("to_id").startswith(prefix)).withColumn("name", F.substring_index("to_id", "/", -1)).withColumn("repository", ids.repository(F.col("from_id")))
    return calls.join(names, ["repository", "name"]).select(
        "from_id", "relation", F.col("to_id").alias("unresolved_to"), "resolved_to", "evidence", F.lit(INFERRED).alias("confidence"), F.lit("unique_name_heuristic").alias("provenance")
    )


def resolve_grpc(candidates: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, diagnostics) of RPC candidates.

    ``candidates``: schema.GRPC_CANDIDATE. ``methods``: service, method, cardinality. A unary
    candidate with a contract makes an operation entity, its tie to the contract, and an edge
    from a client or to a server; others make a diagnostic.
    """
    unary = candidates.where("cardinality = 'unary'")
    contracts = methods.select("service", "method", "cardinality").distinct().withColumn("known", F.lit(True))
    joined = unary.join(contracts, ["service", "method", "cardinality"], "left")
    path = F.concat("service", F.lit("/"), "method")
    hit = joined.where("known").withColumn("operation", F.concat(F.lit("grpc://"), path)).withColumn("contract", F.concat(F.lit("proto-method://"), path))
    entities = hit.select(F.col("operation").alias("id"), F.lit("grpc_operation").alias("kind"), F.concat(F.lit("rpc_cardinality:"), "cardinality").alias("metadata")).distinct()
    bound = hit.select(F.col("operation").alias("from_id"), F.lit("binds_contract").alias("relation"), F.col("contract").alias("to_id"), "evidence", "confidence", "provenance")
    client = hit.where("role = 'client'").select(F.col("local_symbol").alias("from_id"), F.lit("calls_rpc").alias("relation"), F.col("operation").alias("to_id"), "evidence", "confidence", "provenance")
    server = hit.where("role = 'server'").select(F.col("operation").alias("from_id"), F.lit("implemented_by").alias("relation"), F.col("local_symbol").alias("to_id"), "evidence", "confidence", "provenance")
    keys = ["local_symbol", "role", "service", "method", "evidence"]
    unmatched = joined.where("known is null").select(*keys, F.lit("grpc.contract_unmatched").alias("code"))
    unsupported = candidates.where("cardinality <> 'unary'").select(*keys, F.lit("grpc.cardinality_unsupported").alias("code"))
    return entities, bound.union(client).union(server).distinct(), unmatched.union(unsupported).distinct()


def bind_graphql(resolvers: DataFrame, fields: DataFrame) -> DataFrame:
    """``resolved_by`` edges from fields to resolvers: by (parent, field), else by the field's name where it is the repository's only one.

    ``resolvers``: repository, field, parent (nullable), resolver, evidence. ``fields``:
    repository, parent, field, id.
    """
    exact = fields.select("repository", "parent", "field", F.col("id").alias("exact_id")).distinct()
    alone = only_value(fields, ["repository", "field"], "id", "alone_id")
    joined = resolvers.join(exact, ["repository", "parent", "field"], "left").join(alone, ["repository", "field"], "left")
    found = joined.withColumn("field_id", F.when(F.col("parent").isNotNull(), F.col("exact_id")).otherwise(F.col("alone_id"))).where("field_id is not null")
    return found.select(F.col("field_id").alias("from_id"), F.lit("resolved_by").alias("relation"), F.col("resolver").alias("to_id"), "evidence", F.lit(EXACT).alias("confidence"), F.lit("ast").alias("provenance"))


def prefixes(text: Column, separator: str = "/") -> Column:
    """Each prefix of ``text`` that ends before a separator, and the text itself, as an array."""
    parts = F.split(text, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def longest_prefix(rows: DataFrame, key: str, owners: DataFrame, owner: str, separator: str = "/") -> DataFrame:
    """``rows`` with ``owner``: the longest owner that is the key or a prefix of it at a separator; else null.

    The key's prefixes are rows of their own, so the match is an equality join and not a
    comparison of all pairs.
    """
    # Equal rows share one lookup.
    looked = rows.select(key).distinct().select(key, F.explode(prefixes(F.col(key), separator)).alias(owner))
    best = looked.join(owners.select(owner).distinct(), owner).groupBy(key).agg(F.max_by(owner, F.length(owner)).alias(owner))
    return rows.join(best, key, "left")


def entity_owner(ids_: DataFrame, facts: DataFrame, repositories: DataFrame) -> DataFrame:
    """``id, repository``: of the entity's facts where they agree on one, else the longest ``repo://R/`` prefix."""
    known = only_value(facts, ["id"], "repository", "fact_repository")
    owners = repositories.select(F.concat(F.lit("repo://"), "repository").alias("owner"))
    found = longest_prefix(ids_.select("id"), "id", owners, "owner").join(known, "id", "left")
    return found.select("id", F.coalesce("fact_repository", F.regexp_replace("owner", "^repo://", "")).alias("repository"))


#: So many pieces of evidence stand beside a pair of repositories; ``repository_evidence`` has all.
EVIDENCE_SHOWN = 20


def repository_graph(edges: DataFrame, owners: DataFrame, analyzer: str = "baseline") -> DataFrame:
    """``from_repository, to_repository`` with the sorted sets of analyzers and kinds, the number of pieces of evidence and the first of them; edges inside one are skipped.

    ``owners``: id, repository. An edge's kind is a resolution override where its provenance is heuristic or compiled.
    """
    kind = F.when(F.col("provenance").isin("unique_name_heuristic", "compiler"), "resolution_override").otherwise("semantic_observation")
    tied = edges.join(owners.selectExpr("id as from_id", "repository as from_repository"), "from_id").join(owners.selectExpr("id as to_id", "repository as to_repository"), "to_id")
    tied = tied.where("from_repository <> to_repository").withColumn("kind", kind)
    each = tied.select("from_repository", "to_repository", "kind", "evidence").distinct()
    # Two steps, the first over parts of a pair's evidence: no task gathers all evidence of two large repositories.
    pair = ["from_repository", "to_repository"]
    parts = each.groupBy(*pair, F.pmod(F.xxhash64("evidence"), F.lit(1024)).alias("_part")).agg(
        F.collect_set("kind").alias("kinds"), F.count_distinct("evidence").alias("n"), F.slice(F.sort_array(F.collect_set("evidence")), 1, EVIDENCE_SHOWN).alias("evidence")
    )
    return parts.groupBy(*pair).agg(
        F.array(F.lit(analyzer)).alias("analyzers"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.sum("n").alias("n_evidence"),
        F.slice(F.sort_array(F.flatten(F.collect_list("evidence"))), 1, EVIDENCE_SHOWN).alias("evidence"),
    )


def repository_evidence(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``from_repository, to_repository, evidence``: each piece of evidence between two repositories, as rows."""
    tasks = tasks_for(edges)
    tied = edges.select("from_id", "to_id", "evidence")
    for end in ("from_id", "to_id"):
        owned = owners.selectExpr(f"id as {end}", f"repository as {end.removesuffix('id')}repository")
        tied = dealt_by(tied, tasks, end).join(dealt_by(owned, tasks, end), end)
    found = tied.where("from_repository <> to_repository").select("from_repository", "to_repository", "evidence")
    return dealt_by(found, tasks, *found.columns).distinct()


def neighbours(repo_graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(direct context of each repository, repositories that each one affects): one hop, on purpose."""
    context = repo_graph.groupBy(F.col("from_repository").alias("repository")).agg(F.sort_array(F.collect_set("to_repository")).alias("context"))
    affected = repo_graph.groupBy(F.col("to_repository").alias("repository")).agg(F.sort_array(F.collect_set("from_repository")).alias("affected"))
    return context, affected


def first_existing(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The first existing candidate file of each import. ``imports``: key, candidates (ordered array). ``files``: path."""
    tried = imports.select("key", F.posexplode("candidates").alias("at", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("key").agg(F.min_by("path", "at").alias("path"))


# Endings of an imported module's file, in the order they are tried.
IMPORT_ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx")


def import_candidates(base: Column, endings: tuple[str, ...] = IMPORT_ENDINGS) -> Column:
    """Paths that an import of ``base`` may mean: a source file itself, else with each ending, or an index file inside."""
    tried = F.array(*(F.concat(base, F.lit(e)) for e in endings), *(F.concat(base, F.lit(f"/index{e}")) for e in endings))
    return F.when(base.rlike(r"\.(js|jsx|ts|tsx)$"), F.array(base)).otherwise(tried)


def expand_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """``key, path``: a specifier with its longest fitting alias replaced. ``imports``: key, specifier; ``aliases``: prefix (up to a slash), target."""
    parts = F.split("specifier", "/")
    tried = imports.where("instr(specifier, '/') > 0").select("key", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))).alias("prefix"))
    rest = F.expr("substring(specifier, length(prefix) + 1)")
    return tried.join(aliases, "prefix").groupBy("key").agg(F.max_by(F.concat("target", rest), F.length("prefix")).alias("path"))


def best_overloads(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """The one best overload of each call.

    ``calls``: call_id, name, arguments (array). ``candidates``: name, target, parameters
    (array), optional (count). A candidate fits by its number of parameters; its score is how
    many argument types equal the parameter's. Ties for the best score leave the call unresolved.
    """
    joined = calls.join(candidates, "name").where("size(arguments) between size(parameters) - optional and size(parameters)")
    scored = joined.withColumn("score", F.expr("aggregate(zip_with(arguments, parameters, (a, p) -> if(a <=> p and a is not null, 1, 0)), 0, (t, x) -> t + x)"))
    best = Window.partitionBy("call_id").orderBy(F.desc("score"))
    ranked = scored.withColumn("rank", F.rank().over(best)).where("rank = 1").withColumn("n", F.count("*").over(Window.partitionBy("call_id")))
    return ranked.where("n = 1").select("call_id", "name", "target", "score")


def elixir_modules(edges: DataFrame) -> DataFrame:
    """Overrides of references to Elixir modules that exactly one definition of the workspace bears the name of."""
    symbol = F.regexp_extract("to_id", "/elixir/([^/]*)$", 1)
    alone = only_value(edges.where("relation = 'defines'").select(symbol.alias("name"), F.col("to_id").alias("id")).where("name <> ''"), ["name"], "id", "resolved_to")
    asked = edges.where("relation in ('implements', 'imports', 'requires', 'uses') and to_id like 'elixir-module://%'").withColumn("name", F.regexp_replace("to_id", "^elixir-module://", ""))
    return asked.join(alone, "name").select("from_id", "relation", F.col("to_id").alias("unresolved_to"), "resolved_to", "evidence", F.lit(EXACT).alias("confidence"), F.lit("ast").alias("provenance")).distinct()


def elixir_calls(code: DataFrame) -> DataFrame:
    """``from_id, relation, to_id, evidence, resolved`` of Elixir calls: by module and arity, and local ones through the one import that takes them.

    What such an import's module doesn't define in the repository is named as a call of that module.
    """
    code = code.where(F.col("path").rlike(r"\.exs?$"))
    symbol = lambda c: F.regexp_extract(c, "^.*/elixir/(.*)$", 1)
    known = code.where("relation = 'defines'").select("repository", symbol("to_id").alias("symbol"), F.col("to_id").alias("id")).where("instr(symbol, '/') > 0")
    known = only_value(known, ["repository", "symbol"], "id", "resolved")
    keys = ["repository", "from_id", "relation", "to_id", "evidence"]
    calls = code.where("relation = 'calls' and to_id like 'elixir-call://%'").select(*keys, F.regexp_replace("to_id", "^elixir-call://", "").alias("symbol")).distinct()
    remote = calls.where("size(split(symbol, '/')) > 2").join(known, ["repository", "symbol"]).select(*keys[1:], "resolved")
    taken = code.where("sort = 'import'").select("repository", F.col("from_id").alias("scope"), F.col("id").alias("module"), F.from_json("provenance", "only array<string>, except array<string>").alias("f")).distinct()
    # An import holds in a whole module or in one function.
    scopes = F.explode(F.array("from_id", F.regexp_replace("from_id", "/[^/]*/[^/]*$", ""))).alias("scope")
    local = calls.where("size(split(symbol, '/')) = 2").select(*keys, "symbol", scopes).join(taken, ["repository", "scope"])
    local = local.where("(f.only is null or array_contains(f.only, symbol)) and not array_contains(f.except, symbol)").withColumn("symbol", F.concat("module", F.lit("/"), "symbol"))
    imported = only_value(local, keys, "symbol", "symbol").join(known, ["repository", "symbol"], "left")
    return remote.union(imported.select(*keys[1:], F.coalesce("resolved", F.concat(F.lit("elixir-call://"), "symbol")).alias("resolved")))


def macro_uses(code: DataFrame) -> DataFrame:
    """Generated edges of Elixir modules that use another's ``__using__``: what it defines, calls and implements there.

    The macro's module is the only one of its name in the repository; what a module defines
    itself it isn't given again.
    """
    made = code.where("sort in ('using_defines', 'using_calls', 'using_implements')").select("repository", "path", "sort", F.col("id").alias("macro"), F.col("kind").alias("function"), F.col("to_id").alias("target"), "evidence")
    made = made.join(only_value(made, ["macro"], "path", "path"), ["macro", "path"])
    uses = code.where("sort = 'edge' and relation = 'uses' and to_id like 'elixir-module://%'")
    uses = uses.select("repository", F.col("from_id").alias("module"), F.concat(F.lit("repo://"), "repository", F.lit("/elixir/"), F.regexp_replace("to_id", "^elixir-module://", "")).alias("macro")).distinct()
    met = uses.join(made.drop("repository", "path"), "macro")
    own = code.where("sort = 'edge' and relation = 'defines'").select(F.col("from_id").alias("module"), F.col("to_id").alias("id")).distinct()
    given = met.where("sort = 'using_defines'").withColumn("id", F.concat("module", F.lit("/"), "function")).join(own, ["module", "id"], "left_anti")
    # Where two macros give one function, the one of the smaller evidence does.
    given = given.groupBy("module", "id", "function").agg(F.min(F.struct("evidence", "macro")).alias("x")).select("module", "id", "function", "x.*")
    edge = lambda source, relation, target, confidence: (source.alias("from_id"), F.lit(relation).alias("relation"), target.alias("to_id"), "evidence", confidence.alias("confidence"), F.lit("generated").alias("provenance"))
    defines = given.select(*edge(F.col("module"), "defines", F.col("id"), F.lit(EXACT)))
    calls = met.where("sort = 'using_calls'").join(given.select("module", "macro", "function", "id"), ["module", "macro", "function"])
    known = own.select("id").union(given.select("id")).distinct().withColumnRenamed("id", "known")
    local = F.when(~F.col("target").contains("://"), F.concat("module", F.lit("/"), "target"))
    calls = calls.withColumn("local", local).join(known, F.col("local") == F.col("known"), "left")
    to = F.coalesce("known", F.when(F.col("local").isNotNull(), F.concat(F.lit("elixir-call://"), "target")).otherwise(F.col("target")))
    called = calls.select(*edge(F.col("id"), "calls", to, F.when(F.col("known").isNotNull(), EXACT).otherwise(INFERRED)))
    implements = met.where("sort = 'using_implements'").select(*edge(F.col("module"), "implements", F.col("target"), F.lit(EXACT)))
    return defines.union(called).union(implements).distinct()


#: Kinds of compiler events that are calls, and the relations of those that name a module. Fixed values.
EVENT_CALLS = ("imported_function", "imported_macro", "local_function", "local_macro", "remote_function", "remote_macro")
EVENT_RELATIONS = {"import": "imports", "require": "requires", "alias": "uses", "alias_expansion": "uses", "alias_reference": "uses", "struct_expansion": "uses"}


def compiler_observations(events: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, entities) of a compiler's events.

    ``events``: ordinal, repository, kind, file, line, caller_module, caller_function
    (name/arity), target, function (name/arity), from_macro, definitions (array of
    name/arity, of a module's event). ``sources``: repository, path. Events outside the
    sources are no evidence; of a module's events the last counts; a caller without module is its file.
    """
    placed = events.join(sources.selectExpr("repository", "path as file").distinct(), ["repository", "file"], "left_semi")
    modules = placed.where("kind = 'module' and target is not null").groupBy("repository", "target").agg(F.max_by("definitions", "ordinal").alias("definitions"))
    module_id = lambda m: F.concat(F.lit("repo://"), "repository", F.lit("/elixir/"), m)
    callables = modules.select("repository", F.col("target").alias("module"), F.explode("definitions").alias("function")).distinct()
    entities = modules.select(module_id("target").alias("id"), F.lit("namespace").alias("kind"), F.lit("").alias("metadata"))
    entities = entities.union(callables.select(F.concat(module_id("module"), F.lit("/"), "function"), F.lit("callable"), F.lit("")))
    kind = F.col("kind")
    relation = F.when(kind.isin(*EVENT_CALLS), "calls")
    for name, value in EVENT_RELATIONS.items():
        relation = relation.when(kind == name, value)
    rows = placed.withColumn("relation", relation).where("relation is not null")
    caller = F.when(F.col("caller_module").isNull(), F.concat(F.lit("repo://"), "repository", F.lit("/elixir-source/"), "file")).otherwise(F.concat(module_id("caller_module"), F.coalesce(F.concat(F.lit("/"), "caller_function"), F.lit(""))))
    callee = F.when(kind.isin("local_function", "local_macro"), F.col("caller_module")).otherwise(F.col("target"))
    rows = rows.withColumn("from_id", caller).withColumn("module", F.when(F.col("relation") == "calls", callee).otherwise(F.col("target"))).where("module is not null")
    rows = rows.join(callables.withColumn("defined", F.lit(True)), ["repository", "module", "function"], "left")
    rows = rows.join(modules.select("repository", F.col("target").alias("module"), F.lit(True).alias("here")), ["repository", "module"], "left")
    called = F.when(F.col("defined"), F.concat(module_id("module"), F.lit("/"), "function")).otherwise(F.concat(F.lit("elixir-call://"), "module", F.lit("/"), "function"))
    named = F.when(F.col("here"), module_id("module")).when(F.col("module").startswith(":"), F.concat(F.lit("erlang-module://"), F.ltrim("module", F.lit(":")))).otherwise(F.concat(F.lit("elixir-module://"), "module"))
    place = F.concat("file", F.when(F.coalesce("line", F.lit(0)) == 0, "").otherwise(F.concat(F.lit(":"), F.col("line").cast("string"))))
    macro = F.coalesce("from_macro", F.lit(False))
    evidence = F.concat(place, F.lit(" (compiler "), "kind", F.when(macro, " via macro expansion").otherwise(""), F.lit(")"))
    to = F.when(F.col("relation") == "calls", called).otherwise(named)
    return rows.select("from_id", "relation", to.alias("to_id"), evidence.alias("evidence"), F.when(macro, INFERRED).otherwise(EXACT).alias("confidence"), F.lit("compiler").alias("provenance")).distinct(), entities


def csharp_calls(code: DataFrame) -> DataFrame:
    """``calls`` edges of C# calls that fit exactly one method of the repository.

    A plain or ``this`` call means a method of the caller's type, a constructor one of the
    named type, and another member one of the type its receiver is declared as or names, of
    their bases, or an extension of the declared type. Each is an equality join on the
    method's name and its owner.
    """
    simple = lambda id_: F.element_at(F.split(id_, "/"), -1)
    qualified = lambda id_: F.regexp_extract(id_, r"\.cs/(.*)$", 1)
    described = F.from_json("provenance", "types array<string>, optional int, extension boolean")
    methods = code.where("sort = 'method'").select("repository", F.col("kind").alias("name"), F.col("id").alias("target"), F.col("from_id").alias("type"), described.alias("d"))
    owner = F.array(F.concat(F.lit("q:"), qualified(F.col("type"))), F.concat(F.lit("s:"), simple(F.col("type"))), F.when(F.col("d.extension"), F.concat(F.lit("x:"), F.col("d.types")[0])))
    filed = methods.select("repository", "name", "target", "d", F.explode(F.array_compact(owner)).alias("owner"))
    calls = code.where("sort = 'call'").select(
        "repository", F.col("id").alias("name"), "kind", "from_id", F.col("relation").alias("receiver"), F.col("to_id").alias("declared"), "evidence",
        F.from_json("provenance", "array<string>").alias("arguments"), F.md5(F.concat_ws("\n", "from_id", "id", "kind", "relation", "to_id", "evidence", "provenance")).alias("call_id"),
    ).distinct()
    own = F.concat(F.lit("q:"), qualified(F.regexp_replace("from_id", r"/[^/]*\([^()]*\)$", "")))
    inside = calls.where("kind = 'direct' or kind = 'member' and receiver = 'this'").select("call_id", "repository", "name", own.alias("owner"))
    made = calls.where("kind = 'constructor'").select("call_id", "repository", "name", F.concat(F.lit("s:"), "name").alias("owner"))
    # What a receiver may stand for: its declared type and the type it names, and the bases of both.
    member = calls.where("kind = 'member' and receiver <> 'this'")
    stands = member.select("call_id", "repository", "name", F.col("declared").alias("type"), F.lit(True).alias("typed")).where("type <> ''")
    stands = stands.union(member.select("call_id", "repository", "name", F.substring_index("receiver", ".", -1), F.lit(False)))
    bases = code.where("sort = 'base'").select(F.concat("repository", F.lit("\n"), simple(F.col("id"))).alias("from_id"), F.concat("repository", F.lit("\n"), "to_id").alias("to_id")).distinct()
    inherited = base_types(bases).select(*(F.element_at(F.split(c, "\n"), k).alias(n) for c, k, n in (("from_id", 1, "repository"), ("from_id", 2, "type"), ("to_id", 2, "base"))))
    wide = stands.union(stands.join(inherited, ["repository", "type"]).select("call_id", "repository", "name", F.col("base").alias("type"), "typed"))
    through = wide.select("call_id", "repository", "name", F.explode(F.array_compact(F.array(F.concat(F.lit("s:"), "type"), F.when(F.col("typed"), F.concat(F.lit("x:"), "type"))))).alias("owner"))
    met = inside.union(made).union(through).join(filed, ["repository", "name", "owner"]).join(calls.select("call_id", "kind"), "call_id")
    # An extension's first parameter is the receiver.
    shift = F.when(F.col("d.extension") & (F.col("kind") == "member"), 1).otherwise(0)
    types = F.slice(F.col("d.types"), shift + 1, F.size("d.types"))
    fits = met.select(F.col("call_id").alias("name"), "target", types.alias("parameters"), F.col("d.optional").alias("optional")).distinct()
    best = best_overloads(calls.selectExpr("call_id", "call_id as name", "arguments"), fits)
    found = calls.join(best.select("call_id", "target"), "call_id")
    return found.select("from_id", F.lit("calls").alias("relation"), F.col("target").alias("to_id"), "evidence", F.lit(EXACT).alias("confidence"), F.lit("ast").alias("provenance")).distinct()


def visible_assemblies(references: DataFrame) -> DataFrame:
    """Each assembly with all it sees: itself and its transitive project references."""
    return all_pairs_closure(references, reflexive=True)


def base_types(extends: DataFrame) -> DataFrame:
    """Each subtype with all its bases, over ``from_id`` extends ``to_id``."""
    return all_pairs_closure(extends)


def reexport_origins(exports: DataFrame, reexports: DataFrame) -> DataFrame:
    """``file, name, origin_file, origin_name``: where an exported name is defined, through re-exports and stars.

    ``exports``: file, name, and origin_name where a definition has another one. ``reexports``:
    file, name, source_file, source_name; a name of ``*`` passes on every name but default.
    """
    seed = exports.selectExpr("file", "name", "file as origin_file", "origin_name" if "origin_name" in exports.columns else "name as origin_name")
    named = reexports.where("name <> '*'").selectExpr("file as f", "name as n", "source_file", "source_name")
    star = reexports.where("name = '*'").selectExpr("file as f", "source_file")

    def step(new: DataFrame) -> DataFrame:
        by_name = new.join(named, (new.file == named.source_file) & (new.name == named.source_name)).selectExpr("f as file", "n as name", "origin_file", "origin_name")
        by_star = new.where("name <> 'default'").join(star, new.file == star.source_file).selectExpr("f as file", "name", "origin_file", "origin_name")
        return by_name.union(by_star)

    return fixpoint(seed, step, ["file", "name", "origin_file", "origin_name"], "reexports")


def inherited_settings(own: DataFrame, extends: DataFrame) -> DataFrame:
    """``file, key, value``: own settings, else those of the nearest file it extends; cycles are harmless.

    ``own``: file, key, value. ``extends``: file, parent.
    """
    files = own.select("file").union(extends.select("file")).distinct()
    seed = files.selectExpr("file", "file as source", "0 as depth")
    step = lambda new: new.join(extends.selectExpr("file as source", "parent"), "source").selectExpr("file", "parent as source", "depth + 1 as depth")
    chain = fixpoint(seed, step, ["file", "source"], "extends")
    return chain.join(own.selectExpr("file as source", "key", "value"), "source").groupBy("file", "key").agg(F.min_by("value", "depth").alias("value"))


def member_lookup(members: DataFrame, extends: DataFrame) -> DataFrame:
    """``type, name, target``: own member, else that of the nearest base. ``members``: type, name, target; ``extends``: from_id, to_id."""
    types = members.select("type").union(extends.select("from_id")).distinct()
    seed = types.selectExpr("type", "type as base", "0 as depth")
    step = lambda new: new.join(extends.selectExpr("from_id as base", "to_id"), "base").selectExpr("type", "to_id as base", "depth + 1 as depth")
    chain = fixpoint(seed, step, ["type", "base"], "bases")
    return chain.join(members.selectExpr("type as base", "name", "target"), "base").groupBy("type", "name").agg(F.min_by("target", "depth").alias("target"))


def receiver_types(chains: DataFrame, bindings: DataFrame, fields: DataFrame) -> DataFrame:
    """``scope, owner, type`` of each receiver chain ``a.b.c`` whose every part has a type.

    ``chains``: scope, owner, parts (array); an owner is a call, or a name whose initial value the chain is, so that
    another chain of the scope may begin with it. ``bindings``: scope, name, type, one row for each name of a scope that is declared with a type;
    ``fields``: type, name, target, of members and of what calls return. Rows of the fixpoint are typed prefixes:
    each is worked out once, so names that are defined by each other end without a type.
    """
    chains = materialize(chains.select("scope", "owner", "parts", F.get("parts", F.lit(0)).alias("head")), "chains")
    # Names that are alike take far less room in files than in memory, so joins to chains must not go by file sizes and broadcast, through the driver, every round.
    sized = chains.select("scope", "owner", "parts").hint("merge")
    fields = fields.groupBy("type", "name").agg(F.min("target").alias("target"))
    declared = chains.join(bindings.select("scope", F.col("name").alias("head"), "type"), ["scope", "head"])
    seed = declared.select("scope", "owner", F.lit(1).alias("k"), "type")
    waiting = chains.join(bindings.select("scope", F.col("name").alias("head")), ["scope", "head"], "left_anti").select("scope", "owner", "head").hint("merge")

    def step(new: DataFrame) -> DataFrame:
        at = new.join(sized, ["scope", "owner"])
        onward = at.where("k < size(parts)").select("scope", "owner", "k", "type", F.get("parts", F.col("k")).alias("name"))
        onward = onward.join(fields, ["type", "name"]).select("scope", "owner", (F.col("k") + 1).alias("k"), F.col("target").alias("type"))
        known = at.where("k = size(parts)").select("scope", F.col("owner").alias("head"), "type")
        return onward.union(known.join(waiting, ["scope", "head"]).select("scope", "owner", F.lit(1).alias("k"), "type"))

    typed = fixpoint(seed, step, ["scope", "owner", "k"], "receivers", hint="merge")
    return typed.join(sized, ["scope", "owner"]).where("k = size(parts)").select("scope", "owner", "type")


def resolve_providers(provides: DataFrame, imports: DataFrame) -> DataFrame:
    """``module, token, target`` where exactly one provider of a token is visible.

    ``provides``: module, token, target, exported (boolean). ``imports``: module, imported,
    re_exported (boolean): whether the importing module passes the imported one's exports on.
    """
    passed = fixpoint(
        provides.where("exported").selectExpr("module", "token", "target"),
        lambda new: new.join(imports.where("re_exported").selectExpr("imported as m", "module as outer_module"), new.module == F.col("m")).selectExpr("outer_module as module", "token", "target"),
        ["module", "token", "target"], "providers",
    )
    seen = imports.selectExpr("module", "imported").join(passed.selectExpr("module as imported", "token", "target"), "imported").select("module", "token", "target")
    return only_value(provides.select("module", "token", "target").union(seen), ["module", "token"], "target", "target")


def register_services(registrations: DataFrame, types: DataFrame) -> DataFrame:
    """``implements`` edges from registered implementations to services, where both names are one type's.

    ``registrations``: service, implementation, evidence. ``types``: name, id.
    """
    alone = only_value(types, ["name"], "id", "id")
    made = registrations.join(alone.selectExpr("name as service", "id as service_id"), "service").join(alone.selectExpr("name as implementation", "id as implementation_id"), "implementation")
    return made.select(F.col("service_id").alias("from_id"), F.lit("implemented_by").alias("relation"), F.col("implementation_id").alias("to_id"), "evidence", F.lit(EXACT).alias("confidence"), F.lit("ast").alias("provenance")).distinct()


def lifecycle_edges(methods: DataFrame, bases: DataFrame) -> DataFrame:
    """``implemented_by`` edges from an engine's messages to the methods of its behaviours, subclasses of subclasses too.

    ``methods``: repository, type (simple name), message, method, evidence. ``bases``:
    repository, type, base (simple names).
    """
    seed = methods.select("repository").distinct().selectExpr("repository", "'MonoBehaviour' as type")
    inherits = bases.selectExpr("repository", "type as sub", "base as type").distinct()
    behaviours = fixpoint(seed, lambda new: new.join(inherits, ["repository", "type"]).selectExpr("repository", "sub as type"), ["repository", "type"], "behaviours")
    hit = methods.join(behaviours, ["repository", "type"], "left_semi")
    return hit.select(F.concat(F.lit("unity://UnityEngine.MonoBehaviour/"), "message").alias("from_id"), F.lit("implemented_by").alias("relation"), F.col("method").alias("to_id"), "evidence", F.lit(EXACT).alias("confidence"), F.lit("ast").alias("provenance")).distinct()


def prefab_scripts(references: DataFrame, metas: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``uses`` edges, unresolved references) of prefabs by script guid.

    ``references``: prefab, guid, evidence. ``metas``: guid, path. ``types``: path, id. A guid with
    one script path that holds one type resolves; all else is reported.
    """
    script = only_value(metas, ["guid"], "path", "path").join(only_value(types, ["path"], "id", "id"), "path")
    joined = references.join(script.select("guid", "id"), "guid", "left")
    hit = joined.where("id is not null").select(F.col("prefab").alias("from_id"), F.lit("uses").alias("relation"), F.col("id").alias("to_id"), "evidence", F.lit(EXACT).alias("confidence"), F.lit("ast").alias("provenance"))
    return hit.distinct(), joined.where("id is null").select("prefab", "guid", "evidence", F.lit("unity.prefab_script_unresolved").alias("code")).distinct()


def stitched_fields(stitches: DataFrame, fields: DataFrame) -> DataFrame:
    """``resolved_by`` edges of stitched fields: both fields exist, and differ. ``stitches``: gateway_id, upstream_id, evidence; ``fields``: id."""
    known = fields.select("id").distinct()
    out = stitches.where("gateway_id <> upstream_id").join(known.withColumnRenamed("id", "gateway_id"), "gateway_id", "left_semi").join(known.withColumnRenamed("id", "upstream_id"), "upstream_id", "left_semi")
    return out.select(F.col("gateway_id").alias("from_id"), F.lit("resolved_by").alias("relation"), F.col("upstream_id").alias("to_id"), "evidence", F.lit(EXACT).alias("confidence"), F.lit("descriptor").alias("provenance"))


def prioritized(calls: DataFrame, lookups: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """``calls`` with ``target``: of several lookups (frame with target, join keys) the first that has one."""
    out, found = calls, []
    for k, (frame, keys) in enumerate(lookups):
        name = f"_target{k}"
        out = out.join(only_value(frame, keys, "target", name), keys, "left")
        found.append(F.col(name))
    return out.select(*calls.columns, F.coalesce(*found).alias("target"))


def receiver_diagnostics(calls: DataFrame, code: str) -> DataFrame:
    """One diagnostic a file for its unresolved receiver calls: first line and count. ``calls``: repository, path, line."""
    return calls.groupBy("repository", "path").agg(F.count("*").alias("n"), F.min("line").alias("line")).select(
        "repository", F.lit(code).alias("code"), F.lit("known_limitation").alias("severity"), "path", "line", F.concat("n", F.lit(" unresolved receiver calls")).alias("detail")
    )


def escapes_target(edges: DataFrame, target: str) -> DataFrame:
    """Edges of an enrichment that start in a repository other than its target: those it must not publish."""
    return edges.where(F.col("from_id").startswith("repo://") & ~F.col("from_id").startswith(f"repo://{target}/"))
