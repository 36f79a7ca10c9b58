"""TypeScript and JavaScript modules: imports to files, exports to definitions, and calls to what they import.

All is joins on names: a file's imports meet candidate paths as rows, exports reach their
definitions by a fixpoint, and calls look up what their file's imports bind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.shared import materialize
from ..schema import EXACT
from ..sources import manifests
from . import resolve

SOURCE = r"\.(ts|tsx|js|jsx)$"
_SCOPE = ("repository", "path", "specifier")


def _place(repository: Column, directory: Column) -> Column:
    """A directory of a repository as one path, whose parents are prefixes at a slash."""
    return F.concat(repository, F.lit("/"), F.when(directory == "", "").otherwise(F.concat(F.lit("/"), directory)))


def module_id(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("repo://"), repository, F.when(path.rlike(r"\.jsx?$"), "/javascript/").otherwise("/typescript/"), path)


def _alias_bases(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Bases by the deepest configuration above the importing file, its own paths or those of the nearest one it extends."""
    configs = manifests.tsconfigs(files).withColumn("file", F.concat("repository", F.lit("//"), "path")).withColumn("directory", manifests.directory(F.col("path")))
    parent = ids.normalize_path(F.concat("directory", F.lit("/"), F.when(F.col("extends").endswith(".json"), F.col("extends")).otherwise(F.concat("extends", F.lit(".json")))))
    extends = configs.where("extends like '.%'").select("file", F.concat("repository", F.lit("//"), parent).alias("parent"))
    base = ids.normalize_path(F.concat("directory", F.lit("/"), F.coalesce("base_url", F.lit("."))))
    own = configs.where("paths is not null").select("file", F.lit("paths").alias("key"), F.struct(base.alias("base"), "paths").alias("value"))
    named = configs.where(F.col("path").rlike(r"(^|/)(ts|js)config\.json$"))
    settled = named.select("file", _place(F.col("repository"), F.col("directory")).alias("config")).join(resolve.inherited_settings(own, extends), "file")
    # Of a tsconfig and a jsconfig in one directory, the tsconfig, whose name is the larger.
    settled = settled.groupBy("config").agg(F.max_by("value", "file").alias("value"))
    placed = specifiers.withColumn("place", _place(F.col("repository"), manifests.directory(F.col("path"))))
    found = resolve.longest_prefix(placed, "place", settled, "config").join(settled, "config")
    rows = found.select(*_SCOPE, F.col("value.base").alias("base"), F.explode("value.paths").alias("pattern", "targets"))
    prefix, suffix = F.substring_index("pattern", "*", 1), F.expr("substring(pattern, instr(pattern, '*') + 1)")
    star = (F.instr("pattern", "*") > 0) & F.startswith(F.col("specifier"), prefix) & F.endswith(F.col("specifier"), suffix) & (F.length("specifier") >= F.length(prefix) + F.length(suffix))
    hits = rows.where((F.col("pattern") == F.col("specifier")) | star)
    capture = F.when(F.col("pattern") == F.col("specifier"), "").otherwise(F.substring(F.col("specifier"), F.length(prefix) + 1, F.length("specifier") - F.length(prefix) - F.length(suffix)))
    rank = F.when(F.col("pattern") == F.col("specifier"), -(1 << 30)).otherwise(-F.length(prefix))
    hits = hits.select(*_SCOPE, "base", capture.alias("capture"), rank.alias("o2"), F.posexplode("targets").alias("o3", "target"))
    return hits.select(*_SCOPE, F.col("repository").alias("target_repository"), F.concat("base", F.lit("/"), F.replace("target", F.lit("*"), F.col("capture"))).alias("base"), F.lit(0).alias("o1"), "o2", "o3")


def _strings(value: str) -> str:
    """SQL for all strings a manifest's value holds, in order."""
    return f"if({value} like '{{%', regexp_extract_all({value}, ':\\\\s*\"([^\"]*)\"', 1), array({value}))"


def _package_bases(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Bases by the longest package name: the repository's own package, else one that only one repository has."""
    found = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select("repository", manifests.directory(F.col("path")).alias("directory"), F.col("content").cast("string").alias("text"))
    field = lambda name: F.get_json_object("text", f"$.{name}")
    known = found.select(
        "repository", "directory", field("name").alias("name"), field("exports").alias("exports"), F.array_compact(F.array(*(field(x) for x in ("source", "module", "main")))).alias("fields"),
    ).where("name is not null")
    manifest = F.struct("repository", "directory", "exports", "fields")
    own = known.groupBy(F.col("repository").alias("scope"), "name").agg(F.min(manifest).alias("package"))
    shared = known.groupBy("name").agg(F.min(manifest).alias("package"), F.count("*").alias("n")).where("n = 1").select(F.lit("").alias("scope"), "name", "package")
    packages = own.unionByName(shared).withColumn("owner", F.concat("scope", F.lit("//"), "name"))
    bare = specifiers.where("specifier not like '.%'")
    asked = bare.withColumn("key", F.concat("repository", F.lit("//"), "specifier")).withColumn("o1", F.lit(1)).union(bare.withColumn("key", F.concat(F.lit("//"), "specifier")).withColumn("o1", F.lit(2)))
    met = resolve.longest_prefix(asked, "key", packages, "owner").join(packages.select("owner", "name", "package"), "owner")
    met = met.selectExpr(*_SCOPE, "o1", "package", "package.exports as exports", "if(specifier = name, '.', concat('.', substring(specifier, length(name) + 1))) as entry")
    met = met.withColumn("map", F.from_json("exports", "map<string, string>"))
    by_star = f"""flatten(transform(filter(map_entries(map), e -> instr(e.key, '*') > 0 and startswith(entry, substring_index(e.key, '*', 1)) and endswith(entry, substring(e.key, instr(e.key, '*') + 1))
        and length(entry) >= length(e.key) - 1), e -> transform({_strings('e.value')}, t -> replace(t, '*', substring(entry, instr(e.key, '*'), length(entry) - length(e.key) + 1)))))"""
    conditions = "entry = '.' and not exists(map_keys(map), k -> startswith(k, '.'))"
    exported = f"case when exports is null then array() when map is null then if(entry = '.', array(exports), array()) when map[entry] is not null then {_strings('map[entry]')} when {conditions} then {_strings('exports')} else {by_star} end"
    rest = "if(entry = '.', concat(package.fields, array('src/index', 'index')), array(substring(entry, 3)))"
    tried = met.selectExpr(*_SCOPE, "o1", "package.repository as target_repository", "package.directory as directory", f"posexplode(concat(cast({exported} as array<string>), {rest})) as (o3, target)")
    return tried.select(*_SCOPE, "target_repository", F.concat("directory", F.lit("/"), "target").alias("base"), "o1", F.lit(0).alias("o2"), "o3")


def imported_files(specifiers: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """``repository, path, specifier, file``: the first existing file that an import may mean.

    ``specifiers`` has the first three; ``sources``: repository, path, file of all modules.
    """
    relative = specifiers.where("specifier like '.%'").select(
        *_SCOPE, F.col("repository").alias("target_repository"), F.concat(manifests.directory(F.col("path")), F.lit("/"), "specifier").alias("base"), F.lit(1).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3")
    )
    bases = relative.unionByName(_alias_bases(specifiers, files)).unionByName(_package_bases(specifiers, files)).withColumn("base", ids.normalize_path(F.col("base")))
    tried = bases.select(*_SCOPE, "target_repository", "o1", "o2", "o3", F.posexplode(resolve.import_candidates(F.col("base"))).alias("o4", "target_path"))
    hits = tried.join(sources.selectExpr("repository as target_repository", "path as target_path", "file"), ["target_repository", "target_path"])
    return hits.groupBy(*_SCOPE).agg(F.min_by("file", F.struct("o1", "o2", "o3", "o4")).alias("file"))


def resolve_modules(code: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``from_id, relation, to_id, evidence, resolved`` of each call that imports settle, diagnostics of receiver calls left, ``file, local, imported, target_file`` of imports).

    ``code``: facts of the frontends. ``files``: repository, path, content, for the manifests.
    A called name is what its import binds; a member of ``* as`` is an export of that file; a
    member of an imported or local type is that type's.
    """
    code = code.where(F.col("path").rlike(SOURCE))
    sources = code.select("repository", "path").distinct().withColumn("file", module_id(F.col("repository"), F.col("path")))
    specifiers = code.where("sort in ('import', 'export') and to_id is not null").select("repository", "path", F.col("to_id").alias("specifier")).distinct()
    reached = materialize(imported_files(specifiers, files, sources), "imported-files")
    symbols = code.where("sort = 'edge' and relation = 'defines'").where(F.startswith(F.col("to_id"), F.concat("from_id", F.lit("/"))) & (F.col("from_id") == module_id(F.col("repository"), F.col("path"))))
    symbols = symbols.select(F.col("from_id").alias("file"), F.expr("substring(to_id, length(from_id) + 2)").alias("name"), F.col("to_id").alias("id")).distinct()
    bound = code.where("sort = 'import'").select("repository", "path", F.col("to_id").alias("specifier"), F.col("from_id").alias("file"), F.col("id").alias("local"), F.col("kind").alias("imported"))
    bound = bound.join(reached.withColumnRenamed("file", "target_file"), list(_SCOPE))
    bound = materialize(bound.groupBy("file", "local").agg(F.min(F.struct("imported", "target_file")).alias("x")).select("file", "local", "x.*"), "bound")
    exports = code.where("sort = 'export'").select("repository", "path", F.col("from_id").alias("file"), F.col("id").alias("name"), F.col("kind").alias("local"), F.col("to_id").alias("specifier"))
    named = exports.where("specifier is null")
    own = named.join(symbols.selectExpr("file", "name as local"), ["file", "local"]).selectExpr("file", "name", "local as origin_name")
    passed = named.join(bound.where("imported <> '*'"), ["file", "local"]).selectExpr("file", "name", "target_file as source_file", "imported as source_name")
    again = exports.where("specifier is not null").join(reached.withColumnRenamed("file", "source_file"), list(_SCOPE)).selectExpr("file", "name", "source_file", "local as source_name")
    origins = resolve.reexport_origins(own.distinct(), passed.union(again).distinct())
    exported = origins.join(symbols.selectExpr("file as origin_file", "name as origin_name", "id"), ["origin_file", "origin_name"])
    exported = materialize(resolve.only_value(exported, ["file", "name"], "id", "id"), "exported")
    pattern = r"^(?:typescript|javascript)-(call|constructor|method)://(?:(.*)/)?(.*)$"
    calls = code.where("sort = 'edge' and relation = 'calls'").where(F.col("to_id").rlike(pattern)).select(
        "repository", "path", "from_id", "relation", "to_id", "evidence", module_id(F.col("repository"), F.col("path")).alias("file"),
        F.regexp_extract("to_id", pattern, 2).alias("receiver"), F.regexp_extract("to_id", pattern, 3).alias("name"),
    )
    calls = calls.withColumn("local", F.expr("if(receiver = '', name, receiver)")).join(bound, ["file", "local"], "left")
    calls = calls.join(exported.selectExpr("file as target_file", "name as imported", "id as bound_id"), ["target_file", "imported"], "left")
    calls = calls.join(exported.selectExpr("file as target_file", "name", "id as namespace_id"), ["target_file", "name"], "left")
    calls = calls.withColumn("member", F.expr("if(receiver = '' or imported = '*', null, concat(coalesce(bound_id, if(imported is null, concat(file, '/', receiver), null)), '/', name))"))
    calls = calls.join(code.where("sort = 'entity'").select(F.col("id").alias("member"), F.col("id").alias("member_id")).distinct(), "member", "left")
    settled = calls.withColumn("resolved", F.expr("case when receiver = '' and imported <> '*' then bound_id when receiver <> '' and imported = '*' then namespace_id else member_id end"))
    settled = materialize(settled.select("repository", "path", "from_id", "relation", "to_id", "evidence", "receiver", "resolved").distinct(), "settled-calls")
    left = settled.where("receiver <> '' and resolved is null").select("repository", "path", F.regexp_extract("evidence", r":([0-9]+)$", 1).try_cast("long").alias("line"))
    return settled.where("resolved is not null").select("from_id", "relation", "to_id", "evidence", "resolved"), resolve.receiver_diagnostics(left, "typescript.receiver_resolution_incomplete"), bound


def settle(edges: DataFrame, settled: DataFrame) -> DataFrame:
    """``edges`` with the calls that ``settled`` names pointed at what they call."""
    keys = ["from_id", "relation", "to_id", "evidence"]
    out = edges.join(settled.distinct(), keys, "left")
    return out.select("from_id", "relation", F.coalesce("resolved", "to_id").alias("to_id"), "evidence", F.when(F.col("resolved").startswith("repo://"), EXACT).otherwise(F.col("confidence")).alias("confidence"), "provenance")
