"""Manifests: package.json, tsconfig, Cargo.toml, mix.exs, csproj and Unity files, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _named(files: DataFrame, pattern: str) -> DataFrame:
    text = F.col("content").cast("string")
    return files.where(F.col("path").rlike(pattern)).select("repository", "path", text.alias("text"))


def directory(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def packages(files: DataFrame) -> DataFrame:
    """``repository, directory, name`` of each package.json."""
    found = _named(files, r"(^|/)package\.json$")
    return found.select("repository", directory(F.col("path")).alias("directory"), F.get_json_object("text", "$.name").alias("name")).where("name is not null")


def package_dependencies(files: DataFrame) -> DataFrame:
    """``repository, path, dependency``: of each package.json's dependencies of any kind."""
    found = _named(files, r"(^|/)package\.json$")
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    keys = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.json_object_keys(F.get_json_object("text", f"$.{k}")), F.expr("cast(array() as array<string>)")) for k in kinds))))
    return found.select("repository", "path", F.explode(keys).alias("dependency"))


def without_comments(text):
    """JSON with comments and trailing commas as plain JSON; strings are left as they are."""
    kept = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")
    return F.regexp_replace(kept, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def tsconfigs(files: DataFrame) -> DataFrame:
    """``repository, path, extends, base_url, paths`` of each tsconfig or jsconfig."""
    found = _named(files, r"(^|/)(tsconfig|jsconfig)\.([^/]*\.)?json$").withColumn("json", without_comments(F.col("text")))
    return found.select(
        "repository", "path", F.get_json_object("json", "$.extends").alias("extends"), F.get_json_object("json", "$.compilerOptions.baseUrl").alias("base_url"),
        F.from_json(F.get_json_object("json", "$.compilerOptions.paths"), "map<string, array<string>>").alias("paths"),
    )


def cargo_dependencies(files: DataFrame) -> DataFrame:
    """``repository, path, dependency`` of each Cargo.toml, from its dependency tables."""
    found = _named(files, r"(^|/)Cargo\.toml$")
    section = F.regexp_extract_all("text", F.lit(r"(?m)^\[(?:[\w.'\"()= -]*\.)?(?:dev-|build-)?dependencies\]\s*\n((?:(?!^\[).*\n?)*)"), 1)
    names = F.flatten(F.transform(section, lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^\s*\"?([A-Za-z0-9_-]+)\"?\s*(?:\.[\w-]+\s*)?="), 1)))
    return found.select("repository", "path", F.explode(F.array_distinct(names)).alias("dependency"))


def mix_dependencies(files: DataFrame) -> DataFrame:
    """``repository, path, dependency`` of each mix.exs."""
    found = _named(files, r"(^|/)mix\.exs$")
    return found.select("repository", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{\s*:([a-z_0-9]+)\s*,\s*(?:\"|[a-z_]+:|>|~)"), 1))).alias("dependency"))


def csharp_projects(files: DataFrame) -> DataFrame:
    """``repository, path, assembly, references, included, removed`` of each csproj."""
    found = _named(files, r"\.csproj$").withColumn("xml", F.regexp_replace("text", r'\sxmlns="[^"]*"|^﻿', ""))
    stem = F.regexp_extract("path", r"([^/]*)\.csproj$", 1)
    slashes = lambda xs: F.transform(xs, lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    return found.select(
        "repository", "path", F.coalesce(F.nullif(F.xpath_string("xml", F.lit("//AssemblyName")), F.lit("")), stem).alias("assembly"),
        slashes(F.xpath("xml", F.lit("//ProjectReference/@Include"))).alias("references"),
        slashes(F.xpath("xml", F.lit("//Compile/@Include"))).alias("included"), slashes(F.xpath("xml", F.lit("//Compile/@Remove"))).alias("removed"),
    )


def unity_metas(files: DataFrame) -> DataFrame:
    """``repository, path, guid``: the asset each .meta file stands for."""
    found = _named(files, r"\.meta$")
    return found.select("repository", F.regexp_replace("path", r"\.meta$", "").alias("path"), F.regexp_extract("text", r"(?m)^guid:\s*([0-9a-f]{32})", 1).alias("guid")).where("guid <> ''")


def unity_prefabs(files: DataFrame) -> DataFrame:
    """``repository, prefab, kind, guid, evidence``: script and source-prefab references of each .prefab, by line."""
    found = _named(files, r"\.prefab$").select("repository", "path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    pattern = r"(m_Script|m_SourcePrefab): *\{[^}]*guid: *([0-9a-f]{32})"
    hit = found.where(F.col("line").rlike(pattern))
    return hit.select(
        "repository", F.concat(F.lit("repo://"), "repository", F.lit("/unity-prefab/"), "path").alias("prefab"),
        F.when(F.regexp_extract("line", pattern, 1) == "m_Script", "script").otherwise("source_prefab").alias("kind"),
        F.regexp_extract("line", pattern, 2).alias("guid"), F.concat("path", F.lit(":"), F.col("at") + 1).alias("evidence"),
    )


def unity_assemblies(files: DataFrame) -> DataFrame:
    """``repository, path, name, references`` of each .asmdef."""
    found = _named(files, r"\.asmdef$").withColumn("json", F.from_json("text", "name string, references array<string>"))
    return found.select("repository", "path", "json.name", F.coalesce("json.references", F.expr("cast(array() as array<string>)")).alias("references"))
