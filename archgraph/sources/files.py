"""Reading source trees: files, inventories and state fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import identity_text

# Directories that a scan skips.
IGNORED_DIRECTORIES = (
    ".git", ".next", ".next-server", ".terraform", ".turbo", "_build", "bin", "build", "coverage", "deps", "dist", "node_modules", "obj",
    "storybook-static", "target",
)
# File names and endings by analyzer.
ACCEPTED = {
    "rust": (r"\.rs$",),
    "elixir": (r"\.exs?$",),
    "typescript": (r"\.(js|jsx|ts|tsx)$", r"(^|/)package\.json$", r"(^|/)(tsconfig|jsconfig)\.([^/]*\.)?json$"),
    "csharp": (r"\.cs$", r"\.csproj$", r"\.asmdef$", r"\.prefab$", r"\.cs\.meta$", r"\.prefab\.meta$"),
    "graphql": (r"\.(graphql|gql)$",),
    "protobuf": (r"\.proto$", r"(^|/)buf\.(yaml|lock)$"),
}


def accepted(path: Column, analyzer: str | None = None) -> Column:
    """Whether an analyzer (or any) reads a file of that relative path."""
    patterns = ACCEPTED[analyzer] if analyzer else [p for ps in ACCEPTED.values() for p in ps]
    return path.rlike("|".join(f"(?:{p})" for p in patterns))


def taken(path: Column) -> Column:
    """Whether a scan takes a file of that relative path: some analyzer reads it, and no directory above it is skipped."""
    return ~F.exists(F.split(path, "/"), lambda x: x.isin(*IGNORED_DIRECTORIES)) & accepted(path)


# Endings of generated files' names, and what their first lines hold, by language.
GENERATED = {
    r"\.exs?$": (r"\.pb\.ex$", "Autogenerated by"),
    r"\.cs$": (r"\.(generated|g)\.cs$", "(?i)<auto-generated|generated by"),
    r"\.(js|jsx|ts|tsx)$": (r"\.(generated|gen)\.\w+$", "(?i)@generated|generated by|do not edit"),
}


def generated(path: Column, text: Column) -> Column:
    """Whether a source was generated, by its name or its first 20 lines."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 20), "\n")
    out = F.lit(False)
    for language, (name, marker) in GENERATED.items():
        out = out | (path.rlike(language) & (path.rlike(name) | head.rlike(marker)))
    return out


def scan(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """``repository, path, content, length, modified`` of each accepted file below ``root``, by relative path.

    Only what later steps select is read: the listing alone needs no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # The root's own path may be inside an ignored directory, so only the relative path counts.
    qualified = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = qualified.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(qualified).toString().rstrip("/") + "/"
    relative = F.expr(f"substring(replace(path, 'file:///', 'file:/'), {len(base.replace('file:///', 'file:/')) + 1})")
    rows = files.select(F.lit(repository).alias("repository"), relative.alias("path"), "content", F.col("length"), F.col("modificationTime").alias("modified"))
    return rows.where(taken(F.col("path")))


def inventory(files: DataFrame) -> DataFrame:
    """``repository, digest`` of paths, lengths and times: changes when any file does, without reading one."""
    line = identity_text(F.col("path"), F.col("length").cast("string"), F.col("modified").cast("string"))
    return files.groupBy("repository").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(line, 256))), ""), 256).alias("digest"))


def state_fingerprint(files: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``repository, fingerprint``: identity, head and each file's path and content digest, in path order.

    Contents are hashed where they lie; only digests are gathered.
    """
    line = F.struct("path", F.sha2(F.col("content"), 256).alias("sha"))
    gathered = files.groupBy("repository").agg(F.sort_array(F.collect_list(line)).alias("files"))
    if heads is not None:
        gathered = gathered.join(heads, "repository", "left")
    else:
        gathered = gathered.withColumn("head", F.lit(None).cast("string"))
    text = F.concat(identity_text(F.col("repository"), F.when(F.col("head").isNull(), "0").otherwise("1"), F.coalesce("head", F.lit(""))), F.array_join(F.transform("files", lambda f: F.concat(F.octet_length(f["path"]).cast("string"), F.lit(":"), f["path"], f["sha"])), ""))
    return gathered.select("repository", F.sha2(text, 256).alias("fingerprint"))


def repository_identity(remote: Column, path: Column) -> Column:
    """``host/path`` of a fetch remote, without user, scheme and ``.git``; without a remote, a digest of the local path."""
    bare = F.regexp_replace(F.regexp_replace(remote, r"^[a-z+]+://", ""), r"^[^@/]+@", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^([^/:]+):(?!\d+/)", "$1/"), r"(\.git)?/?$", "")
    return F.when(remote.isNotNull() & (remote != ""), bare).otherwise(F.concat(F.lit("local://"), F.sha2(path, 256)))


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content no cache row covers for this analyzer version. ``cache``: sha, version, ...; ``files`` has version."""
    return files.withColumn("sha", F.sha2("content", 256)).join(cache.select("sha", "version").distinct(), ["sha", "version"], "left_anti")


def decode_source(content: Column) -> Column:
    """Struct (text, lossy) of bytes by their byte order mark: UTF-8, or UTF-16 of either order."""
    head = F.hex(F.substring(content, 1, 3))
    body = lambda n: F.substring(content, n, 1 << 30)
    text = (
        F.when(head.startswith("EFBBBF"), F.decode(body(4), "UTF-8")).when(head.startswith("FFFE"), F.decode(body(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(body(3), "UTF-16BE")).otherwise(F.try_validate_utf8(content.cast("string")))
    )
    lossy = text.isNull()
    return F.struct(F.coalesce(text, F.make_valid_utf8(content.cast("string"))).alias("text"), lossy.alias("lossy"))
