"""Repositories' files: discovery, ignore rules, routing to extractors, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never read, and folders that are left out unless a pattern names them.
PROTECTED = (".git", ".hg", ".svn")
DEFAULT_EXCLUDES = ("node_modules", "target", "dist", "build", "vendor", ".venv", "venv", "__pycache__", ".next", "coverage", ".terraform", ".idea", ".gradle", "out")
MOST_BYTES = 8 << 20

#: Extractor id and the names (as a regular expression on the path) that it reads; a file may go to several.
ROUTES: dict[str, str] = {
    "openapi": r"(?:^|/)(?:openapi|swagger)[^/]*\.(?:ya?ml|json)$",
    "asyncapi": r"(?:^|/)asyncapi[^/]*\.(?:ya?ml|json)$",
    "source_rust": r"\.rs$", "source_python": r"\.py$", "source_javascript": r"\.(?:m|c)?jsx?$", "source_typescript": r"\.tsx?$", "source_go": r"\.go$", "source_java": r"\.java$",
    "events": r"\.(?:rs|py|(?:m|c)?jsx?|tsx?|go|java)$", "literal_sql": r"\.(?:rs|py)$",
    "graphql": r"\.(?:graphqls?|gql)$", "persisted_operations": r"(?:^|/)persisted[^/]*\.json$",
    "protobuf": r"\.proto$", "protobuf_generated": r"(?:_pb2_grpc\.py|_grpc\.pb\.go|Grpc\.java|_grpc_pb\.js)$",
    "package_npm": r"(?:^|/)package\.json$", "package_cargo": r"(?:^|/)Cargo\.toml$", "package_python": r"(?:^|/)pyproject\.toml$", "package_go": r"(?:^|/)go\.mod$", "package_maven": r"(?:^|/)pom\.xml$",
    "package_requirements": r"(?:^|/)requirements[^/]*\.txt$", "generated_client": r"(?:^|/)\.openapi-generator/(?:FILES|VERSION)$",
    "sql": r"\.sql$", "prisma": r"\.prisma$", "alembic": r"(?:^|/)(?:alembic|migrations)/.*\.py$",
    "compose": r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml$", "kubernetes": r"(?:^|/)(?:k8s|kubernetes|deploy|manifests)/.*\.ya?ml$", "terraform": r"\.tf$", "helm": r"(?:^|/)Chart\.yaml$",
    "markdown": r"\.mdx?$", "codeowners": r"(?:^|/)CODEOWNERS$", "catalog": r"(?:^|/)catalog[^/]*\.ya?ml$", "config_keys": r"(?:^|/)(?:\.env[^/]*|config[^/]*\.(?:ya?ml|json|toml))$",
}
THIRD_PARTY = r"(?:^|/)(?:vendor|third[_-]?party|bower_components|jquery[^/]*\.js|[^/]*\.min\.(?:js|css))"


def glob_pattern(glob: str) -> str:
    """A glob of a path as a regular expression: ** crosses folders, * and ? do not."""
    anchored = "/" in glob.rstrip("/")
    folder, g = glob.endswith("/"), glob.strip("/")
    out, i = "", 0
    while i < len(g):
        if g[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif g[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], g[i] if g[i].isalnum() or g[i] in "/_-" else "\\" + g[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def excluded(path: Column, excludes: Sequence[str] = (), includes: Sequence[str] = (), ignored: Sequence[str] = ()) -> Column:
    """Protected and configured excludes always hold; the defaults unless an include names the path; then lines of ignore files,
    of which the last that matches decides (a leading ! takes a path back in)."""
    always = path.rlike("(?:^|/)(?:" + "|".join(x.replace(".", r"\.") for x in PROTECTED) + ")(?:/|$)")
    for g in excludes:
        always = always | path.rlike(glob_pattern(g))
    wanted = F.lit(False)
    for g in includes:
        wanted = wanted | path.rlike(glob_pattern(g))
    default = path.rlike("(?:^|/)(?:" + "|".join(x.replace(".", r"\.") for x in DEFAULT_EXCLUDES) + ")/") & ~wanted
    by_file = F.lit(False)
    for line in ignored:
        line = line.strip()
        if line and not line.startswith("#"):
            by_file = F.when(path.rlike(glob_pattern(line.lstrip("!"))), F.lit(not line.startswith("!"))).otherwise(by_file)
    return always | default | by_file


def discover(spark: SparkSession, roots: dict[str, str], **rules) -> DataFrame:
    """(repo_id, path, size_bytes, modified, content) of all files under the roots that are not excluded.

    The content is only read where a later step selects it.
    """
    out = None
    for repo, root in sorted(roots.items()):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rel = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
        f = f.select(F.lit(repo).alias("repo_id"), rel.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content").where(~excluded(F.col("path"), **rules))
        out = f if out is None else out.unionByName(f)
    return out


def minified(path: Column, size: Column, lines: Column) -> Column:
    """Scripts of at least 4 KiB whose lines are 500 bytes long on average, and ones that say so."""
    return path.rlike(THIRD_PARTY) | path.rlike(r"\.(?:m|c)?jsx?$") & (size >= 4096) & (size / F.greatest(lines, F.lit(1)) >= 500)


def routed(files: DataFrame) -> DataFrame:
    """One row for each file and extractor."""
    ids = F.array_compact(F.array(*(F.when(F.col("path").rlike(p), i) for i, p in ROUTES.items())))
    return files.withColumn("extractor", F.explode(ids))


def fingerprints(files: DataFrame, checkout: str = "main") -> DataFrame:
    """Fingerprints of routed files; content is read once for all its extractors."""
    return routed(files.withColumn("content_hash", F.sha2("content", 256)).drop("content")).select("repo_id", F.lit(checkout).alias("checkout_id"), "path", "extractor", "content_hash", "size_bytes")


def stat_cached(files: DataFrame, cache: DataFrame, racy_seconds: int = 2) -> DataFrame:
    """files with ``content_hash`` where the cache knows the same size and time, not younger than the racy window; else null."""
    c = cache.select("repo_id", "path", F.col("size_bytes").alias("_s"), F.col("modified").alias("_m"), F.col("content_hash").alias("_h"), F.col("seen_at").alias("_t"))
    same = (F.col("size_bytes") == F.col("_s")) & (F.col("modified") == F.col("_m")) & (F.unix_timestamp("_t") - F.unix_timestamp("_m") >= racy_seconds)
    return files.join(c, ["repo_id", "path"], "left").withColumn("content_hash", F.when(same, F.col("_h"))).drop("_s", "_m", "_h", "_t")


def as_text(content: Column) -> Column:
    """UTF-8 with replacement characters, and nothing for files over the bound."""
    return F.when(F.octet_length(content) <= MOST_BYTES, F.try_validate_utf8(content.cast("string")))


def precedence(*values: Column) -> Column:
    """Command line, manifest, repository, detection, default: the first that is set."""
    return F.coalesce(*values)


def competing(files: DataFrame) -> DataFrame:
    """Repositories with more than one OpenAPI file: the choice would be a guess."""
    return files.where(F.col("path").rlike(ROUTES["openapi"])).groupBy("repo_id").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def normalized_remote(url: Column) -> Column:
    """host/owner/name of a remote, whatever its form."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[a-z+]+://(?:[^@/]*@)?", ""), r"^[^@/]+@([^:/]+):", "$1/")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r":[0-9]+/", "/"), r"(?:\.git)?/?$", ""))
