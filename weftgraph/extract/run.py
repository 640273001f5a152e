"""Runs extractors over files: one of them, or all in one pass that reads every file once; each family with its own schema."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import ROUTES
from ..sources.shared import new_path
from . import declared as D
from . import source as S

HTTP = "method string, route string, operation string, line int"
SOURCE = "role string, framework string, method string, route string, symbol string, authority string, line int"
EVENT = "broker string, role string, channel string, schema string, fields array<string>, line int"
GRAPHQL = "kind string, type string, field string, type_ref string, arguments array<string>, line int"
PROTO = "kind string, owner string, name string, number long, type string, wire_type string, cardinality string, line int"
MARKER = "role string, service string, method string, line int"
PACKAGE = "kind string, name string, value string, scope string, line int"
DATA = "kind string, table string, name string, type string, nullable boolean, references string, line int"
INFRA = "kind string, name string, namespace string, images array<string>, environment_keys array<string>, dependencies array<string>, line int"
DOCUMENT = "kind string, target string, line int"
CLIENT = "kind string, name string, line int"


@dataclass(frozen=True)
class Extractor:
    """id, version of its contract, a pattern that a file's text must have before Python sees it, its rows' schema, and the function."""

    id: str
    schema: str
    extract: Callable[[str, str], Iterator[dict]]
    version: str = "1"
    marker: str | None = None


EXTRACTORS = {e.id: e for e in (
    Extractor("openapi", HTTP, D.openapi, marker="openapi|swagger"), Extractor("asyncapi", EVENT, D.asyncapi, marker="asyncapi"), Extractor("graphql", GRAPHQL, D.graphql), Extractor("persisted_operations", GRAPHQL, D.persisted),
    Extractor("source_python", SOURCE, S.python, marker=r"(?i)route|get|post|put|delete|patch|client|test_"), *(Extractor(f"source_{x}", SOURCE, S.brace) for x in ("javascript", "typescript", "go", "java", "rust")),
    Extractor("events", EVENT, S.events, marker=r"(?i)publish|subscribe|send|produce|consume|receive|poll"), Extractor("literal_sql", DATA, S.literal_sql, marker=r"(?i)select|insert|update|delete"),
    Extractor("protobuf", PROTO, D.protobuf), Extractor("protobuf_generated", MARKER, D.protobuf_generated), Extractor("package_npm", PACKAGE, D.npm), Extractor("package_cargo", PACKAGE, D.cargo), Extractor("package_python", PACKAGE, D.pyproject),
    Extractor("package_go", PACKAGE, D.go_mod), Extractor("package_maven", PACKAGE, D.maven), Extractor("package_requirements", PACKAGE, D.requirements), Extractor("generated_client", CLIENT, D.generated_client), Extractor("sql", DATA, D.sql),
    Extractor("prisma", DATA, D.prisma, marker="model"), Extractor("alembic", DATA, D.alembic, marker="revision|op\\."), Extractor("compose", INFRA, D.compose, marker="services"), Extractor("kubernetes", INFRA, D.kubernetes, marker="kind:"),
    Extractor("helm", INFRA, D.helm), Extractor("terraform", INFRA, D.terraform, marker="resource|data|module"), Extractor("markdown", DOCUMENT, D.markdown), Extractor("codeowners", DOCUMENT, D.codeowners), Extractor("catalog", DOCUMENT, D.catalog, marker="metadata"),
    Extractor("config_keys", DOCUMENT, D.config_keys))}


def extracted(files: DataFrame, extractor: str | Extractor, *keys: str) -> DataFrame:
    """The rows of one extractor over files(repo_id, path, text, ...) that it reads; further key columns are kept.

    Files are routed and pre-filtered by column expressions; only what is left goes to Python.
    """
    e = EXTRACTORS[extractor] if isinstance(extractor, str) else extractor
    rows = files.where(F.col("path").rlike(ROUTES[e.id]) & F.col("text").isNotNull()) if e.id in ROUTES else files.where("text is not null")
    if e.marker:
        rows = rows.where(F.col("text").rlike(e.marker))
    kept = ["repo_id", "path", *keys]
    rows = rows.select(*kept, "text")
    names = [p.split(" ")[0] for p in e.schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*key, *(r[n] for n in names)) for *key, text in batch.itertuples(index=False) for r in e.extract(key[1], text)]
            yield pd.DataFrame(out, columns=[*kept, *names])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInPandas(run, f"{types}, {e.schema}")


def _wanted() -> Column:
    """The ids of the extractors that read a file(path, text)."""
    def reads(e: Extractor) -> Column:
        path = F.col("path").rlike(ROUTES[e.id]) if e.id in ROUTES else F.lit(True)
        return F.when(path & F.col("text").rlike(e.marker) if e.marker else path, F.lit(e.id))

    return F.array_compact(F.array(*map(reads, EXTRACTORS.values())))


def observed(files: DataFrame) -> DataFrame:
    """(extractor, repo_id, path, row) of all extractors over files(repo_id, path, text): one pass, every file read once; row is JSON."""
    rows = files.where("text is not null").withColumn("wanted", _wanted()).where(F.size("wanted") > 0).select("repo_id", "path", "text", "wanted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, repo, path, json.dumps(r)) for repo, path, text, wanted in batch.itertuples(index=False) for i in wanted for r in EXTRACTORS[i].extract(path, text)]
            yield pd.DataFrame(out, columns=["extractor", "repo_id", "path", "row"])

    return rows.mapInPandas(run, "extractor string, repo_id string, path string, row string")


def everything(files: DataFrame) -> dict[str, DataFrame]:
    """The rows of each extractor; the files are read and parsed once, and the outcome is a written table in parts by extractor."""
    path = new_path(files.sparkSession, "observations")
    observed(files).write.partitionBy("extractor").parquet(path)
    found = files.sparkSession.read.schema("repo_id string, path string, row string, extractor string").parquet(path)
    return {i: found.where(F.col("extractor") == i).select("repo_id", "path", F.from_json("row", e.schema).alias("x")).select("repo_id", "path", "x.*") for i, e in EXTRACTORS.items()}
