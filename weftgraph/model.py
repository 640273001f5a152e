"""The data model: nodes, edges, evidence and the closed sets they use."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "kind", "repo_id", "stable_key", "label")])
EDGES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("confidence", T.FloatType()), T.StructField("status", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
EVIDENCE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("repo_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("extractor", T.StringType()), T.StructField("extractor_version", T.StringType()),
    T.StructField("provenance", T.StringType()), T.StructField("confidence", T.FloatType()), T.StructField("observed_at_commit", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("note", T.StringType())])
FINGERPRINTS = T.StructType([T.StructField(x, T.StringType()) for x in ("repo_id", "checkout_id", "path", "extractor", "content_hash")] + [T.StructField("size_bytes", T.LongType())])

# The closed sets, in the order that ties are broken by.
NODE_KINDS = (
    "repository", "artifact", "package", "symbol_ref", "http_operation", "graphql_operation", "rpc_method", "event_channel", "event_schema", "database", "table", "column",
    "deployment", "service", "config_key", "owner", "document", "adr", "test_case", "change_set", "pull_request", "community")
EDGE_KINDS = (
    "contains", "provides", "consumes", "calls_remote", "publishes", "subscribes", "delivers_to", "depends_on_package", "depends_on_repository", "reads_table", "writes_table",
    "deploys", "configures", "documents", "owned_by", "implemented_by", "validates", "member_of", "compatible_with", "incompatible_with", "changed_in", "affects", "precedes",
    "reverts", "manual_link")
#: From the best to the worst.
STATUSES = ("confirmed", "inferred", "ambiguous", "stale", "incomplete")
#: Edges along which a change does not spread.
NOT_PROPAGATING = ("validates", "owned_by", "documents", "member_of", "precedes", "reverts", "compatible_with")
#: What counts as a contract differs by report.
IMPACT_CONTRACTS = ("http_operation", "graphql_operation", "rpc_method", "event_channel", "event_schema", "table", "column", "config_key")
COMMUNITY_CONTRACTS = ("http_operation", "graphql_operation", "rpc_method", "event_channel", "event_schema", "database", "table", "package")
INSPECTED_CONTRACTS = ("http_operation", "graphql_operation", "rpc_method", "event_channel", "event_schema", "database", "table", "column", "package")
BOUNDARIES = ("http_operation", "graphql_operation", "rpc_method", "event_channel", "event_schema", "package", "database", "table", "column", "config_key")
#: What a state of freshness takes off a search score.
FRESHNESS_PENALTY = {
    "fresh": 0.0, "working_tree_changed": 0.05, "commits_behind": 0.1, "config_changed": 0.15, "extractor_changed": 0.15, "provider_stale": 0.15, "partial": 0.2, "unknown": 0.2,
    "corrupt": 0.4, "unavailable": 0.5}
NO_FRESHNESS_PENALTY = 0.2
