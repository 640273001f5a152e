"""Queries of discovery and extraction, with their SQL: files are made from the tables, so SQL can tell what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract.run import extracted
from ..functions import routes as R
from ..sources import files as X
from ..sources import tables as G


def _s(x):
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _files(spark, sf, table, key, path, *text):
    """Files of a table's rows: path and text are lists of literals and columns."""
    put = lambda parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    k = F.col(key)
    return G.table(spark, sf, table).select(F.concat(F.lit("repo-"), _s(k % 10)).alias("repo_id"), put(path(k)).alias("path"), put([t(k) if callable(t) else t for t in text]).alias("text"))


def extract_page_links(spark, sf):
    """Links of pages; by column functions alone."""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return G.table(spark, sf, "pages").select("page_id", links.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def extract_routes_python(spark, sf):
    f = _files(spark, sf, "part", "p_partkey", lambda k: ["svc/app_", k, ".py"], "import requests\n# requests.get('/no')\n@app.get('/parts/", lambda k: k, "/{id}')\ndef read():\n    return requests.post(f'http://svc-", lambda k: k % 7,
               "/orders/{x}?q=1')\n\ndef test_", lambda k: k, "():\n    client.get('/p/' + name)\n")
    return extracted(f, "source_python").drop("repo_id")


def extract_routes_brace(spark, sf):
    f = _files(spark, sf, "part", "p_partkey", lambda k: ["web/r_", k, ".ts"], "// app.get('/no')\napp.get('/a/", lambda k: k, "', h)\nfetch(`https://api.x/b/${id}/", lambda k: k % 9, "`, { method: 'PUT' })\nit('works ", lambda k: k % 3, "', () => {})\n")
    return extracted(f, "source_typescript").drop("repo_id")


def extract_event_calls(spark, sf):
    f = _files(spark, sf, "part", "p_partkey", lambda k: ["w/e_", k, ".py"], "def publish(x): pass\nkafka_producer.send('orders.", lambda k: k % 50, "', b'')\n# nats.publish('no')\nchannel.basic_consume('queue.", lambda k: k % 4, "')\nbus.subscribe('plain')\n")
    return extracted(f, "events").select("path", "broker", "role", "channel", "line")


def extract_sql_accesses(spark, sf):
    f = _files(spark, sf, "supplier", "s_suppkey", lambda k: ["db/q_", k, ".sql"], "-- from nothing\nCREATE TABLE sales.t", lambda k: k, " (\n  id BIGINT NOT NULL,\n  note VARCHAR(", lambda k: k % 90 + 1, "),\n  PRIMARY KEY (id)\n);\nWITH x AS (SELECT * FROM sales.t", lambda k: k, ")\nINSERT INTO log_", lambda k: k % 5, " SELECT * FROM x JOIN \"Dim\".d ON true;\n")
    return extracted(f, "sql").select("path", "kind", "table", "name", "type", "nullable", "line")


def extract_packages(spark, sf):
    f = _files(spark, sf, "part", "p_partkey", lambda k: ["p", k, "/package.json"], '{"name": "@x/p', lambda k: k, '", "version": "1.', lambda k: k % 9, '.0",\n "dependencies": {"left-pad": "^', lambda k: k % 4, '"},\n "peerDependencies": {"react": "^18"}, "exports": {".": "./i.js", "./t": "./t.js"}}')
    return extracted(f, "package_npm").drop("repo_id")


def extract_openapi(spark, sf):
    f = _files(spark, sf, "supplier", "s_suppkey", lambda k: ["a", k, "/openapi.yaml"], "openapi: 3.0.0\npaths:\n  /v1/s", lambda k: k, "/:\n    get: {operationId: read", lambda k: k, "}\n    delete: {}\n")
    return extracted(f, "openapi").drop("repo_id")


def extract_protobuf(spark, sf):
    f = _files(spark, sf, "supplier", "s_suppkey", lambda k: ["p", k, "/a.proto"], 'syntax = "proto3";\npackage x', lambda k: k, ";\nmessage M {\n  // string no = 9;\n  repeated int32 n = ", lambda k: k % 20 + 1, ";\n}\nservice S { rpc Get(M) returns (stream M); }\n")
    return extracted(f, "protobuf").drop("repo_id")


def extract_compose(spark, sf):
    f = _files(spark, sf, "supplier", "s_suppkey", lambda k: ["c", k, "/compose.yaml"], "services:\n  api", lambda k: k, ":\n    image: x:", lambda k: k % 3, "\n    environment:\n      TOKEN: secret\n    depends_on: [db]\n  db: {image: pg}\n")
    return extracted(f, "compose").select("path", "name", F.array_join("images", ",").alias("images"), F.array_join("environment_keys", ",").alias("keys"), F.array_join("dependencies", ",").alias("needs"), "line")


def extract_markdown_refs(spark, sf):
    f = _files(spark, sf, "supplier", "s_suppkey", lambda k: ["d", k, "/README.md"], "# Title ", lambda k: k, "\nsee [x](./y_", lambda k: k % 8, ".md) and GET /s/", lambda k: k, "\n```\n[no](z)\n```\n")
    return extracted(f, "markdown").drop("repo_id")


def extract_config_keys(spark, sf):
    f = _files(spark, sf, "supplier", "s_suppkey", lambda k: ["e", k, "/.env"], "# c\nexport DB_PASSWORD=hunter2\nPORT_", lambda k: k, "=80\n")
    return extracted(f, "config_keys").drop("repo_id")


PATHS = ["src/main.rs", "node_modules/x/index.js", "a/.git/config", "build/out.py", "docs/openapi.yaml", "web/app.min.js", "vendor/keep/a.go", "tests/gen/x.py", "k8s/a.yaml", "sub/package.json", "logs/a.log", "logs/keep.log"]


def discovery_rules(spark, sf):
    d = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return d.withColumn("excluded", X.excluded(F.col("path"), excludes=["tests/gen/**"], includes=["vendor/keep/**"], ignored=["*.log", "!keep.log"]))


def extractor_routing(spark, sf):
    return X.routed(spark.createDataFrame([(p,) for p in PATHS], "path string"))


def page_fingerprints(spark, sf):
    p = G.table(spark, sf, "pages").select(F.lit("site").alias("repo_id"), F.concat(F.lit("pages/"), _s("page_id"), F.when(F.col("page_id") % 2 == 0, ".md").otherwise(".sql")).alias("path"), F.length("html").cast("long").alias("size_bytes"), F.encode("html", "UTF-8").alias("content"))
    return X.fingerprints(p)


def remote_identity(spark, sf):
    rows = [("git@github.example:Org/Repo.git",), ("https://user@github.example/Org/Repo",), ("ssh://git@github.example:22/Org/Repo.git/",), ("http://h/a/b/",)]
    return spark.createDataFrame(rows, "url string").withColumn("identity", X.normalized_remote(F.col("url")))


def page_paths(spark, sf):
    return G.table(spark, sf, "pages").select("page_id", R.normalized_path(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("path"), R.normalized_authority(F.col("url")).alias("authority"))


QUERIES = {f.__name__: f for f in (
    extract_page_links, extract_routes_python, extract_routes_brace, extract_event_calls, extract_sql_accesses, extract_packages, extract_openapi, extract_protobuf, extract_compose, extract_markdown_refs, extract_config_keys,
    discovery_rules, extractor_routing, page_fingerprints, remote_identity, page_paths)}

_P, _U = "(SELECT p_partkey AS k FROM part)", "(SELECT s_suppkey AS k FROM supplier)"
_ROUTED = {"src/main.rs": ["source_rust", "events", "literal_sql"], "node_modules/x/index.js": ["source_javascript", "events"], "build/out.py": ["source_python", "events", "literal_sql"], "docs/openapi.yaml": ["openapi"], "web/app.min.js": ["source_javascript", "events"],
           "vendor/keep/a.go": ["source_go", "events"], "tests/gen/x.py": ["source_python", "events", "literal_sql"], "k8s/a.yaml": ["kubernetes"], "sub/package.json": ["package_npm"]}
_OUT = {"node_modules/x/index.js", "a/.git/config", "build/out.py", "tests/gen/x.py", "logs/a.log"}
_SRC = "SELECT path, role, framework, method, route, symbol, authority, CAST(line AS INT) AS line FROM"
_DB = "CAST({n} AS INT) AS line"

ORACLE_SQL = {
    "extract_page_links": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL",
    "extract_routes_python": f"""{_SRC} (SELECT 'svc/app_' || k || '.py' AS path, 'provider' AS role, 'decorator' AS framework, 'GET' AS method, '/parts/' || k || '/{{id}}' AS route, 'read' AS symbol, NULL AS authority, 3 AS line FROM {_P}
UNION ALL SELECT 'svc/app_' || k || '.py', 'consumer', 'requests', 'POST', '/orders/{{}}', 'read', 'svc-' || (k % 7), 5 FROM {_P} UNION ALL SELECT 'svc/app_' || k || '.py', 'test', 'pytest', NULL, NULL, 'test_' || k, NULL, 7 FROM {_P}
UNION ALL SELECT 'svc/app_' || k || '.py', 'consumer', 'client', 'GET', '/p/{{}}', 'test_' || k, NULL, 8 FROM {_P})""",
    "extract_routes_brace": f"""{_SRC} (SELECT 'web/r_' || k || '.ts' AS path, 'provider' AS role, 'express' AS framework, 'GET' AS method, '/a/' || k AS route, NULL AS symbol, NULL AS authority, 2 AS line FROM {_P}
UNION ALL SELECT 'web/r_' || k || '.ts', 'consumer', 'fetch', 'PUT', '/b/{{}}/' || (k % 9), NULL, 'api.x', 3 FROM {_P} UNION ALL SELECT 'web/r_' || k || '.ts', 'test', 'test', NULL, NULL, 'works ' || (k % 3), NULL, 4 FROM {_P})""",
    "extract_event_calls": f"""SELECT 'w/e_' || k || '.py' AS path, x.b AS broker, x.r AS role, x.c || CASE x.b WHEN 'kafka' THEN CAST(k % 50 AS VARCHAR) WHEN 'rabbit_mq' THEN CAST(k % 4 AS VARCHAR) ELSE '' END AS channel, CAST(x.n AS INT) AS line
FROM {_P}, (VALUES ('kafka', 'publisher', 'orders.', 2), ('rabbit_mq', 'subscriber', 'queue.', 4), ('generic', 'subscriber', 'plain', 5)) AS x(b, r, c, n)""",
    "extract_sql_accesses": f"""SELECT 'db/q_' || k || '.sql' AS path, x.kind, CASE x.kind WHEN 'write' THEN 'log_' || (k % 5) ELSE coalesce(x.t, 'sales.t' || k) END AS "table",
  CASE x.kind WHEN 'write' THEN 'log_' || (k % 5) WHEN 'table' THEN 'sales.t' || k ELSE coalesce(x.name, x.t, 'sales.t' || k) END AS name, CASE x.name WHEN 'id' THEN x.ty WHEN 'note' THEN 'VARCHAR(' || (k % 90 + 1) || ')' END AS type,
  x.nu AS nullable, CAST(x.n AS INT) AS line FROM {_U}, (VALUES ('table', NULL, NULL, NULL, NULL, 2), ('column', NULL, 'id', 'BIGINT', false, 3), ('column', NULL, 'note', NULL, true, 4), ('primary_key', NULL, 'id', NULL, NULL, 5), ('read', NULL, NULL, NULL, NULL, 7), ('write', NULL, NULL, NULL, NULL, 8),
  ('read', 'dim.d', NULL, NULL, NULL, 8)) AS x(kind, t, name, ty, nu, n)""",
    "extract_packages": f"""SELECT 'p' || k || '/package.json' AS path, x.kind, CASE WHEN x.kind = 'package' THEN '@x/p' || k ELSE x.name END AS name, CASE WHEN x.kind = 'package' THEN '1.' || (k % 9) || '.0' WHEN x.name = 'left-pad' THEN '^' || (k % 4) ELSE x.v END AS value, x.scope, CAST(x.n AS INT) AS line
FROM {_P}, (VALUES ('package', NULL, NULL, NULL, 1), ('dependency', 'left-pad', NULL, 'runtime', 2), ('dependency', 'react', '^18', 'peer', 3), ('export', '.', NULL, NULL, 1), ('export', './t', NULL, NULL, 1)) AS x(kind, name, v, scope, n)""",
    "extract_openapi": f"SELECT 'a' || k || '/openapi.yaml' AS path, m AS method, '/v1/s' || k AS route, CASE m WHEN 'GET' THEN 'read' || k END AS operation, CAST(3 AS INT) AS line FROM {_U}, (VALUES ('GET'), ('DELETE')) AS x(m)",
    "extract_protobuf": f"""SELECT 'p' || k || '/a.proto' AS path, 'field' AS kind, 'x' || k || '.M' AS owner, 'n' AS name, k % 20 + 1 AS number, 'int32' AS type, 'varint' AS wire_type, 'repeated' AS cardinality, CAST(5 AS INT) AS line FROM {_U}
UNION ALL SELECT 'p' || k || '/a.proto', 'method', 'x' || k || '.S', 'Get', NULL, 'M -> stream M', NULL, NULL, 7 FROM {_U}""",
    "extract_compose": f"""SELECT 'c' || k || '/compose.yaml' AS path, 'api' || k AS name, 'x:' || (k % 3) AS images, 'TOKEN' AS keys, 'db' AS needs, CAST(2 AS INT) AS line FROM {_U} UNION ALL SELECT 'c' || k || '/compose.yaml', 'db', 'pg', '', '', 7 FROM {_U}""",
    "extract_markdown_refs": f"""SELECT 'd' || k || '/README.md' AS path, x.kind, CASE x.kind WHEN 'title' THEN 'Title ' || k WHEN 'link' THEN './y_' || (k % 8) || '.md' ELSE 'GET /s/' || k END AS target, CAST(x.n AS INT) AS line FROM {_U}, (VALUES ('title', 1), ('link', 2), ('http_operation', 2)) AS x(kind, n)""",
    "extract_config_keys": f"SELECT 'e' || k || '/.env' AS path, x.kind, CASE x.kind WHEN 'plain' THEN 'PORT_' || k ELSE 'DB_PASSWORD' END AS target, CAST(x.n AS INT) AS line FROM {_U}, (VALUES ('sensitive', 2), ('plain', 3)) AS x(kind, n)",
    "discovery_rules": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {'true' if p in _OUT else 'false'})" for p in PATHS) + ") AS t(path, excluded)",
    "extractor_routing": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{e}')" for p, es in _ROUTED.items() for e in es) + ") AS t(path, extractor)",
    "page_fingerprints": "SELECT 'site' AS repo_id, 'main' AS checkout_id, 'pages/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '.sql' END AS path, CASE WHEN page_id % 2 = 0 THEN 'markdown' ELSE 'sql' END AS extractor, sha256(html) AS content_hash, length(html) AS size_bytes FROM pages",
    "remote_identity": "SELECT * FROM (VALUES ('git@github.example:Org/Repo.git', 'github.example/org/repo'), ('https://user@github.example/Org/Repo', 'github.example/org/repo'), ('ssh://git@github.example:22/Org/Repo.git/', 'github.example/org/repo'), ('http://h/a/b/', 'h/a/b')) AS t(url, identity)",
    "page_paths": """SELECT page_id, CASE WHEN p = '' OR p = '/' THEN '/' ELSE rtrim(p, '/') END AS path, a AS authority FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS p, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS a FROM pages)""",
}
