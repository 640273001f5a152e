"""Extractors of declarative formats: OpenAPI, AsyncAPI, GraphQL, Protobuf, packages, SQL, infrastructure, documents, settings.

Each takes (path, text) and yields dicts with the columns of its schema.  Values that are not literal are left out rather than
guessed; values of settings are never kept.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import yaml

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
#: Bounds of one file.
MOST_DEPTH, MOST_ROWS = 64, 100_000


def _documents(text: str) -> list[Any]:
    try:
        return [d for d in yaml.safe_load_all(text) if d is not None]
    except (yaml.YAMLError, RecursionError):
        return []


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, max(at, 0)) + 1


def _find(text: str, word: str) -> int:
    return _line(text, text.find(str(word)))


def _map(x: Any) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x: Any) -> list:
    return x if isinstance(x, list) else []


def http_path(path: str) -> str:
    p = re.sub("/+", "/", "/" + path)
    return p if p == "/" else p.rstrip("/")


def openapi(path: str, text: str) -> Iterator[dict]:
    for doc in _documents(text)[:1]:
        doc = _map(doc)
        if not ("openapi" in doc or "swagger" in doc):
            continue
        base = str(doc.get("basePath") or "") if "swagger" in doc else ""
        for route, item in _map(doc.get("paths")).items():
            for method in METHODS:
                if method in _map(item):
                    op = _map(item[method])
                    yield {"method": method.upper(), "route": http_path(base + str(route)), "operation": op.get("operationId"), "line": _find(text, route)}


def asyncapi(path: str, text: str) -> Iterator[dict]:
    for doc in _documents(text)[:1]:
        doc = _map(doc)
        version = str(doc.get("asyncapi") or "")
        brokers = sorted({str(_map(s).get("protocol")) for s in _map(doc.get("servers")).values() if _map(s).get("protocol")})
        broker = brokers[0] if len(brokers) == 1 else "generic"
        for name, ch in _map(doc.get("channels")).items():
            ch = _map(ch)
            roles = [r for r in ("publish", "subscribe") if r in ch] if version.startswith("2") else ["declaration"]
            address = str(ch.get("address") or name)
            for role in roles or ["declaration"]:
                message = _map(_map(ch.get(role)).get("message"))
                payload = _map(message.get("payload"))
                required = set(map(str, _list(payload.get("required"))))
                fields = [f"{f}:{_map(d).get('type', 'unknown')}:{'required' if f in required else 'optional'}" for f, d in sorted(_map(payload.get("properties")).items())]
                yield {"broker": broker, "role": role, "channel": address, "schema": message.get("name"), "fields": fields, "line": _find(text, name)}


_COMMENT = re.compile(r'"""(?:.|\n)*?"""|#[^\n]*')


def graphql(path: str, text: str) -> Iterator[dict]:
    plain = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in re.finditer(r"\b(?:extend\s+)?(type|input|interface)\s+(\w+)[^{]*\{((?:[^{}])*)\}", plain):
        for f in re.finditer(r"(\w+)\s*(\((?:[^()])*\))?\s*:\s*([\[\]\w!]+)", m[3]):
            yield {"kind": m[1], "type": m[2], "field": f[1], "type_ref": f[3], "arguments": sorted(re.findall(r"(\w+)\s*:", f[2] or "")), "line": _line(plain, m.start(3) + f.start())}
    for m in re.finditer(r"\benum\s+(\w+)[^{]*\{([^{}]*)\}", plain):
        for v in re.finditer(r"\w+", m[2]):
            yield {"kind": "enum", "type": m[1], "field": v[0], "type_ref": None, "arguments": [], "line": _line(plain, m.start(2) + v.start())}
    for m in re.finditer(r"(?:^|\})\s*(query|mutation|subscription)\s*(\w*)\s*(?:\([^)]*\))?\s*\{", plain):
        depth, at, root = 1, m.end(), []
        for t in re.finditer(r"[{}]|\([^)]*\)|\.\.\.\s*\w*|(?:\w+\s*:\s*)?(\w+)", plain[at:]):
            if t[0] == "{":
                depth += 1
            elif t[0] == "}":
                depth -= 1
                if not depth:
                    break
            elif t[1] and depth == 1:
                root.append(t[1])
        for field in root:
            yield {"kind": m[1], "type": m[2] or None, "field": field, "type_ref": None, "arguments": [], "line": _line(plain, m.start(1))}


def persisted(path: str, text: str) -> Iterator[dict]:
    try:
        doc = json.loads(text)
    except ValueError:
        return
    for key, body in (doc.items() if isinstance(doc, dict) else ((str(i), b) for i, b in enumerate(_list(doc)))):
        body = body if isinstance(body, str) else _map(body).get("query") or _map(body).get("body") or ""
        for row in graphql(path, body):
            yield row | {"type": row["type"] or str(key), "line": _find(text, key)}


WIRE = {t: "varint" for t in "int32 int64 uint32 uint64 sint32 sint64 bool".split()} | {t: "fixed64" for t in ("fixed64", "sfixed64", "double")} | {t: "fixed32" for t in ("fixed32", "sfixed32", "float")}


def protobuf(path: str, text: str) -> Iterator[dict]:
    plain = re.sub(r"//[^\n]*|/\*(?:.|\n)*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    package = (m := re.search(r"\bpackage\s+([\w.]+)\s*;", plain)) and m[1] or ""
    stack: list[tuple[str, str]] = []
    for m in re.finditer(
        r"\b(message|enum|service|oneof)\s+(\w+)\s*\{|\brpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)|(?:\b(repeated|optional|required)\s+)?\b(map\s*<[^>]*>|[\w.]+)\s+(\w+)\s*=\s*(\d+)\s*(?:\[[^\]]*\])?\s*;|\b(\w+)\s*=\s*(-?\d+)\s*(?:\[[^\]]*\])?\s*;|\{|\}", plain):
        name = ".".join(x for x in [package, *(n for k, n in stack if k in ("message", "enum", "service"))] if x)
        row = {"kind": None, "owner": name, "name": None, "number": None, "type": None, "wire_type": None, "cardinality": None, "line": _line(plain, m.start())}
        if m[1]:
            stack.append((m[1], m[2]))
        elif m[3]:
            yield row | {"kind": "method", "name": m[3], "type": f"{m[4] or ''}{m[5]} -> {m[6] or ''}{m[7]}"}
        elif m[10] and stack and stack[-1][0] in ("message", "oneof"):
            type_ = re.sub(r"\s", "", m[9])
            yield row | {"kind": "field", "name": m[10], "number": int(m[11]), "type": type_, "wire_type": WIRE.get(type_, "length"), "cardinality": m[8] or ("map" if type_.startswith("map<") else "singular")}
        elif m[12] and stack and stack[-1][0] == "enum":
            yield row | {"kind": "enum_value", "name": m[12], "number": int(m[13])}
        elif m[0] == "{":
            stack.append(("block", ""))
        elif m[0] == "}" and stack:
            stack.pop()


def protobuf_generated(path: str, text: str) -> Iterator[dict]:
    found = set()
    for m in re.finditer(r"['\"]/([\w.]+)/(\w+)['\"]", text):
        role = "client" if re.search(r"Stub|NewClient|ClientConn|newStub|Client\b", text) and "Stub" in text[: m.start()] else "server" if re.search(r"add_\w+_to_server|Servicer|RegisterService|ImplBase", text) else "unknown"
        if (m[1], m[2]) not in found:
            found.add((m[1], m[2]))
            yield {"role": role, "service": m[1], "method": m[2], "line": _line(text, m.start())}


def _package(kind: str, name: Any, value: Any = None, scope: str | None = None, line: int = 1) -> dict:
    return {"kind": kind, "name": str(name), "value": None if value is None else str(value), "scope": scope, "line": line}


def npm(path: str, text: str) -> Iterator[dict]:
    try:
        doc = _map(json.loads(text))
    except ValueError:
        return
    if doc.get("name"):
        yield _package("package", doc["name"], doc.get("version"), None, _find(text, '"name"'))
    for key, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for n, v in _map(doc.get(key)).items():
            yield _package("dependency", n, v, scope, _find(text, f'"{n}"'))
    exports = doc.get("exports")
    for n in exports if isinstance(exports, dict) else ["."] if exports or doc.get("main") else []:
        yield _package("export", n)
    spaces = doc.get("workspaces")
    for n in _list(spaces if isinstance(spaces, list) else _map(spaces).get("packages")):
        yield _package("workspace", n)


def _version(v: Any) -> Any:
    return v.get("version") if isinstance(v, dict) else v


def cargo(path: str, text: str) -> Iterator[dict]:
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    if (p := _map(doc.get("package"))).get("name"):
        yield _package("package", p["name"], p.get("version") if isinstance(p.get("version"), str) else None, None, _find(text, "name"))
    for key, scope in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
        for n, v in _map(doc.get(key)).items():
            yield _package("dependency", _map(v).get("package", n) if isinstance(v, dict) else n, _version(v), scope, _find(text, n))
    for n in _map(doc.get("features")):
        yield _package("feature", n)
    for n in _list(_map(doc.get("workspace")).get("members")):
        yield _package("workspace", n)


_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([<>=!~][^;#]*)?")


def pyproject(path: str, text: str) -> Iterator[dict]:
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    p, poetry = _map(doc.get("project")), _map(_map(doc.get("tool")).get("poetry"))
    if name := p.get("name") or poetry.get("name"):
        yield _package("package", name, p.get("version") or poetry.get("version"), None, _find(text, "name"))
    groups = [("runtime", p.get("dependencies"))] + [("optional", v) for v in _map(p.get("optional-dependencies")).values()] + [("dev", v) for v in _map(doc.get("dependency-groups")).values()]
    for scope, items in groups:
        for item in _list(items):
            if isinstance(item, str) and (m := _REQUIREMENT.match(item)):
                yield _package("dependency", m[1], (m[2] or "").strip() or None, scope, _find(text, item))
    for scope, table in [("runtime", poetry.get("dependencies"))] + [("dev", _map(g).get("dependencies")) for g in _map(poetry.get("group")).values()]:
        for n, v in _map(table).items():
            if n.lower() != "python":
                yield _package("dependency", n, _version(v), scope, _find(text, n))


def requirements(path: str, text: str) -> Iterator[dict]:
    for i, line in enumerate(text.split("\n"), 1):
        if not line.lstrip().startswith(("#", "-")) and (m := _REQUIREMENT.match(line)):
            yield _package("dependency", m[1], (m[2] or "").strip() or None, "runtime", i)


def go_mod(path: str, text: str) -> Iterator[dict]:
    for i, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*module\s+(\S+)", line):
            yield _package("package", m[1], None, None, i)
        elif m := re.match(r"\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S*|[\w.-]+\.[a-z]+\S*)\s+(v\S+)", line):
            yield _package("dependency", m[1], m[2], "indirect" if "// indirect" in line else "runtime", i)


def maven(path: str, text: str) -> Iterator[dict]:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return
    ns = root.tag[: root.tag.find("}") + 1] if root.tag.startswith("{") else ""
    value = lambda e, n: (x.text or "").strip() if e is not None and (x := e.find(ns + n)) is not None else None
    if value(root, "artifactId"):
        group = value(root, "groupId") or value(root.find(ns + "parent"), "groupId")
        yield _package("package", f"{group}:{value(root, 'artifactId')}", value(root, "version"), None, 1)
    for d in root.iterfind(f"{ns}dependencies/{ns}dependency"):
        yield _package("dependency", f"{value(d, 'groupId')}:{value(d, 'artifactId')}", value(d, "version"), value(d, "scope") or "runtime", _find(text, value(d, "artifactId") or ""))


def generated_client(path: str, text: str) -> Iterator[dict]:
    for i, line in enumerate(text.split("\n"), 1):
        if line.strip():
            yield {"kind": "version" if path.endswith("VERSION") else "file", "name": line.strip(), "line": i}


# --- SQL ------------------------------------------------------------------------------------------------------------

_NAME = r"(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])(?:\s*\.\s*(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\]))*"


def table_name(raw: str) -> str:
    return ".".join(re.sub(r'^["`\[]|["`\]]$', "", p.strip()) for p in raw.split(".")).lower()


def _plain_sql(text: str) -> str:
    return re.sub(r"--[^\n]*|/\*(?:.|\n)*?\*/|'(?:[^']|'')*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _split(body: str) -> list[tuple[int, str]]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append((start, body[start:i]))
            start = i + 1
    return [*out, (start, body[start:])]


def sql_accesses(text: str) -> Iterator[tuple[str, str, int]]:
    """(read or write, table, place) of statements; names of common table expressions are no tables."""
    plain = _plain_sql(text)
    local = {table_name(m[1]) for m in re.finditer(rf"(?:\bwith\s+(?:recursive\s+)?|,\s*)({_NAME})\s*(?:\([^)]*\))?\s+as\s*(?:materialized\s*)?\(", plain, re.I)}
    taken = set()
    for m in re.finditer(rf"\b(insert\s+into|merge\s+into|update|delete\s+from|truncate\s+table)\s+(?:only\s+)?({_NAME})", plain, re.I):
        if table_name(m[2]) not in local:
            taken.add(m.start(2))
            yield "write", table_name(m[2]), m.start()
    for m in re.finditer(rf"\b(?:from|join|using)\s+(?:only\s+|lateral\s+)?({_NAME})(?!\s*\()", plain, re.I):
        if m.start(1) not in taken and table_name(m[1]) not in local and table_name(m[1]) not in ("select", "lateral", "unnest"):
            yield "read", table_name(m[1]), m.start()


def sql(path: str, text: str) -> Iterator[dict]:
    plain = _plain_sql(text)
    row = {"kind": None, "table": None, "name": None, "type": None, "nullable": None, "references": None, "line": 1}
    for m in re.finditer(rf"\bcreate\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*\(", plain, re.I):
        table, depth, end = table_name(m[1]), 1, m.end()
        while end < len(plain) and depth:
            depth += (plain[end] == "(") - (plain[end] == ")")
            end += 1
        at = {"table": table, "line": _line(plain, m.start())}
        yield row | at | {"kind": "table", "name": table}
        for start, part in _split(plain[m.end() : end - 1]):
            line = _line(plain, m.end() + start + len(part) - len(part.lstrip()))
            fk = re.search(rf"\breferences\s+({_NAME})\s*(\([^)]*\))?", part, re.I)
            if c := re.match(r"\s*(?:constraint\s+\S+\s+)?(primary\s+key|foreign\s+key|unique|check|index|key)\b\s*(\([^)]*\))?", part, re.I):
                kind = re.sub(r"\s+", "_", c[1].lower())
                yield row | at | {"kind": kind, "name": re.sub(r"[()\s\"`]", "", c[2] or "") or None, "references": table_name(fk[1]) if fk else None, "line": line}
            elif c := re.match(rf"\s*({_NAME})\s+([A-Za-z]\w*(?:\s*\([^)]*\))?)", part):
                yield row | at | {"kind": "column", "name": table_name(c[1]), "type": re.sub(r"\s", "", c[2]).upper(), "nullable": not re.search(r"\bnot\s+null\b|\bprimary\s+key\b", part, re.I), "references": table_name(fk[1]) if fk else None, "line": line}
    for m in re.finditer(rf"\bcreate\s+(unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({_NAME})?\s*on\s+({_NAME})", plain, re.I):
        yield row | {"kind": "unique_index" if m[1] else "index", "table": table_name(m[3]), "name": table_name(m[2]) if m[2] else None, "line": _line(plain, m.start())}
    for op, table, at in sql_accesses(text):
        yield row | {"kind": op, "table": table, "name": table, "line": _line(plain, at)}


def prisma(path: str, text: str) -> Iterator[dict]:
    row = {"kind": None, "table": None, "name": None, "type": None, "nullable": None, "references": None, "line": 1}
    models = set(re.findall(r"\bmodel\s+(\w+)\s*\{", text))
    for m in re.finditer(r"\bmodel\s+(\w+)\s*\{([^}]*)\}", text):
        mapped = re.search(r'@@map\("([^"]+)"\)', m[2])
        table = (mapped[1] if mapped else m[1]).lower()
        yield row | {"kind": "table", "table": table, "name": m[1], "line": _line(text, m.start())}
        for f in re.finditer(r"^[ \t]*(\w+)[ \t]+(\w+)(\[\])?(\?)?", m[2], re.M):
            yield row | {"kind": "relation" if f[2] in models else "column", "table": table, "name": f[1], "type": f[2], "nullable": bool(f[4]), "references": f[2].lower() if f[2] in models else None, "line": _line(text, m.start(2) + f.start(1))}


def alembic(path: str, text: str) -> Iterator[dict]:
    row = {"kind": None, "table": None, "name": None, "type": None, "nullable": None, "references": None, "line": 1}
    for name in ("revision", "down_revision"):
        if m := re.search(rf"^{name}\s*(?::[^=]*)?=\s*['\"]([^'\"]+)['\"]", text, re.M):
            yield row | {"kind": name, "name": m[1], "line": _line(text, m.start())}
    for m in re.finditer(r"\bop\.(create_table|drop_table|add_column|drop_column)\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*(?:sa\.Column\(\s*)?['\"]([^'\"]+)['\"])?", text):
        yield row | {"kind": m[1], "table": m[2].lower(), "name": m[3], "line": _line(text, m.start())}


# --- infrastructure -------------------------------------------------------------------------------------------------


def _infra(kind: str, name: Any, namespace: Any = None, images: Any = (), keys: Any = (), needs: Any = (), line: int = 1) -> dict:
    clean = lambda xs: sorted({str(x) for x in xs if x})
    return {"kind": kind, "name": str(name), "namespace": namespace and str(namespace), "images": clean(images), "environment_keys": clean(keys), "dependencies": clean(needs), "line": line}


def compose(path: str, text: str) -> Iterator[dict]:
    for doc in _documents(text)[:1]:
        for name, s in _map(_map(doc).get("services")).items():
            s = _map(s)
            env = s.get("environment")
            keys = _map(env).keys() if isinstance(env, dict) else [str(e).split("=", 1)[0] for e in _list(env)]
            needs = s.get("depends_on")
            yield _infra("compose_service", name, None, [s.get("image")], keys, needs if isinstance(needs, (list, dict)) else [], _find(text, f"{name}:"))


def kubernetes(path: str, text: str) -> Iterator[dict]:
    for doc in _documents(text):
        doc = _map(doc)
        meta = _map(doc.get("metadata"))
        if not doc.get("kind") or not meta.get("name"):
            continue
        pod = _map(_map(_map(doc.get("spec")).get("template")).get("spec")) or _map(doc.get("spec"))
        containers = [_map(c) for c in _list(pod.get("containers"))]
        keys = [_map(e).get("name") for c in containers for e in _list(c.get("env"))] if doc["kind"] not in ("Secret", "ConfigMap") else list(_map(doc.get("data")))
        yield _infra(str(doc["kind"]).lower(), meta["name"], meta.get("namespace"), [c.get("image") for c in containers], keys, [], _find(text, meta["name"]))


def helm(path: str, text: str) -> Iterator[dict]:
    for doc in _documents(text)[:1]:
        if _map(doc).get("name"):
            yield _infra("helm_chart", doc["name"], None, [], [], [_map(d).get("name") for d in _list(doc.get("dependencies"))])


def terraform(path: str, text: str) -> Iterator[dict]:
    for m in re.finditer(r'^\s*(resource|data|module)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{', text, re.M):
        yield _infra("module" if m[1] == "module" else m[2], m[3] or m[2], None, [], [], [], _line(text, m.start(1)))


# --- documents and settings -----------------------------------------------------------------------------------------


def markdown(path: str, text: str) -> Iterator[dict]:
    fence = False
    for i, line in enumerate(text.split("\n"), 1):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence:
            if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
                yield {"kind": "title" if len(m[1]) == 1 else "heading", "target": m[2], "line": i}
            for m in re.finditer(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)", line):
                yield {"kind": "link", "target": m[1], "line": i}
            for m in re.finditer(r"\b(GET|PUT|POST|DELETE|PATCH)\s+(/[\w/{}.:-]*)", line):
                yield {"kind": "http_operation", "target": f"{m[1]} {http_path(m[2])}", "line": i}


def codeowners(path: str, text: str) -> Iterator[dict]:
    for i, line in enumerate(text.split("\n"), 1):
        parts = line.split("#", 1)[0].split()
        for owner in parts[1:]:
            yield {"kind": "owner", "target": f"{parts[0]} {owner}", "line": i}


def catalog(path: str, text: str) -> Iterator[dict]:
    for doc in _documents(text):
        doc, meta, spec = _map(doc), _map(_map(doc).get("metadata")), _map(_map(doc).get("spec"))
        if meta.get("name"):
            yield {"kind": "service", "target": str(meta["name"]), "line": _find(text, meta["name"])}
            if spec.get("owner"):
                yield {"kind": "owner", "target": f"{meta['name']} {spec['owner']}", "line": _find(text, spec["owner"])}
            for d in _list(spec.get("dependsOn")):
                yield {"kind": "depends_on", "target": f"{meta['name']} {d}", "line": _find(text, d)}


SENSITIVE = re.compile(r"passw|secret|token|api[_-]?key|private|credential", re.I)


def config_keys(path: str, text: str) -> Iterator[dict]:
    """Names of settings, never their values."""

    def keys(x: Any, prefix: str, depth: int) -> Iterator[str]:
        for k, v in _map(x).items() if depth < MOST_DEPTH else ():
            name = f"{prefix}{k}"
            if isinstance(v, dict):
                yield from keys(v, name + ".", depth + 1)
            else:
                yield name

    if re.search(r"(?:^|/)\.env[^/]*$", path):
        names = re.findall(r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", text, re.M)
    else:
        try:
            docs = [tomllib.loads(text)] if path.endswith(".toml") else _documents(text)
        except tomllib.TOMLDecodeError:
            docs = []
        names = [n for d in docs for n in keys(d, "", 0)]
    for n in names:
        yield {"kind": "sensitive" if SENSITIVE.search(n) else "plain", "target": n, "line": _find(text, n.rsplit(".", 1)[-1])}
