"""Extractors of source languages: HTTP routes and calls, tests, event calls, literal SQL.

Python is parsed; the brace languages are read by call patterns over text in which comments are blanked.  A fact needs a call,
decorator or annotation; what isn't literal becomes ``{}`` if it is a whole segment, and drops the route otherwise.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .declared import _line, http_path, sql_accesses

METHODS = ("get", "put", "post", "delete", "patch", "head", "options")
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java"}


def _row(role: str, framework: str, method: str | None, route: str | None, symbol: str | None, authority: str | None, line: int) -> dict:
    return {"role": role, "framework": framework, "method": method, "route": route, "symbol": symbol, "authority": authority, "line": line}


def split_url(url: str) -> tuple[str | None, str | None]:
    """(authority, path) of a literal or template URL; parameters that fill a segment are kept as {}."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://([^/?#]*))?(.*)$", url, re.I | re.S)
    authority, path = m[1], re.sub(r"[?#].*$", "", m[2], flags=re.S)
    if not path.startswith("/"):
        if path and authority is None and not path.startswith("\x00"):
            return None, None
        path = re.sub("^\x00", "", path)
        path = path if path.startswith("/") else "/" + path
    parts = path.split("/")
    if any("\x00" in p and p != "\x00" for p in parts):
        return authority if authority and "\x00" not in authority else None, None
    return authority if authority and "\x00" not in authority else None, http_path("/".join("{}" if p == "\x00" else p for p in parts))


class _Python(ast.NodeVisitor):
    def __init__(self):
        self.rows: list[dict] = []
        self.constants: dict[str, str] = {}
        self.inside: list[str] = []

    def text(self, node: ast.AST | None) -> str | None:
        """A string expression; unknown parts are NUL."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value
        if isinstance(node, ast.Name):
            return self.constants.get(node.id, "\x00")
        if isinstance(node, ast.JoinedStr):
            return "".join(str(v.value) if isinstance(v, ast.Constant) else self.text(v.value) or "\x00" for v in node.values)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            a, b = self.text(node.left), self.text(node.right)
            return None if a is None or b is None else a + b
        return None

    def visit_Assign(self, node: ast.Assign) -> None:
        value = self.text(node.value)
        if value is not None and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            self.constants[node.targets[0].id] = value
        self.generic_visit(node)

    def _function(self, node) -> None:
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args:
                route = self.text(d.args[0])
                if route is None or not route.startswith("/") and route:
                    continue
                if d.func.attr in METHODS:
                    self.rows.append(_row("provider", "decorator", d.func.attr.upper(), http_path(route), node.name, None, d.lineno))
                elif d.func.attr == "route":
                    named = next((k.value for k in d.keywords if k.arg == "methods"), None)
                    methods = [m for m in (self.text(e) for e in getattr(named, "elts", [])) if m] or ["GET"]
                    self.rows += [_row("provider", "route", m.upper(), http_path(route), node.name, None, d.lineno) for m in methods]
        if node.name.startswith("test_"):
            self.rows.append(_row("test", "pytest", None, None, node.name, None, node.lineno))
        self.inside.append(node.name)
        self.generic_visit(node)
        self.inside.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Attribute) and node.args:
            owner = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else ""
            symbol = self.inside[-1] if self.inside else None
            if f.attr in METHODS and re.search(r"requests|httpx|session|client|http", owner, re.I):
                url = self.text(node.args[0])
                if url:
                    authority, route = split_url(url)
                    if route:
                        self.rows.append(_row("consumer", owner, f.attr.upper(), route, symbol, authority, node.lineno))
            elif f.attr in ("add_api_route", "add_url_rule") and (route := self.text(node.args[0])):
                self.rows.append(_row("provider", f.attr, "GET", http_path(route), None, None, node.lineno))
            elif f.attr in ("include_router", "register_blueprint"):
                prefix = next((self.text(k.value) for k in node.keywords if k.arg in ("prefix", "url_prefix")), None)
                child = node.args[0].id if isinstance(node.args[0], ast.Name) else node.args[0].attr if isinstance(node.args[0], ast.Attribute) else None
                if child:
                    self.rows.append(_row("mount", f.attr, None, http_path(prefix or "/"), child, None, node.lineno))
        self.generic_visit(node)


def python(path: str, text: str) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    v = _Python()
    v.visit(tree)
    yield from sorted(v.rows, key=lambda r: (r["line"], r["role"], r["route"] or ""))


_BRACE = re.compile(r"//[^\n]*|/\*(?:.|\n)*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")


def without_comments(text: str) -> str:
    return _BRACE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)


def _literal(raw: str) -> str:
    body = raw[1:-1]
    return re.sub(r"\$\{[^}]*\}", "\x00", body) if raw[0] == "`" else body


_STR = r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
_VERB = "get|put|post|delete|patch|head|options"
#: (language, role, framework, pattern, group of the method or a method, group of the text)
CALLS = [
    ("js", "provider", "express", rf"\b(?:app|router|server|fastify|api)\.({_VERB})\s*\(\s*{_STR}", 1, 2), ("js", "consumer", "axios", rf"\baxios\.({_VERB})\s*(?:<[^>]*>)?\(\s*{_STR}", 1, 2),
    ("js", "provider", "nest", rf"@(Get|Put|Post|Delete|Patch)\(\s*{_STR}?\s*\)", 1, 2), ("js", "test", "test", rf"\b(?:it|test)\s*\(\s*{_STR}", None, 1),
    ("go", "provider", "router", rf"\b\w+\.(GET|PUT|POST|DELETE|PATCH|Get|Put|Post|Delete|Patch)\s*\(\s*{_STR}\s*,", 1, 2), ("go", "provider", "nethttp", rf"\b(?:http|mux)\.Handle(?:Func)?\s*\(\s*{_STR}", None, 1),
    ("go", "consumer", "nethttp", rf"\bhttp\.(Get|Post|Head)\s*\(\s*{_STR}", 1, 2), ("go", "test", "testing", r"\bfunc\s+(Test\w+)\s*\(", None, None),
    ("java", "provider", "spring", rf"@(Get|Put|Post|Delete|Patch)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?{_STR}", 1, 2), ("java", "consumer", "webclient", rf"\.(get|put|post|delete|patch)\(\)\s*\.uri\(\s*{_STR}", 1, 2),
    ("java", "consumer", "resttemplate", rf"\.(get|post)For(?:Object|Entity)\(\s*{_STR}", 1, 2), ("rust", "consumer", "reqwest", rf"\b(?:reqwest|client|http)(?:::|\.)({_VERB})\s*\(\s*{_STR}", 1, 2),
    ("rust", "provider", "actix", rf"#\[({_VERB})\(\s*{_STR}\s*\)\]", 1, 2), ("rust", "test", "test", r"#\[(?:tokio::)?test\]\s*(?:async\s+)?fn\s+(\w+)", None, None),
]


def brace(path: str, text: str) -> Iterator[dict]:
    """JavaScript, TypeScript, Go, Java and Rust."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1], "")
    group = "js" if language in ("javascript", "typescript") else language
    plain = without_comments(text)
    rows = []
    for lang, role, framework, pattern, method, at in CALLS:
        if lang != group:
            continue
        for m in re.finditer(pattern, plain):
            line = _line(plain, m.start())
            if role == "test":
                rows.append(_row("test", framework, None, None, _literal(m[at]) if at else m[1], None, line))
                continue
            raw = _literal(m[at]) if m[at] else "/"
            verb = m[method].upper() if method else (raw.split(" ", 1)[0] if " " in raw else "GET")
            raw = raw.split(" ", 1)[1] if not method and " " in raw else raw
            authority, route = split_url(raw) if role == "consumer" else (None, http_path(raw) if "\x00" not in raw else None)
            if route:
                rows.append(_row(role, framework, verb, route, None, authority, line))
    if group == "js":
        for m in re.finditer(rf"\bfetch\s*\(\s*{_STR}(?:\s*,\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}})?", plain):
            verb = (x := re.search(r"\bmethod\s*:\s*['\"](\w+)['\"]", m[2] or "")) and x[1].upper() or "GET"
            authority, route = split_url(_literal(m[1]))
            if route:
                rows.append(_row("consumer", "fetch", verb, route, None, authority, _line(plain, m.start())))
    if group == "rust":
        for m in re.finditer(rf"\.route\s*\(\s*{_STR}\s*,\s*((?:[^()]|\([^()]*\))*)\)", plain):
            for verb in re.findall(rf"\b({_VERB})\s*\(", m[2]):
                rows.append(_row("provider", "axum", verb.upper(), http_path(_literal(m[1])), None, None, _line(plain, m.start())))
        for m in re.finditer(rf"\.nest\s*\(\s*{_STR}", plain):
            rows.append(_row("mount", "axum", None, http_path(_literal(m[1])), None, None, _line(plain, m.start())))
    yield from sorted(rows, key=lambda r: (r["line"], r["role"], r["route"] or "", r["method"] or ""))


# What tells brokers apart, in the order that they are tried, and their calls that declare, publish and subscribe.
# Statements are compared in lower case, without blanks and underscores; a mark may be several parts that must all occur.
BROKERS = [
    ("aws_sns", [("topicarn",), ("sns.",), ("snsclient",)], ("createtopic",), ("publish", "send"), ("subscribe",)),
    ("aws_sqs", [("queueurl",), ("sqs.",), ("sqsclient",), ("sendmessage",), ("receivemessage",)], ("createqueue",), ("sendmessage",), ("receivemessage", "startmessagepoller", "sqslistener")),
    ("google_pub_sub", [("pubsub",), ("publisherclient",), ("subscriberclient",), ("topicpath",), ("subscriptionpath",)], ("createtopic", "createsubscription"), ("publish", "publishmessage"), ("subscribe", "pull", "streamingpull", "receive", "pubsubsubscription")),
    ("rabbit_mq", [("rabbit",), ("amqp",), ("basicpublish",), ("basicconsume",), ("queuedeclare",), ("exchangedeclare",)], ("queuedeclare", "exchangedeclare", "assertqueue", "assertexchange"), ("basicpublish", "publish", "send"), ("basicconsume", "consume", "get", "rabbitlistener")),
    ("kafka", [("kafka",), ("baserecord::to",), ("futurerecord::to",), ("newtopic",), ("producer.", "topic"), ("consumer.", "subscribe")], ("newtopic", "createtopics"), ("send", "publish", "produce", "writemessages"), ("subscribe", "subscribetopics", "assign", "poll", "kafkalistener")),
    ("nats", [("nats",), ("jetstream",), ("^nc.",), ("^js.",)], ("addstream", "createstream"), ("publish", "request"), ("subscribe", "queuesubscribe")),
    ("generic", [()], ("declarechannel", "createchannel"), ("publish",), ("subscribe",)),
]


def _marked(statement: str, marks: list[tuple[str, ...]]) -> bool:
    return any(all(statement.startswith(part[1:]) if part[0] == "^" else part in statement for part in mark) for mark in marks)


def events(path: str, text: str) -> Iterator[dict]:
    """Publishing and subscribing calls whose first text is the channel."""
    plain = without_comments(text) if not path.endswith(".py") else re.sub(r"#[^\n]*", lambda m: " " * len(m[0]), text)
    for n, line in enumerate(plain.split("\n"), 1):
        if re.match(r"\s*(?:def|func|fn|function|public|private)\b", line):
            continue
        masked = re.sub(_STR, '""', line)
        squeezed = re.sub(r"[\s_]", "", masked).lower()
        for broker, marks, *calls in BROKERS:
            if not _marked(squeezed, marks):
                continue
            role = next((r for r, names in zip(("declaration", "publisher", "subscriber"), calls) if re.search(rf"(?:^|[.:@]|\bawait|\bnew)(?:{'|'.join(names)})\(", squeezed)), None)
            if role:
                channel = re.search(_STR, line[line.index("(") :])
                if channel and "\x00" not in _literal(channel[1]) and _literal(channel[1]):
                    yield {"broker": broker, "role": role, "channel": _literal(channel[1]), "schema": None, "fields": [], "line": n}
                break


def literal_sql(path: str, text: str) -> Iterator[dict]:
    """Tables that SQL in texts of the source reads and writes."""
    for m in re.finditer(r'"""((?:.|\n)*?)"""|r#"((?:.|\n)*?)"#|"((?:[^"\\]|\\.)*)"', text):
        body = m[1] or m[2] or m[3] or ""
        if re.match(r"\s*(?:select|with|insert|update|delete|merge)\b", body, re.I):
            for op, table, at in sql_accesses(body):
                yield {"kind": op, "table": table, "name": table, "type": None, "nullable": None, "references": None, "line": _line(text, m.start() + at)}
