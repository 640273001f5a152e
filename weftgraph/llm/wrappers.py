"""Main text of web pages by wrappers that are inferred for each host.

A page is read as a stream of tokens and folded into a union-free regular expression: a tree of elements in which neighbours of
one kind, or tandem repeats of a short run of kinds, become repeated groups.  Expressions of the same host are aligned step by
step: elements that both have are matched in order and aligned inside, an element that one lacks becomes optional, texts that
differ become slots.  The outcome is the host's wrapper.  It is then told apart: text of the article, or of menus, headers,
footers, sidebars, notices, adverts, forms and comments.  Where an element, role, class or id names one of these, the name tells.
The rest the alignment tells, inside an article element as well as on hosts without one: what is the same on each of at least
``TELLING`` pages while other texts of the article differ belongs to the host and not to the article; without an article element,
texts that are mostly links, too.  Extraction reads each page once more against the wrapper of its host.

Alignment is merged in each task first, so a host costs as many rows as tasks, not pages, and then in two steps; no task holds
the pages of a host.  The slots of all hosts are broadcast if they fit ``BROADCAST_BYTES``; otherwise only those of hosts with more
than one in ``HOT`` of the pages are (there are fewer than ``HOT`` such hosts), and all other pages are joined to theirs.

White space inside a block becomes one blank; blocks are joined by one blank in page order.  A null html counts as empty.  A page
without url belongs to the host "".  Repeated rows come out as often as they came in; they count as pages of their host.  An empty
table gives no rows; other columns than the three are not read.  Broken markup is read as far as it goes: open
elements end with the page, an unfinished tag or comment is dropped.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Size up to which the slots of all hosts go to every task.
BROADCAST_BYTES = 16 << 20
#: Hosts whose wrappers a task merges before it hands them on.
HOSTS_AT_A_TIME = 5000
#: A host with more than one page in so many is hot: its pages are dealt out evenly, not by host.
HOT = 500
#: Pages of a host that must agree on a text before it counts as the host's own.
TELLING = 3
#: Tasks that share the first step of merging the wrappers of a host.
FAN = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|noscript|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|(\Z))|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first ends an open element of the others, as browsers have it.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("article aside body blockquote div footer form header html main nav ol section table td th ul".split())

# Elements, roles and class words that mark what is not the article, and what is.
OTHER_TAGS = frozenset("nav footer aside form head button select dialog menu".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
MAIN_WORDS = frozenset("article content entry main post story".split())


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "")."""
    for m in _TOKEN.finditer(page):
        if m[3]:
            if m[5] is None:
                yield ("close", m[3].lower(), "") if m[2] else ("open", m[3].lower(), m[4])
        elif m[0][0] != "<" or m[0] == "<":
            yield "text", m[0], ""


def label_of(tag: str, attributes: str) -> str:
    """The element's kind: tag, class, id and role, numbers left out."""
    if not attributes or attributes == "/":
        return tag
    found = {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    out = tag
    for mark, name in ((".", "class"), ("#", "id"), ("@", "role")):
        if value := re.sub(r"\d+", "0", " ".join(found.get(name, "").split())):
            out += mark + value.replace("/", " ")
    return out + ("!" if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "") else "")


def walk(page: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """("text", path), ("block", path) where a block begins or ends, and ("element", path) for each element that begins."""
    tags: list[str] = []
    path: list[str] = []

    def shut(at: int) -> bool:
        broke = any(t not in INLINE for t in tags[at:])
        del tags[at:], path[at:]
        return broke

    for kind, name, rest in tokens(page):
        if kind == "text":
            yield name, tuple(path)
            continue
        if kind == "open":
            ends = ("p",) if name in ENDS_P else ENDS.get(name, ())
            for at in range(len(tags) - 1, -1, -1):
                if tags[at] in ends:
                    shut(at)
                    break
                if tags[at] in SCOPES and tags[at] not in ends and not (name in ENDS_P and tags[at] == "p"):
                    break
            if name not in INLINE:
                yield "", tuple(path)
            if name not in VOID:
                tags.append(name)
                path.append(label_of(name, rest))
                yield None, tuple(path)
        else:
            for at in range(len(tags) - 1, -1, -1):
                if tags[at] == name:
                    if shut(at):
                        yield "", tuple(path)
                    break
                if tags[at] in SCOPES and name not in SCOPES:
                    break


# An expression: [label, multiplicity, children, text, pages, chars, link chars].
# multiplicity: 1, ?, + or *; text: None (none seen), a text's hash (the same on all pages) or "*" (a slot).


def _node(label: str) -> list:
    return [label, "1", [], None, 1, 0, 0]


def _wider(a: str, b: str) -> str:
    optional, many = "?" in a + b or "*" in a + b, "+" in a + b or "*" in a + b
    return "*" if optional and many else "?" if optional else "+" if many else "1"


def _text(a, b):
    return b if a is None else a if b is None or a == b else "*"


def align(a: list, b: list, same_page: bool = False) -> list:
    """The expression of both."""
    out = [a[0], "+" if same_page else _wider(a[1], b[1]), None, _text(a[3], b[3]), max(a[4], b[4]) if same_page else a[4] + b[4], a[5] + b[5], a[6] + b[6]]
    x, y = a[2], b[2]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    merged = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
            merged.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            merged.append([x[i][0], _wider(x[i][1], "?"), *x[i][2:]])
            i += 1
        else:
            merged.append([y[j][0], _wider(y[j][1], "?"), *y[j][2:]])
            j += 1
    out[2] = folded(merged)
    return out


def folded(children: list[list]) -> list[list]:
    """Neighbours of one kind as one repeated element; tandem repeats of up to four kinds as one run of repeated elements."""
    for period in (1, 2, 3, 4):
        out: list[list] = []
        for c in children:
            out.append(c)
            while len(out) >= 2 * period and all(out[-k][0] == out[-k - period][0] for k in range(1, period + 1)):
                run = [align(x, y, same_page=True) for x, y in zip(out[-2 * period : -period], out[-period:])]
                del out[-2 * period :]
                out.extend(run)
        children = out
    return children


def expression(page: str) -> list:
    """The folded expression of one page."""
    root = _node("")
    stack = [root]
    for text, path in walk(page):
        del stack[len(path) + (text is not None) :]
        if text is None:
            del stack[len(path) :]
            new = _node(path[-1])
            stack[-1][2].append(new)
            stack.append(new)
        elif text and (plain := " ".join(html.unescape(text).split())):
            node = stack[len(path)]
            node[3] = _text(node[3], format(hash_of(plain), "x"))
            node[5] += len(plain)
            node[6] += len(plain) if any(p.split(".")[0].split("#")[0] == "a" for p in path) else 0

    def fold(node: list) -> None:
        for c in node[2]:
            fold(c)
        node[2] = folded(node[2])

    fold(root)
    return root


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text.encode("utf-8", "replace"))


def _parts(label: str) -> tuple[str, set[str], str]:
    m = re.fullmatch(r"([^.#@!]*)(?:\.([^#@!]*))?(?:#([^@!]*))?(?:@([^!]*))?(!?)", label)
    if not m:
        return label, set(), ""
    words = {w.lower() for w in _WORD.findall(f"{m[2] or ''} {m[3] or ''}")}
    return m[1], words, m[4] or ("hidden" if m[5] else "")


def is_main(label: str) -> bool:
    tag, words, role = _parts(label)
    return not is_other(label, False) and (tag in ("article", "main") or role == "main" or tag in ("div", "section", "td") and bool(words & MAIN_WORDS))


def is_other(label: str, inside_main: bool) -> bool:
    tag, words, role = _parts(label)
    if tag in ("body", "html"):
        return False
    return tag in OTHER_TAGS or role in OTHER_ROLES or role == "hidden" or bool(words & OTHER_WORDS) or not inside_main and (tag == "header" or "header" in words)


def slots(wrapper: list) -> dict:
    """{"main": whether the host has an article element, "paths": those of the article's text}."""
    found: list[tuple[str, bool, bool, list]] = []

    def visit(node: list, path: tuple[str, ...], main: bool, other: bool) -> None:
        for c in node[2]:
            m = main or is_main(c[0])
            o = other or is_other(c[0], main)
            at = (*path, c[0])
            if c[3] is not None:
                found.append(("/".join(at), m, o, c))
            visit(c, at, m, o)

    if wrapper[3] is not None:  # text outside any element
        found.append(("", False, False, wrapper))
    visit(wrapper, (), False, False)
    has_main = any(m and not o for _, m, o, _ in found)
    mine = [(p, c) for p, m, o, c in found if not o and (m or not has_main)]
    differ = any(c[3] == "*" and c[4] >= TELLING for _, c in mine)
    own = {p for p, c in mine if not (differ and c[3] != "*" and c[4] >= TELLING) and (has_main or 2 * c[6] <= c[5])}
    return {"main": has_main, "paths": sorted(own)}


def text_of(page: str, host_slots: dict) -> str:
    """The article's text of one page, by the slots of its host."""
    wanted, blocks, now = host_slots["set"], [], []
    has_main = False
    rows = list(walk(page))
    if host_slots["main"]:
        has_main = any(text is None and is_main(path[-1]) for text, path in rows)
        if not has_main:  # a page of another make than its host's wrapper: read by itself
            own = slots(expression(page))
            wanted = set(own["paths"])
    for text, path in rows:
        if text is None:
            continue
        if text == "":
            if now:
                blocks.append("".join(now))
                now = []
        elif "/".join(path) in wanted:
            now.append(html.unescape(text))
    if now:
        blocks.append("".join(now))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the expression of every host, as JSON."""

    def local(batches):
        held: dict[str, list] = {}

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            return got

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, own = host_of(url), expression(page)
                held[host] = align(held[host], own) if host in held else own
                if len(held) >= HOSTS_AT_A_TIME:
                    yield out()
        if held:
            yield out()

    def merged(batches):
        now, wrapper = None, None
        for batch in batches:
            for host, w in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                if host != now and wrapper is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([json.dumps(wrapper)], pa.string())], ["host", "wrapper"])
                wrapper = json.loads(w) if host != now else align(wrapper, json.loads(w))
                now = host
        if wrapper is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([json.dumps(wrapper)], pa.string())], ["host", "wrapper"])

    schema = "host string, wrapper string"
    first = common.whole_text(pages, "url", column="html").mapInArrow(local, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(FAN)))
    part = first.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").drop("salt").mapInArrow(merged, schema)
    return part.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merged, schema)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def pick(batches):
        for batch in batches:
            made = [json.loads(w) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(slots(w)) for w in made], pa.string()), pa.array([w[4] for w in made], pa.int64())], ["host", "slots", "n"])

    known = common.written(wrappers(pages).mapInArrow(pick, "host string, slots string, n long"), "wrappers")
    rows = common.whole_text(pages, "page_id", "url", column="html")
    size = known.agg(F.sum(F.length("host") + F.length("slots"))).first()[0] or 0
    key = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {key}, url string, text string, n_chars long"

    def texts(batch, of):
        out = [text_of(page, of(url, i)) for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()))]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def ready(s: str) -> dict:
        got = json.loads(s)
        return got | {"set": set(got["paths"])}

    if size <= BROADCAST_BYTES:
        by_host = pages.sparkSession.sparkContext.broadcast({r.host: r.slots for r in known.collect()})

        def run(batches):
            made: dict[str, dict] = {}

            def of(url, _):
                host = host_of(url)
                if host not in made:
                    made[host] = ready(by_host.value[host])
                return made[host]

            for batch in batches:
                yield texts(batch, of)

        return rows.mapInArrow(run, schema)

    total = known.agg(F.sum("n")).first()[0] or 0
    hot = pages.sparkSession.sparkContext.broadcast({r.host: r.slots for r in known.where(F.col("n") * HOT > total).collect()})

    def hosts(batches):
        for batch in batches:
            own = [host_of(u) for u in batch.column("url").to_pylist()]
            # no host is called like this: the pages of a hot one go anywhere
            at = [f"\0{i}" if h in hot.value else h for i, h in enumerate(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "host", "own"])

    def run_joined(batches):
        for batch in batches:
            column, page, own = (batch.column(c).to_pylist() for c in ("slots", "html", "own"))
            made: dict[str, dict] = {}

            def of(_, i):
                if own[i] not in made:
                    made[own[i]] = ready(column[i] or hot.value.get(own[i]) or json.dumps(slots(expression(page[i]))))
                return made[own[i]]

            yield texts(batch, of)

    rows = rows.mapInArrow(hosts, f"page_id {key}, url string, html string, host string, own string")
    return rows.join(known.select("host", "slots"), "host", "left").select("page_id", "url", "html", "own", "slots").mapInArrow(run_joined, schema)
