"""HTML by declared rules: steps that rewrite the tree, containers, items, fields and repeated child objects. The parser runs in tasks on pages Spark has dealt out."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_pattern
from ..session import ship

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_RAW = frozenset(("script", "style"))
_SIMPLE = re.compile(
    r"""(?P<tag>\*|[\w-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:(?P<pseudo>first-child|last-child|only-child|nth-child|not|contains)(?:\((?P<arg>[^()]*)\))?""",
    re.X,
)


class Node:
    """An element: kids are texts and elements in order."""

    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []

    def add(self, kid: Node | str) -> None:
        self.kids.append(kid)
        if isinstance(kid, Node):
            kid.parent = self

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.kids = [k for k in self.parent.kids if k is not self]
            self.parent = None

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in _RAW:
                todo.extend(reversed(node.kids))
        return " ".join("".join(out).split())

    def inner(self) -> str:
        """The markup inside."""
        out: list[str] = []
        todo: list[Node | str | tuple[str]] = list(reversed(self.kids))
        raw = self.tag in _RAW
        while todo:
            step = todo.pop()
            if isinstance(step, tuple):
                out.append(step[0])
            elif isinstance(step, str):
                out.append(step if raw or out and out[-1][1:].split(" ")[0].rstrip(">") in _RAW else escape(step, quote=False))
            else:
                out.append(f"<{step.tag}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in step.attrs.items())}>")
                if step.tag not in _VOID:
                    todo.append((f"</{step.tag}>",))
                todo.extend(reversed(step.kids))
        return "".join(out)

    def walk(self) -> Iterator[Node]:
        """Elements inside, in the order of the page."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].add(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].add(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


# --- selectors


@lru_cache(maxsize=4096)
def _compiled(selector: str) -> tuple[tuple[tuple[str, tuple], ...], ...]:
    """Alternatives, each a row of (combinator before it, conditions). What cannot be read selects nothing."""
    out = []
    for one in re.split(r",(?![^\[(]*[\])])", selector):
        parts, combinator = [], " "
        for token in re.findall(r"""[>+~]|(?:[^\s>+~\[(]|\[[^\]]*\]|\([^)]*\))+""", one.strip()):
            if token in (">", "+", "~"):
                combinator = token
                continue
            conditions, at = [], 0
            while at < len(token):
                m = _SIMPLE.match(token, at)
                if not m or m["tag"] and at:
                    conditions = None
                    break
                conditions.append(tuple(sorted((k, v) for k, v in m.groupdict().items() if v is not None)))
                at = m.end()
            if conditions is None:
                parts = []
                break
            parts.append((combinator, tuple(conditions)))
            combinator = " "
        if parts:
            out.append(tuple(parts))
    return tuple(out)


def _holds(node: Node, condition: tuple) -> bool:
    c = dict(condition)
    if "tag" in c:
        return c["tag"] in ("*", node.tag)
    if "cls" in c:
        return c["cls"] in node.attrs.get("class", "").split()
    if "id" in c:
        return node.attrs.get("id") == c["id"]
    if "attr" in c:
        value, want = node.attrs.get(c["attr"].lower()), c.get("dq", c.get("sq", c.get("bare")))
        if value is None or want is None:
            return value is not None
        tests = {"=": value == want, "~=": want in value.split(), "|=": value == want or value.startswith(want + "-"), "^=": want != "" and value.startswith(want), "$=": want != "" and value.endswith(want), "*=": want != "" and want in value}
        return tests[c["op"]]
    argument = c.get("arg", "")
    if c["pseudo"] == "not":
        return not any(len(p) == 1 and all(_holds(node, x) for x in p[0][1]) for p in _compiled(argument))
    if c["pseudo"] == "contains":
        return argument.strip("\"' ") in node.text()
    same = [k for k in node.parent.kids if isinstance(k, Node)] if node.parent else [node]
    place = next(k for k, x in enumerate(same, 1) if x is node)
    if c["pseudo"] == "nth-child":
        wanted = argument.strip()
        return wanted.isdigit() and place == int(wanted) or wanted == "odd" and place % 2 == 1 or wanted == "even" and place % 2 == 0
    return (c["pseudo"] == "last-child" or place == 1) and (c["pseudo"] == "first-child" or place == len(same))


def _before(node: Node) -> list[Node]:
    """Elements beside and before it, the nearest first."""
    if node.parent is None:
        return []
    out = []
    for k in node.parent.kids:
        if k is node:
            break
        if isinstance(k, Node):
            out.append(k)
    return out[::-1]


def _fits(node: Node, parts: tuple, scope: Node) -> bool:
    """Whether the node is what the parts end with, all of it inside the scope."""
    combinator, conditions = parts[-1]
    if not all(_holds(node, c) for c in conditions):
        return False
    if len(parts) == 1:
        return combinator == " " or combinator == ">" and node.parent is scope
    rest = parts[:-1]
    if combinator in "+~":
        beside = _before(node)
        return any(_fits(b, rest, scope) for b in (beside[:1] if combinator == "+" else beside))
    above = node.parent
    while above is not None and above is not scope:
        if _fits(above, rest, scope):
            return True
        if combinator == ">":
            return False
        above = above.parent
    return False


def select(node: Node, selector: str) -> list[Node]:
    """Descendants in the order of the page, by tag, .class, #id, [attribute] tests and simple pseudo classes, with the usual combinators and commas."""
    ways = _compiled(selector)
    return [x for x in node.walk() if any(_fits(x, parts, node) for parts in ways)] if ways else []


def matches(node: Node, selector: str) -> bool:
    """Whether the element itself is one the selector's last part names."""
    return any(len(parts) == 1 and all(_holds(node, c) for c in parts[0][1]) for parts in _compiled(selector))


# --- rewriting


def rewrite(root: Node, steps: Sequence[tuple[str, str]]) -> Node:
    """The tree after each step (kind, selector) in turn.

    remove_elements: they go with all inside. unwrap_elements: what is inside takes their place. merge_tables: the rows of all but
    the first go to the end of the first one's body (or of itself, if it has none), and the others go. Other kinds change nothing.
    """
    for kind, selector in steps:
        found = select(root, selector)
        if kind == "remove_elements":
            for node in found:
                node.detach()
        elif kind == "unwrap_elements":
            for node in found:
                at = node.parent
                inside, node.kids, node.parent = node.kids, [], None
                for k in inside:
                    if isinstance(k, Node):
                        k.parent = at
                at.kids = [x for k in at.kids for x in (inside if k is node else [k])]
        elif kind == "merge_tables" and len(found) > 1:
            body = next(iter(select(found[0], "tbody")), found[0])
            for table in found[1:]:
                for row in select(table, "tr"):
                    row.detach()
                    body.add(row)
                table.detach()
    return root


# --- fields


def _match(pattern: str, text: str, group: int | None = None) -> str | None:
    fine = safe_pattern(pattern)
    m = re.search(fine, text) if fine else None
    if not m:
        return None
    return (m[group] if group <= (m.re.groups or 0) else None) if group is not None else m[1] if m.re.groups else m[0]


def field_of(node: Node, rule: str | Mapping) -> str | None:
    """A short rule: `_text`, `_regex:pattern` (first group of the text), `selector` or `selector|attr:name`. A long one: selector, method
    (text, attribute, html, regex or constant), attribute, pattern, group, value, default. The element itself counts where nothing inside fits the selector."""
    if not isinstance(rule, str):
        value = rule.get("value") if rule.get("method") == "constant" else _long(node, rule)
        return value if value else rule.get("default")
    if rule == "_text":
        return node.text() or None
    if rule.startswith("_regex:"):
        return _match(rule[7:], node.text())
    selector, _, attr = rule.partition("|attr:")
    return _long(node, {"selector": selector, "method": "attribute" if attr else "text", "attribute": attr})


def _long(node: Node, rule: Mapping) -> str | None:
    selector = (rule.get("selector") or "").partition("|attr:")[0]
    hit = next(iter(select(node, selector)), node if matches(node, selector) else None) if selector else node
    if hit is None:
        return None
    method = rule.get("method") or ("regex" if rule.get("pattern") else "text")
    if method == "attribute":
        return hit.attrs.get(rule.get("attribute") or "") or None
    if method == "html":
        return hit.inner() or None
    if method == "regex":
        found = _match(rule.get("pattern") or "", hit.text(), rule.get("group") or 1)
        return found.strip() or None if found else None
    return hit.text() or None if method == "text" else None


def children_of(node: Node, selector: str, fields: Mapping[str, str | Mapping]) -> list[dict[str, str]]:
    """An object for each element inside that fits, of the fields that are there; without any, none."""
    found = ({f: v for f, rule in fields.items() if (v := field_of(x, rule))} for x in select(node, selector))
    return [x for x in found if x]


def items_of(html: str | None, rules: Mapping) -> Iterator[tuple[dict[str, str | None], dict[str, list[dict[str, str]]]]]:
    """Fields and child objects of each item of a page. rules: container, item, fields, and maybe steps [[kind, selector]] and children {name: {selector, fields}}.

    Without a container the whole page is one; without items each container is one. An item in several containers comes once.
    """
    root = rewrite(tree(html), [tuple(s) for s in rules.get("steps") or ()])
    boxes = select(root, rules["container"]) if rules.get("container") else [root]
    seen: set[int] = set()
    for box in boxes:
        for node in select(box, rules["item"]) if rules.get("item") else [box]:
            if id(node) not in seen:
                seen.add(id(node))
                yield {f: field_of(node, rule) for f, rule in rules["fields"].items()}, {name: children_of(node, c["selector"], c["fields"]) for name, c in (rules.get("children") or {}).items()}


def extract(
    pages: DataFrame, container: str, item: str, fields: dict[str, str | Mapping], url: str = "url", html: str = "html", steps: Sequence[tuple[str, str]] = (), children: Mapping[str, tuple[str, Mapping]] | None = None
) -> DataFrame:
    """One row for each item of each page: url, place, the fields as strings (null where a rule finds nothing), and for each of
    children {name: (selector, fields)} an array of structs. The pages' trees are rewritten by steps before."""
    ship(pages.sparkSession)
    children = children or {}
    rules = {"container": container, "item": item, "fields": fields, "steps": list(steps), "children": {n: {"selector": s, "fields": f} for n, (s, f) in children.items()}}
    kinds = {n: pa.list_(pa.struct([(f, pa.string()) for f in own])) for n, (_, own) in children.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"url": [], "place": [], **{f: [] for f in (*fields, *children)}}
            for where, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place, (values, nested) in enumerate(items_of(text, rules)):
                    for name, value in {"url": where, "place": place, **values, **nested}.items():
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k) or (pa.int64() if k == "place" else pa.string())) for k, v in out.items()})

    nested = "".join(f", `{n}` array<struct<{', '.join(f'`{f}`: string' for f in own)}>>" for n, (_, own) in children.items())
    return pages.select(url, html).mapInArrow(run, "url string, place bigint" + "".join(f", `{f}` string" for f in fields) + nested)


@lru_cache(maxsize=4096)
def _read(rules: str) -> dict | None:
    try:
        found = json.loads(rules)
    except ValueError:
        return None
    return found if isinstance(found, dict) and isinstance(found.get("fields"), dict) else None


def extract_by_rule(pages: DataFrame, keys: Sequence[str], html: str = "html", rules: str = "rules") -> DataFrame:
    """Each page by the rules in its own row (JSON, as items_of() takes them): keys, place, fields map<string,string>, children map<string,array<map<string,string>>>.

    Pages without rules, or with ones that cannot be read, have no items. Fields that are not found are left out.
    """
    ship(pages.sparkSession)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, place, fields, children = [], [], [], []
            for k, (text, rule) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                own = _read(rule) if rule is not None else None
                for at, (values, nested) in enumerate(items_of(text, own)) if own else ():
                    of.append(k)
                    place.append(at)
                    fields.append([(f, v) for f, v in values.items() if v is not None])
                    children.append([(name, [list(x.items()) for x in found]) for name, found in nested.items()])
            rows = [batch.column(c).take(pa.array(of, pa.int32())) for c in range(n)]
            kind = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*rows, pa.array(place, pa.int64()), pa.array(fields, kind), pa.array(children, pa.map_(pa.string(), pa.list_(kind)))], names=[*keys, "place", "fields", "children"])

    own = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html, rules).mapInArrow(run, f"{own}, place bigint, fields map<string,string>, children map<string,array<map<string,string>>>")


# --- structure


def structure_hash(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, structure): a hash of tags with their class, id and role, without texts; equal for pages of one layout."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = ["|".join(f"{n.tag}.{n.attrs.get('class', '')}#{n.attrs.get('id', '')}@{n.attrs.get('role', '')}" for n in tree(t).walk()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"url": batch.column(0), "structure": pa.array([hashlib.sha256(s.encode()).hexdigest() for s in shapes])})

    return pages.select(url, html).mapInArrow(run, "url string, structure string")


def tag_hash(html: Column) -> Column:
    """A hash of the tags in order, without a parser: opening tags of the page in lower case, what stands inside scripts and styles left out."""
    bare = F.coalesce(html, F.lit(""))
    for tag in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?is)(<{tag}\b[^>]*>).*?</{tag}\s*>", "$1")
    return F.sha2(F.lower(F.array_join(F.regexp_extract_all(bare, F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), "|")), 256)
