"""Document parsers: JSON, Markdown and a syntax-level view of TypeScript as trees of nodes.

A parser turns one text into rows in pre-order; offsets count UTF-16 units.  They
run inside ``mapInArrow`` tasks, one document at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from ..functions.values import tagged_row


class SyntaxFault(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


@dataclass(slots=True)
class Row:
    local: str
    kind: str
    edge: str
    parent: int
    sib: int
    depth: int
    start: int
    end: int
    attrs: dict = field(default_factory=dict)
    pre: int = 0
    last: int = 0


class Tree:
    """Rows in pre-order; ``close`` sets the ranges."""

    def __init__(self):
        self.rows: list[Row] = []
        self.children: dict[int, int] = {}
        self.notes: list[tuple[str, str, int, int]] = []

    def add(self, parent: int, local: str, kind: str, edge: str, start: int, end: int, **attrs) -> int:
        sib = self.children.get(parent, 0)
        self.children[parent] = sib + 1
        at = len(self.rows)
        depth = self.rows[parent].depth + 1 if parent >= 0 else 0
        self.rows.append(Row(local, kind, edge, parent, sib, depth, start, end, attrs, at, at))
        return at

    def close(self, units=None) -> Tree:
        for r in reversed(self.rows):
            if r.parent >= 0:
                self.rows[r.parent].last = max(self.rows[r.parent].last, r.last)
        if units:
            for r in self.rows:
                r.start, r.end = units(r.start), units(r.end)
        return self


def utf16(text: str):
    """Function from code points to UTF-16 units, or None where they are the same."""
    wide = [i for i, c in enumerate(text) if ord(c) > 0xFFFF] if not text.isascii() else []
    return (lambda k: k + bisect_left(wide, k)) if wide else None


# -- JSON ------------------------------------------------------------------------

_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
_NUM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_GAP = re.compile(r"[\t\n\r ]*")
_NAMED = (("true", True), ("false", False), ("null", None))
JSON_ATTRS = {"encoding": "string", "finalNewline": "boolean", "size": "number", "name": "string", "index": "number", "valueType": "string", "value": "tagged"}


def _decode_string(raw: str) -> str:
    import json

    return json.loads(raw, strict=True) if "\\" in raw else raw[1:-1]


def parse_json(text: str) -> Tree:
    """Strict JSON; repeated keys stay separate properties; nesting has no limit."""
    bom = text.startswith("﻿")
    body = text[1:] if bom else text
    tree, n = Tree(), len(body)
    root = tree.add(-1, "$", "json::root", "json::mount", 0, n, encoding="utf8-bom" if bom else "utf8", finalNewline=body.endswith(("\n", "\r")))
    # open containers: [row, is object, members so far]
    stack: list[list] = []
    at = _GAP.match(body, 0).end()
    parent, local = root, "$/value:0"
    while True:
        # one value at ``at``, child of ``parent``
        c = body[at : at + 1]
        done = True
        if c == "{" or c == "[":
            row = tree.add(parent, local, "json::object" if c == "{" else "json::array", "json::children", at, at + 1, size=0)
            at = _GAP.match(body, at + 1).end()
            if body[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
                tree.rows[row].end = at
            else:
                stack.append([row, c == "{", 0])
                done = False
        elif c == '"':
            m = _STRING.match(body, at)
            if not m:
                raise SyntaxFault("invalid string", at)
            tree.add(parent, local, "json::scalar", "json::children", at, m.end(), valueType="string", value=_decode_string(m[0]))
            at = m.end()
        else:
            for word, value in _NAMED:
                if body.startswith(word, at):
                    tree.add(parent, local, "json::scalar", "json::children", at, at + len(word), valueType="null" if value is None else "boolean", value=value)
                    at += len(word)
                    break
            else:
                m = _NUM.match(body, at)
                if not m:
                    raise SyntaxFault("expected a value", at)
                number = float(m[0])
                if number in (float("inf"), float("-inf")):
                    raise SyntaxFault("a number beyond the range of doubles", at)
                tree.add(parent, local, "json::scalar", "json::children", at, m.end(), valueType="number", value=number)
                at = m.end()
        while True:
            if done:
                # the value ends: so may properties, items and containers around it
                if not stack:
                    at = _GAP.match(body, at).end()
                    if at < n:
                        raise SyntaxFault("content after the document", at)
                    return tree.close(utf16(body))
                tree.rows[parent].end = at
                at = _GAP.match(body, at).end()
                top = stack[-1]
                mark = body[at : at + 1]
                if mark == ("}" if top[1] else "]"):
                    at += 1
                    tree.rows[top[0]].end = at
                    tree.rows[top[0]].attrs["size"] = top[2]
                    stack.pop()
                    parent = tree.rows[top[0]].parent
                    continue
                if mark != ",":
                    raise SyntaxFault("expected , or the end of the container", at)
                at = _GAP.match(body, at + 1).end()
            top = stack[-1]
            base, k = tree.rows[top[0]].local, top[2]
            top[2] += 1
            if top[1]:
                m = _STRING.match(body, at)
                if not m:
                    raise SyntaxFault("expected a property name", at)
                parent = tree.add(top[0], f"{base}/property:{k}", "json::property", "json::children", at, at, name=_decode_string(m[0]))
                at = _GAP.match(body, m.end()).end()
                if body[at : at + 1] != ":":
                    raise SyntaxFault("expected :", at)
                at = _GAP.match(body, at + 1).end()
            else:
                parent = tree.add(top[0], f"{base}/index:{k}", "json::index", "json::children", at, at, index=k)
            local = tree.rows[parent].local + "/value:0"
            break


# -- Markdown --------------------------------------------------------------------

MARKDOWN_ATTRS = {"encoding": "string", "finalNewline": "boolean", "format": "string", "content": "string", "level": "number", "title": "string", "text": "string", "html": "boolean", "ordered": "boolean", "size": "number", "index": "number", "destination": "string", "reference": "boolean", "language": "string", "closed": "boolean"}
_INDENT = " {0,3}"
_FENCE = re.compile(rf"^{_INDENT}(?P<mark>`{{3,}}|~{{3,}})(?P<info>[^`]*)$")
_FENCE_START = re.compile(rf"^{_INDENT}(?:`{{3}}|~{{3}})")
_HEADING = re.compile(rf"^{_INDENT}(?P<marks>#{{1,6}})[ \t]+(?P<title>.+?)[ \t]*#*[ \t]*$")
_HEADING_START = re.compile(rf"^{_INDENT}#{{1,6}}[ \t]+")
_ITEM = re.compile(rf"^{_INDENT}(?:[*+-]|(?P<digits>\d+)[).])[ \t]+(?P<body>.+)$", re.ASCII)
_ITEM_START = re.compile(rf"^{_INDENT}(?:[*+-]|\d+[).])[ \t]+", re.ASCII)
_DEFINITION = re.compile(r"^\[(?P<name>[^\]]+)\]:\s*(?P<target>\S+)")
_LINK = re.compile(r"\[(?P<text>[^\]]+)\](?:\((?P<inline>[^)]+)\)|\[(?P<name>[^\]]+)\])")
_LINES = re.compile(r"([^\r\n]*)(\r\n|\r|\n|$)")


def text_lines(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end of content, end with the line break, content) of every line."""
    out, at = [], 0
    while at < len(text):
        m = _LINES.match(text, at)
        out.append((at, m.end(1), m.end(), m[1]))
        at = m.end()
    return out


@dataclass
class _Block:
    kind: str
    start: int
    end: int
    attrs: dict
    links: list = field(default_factory=list)
    items: list = field(default_factory=list)
    title: tuple | None = None


def _links(value: str, base: int, known: dict) -> list:
    out = []
    for k, m in enumerate(_LINK.finditer(value)):
        inline = m["inline"]
        target = inline if inline is not None else known.get(m["name"].lower())
        if target is not None:
            out.append((k, base + m.start(), base + m.end(), m["text"], target, inline is None))
    return out


def _blocks(text: str, notes: list) -> list[_Block]:
    lines = text_lines(text)
    known = {m["name"].lower(): m["target"] for m in (_DEFINITION.match(x[3]) for x in lines) if m}
    out: list[_Block] = []
    i, n, level = 0, len(lines), 0
    if lines and lines[0][3] == "---":
        stop = next((j for j in range(1, n) if lines[j][3] == "---"), None)
        if stop is None:
            notes.append(("markdown.unclosed-frontmatter", "frontmatter has no end", lines[0][0], lines[0][1]))
        else:
            out.append(_Block("frontmatter", 0, lines[stop][2], {"format": "yaml", "content": text[lines[0][2] : lines[stop][0]]}))
            i = stop + 1
    while i < n:
        start, stop, after, line = lines[i]
        if not line.strip():
            i += 1
            continue
        m = _FENCE.match(line)
        if m:
            mark = m["mark"]
            j = next((j for j in range(i + 1, n) if lines[j][3].strip().startswith(mark[0]) and len(lines[j][3].strip()) >= len(mark)), None)
            inner = (after, lines[j][0] if j is not None else len(text))
            words = m["info"].strip().split()
            out.append(_Block("code-block", start, lines[j][2] if j is not None else len(text), {"language": words[0] if words else "", "content": text[inner[0] : inner[1]], "closed": j is not None}, title=inner))
            if j is None:
                notes.append(("markdown.unclosed-fence", "a fence is open at the end", start, stop))
            i = n if j is None else j + 1
            continue
        m = _HEADING.match(line)
        if m:
            title, depth = m["title"], len(m["marks"])
            at = start + line.index(title)
            out.append(_Block("heading", start, after, {"level": depth, "title": title}, _links(title, at, known), title=(at, at + len(title))))
            if level and depth > level + 1:
                notes.append(("markdown.skipped-heading-level", f"from level {level} to {depth}", start, stop))
            level, i = depth, i + 1
            continue
        m = _ITEM.match(line)
        if m:
            ordered, first, items = m["digits"] is not None, i, []
            while i < n:
                m = _ITEM.match(lines[i][3])
                if not m or (m["digits"] is not None) != ordered:
                    break
                at = lines[i][0] + lines[i][3].index(m["body"])
                items.append((lines[i][0], lines[i][2], m["body"], _links(m["body"], at, known)))
                i += 1
            out.append(_Block("list", lines[first][0], lines[i - 1][2], {"ordered": ordered, "size": len(items)}, items=items))
            continue
        i += 1
        while i < n and lines[i][3].strip() and not any(p.match(lines[i][3]) for p in (_HEADING_START, _FENCE_START, _ITEM_START)):
            i += 1
        value = text[start : lines[i - 1][2]].rstrip("\r\n")
        out.append(_Block("paragraph", start, lines[i - 1][2], {"text": value, "html": value.lstrip().startswith("<")}, _links(value, start, known)))
    return out


def _put_block(tree: Tree, parent: int, number: int, b: _Block, edge: str, deep: bool):
    local = f"block:{number}"
    at = tree.add(parent, local, f"markdown::{b.kind}", edge, b.start, b.end, **b.attrs)
    if not deep:
        return
    for k, start, end, text, target, reference in b.links:
        tree.add(at, f"{local}/link:{k}", "markdown::link", "markdown::children", start, end, text=text, destination=target, reference=reference)
    for k, (start, end, body, links) in enumerate(b.items):
        item = tree.add(at, f"{local}/item:{k}", "markdown::list-item", "markdown::children", start, end, text=body, index=k)
        for j, s, e, text, target, reference in links:
            tree.add(item, f"{local}/item:{k}/link:{j}", "markdown::link", "markdown::children", s, e, text=text, destination=target, reference=reference)


@dataclass
class Section:
    number: int
    heading: int
    level: int
    title: str
    start: int
    end: int
    body: tuple[int, int]
    blocks: list
    children: list


def sections_of(text: str, blocks: list[_Block]) -> list[Section]:
    """Sections in order; those without a parent come first in their own right."""
    heads = [(i, b) for i, b in enumerate(blocks) if b.kind == "heading"]
    out: list[Section] = []
    for k, (i, b) in enumerate(heads):
        level = b.attrs["level"]
        peer = next((o.start for _, o in heads[k + 1 :] if o.attrs["level"] <= level), len(text))
        body_end = heads[k + 1][1].start if k + 1 < len(heads) and heads[k + 1][1].start < peer else peer
        own = [j for j, o in enumerate(blocks) if o.start >= b.end and o.end <= body_end]
        out.append(Section(k, i, level, b.attrs["title"], b.start, peer, (b.end, body_end), own, []))
        above = next((s for s in reversed(out[:-1]) if s.level < level and s.end >= peer), None)
        if above is not None:
            above.children.append(k)
    return out


def parse_markdown(text: str, view: str = "syntax") -> Tree:
    """The blocks of a text, or (view "sections") its sections with their own blocks."""
    bom = text.startswith("﻿")
    body = text[1:] if bom else text
    tree = Tree()
    blocks = _blocks(body, tree.notes)
    sections = view.endswith(("sections", "section-tree"))
    root = tree.add(-1, "$sections" if sections else "$syntax", "markdown::document", "markdown::mount", 0, len(body), encoding="utf8-bom" if bom else "utf8", finalNewline=body.endswith(("\n", "\r")))
    if not sections:
        for i, b in enumerate(blocks):
            _put_block(tree, root, i, b, "markdown::children", True)
        return tree.close(utf16(body))
    every = sections_of(body, blocks)
    nested = {c for s in every for c in s.children}

    def put(parent: int, s: Section):
        at = tree.add(parent, f"section:{s.number}", "markdown::section", "markdown::sections", s.start, s.end, level=s.level, title=s.title)
        for i in [s.heading, *s.blocks]:
            _put_block(tree, at, i, blocks[i], "markdown::sections", False)
        for c in s.children:
            put(at, every[c])

    for s in every:
        if s.number not in nested:
            put(root, s)
    return tree.close(utf16(body))


# -- TypeScript, syntax only -------------------------------------------------------

TS_ATTRS = {"language": "string", "declaration": "boolean", "name": "string", "callee": "string", "module": "string", "syntaxKind": "string"}
_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|[{}()\[\];,.:=<>+\-*/%!&|?@#^~])|(?P<other>.)",
    re.S,
)
_KEYWORDS = frozenset("abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function if implements import in instanceof interface let new null of package private protected public readonly return static super switch this throw true try type typeof undefined var void while with yield".split())


def parse_typescript(text: str, language: str = "typescript", declaration: bool = False) -> Tree:
    """Functions, classes, variables, calls, imports and identifiers by their syntax; no types, no symbols."""
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
    tree = Tree()
    root = tree.add(-1, f"source-file:0:{len(text)}", "ts::source-file", "ts::mount", 0, len(text), language=language, declaration=declaration)
    opens = {"(": ")", "[": "]", "{": "}"}
    match, stack = {}, []
    for k, (_, t, _, _) in enumerate(tokens):
        if t in opens:
            stack.append(k)
        elif t in opens.values():
            if not stack or opens[tokens[stack[-1]][1]] != t:
                tree.notes.append(("ts.syntax-error", f"unexpected {t}", tokens[k][2], tokens[k][3]))
            else:
                match[stack.pop()] = k
    for k in stack:
        tree.notes.append(("ts.syntax-error", f"{tokens[k][1]} is never closed", tokens[k][2], tokens[k][3]))
    n = len(tokens)

    def statement_end(k: int) -> int:
        """Index of the last token of the statement that begins at k."""
        while k < n:
            t = tokens[k]
            if t[1] in opens:
                k = match.get(k, n - 1)
            elif t[1] == ";":
                return k
            elif t[1] in ")]}":
                return k - 1
            if k + 1 < n and "\n" in text[tokens[k][3] : tokens[k + 1][2]] and tokens[k + 1][1] not in (".", "(", "[", "=", "=>", "{", "+", "-", "?", ":", "&", "|") and tokens[k][1] not in (",", "=", "=>", ".", "+", "-", "(", "{", "?", ":", "&", "|"):
                return k
            k += 1
        return n - 1

    def body_end(k: int) -> int:
        """Index of the brace that closes the first block from k on."""
        while k < n and tokens[k][1] not in "{;":
            k = match.get(k, n - 1) + 1 if tokens[k][1] in "([" else k + 1
        return match.get(k, n - 1) if k < n and tokens[k][1] == "{" else min(k, n - 1)

    def put(parent, kind, a, b, **attrs) -> int:
        start, end = tokens[a][2], tokens[b][3]
        return tree.add(parent, f"{kind}:{start}:{end}", f"ts::{kind}", "ts::children", start, end, **attrs)

    def walk(parent: int, a: int, b: int):
        k = a
        while k <= b:
            group, t, _, _ = tokens[k]
            nxt = tokens[k + 1] if k + 1 <= b else (None, "", 0, 0)
            if t == "import" and nxt[1] != "(":
                e = min(statement_end(k), b)
                module = next((tokens[j][1][1:-1] for j in range(k, e + 1) if tokens[j][0] == "string"), "")
                at = put(parent, "import", k, e, module=module)
                walk(at, k + 1, e)
                k = e + 1
            elif t in ("function", "class") and nxt[0] == "name":
                e = min(body_end(k), b)
                at = put(parent, t, k, e, name=nxt[1])
                walk(at, k + 1, e)
                k = e + 1
            elif t in ("const", "let", "var") and nxt[0] == "name":
                e = min(statement_end(k), b)
                at = put(parent, "variable", k + 1, e - (tokens[e][1] == ";"), name=nxt[1])
                walk(at, k + 1, e)
                k = e + 1
            elif group == "name" and t not in _KEYWORDS:
                j, callee = k, t
                while j + 2 <= b and tokens[j + 1][1] == "." and tokens[j + 2][0] == "name":
                    callee += "." + tokens[j + 2][1]
                    j += 2
                if j + 1 <= b and tokens[j + 1][1] == "(" and j + 1 in match and (k == a or tokens[k - 1][1] not in ("function", "class")):
                    e = min(match[j + 1], b)
                    at = put(parent, "call", k, e, callee=callee)
                    for x in range(k, j + 1, 2):
                        put(at, "identifier", x, x, name=tokens[x][1], declaration=False)
                    walk(at, j + 2, e - 1)
                    k = e + 1
                else:
                    put(parent, "identifier", k, k, name=t, declaration=k > 0 and tokens[k - 1][1] in ("function", "class", "const", "let", "var"))
                    k += 1
            else:
                k += 1

    walk(root, 0, n - 1)
    return tree.close(utf16(text))


PARSERS = {"json": (parse_json, JSON_ATTRS), "markdown": (parse_markdown, MARKDOWN_ATTRS), "ts": (parse_typescript, TS_ATTRS)}


def tagged(x):
    return tagged_row(x)
