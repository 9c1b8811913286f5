"""Names of source files and what they stand for: declarations in scope, and exports of other files of a project."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parsers as P
from .documents import DocumentGraph, documents

_DECLARES = ("ts::function", "ts::class", "ts::variable")
_CLAUSE = re.compile(r"import\s+(?:type\s+)?(?P<what>.*?)\s*from\s*[\"']", re.S)
_ENDING = re.compile(r"(\.d)?\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$")
_USES = "resource string, uri string, from_pre long, to_pre long, module string, name string, exported boolean"


@dataclass(frozen=True)
class Use:
    """An identifier and the declaration it stands for: ``to`` in the same file, or ``name`` of a module."""

    pre: int
    start: int
    end: int
    to: int | None = None
    module: str | None = None
    name: str | None = None


def stem(path: str) -> str:
    """A path without the ending that module names and files differ in."""
    return _ENDING.sub("", posixpath.normpath(path)).removesuffix("/index")


def module_of(uri: str, module: str) -> str | None:
    """The stem of a relative module; packages are no part of a project."""
    return stem(posixpath.join(posixpath.dirname(uri), module)) if module.startswith(".") else None


def imported(text: str) -> dict[str, str]:
    """Local name to exported name of an import clause; a whole namespace has none."""
    m = _CLAUSE.match(text)
    out: dict[str, str] = {}
    if not m:
        return out
    named = re.search(r"\{(.*)\}", m["what"], re.S)
    for part in named[1].split(",") if named else ():
        words = part.replace("type ", "").split()
        if words:
            out[words[-1]] = words[0]
    first = re.match(r"[A-Za-z_$][\w$]*", m["what"])
    if first:
        out[first[0]] = "default"
    return out


def resolved(text: str) -> tuple[list[Use], dict[str, int], list]:
    """(uses, exported names with their declarations, rows) of one file; names that nothing declares have no use.

    A name stands for the declaration of the innermost block construct around it
    that has one, for nothing if a parameter hides it, or for what an import brings.
    """
    rows = P.parse_typescript(text).rows
    wide = P.utf16(text)
    spot = {wide(i) if wide else i: i for i in range(len(text) + 1)} if wide else None
    at = (lambda k: spot[k]) if spot else (lambda k: k)
    inside: dict[int, dict[str, int]] = {}
    brought: dict[str, tuple[str, str]] = {}
    hidden: dict[int, set[str]] = {}
    exports: dict[str, int] = {}
    for r in rows:
        if r.kind in _DECLARES:
            inside.setdefault(r.parent, {}).setdefault(r.attrs["name"], r.pre)
            begin = text.rfind("\n", 0, at(r.start)) + 1
            before = text[max(begin, text.rfind(";", 0, at(r.start)) + 1) : at(r.start)]
            if r.parent == 0 and re.search(r"\bexport\b", before):
                exports[r.attrs["name"]] = r.pre
                if re.search(r"\bdefault\b", before):
                    exports["default"] = r.pre
        if r.kind == "ts::function":
            head = text[at(r.start) : at(r.end)].split("{")[0]
            hidden[r.pre] = set(re.findall(r"(?:^|[,(\s.])([A-Za-z_$][\w$]*)\s*(?=[:,)=?])", head.partition("(")[2]))
        if r.kind == "ts::import" and r.parent == 0:
            for own, name in imported(text[at(r.start) : at(r.end)]).items():
                brought[own] = (r.attrs["module"], name)
    for m in re.finditer(r"export\s*\{([^}]*)\}", text):
        for part in m[1].split(","):
            words = part.split()
            if words and words[0] in inside.get(0, {}):
                exports[words[-1]] = inside[0][words[0]]
    uses = []
    for r in rows:
        if r.kind != "ts::identifier" or at(r.start) and text[at(r.start) - 1] == ".":
            continue
        name, p = r.attrs["name"], r.parent
        while p >= 0:
            if name in inside.get(p, {}):
                uses.append(Use(r.pre, r.start, r.end, to=inside[p][name]))
                break
            if name in hidden.get(p, ()) and not (rows[p].attrs.get("name") == name and r.attrs.get("declaration")):
                break
            p = rows[p].parent
        else:
            if name in brought:
                uses.append(Use(r.pre, r.start, r.end, module=brought[name][0], name=brought[name][1]))
    return uses, exports, rows


def names(docs: DataFrame) -> DataFrame:
    """Uses and exports of every document (resource, uri, revision, text), each parsed where it lies."""

    def run(batches):
        for batch in batches:
            out = []
            for resource, uri, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text is None:
                    continue
                uses, exports, _ = resolved(text)
                out += [(resource, uri, u.pre, u.to, module_of(uri, u.module) if u.module else None, u.name, False) for u in uses]
                out += [(resource, uri, None, pre, stem(uri), name, True) for name, pre in exports.items()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            cols = zip(*out) if out else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [f.split()[0] for f in _USES.split(", ")])

    return docs.select("resource", "uri", "text").mapInArrow(run, _USES)


def project(spark: SparkSession, docs: DataFrame, view: str | None = None) -> DocumentGraph:
    """Source files (resource, uri, revision, text) as one graph with ``ts::symbol`` edges, also from file to file.

    Files meet by the stems of their uris and of the modules that others import, in one join.
    """
    graph = documents(spark, docs, "ts", view, keep=True)
    found = names(docs)
    own = found.where("not exported and to_pre is not null").select("resource", "from_pre", F.col("resource").alias("to_resource"), "to_pre")
    wanted = found.where("not exported and module is not null").select("resource", "from_pre", "module", "name")
    offered = found.where("exported").select(F.col("resource").alias("to_resource"), "to_pre", "module", "name")
    across = wanted.join(offered, ["module", "name"]).select("resource", "from_pre", "to_resource", "to_pre")
    graph.extra = own.unionAll(across).select(F.lit("ts::symbol").alias("name"), "resource", "from_pre", "to_resource", "to_pre", F.lit(0).alias("pos"))
    return graph


def occurrences(files: dict[str, str], uri: str, start: int) -> list[tuple[str, int, int]]:
    """(uri, start, end) of all names in ``files`` that stand for what the name at ``start`` in ``uri`` does."""
    seen = {u: resolved(t) for u, t in files.items()}
    home = {stem(u): u for u in files}

    def target(u: str, use: Use):
        if use.to is not None:
            return u, use.to
        path = module_of(u, use.module)
        there = home.get(path) if path else None
        pre = seen[there][1].get(use.name) if there else None
        return (there, pre) if pre is not None else None

    mark = next((target(uri, x) for x in seen[uri][0] if x.start == start), None)
    if mark is None:
        return []
    name = seen[mark[0]][2][mark[1]].attrs["name"]
    out = []
    for u, (uses, _, _) in seen.items():
        for x in uses:
            if target(u, x) == mark and files[u][x.start : x.end] == name:
                out.append((u, x.start, x.end))
    return sorted(out)
