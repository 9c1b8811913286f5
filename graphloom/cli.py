"""Command line: query, plan, apply, explain, schema and plugins."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from .diagnostics import LoomError
from .functions.values import BigInt

OK, FAILURE, DIAGNOSTICS, USAGE, PLAN_INVALID, APPLY_FAILED, INTERRUPTED = 0, 1, 2, 3, 4, 5, 130
_SECRET = re.compile(r"(pass(word|phrase)?|secret|token|api[_-]?key|credential|private[_-]?key)", re.I)


def printable(x, key: str = ""):
    """JSON value: keys sorted, bigints as "12n", values under telling names hidden."""
    if key and _SECRET.search(key) and not isinstance(x, (dict, list)):
        return "[REDACTED]"
    if isinstance(x, BigInt):
        return f"{int(x)}n"
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float) and x == int(x) and abs(x) < 2**53:
        return int(x)
    if isinstance(x, dict):
        return {k: printable(x[k], k) for k in sorted(x)}
    if isinstance(x, (list, tuple)):
        return [printable(i) for i in x]
    return x


def emit(values, pretty: bool, out) -> None:
    for v in values:
        print(json.dumps(printable(v), ensure_ascii=False, indent=2 if pretty else None), file=out)


def environment(spark, diagnostics=None):
    """Built-in sources, mounts and operations."""
    from .change import FileChanges, json_changes, markdown_changes, typescript_changes
    from .change import Operation as Op
    from .plans.pipeline import Argument, Environment, Mount, OperationSpec, Source
    from .sources import documents as D
    from .sources import filesystem as FS

    uri = {"uri": Argument("string", required=True)}
    listing = {
        **uri,
        "include": Argument("string", many=True),
        "exclude": Argument("string", many=True),
        "kinds": Argument("string", many=True, choices=FS.KINDS),
        "minSize": Argument("number"),
        "maxSize": Argument("number"),
        "modifiedAfter": Argument("number"),
        "modifiedBefore": Argument("number"),
    }

    def files(uri, include=(), exclude=(), kinds=(), minSize=None, maxSize=None, modifiedAfter=None, modifiedBefore=None):
        q = FS.files(spark, uri.removeprefix("file://"), include=include, exclude=exclude, kinds=kinds, min_size=minSize, max_size=maxSize, modified_after=modifiedAfter, modified_before=modifiedBefore)
        if diagnostics is not None:
            diagnostics.items += q.shape.graph.walk.diagnostics.items
        return q

    def document(language):
        def open_(uri, treeView=None):
            path = uri.removeprefix("file://")
            with open(path, encoding="utf-8", newline="") as f:
                docs = D.texts(spark, {f"file://{os.path.realpath(path)}": f.read()})
            graph = D.documents(spark, docs, language, treeView)
            if diagnostics is not None:
                for r in graph.diagnostics.collect():
                    diagnostics.add(r.code, r.message, "error" if r.code.endswith(("invalid-syntax", "syntax-error")) else "warning", uri=r.uri)
            return graph.roots()

        return open_

    def mounted(language):
        def mount(query, onError="skip", treeView=None):
            return D.mount(query, language, "path", treeView, onError, query.shape.graph.contents(onError))

        return mount

    view = {"treeView": Argument("string")}
    env = Environment(
        {
            "fs": Source(files, listing, "selection"),
            "json": Source(document("json"), uri),
            "markdown": Source(document("markdown"), {**uri, **view}, view=lambda a: a.get("treeView")),
            "ts": Source(document("ts"), uri),
        },
        {
            "json": Mount(mounted("json"), D.JSON_SCHEMA, {"onError": Argument("string", choices=("skip", "throw"))}),
            "markdown": Mount(mounted("markdown"), D.MARKDOWN_SCHEMA, view, lambda a: a.get("treeView")),
            "ts": Mount(mounted("ts"), D.TS_SCHEMA),
        },
    )

    def operation(name, adapter, /, **args):
        def create(node, /, **given):
            return Op(name, node, {k: (json.loads(v) if k == "value" and isinstance(v, str) and v[:1] in "[{" else v) for k, v in given.items()})

        env.operations[name] = OperationSpec(create, adapter, args)

    text, needed = Argument("string"), Argument("string", required=True)
    for name, args in {"write": {"content": needed}, "move": {"path": needed}, "remove": {}, "create": {"path": needed, "content": text}}.items():
        operation(f"fs::{name}", _Rooted(FileChanges), **args)
    j, m, t = json_changes(), markdown_changes(), typescript_changes()
    operation("json::replace-value", j, value=needed)
    operation("json::insert-property", j, name=needed, value=needed, index=Argument("number"))
    operation("json::remove-property", j)
    operation("json::insert-array-item", j, value=needed, index=Argument("number"))
    operation("json::remove-array-item", j)
    operation("markdown::set-heading", m, title=needed)
    operation("markdown::replace-section", m, content=needed)
    operation("ts::replace-call", t, callee=needed)
    return env


class _Rooted:
    """File changes below the root that each target names."""

    namespace, version = "fs", "1"

    def __init__(self, make):
        self.make = make

    def plan(self, op):
        return self.make(op.target["id"]["resource"]).plan(op)

    def apply(self, changes):
        self.make("/").apply(changes)


def adapters() -> dict:
    from .change import FileChanges, json_changes, markdown_changes, typescript_changes

    return {"fs": _Rooted(FileChanges), "json": json_changes(), "markdown": markdown_changes(), "ts": typescript_changes()}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Query resources as one graph.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "plan", "apply", "explain", "schema", "plugins"):
        s = sub.add_parser(name)
        if name in ("query", "plan", "explain", "apply"):
            s.add_argument("file", nargs="?")
            s.add_argument("-e", "--expr")
        if name in ("query", "explain"):
            s.add_argument("--pretty", action="store_true", default=None)
        if name == "plan":
            s.add_argument("--save")
            s.add_argument("--show-content", action="store_true")
        if name == "apply":
            s.add_argument("--plan")
            s.add_argument("--yes", action="store_true")
            s.add_argument("--allow-destructive", action="store_true")
            s.add_argument("--allow-irreversible", action="store_true")
            s.add_argument("--policy", choices=("stop", "continue-independent"), default="stop")
        if name == "schema":
            s.add_argument("namespace", nargs="?")
        s.add_argument("--config")
    return p


def _config(args) -> dict:
    """Settings: option before environment before file."""
    path = args.config or os.environ.get("GRAPHLOOM_CONFIG")
    data = {}
    if path:
        try:
            with open(path) as f:
                data = json.load(f)
            if not isinstance(data, dict) or set(data) - {"pretty"}:
                raise ValueError("unknown settings")
        except (OSError, ValueError) as e:
            raise LoomError("cli.invalid-config", str(e)) from e
    pretty = getattr(args, "pretty", None)
    if pretty is None:
        own = os.environ.get("GRAPHLOOM_PRETTY")
        pretty = own == "1" if own is not None else data.get("pretty", sys.stdout.isatty())
    return {"pretty": bool(pretty)}


def _program(args, stdin) -> str:
    modes = [args.file is not None and args.file != "-", args.expr is not None]
    if sum(modes) > 1:
        raise LoomError("cli.usage", "give a file or an expression")
    if args.expr is not None:
        return args.expr
    if args.file is not None and args.file != "-":
        with open(args.file, encoding="utf-8") as f:
            return f.read()
    return stdin.read()


def main(argv=None, spark=None, stdin=None, stdout=None, stderr=None) -> int:
    stdin, stdout, stderr = stdin or sys.stdin, stdout or sys.stdout, stderr or sys.stderr
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    try:
        return _run(args, spark, stdin, stdout, stderr)
    except LoomError as e:
        print(json.dumps(e.diagnostic.as_dict()), file=stderr)
        return {"cli.usage": USAGE, "cli.invalid-config": USAGE, "cli.invalid-plan": PLAN_INVALID, "apply.invalid-plan": PLAN_INVALID}.get(e.code, FAILURE)
    except KeyboardInterrupt:
        return INTERRUPTED
    except OSError as e:
        print(json.dumps({"code": "cli.error", "severity": "error", "message": str(e), "locations": []}), file=stderr)
        return FAILURE


def _run(args, spark, stdin, stdout, stderr) -> int:
    from . import change as C
    from .diagnostics import Diagnostics
    from .plans.pipeline import compile_program
    from .sources import documents as D
    from .sources import filesystem as FS

    config = _config(args)
    if args.command == "schema":
        schemas = {"fs": FS.SCHEMA, **D.SCHEMAS}
        if args.namespace and args.namespace not in schemas:
            raise LoomError("cli.usage", f"unknown namespace {args.namespace}")
        for n, s in schemas.items():
            if args.namespace in (None, n):
                print(json.dumps({"namespace": n, "kinds": {k: sorted(a) for k, a in s.kinds.items()}, "edges": sorted(s.edges), "views": sorted(s.views), "operations": list(s.operations)}), file=stdout)
        return OK
    if args.command == "plugins":
        print("[]", file=stdout)
        return OK
    if args.command == "apply" and args.plan:
        with open(args.plan, encoding="utf-8") as f:
            return _apply(C.deserialize(f.read(), adapters()), args, stdout)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("graphloom").getOrCreate()
    notes = Diagnostics()
    compiled = compile_program(_program(args, stdin), environment(spark, notes))
    if args.command == "explain":
        tree = compiled.query.explain()
        if compiled.kind == "plan":
            tree = {"query": tree, "plan": C.render(compiled.plan())}
        print(json.dumps(tree, indent=2 if config["pretty"] else None, default=str), file=stdout)
        return OK
    if args.command == "query":
        if compiled.kind != "query":
            raise LoomError("cli.usage", "a transformation needs plan or apply")
        emit(compiled.query.collect(), config["pretty"], stdout)
        for d in notes.items:
            print(json.dumps(d.as_dict()), file=stderr)
        return DIAGNOSTICS if notes.failed else OK
    if compiled.kind != "plan":
        raise LoomError("cli.usage", "a query plans nothing")
    plan = compiled.plan()
    if args.command == "plan":
        print(C.render(plan, args.show_content), file=stdout)
        if args.save:
            with open(args.save, "w", encoding="utf-8") as f:
                f.write(C.serialize(plan))
        return PLAN_INVALID if plan.failed else OK
    return _apply(plan, args, stdout)


def _apply(plan, args, stdout) -> int:
    from . import change as C

    risks = {c.risk for c in plan.changes}
    if not args.yes:
        raise LoomError("cli.usage", "apply needs --yes")
    for risk in (C.DESTRUCTIVE, C.IRREVERSIBLE):
        if risk in risks and not getattr(args, f"allow_{risk}"):
            raise LoomError("cli.usage", f"{risk} changes need --allow-{risk}")
    results = C.apply(plan, args.policy)
    for r in results:
        print(json.dumps(r), file=stdout)
    return OK if all(r["status"] == "applied" for r in results) else APPLY_FAILED


if __name__ == "__main__":
    sys.exit(main())
