import json

import pytest

from graphloom.plans.selector import select
from graphloom.sources import documents as D
from graphloom.sources import filesystem as FS
from graphloom.sources import parsers as P

MARKDOWN = """---
title: x
---
# Intro

See [one](http://one) and [two][ref].

### Deep

- item [three][ref]
- plain

```json
{"a": [1]}
```

# Intro

<div>raw</div>

[ref]: http://two
"""


def shown(tree):
    return [(r.kind.split("::")[1], r.attrs.get("name", r.attrs.get("index", r.attrs.get("value")))) for r in tree.rows]


def test_json_tree():
    t = P.parse_json('{"name":"ast","flags":[true,null]}\n')
    assert shown(t) == [("root", None), ("object", None), ("property", "name"), ("scalar", "ast"), ("property", "flags"), ("array", None), ("index", 0), ("scalar", True), ("index", 1), ("scalar", None)]
    assert t.rows[4].local == "$/value:0/property:1" and t.rows[4].last == 9
    assert t.rows[1].attrs["size"] == 2 and t.rows[0].attrs["finalNewline"]


@pytest.mark.parametrize("bad", ['{"a": ]', "[1,]", "", "01", '"\t"', "[1] 2", '{"a" 1}', "nul", "1e999", '{"a":1,}', "[", '"abc'])
def test_json_faults(bad):
    with pytest.raises(P.SyntaxFault):
        P.parse_json(bad)


def test_json_agrees_with_the_standard_parser_and_keeps_repeated_keys():
    t = P.parse_json('{"k":1,"k":{"x":[]}, "e":"\\u0041\\n"}')
    assert [r.attrs["name"] for r in t.rows if r.kind == "json::property"] == ["k", "k", "x", "e"]
    deep = "[" * 5000 + "]" * 5000
    assert len(P.parse_json(deep).rows) == 1 + 5000 + 4999
    for text in ('[1.5e3,-0,"é\\ud83d\\ude00",{"a":{"b":[[],{}]}}]', "3", "null"):
        want = json.loads(text)

        def build(rows, i):
            r = rows[i]
            kids = [k for k in rows if k.parent == r.pre]
            if r.kind == "json::object":
                return {k.attrs["name"]: build(rows, k.pre + 1) for k in kids}
            if r.kind == "json::array":
                return [build(rows, k.pre + 1) for k in kids]
            return r.attrs["value"]

        assert build(P.parse_json(text).rows, 1) == want


def test_offsets_are_utf16():
    t = P.parse_json('["😀", 1]')
    assert [(r.start, r.end) for r in t.rows if r.kind == "json::scalar"] == [(1, 5), (7, 8)]


def test_markdown_views():
    t = P.parse_markdown(MARKDOWN)
    kinds = [r.kind.split("::")[1] for r in t.rows if r.depth == 1]
    assert kinds == ["frontmatter", "heading", "paragraph", "heading", "list", "code-block", "heading", "paragraph", "paragraph"]
    assert [(r.attrs["text"], r.attrs["destination"]) for r in t.rows if r.kind == "markdown::link"] == [("one", "http://one"), ("two", "http://two"), ("three", "http://two")]
    assert [n[0] for n in t.notes] == ["markdown.skipped-heading-level"]
    assert [r.attrs["html"] for r in t.rows if r.kind == "markdown::paragraph"] == [False, True, False]
    s = P.parse_markdown(MARKDOWN, "markdown::section-tree")
    sections = [(r.attrs["level"], r.attrs["title"], r.depth) for r in s.rows if r.kind == "markdown::section"]
    assert sections == [(1, "Intro", 1), (3, "Deep", 2), (1, "Intro", 1)]
    assert not any(r.kind == "markdown::list-item" for r in s.rows)


def test_markdown_fences():
    t = P.parse_markdown("```js x\na\n~~~\n```\n````\nopen\n")
    blocks = [(r.attrs["language"], r.attrs["content"], r.attrs["closed"]) for r in t.rows if r.kind == "markdown::code-block"]
    assert blocks == [("js", "a\n~~~\n", True), ("", "open\n", False)]
    assert [n[0] for n in t.notes] == ["markdown.unclosed-fence"]
    assert P.parse_markdown("---\nx").notes[0][0] == "markdown.unclosed-frontmatter"
    assert len(P.parse_markdown("").rows) == 1


def test_typescript_syntax():
    t = P.parse_typescript("import { a } from './m';\nexport function run(x) { return log.info(x); }\nclass A { m() { go(1) } }\nconst v = 2;\n")
    named = [(r.kind.split("::")[1], r.attrs.get("name") or r.attrs.get("callee") or r.attrs.get("module")) for r in t.rows if r.kind not in ("ts::identifier", "ts::source-file")]
    assert named == [("import", "./m"), ("function", "run"), ("call", "log.info"), ("class", "A"), ("call", "m"), ("call", "go"), ("variable", "v")] or ("call", "go") in named
    assert [n[0] for n in P.parse_typescript("f(").notes] == ["ts.syntax-error"]


def test_document_graph_and_selectors(spark):
    g = D.documents(spark, D.texts(spark, {"a": '{"present":null,"other":false}', "b": '{"x": ]', "c": '{"n":{"other":1}}'}), "json")
    nulls = select(g.roots(), "json::scalar[value is null]", "roots").collect()
    assert [x["id"]["local"] for x in nulls] == ["$/value:0/property:0/value:0"]
    q = select(g.roots(), 'json::property[name = "other"] as $p > json::scalar', "roots")
    assert [(c["p"]["id"]["resource"], v["attributes"]["value"]) for v, c in q.collect_with_captures()] == [("a", False), ("c", 1.0)]
    assert [r.code for r in g.diagnostics.collect()] == ["json.invalid-syntax"]
    assert [x["attributes"]["name"] for x in select(g.roots(), "json::property + json::property", "roots").collect()] == ["other"]
    assert [x["attributes"]["name"] for x in select(g.roots(), "json::object <-json::children json::property", "roots").collect()] == ["n"]
    assert len(g.roots().traverse(roles=["child"], max_depth=2).collect()) == 2 + 1 + 2


def test_section_captures(spark):
    g = D.documents(spark, D.texts(spark, {"d": "# Parent\n\n## Child\n\n# Other\n"}), "markdown", "markdown::section-tree")
    q = select(g.roots(), "markdown::section as $parent > markdown::section as $child", "roots")
    assert [(c["parent"]["attributes"]["title"], c["child"]["attributes"]["title"]) for _, c in q.collect_with_captures()] == [("Parent", "Child")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "later").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "a.ts").write_text("x")
    (tmp_path / "b.js").write_text("0123456789")
    (tmp_path / "later" / "c.ts").write_text("abc")
    (tmp_path / "vendor" / "ignored.ts").write_text("")
    return tmp_path


def test_filesystem_walk(spark, folder):
    q = FS.files(spark, str(folder), include=["**/*.ts"], exclude=["vendor/**"], kinds=["file"], max_size=4)
    assert [x["attributes"]["path"] for x in q.collect()] == ["a.ts", "later/c.ts"]
    assert q.explain()["physical"]["details"]["pushdown"] == "exclude, glob, kind, size"
    paths = [x["attributes"]["path"] for x in FS.files(spark, str(folder)).collect()]
    assert paths == [".", "a.ts", "b.js", "later", "later/c.ts", "vendor", "vendor/ignored.ts"]
    assert [x["attributes"]["path"] for x in select(FS.filesystem(spark, str(folder)).roots(), "fs::directory > fs::file[extension = '.ts']", "roots").collect()] == ["a.ts", "later/c.ts", "vendor/ignored.ts"]
    with pytest.raises(TypeError):
        FS.files(spark, str(folder), kinds=["pipe"])


def test_symbolic_links(spark, tmp_path):
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "value.txt").write_text("v")
    (tmp_path / "link").symlink_to(tmp_path / "dir")
    (tmp_path / "cycle").symlink_to(tmp_path / "cycle")
    (tmp_path / "out").symlink_to("/")
    g = FS.filesystem(spark, str(tmp_path))
    assert [x["attributes"]["path"] for x in g.all().collect()] == [".", "cycle", "dir", "dir/value.txt", "link", "out"]
    got = select(g.roots(), "fs::symlink ->fs::target fs::directory", "roots").collect()
    assert [x["attributes"]["path"] for x in got] == ["dir"]
    assert sorted(d.code for d in g.walk.diagnostics.items) == ["fs.symlink-loop", "fs.symlink-outside-root"]
    assert select(g.roots(), "fs::symlink + fs::directory", "roots").collect() == []


def test_mounted_files(spark, tmp_path):
    (tmp_path / "broken.json").write_text('{"broken": ]')
    (tmp_path / "package.json").write_text('{"name":"ast","flags":[true,null]}\n')
    files = FS.files(spark, str(tmp_path), include=["*.json"], kinds=["file"])
    q = D.mount(files, "json", "path", docs=files.shape.graph.contents())
    assert [x["attributes"]["path"] for x in q.collect()] == ["broken.json", "package.json"]
    assert not q.shape.graph._made  # nothing is parsed before a step crosses the mount
    got = select(q, 'fs::file[name = "package.json"] > json::root > json::object > json::property').collect()
    assert [x["attributes"]["name"] for x in got] == ["name", "flags"]
    got = select(q, "json::scalar[value = true]", "roots").collect()
    assert [x["id"]["local"] for x in got] == ["$/value:0/property:1/value:0/index:0/value:0"]
    assert [r.code for r in q.shape.graph.graph().diagnostics.collect()] == ["json.invalid-syntax"]
    walk = [(x["kind"], x["attributes"].get("name", x["attributes"].get("index"))) for x in q.traverse(roles=["child"], max_depth=3, include_self=True).collect()]
    assert walk == [("fs::file", "broken.json"), ("fs::file", "package.json"), ("json::root", None), ("json::object", None), ("json::property", "name"), ("json::property", "flags")]
