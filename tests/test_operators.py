"""Operators on small inputs: rules that the tables do not show."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunking, extract, graph, lens, lexer, linking, relevance, scrub, search, tasks, vectors
from granary.plans import registry
from granary.sources import crawl, tables
from granary.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,n", [("", 0), ("hello world", 2), ("x = foo(1.5)", 6), ("abcdefghijk", 3), ("_bcdefghijk", 1), ("Étion", 1), ("a" * 40, 4), ("  \n\t ", 0), ("a.b", 3)])
def test_token_count(spark, text, n):
    n = n if text != "a" * 40 else 40 // 4
    assert one(spark, T.token_count(F.col("t")), t=text) == n == chunking.count_tokens(text)


def test_truncate(spark):
    assert one(spark, T.truncate_tokens(F.col("t"), 3), t="a  b   c") == "a  b   c"
    assert one(spark, T.truncate_tokens(F.col("t"), 3), t="a  b   c d") == "a b c"


@pytest.mark.parametrize(
    "url,service,path",
    [("http://user-service/api/users", "user-service", "/api/users"), ("http://localhost:80/x", None, None), ("https://a.b:8080", "a.b", None), ("http://a/b?c=1", "a", "/b?c=1"), ("http://a/b c", "a", "/b"), ("ftp", None, None)],
)
def test_urls(spark, url, service, path):
    assert one(spark, T.url_service(F.col("u")), u=url) == service
    assert one(spark, T.url_path(F.col("u")), u=url) == path


@pytest.mark.parametrize("path,normal", [("/a/b/", "/a/b"), ("/a?x=1", "/a"), ("/", "/"), ("", "/"), ("/a//", "/a")])
def test_normal_path(spark, path, normal):
    assert one(spark, T.normal_path(F.col("p")), p=path) == normal


def test_slug(spark):
    assert one(spark, T.slug(F.col("t")), t="Hello,  World!") == "hello-world"
    long = one(spark, T.slug(F.col("t")), t="word " * 30)
    assert re.fullmatch(r"(word-){9}[0-9a-f]{4}", long)  # the hyphen that the cut leaves goes


def test_small_text_functions(spark):
    assert one(spark, T.line_ending(F.col("t")), t="a\r\nb\nc") == "mixed"
    assert one(spark, T.balanced(F.col("t")), t="f(a[1]{") is False
    assert one(spark, T.language_of(F.col("t")), t="a/b.TSX") == "typescript"
    assert one(spark, T.snippet(F.col("t"), 2), t="a\nb\nc") == "a\nb\n... (1 more lines)"
    assert one(spark, T.front_matter(F.col("t"), "b"), t="---\na: 1\nb: two\n---\nb: 3") == "two"
    assert one(spark, T.code_words(F.col("t")), t="getUserName of the_thing") == ["get", "user", "name", "thing"]
    assert one(spark, T.kind_name(F.col("k")), k=12) == "function" and one(spark, T.kind_name(F.col("k")), k=99) == "unknown"


def test_packing():
    items = ["a b c", "d e", "f", "g h i j k l", "m"]
    assert list(chunking.pack(items, 5, 0)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(chunking.pack(items, 5, 2)) == [(0, 2), (1, 3), (2, 4), (4, 5)]
    assert list(chunking.pack([], 5, 0)) == []


def test_line_chunks_cover_the_text(spark):
    text = "\n".join(f"line {k} {'x ' * (k % 7)}é" for k in range(80))
    rows = chunking.line_chunks(spark.createDataFrame([(1, "u", text), (2, "v", ""), (3, "w", None)], "doc_id long, uri string, text string"), 40, 0).orderBy("doc_id", "ordinal").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert "\n".join(r.text for r in own) == text and all(chunking.count_tokens(r.text) <= 40 for r in own)
    raw = text.encode()
    assert all(raw[r.start : r.end].decode() == r.text for r in own) and own[-1].end == len(raw)
    assert [(r.start, r.end, r.text) for r in rows if r.doc_id > 1] == [(0, 0, ""), (0, 0, "")]


def test_code_chunks(spark):
    code = "import os\n\nclass A:\n    def f(self):\n        return 1\n\nif True:\n    def g():\n        return 2\n\n@cached\ndef é():\n    return 3\n"
    go = 'package a\n\ntype ID string\n\nfunc Run(x interface{}) error {\n\ts := "}" // }\n\treturn nil\n}\n\nfunc (t *T) Do() {\n}\n'
    ts = "import x\n\nexport async function load(a: {b: number}[] = []) {\n  return `}`\n}\n\nexport class Box {\n  get() { return 1 }\n}\n"
    cs = "namespace N\n{\n    [Serializable]\n    public sealed class Box : IBox\n    {\n        void Do() { }\n    }\n    struct P { int x; }\n}\n"
    rows = [(1, "a.py", code, "python"), (2, "b.py", "x = (", "python"), (3, "test_c.py", "import os\n", "python"), (4, "a.go", go, "go"), (5, "a.ts", ts, "typescript"), (6, "a.cs", cs, "csharp"), (7, "a.rs", "fn f() {}", "rust"), (8, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, uri string, text string, language string")
    out = chunking.code_chunks(docs).orderBy("doc_id", "ordinal").collect()
    segment, anonymous = ("segment", "<file_segment>"), "<anonymous>"
    found = {k: [(r.kind, r.name) for r in out if r.doc_id == k] for k in range(1, 9)}
    assert found[1] == [("class", "A"), ("function", "g"), ("function", anonymous)] and all(found[k] == [segment] for k in (2, 3, 7, 8))
    assert found[4] == [("type", anonymous), ("function", "Run"), ("function", anonymous)]
    assert found[5] == [("function", "load"), ("class", anonymous)] and found[6] == [("class", "Box"), ("struct", "P")]
    texts = {r[0]: r[2] for r in rows}
    assert all(texts[r.doc_id].encode()[r.start : r.end].decode() == r.text for r in out if r.doc_id < 8)
    assert [r.text for r in out if r.doc_id == 1][2].startswith("@cached") and [r.text for r in out if r.doc_id == 4][1].endswith("return nil\n}")
    small = chunking.code_chunks(docs, 6, 0).filter("doc_id = 1").collect()
    assert {r.name for r in small} == {"A_part", "g_part", "<anonymous>_part"}


SOURCES = [
    ("go", 'package a\n\nimport (\n\t"fmt" // ")\n)\n\nfunc Run(a []int) (x interface{}, err error) {\n\tfor i := range a { fmt.Println("}", `}`, i) }\n\treturn nil, nil\n}\n\ntype T struct {\n\tA int\n\tB map[string]struct{}\n}\n'),
    ("typescript", "import {a} from 'x';\nexport default class Box<T> extends Base {\n  get(k: string): {v: T} { return `${this.m[k].map(x => `<${x}>`)}` }\n}\nconst f = async (x) => {\n  if (/[}`]/.test(x)) { return {a: [1, 2, {b: '}'}]} }\n}\n"),
    ("csharp", 'namespace N {\n  [A("}")] public class C : D {\n    string S(int i) => $"{i:N2} {d["}"]} {{";\n    void V() { var x = @"a""}"; }\n  }\n  public struct P { }\n}\n'),
    ("python", 'import os\n\ndef f(a, b=")"):\n    """doc ( """\n    return [x for x in a if x # ]\n            ]\n\nclass É:\n    v = {1: (2, 3)}\n'),
    ("go", "func f( { [ ) } ]"), ("csharp", '$"{a{'), ("typescript", "`${`${"), ("python", ""),
]


@pytest.mark.parametrize("language,text", SOURCES)
def test_trees_hold_the_text(language, text):
    root = lexer.tree(text, language)
    every = [root]
    for node in every:
        every.extend(node.children)
    for group in lexer.groups(root):
        last = group.start
        for c in group.children:
            assert last <= c.start < c.end <= group.end
            last = c.end
    for limit in (1, 3, 8, 20, 1000):
        cuts = list(chunking.pieces(text, language, limit))
        assert "".join(text[a:b] for a, b in cuts) == text and all(a < b for a, b in cuts)
        leaves = [n.start for n in every if not n.children]
        assert all(chunking.count_tokens(text[a:b]) <= limit or sum(a <= x < b for x in leaves) <= 1 for a, b in cuts)
        joined = [chunking.count_tokens(text[a:d]) for (a, _), (_, d) in zip(cuts, cuts[1:])]
        assert limit < 1000 or not joined


def test_large_sources_in_time(spark):
    text = "func f() {\n" + "\tx := g(a, [1, 2], {b: c}); y\n" * 20_000 + "}\n"
    began = time.time()
    cuts = list(chunking.pieces(text, "go", 100))
    assert "".join(text[a:b] for a, b in cuts) == text and max(chunking.count_tokens(text[a:b]) for a, b in cuts) <= 100
    assert len(cuts) <= 2 * chunking.count_tokens(text) / 100 and time.time() - began < 20
    assert len(list(lexer.groups(lexer.tree("(" * 50_000, "go")))) == 50_000
    out = chunking.tree_chunks(spark.createDataFrame([(1, "a.go", text[:5000], "go"), (2, "b", None, "go"), (3, "c.rs", "fn a() {}", "rust"), (4, None, "x", None)], "doc_id long, uri string, text string, language string"), 50).orderBy("doc_id", "ordinal").collect()
    assert "".join(r.text for r in out if r.doc_id == 1) == text[:5000] and [r.doc_id for r in out if r.doc_id > 1] == [3, 4]


def test_symbols_behind_strings_and_holes():
    found = lambda language, text: [(k, n, text[a:b]) for a, b, k, n in chunking.brace_symbols(text, language)]
    go, ts, cs = (t for _, t in SOURCES[:3])
    assert [f[:2] for f in found("go", go)] == [("function", "Run"), ("type", "<anonymous>")] and found("go", go)[0][2].endswith("nil, nil\n}")
    assert [f[:2] for f in found("typescript", ts)] == [("class", "<anonymous>")] and found("typescript", ts)[0][2].startswith("class Box")
    assert [f[:2] for f in found("csharp", cs)] == [("class", "C"), ("struct", "P")] and found("csharp", cs)[0][2].startswith('[A("}")] public')
    assert [f[:2] for f in found("typescript", "function f(a = {}): {x: 1} {}\nfoo(function g() {}); namespace N { export class A {} }")] == [("function", "f"), ("class", "<anonymous>")]


def test_messages(spark):
    texts = ['[{"type": "message", "user": "u", "text": "a", "ts": "1.5", "thread_ts": "t"}, {"type": "join"}, 3, {"type": "message", "username": "b"}]', '{"messages": [{"type": "message", "text": "x", "ts": "no"}]}', "Ann: hi\nno name\nBob:  there", "just text ", " ", None, "[]"]
    rows = chunking.messages(spark.createDataFrame([("u", k, t) for k, t in enumerate(texts)], "uri string, doc_id long, content string")).orderBy("doc_id", "pos").collect()
    got = [(r.doc_id, r.thread, r.speaker, r.text) for r in rows]
    assert got == [(0, "t", "u", "a"), (0, None, "b", ""), (1, None, "unknown", "x"), (2, None, "Ann", "hi"), (2, None, "no name\nBob", "there"), (3, None, "unknown", "just text")]
    assert [r.ts is not None for r in rows] == [True, False, False, False, False, False]


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "intro\n\n# A\ntext\n## B\n```\n# not code\n```"), (2, "no heading"), (3, "\n\n# Only\n")], "doc_id long, text string")
    rows = chunking.markdown_sections(docs).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.heading, r.level) for r in rows] == [(1, "(preamble)", 0), (1, "A", 1), (1, "B", 2), (1, "not code", 1), (2, "", 0), (3, "Only", 1)]
    assert rows[1].text == "# A\ntext" and rows[4].text == "no heading"


def test_thread_chunks_repeat_the_last_message(spark):
    rows = [(1, k, f"u: {'w ' * 8}") for k in range(6)]
    out = chunking.thread_chunks(spark.createDataFrame(rows, "doc_id long, pos long, line string"), 22).orderBy("ordinal").collect()
    assert [(r.first, r["last"]) for r in out] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_linking(spark):
    routes = [("s", "GET", "/users/{id}", "h1", 1), ("s", "GET", "/users/me", "h2", 2), ("s", "POST", "/users", "h3", 3), ("t", "GET", "/{a}/{b}", "h4", 4)]
    calls = [(1, "s", "http", "GET", "/users/7"), (2, "s", "http", "get", "/users/me"), (3, "s", "http", "PUT", "/users"), (4, "s", "http", "GET", "/x"), (5, "q", "http", "GET", "/x"), (6, "s", "grpc", None, None), (7, "q", "queue", None, None), (8, "s", "http", None, "/users/7/"), (9, "t", "http", "GET", "/a//"), (10, "s", "http", "GET", None)]
    out = linking.link(spark.createDataFrame(calls, "call_id long, target_service string, call_type string, method string, url_path string"), spark.createDataFrame(routes, "service string, method string, path string, handler string, seq long"))
    got = {r.call_id: (r.handler, r.miss_reason) for r in out.collect()}
    assert got == {1: ("h1", None), 2: ("h2", None), 3: (None, "method_mismatch"), 4: (None, "path_mismatch"), 5: (None, "no_routes"), 6: ("<service>", None), 7: (None, "no_routes"), 8: ("h1", None), 9: (None, "path_mismatch"), 10: ("<service>", None)}


def test_scrub_resolves_overlaps(spark):
    text = "mail a.b@c.org or +1 (252) 555-8630, card 4572244787104698 at 10.2.3.4 é"
    out = scrub.scrub(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert out[0].clean == "mail [EMAIL] or [PHONE], card XXXX-XXXX-XXXX-XXXX at XXX.XXX.XXX.XXX é"
    assert [text[x.start : x.end] for x in out[0].log] == ["a.b@c.org", "+1 (252) 555-8630", "4572244787104698", "10.2.3.4"]
    assert out[1].clean is None and list(out[1].log) == []


def test_pseudonyms_ignore_order(spark):
    rows = spark.createDataFrame([("PERSON", "Ann"), ("PERSON", " ann "), ("PERSON", "Bob"), ("ORG", "Ann")], "e string, v string")
    a, b, c, d = (r.p for r in rows.select(scrub.pseudonym(F.col("e"), F.col("v"), "s").alias("p")).collect())
    assert a == b and len({a, c, d}) == 3


def test_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.nearest(store, [1.0, 0.1], 2).collect()] == [1, 3]
    with pytest.raises(Exception, match="must have 3 dimensions"):
        store.select(vectors.checked(F.col("embedding"), 3)).collect()
    with pytest.raises(ValueError):
        vectors.distance(F.col("a"), F.col("b"), "manhattan")
    out = vectors.nearest_for_each(store, store.select(F.col("vec_id").alias("query_id"), "embedding"), 1).collect()
    assert {(r.query_id, r.vec_id) for r in out} == {(1, 1), (2, 2), (3, 1)}


def test_ranking(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c"])], "doc_id long, words array<string>")
    assert [r.doc_id for r in search.top(search.bm25(search.counted(docs, F.col("words"), ["a", "b"]), ["t0", "t1"]), 5).collect()] == [1, 2]
    lists = spark.createDataFrame([("x", 1, 0), ("y", 1, 1), ("x", 2, 1)], "list string, doc_id long, rank int")
    got = {r.doc_id: r.score for r in search.fuse(lists).collect()}
    assert got[1] == pytest.approx(1 / 61 + 1 / 62) and got[2] == pytest.approx(1 / 62)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "C"), (2, 3, "C"), (3, 1, "C"), (3, 4, "M"), (4, 5, "C")], "src long, dst long, type string")
    start = spark.createDataFrame([(1,)], "start long")
    hops = lambda *a: {(r.node, r.hop) for r in graph.neighbours(edges, start, *a).collect()}
    assert hops(1) == {(2, 1)} and hops(2) == {(2, 1), (3, 2)} and hops(9) == {(2, 1), (3, 2), (4, 3), (5, 4)}
    assert hops(9, "out", ["C"]) == {(2, 1), (3, 2)} and hops(1, "both") == {(2, 1), (3, 1)} and hops(1, "in") == {(3, 1)}


def test_staleness(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "doc string")
    index = spark.createDataFrame([("a", "f1", "1"), ("a", "f2", "2"), ("b", "f1", "old"), ("c", "gone", "3"), ("d", "f1", "1")], "doc string, source string, hash string")
    files = spark.createDataFrame([("f1", "1"), ("f2", "2")], "source string, hash string")
    got = {r.doc: r.status for r in lens.staleness(pages, index, files).collect()}
    assert got == {"a": "FRESH", "b": "STALE", "c": "STALE", "d": "MISSING", "z": "ORPHANED"}


@pytest.mark.parametrize(
    "files,condition,run",
    [
        ([], "any", False),
        (["README.md"], "homepage changes", False),
        (["README.md"], "update the documentation", True),
        (["src/index.tsx"], "homepage changes", True),
        (["a.css"], "TypeScript compiles", False),
        (["a.css"], "visual check", True),
        (["Footer.vue"], "login works", False),
        (["lib/Footer.vue"], "login works", True),
        ([".gitignore"], "layout", False),
        (["x.go"], "deploy", True),
    ],
)
def test_relevance(spark, files, condition, run):
    rows = spark.createDataFrame([("g", f) for f in files or [None]], "g string, path string")
    d = relevance.decision(F.col("n"), F.col("some"), F.col("every"), F.lit(condition))
    assert relevance.file_flags(rows, "g").select(d.alias("d")).first().d.run is run


def test_cycles(spark):
    parse = lambda t: one(spark, relevance.parse_cycle(F.col("t"), F.lit("x.md")), t=t)
    assert tuple(parse("# Name\nRun: make\nWHEN: always")) == ("Name", "automated", "make", "always", "", None)
    assert tuple(parse("run: a\nwhen: b")) == ("x", "automated", "a", "b", "", None)
    assert tuple(parse("#Name\nSee that\n it works\nwhen:")) == ("Name", "manual", None, "", "See that\n it works", None)
    assert parse("plain\n").error == "no condition" and parse(" \n").error == "empty file"
    files = spark.createDataFrame([("d/a.md", "# A\nwhen: x"), ("d/b.md", "no condition"), ("d/c.txt", "when: x")], "path string, content string")
    assert [(r.path, r.name, r.when) for r in relevance.valid_cycles(files).collect()] == [("d/a.md", "A", "x")]


def test_fixed_values(spark):
    long = "checkout process including cart validation at-- and payment"
    cut = one(spark, T.slug(F.col("t")), t=long)
    assert cut.startswith("checkout-process-including-cart-validation-at-") and len(cut) == 50
    assert one(spark, T.slug(F.col("t")), t="a" * 44 + "  " + "b" * 20)[:-4] == "a" * 44 + "-"
    kinds = [one(spark, T.kind_name(F.col("t")), t=k) for k in (1, 6, 22, 26, 27)]
    assert kinds == ["file", "method", "enummember", "typeparameter", "unknown"]
    names = {"a.mjs": "javascript", "a.cjs": "javascript", "a.pyi": "python", "a.h": "c", "a.cxx": "cpp", "a.cc": "cpp", "a.hpp": "cpp", "a.kts": "kotlin", "a.htm": "html", "a.scss": "css", "a.less": "css", "a.swift": "unknown", "a.scala": "unknown"}
    assert {p: one(spark, T.language_of(F.col("t")), t=p) for p in names} == names


def test_workers(spark):
    rows = [("p", "a", "idle", 1, 1), ("p", "b", "polling", 9, 2), ("p", "c", "polling", 5, 3), ("q", "d", "executing", 1, 4), ("r", "e", "idle", 2, 6), ("r", "f", "idle", 2, 5)]
    got = tasks.next_workers(spark.createDataFrame(rows, "g string, name string, status string, last_activity long, seq long"), "g").collect()
    assert {(r.g, r.name) for r in got} == {("p", "c"), ("r", "f")}


@pytest.mark.parametrize(
    "language,text,calls",
    [
        ("python", 'import requests\nrequests.get("http://user-service/api/users")', [(2, "GET", "http://user-service/api/users", 0.9)]),
        ("python", 'session.post(f"http://a-api/{x}")', [(1, "POST", "http://a-api/{x}", 0.7)]),
        ("python", '"""requests.get("http://a/b")"""\n# requests.get("http://a/b")\nrequests.get("http://localhost/x")\nd.get("http://a/b")', []),
        ("go", 'resp, err := http.Get("http://s/x")\nreq, _ := http.NewRequest("PUT", "http://s/y", nil)\n// http.Get("http://no/x")', [(1, "GET", "http://s/x", 0.9), (2, "PUT", "http://s/y", 0.9)]),
        ("typescript", "fetch('http://s/x', { method: 'DELETE' });\nawait axios.post(`http://s/${id}`);\nfetch(\"http://s/z\")", [(1, "DELETE", "http://s/x", 0.9), (2, "POST", "http://s/${id}", 0.7), (3, "GET", "http://s/z", 0.9)]),
        ("python", 's.get("http://a-api/x")\nself.http_client.put("http://b/y")\nd.get("http://a/b")\nurllib.head("http://c/z", x)', [(1, "GET", "http://a-api/x", 0.9), (2, "PUT", "http://b/y", 0.9), (4, "HEAD", "http://c/z", 0.9)]),
        ("csharp", '_http.SendAsync("http://s/x");\nhttp.PutAsync(@"http://s/y");\nw.DownloadString("http://no/x");\nwebClient.UploadData("http://s/z", d);\nclient.Fetch("http://no/y");', [(1, "GET", "http://s/x", 0.9), (2, "PUT", "http://s/y", 0.9), (4, "POST", "http://s/z", 0.9)]),
        ("typescript", 'superagent.put("http://s/x"); userApi.request("http://s/y"); map.get("http://no/x")', [(1, "PUT", "http://s/x", 0.9), (1, "GET", "http://s/y", 0.9)]),
        ("go", 'client.Get("http://a/x/" + id); http.Get(fmt.Sprintf("http://a/x/%d", id))\nhttp.Get(`http://a/y`)', [(1, "GET", "http://a/x/", 0.7), (1, "GET", "http://a/x/%d", 0.7), (2, "GET", "http://a/y", 0.9)]),
        ("go", 's := "/*"; http.Get("http://a/x") // */\nfmt.Println("http://no/x")\nreq, _ := http.NewRequestWithContext(ctx, "put", "http://s/y"+z, nil)', [(1, "GET", "http://a/x", 0.9), (3, "PUT", "http://s/y", 0.7)]),
        ("typescript", 'fetch("http://a/u", {headers: {a: 1}, method: "POST"}); axios.request({url: \'http://a/x\'});\naxios.get("http://no/x/" + id)', [(1, "POST", "http://a/u", 0.9), (1, "GET", "http://a/x", 0.9)]),
        ("typescript", "const r = /[`\"]/g; getClient().get<A<B>>(`http://a/${await http.put('http://b/c')}`)", [(1, "GET", "http://a/${await http.put('http://b/c')}", 0.7), (1, "PUT", "http://b/c", 0.9)]),
        ("csharp", '#region "\nvar s = $"a{b["}"]}"; client.GetAsync("http://no/x/" + id);\n_http?.PostAsync($"http://s/{d["k"]}", x); client.DeleteAsync(requestUri: "http://t/u")', [(3, "POST", 'http://s/{d["k"]}', 0.7), (3, "DELETE", "http://t/u", 0.9)]),
        ("csharp", 'var r = await _client.GetAsync("http://s/x");\nclient.PostAsync($"http://s/{id}");\n/* client.GetAsync("http://n/x") */', [(1, "GET", "http://s/x", 0.9), (2, "POST", "http://s/{id}", 0.7)]),
    ],
)
def test_extraction(language, text, calls):
    assert extract.calls_in(text, language) == calls


def test_imports(spark):
    files = [("p", "python", 'import os, sys as s\nfrom a.b import c\n"""import no"""\nfrom . import x\nfrom .y import z\n# import no\n'), ("g", "go", 'import "net/http"\nimport (\n\tx "fmt"\n\t_ "a/b"\n)\nvar s = `\nimport "no"`\n'),
             ("t", "typescript", "import axios from 'axios';\nimport {\n a,\n b } from './x'\nimport 'side';\nexport * from \"y\";\nconst s = `\nimport z from 'no'`;"), ("c", "csharp", 'using System.Net;\nusing static A.B;\nusing J = K.L;\nusing (var x = y) { }\nvar s = @"\nusing No;";'), ("n", "go", None), ("o", "rust", "use x;")]
    got = {}
    for r in extract.imports(spark.createDataFrame(files, "path string, language string, content string")).collect():
        got.setdefault(r.path, set()).add(r.module)
    assert got == {"p": {"os", "sys", "a.b", ".", ".y"}, "g": {"net/http", "fmt", "a/b"}, "t": {"axios", "./x", "side", "y"}, "c": {"System.Net", "A.B", "K.L"}}


def test_stores(spark, tmp_path):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "id long, v string")
    assert {tuple(r) for r in tables.insert_ignore(store, new, "id", F.col("v")).collect()} == {(1, "a"), (2, "b"), (3, "y")}
    with pytest.raises(Exception, match="duplicate key"):
        tables.insert_or_fail(store, new, "id").collect()
    assert tables.insert_or_fail(store, new.filter("v = 'z'"), "id").count() == 3
    path = str(tmp_path / "routes")
    rows = lambda *r: spark.createDataFrame(r, "service string, path string")
    tables.write_by_service(rows(("s", "/a"), ("t", "/b")), path)
    tables.write_by_service(rows(("s", "/c")), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("service", "path").collect()} == {("s", "/c"), ("t", "/b")}


def test_readers(spark, tmp_path):
    src = tmp_path / "src"
    for name, content in {"a.py": b"x = 1", "lib/b.go": b"package b", "node_modules/c.js": b"no", "README.md": b"# Hi", "bad.py": b"\xff\xfe ok"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(content)
    rows = crawl.files(spark, str(src), crawl.CODE).collect()
    assert {(r.path.rsplit("/", 1)[1], r.language) for r in rows} == {("a.py", "python"), ("b.go", "go"), ("bad.py", "python")}
    assert [r.is_readme for r in crawl.files(spark, str(src), crawl.DOCS).collect()] == [True]
    tracked = spark.createDataFrame([("lib/b.go",)], "path string")
    assert [r.language for r in crawl.tracked_files(spark, str(src), tracked).collect()] == ["go"]
    chat = tmp_path / "export" / "general"
    chat.mkdir(parents=True)
    (chat / "2024-01-02.json").write_text(json.dumps([{"type": "message", "user": "u2", "text": "later", "ts": "2.0"}]))
    (chat / "2024-01-01.json").write_text(json.dumps([{"type": "message", "username": "bot", "text": "hi", "ts": "1.0", "thread_ts": "1.0"}, {"type": "join"}]))
    out = crawl.chat_export(spark, str(tmp_path / "export")).collect()
    assert [(m.speaker, m.thread, m.text) for m in out[0].messages] == [("bot", "1.0", "hi"), ("u2", "main", "later")] and out[0].uri == "slack://general"
    assert crawl.is_chat_export(spark, str(tmp_path / "export")) and crawl.conversations(spark, str(tmp_path / "export")).count() == 2
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "notes.json").write_text('{"a": 1}')
    assert not crawl.is_chat_export(spark, str(tmp_path / "plain"))
    (tmp_path / "talk.txt").write_text("Ann: hello\n\nno name\nBob: a: b")
    assert [(r.speaker, r.text) for r in crawl.transcripts(spark, str(tmp_path)).orderBy("pos").collect()] == [("Ann", "hello"), ("unknown", "no name"), ("Bob", "a: b")]


def test_task_lives(spark):
    rows = [("p", 1, 10, "register", "a", None), ("p", 2, 11, "submit", "a", "t"), ("p", 3, 12, "start", "b", "t"), ("p", 4, 13, "failed", "b", "t"), ("p", 5, 14, "start", "c", "t"), ("p", 6, 15, "submit", "a", "u"), ("q", 7, 16, "submit", "a", "t"), ("q", 8, 17, "done", "a", "t")]
    lives = jobs.task_lives(spark.createDataFrame(rows, "pool string, seq long, at long, tool string, worker string, task string"))
    assert {tuple(r) for r in lives.collect()} == {("p", "t", 1, 1, "executing", "c", 14), ("p", "u", 1, 0, "queued", "a", 15), ("q", "t", 1, 0, "done", "a", 17)}
    late = {(r.pool, r.task): (r.state, r.worker) for r in jobs.requeued(lives, F.lit(14 + jobs.TASK_TIMEOUT + 1)).collect()}
    assert late == {("p", "t"): ("queued", None), ("p", "u"): ("queued", "a"), ("q", "t"): ("done", "a")}


def test_streams_append_in_turns(spark, tmp_path):
    """What is final is appended to a table; a second run over more files goes on from the progress that was kept."""
    rows = spark.range(6).selectExpr("id", "timestamp_seconds(id * 3600) as ts", "'a' as event_type", "cast(id as double) as value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert jobs.finish(stream.select("id"), "ids", ["id"]).count() == 6
    assert jobs.finish(jobs.hourly(stream), "hours", ["start", "event_type"]).count() == 6


def test_requests_and_yaml(spark):
    lines = spark.createDataFrame([('{"id": "1", "tool": "poll", "params": {"a": "b"}}',), ("",), ("broken{",)], "value string")
    assert {(r.id, r.tool, r.error) for r in crawl.requests(lines).collect()} == {("1", "poll", None), (None, None, "bad request")}


def test_models_and_pages(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, " "), (3, None)], "doc_id long, text string")
    out = vectors.model_embedding(docs, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()
    assert {r.doc_id: list(r.vector) for r in out} == {1: [2.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    pairs = spark.createDataFrame([(1, k, "q", "x" * k, float(k)) for k in range(5)], "query_id long, doc_id long, query string, text string, score double")
    out = search.rerank(pairs, lambda: lambda q, t: [-float(len(x)) for x in t], 3).collect()
    assert {(r.doc_id, r.score) for r in out} == {(4, -4.0), (3, -3.0), (2, -2.0)}
    status = spark.createDataFrame([("b", "d2", "FRESH", "2024-01-02T03:04"), ("b", "d1", "STALE", "2024-01-01T00:00")], "lens string, doc string, status string, generated string")
    got = {r.lens: r.lines for r in lens.index_lines(status, ["a", "b"]).collect()}
    assert got == {"a": "(empty)", "b": "d1 | STALE | 2024-01-01\nd2 | FRESH | 2024-01-02"}
    asked = spark.createDataFrame([("x", None), ("x", "own")], "agent string, lens string")
    assert sorted(r.lens for r in lens.lenses_for(asked, spark.createDataFrame([("x", "std")], "agent string, default_lens string")).collect()) == ["own", "std"]
    page = spark.createDataFrame([("d", "flows", "auth", "2024", "text")], "doc string, lens string, focus string, generated string, body string")
    assert lens.page_texts(page).select(T.front_matter(F.col("text"), "focus")).first()[0] == "auth"


def test_called_by_gathers_no_lists(spark, tmp_path):
    rows = [(k, 7) for k in range(1000)] + [(k, 7) for k in range(500)] + [(3, 8), (5, None), (None, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = registry.queries()["called_by"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(7, 1000, 0, 999), (8, 1, 3, 3), (None, 1, 5, 5)], key=str)
    assert "collect_" not in out._jdf.queryExecution().toString()


def test_nearest_for_each_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    store = rng.integers(0, 3, (2500, 4)).astype(float)  # many ties
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(store)] + [(9999, None)], "vec_id long, embedding array<float>")
    out = vectors.nearest_for_each(table, table.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add((r.distance, r.vec_id))
    for q in range(0, 2500, 50):
        assert got[q] == set(sorted((float(d), k) for k, d in enumerate(((store - store[q]) ** 2).sum(axis=1)))[:3])


def test_lenses(spark):
    lenses = lens.lens_table(spark, {"flows": (("save", "(broken"), ("test",)), "boundaries": ((), ())})
    symbols = spark.createDataFrame([("a.ts", "saveUser", 12), ("a.ts", "x(broken", 12), ("test/a.ts", "save", 12), ("a.ts", "Box", 2)], "uri string, name string, kind int")
    got = {(r.lens, r.name) for r in lens.lens_symbols(symbols, lenses).filter("lens in ('flows', 'boundaries')").collect()}
    assert got == {("flows", "saveUser"), ("flows", "x(broken"), ("boundaries", "Box")}
    asked = lambda name, column: spark.createDataFrame([(name,)], f"{column} string")
    assert [r.lens for r in lens.agent_lenses(asked("security", "agent")).collect()] == ["trust-zones", "contracts"]
    for bad in (lens.agent_lenses(asked("nobody", "agent")), lens.with_lens(asked("none", "lens"), lenses)):
        with pytest.raises(Exception, match="unknown (agent|lens)"):
            bad.collect()
    files = spark.createDataFrame([("a", "x foo\nfoo bar"), ("b", "bar"), ("c", "foo")], "path string, content string")
    found = lens.structural_search(files, ["fo+", "ba[r", "foo"], 2).collect()
    assert {(r.path, r.line, r.column, r.pattern) for r in found} == {("a", 1, 3, "fo+"), ("a", 2, 1, "fo+"), ("c", 1, 1, "fo+")}


@pytest.mark.parametrize("glob,path,fits", [("**/*.{ts,go}", "a/b/c.go", True), ("**/*.{ts,go}", "c.ts", True), ("*.ts", "a/c.ts", False), ("src/**/auth/**/*.py", "src/x/auth/y/z.py", True), ("src/**/auth/**/*.py", "src/auth/z.py", True), ("**/*auth*.py", "a/my-auth-x.py", True), ("**/*auth*.py", "auth/x.py", False)])
def test_globs(glob, path, fits):
    assert bool(re.search(lens.glob_expression(glob), path)) is fits


def test_service_resolution_and_references(spark):
    services = spark.createDataFrame([("user-service", 2), ("user", 1), ("billing", 3), ("ab", 4)], "name string, seq int")
    names = spark.createDataFrame([(n,) for n in ("user-service", "USER.example.org:80", "my-user-service-v2", "bill", "zzz", "", None)], "name string")
    got = {r.name: r.service for r in linking.resolve_services(names, services).collect()}
    assert got == {"user-service": "user-service", "USER.example.org:80": "user", "my-user-service-v2": "user", "bill": "billing", "zzz": None, "": "user", None: None}
    texts = spark.createDataFrame([(1, "Ask BILLING, http://billing:80/x and http://user/y"), (2, "nothing"), (3, None), (4, "cab")], "doc_id long, text string")
    found = {(r.doc_id, r.service): r.n for r in linking.service_references(texts, services).collect()}
    assert found == {(1, "billing"): 2, (1, "user"): 2, (4, "ab"): 1}


def test_scrub_with_a_model(spark):
    def load():
        def model(text):
            if "fail" in text:
                raise ValueError("no")
            return [(m.start(), m.end(), "PERSON") for m in re.finditer("Ann", text)]

        return model

    docs = spark.createDataFrame([(1, "Ann has a.b@c.org"), (2, "fail"), (3, None), (4, "ok")], "doc_id long, text string")
    out = {r.doc_id: (r.clean, len(r.log), r.error) for r in scrub.scrub(docs, load=load).collect()}
    assert out == {1: ("[PERSON] has [EMAIL]", 2, None), 2: (None, 0, "ValueError: no"), 3: (None, 0, None), 4: ("ok", 0, None)}


def test_batches_and_unique_routes(spark):
    new = spark.createDataFrame([("s", "/a", 1), ("s", "/a", 2), ("t", "/b", None)], "service string, path string, v int")
    assert tuple(tables.insert_report(new, F.col("v") > 1).first()) == (1, 2) and tables.failed_rows(new, F.col("v") > 1).count() == 2
    with pytest.raises(Exception, match="duplicate key s /a"):
        tables.replace_groups(new, new, "service", ["service", "path"]).collect()
    assert tables.replace_groups(new, new.filter("v = 1"), "service", ["service", "path"]).count() == 2


def test_fan_out(spark, tmp_path):
    for name, text in {"code/a.py": "x = 1", "docs/b.md": "# B", "talk/c.txt": "Ann: hi"}.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    rows = crawl.fan_out(spark, [(k, str(tmp_path / k)) for k in ("code", "docs", "talk")]).collect()
    assert {(r.kind, r.content) for r in rows} == {("code", "x = 1"), ("docs", "# B"), ("talk", "Ann: hi")}


def test_route_tables(spark):
    routes = spark.createDataFrame([("s", "/a"), ("t", "/b"), (None, "/c")], "service string, path string")
    assert [r.path for r in tables.routes_of(routes, "s").collect()] == ["/a"]
    assert {r.path for r in tables.cleared(routes, "s").collect()} == {"/b", "/c"} and tables.cleared(routes).count() == 0


def test_token_windows_and_siblings(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, " ")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in chunking.token_windows(docs, 3, 1).orderBy("ordinal").collect()] == [(1, "a b c"), (1, "c d e")]
    parts = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c"), (1, 2, "d e f g"), (1, 5, "h"), (2, 0, "x")], "doc_id long, ordinal int, text string")
    rows = chunking.merged_siblings(parts, 3).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.first, r["last"], r.n_tokens, r.text) for r in rows] == [(1, 0, 0, 1, 3, "a b\nc"), (1, 1, 2, 2, 4, "d e f g"), (1, 2, 5, 5, 1, "h"), (2, 0, 0, 0, 1, "x")]


def test_uris(spark):
    for path in ("/a b/c.py", "/100%/x+y", "/é"):
        assert one(spark, T.uri_path(T.file_uri(F.col("p"))), p=path) == path
    assert one(spark, T.file_uri(F.col("p")), p="/a\\b%") == "file:///a/b%25" and one(spark, T.uri_path(F.col("p")), p="x/y") == "x/y"
    assert one(spark, T.uri_path(F.col("p")), p="file:///a%20b") == "/a b"


def test_freshness_is_for_conversations(spark):
    rows = spark.createDataFrame([("CONVO_SLACK", "2024-01-01", 1.0), ("DOC_DESIGN", "2024-01-01", 1.0), ("CONVO_SLACK", None, 1.0), (None, "2024-01-01", 1.0)], "corpus string, ts string, score double")
    got = [r.s for r in rows.select(search.fresh(F.col("score"), F.col("ts"), F.lit("2024-01-01"), 0.1, 90.0, F.col("corpus")).alias("s")).collect()]
    assert got == [1.0, 1.0, 1.0, 1.0]
    late = rows.select(search.fresh(F.col("score"), F.col("ts"), F.lit("2024-03-31"), 0.1, 90.0, F.col("corpus")).alias("s")).collect()
    assert [round(r.s, 4) for r in late] == [0.95, 1.0, 1.0, 1.0]
