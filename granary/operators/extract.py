"""Service calls, routes, imports and named things extracted from source text."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import lexer

VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
# Names of HTTP clients, and the HTTP methods of C# client methods.
CLIENTS = ("requests", "httpx", "aiohttp", "urllib", "http", "session", "client", "s", "c", "http_client")
GO_CLIENTS = ("http", "client", "c", "httpclient", "httputil")
SCRIPT_CLIENTS = ("axios", "http", "https", "request", "got", "ky", "superagent", "$", "jquery")
SHARP_METHODS = {
    "getasync": "GET", "getstringasync": "GET", "getstreamasync": "GET", "getbytearrayasync": "GET", "postasync": "POST", "putasync": "PUT",
    "deleteasync": "DELETE", "patchasync": "PATCH", "sendasync": "GET", "downloadstring": "GET", "downloadstringasync": "GET",
    "downloaddata": "GET", "uploadstring": "POST", "uploaddata": "POST",
}
HIGH, MEDIUM, LOW, GUESS = 0.9, 0.7, 0.5, 0.3
CALL = "source_file string, line int, method string, url string, confidence double"
LOCAL = ("localhost", "127.0.0.1", "0.0.0.0")


def confidence(url: Column, kind: Column) -> Column:
    """How sure a url of a source is: a plain string with a scheme, one that is built from parts, or anything else."""
    plain = (kind == "string") & url.rlike("^https?://")
    return F.when(plain, HIGH).when(kind.isin("formatted_string", "template_string"), MEDIUM).otherwise(LOW)


def python_calls(text: str) -> Iterator[tuple[int, str, str, float]]:
    """(line, method, url, confidence) of HTTP client calls: a verb called on a client, with a url as its first text."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in VERBS):
            continue
        target = node.func.value
        name = ast.unparse(target).lower()
        if not (name in CLIENTS or "client" in name or "session" in name):
            continue
        for arg in node.args:
            if isinstance(arg, ast.Constant) and isinstance(arg.value, str):
                url, confidence = arg.value, HIGH
            elif isinstance(arg, ast.JoinedStr):
                url, confidence = "".join(p.value if isinstance(p, ast.Constant) else "{x}" for p in arg.values), MEDIUM
            else:
                continue
            if re.match("https?://", url):
                yield node.lineno, node.func.attr.upper(), url, confidence
                break


def sent_by(language: str, receiver: str, verb: str) -> str | None:
    """The HTTP method of a call of receiver.verb, if that is one."""
    name, low = receiver.lower(), verb.lower()
    if language == "csharp":
        return SHARP_METHODS.get(low) if "client" in name or "http" in name else None
    if language == "go":
        return verb.upper() if low in VERBS[:6] and (name in GO_CLIENTS or "client" in name or "http" in name) else None
    known = name in SCRIPT_CLIENTS or any(w in name for w in ("client", "http", "api"))
    return ("GET" if low == "request" else verb.upper()) if low in (*VERBS[:6], "request") and known else None


_LINK = re.compile(r"https?://[^\s\"'`]*")
FETCHED = ("GET", "POST", "PUT", "DELETE", "PATCH")


def literal(part: list[lexer.Node], text: str, language: str) -> tuple[str, float] | None:
    """The url of an argument that is a literal, and how sure it is; one with holes is less so."""
    if language == "csharp" and len(part) == 3 and part[1].said(text) == ":":  # a named argument
        part = part[2:]
    if len(part) != 1 or part[0].kind not in ("string", "built"):
        return None
    url = part[0].said(text).lstrip("$@").strip("\"'`")
    found = re.search("https?://", url)
    return (url[found.start() :], MEDIUM if part[0].kind == "built" else HIGH) if found else None


def joined(part: list[lexer.Node], text: str) -> tuple[str, float] | None:
    """The url of a Go argument that is put together, by operators or by a call: its literal part."""
    operators = any(c.kind == "op" and c.said(text) in "+-*/%|&" for c in part)
    called = len(part) > 1 and part[-1].kind == "group" and part[-1].open == "("
    found = _LINK.search(text[part[0].start : part[-1].end]) if part and (operators or called) else None
    return (found[0], MEDIUM) if found else None


def options(part: list[lexer.Node], text: str) -> dict[str, list[lexer.Node]]:
    """The pairs of an argument that is an object."""
    if len(part) != 1 or part[0].kind != "group" or part[0].open != "{":
        return {}
    pairs = [p for p in lexer.parts(part[0], text) if len(p) > 2 and p[1].said(text) == ":"]
    return {p[0].said(text).strip("\"'"): p[2:] for p in pairs}


def url_among(arguments: list[list[lexer.Node]], text: str, language: str) -> tuple[str, float] | None:
    """The first url among arguments, in TypeScript also under url or baseURL of an object."""
    for part in arguments:
        if found := literal(part, text, language):
            return found
        for name, value in options(part, text).items() if language == "typescript" else ():
            if name in ("url", "baseURL", "baseUrl") and value[0].kind == "string" and (found := literal(value, text, language)):
                return found
    return None


def scanned_calls(text: str, language: str) -> Iterator[tuple[int, str, str, float]]:
    """The calls of a Go, TypeScript or C# source, from its tree of brackets."""
    ends = [m.start() for m in re.finditer("\n", text)]
    for start, receiver, name, group in lexer.calls(lexer.tree(text, language), text, language):
        arguments, verb, url = lexer.parts(group, text), None, None
        if language == "go" and name in ("NewRequest", "NewRequestWithContext") and receiver:
            first = int(name != "NewRequest")
            said = arguments[first][0].said(text).strip('"`').upper() if len(arguments) > first + 1 and len(arguments[first]) == 1 else ""
            verb = said if said in (*FETCHED, "HEAD") else None
            url = (literal(arguments[first + 1], text, language) or joined(arguments[first + 1], text)) if verb else None
        elif receiver and (verb := sent_by(language, receiver, name)):
            first = arguments[0] if arguments else []
            url = (literal(first, text, language) or joined(first, text)) if language == "go" else url_among(arguments, text, language)
        elif language == "typescript" and receiver is None and name == "fetch":
            chosen = options(arguments[1], text).get("method", []) if len(arguments) > 1 else []
            said = chosen[0].said(text).strip("\"'").upper() if len(chosen) == 1 else ""
            verb, url = said if said in FETCHED else "GET", url_among(arguments, text, language)
        if verb and url:
            yield bisect.bisect_left(ends, start) + 1, verb, *url


def calls_in(text: str, language: str) -> list[tuple[int, str, str, float]]:
    found = python_calls(text) if language == "python" else scanned_calls(text, language) if language in lexer.TOKENS else ()
    return [f for f in found if re.match(r"https?://([^/:]+)", f[2]) and re.match(r"https?://([^/:]+)", f[2])[1] not in LOCAL]


def service_calls(files: DataFrame) -> DataFrame:
    """Calls of all files (path, language, content); files of other languages, and null contents, have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *c) for path, lang, text in zip(frame["path"], frame["language"], frame["content"]) if isinstance(text, str) for c in calls_in(text, lang)]
            yield pd.DataFrame(rows, columns=["source_file", "line", "method", "url", "confidence"])

    return files.select("path", "language", "content").mapInPandas(run, CALL)


def queue_calls(files: DataFrame) -> DataFrame:
    """(path, kind, target): remote channels, and topics that are published to or subscribed from, by patterns."""
    kinds = (
        ("grpc", r"(?:insecure_channel|secure_channel|grpc\.Dial)\(\s*[\"']([^\"':]+)"),
        ("publish", r"\.(?:publish|send|produce)\(\s*[\"']([\w.-]+)"),
        ("subscribe", r"\.(?:subscribe|consume)\(\s*[\[]?[\"']([\w.-]+)"),
    )
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("targets")) for k, p in kinds))
    return files.select("path", F.explode(each).alias("e")).select("path", "e.kind", F.explode("e.targets").alias("target"))


def routes(files: DataFrame) -> DataFrame:
    """(path, method, route): decorators, attributes and registrations of the usual web frameworks, by pattern.

    `@app.get("/x")`, `router.POST("/x", ...)`; `@app.route("/x", methods=["GET", "PUT"])`, GET without methods;
    `@Get("x")` in a `@Controller("base")`; `[HttpGet("x")]` in a class with `[Route("base")]`. A base stands before the
    routes after it.
    """
    verb = "get|post|put|delete|patch"
    called = F.regexp_extract_all("content", F.lit(rf"(?i)(?:@\w+|\b\w+)\.({verb})\(\s*[\"']/[^\"']*[\"']"), F.lit(0))
    listed = F.regexp_extract_all("content", F.lit(r"@\w+\.route\(\s*[\"']/[^\"']*[\"'][^)]*\)"), F.lit(0))
    # a part for each controller: what stands before the first has no base
    parts = F.split("content", r"(?=@Controller\()|(?=\[Route\()")
    marked = F.flatten(F.transform(parts, lambda part: F.transform(
        F.regexp_extract_all(part, F.lit(rf"(?:@|\[Http)(?i:{verb})\((?:\s*[\"'][^\"']*[\"'])?\s*\)|\[Http(?i:{verb})\]"), F.lit(0)),
        lambda hit: F.concat(hit, F.lit("\n"), F.regexp_extract(part, r"^(?:@Controller|\[Route)\(\s*[\"']([^\"']*)[\"']", 1)))))
    quoted = lambda c: F.regexp_extract(c, r"[\"']([^\"']*)[\"']", 1)
    one = files.select("path", F.explode(called).alias("hit")).select("path", F.upper(F.regexp_extract("hit", rf"(?i)\.({verb})\(", 1)).alias("method"), quoted("hit").alias("route"))
    methods = F.filter(F.regexp_extract_all(F.upper(F.regexp_extract("hit", r"methods\s*=\s*[\[({]([^\])}]*)", 1)), F.lit(r"[A-Z]+"), F.lit(0)), lambda m: m != "")
    many = files.select("path", F.explode(listed).alias("hit")).select("path", F.explode(F.when(F.size(methods) > 0, methods).otherwise(F.array(F.lit("GET")))).alias("method"), quoted("hit").alias("route"))
    hit, base = F.split_part("hit", F.lit("\n"), F.lit(1)), F.split_part("hit", F.lit("\n"), F.lit(2))
    joined = F.concat(F.lit("/"), F.array_join(F.filter(F.array(F.regexp_replace(base, "^/+|/+$", ""), F.regexp_replace(quoted(hit), "^/+|/+$", "")), lambda x: x != ""), "/"))
    under = files.select("path", F.explode(marked).alias("hit")).select("path", F.upper(F.regexp_extract(hit, rf"(?i)({verb})", 1)).alias("method"), joined.alias("route"))
    return one.unionByName(many).unionByName(under)


def imported(text: str, language: str) -> Iterator[str]:
    """The modules that a source imports, in order; what strings and comments say is none."""
    root = lexer.tree(text, language)
    for run in lexer.statements(root, text):
        said = [c.said(text) for c in run]
        if language == "python" and said[0] in ("from", "import"):
            end = next((k for k, c in enumerate(run) if k and (c.kind == "name" and said[k] in ("import", "as"))), len(run)) if said[0] == "from" else len(run)
            for part in " ".join(said[1:end]).split(" , "):
                yield re.sub(r"\s+", "", part.split(" as ")[0])
        elif language == "typescript" and said[0] in ("import", "export"):
            last = next((c for k, c in enumerate(run) if c.kind == "string" and (said[k - 1] == "from" or k == 1)), None)
            if last is not None:
                yield last.said(text).strip("\"'")
        elif language == "go" and said[0] == "import":
            for c in run[1:]:
                yield from (x.said(text).strip("\"`") for x in ([c] if c.kind == "string" else c.children) if x.kind == "string")
        elif language == "csharp" and (said[:1] == ["using"] or said[:2] == ["global", "using"]) and said[-1] == ";" and not any(c.kind == "group" for c in run):
            name = "".join(w for w in said[said.index("using") + 1 : -1] if w != "static")
            yield name.split("=")[-1]


def imports(files: DataFrame) -> DataFrame:
    """(path, module): what files (path, language, content) import, each module once; null contents import nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, m) for path, lang, text in zip(frame["path"], frame["language"], frame["content"]) if isinstance(text, str) and lang in lexer.TOKENS for m in dict.fromkeys(imported(text, lang)) if m]
            yield pd.DataFrame(rows, columns=["path", "module"])

    return files.select("path", "language", "content").mapInPandas(run, "path string, module string")


def named_things(docs: DataFrame) -> DataFrame:
    """(doc_id, type, name): services, incidents and people named in free text."""
    kinds = (("SERVICE", r"(?i)\b([a-z][a-z0-9]*[-_](?:service|api|svc))\b"), ("INCIDENT", r"(?i)\b(inc-?[0-9]{2,})\b"), ("PERSON", r"@([A-Za-z][\w.-]*)"))
    each = F.array(*(F.struct(F.lit(k).alias("type"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("names")) for k, p in kinds))
    rows = docs.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.type", F.explode("e.names").alias("name"))
    return rows.withColumn("name", F.when(F.col("type") == "SERVICE", F.replace(F.lower("name"), F.lit("_"), F.lit("-"))).otherwise(F.lower("name"))).distinct()
