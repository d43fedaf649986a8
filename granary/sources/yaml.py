"""YAML documents as variants, and what deployment resources say of services.

The parser keeps a stack of open mappings and lists by their indentation. It knows what resources are written in:
nested and listed forms, flow forms, quoted and block scalars, comments, several documents in a file. Anchors, tags and
complex keys are no part of it; a document with a line that it can't place has an error and no value.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.batches import flat_map

_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s"'\[\]{},#&*!|>%@`-][^#\n]*?|-[^\s][^#\n]*?)[ \t]*:(?=[ \t]|$)[ \t]*""")
_FLOW = re.compile(r"""[ \t\n]*([\[\]{},:]|"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\[\]{},:\s](?:[^\[\]{},:\n]|:(?=\S))*)""")
_NUMBERS = ((re.compile(r"[-+]?[0-9]+"), int), (re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?"), float))
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_ESCAPED = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b"}


@functools.lru_cache(4096)
def scalar(text: str) -> object:
    """The value of a plain or quoted scalar; keys and common values are remembered."""
    text = text.strip()
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        return _ESCAPED.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text[1:-1])
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text in _WORDS:
        return _WORDS[text]
    for pattern, kind in _NUMBERS:
        if pattern.fullmatch(text) and not re.match(r"[-+]?0[0-9]", text):
            return kind(text)
    return text


def flow(text: str) -> object:
    """The value of a flow form, brackets within brackets."""
    stack: list[tuple[object, object]] = []  # containers, each with the key that waits for a value
    at, done, out = 0, False, None

    def put(value: object) -> None:
        nonlocal done, out
        if not stack:
            done, out = True, value
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        elif stack[-1][1] is None:
            stack[-1] = (stack[-1][0], (value,))
        else:
            stack[-1][0][str(stack[-1][1][0])] = value
            stack[-1] = (stack[-1][0], None)

    while not done and (m := _FLOW.match(text, at)):
        at, token = m.end(), m[1]
        if token in "[{":
            stack.append(([], None) if token == "[" else ({}, None))
        elif token in "]}":
            whole, waiting = stack.pop() if stack else (None, None)
            if not isinstance(whole, list if token == "]" else dict):
                raise ValueError(text)
            if waiting:
                whole[str(waiting[0])] = None
            put(whole)
        elif token == ",":
            if stack and stack[-1][1]:
                put(None)
        elif token != ":":
            put(scalar(token))
    if not done or text[at:].strip() and not text[at:].strip().startswith("#"):
        raise ValueError(text)
    return out


def _bare(line: str) -> str:
    """A line without its comment; a # inside quotes or a word is none."""
    if "#" not in line:
        return line.rstrip()
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote and (c == "'" or line[k - 1] != "\\") else quote
        elif c in "\"'" and (not k or line[k - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (not k or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


def document(text: str) -> object:
    """The value of one document; ValueError for what can't be placed."""
    lines = text.split("\n")
    root: list = [None]
    stack: list[tuple[int, object, object]] = [(-1, root, 0)]  # indentation, container, key of the value that may follow deeper
    k = 0
    while k < len(lines):
        line = _bare(lines[k])
        k += 1
        body = line.lstrip(" ")
        if not body or body.startswith("%") and len(stack) == 1:
            continue
        if body.startswith("\t"):
            raise ValueError(line)
        indent = len(line) - len(body)
        while True:
            item = body == "-" or body.startswith(("- ", "-\t"))
            m = None if item else _KEY.match(body)
            while stack[-1][0] > indent or stack[-1][0] == indent and isinstance(stack[-1][1], list) and not item:
                stack.pop()
            at, holder, key = stack[-1]
            if (item or m) and (at < indent or item and isinstance(holder, dict)):  # opens a container as the value that is waited for
                if holder[key] is not None:
                    raise ValueError(line)
                holder[key] = [] if item else {}
                stack.append((indent, holder[key], None))
            at, holder, key = stack[-1]
            if item and isinstance(holder, list) and holder is not root:
                holder.append(None)
                stack[-1] = (at, holder, len(holder) - 1)
                rest = body[1:].lstrip(" \t")
                indent += len(body) - len(rest)
                body = rest
                if not body:
                    break
                if body == "-" or body.startswith("- ") or _KEY.match(body):
                    continue
            elif m and isinstance(holder, dict):
                key = str(scalar(m[1]))
                holder[key] = None
                stack[-1] = (at, holder, key)
                body = body[m.end() :]
                if not body:
                    break
            elif not m and not item and (at < indent or holder is root) and holder[key] is None:
                pass
            elif not m and not item and at < indent and isinstance(holder[key], str):  # a plain scalar goes on
                holder[key] += " " + body
                break
            else:
                raise ValueError(line)
            holder, key = stack[-1][1], stack[-1][2]
            if body[0] in "|>" and (b := re.fullmatch(r"([|>])([-+]?)[0-9]?([-+]?)", body)):
                own, k = _block(lines, k, stack[-1][0] if holder is not root else -1)
                said = "\n".join(own) if b[1] == "|" else re.sub(r"\n(\n*)", lambda m: m[1] or " ", "\n".join(own))
                holder[key] = said.rstrip("\n") + ("" if "-" in (b[2], b[3]) else "\n")
            elif body[0] in "[{":
                while True:
                    try:
                        holder[key] = flow(body)
                        break
                    except ValueError:
                        if k >= len(lines):
                            raise
                        body, k = body + "\n" + _bare(lines[k]), k + 1
            else:
                if body[0] not in "\"'" and re.search(r":(?:\s|$)", body):
                    raise ValueError(line)
                holder[key] = scalar(body)
            break
    return root[0]


def _block(lines: list[str], k: int, indent: int) -> tuple[list[str], int]:
    """The lines of a block scalar from line k on, deeper than indent, and the line after them."""
    own: list[str] = []
    deep = None
    while k < len(lines):
        line = lines[k]
        if line.strip():
            here = len(line) - len(line.lstrip(" "))
            if here <= indent or deep is not None and here < deep:
                break
            deep = here if deep is None else deep
        own.append(line[deep or 0 :] if line.strip() else "")
        k += 1
    return own, k


def documents(files: DataFrame) -> DataFrame:
    """(path, ordinal, value, error) of YAML files (path, content): a variant for each document that says something, split
    at --- lines; error tells the line that can't be read. Null and empty files have no documents."""

    def each(path: str, content: str | None) -> Iterator[tuple]:
        for n, part in enumerate(re.split(r"(?m)^---(?:[ \t].*)?$", content.replace("\r\n", "\n")) if content is not None else ()):
            try:
                value = document(re.split(r"(?m)^\.\.\.[ \t]*$", part)[0])
                if value is not None:
                    yield path, n, json.dumps(value), None
            except (ValueError, RecursionError) as e:
                yield path, n, None, str(e)[:200]

    found = flat_map(files.select("path", "content"), each, "path string, ordinal int, json string, error string")
    return found.select("path", "ordinal", F.try_parse_json("json").alias("value"), "json", "error")


def _text(path: str, value: Column | str = "value") -> Column:
    return F.try_variant_get(F.col(value) if isinstance(value, str) else value, path, "string")


#: Keys whose whole number is a port.
PORTS = ("port", "targetPort", "containerPort", "nodePort", "hostPort", "servicePort")


def resources(files: DataFrame) -> DataFrame:
    """(path, ordinal, kind, name, namespace, labels, service_name, ports, images, env_refs, value) of the documents that
    name a kind. ports: all port numbers, nested or
    listed, or the number under a port, in their order; service_name: the label app."""
    kind = _text("$.kind")
    listed = lambda pattern: F.regexp_extract_all("json", F.lit(pattern), F.lit(1))
    # in JSON a quote inside a string has a backslash before it, so these keys are keys
    ports = listed(rf'(?<!\\)"(?:{"|".join(PORTS)})": (?:\{{"number": )?([0-9]{{1,5}})(?![0-9.eE])').cast("array<int>")
    refs = listed(r'(?<!\\)"(?:configMapKeyRef|secretKeyRef|configMapRef|secretRef)": \{[^{}]*"name": "((?:\\.|[^"\\])*)"')
    labels = F.try_variant_get("value", "$.metadata.labels", "map<string,string>")
    found = documents(files).filter(F.coalesce(kind, F.lit("")) != "")
    return found.select(
        "path", "ordinal", kind.alias("kind"), F.coalesce(_text("$.metadata.name"), F.lit("")).alias("name"), _text("$.metadata.namespace").alias("namespace"),
        labels.alias("labels"), F.try_element_at(labels, F.lit("app")).alias("service_name"), ports.alias("ports"),
        F.array_distinct(listed(r'(?<!\\)"image": "((?:\\.|[^"\\])*)"')).alias("images"), F.array_distinct(refs).alias("env_refs"), "value",
    )


def _each(value: Column, path: str) -> Column:
    """The items of a list, or the one value that stands in its place."""
    many = F.try_variant_get(value, path, "array<variant>")
    return F.coalesce(many, F.when(F.try_variant_get(value, path, "variant").isNotNull(), F.array(F.try_variant_get(value, path, "variant"))), F.array().cast("array<variant>"))


def boundary_signals(found: DataFrame) -> DataFrame:
    """(path, ordinal, signal, name, target, port, route) of resources: a Service bounds a network, an Ingress exposes a
    backend under a host and path, an environment value with a url depends on its host, a NetworkPolicy bounds itself."""
    v = F.col("value")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda signal, target, port, route: F.struct(F.lit(signal).alias("signal"), target.alias("target"), port.alias("port"), route.alias("route"))
    number = lambda x, path: F.try_variant_get(x, path, "int")
    selector = F.coalesce(_text("$.spec.selector.app"), _text("$.spec.selector.matchLabels.app"))
    service = F.transform(_each(v, "$.spec.ports"), lambda p: row("network", selector, number(p, "$.port"), none("string")))
    backend = lambda p: row(
        "external", F.coalesce(_text("$.backend.service.name", p), _text("$.backend.serviceName", p)),
        F.coalesce(number(p, "$.backend.service.port.number"), number(p, "$.backend.servicePort")), _text("$.path", p))
    ingress = F.flatten(F.transform(_each(v, "$.spec.rules"), lambda r: F.transform(_each(r, "$.http.paths"), lambda p: backend(p).withField("route", F.concat(F.coalesce(_text("$.host", r), F.lit("*")), F.coalesce(_text("$.path", p), F.lit("/")))))))
    values = F.flatten(F.transform(F.concat(_each(v, "$.spec.template.spec.containers"), _each(v, "$.spec.containers")), lambda c: F.transform(_each(c, "$.env"), lambda e: F.coalesce(_text("$.value", e), F.lit("")))))
    linked = F.filter(values, lambda e: e.rlike("^[a-z]+://[^/:]+"))
    depends = F.transform(linked, lambda e: row("depends", F.regexp_extract(e, "^[a-z]+://(?:[^/@]*@)?([^/:]+)", 1), F.regexp_extract(e, "^[a-z]+://(?:[^/@]*@)?[^/:]+:([0-9]+)", 1).try_cast("int"), none("string")))
    policy = F.array(row("policy", _text("$.spec.podSelector.matchLabels.app"), none("int"), none("string")))
    every = F.when(F.col("kind") == "Service", service).when(F.col("kind") == "Ingress", ingress).when(F.col("kind") == "NetworkPolicy", policy).otherwise(depends)
    return found.select("path", "ordinal", "name", F.explode(every).alias("s")).select("path", "ordinal", "s.signal", "name", "s.target", "s.port", "s.route")
