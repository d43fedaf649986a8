"""Chunkers: documents into pieces of bounded token counts. Packing is a fold over a document's own lines."""

from __future__ import annotations

import ast
import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import token_count
from granary.operators import lexer
from granary.operators.batches import flat_map

MAX_TOKENS, OVERLAP = 512, 50
CHUNK = "doc_id long, ordinal int, chunk_id string, text string, start long, end long, kind string, name string"
_TOKEN = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^\s\w]")


def count_tokens(text: str) -> int:
    """The rule of functions.text.token_count, in Python."""
    n = 0
    for t in _TOKEN.findall(text):
        size = len(t)
        if size > 10 and t[0].isalpha():
            n += -(-size // (size // max(1, size // 4)))
        else:
            n += 1
    return n


def pack(items: Sequence[str], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Runs [first, end) of items: each takes items while it stays within limit, and begins with as many of the
    run before it as have overlap tokens at most. An item over the limit is a run by itself."""
    sizes = [count_tokens(x) for x in items]
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if total + size > limit and k > first:
            yield first, k
            first, total = k, 0
            while first > 0 and total + sizes[first - 1] <= overlap:
                first -= 1
                total += sizes[first]
        total += size
    if items:
        yield first, len(items)


def _id(uri: str, start: int, end: int) -> str:
    return hashlib.sha256(f"{uri}:{start}:{end}".encode()).hexdigest()


def line_spans(text: str, base: int, limit: int, overlap: int, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of packed lines, in bytes from base; the last one ends at end if given."""
    lines = text.split("\n")
    starts = [base]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()) + 1)
    runs = list(pack(lines, limit, overlap))
    for k, (a, b) in enumerate(runs):
        part = "\n".join(lines[a:b])
        yield part, starts[a], end if end is not None and k == len(runs) - 1 else starts[a] + len(part.encode())


def _map(docs: DataFrame, cut, *more: str) -> DataFrame:
    """Runs cut(uri, text) on each row (doc_id, uri, text) and numbers what it gives. more: further columns for cut."""

    def each(doc_id: int, uri: str | None, text: str | None, *rest: object) -> Iterator[tuple]:
        for k, (part, start, end, kind, name) in enumerate(cut(uri or "", text or "", *rest)):
            yield doc_id, k, _id(uri or "", start, end), part, start, end, kind, name

    return flat_map(docs.select(F.col("doc_id").cast("long"), "uri", "text", *more), each, CHUNK)


def line_chunks(docs: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Whole files in runs of lines. An empty or null text gives one empty chunk."""
    return _map(docs, lambda uri, text: ((p, a, b, "segment", "<file_segment>") for p, a, b in line_spans(text, 0, limit, overlap, len(text.encode()))))


def code_chunks(docs: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Outermost functions, classes and types of sources (doc_id, uri, text, language), as chunks; large ones in runs of
    lines, named <name>_part. Files without any, of another language, or that do not parse, are cut as line_chunks does."""

    def cut(uri: str, text: str, language: str) -> Iterator[tuple[str, int, int, str, str]]:
        found = python_symbols(text) if language == "python" else brace_symbols(text, language) if language in _BEGIN else ()
        none = True
        for start, end, kind, name in found:
            none = False
            part, a = text[start:end], len(text[:start].encode())
            b = a + len(part.encode())
            if count_tokens(part) <= limit:
                yield part, a, b, kind, name
            else:
                yield from ((p, x, y, "partial", f"{name}_part") for p, x, y in line_spans(part, a, limit, overlap, b))
        if none:
            yield from ((p, a, b, "segment", "<file_segment>") for p, a, b in line_spans(text, 0, limit, overlap, len(text.encode())))

    return _map(docs, cut, "language")


#: Names are those that stand right under a symbol in its grammar: methods and types of Go and classes of TypeScript have
#: none there, nor have decorated Python definitions.
NAMELESS = {("go", "type"), ("typescript", "class")}
ANONYMOUS = "<anonymous>"
#: Words that may stand before a symbol's own, and those that begin it.
_BEFORE = {"typescript": ("export", "default", "declare", "abstract"), "csharp": ("public", "private", "protected", "internal", "static", "sealed", "abstract", "partial", "readonly", "file", "unsafe", "ref", "record", "new")}
_BEGIN = {"go": ("func", "type"), "typescript": ("function", "class"), "csharp": ("class", "struct")}


def _statement(nodes: list[lexer.Node], k: int, text: str, language: str) -> list[lexer.Node]:
    """The nodes from place k on to the end of a line in Go, and else to a semicolon or a body in braces."""
    run = [nodes[k]]
    for before, c in itertools.pairwise(itertools.islice(nodes, k, None)):
        if language == "go" and "\n" in text[before.end : c.start] or run[-1].said(text) == ";":
            break
        run.append(c)
        if language != "go" and c.open == "{" and before.said(text) not in (":", "|", "&", "<", ",", "=>"):
            break
    return run


def _symbol(run: list[lexer.Node], text: str, language: str) -> tuple[int, int, str, str] | None:
    """(start, end, kind, name) of the symbol that a statement is, if it is one."""
    said = [c.open or c.said(text) for c in run]
    k = 0
    while k < len(run) and (said[k] in _BEFORE.get(language, ()) or language == "csharp" and said[k] == "["):
        k += 1
    start = run[0].start if language == "csharp" or k == len(run) else run[k].start
    k += language == "typescript" and said[k : k + 1] == ["async"]
    if k == len(run) or said[k] not in _BEGIN[language]:
        return None
    kind, k = said[k], k + 1
    k += language == "typescript" and said[k : k + 1] == ["*"]
    named = k < len(run) and run[k].kind == "name"
    if not named and said[k : k + 1] != (["("] if (language, kind) == ("go", "func") else [None]):
        return None
    if language != "go" and run[-1].open != "{":
        return None
    braces = [c for c in run if c.open == "{"]
    end = braces[-1].end if kind == "func" and braces else run[-1].end
    return start, end, {"func": "function"}.get(kind, kind), said[k] if named and (language, kind) not in NAMELESS else ANONYMOUS


def brace_symbols(text: str, language: str) -> Iterator[tuple[int, int, str, str]]:
    """The outermost symbols of a source with braces, in characters, from its tree of brackets; a symbol that is not closed
    ends with the text."""
    stack = [(lexer.tree(text, language).children, 0, True)]
    while stack:
        nodes, k, braces = stack.pop()  # statements stand in braces, or in none
        while k < len(nodes):
            before = nodes[k - 1] if k else None
            begins = braces and (before is None or "\n" in text[before.end : nodes[k].start] or before.said(text) == ";" or before.open == "{")
            found = _symbol(_statement(nodes, k, text, language), text, language) if begins and nodes[k].kind in ("name", "group") else None
            if found:
                yield found
                while k < len(nodes) and nodes[k].start < found[1]:
                    k += 1
            elif nodes[k].children and language != "go":
                stack.append((nodes, k + 1, braces))
                nodes, k, braces = nodes[k].children, 0, nodes[k].open == "{"
            else:
                k += 1


def python_symbols(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The same for a Python source, decorators included; none if it does not parse."""
    try:
        nodes = list(outermost(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError):
        return
    starts, raw = [0], text.encode()
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    for node in nodes:
        first = min([node, *node.decorator_list], key=lambda n: n.lineno)
        a = starts[first.lineno - 1] + first.col_offset - (first is not node)
        b = starts[node.end_lineno - 1] + node.end_col_offset
        start = len(raw[:a].decode())
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        yield start, start + len(raw[a:b].decode()), kind, ANONYMOUS if node.decorator_list else node.name


def outermost(node: ast.AST) -> Iterator[ast.AST]:
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield child
        else:
            yield from outermost(child)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, heading, level, text): what stands from each heading of 1 to 6 signs to the next, trimmed.

    Text before the first heading is the section 0, named (preamble), if it is not blank; a text without headings is
    one section of level 0 with an empty heading. Texts are cut in their rows: nothing is shuffled or runs in Python.
    """
    head = r"^#{1,6}\s+\S"
    parts = F.split("text", r"(?dm)(?=^#{1,6}[^\S\n]+\S)", -1)
    cut = docs.select("doc_id", parts.alias("parts")).withColumn("headed", F.substring_index(F.get("parts", 0), "\n", 1).rlike(head))
    rows = cut.select("doc_id", "headed", (F.size("parts") == 1).alias("alone"), F.posexplode("parts").alias("pos", "raw"))
    line, section = F.substring_index("raw", "\n", 1), F.col("pos") + F.col("headed").cast("int")
    none = F.col("alone") & ~F.col("headed")
    text = F.when(none, F.col("raw")).otherwise(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    heading = F.when(none, "").when(section == 0, "(preamble)").otherwise(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1))
    level = F.when(section == 0, 0).otherwise(F.length(F.regexp_extract(line, "^(#{1,6})", 1)))
    out = rows.select("doc_id", section.cast("long").alias("section"), none.alias("none"), heading.alias("heading"), level.alias("level"), text.alias("text"))
    return out.filter("none or section > 0 or text <> ''").drop("none")


def section_chunks(sections: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Sections (doc_id, uri, text) in chunks: paragraphs are packed without overlap, a paragraph over the limit by lines."""

    def cut(uri: str, text: str) -> Iterator[tuple[str, int, int, str, str]]:
        if count_tokens(text) <= limit:
            yield text, 0, len(text.encode()), "section", ""
            return
        at, held, total = 0, [], 0
        for para in re.split(r"\n\n+", text):
            size = count_tokens(para)
            if held and total + size > limit:
                part = "\n\n".join(held)
                yield part, at, at + len(part.encode()), "partial", ""
                at, held, total = at + len(part.encode()) + 2, [], 0
            if size > limit:
                yield from ((p, a, b, "partial", "") for p, a, b in line_spans(para, at, limit, 0))
                at += len(para.encode()) + 2
            else:
                held.append(para)
                total += size
        if held:
            part = "\n\n".join(held)
            yield part, at, len(text.encode()), "section", ""

    return _map(sections, cut)


def messages(talks: DataFrame) -> DataFrame:
    """(uri, doc_id, pos, thread, ts, speaker, text) of conversations as text (uri, doc_id, content).

    A JSON list, or an object with messages, gives its items of type message; the speaker is user, else username,
    else unknown. Other text gives its lines `Speaker: text` (what stands before a colon, over lines too); without any, all of it is one message of unknown.
    Blank and null texts have none.
    """
    item = "type string, user string, username string, text string, ts string, thread_ts string"
    content = F.coalesce("content", F.lit(""))
    is_json = F.try_parse_json(content).isNotNull() & content.rlike(r"^\s*[\[{]")
    listed = F.when(content.rlike(r"^\s*\["), content).otherwise(F.get_json_object(content, "$.messages"))
    items = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))
    of_json = F.transform(
        F.filter(F.transform(items, lambda x: F.from_json(x, item)), lambda m: m["type"] == "message"),
        lambda m: F.struct(m["thread_ts"].alias("thread"), F.timestamp_seconds(m["ts"].try_cast("double")).alias("ts"), F.coalesce(m["user"], m["username"], F.lit("unknown")).alias("speaker"), F.coalesce(m["text"], F.lit("")).alias("text")),
    )
    message = "struct<thread: string, ts: timestamp, speaker: string, text: string>"
    row = lambda speaker, text: F.struct(F.lit(None).cast("string").alias("thread"), F.lit(None).cast("timestamp").alias("ts"), speaker.alias("speaker"), text.alias("text"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    spoken = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^[^:]+:\s*.+$"), F.lit(0)), lambda x: row(bare(F.regexp_extract(x, r"^([^:]+):", 1)), bare(F.regexp_extract(x, r"^[^:]+:\s*(.+)$", 1))))
    whole = F.when(content.rlike(r"\S"), F.array(row(F.lit("unknown"), bare(content)))).otherwise(F.array().cast(f"array<{message}>"))
    found = F.when(is_json, of_json).when(F.size(spoken) > 0, spoken).otherwise(whole)
    rows = talks.select("uri", "doc_id", F.posexplode(found).alias("pos", "m"))
    return rows.select("uri", "doc_id", "pos", "m.thread", "m.ts", "m.speaker", "m.text")


def pieces(text: str, language: str, limit: int) -> Iterator[tuple[int, int]]:
    """[start, end) in characters of a source's pieces: every character is in exactly one, and none has over limit tokens
    but where a single token or literal has.

    A part within limit stays whole. A larger one is cut before its statements, these before their tokens, and a group
    behind its opening bracket, level by level; neighbours of a level are then joined as long as limit allows. White space
    and comments go with what follows them.
    """
    work: list[tuple[int, int, list[lexer.Node], bool]] = [(0, len(text), lexer.tree(text, language).children, True)]
    while work:  # parts of one level are taken from the last to the first
        start, end, nodes, by_lines = work.pop()
        if count_tokens(text[start:end]) <= limit or not nodes:
            if end > start:
                yield start, end
            continue
        runs = [[nodes[0]]]
        for before, c in itertools.pairwise(nodes):
            if not by_lines or "\n" in text[before.end : c.start] or before.said(text) == ";":
                runs.append([])
            runs[-1].append(c)
        if len(runs) == 1 and len(nodes) > 1:
            work.append((start, end, nodes, False))
            continue
        if len(nodes) == 1:
            node = nodes[0]
            inside = node.start + len(node.open) if node.kind == "group" else node.children[0].start if node.children else end
            if not node.children or inside >= end:
                yield start, end
                continue
            work.append((inside, end, node.children, True))
            if inside > start:
                work.append((start, inside, [], True))
            continue
        edges = [start, *(r[0].start for r in runs[1:]), end]
        sizes = [count_tokens(text[a:b]) for a, b in itertools.pairwise(edges)]
        level, first, total = [], 0, 0
        for k, size in enumerate(sizes):
            if k > first and total + size > limit:
                level.append((first, k))
                first, total = k, 0
            total += size
        level.append((first, len(runs)))
        for a, b in reversed(level):
            work.append((edges[a], edges[b], [c for r in runs[a:b] for c in r], by_lines))


def tree_chunks(docs: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Sources (doc_id, uri, text, language) cut along their trees of brackets, see pieces(); texts of other languages are
    cut as line_chunks does, without overlap. An empty or null text gives no chunk."""

    def cut(uri: str, text: str, language: str) -> Iterator[tuple[str, int, int, str, str]]:
        if language not in lexer.TOKENS:
            yield from ((p, a, b, "segment", "<file_segment>") for p, a, b in line_spans(text, 0, limit, 0, len(text.encode())) if text)
            return
        at = 0
        for a, b in pieces(text, language, limit):
            part = text[a:b]
            yield part, at, (at := at + len(part.encode())), "piece", ""

    return _map(docs, cut, "language")


def merged_siblings(chunks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, ordinal, first, last, n_tokens, text) of chunks (doc_id, ordinal, text): neighbours of a document are
    joined by line ends as long as limit allows; a chunk over the limit stays alone."""
    sized = chunks.withColumn("size", token_count(F.col("text")))
    listed = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "size", "text"))).alias("l"))  # one document's own
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def each(doc_id: object, parts: list[dict]) -> Iterator[tuple]:
        made = lambda k, r: (doc_id, k, r[0]["ordinal"], r[-1]["ordinal"], sum(p["size"] for p in r), "\n".join(p["text"] for p in r))
        run: list[dict] = []
        total = k = 0
        for p in parts:
            if run and total + p["size"] > limit:
                yield made(k, run)
                run, total, k = [], 0, k + 1
            run.append(p)
            total += p["size"]
        if run:
            yield made(k, run)

    return flat_map(listed, each, f"doc_id {kind}, ordinal int, first int, last int, n_tokens long, text string")


def threads(messages: DataFrame) -> DataFrame:
    """(uri, thread, text, n, speakers): messages (uri, pos, thread, ts, speaker, text) of a thread as lines
    `[time] speaker: text`, in order; without a thread they belong to main."""
    prefix = F.when(F.col("ts").isNotNull(), F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "))).otherwise("")
    line = F.concat(prefix, F.coalesce("speaker", F.lit("unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x.line)
    return messages.groupBy("uri", F.coalesce("thread", F.lit("main")).alias("thread")).agg(F.array_join(ordered, "\n").alias("text"), F.count("*").alias("n"), F.sort_array(F.collect_set("speaker")).alias("speakers"))


def thread_chunks(messages: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, ordinal, first, last, text): a thread's messages (doc_id, pos, line) in runs within limit, each beginning
    with the last message of the run before."""
    listed = messages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line).alias("lines"))

    def each(doc_id: int, lines: list[str]) -> Iterator[tuple]:
        sizes = [count_tokens(x) for x in lines]
        first, total, k = 0, 0, 0
        for i, size in enumerate(sizes):
            if total + size > limit and i > first:
                yield doc_id, k, first, i - 1, "\n".join(lines[first:i])
                first, total, k = i - 1, sizes[i - 1], k + 1
            total += size
        yield doc_id, k, first, len(lines) - 1, "\n".join(lines[first:])

    return flat_map(listed, each, "doc_id long, ordinal int, first int, last int, text string")


def windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, window, text): size words each, the next one size - overlap words on, as long as new words come."""
    step = size - overlap
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = docs.select("doc_id", w.alias("w")).withColumn("last", F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int"))
    texts = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.array_join(F.slice("w", k * step + 1, size), " "))  # the words are in one row
    return rows.select("doc_id", F.posexplode(texts).alias("window", "text"))


def token_windows(docs: DataFrame, size: int = 1600, overlap: int = 160) -> DataFrame:
    """(doc_id, ordinal, first, last, text): whole words of size tokens at most, each window beginning with as many of the
    last one's words as have overlap tokens at most. A text without words has none."""

    def each(doc_id: int, text: str | None) -> Iterator[tuple]:
        words = (text or "").split()
        for k, (a, b) in enumerate(pack(words, size, overlap)):
            yield doc_id, k, a, b - 1, " ".join(words[a:b])

    return flat_map(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, ordinal int, first int, last int, text string")
